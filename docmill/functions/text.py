"""Text functions on columns: normalising, extracting, formatting. Script ranges and lists are parameters."""

from __future__ import annotations

import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

# Marks, letters, digits and phrases of Arabic legal texts.
DIACRITICS = r"[\u0610-\u061A\u064B-\u065F\u0670\u06D6-\u06DC\u06DF-\u06E4\u06E7-\u06E8\u06EA-\u06ED]"
CITATION_DIACRITICS = r"[\u0610-\u061A\u064B-\u065F\u0670]"
ALEFS, ALEF = "أإآٱ", "ا" * 4
MAQSURA, YEH = "ى", "ي"
TA_MARBUTA, HEH = "ة", "ه"
ARABIC_DIGITS, PERSIAN_DIGITS, DIGITS = "٠١٢٣٤٥٦٧٨٩", "۰۱۲۳۴۵۶۷۸۹", "0123456789"
ARABIC = r"[\u0600-\u06FF]"
ARTICLE = r"المادة\s+(\d+)"
CITATIONS = (
    (r"(?:المادة|مادة|م\.?)\s*[(\[]?\s*(\d+)\s*[)\]]?", (1,)),
    (r"(?:المادة|مادة)\s+رقم\s*[(\[]?\s*(\d+)\s*[)\]]?", (1,)),
    (r"(?:المواد|مواد)\s+(?:من\s+)?(\d+)\s*(?:إلى|حتى)\s*(\d+)", (1, 2)),
    (r"(?:الفقرة|فقرة)\s*[(\[]?\s*(\d+)\s*[)\]]?\s*من\s*(?:المادة|مادة)\s*(\d+)", (1, 2)),
)
ENTITIES = (r"\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4}", r"\d[\d,.]* (?:جنيه|دولار|يورو)", r"(?:السيد|السيدة|الأستاذ|الشركة)\s+\S+")
ARTICLE_RANGE = r"(?:بين\s*(\d+)\s*و\s*(\d+)|من\s*(?:المادة\s*)?(\d+)\s*(?:الي|إلى|إلي|الى)\s*(?:المادة\s*)?(\d+))"
ORDINALS = {
    1: ("الأول", "الأولى"), 2: ("الثاني", "الثانية"), 3: ("الثالث", "الثالثة"), 4: ("الرابع", "الرابعة"), 5: ("الخامس", "الخامسة"),
    6: ("السادس", "السادسة"), 7: ("السابع", "السابعة"), 8: ("الثامن", "الثامنة"), 9: ("التاسع", "التاسعة"), 10: ("العاشر", "العاشرة"),
}
NUMBERED = "رقم "


def squeeze(text: Column) -> Column:
    """Every run of white space (of any script) becomes one space, ends trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


@cache
def _normal_form(form: str):
    """The one thing here that Spark has no function for."""

    @pandas_udf("string")
    def convert(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None else unicodedata.normalize(form, t))

    return convert


def composed(text: Column, form: str = "NFC") -> Column:
    """In a Unicode normal form; only texts with something beyond ASCII leave the JVM.

    A function behind a condition still sees every row, so it gets a null for the others.
    """
    return F.coalesce(_normal_form(form)(F.when(text.rlike(r"[^\x00-\x7f]"), text)), text)


def folded(text: Column) -> Column:
    """The key under which strings count as equal: NFKC, trimmed, lower case."""
    return F.lower(F.trim(composed(text, "NFKC")))


def normalize(text: Column, ta_marbuta: bool = False) -> Column:
    """Diacritics out, hamza alefs and maqsura unified, NFC, white space squeezed, in this order."""
    out = F.translate(F.regexp_replace(text, DIACRITICS, ""), ALEFS + MAQSURA, ALEF + YEH)
    if ta_marbuta:
        out = F.translate(out, TA_MARBUTA, HEH)
    return squeeze(composed(out))


def digits(text: Column, persian: bool = False) -> Column:
    """Arabic-Indic (and Persian) digits as 0-9."""
    return F.translate(text, ARABIC_DIGITS + (PERSIAN_DIGITS if persian else ""), DIGITS * (1 + persian))


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, "<[^>]+>", "")


def for_matching(text: Column) -> Column:
    """Hamza alefs and maqsura only."""
    return F.translate(text, ALEFS + MAQSURA, ALEF + YEH)


def clean(text: Column) -> Column:
    """Direction marks, stretched letters, page lines, letterhead and stamp out; blanks squeezed."""
    out = F.translate(text, "\u200f\u200e", "")
    for pattern in (r"\u0640+", r"(?m)^\s*-\s*\d+\s*-\s*$", r"(?m)^[^\n]*وزارة العدل[^\n]*$\n^[^\n]*محكمة[^\n]*$", "صورة طبق الأصل"):
        out = F.regexp_replace(out, pattern, "")
    return F.regexp_replace(F.regexp_replace(out, "[ \t]+", " "), r"^\s+|\s+$", "")


def lines(text: Column) -> Column:
    """Trimmed lines that are not empty."""
    return F.filter(F.transform(F.split(text, "\n", -1), lambda x: F.trim(x)), lambda x: x != "")


def first_lines(text: Column, n: int = 2, joint: str = " - ") -> Column:
    return F.array_join(F.slice(lines(text), 1, n), joint)


def first_line(text: Column, most: int = 80) -> Column:
    """The first line that is not empty, else the first characters."""
    return F.coalesce(F.get(lines(text), F.lit(0)), F.substring(text, 1, most))


def article_id(text: Column) -> Column:
    """A number in either script's digits, else null."""
    plain = digits(F.trim(text))
    return F.when(plain.rlike(r"^\d+$"), plain.try_cast("int"))


def extract_ints(text: Column, pattern: str, group: int = 1) -> Column:
    """Distinct numbers that a pattern's group finds, in order of appearance."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(pattern), group), lambda x: x.try_cast("int")))


def cited_articles(text: Column, pattern: str = ARTICLE) -> Column:
    return extract_ints(digits(text), pattern)


def rich_citations(text: Column, patterns=CITATIONS) -> Column:
    """All numbers of all citation forms; a range gives its two ends only."""
    plain = digits(composed(F.regexp_replace(text, CITATION_DIACRITICS, "")))
    found = [extract_ints(plain, p, g) for p, groups in patterns for g in groups]
    return F.array_sort(F.array_distinct(F.concat(*found)))


def scrub_citations(text: Column, invalid: Column, word: str = "المادة") -> Column:
    """The text without citations of the invalid numbers, white space runs then single."""
    def drop(out: Column, number: Column) -> Column:
        return F.regexp_replace(out, F.concat(F.lit(word + r"\s+"), number.cast("string"), F.lit(r"(?!\d)")), F.lit(""))

    cut = F.aggregate(invalid, text, drop)
    return F.when(F.size(invalid) == 0, text).otherwise(F.trim(F.regexp_replace(cut, r"(?U)\s{2,}", " ")))


def citation_integrity(cited: Column, invalid: Column) -> Column:
    return F.when(F.size(cited) == 0, "none").when(F.size(invalid) == 0, "full").otherwise("partial")


def strip_fences(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```[A-Za-z]*\s*", ""), r"\s*```$", ""))


def json_strings(text: Column) -> Column:
    """The trimmed strings of a JSON list, wherever it stands in the text; else the text itself."""
    body = strip_fences(text)
    as_list = lambda t: F.from_json(t, "array<string>", {"mode": "PERMISSIVE"})
    found = F.coalesce(as_list(body), as_list(F.regexp_extract(body, r"(?s)(\[.*?\])", 1)))
    trimmed = F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))
    return F.when(F.size(F.coalesce(trimmed, F.array().cast("array<string>"))) > 0, trimmed).otherwise(F.array(F.trim(text)))


def query_range(query: Column, pattern: str = ARTICLE_RANGE) -> Column:
    """(start, end) of an article range that a question names, else of its single article, else null."""
    part = lambda i: F.nullif(F.regexp_extract(digits(query), pattern, i), F.lit("")).cast("int")
    one = F.get(cited_articles(query, r"المادة\s*(\d+)"), F.lit(0))
    start, end = F.coalesce(part(1), part(3), one), F.coalesce(part(2), part(4), one)
    return F.when(start.isNotNull(), F.struct(start.alias("start"), end.alias("end")))


def entities(text: Column, patterns=ENTITIES) -> Column:
    found = [F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({p})"), 1) for p in patterns]
    return F.array_distinct(F.transform(F.concat(*found), lambda x: F.trim(x)))


def numbers(text: Column) -> Column:
    """Numbers as written, of more than one character."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(\b\d[\d,./٠-٩]*\b)"), 1)
    return F.filter(found, lambda x: F.char_length(x) > 1)


def header(text: Column, n: int = 6) -> Column:
    return F.array_join(F.slice(F.split(text, "\n", -1), 1, n), "\n")


def excerpt(text: Column, n: int = 400) -> Column:
    words = F.filter(F.split(text, r"(?U)\s+", -1), lambda x: x != "")
    return F.array_join(F.slice(words, 1, n), " ")


def citation_label(doc: Column, page: Column, paragraph: Column) -> Column:
    return F.format_string("%s ص%s ف%s", doc, page.cast("string"), paragraph.cast("string"))


def detect_rank(doc_id: Column) -> Column:
    """Rank of the first ordinal word (from the tenth down, either gender) or digit that occurs."""
    seen = for_matching(doc_id)
    words = [F.when(seen.contains(w.translate(str.maketrans(ALEFS + MAQSURA, ALEF + YEH))), r) for r in sorted(ORDINALS, reverse=True) for w in ORDINALS[r]]
    return F.coalesce(*words, *[F.when(seen.contains(str(r)), r) for r in range(10, 0, -1)])


def ordinal(rank: Column, feminine: Column) -> Column:
    pick = F.coalesce(*[F.when(rank == r, F.when(feminine, f).otherwise(m)) for r, (m, f) in ORDINALS.items()])
    return F.coalesce(pick, F.concat(F.lit(NUMBERED), rank.cast("string")))


def cache_key(*parts: Column, length: int = 16) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, length)


def uuid5(name: Column, namespace: str = "6ba7b810-9dad-11d1-80b4-00c04fd430c8") -> Column:
    """The name-based UUID (version 5) of a string."""
    space = F.unhex(F.lit(namespace.replace("-", "")))
    digest = F.sha1(F.concat(space, F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4 + 1), F.lit(1))
    part = lambda a, n: F.substring(digest, a, n)
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))


def new_id(prefix: str, *seed: Column) -> Column:
    """prefix_ and 12 hex digits: of the seed if there is one (repeatable), else random."""
    body = F.md5(F.concat_ws("|", *seed)) if seed else F.replace(F.uuid(), F.lit("-"), F.lit(""))
    return F.concat(F.lit(f"{prefix}_"), F.substring(body, 1, 12))


def escape_braces(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("{"), F.lit("{{")), F.lit("}"), F.lit("}}"))


def history_text(turns: Column, roles: dict[str, str]) -> Column:
    """'Label: text' lines of the turns (role, text) that say something."""
    label = lambda r: F.coalesce(*[F.when(r == k, v) for k, v in roles.items()], r)
    said = F.filter(turns, lambda t: F.trim(F.coalesce(t["text"], F.lit(""))) != "")
    return F.array_join(F.transform(said, lambda t: F.concat(label(t["role"]), F.lit(": "), t["text"])), "\n")


def first_keyword(text: Column, table: dict[str, list[str]], default: str | None = None) -> Column:
    """The first class, in the table's order, of which any keyword occurs."""
    def any_of(words: list[str]) -> Column:
        found = text.contains(words[0])
        for w in words[1:]:
            found = found | text.contains(w)
        return found

    return F.coalesce(*[F.when(any_of(ws), c) for c, ws in table.items() if ws], F.lit(default).cast("string"))


def keyword_score(text: Column, table: dict[str, list[str]], points: int = 25, cap: int = 100) -> Column:
    """(doc_type, confidence, keywords) of the class with most keywords; earlier classes win ties, no hit gives null."""
    def hits(words: list[str]) -> Column:
        return F.filter(F.array(*[F.lit(w) for w in words]), lambda w: text.contains(w))

    kinds = [(c, ws) for c, ws in table.items() if ws]
    rows = F.array(*[F.struct(F.size(hits(ws)).alias("n"), F.lit(-i).alias("at"), F.lit(c).alias("c"), hits(ws).alias("k")) for i, (c, ws) in enumerate(kinds)])
    best = F.array_max(rows)
    return F.struct(
        F.when(best["n"] > 0, best["c"]).alias("doc_type"),
        F.least(best["n"] * points, F.lit(cap)).alias("confidence"),
        F.when(best["n"] > 0, best["k"]).otherwise(F.array().cast("array<string>")).alias("keywords"),
    )


def sse(event: Column, data: Column) -> Column:
    return F.concat(F.lit("event: "), event, F.lit("\ndata: "), data, F.lit("\n\n"))


def read_sse(frame: Column) -> Column:
    return F.struct(
        F.regexp_extract(frame, r"(?m)^event: (.*)$", 1).alias("event"), F.regexp_extract(frame, r"(?m)^data: (.*)$", 1).alias("data")
    )


def basename(path: Column) -> Column:
    return F.regexp_extract(F.replace(path, F.lit("\\"), F.lit("/")), r"([^/]+)/?$", 1)


def object_key(case_id: Column, record_id: Column, path: Column) -> Column:
    safe = F.regexp_replace(F.coalesce(F.nullif(case_id, F.lit("")), F.lit("no-case")), r"[^a-zA-Z0-9_\-]", "_")
    return F.concat_ws("/", safe, record_id, basename(path))


def truncated(text: Column, most: int, mark: str = "...") -> Column:
    return F.when(F.char_length(text) > most, F.concat(F.substring(text, 1, most), F.lit(mark))).otherwise(text)


def script_ratio(text: Column, script: str = ARABIC) -> Column:
    """Share of the characters that are not white space which belong to a script; 0 without any."""
    solid = F.regexp_replace(text, r"(?U)\s", "")
    return F.coalesce(F.try_divide(F.regexp_count(solid, F.lit(script)), F.char_length(solid)), F.lit(0.0))
