"""Text operators over documents, pages, conversations and events."""

import uuid

from pyspark.sql import functions as F

from docmill.functions import guards as G, text as T
from docmill.operators import chunking
from docmill.plans.registry import query
from docmill.sources import index
from docmill.tables import shared, table

LATIN = r"[A-Za-zÀ-ÿ]"
#: Stand-ins for class keywords in the invented prose.
KEYWORDS = {"claim": ["the", "Licensed", "that"], "defence": ["der", "und", "Die"], "judgment": ["que", "les", "une", "des"], "unknown": []}


@query("text_flatten", "SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g'), ' ') AS flat FROM documents")
def flatten(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.squeeze(F.col("text")).alias("flat"))


@query("text_normalize", "SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g'), ' ') AS norm FROM documents")
def normalize(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.normalize(F.col("text")).alias("norm"))


@query("strip_html", "SELECT page_id, md5(regexp_replace(html, '<[^>]+>', '', 'g')) AS body_md5, length(regexp_replace(html, '<[^>]+>', '', 'g')) AS n FROM pages")
def strip_html(spark, sf_dir):
    body = T.strip_tags(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.md5(body).alias("body_md5"), F.char_length(body).cast("long").alias("n"))


@query("digits_translate", "SELECT event_id, translate(translate(props, '0123456789', '٠١٢٣٤٥٦٧٨٩'), '٠١٢٣٤٥٦٧٨٩', '0123456789') AS plain FROM events")
def digits(spark, sf_dir):
    arabic = F.translate("props", T.DIGITS, T.ARABIC_DIGITS)
    return table(spark, sf_dir, "events").select("event_id", T.digits(arabic, persian=True).alias("plain"))


@query("title_extract", "SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '')[1:2], ' - ') AS title FROM documents")
def titles(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.first_lines(F.col("text")).alias("title"))


@query(
    "script_ratio_validate",
    """WITH s AS (SELECT doc_id, trim(text, ' ') AS q, regexp_replace(text, '[ \\t\\n\\r]', '', 'g') AS solid FROM documents),
    r AS (SELECT *, coalesce(len(regexp_extract_all(solid, '[A-Za-zÀ-ÿ]'))::DOUBLE / nullif(length(solid), 0), 0) AS ratio FROM s)
    SELECT doc_id, round(ratio, 6) AS ratio, CASE WHEN q = '' THEN 'empty' WHEN length(q) < 3 THEN 'too_short' WHEN length(q) > 2000 THEN 'too_long' WHEN ratio < 0.3 THEN 'wrong_script' END AS fault FROM r""",
)
def validate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.round(T.script_ratio(F.col("text"), LATIN), 6).alias("ratio"), G.query_fault(F.col("text"), LATIN).alias("fault")
    )


@query(
    "injection_guard",
    """SELECT conv_id, turn, CASE WHEN text IS NULL OR trim(text, ' ') = '' THEN 'empty' WHEN length(text) > 4000 THEN 'too_long'
    WHEN regexp_matches(text, '(?i)\\bthe\\s+\\w+ion') THEN 'injection_1' WHEN regexp_matches(text, '(?i)der\\s+ein') THEN 'injection_2' END AS fault FROM conversations""",
)
def injection(spark, sf_dir):
    found = G.input_fault(F.col("text"), patterns=(r"\bthe\s+\w+ion", r"der\s+ein"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", found.alias("fault"))


@query("fast_filter", "SELECT conv_id, turn, length(trim(coalesce(text, ''), ' ')) < 5 OR NOT regexp_matches(trim(coalesce(text, ''), ' '), '[A-Za-zÀ-ÿ]') AS off_topic FROM conversations")
def fast_filter(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", G.fast_off_topic(F.col("text"), LATIN).alias("off_topic"))


@query(
    "paragraph_segment",
    """SELECT doc_id, i::INT AS paragraph_number, trim(p, ' ') AS clean_text FROM (SELECT doc_id, unnest(string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10))) AS p,
    generate_subscripts(string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10)), 1) AS i FROM documents) WHERE trim(p, ' ') <> ''""",
)
def segment(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return chunking.paragraphs(docs, "doc_id", "text")


@query(
    "page_fold",
    """WITH RECURSIVE p AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS ps FROM documents),
    f AS (SELECT doc_id, ps, 1 AS i, CASE WHEN length(ps[1]) > 2000 THEN 2 ELSE 1 END AS page, CASE WHEN length(ps[1]) > 2000 THEN 0 ELSE length(ps[1]) END AS s FROM p WHERE len(ps) > 0
    UNION ALL SELECT doc_id, ps, i + 1, CASE WHEN s + length(ps[i + 1]) > 2000 THEN page + 1 ELSE page END, CASE WHEN s + length(ps[i + 1]) > 2000 THEN 0 ELSE s + length(ps[i + 1]) END FROM f WHERE i < len(ps))
    SELECT doc_id, count(*) AS n_paragraphs, max(page)::INT AS last_page, sum(page)::BIGINT AS page_sum FROM f GROUP BY doc_id""",
)
def page_fold(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    rows = chunking.segments(docs, "doc_id", "text")
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_paragraphs"), F.max("page_number").alias("last_page"), F.sum("page_number").alias("page_sum"))


@query("chunk_ids", """SELECT doc_id, count(*) AS n, count(DISTINCT i) AS n_ids FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS p FROM documents) WHERE trim(p, ' ') <> '' GROUP BY doc_id""")
def chunk_ids(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    rows = chunking.segments(docs, "doc_id", "text").filter(F.col("chunk_id").rlike("^[0-9a-f]{8}-[0-9a-f]{4}-5[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_distinct("chunk_id").alias("n_ids"))


@query("recursive_chunks")
def recursive_chunks(spark, sf_dir):
    return chunking.chunks(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("header_excerpt", """SELECT doc_id, array_to_string(string_split(text, chr(10))[1:6], chr(10)) AS header, array_to_string(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r]+'), lambda x: x <> '')[1:400], ' ') AS excerpt FROM documents""")
def header_excerpt(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.header(F.col("text")).alias("header"), T.excerpt(F.col("text")).alias("excerpt"))


HITS = ", ".join(f"{' + '.join(f'contains(text, {w!r})::INT' for w in ws)} AS {c}" for c, ws in KEYWORDS.items() if ws)


@query(
    "keyword_classify",
    f"""WITH h AS (SELECT doc_id, {HITS} FROM documents), b AS (SELECT *, greatest(claim, defence, judgment) AS n FROM h)
    SELECT doc_id, CASE WHEN n = 0 THEN NULL WHEN claim = n THEN 'claim' WHEN defence = n THEN 'defence' ELSE 'judgment' END AS doc_type, least(100, 25 * n)::INT AS confidence,
    CASE WHEN least(100, 25 * n) >= 70 THEN 'heuristic' ELSE 'llm' END AS route FROM b""",
)
def keyword_classify(spark, sf_dir):
    scored = table(spark, sf_dir, "documents").select("doc_id", T.keyword_score(F.col("text"), KEYWORDS).alias("k")).select("doc_id", "k.doc_type", "k.confidence")
    return scored.withColumn("route", F.when(F.col("confidence") >= 70, "heuristic").otherwise("llm"))


@query("doc_type_first_match", """SELECT doc_id, CASE WHEN contains(left(text, 2000), 'the') OR contains(left(text, 2000), 'Licensed') OR contains(left(text, 2000), 'that') THEN 'claim' WHEN contains(left(text, 2000), 'der') OR contains(left(text, 2000), 'und') OR contains(left(text, 2000), 'Die') THEN 'defence'
    WHEN contains(left(text, 2000), 'que') OR contains(left(text, 2000), 'les') OR contains(left(text, 2000), 'une') OR contains(left(text, 2000), 'des') THEN 'judgment' ELSE 'none' END AS doc_type FROM documents""")
def first_match(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.first_keyword(F.substring("text", 1, 2000), KEYWORDS, "none").alias("doc_type"))


@query("number_extract", r"SELECT doc_id, array_to_string(list_filter(regexp_extract_all(text, '\b[0-9][0-9,./]*\b'), lambda x: length(x) > 1), '|') AS numbers FROM documents")
def number_extract(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.numbers(F.col("text")), "|").alias("numbers"))


@query("cache_keys", "SELECT conv_id, turn, left(sha256(text || '|' || conv_id), 16) AS key16, md5(text) AS md5 FROM conversations")
def cache_keys(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.cache_key(F.col("text"), F.col("conv_id").cast("string")).alias("key16"), F.md5("text").alias("md5"))


@query("braces_fences", """SELECT event_id, replace(replace(props, '{', '{{'), '}', '}}') AS escaped, props AS bare FROM events""")
def braces(spark, sf_dir):
    fenced = F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))
    return table(spark, sf_dir, "events").select("event_id", T.escape_braces(F.col("props")).alias("escaped"), T.strip_fences(fenced).alias("bare"))


@query("json_props_parse", "SELECT event_id, coalesce(try_cast(json_extract_string(props, '$.k') AS BIGINT), -1) AS k, json_extract_string(props, '$.missing') IS NULL AS lacks FROM events")
def json_props(spark, sf_dir):
    parsed = F.from_json("props", "k bigint, missing string")
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(parsed["k"], F.lit(-1)).alias("k"), parsed["missing"].isNull().alias("lacks"))


@query("json_list_strings", "SELECT conv_id, turn, role || '|' || conv_id AS items FROM conversations")
def json_list(spark, sf_dir):
    listed = F.concat(F.lit("Here: [\""), F.col("role"), F.lit("\", \" "), F.col("conv_id").cast("string"), F.lit(" \", \"\"] ok"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(T.json_strings(listed), "|").alias("items"))


@query("sse_frames", "SELECT event_id, event_type AS event, props AS data, length('event: ' || event_type || 'data: ' || props) + 3 AS n FROM events")
def sse_frames(spark, sf_dir):
    frame = T.sse(F.col("event_type"), F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", T.read_sse(frame)["event"].alias("event"), T.read_sse(frame)["data"].alias("data"), F.char_length(frame).cast("long").alias("n"))


@query("error_codes", """SELECT event_id, CASE WHEN event_type = 'error' AND user_id % 2 = 0 THEN 'CASE_NOT_FOUND' WHEN event_type = 'error' THEN 'NOT_FOUND' WHEN event_type = 'click' THEN 'INVALID_MIME_TYPE' WHEN event_type = 'view' THEN 'FILE_TOO_LARGE'
    WHEN event_type = 'signup' THEN 'VALIDATION_ERROR' ELSE 'UNAUTHORIZED' END AS code FROM events""")
def error_codes(spark, sf_dir):
    kind = F.col("event_type")
    detail = F.when((kind == "error") & (F.col("user_id") % 2 == 0), "Case not found").when(kind == "error", "Thing not found").when(kind == "click", "MIME x").when(kind == "view", "File exceeds 5 MB")
    status = F.when(kind == "signup", 422).otherwise(401)
    return table(spark, sf_dir, "events").select("event_id", G.error_code(status, detail).alias("code"))


@query("url_basename", "SELECT page_id, 'c-' || page_id || '/' || regexp_extract(url, '([^/]+)/?$', 1) AS object_key FROM pages")
def basename(spark, sf_dir):
    key = T.object_key(F.lit(None).cast("string"), F.lit("x"), F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", F.replace(key, F.lit("no-case/x/"), F.concat(F.lit("c-"), F.col("page_id").cast("string"), F.lit("/"))).alias("object_key"))


@query("history_text", """SELECT conv_id, string_agg(CASE role WHEN 'user' THEN 'U' WHEN 'assistant' THEN 'A' ELSE role END || ': ' || text, chr(10) ORDER BY turn) AS history FROM conversations WHERE trim(coalesce(text, ''), ' ') <> '' GROUP BY conv_id""")
def history(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    return rows.select("conv_id", T.history_text(F.col("t"), {"user": "U", "assistant": "A"}).alias("history")).filter("history <> ''")


@query(
    "chunk_table_join",
    r"""WITH p AS (SELECT doc_id, source, lang, trim(unnest(string_split(coalesce(text, ''), chr(10) || chr(10))), ' ') AS p FROM documents)
    SELECT doc_id, source AS case_id, lang AS doc_type, count(*) AS n_chunks, sum(length(p)) AS n_chars FROM p WHERE p <> '' GROUP BY ALL""",
)
def chunk_table_join(spark, sf_dir):
    """Documents to a table of chunks with their case, joined with the documents' own table by bucket: no shuffle."""
    docs = table(spark, sf_dir, "documents")
    chunks = chunking.segments(docs, "doc_id", "text").join(docs.select("doc_id", F.col("source").alias("case_id")), "doc_id")
    kinds = docs.select("doc_id", F.col("source").alias("case_id"), F.col("lang").alias("doc_type"))
    run = uuid.uuid4().hex
    held = index.write_chunks(chunks, f"chunks_{run}", f"{shared(spark)}/chunks-{run}", "case_id", "doc_id")
    known = index.write_chunks(kinds, f"kinds_{run}", f"{shared(spark)}/kinds-{run}", "case_id", "doc_id")
    met = held.select("doc_id", "case_id", "clean_text").join(known.select("doc_id", "doc_type").hint("merge"), "doc_id")
    return met.groupBy("doc_id", "case_id", "doc_type").agg(F.count("*").alias("n_chunks"), F.sum(F.char_length("clean_text")).alias("n_chars"))


@query(
    "index_changes",
    """WITH now AS (SELECT source || '/' || doc_id AS path, md5(coalesce(text, '')) AS f FROM documents WHERE doc_id % 10 <> 3), was AS (SELECT source || '/' || doc_id AS path, CASE WHEN doc_id % 7 = 0 THEN 'old' ELSE md5(coalesce(text, '')) END AS f FROM documents WHERE doc_id % 10 <> 4)
    SELECT path, CASE WHEN was.f IS NULL THEN 'new' WHEN now.f IS NULL THEN 'deleted' WHEN was.f = now.f THEN 'same' ELSE 'changed' END AS change FROM now FULL JOIN was USING (path)""",
)
def index_changes(spark, sf_dir):
    """Documents stand for files; a tenth has come, a tenth has gone, and a seventh is not what it was."""
    docs = table(spark, sf_dir, "documents")
    path, print_ = F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.md5(F.coalesce("text", F.lit("")))
    now = docs.filter("doc_id % 10 <> 3").select(path, print_.alias("fingerprint"))
    was = docs.filter("doc_id % 10 <> 4").select(path, F.when(F.col("doc_id") % 7 == 0, "old").otherwise(print_).alias("fingerprint"))
    return index.changes(was, now)
