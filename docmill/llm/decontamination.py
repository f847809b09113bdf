"""Benchmark decontamination by spaced-seed hashing, in SQL functions only.

Texts are lower-cased and cut into runs of letters and digits. A fixed mask selects some of SPAN
neighbouring tokens and ignores the rest; the hash of the selected ones is a seed. Seeds of the
test items are joined with those of the documents. A hit fixes how an item lies on a document;
all tokens of the item are then compared there, and the document is contaminated if in some
WINDOW neighbouring tokens of the item (or the whole item, if shorter) no more than ALLOWED in
WINDOW were substituted. The two masks meet every way to substitute two of thirteen tokens, so
such an overlap never escapes.

Items of fewer than SHORT tokens are too short for that. They are found by the hash of the whole
item, or, where one substitution is allowed (from 7 tokens on), by its hashes with each one token
left out, and verified as the others. Documents get such hashes only for lengths that items have.
Null or empty texts match nothing. Repeated documents or items each get rows of their own ids; rows
that repeat an id are judged together. Rows without an id are judged under the null id. Empty
tables of either kind give no overlaps. Only the named columns are read, and decontaminate gives
back all columns whatever their names. A very long text is one row of token hashes, eight bytes
each, and a token that is repeated on end is one run of a seed, not a hit for every place.

The items' seeds are broadcast if their bytes are few (they are summed first), else shuffled;
so are the ids of the documents that have a hit. Hits are made distinct before documents are
read again, and only documents with a hit are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.llm.common import checkpoint, private

#: Together they leave no two substitutions in WINDOW tokens unseen.
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 4, 5, 6, 7))
SPAN, WINDOW, ALLOWED = 8, 13, 2
#: From so many tokens on the masks meet every substitution that is allowed.
SHORT = 10
#: Bytes of a side that is broadcast, at most, and of a row besides its array or string.
BROADCAST_BYTES, ROW_BYTES = 32_000_000, 64


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", -1), lambda t: t != "")


def hashed(df: DataFrame, id_col: str, text_col: str, name: str, held: str) -> DataFrame:
    return df.select(F.col(id_col).alias(name), tokens(F.col(text_col)).alias("_t")).select(
        name, F.transform("_t", lambda t: F.xxhash64(t)).alias(held)
    )


def runs(found: Column) -> Column:
    """Runs of equal neighbours in an array: seed, first place and last place."""
    begins = F.filter(F.sequence(F.lit(0), F.size(found) - 1), lambda i: (i == 0) | (F.get(found, i) != F.get(found, i - 1)))
    ends = F.filter(F.sequence(F.lit(0), F.size(found) - 1), lambda i: (i == F.size(found) - 1) | (F.get(found, i) != F.get(found, i + 1)))
    return F.zip_with(begins, ends, lambda lo, hi: F.struct(F.get(found, lo).alias("seed"), lo.alias("lo"), hi.alias("hi")))


def seeds(df: DataFrame, name: str, held: str) -> DataFrame:
    """name, seed, lo, hi: one row for each mask and run of places of the token hashes in column held."""
    n = F.size(held) - (SPAN - 1)

    def places(mask: int) -> Column:
        at = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(F.lit(mask), *[F.get(held, i + o) for o in MASKS[mask]]))
        return F.when(F.size(held) >= SPAN, at)

    each = df.select(name, *[places(mask).alias(f"_s{mask}") for mask in range(len(MASKS))])
    # an outer explode, as the filter that Spark derives from an inner one is pushed down to where
    # the token hashes are made, and would make them again for every place
    listed = each.select(name, F.concat(*[runs(F.col(f"_s{mask}")) for mask in range(len(MASKS))]).alias("_runs"))
    return listed.select(name, F.explode_outer("_runs").alias("_r")).select(name, "_r.seed", "_r.lo", "_r.hi")


def short_seeds(df: DataFrame, name: str, held: str, sizes: list[int], whole: bool = False) -> DataFrame:
    """name, seed, lo, hi (the same place): as seeds, for items of the given sizes; whole: only of rows that have just that size."""
    n, each = F.size(held), []
    for m in sizes:
        # a token left out at either end may lie outside the document
        slack = m * ALLOWED // WINDOW
        for left_out in range(m) if slack else [-1]:

            def place(i: Column) -> Column:
                kept = [F.get(held, i + o) for o in range(m) if o != left_out]
                return F.struct(F.xxhash64(F.lit(m), F.lit(left_out), *kept).alias("seed"), i.alias("lo"), i.alias("hi"))

            if whole:
                each.append(F.when(n == m, F.array(place(F.lit(0)))))
            else:
                each.append(F.when(n >= m - slack, F.transform(F.sequence(F.lit(-slack), n - m + slack), place)))
    none = F.array().cast("array<struct<seed:bigint,lo:int,hi:int>>")
    listed = df.select(name, F.concat(*[F.coalesce(e, none) for e in each]).alias("_seeds"))
    return listed.select(name, F.explode_outer("_seeds").alias("_s")).select(name, "_s.seed", "_s.lo", "_s.hi")


def _small(df: DataFrame, more: Column | int = 0) -> DataFrame:
    """df, marked for broadcast if its rows are summed to be small; more: a row's bytes beyond ROW_BYTES."""
    n = df.agg(F.sum(F.coalesce(F.lit(more) if isinstance(more, int) else more, F.lit(0)) + F.lit(ROW_BYTES))).first()[0] or 0
    return F.broadcast(df) if n <= BROADCAST_BYTES else df


def _width(name: str) -> Column:
    return F.octet_length(F.col(name).cast("string"))


def overlaps(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text"
) -> DataFrame:
    """One row per document and item that overlap.

    doc_id, item_id, equal_tokens (of the whole item where it lies best), item_tokens,
    window_equal (most equal tokens in one window), first_token (place in the document of the
    item's first token; negative if the document begins inside the item).
    """
    tests = checkpoint(hashed(items, item_id, text_col, "_item", "_g").filter(F.size("_g") > 0))
    sizes = sorted(r[0] for r in tests.select(F.size("_g")).filter(F.size("_g") < SHORT).distinct().collect())
    named = docs.select(F.col(doc_id).alias("_name"), F.col(text_col).alias("_body"))
    texts = hashed(named, "_name", "_body", "_doc", "_h")
    asked, held = seeds(tests, "_item", "_g"), seeds(texts, "_doc", "_h")
    if sizes:
        asked = asked.unionByName(short_seeds(tests, "_item", "_g", sizes, whole=True))
        held = held.unionByName(short_seeds(texts, "_doc", "_h", sizes))
    wanted = checkpoint(asked.filter("seed is not null").withColumnsRenamed({"lo": "_lo", "hi": "_hi"}).distinct())
    hits = held.join(_small(wanted, _width("_item")), "seed")
    # a run of one seed in the text and one in the item lie on each other at every shift between
    shifts = F.explode(F.sequence(F.col("lo") - F.col("_hi"), F.col("hi") - F.col("_lo")))
    apart = hits.select("_doc", "_item", shifts.alias("_at")).distinct()
    found = checkpoint(apart.groupBy("_doc", "_item").agg(F.collect_list("_at").alias("_ats")))
    ids = checkpoint(found.select(F.col("_doc").alias("_hit")).distinct())
    again = named.join(_small(ids, _width("_hit")), F.col("_name").eqNullSafe(F.col("_hit")), "left_semi")
    laid = hashed(again, "_name", "_body", "_key", "_h").join(found, F.col("_key").eqNullSafe(F.col("_doc")))
    both = laid.join(_small(tests.withColumnRenamed("_item", "_test"), 8 * F.size("_g") + _width("_test")), F.col("_item").eqNullSafe(F.col("_test")))
    m = F.size("_g")
    w = F.least(m, F.lit(WINDOW))
    least = w - F.floor(w * ALLOWED / WINDOW)
    total = lambda x: F.aggregate(x, F.lit(0), lambda s, v: s + v)
    # arrays of one element bind what is used more than once
    bind = lambda value, use: F.element_at(F.transform(F.array(value), use), 1)

    def lay(at: Column) -> Column:
        same = F.transform("_g", lambda g, j: F.when((at + j >= 0) & (F.get("_h", at + j) == g), 1).otherwise(0))
        windows = lambda x: F.array_max(F.transform(F.sequence(F.lit(1), m - w + 1), lambda s: total(F.slice(x, s, w))))
        judge = lambda x, equal: F.when(equal >= least, F.struct(windows(x).alias("most"), equal.alias("equal"), (-at).alias("first"), m.alias("m")))
        return bind(same, lambda x: bind(total(x), lambda equal: judge(x, equal)))

    judged = both.select("_doc", "_item", least.alias("_least"), F.array_max(F.transform("_ats", lay)).alias("_best"))
    best, enough = F.max("_best").alias("b"), F.col("_best.most") >= F.col("_least")
    return judged.filter(enough).groupBy("_doc", "_item").agg(best).select(
        F.col("_doc").alias(doc_id),
        F.col("_item").alias(item_id),
        F.col("b.equal").alias("equal_tokens"),
        F.col("b.m").alias("item_tokens"),
        F.col("b.most").alias("window_equal"),
        (-F.col("b.first")).alias("first_token"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that overlap no item."""
    held, (key, body) = private(docs, doc_id, text_col)
    found = overlaps(held.select(F.col(key).alias("key"), F.col(body).alias("body")), items.select(F.col(item_id).alias("item"), F.col(text_col).alias("body")), "key", "item", "body")
    bad = checkpoint(found.select(F.col("key").alias("bad")).distinct())
    return held.join(_small(bad, _width("bad")), F.col(key).eqNullSafe(F.col("bad")), "left_anti").toDF(*docs.columns)
