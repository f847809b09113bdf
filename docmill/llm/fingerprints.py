"""Document fingerprints by a homomorphic multiset hash, in SQL functions only.

A fingerprint is a vector of sums that can be added and subtracted lane by lane:

* 4 lanes modulo 2^62, each the sum of a differently salted 62-bit hash of every paragraph
  (a line of the text). They depend on the multiset of paragraphs only, not on their order, and
  a paragraph is inserted or deleted by adding or subtracting its own vector.
* 65 lanes modulo 2^32: the number of units, and for each of 64 bits how many unit hashes have
  it set. A paragraph's units are its word pairs (the last word alone) and the first four
  characters of each of its words, whatever its length and its neighbours. These lanes are sums
  over paragraphs too; centred, the cosine of two of them estimates how many units two texts
  share, which is the likeness (0 to 1).

So all 69 lanes depend on the multiset of paragraphs only.

Null texts count as empty; an empty text is one empty paragraph. Equal texts, repeated rows
included, have equal fingerprints. Empty tables give empty results; only the named columns are
read, so others of any name do no harm. A very long text is one row, whose units are exploded
and summed as they come, so it takes memory for its units' hashes once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EQUAL_LANES, EQUAL_BITS = 4, 62
LIKE_BITS = 32
MASK62, MASK32 = (1 << EQUAL_BITS) - 1, (1 << LIKE_BITS) - 1
#: Two 32-bit counters are summed in one long: bit j and bit j + 32 of a hash.
PAIR = (1 << 32) | 1
#: Bytes of text in a range of doc_id. Ranges are found in two steps of at most COARSE each for
#: every COARSE squared of them; only their bounds go through the driver.
RANGE_BYTES, COARSE = 16_000_000, 512


def paragraph_lanes(text: Column) -> list[Column]:
    lines = F.split(text, "\n", -1)

    def lane(salt: int) -> Column:
        added = lambda acc, p: (acc + F.xxhash64(p, F.lit(salt)).bitwiseAND(F.lit(MASK62))).bitwiseAND(F.lit(MASK62))
        return F.aggregate(lines, F.lit(0).cast("long"), added)

    return [lane(j) for j in range(EQUAL_LANES)]


def unit_hashes(text: Column) -> Column:
    """Hashes of the units of all paragraphs (and nulls, which no sum counts)."""
    # a line feed is a word of its own here, which ends a paragraph's last word and pairs with none
    words = F.split(F.replace(F.translate(text, "\r\t", "  "), F.lit("\n"), F.lit(" \n ")), " ", -1)
    after = F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0)))
    pairs = F.zip_with(words, after, lambda a, b: F.when(a != "\n", F.xxhash64(a, F.when(b != "\n", b))))
    starts = F.transform(words, lambda w: F.when(w != "\n", F.xxhash64(F.substring(w, 1, 4), F.lit(4))))
    return F.concat(pairs, starts)


def _unpack(packed: Column) -> Column:
    low = F.transform(packed, lambda x: x.bitwiseAND(F.lit(MASK32)))
    high = F.transform(packed, lambda x: F.shiftrightunsigned(x, 32))
    return F.concat(low, high)


def add(a: Column, b: Column, sign: int = 1) -> Column:
    """Fingerprint of the union of two multisets of paragraphs and units (sign -1: of the difference)."""
    def lane(x: Column, y: Column, i: Column) -> Column:
        total = x + sign * y
        return F.when(i < EQUAL_LANES, total.bitwiseAND(F.lit(MASK62))).otherwise(total.bitwiseAND(F.lit(MASK32)))

    both = F.arrays_zip(a.alias("x"), b.alias("y"))
    return F.transform(both, lambda z, i: lane(z["x"], z["y"], i))


def to_hex(fingerprint: Column) -> Column:
    lane = lambda x, i: F.lower(F.lpad(F.hex(x), F.when(i < EQUAL_LANES, 16).otherwise(8), F.lit("0")))
    return F.array_join(F.transform(fingerprint, lane), "")


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: 1 for equal fingerprints, else the cosine of the centred bit counts, 0 if negative."""
    def centred(x: Column) -> Column:
        n = F.element_at(x, EQUAL_LANES + 1)
        return F.transform(F.slice(x, EQUAL_LANES + 2, 2 * LIKE_BITS), lambda v: (2 * v - n).cast("double"))

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)

    u, v = centred(a), centred(b)
    scale = F.sqrt(dot(u, u)) * F.sqrt(dot(v, v))
    cosine = F.when(scale > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), dot(u, v) / scale))).otherwise(F.lit(0.0))
    return F.when(a == b, F.lit(1.0)).otherwise(cosine)


def _summed(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """One row per keys with column fingerprint. keys must tell the rows of df apart."""
    named = df.select(*keys, *[lane.alias(f"_e{j}") for j, lane in enumerate(paragraph_lanes(F.col(text)))], unit_hashes(F.col(text)).alias("_units"))
    held = [*keys, *[f"_e{j}" for j in range(EQUAL_LANES)]]
    each = named.select(*held, F.explode_outer("_units").alias("_h"))
    sums = [F.sum(F.shiftright("_h", j).bitwiseAND(F.lit(PAIR))).alias(f"_b{j}") for j in range(LIKE_BITS)]
    got = each.groupBy(*held).agg(F.count("_h").alias("_n"), *sums)
    packed = F.array(*[F.coalesce(F.col(f"_b{j}"), F.lit(0).cast("long")) for j in range(LIKE_BITS)])
    equal = F.array(*[F.col(f"_e{j}") for j in range(EQUAL_LANES)])
    return got.select(*keys, F.concat(equal, F.array(F.col("_n").bitwiseAND(F.lit(MASK32))), _unpack(packed)).alias("fingerprint"))


def fingerprints(df: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """keys and fingerprint (array of 69 longs) of every whole text; keys must be unique."""
    return _summed(df.select(*keys, F.coalesce(F.col(text_col), F.lit("")).alias("_text")), keys, "_text")


def _ranged(df: DataFrame, id_col: str, text_col: str) -> tuple[Column, list]:
    """The doc_id range of a row, and for each range that has rows, from high to low, its largest doc_id.

    Ranges hold about RANGE_BYTES each. Beyond COARSE of them, coarse ranges are cut again, all at
    once, each by its own percentiles; a row then looks through the coarse bounds and those of one range.
    """
    ids = df.select(id_col)
    least = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = df.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0
    n = max(2, min(least, COARSE), -(-total // RANGE_BYTES))
    coarse = n if n <= COARSE else -(-n // -(-n // COARSE))

    def cuts(parts: int) -> Column:
        return F.percentile_approx(id_col, [i / parts for i in range(1, parts)], 20 * parts)

    def below(bounds: Column) -> Column:
        return F.coalesce(F.size(F.filter(bounds, lambda c: c < F.col(id_col))), F.lit(0))

    longs = lambda found: F.lit(sorted(set(found))).cast("array<bigint>") if found else F.array().cast("array<bigint>")
    first = below(longs(ids.select(cuts(coarse)).first()[0]))
    bucket = first.cast("long")
    if coarse < n:
        parts = -(-n // coarse)
        inner = dict(map(tuple, ids.groupBy(first).agg(cuts(parts)).collect()))
        nested = F.array(*[longs(inner.get(k)) for k in range(max(inner, default=0) + 1)])
        bucket = bucket * parts + below(F.get(nested, first))
    heads = ids.groupBy(bucket.alias("b")).agg(F.max(id_col)).collect()
    return bucket, sorted(map(tuple, heads), reverse=True)


def next_texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows with the next row in descending id_col (after the last: the first), whole.

    Columns: _range, _no (its place in the range), _own (false for the copy of the next range's
    first row that ends each range), id_col, text_col, _next. Texts are shuffled once, by ranges
    of id_col; the driver sees the ranges' bounds only.
    """
    bucket, heads = _ranged(df, id_col, text_col)
    spark = df.sparkSession
    serves = [(heads[(i + 1) % len(heads)][1], b) for i, (b, _) in enumerate(heads)]
    ends = spark.createDataFrame(serves, "_head bigint, _range bigint")
    own = df.withColumn("_range", bucket).withColumn("_own", F.lit(True))
    copies = df.join(F.broadcast(ends), F.col(id_col).eqNullSafe(F.col("_head"))).drop("_head").withColumn("_own", F.lit(False))
    order = Window.partitionBy("_range").orderBy(F.desc("_own"), F.desc_nulls_last(id_col), F.xxhash64(text_col), text_col)
    both = own.unionByName(copies)
    return both.withColumns({"_no": F.row_number().over(order), "_next": F.lead(text_col).over(order)})


def compare_with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint every text and its edited text, and compare with the next document.

    The edited text has the last floor(n / 3) code points replaced by as many first ones (or
    all) of the next document in descending id_col (a number; nulls come last; repeated ids are
    ordered by a hash of the text, then the text). Returns id_col, n_chars, edited_sha256,
    fingerprint, edited_fingerprint (arrays), near_edited, near_next. One shuffle, by id ranges.
    """
    docs = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    n = F.char_length("_text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("_text", F.lit(1), n - third), F.substring(F.coalesce("_next", F.lit("")), F.lit(1), third))
    rows = next_texts(docs, "_id", "_text").select("_range", "_no", "_own", "_id", n.alias("_n_chars"), "_text", edited.alias("_edited"))
    keys = ["_range", "_no", "_own", "_id", "_n_chars", "_sha", "_which"]
    versions = rows.select(
        *keys[:5],
        F.when(F.col("_own"), F.sha2("_edited", 256)).alias("_sha"),
        F.posexplode(F.when(F.col("_own"), F.array("_text", "_edited")).otherwise(F.array("_text"))).alias("_which", "_body"),
    )
    prints = _summed(versions, keys, "_body")
    order = Window.partitionBy("_range").orderBy("_no", "_which")
    # a row's edited version follows it, and the next row's text follows that one
    seen = prints.withColumns({"_edited": F.lead("fingerprint", 1).over(order), "_after": F.lead("fingerprint", 2).over(order)})
    return seen.filter(F.col("_own") & (F.col("_which") == 0)).select(
        F.col("_id").alias(id_col),
        F.col("_n_chars").cast("long").alias("n_chars"),
        F.col("_sha").alias("edited_sha256"),
        "fingerprint",
        F.col("_edited").alias("edited_fingerprint"),
        likeness(F.col("fingerprint"), F.col("_edited")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("_after")).alias("near_next"),
    )
