"""Links between documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates are texts that agree in a band of ROWS MinHash values; each of BANDS bands is an index
of its own, so a pair at 0.8 is missed with probability (1 - 0.8^ROWS)^BANDS, about 5 in 100,000.
Every candidate is verified by its Jaccard similarity over the whole texts, each of which is cut to its
set of shingle hashes once.

A posting of at most POSTING texts is compared pair by pair. In a larger one each text is first
compared with PIVOTS texts of the posting, those that are in most large postings (ties by as many
hashes). Texts are labelled with their component so far, and those that are not of the posting's
most frequent component are compared with PIVOTS texts of it, others in every posting. Where the members of a posting have one label, nothing is left to find
there. The members of all other large
postings are joined exactly, by prefix filtering: each text's shingles are ordered from the rarest
among them to the most frequent; two texts of Jaccard similarity s must share one of the first
n - ceil(s n) + 1 shingles of the longer and of the first n - ceil(2 s n / (1 + s)) + 1 of the
shorter one. They share nothing before the first shingle that they share, so the rest of either text
from there on must be enough for s; a text with too many shingles of its own meets nobody under the
frequent ones. Pairs of one label are left out, postings of one label too, and in the others what has
the most frequent label is compared with the rest only. So no partner is left out for the size of a
posting, and no group is gathered in one task.

Words are those of the SimHash: lower-cased in A-Z only, cut at ASCII white space. A text of
fewer words than a shingle has one shingle of all its words; texts without words have no links.
Rows that repeat a text count once. A very long text is held as its set of shingles' hashes. Empty
tables have no links, null texts are empty, and columns besides the text's may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.llm.common import checkpoint
from docmill.llm.components import components
from docmill.workers import ship

SEED, SHINGLE, SIMILARITY = 42, 5, 0.8
BANDS, ROWS = 25, 5
POSTING, PIVOTS, ROUNDS = 32, 4, 2


def shingles(text: str | None) -> set[bytes]:
    words = (text or "").encode().lower().split()
    n = max(1, len(words) - SHINGLE + 1) if words else 0
    return {b" ".join(words[i : i + SHINGLE]) for i in range(n)}


def similar(a: set[bytes], b: set[bytes]) -> bool:
    both = len(a & b)
    return both > 0 and both >= SIMILARITY * (len(a) + len(b) - both)


def bands(text: str | None) -> list[int]:
    """One signed long per band; none for a text without words."""
    found = shingles(text)
    if not found:
        return []
    xxh = xxhash.xxh64_intdigest
    hashes = np.fromiter((xxh(s, SEED) for s in found), np.uint64, len(found))
    by = np.random.default_rng(SEED).integers(1 << 63, size=BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    least = np.array([(hashes * m).min() for m in by], "<u8").reshape(BANDS, ROWS)
    return [xxh(row.tobytes(), i) - (1 << 63) for i, row in enumerate(least)]


def digest(text_col: str) -> Column:
    """What stands for a text in sketches."""
    return F.xxhash64(text_col, F.lit(SEED))


def links(sketches: DataFrame, texts: DataFrame, text_col: str = "text") -> DataFrame:
    """Links (u, v), u <> v, of nodes with similar texts.

    sketches: node (a long), _t (the text's digest), _bands; texts has the texts themselves.
    """
    ship(sketches.sparkSession)
    # rows that repeat a text differ in nothing; one stands for all of them
    once = checkpoint(sketches.groupBy("node", F.col("_t").alias("t")).agg(F.first("_bands").alias("bands")))
    each = once.select("node", "t", F.posexplode("bands").alias("i", "band")).select("node", "t", F.xxhash64("i", "band").alias("key"))
    sizes = checkpoint(each.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"))
    small = each.join(sizes.filter(F.col("n") <= POSTING).select("key").hint("merge"), "key")
    side = lambda x: small.select("key", F.col("node").alias(x), F.col("t").alias(f"t{x}"))
    pairs = side("u").join(side("v").hint("merge"), "key").filter("tu < tv").select("u", "tu", "v", "tv")
    large = sizes.filter(F.col("n") > POSTING).select("key")
    if large.isEmpty():
        return _verified(pairs, texts, text_col)
    inside = each.join(large.hint("merge"), "key").withColumn("c", F.col("node"))
    # a text that is in many large postings is like many others
    places = inside.groupBy("node", "t").agg((-F.count("*")).alias("rare"))
    members = checkpoint(inside.join(places.hint("merge"), ["node", "t"]))
    found = checkpoint(_verified(pairs.unionByName(_stars(members, members, "rare")), texts, text_col))
    for turn in range(1, ROUNDS + 1):
        members = checkpoint(_mixed(members, components(found), "key"))
        if members.isEmpty():
            return found
        if turn < ROUNDS:
            found = checkpoint(found.unionByName(_verified(_stars(members.filter("c <> main"), members.filter("c = main"), "key"), texts, text_col)).distinct())
    left = checkpoint(members.select("node", "t", "c").distinct())
    return found.unionByName(_verified(_prefix_pairs(left, texts, text_col), texts, text_col)).distinct()


def _stars(members: DataFrame, among: DataFrame, first: str) -> DataFrame:
    """Pairs (u, tu, v, tv) of each member of a posting with PIVOTS of those among it that have another label.

    first: "rare" for those in most large postings, "key" for others in every posting.
    """
    smallest = [F.min(F.struct(first, F.xxhash64("t", "key", F.lit(s)).alias("h"), "t", "node", "c")).alias(f"_p{s}") for s in range(PIVOTS)]
    each = F.explode(F.array_distinct(F.array(*[F.struct(f"_p{s}.t", f"_p{s}.node", f"_p{s}.c") for s in range(PIVOTS)]))).alias("p")
    pivots = among.groupBy("key").agg(*smallest).select("key", each)
    met = members.join(pivots.hint("merge"), "key").filter("c <> p.c")
    return met.select(F.col("node").alias("u"), F.col("t").alias("tu"), F.col("p.node").alias("v"), F.col("p.t").alias("tv"))


def _mixed(members: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """The members, labelled anew, of those postings that have several labels, with main, the most frequent one of each."""
    labelled = members.drop("c", "main").join(found.withColumnRenamed("component", "c").hint("merge"), "node", "left").withColumn("c", F.coalesce("c", "node"))
    return labelled.join(_several(labelled, key).hint("merge"), key)


def _several(labelled: DataFrame, key: str) -> DataFrame:
    """key, main of the postings whose members have several labels."""
    by_label = labelled.groupBy(key, "c").agg(F.count("*").alias("k"))
    most = by_label.groupBy(key).agg(F.max_by("c", F.struct("k", "c")).alias("main"), F.min("c").alias("lo"), F.max("c").alias("hi"))
    return most.filter("lo < hi").select(key, "main")


def _prefix_pairs(members: DataFrame, texts: DataFrame, text_col: str) -> DataFrame:
    """Pairs (u, tu, v, tv) of members (node, t, c) of different c that prefix filtering can't rule out."""
    sets = checkpoint(members.join(_sets(members.select("t"), texts, text_col).hint("merge"), "t").select("node", "t", "c", "hashes"))
    each = sets.select("node", "t", "c", F.explode("hashes").alias("h"))
    often = each.groupBy("h").agg(F.count("*").alias("often"))
    ordered = each.join(often.hint("merge"), "h").groupBy("node", "t", "c").agg(F.sort_array(F.collect_list(F.struct("often", "h"))).alias("s"))
    n = F.size("s")
    least = lambda share: n - F.ceil(n * share - 1e-9).cast("int") + 1
    kept = ordered.select("node", "t", "c", n.alias("n"), least(2 * SIMILARITY / (1 + SIMILARITY)).alias("short"), F.posexplode(F.slice("s", F.lit(1), least(SIMILARITY))).alias("at", "s"))
    postings = checkpoint(kept.filter("s.often > 1").select("node", "t", "c", "n", (F.col("at") < F.col("short")).alias("early"), "at", F.col("s.h").alias("h")))
    live = postings.join(_several(postings, "h").hint("merge"), "h")
    named = lambda d, x: d.select("h", *[F.col(c).alias(f"{c}_{x}") for c in ("node", "t", "c", "n", "early", "at")])
    both = named(live.filter("c <> main"), "u").join(named(live, "v").hint("merge"), "h")
    overlap = F.ceil((F.col("n_u") + F.col("n_v")) * (SIMILARITY / (1 + SIMILARITY)) - 1e-9)
    # two texts need to meet only at the first shingle that they share, and share nothing before it
    most = F.least(F.col("n_u") - F.col("at_u"), F.col("n_v") - F.col("at_v"))
    near = (F.least("n_u", "n_v") >= F.greatest("n_u", "n_v") * SIMILARITY - 1e-9) & (most >= overlap)
    shorter = (F.col("early_u") & (F.col("n_u") <= F.col("n_v"))) | (F.col("early_v") & (F.col("n_v") <= F.col("n_u")))
    return both.filter((F.col("c_u") != F.col("c_v")) & near & shorter).select(
        F.col("node_u").alias("u"), F.col("t_u").alias("tu"), F.col("node_v").alias("v"), F.col("t_v").alias("tv")
    )


def _sets(asked: DataFrame, texts: DataFrame, text_col: str) -> DataFrame:
    """t, hashes: the shingles' XXH64 hashes of the digests asked for, each once; a text is cut to shingles once."""

    def cut(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                hashes = [sorted({xxhash.xxh64_intdigest(s, SEED) - (1 << 63) for s in shingles(x.as_py())}) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(hashes, pa.list_(pa.int64()))], names=["t", "hashes"])

    found = texts.select(digest(text_col).alias("t"), F.col(text_col).alias("text")).join(asked.distinct().hint("merge"), "t", "left_semi")
    return checkpoint(found.groupBy("t").agg(F.first("text").alias("text")).mapInArrow(cut, "t bigint, hashes array<bigint>"))


def _verified(pairs: DataFrame, texts: DataFrame, text_col: str) -> DataFrame:
    """Those pairs (u, v) of (u, tu, v, tv), u <> v, whose whole texts are similar.

    What meets are sets of 64-bit hashes: two different shingles of one pair of texts would have to share one to be taken for equal.
    """
    one_way = F.when(F.col("tu") < F.col("tv"), F.struct("u", "tu", "v", "tv")).otherwise(F.struct(F.col("v").alias("u"), F.col("tv").alias("tu"), F.col("u").alias("v"), F.col("tu").alias("tv")))
    asked = checkpoint(pairs.filter("u <> v").select(one_way.alias("p")).select("p.*").distinct())
    sets = _sets(asked.select(F.col("tu").alias("t")).unionByName(asked.select(F.col("tv").alias("t"))), texts, text_col)
    laid = asked.join(sets.toDF("tu", "a").hint("merge"), "tu").join(sets.toDF("tv", "b").hint("merge"), "tv")
    sizes = laid.select("u", "v", F.size("a").alias("n"), F.size("b").alias("m"), F.size(F.array_intersect("a", "b")).alias("both"))
    enough = (F.col("both") > 0) & (F.col("both") >= SIMILARITY * (F.col("n") + F.col("m") - F.col("both")))
    return sizes.filter(enough).select("u", "v").distinct()
