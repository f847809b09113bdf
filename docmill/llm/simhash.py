"""Near-duplicate documents by SimHash, through an inverted index over byte positions.

A fingerprint bit is the majority of that bit over the XXH64 hashes (seed 42) of the text's word
shingles, repeats included. Two fingerprints that differ in at most two bits share at least six
of their eight positional bytes, so they share four bytes made of two of the four 2-byte blocks.
The index therefore holds every different fingerprint under its six pairs of blocks, and within
such a posting under each of the other four byte positions and the byte there. A pair's shared
positional bytes are tallied by counting the postings that it shares; pairs below the guaranteed
six are left out (pairs that share the four bytes alone are never formed), and the others are
verified bit by bit.

A posting of more than POSTING fingerprints is not compared pair by pair: its members are
indexed again under two more equal bytes (six pairs of the other four), and where that still
leaves more than POSTING, under the 120 ways to blank two of the 16 bits that are left. Such a
group has four members at most, all of them linked, so pointing each at the group's smallest
keeps every link's component. Nothing is capped, and no group is gathered in one task.

Empty tables give empty results, and columns besides the two named ones may have any name. A very
long text is held as its list of words and eight bytes for each shingle.

Texts are lower-cased in A-Z only and cut at ASCII white space. A text of fewer words than a
shingle has one shingle of all its words; a text without words (null and empty texts too) has
fingerprint zero. Rows that repeat an id or a text simply share a fingerprint. Rows without an
id take part but name no component unless nothing else does: then component_id is null.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.llm import near_copies
from docmill.llm.common import checkpoint, private
from docmill.llm.components import components
from docmill.workers import keep_nothing, ship

SEED, SHINGLE, DISTANCE = 42, 3, 2
SHARED_BYTES = 8 - DISTANCE
POSTING = 128
BLOCKS = 4


def shingle_hashes(text: str, k: int) -> np.ndarray:
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    n = max(1, len(words) - k + 1)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    return np.fromiter((digest(join(words[i : i + k]), SEED) for i in range(n)), np.uint64, n)


def fingerprint(text: str, k: int = SHINGLE) -> int:
    """The fingerprint as a signed long."""
    hashes = shingle_hashes(text, k)
    if not len(hashes):
        return 0
    bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)].astype("<u8")
        bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, copies: bool = False) -> DataFrame:
    """id_col, fp long for every whole text; with copies also t and bands, for near_copies.links."""
    ship(df.sparkSession)

    def run(batches):
        keep_nothing()
        for batch in batches:
            texts = [x.as_py() for x in batch.column(1)]
            columns = {id_col: batch.column(0), "fp": pa.array([fingerprint(t, k) if t else 0 for t in texts], pa.int64())}
            if copies:
                columns |= {"_t": batch.column(2), "_bands": pa.array([near_copies.bands(t) for t in texts], pa.list_(pa.int64()))}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    out = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, fp bigint" + (", _t bigint, _bands array<bigint>" if copies else "")
    read = [F.col(id_col), F.col(text_col), *([near_copies.digest(text_col)] if copies else [])]
    return df.select(*read).mapInArrow(run, out)


def _mask(bytes_at: tuple[int, ...]) -> int:
    m = sum(0xFF << 8 * i for i in bytes_at)
    return m - (1 << 64) if m >> 63 else m


def _counted(each: DataFrame) -> DataFrame:
    """Rows (fp, key) with n, the number of fingerprints that share the key; lone ones go."""
    shared = each.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    return each.join(shared.hint("merge"), "key").select("fp", "key", "n")


def _key(kept: tuple[int, ...], column: Column = None) -> Column:
    """A posting's key: which bytes are kept, and their values."""
    fp = F.col("fp") if column is None else column
    return F.struct(F.lit(_mask(kept)).alias("at"), fp.bitwiseAND(F.lit(_mask(kept))).alias("is"))


def _byte(fp: Column, at: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * at).bitwiseAND(F.lit(255)).cast("int")


def tallied(postings: DataFrame, kept: dict[int, tuple[int, ...]]) -> DataFrame:
    """Pairs (u, v) of small postings that share SHARED_BYTES positional bytes or more, counted by the index.

    kept: which bytes the keys of the postings hold, by their masks. The other positions are
    postings of their own; a pair's tally is the bytes of the key and the postings that it shares.
    """
    small = postings.filter(F.col("n") <= POSTING)
    rest = {mask: [i for i in range(8) if i not in bytes_at] for mask, bytes_at in kept.items()}
    at = lambda mask: F.array(*[F.struct(F.lit(i).alias("position"), _byte(F.col("fp"), i).alias("byte")) for i in rest[mask]])
    inside = F.coalesce(*[F.when(F.col("key.at") == mask, at(mask)) for mask in rest])
    each = small.select("key", "fp", F.explode(inside).alias("at"))
    a, b = each.withColumnRenamed("fp", "u"), each.withColumnRenamed("fp", "v")
    met = a.join(b.hint("merge"), ["key", "at"]).filter("u < v").groupBy("key", "u", "v").agg(F.count("*").alias("more"))
    given = len(next(iter(kept.values())))
    return met.filter(F.col("more") + given >= SHARED_BYTES).select("u", "v").distinct()


def _pairs(postings: DataFrame, kept: dict[int, tuple[int, ...]]) -> DataFrame:
    """Links within small postings: the tally decides which pairs are verified."""
    return tallied(postings, kept).filter(F.bit_count(F.expr("u ^ v")) <= DISTANCE)


def links(fps: DataFrame) -> DataFrame:
    """Links (u, v) that connect all different fingerprints of fps that differ in at most two bits.

    fps: one row per different fingerprint, column fp. Inside a dense posting, links go through
    the smallest member of each group of fingerprints that are all linked with each other.
    """
    fours = {_mask(x): x for x in (tuple(sorted((2 * i, 2 * i + 1, 2 * j, 2 * j + 1))) for i, j in combinations(range(BLOCKS), 2))}
    first = checkpoint(_counted(fps.select("fp", F.explode(F.array(*[_key(x) for x in fours.values()])).alias("key"))))
    found = [_pairs(first, fours)]
    dense = first.filter(F.col("n") > POSTING)
    if not dense.isEmpty():
        # two more equal bytes: together any six of the eight
        more = {mask: [tuple(sorted((*x, *y))) for y in combinations(sorted(set(range(8)) - set(x)), 2)] for mask, x in fours.items()}
        again = F.coalesce(*[F.when(F.col("key.at") == mask, F.array(*[_key(y) for y in ys])) for mask, ys in more.items()])
        second = checkpoint(_counted(dense.select("fp", F.explode(again).alias("key")).distinct()))
        alike = second.filter(F.col("n") <= POSTING)
        a, b = alike.select("key", F.col("fp").alias("u")), alike.select("key", F.col("fp").alias("v"))
        # all members of such a posting have the guaranteed bytes in common
        found.append(a.join(b.hint("merge"), "key").filter("u < v").select("u", "v").filter(F.bit_count(F.expr("u ^ v")) <= DISTANCE))
        crowded = second.filter(F.col("n") > POSTING)
        if not crowded.isEmpty():
            rest = F.array_compact(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.when(F.expr("key.at").bitwiseAND(_bit(b)) == 0, b)))
            free = crowded.select("fp", "key", rest.alias("free"))
            ones = free.select("fp", "key", "free", F.posexplode("free").alias("i", "x"))
            twos = ones.select("fp", "key", "x", F.explode(F.slice("free", F.col("i") + 2, F.lit(16))).alias("y"))
            blank = F.col("fp").bitwiseAND(F.bitwise_not(_bit(F.col("x")).bitwiseOR(_bit(F.col("y")))))
            group = twos.select("fp", F.struct("key.at", "x", "y", blank.alias("is")).alias("g"))
            least = group.groupBy("g").agg(F.min("fp").alias("v"), F.collect_list("fp").alias("members")).filter(F.size("members") > 1)
            found.append(least.select(F.explode("members").alias("u"), "v").filter("u <> v"))
    out = found[0]
    for more_links in found[1:]:
        out = out.unionByName(more_links)
    return out.distinct()


def _bit(position: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), position.cast("int"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, copies: bool = False) -> DataFrame:
    """id_col, fp long, component_id (the smallest id reachable by links, itself included).

    With copies, texts of Jaccard similarity 0.8 over five words are linked too (near_copies).
    """
    docs = checkpoint(fingerprints(df, id_col, text_col, k, copies))
    first = checkpoint(docs.groupBy("fp").agg(F.min(id_col).alias("rep")))
    linked = links(first.select("fp"))
    if copies:
        linked = linked.unionByName(near_copies.links(docs.withColumnRenamed("fp", "node"), df, text_col))
    found = components(linked)
    # components are of fingerprints; each takes the smallest id of its fingerprints
    named = first.join(found.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    of_fp = named.select("fp", "component").join(least.hint("merge"), "component").select("fp", "component_id")
    return docs.join(of_fp.hint("merge"), "fp").select(id_col, "fp", "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, copies: bool = False) -> DataFrame:
    """The rows of df without near-duplicates: of each component the document with the smallest id.

    Rows without an id stay. Of rows that repeat a kept id, one stays.
    """
    held, (key, body) = private(df, id_col, text_col)
    rows = held.filter(F.col(key).isNotNull())
    found = near_duplicates(rows.select(F.col(key).alias("id"), F.col(body).alias("body")), "id", "body", k, copies)
    kept = checkpoint(found.filter(F.col("id") == F.col("component_id")).groupBy("id").agg(F.count("*").alias("times")))
    out = held.join(kept.hint("shuffle_hash"), F.col(key) == F.col("id"))
    if not kept.filter("times > 1").isEmpty():
        once = out.filter("times > 1").dropDuplicates([key])
        out = out.filter("times = 1").unionByName(once)
    return out.select(held.columns).unionByName(held.filter(F.col(key).isNull())).toDF(*df.columns)
