"""Shards of near equal bytes by a k-d tree over documents' metadata.

A node of the tree that holds k shards is cut into one of k // 2 and one of the rest, along the
dimension in which it is widest (its extent against that of all rows; the first of equally wide
ones), at the weighted median: the place in the order along that dimension where the left side's
bytes come nearest to its share of the node's. Nodes of one shard are leaves; a leaf has about the
total divided by the number of shards, and differs from it by about as much as the documents at its borders weigh.

All nodes of a level are cut together, in a few passes that shuffle only sums. A row's place along
a dimension is one integer: its 24-bit coordinate, then 20 bits of its text's hash, then 18 bits of its id's hash.
So equal texts lie together in a leaf wherever a border does not have to fall within them, and a
value, source or group of copies with a third of all rows is cut like any other. A pass sums bytes over BINS
even bins between the least and greatest place of each node's rows in question; the bin in which the share
is reached is the next pass's range, until one place is left, so that cuts are exact.
What comes to the driver is one row for each node; cuts go out as constant arrays. After each level the rows'
nodes are written to the shared folder, and the level before is removed.

Numbers of a shard's rows (slots) are gapless without an order over the shard: rows are numbered within
hashed groups of each shard, which are then put one after the other by their counts.

Null texts are empty; sizes are UTF-8 bytes plus `fixed`. Null metadata have coordinate 0, like the least value;
strings get theirs from their md5. Null ids count as empty ones. Rows that repeat an id and a text have the same place
and stay in one shard, next to each other. With fewer rows than shards some shards are empty; an empty table
gives no rows. Other columns may have any name; they are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from docmill.llm.common import remove, stored

COORDINATE, TEXT_BITS, ID_BITS = 24, 20, 18
BINS = 256
SLOT_GROUPS = 4096
DIMENSIONS = ("lang", "source", "n_chars")


def _hashed(value: Column, bits: int) -> Column:
    """The first bits of the value's md5; nulls count as empty."""
    digits = F.substring(F.md5(F.coalesce(value.cast("string"), F.lit("")).cast("binary")), 1, 8)
    return F.shiftright(F.conv(digits, 16, 10).cast("long"), 32 - bits)


def _array(values: list[int]) -> Column:
    """A constant array, from one string."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _rows(docs: DataFrame, dimensions: tuple[str, ...], doc_id: str, text: str, fixed: int) -> DataFrame:
    """doc_id, size, text_crc32, tie, d0, d1 ...: what the tree works on."""
    body = F.coalesce(F.col(text), F.lit(""))
    tie = F.shiftleft(_hashed(body, TEXT_BITS), ID_BITS) + _hashed(F.col(doc_id), ID_BITS)
    raw = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(body).cast("long") + fixed).alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), tie.alias("tie"), *[F.col(d).alias(f"d{i}") for i, d in enumerate(dimensions)])
    numbers = [f"d{i}" for i, d in enumerate(dimensions) if isinstance(docs.schema[d].dataType, NumericType)]
    ends = raw.agg(*[f(c).cast("double").alias(f"{n}_{c}") for c in numbers for n, f in (("least", F.min), ("most", F.max))], F.lit(0)).first()
    for c in [f"d{i}" for i in range(len(dimensions))]:
        if c in numbers:
            least, most = ends[f"least_{c}"] or 0.0, ends[f"most_{c}"] or 0.0
            place = F.floor((F.coalesce(F.col(c).cast("double"), F.lit(least)) - least) * ((1 << COORDINATE) - 1) / (most - least or 1.0))
            raw = raw.withColumn(c, place.cast("long"))
        else:
            raw = raw.withColumn(c, F.when(F.col(c).isNull(), 0).otherwise(_hashed(F.col(c), COORDINATE)).cast("long"))
    return raw


def _place(dimension: Column, n: int) -> Column:
    """A row's place along the dimension of that number."""
    coordinate = F.coalesce(*[F.when(dimension == i, F.col(f"d{i}")) for i in range(n)])
    return F.shiftleft(coordinate, TEXT_BITS + ID_BITS) + F.col("tie")


def _by_node(values: dict[int, int]) -> Column:
    """The value of a row's node; -1 or null for nodes without one."""
    return F.get(_array([values.get(k, -1) for k in range(max(values) + 1)]), F.col("node"))


def _extents(rows: DataFrame, n: int) -> dict[int, tuple[int, list[tuple[int, int]]]]:
    """node -> (its bytes, its least and greatest coordinate in each dimension)."""
    ends = [f(f"d{i}").alias(f"{name}{i}") for i in range(n) for name, f in (("low", F.min), ("high", F.max))]
    found = rows.groupBy("node").agg(F.sum("size").alias("size"), *ends).collect()
    return {r.node: (r["size"], [(r[f"low{i}"], r[f"high{i}"]) for i in range(n)]) for r in found}


def _cuts(rows: DataFrame, n: int, ways: dict[int, int], wanted: dict[int, int], question: dict[int, tuple[int, int, int]]) -> dict[int, int]:
    """node -> the least place of its right side.

    ways: its dimension; wanted: bytes for the left side; question: first and last place that may hold the cut, bytes before them.
    """
    placed = rows.select("node", "size", _place(_by_node(ways), n).alias("place"))
    found: dict[int, int] = {}
    while question:
        low, high, before = ({k: q[i] for k, q in question.items()} for i in range(3))
        step = {k: max(1, -(-(q[1] - q[0] + 1) // BINS)) for k, q in question.items()}
        inside = placed.filter((F.col("place") >= _by_node(low)) & (F.col("place") <= _by_node(high)))
        sums = inside.groupBy("node", ((F.col("place") - _by_node(low)) / _by_node(step)).cast("long").alias("bin")).agg(F.sum("size").alias("size"), F.min("place").alias("low"), F.max("place").alias("high"))
        up_to = F.sum("size").over(Window.partitionBy("node").orderBy("bin")) + _by_node(before)
        reached = sums.withColumn("up_to", up_to).filter(F.col("up_to") >= _by_node(wanted))
        for r in reached.groupBy("node").agg(F.min(F.struct("bin", "up_to", "size", "low", "high")).alias("b")).collect():
            k, b, left = r.node, r.b, r.b["up_to"] - r.b["size"]
            if b.low < b.high:
                question[k] = (b.low, b.high, left)
                continue
            found[k] = b.low + 1 if b["up_to"] - wanted[k] < wanted[k] - left else b.low
            del question[k]
    return found


def _leaves(rows: DataFrame, n: int, n_shards: int) -> DataFrame:
    """rows with node, the number of its leaf."""
    held, where = stored(rows.withColumn("node", F.lit(0)))
    shares, whole = [n_shards], None
    while max(shares) > 1:
        extents = _extents(held, n)
        whole = whole or [high - low or 1 for low, high in extents[0][1]] if extents else None
        first = [sum(1 if k == 1 else 2 for k in shares[:i]) for i in range(len(shares))]
        ways, wanted, question = {}, {}, {}
        for node, (size, ends) in extents.items():
            if (k := shares[node]) > 1:
                ways[node] = max(range(n), key=lambda i: ((ends[i][1] - ends[i][0]) / whole[i], -i))
                low, high = ends[ways[node]]
                wanted[node] = size * (k // 2) // k
                question[node] = (low << TEXT_BITS + ID_BITS, (high + 1 << TEXT_BITS + ID_BITS) - 1, 0)
        node = _by_node(dict(enumerate(first)))
        if ways:
            cuts = _cuts(held, n, ways, wanted, question)
            cut = _by_node(cuts)
            right = (cut >= 0) & (_place(_by_node(ways), n) >= cut)
            node = node + F.coalesce(right.cast("int"), F.lit(0))
        held, before = held.withColumn("node", node.cast("int")), where
        held, where = stored(held)
        remove(rows.sparkSession, before)
        shares = [half for k in shares for half in ([1] if k == 1 else [k // 2, k - k // 2])]
    return held


def shards(docs: DataFrame, n_shards: int, dimensions: tuple[str, ...] = DIMENSIONS, doc_id: str = "doc_id", text: str = "text", fixed: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, shard (0 to n_shards - 1), slot (0, 1, 2 ... within a shard) of every document."""
    held = _leaves(_rows(docs, dimensions, doc_id, text, fixed), len(dimensions), n_shards)
    groups = max(1, SLOT_GROUPS // n_shards)
    held = held.select("doc_id", "size", "text_crc32", F.col("node").alias("shard"), (_hashed(F.col("doc_id"), 32) % groups).alias("_group"))
    sizes = held.groupBy("shard", "_group").agg(F.count("*").alias("_n"))
    start = F.sum("_n").over(Window.partitionBy("shard").orderBy("_group")) - F.col("_n")
    starts, _ = stored(sizes.select("shard", "_group", start.alias("_start")))
    number = F.row_number().over(Window.partitionBy("shard", "_group").orderBy("doc_id", "text_crc32")) - 1
    return held.join(starts, ["shard", "_group"]).select("doc_id", "size", "text_crc32", "shard", (number + F.col("_start")).cast("long").alias("slot"))


def target_shards(docs: DataFrame, target_bytes: int, text: str = "text", fixed: int = 16) -> int:
    """How many shards of about target_bytes a table fills."""
    total = docs.agg(F.sum(F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long") + fixed)).first()[0] or 0
    return max(1, round(total / target_bytes))
