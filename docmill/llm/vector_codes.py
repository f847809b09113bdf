"""Product codes of vectors: Lloyd's rounds for each part, pruned by Elkan's bounds.

Components become integers, floor(scale * x), and vectors are cut into equal consecutive parts.
Each part position has a codebook; its entries start as that part of the smallest vec_ids. A round
assigns every part to its nearest entry (squared distance, ties to the lower index) and replaces each
entry by the floored mean of its parts; entries without parts stay. A last assignment follows.

After the first assignment every vector carries, for each part, an upper bound of the distance to
its entry and one lower bound for each entry, persisted in a table of the shared folder from round
to round; when entries move, bounds are shifted by as much. A part is left alone if its upper bound
is strictly below half the distance from its entry to the nearest other one; an entry is left alone
if its lower bound, or half its distance from the assigned entry, is strictly above the upper bound.
Whatever remains is decided by exact integer distances, so that ties are ties. Lower bounds are
rounded down and upper bounds up, wherever they are computed or stored; in the table a lower bound is one byte.

Rows never meet in one task: assignments are maps over the table, a task hands on one row of sums
for each component of each entry, and the driver holds codebooks, which no amount of rows makes larger. A task
works through CHUNK vectors at a time.

Vectors that are null or hold null or non-finite components are dropped. With fewer vectors than
entries, codebooks are that small. Repeated ids are rows of their own; among equal ids the smaller
vector starts an entry first, and null ids come last. Equal vectors may make equal entries; the
lower index then takes all. Null labels are one label. An empty table gives no rows and empty
codebooks. Other columns may have any name; they are not looked at. Vectors of differing lengths, a
length that the parts do not divide, and components beyond 2^29 after scaling are errors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm.common import checkpoint, remove, stored
from docmill.workers import ship

CHUNK = 1000
LARGEST = 1 << 29
FAR = np.iinfo(np.int64).max


def _up(squared: np.ndarray) -> np.ndarray:
    return np.nextafter(np.sqrt(squared.astype(float)), np.inf)


def _down(squared: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter(np.sqrt(squared.astype(float)), -np.inf), 0)


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a - b) ** 2).sum(-1)


class Bounds:
    """What a chunk of vectors knows of its parts: entry, upper bound, and a lower bound of every entry."""

    def __init__(self, code: np.ndarray, upper: np.ndarray, lower: np.ndarray):
        self.code, self.upper, self.lower = code, upper, lower

    @classmethod
    def unknown(cls, n: int, parts: int, entries: int) -> Bounds:
        return cls(np.zeros((n, parts), np.intp), np.full((n, parts), np.inf), np.zeros((n, parts, entries)))

    def shift(self, moved: np.ndarray) -> None:
        """Entries have moved by at most `moved`."""
        for p in range(len(moved)):
            self.upper[:, p] = np.nextafter(self.upper[:, p] + moved[p][self.code[:, p]], np.inf)
        self.lower = np.maximum(np.nextafter(self.lower - moved, -np.inf), 0)


def assign(x: np.ndarray, books: np.ndarray, known: Bounds) -> int:
    """Brings `known` up to date with books for vectors x of shape (n, parts, width); returns how many distances it computed."""
    computed = 0
    for p, book in enumerate(books):
        apart = _squared(book[:, None], book[None, :])
        half = _down(apart) / 2
        alone = np.where(np.eye(len(book), dtype=bool), np.inf, half).min(1)
        at = np.flatnonzero(known.upper[:, p] >= alone[known.code[:, p]])
        if not len(at):
            continue
        mine, part, rows = known.code[at, p], x[at, p], np.arange(len(at))
        exact = np.full((len(at), len(book)), FAR)
        exact[rows, mine] = own = _squared(part, book[mine])
        upper = _up(own)
        rival = (known.lower[at, p] <= upper[:, None]) & (half[mine] <= upper[:, None])
        rival[rows, mine] = False
        i, j = np.nonzero(rival)
        exact[i, j] = near = _squared(part[i], book[j])
        known.lower[at, p, mine] = _down(own)
        known.lower[at[i], p, j] = _down(near)
        known.code[at, p] = best = exact.argmin(1)
        known.upper[at, p] = _up(exact[rows, best])
        computed += len(at) + len(i)
    return computed


def errors(x: np.ndarray, books: np.ndarray, code: np.ndarray) -> np.ndarray:
    return sum(_squared(x[:, p], book[code[:, p]]) for p, book in enumerate(books))


def moved_means(books: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The floored means, where anything was assigned."""
    return np.where(counts[..., None] > 0, sums // np.maximum(counts, 1)[..., None], books)


def digest(books: np.ndarray) -> str:
    """sha256 of all components in decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def _vectors(column: pa.Array, parts: int, width: int) -> np.ndarray:
    if len(column) and set(np.diff(column.offsets.to_numpy())) != {parts * width}:
        raise ValueError(f"vectors of differing lengths: not all have {parts * width} components")
    x = column.flatten().to_numpy()
    if len(x) and max(x.max(), -x.min()) > LARGEST:
        raise ValueError(f"a component is beyond {LARGEST} after scaling")
    return x.reshape(len(column), parts, width)


def _floats(column: pa.Array, parts: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).astype(float).reshape(len(column), parts)


def _packed(values: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in values], pa.binary())


def shrunk(lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower bounds in a byte each: 255ths, rounded down, of the greatest of their part, and those."""
    top = np.maximum(np.nextafter(lower.max(2, initial=0.0).astype(np.float32), np.float32(-np.inf)), 0)
    share = np.divide(lower, top[..., None], out=np.zeros_like(lower), where=top[..., None] > 0)
    return np.floor(np.minimum(share, 1) * 255 * (1 - 1e-6)).astype(np.uint8), top


def grown(shares: np.ndarray, top: np.ndarray) -> np.ndarray:
    """No more than what was shrunk."""
    return shares / 255 * top[..., None]


def _passes(books: np.ndarray, moved: np.ndarray | None, last: bool):
    """A map over the table: bounds in (none in the first pass), bounds out, or codes and errors in the last one."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, CHUNK):
                b = whole.slice(start, CHUNK)
                x = _vectors(b["x"], parts, width)
                if moved is None:
                    known = Bounds.unknown(len(x), parts, entries)
                else:
                    code = np.frombuffer(b"".join(b["code"].to_pylist()), np.uint8).astype(np.intp).reshape(-1, parts)
                    shares = np.frombuffer(b"".join(b["lower"].to_pylist()), np.uint8).reshape(-1, parts, entries)
                    known = Bounds(code, _floats(b["upper"], parts), grown(shares, _floats(b["top"], parts)))
                    known.shift(moved)
                assign(x, books, known)
                kept = {"vec_id": b["vec_id"], "label": b["label"]}
                if last:
                    yield pa.RecordBatch.from_pydict(kept | {"code": pa.array([bytes(c).hex() for c in known.code.astype(np.uint8)]), "error": pa.array(errors(x, books, known.code))})
                else:
                    upper = np.nextafter(known.upper.astype(np.float32), np.float32(np.inf))
                    lower, top = shrunk(known.lower)
                    yield pa.RecordBatch.from_pydict(kept | {"x": b["x"], "code": _packed(known.code.astype(np.uint8)), "upper": _packed(upper), "lower": _packed(lower), "top": _packed(top)})

    return run


def _sums(state: DataFrame, shape: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Sums and counts of the parts of every entry: summed in tasks, then over tasks."""
    parts, entries, width = shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(shape, np.int64), np.zeros((parts, entries), np.int64)
        for b in batches:
            x = _vectors(b["x"], parts, width)
            code = np.frombuffer(b"".join(b["code"].to_pylist()), np.uint8).reshape(-1, parts)
            for p in range(parts):
                np.add.at(sums[p], code[:, p], x[:, p])
                counts[p] += np.bincount(code[:, p], minlength=entries)
        at = np.flatnonzero(counts.ravel())
        if len(at):
            cells = (at[:, None] * width + np.arange(width)).ravel()
            yield pa.RecordBatch.from_pydict({"cell": pa.array(cells), "total": pa.array(sums.ravel()[cells]), "n": pa.array(np.repeat(counts.ravel()[at], width))})

    each = state.select("x", "code").mapInArrow(run, "cell long, total long, n long")
    sums, counts = np.zeros(parts * entries * width, np.int64), np.zeros(parts * entries * width, np.int64)
    for r in each.groupBy("cell").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
        sums[r.cell], counts[r.cell] = r.total, r.n
    return sums.reshape(shape), counts.reshape(shape)[..., 0]


def compress(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> tuple[DataFrame, np.ndarray]:
    """vec_id, label, code, error, label_error of every vector that is kept; and the codebooks (parts, entries, width).

    code has two hexadecimal digits for each part; label_error is the sum of error over equal labels.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code is one byte: 1 to 256 entries")
    spark = vectors.sparkSession
    ship(spark)
    whole = F.forall("v", lambda c: F.coalesce((c > float("-inf")) & (c < float("inf")), F.lit(False)))
    kept = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v")).filter(F.col("v").isNotNull() & whole)
    kept = kept.select("vec_id", "label", F.transform("v", lambda c: F.floor(c * scale).cast("long")).alias("x"))
    first = [r.x for r in kept.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).collect()]
    length = len(first[0]) if first else parts
    if length % parts or {len(x) for x in first} - {length}:
        raise ValueError(f"{parts} parts need vectors of one length that {parts} divides")
    books = np.array(first, np.int64).reshape(len(first), parts, length // parts).transpose(1, 0, 2).copy()
    kinds = {f.name: f.dataType.simpleString() for f in kept.schema}
    ids = f"vec_id {kinds['vec_id']}, label {kinds['label']}"
    if not first:
        return spark.createDataFrame([], f"{ids}, code string, error long, label_error long"), books

    state, before, moved = kept, None, None
    for _ in range(rounds):
        state, where = stored(state.mapInArrow(_passes(books, moved, False), f"{ids}, x array<bigint>, code binary, upper binary, lower binary, top binary"))
        if before:
            remove(spark, before)
        better = moved_means(books, *_sums(state, books.shape))
        books, moved, before = better, _up(_squared(better, books)), where
    coded = checkpoint(state.mapInArrow(_passes(books, moved, True), f"{ids}, code string, error long"))
    if before:
        remove(spark, before)
    totals = checkpoint(coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")))
    found = coded.join(totals, F.col("label").eqNullSafe(F.col("_label")))
    return found.select("vec_id", "label", "code", "error", "label_error"), books
