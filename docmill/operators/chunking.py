"""Paragraphs, pages and overlapping chunks."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from docmill.functions.text import uuid5
from docmill.workers import ship

SEPARATORS = ("\n\n", "\n", ".", " ", "")


def paragraphs(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, paragraph_number (blank ones count), clean_text of the paragraphs that say something."""
    each = df.select(doc_id, F.posexplode_outer(F.split(F.coalesce(text, F.lit("")), "\n\n", -1)).alias("_pos", "_p"))
    return each.select(doc_id, (F.col("_pos") + 1).alias("paragraph_number"), F.trim("_p").alias("clean_text")).filter("clean_text <> ''")


def pages_of(lengths: Column, most: int = 2000) -> Column:
    """The page of each paragraph: a length is added first; past the most a page begins and the sum starts at zero.

    The fold keeps where pages begin, and the pages are laid out from that.
    """
    start = F.struct(F.lit(0).alias("at"), F.lit(0).cast("long").alias("sum"), F.array(F.lit(0)).alias("begins"))

    def step(acc: Column, n: Column) -> Column:
        total = acc["sum"] + n
        full = total > most
        return F.struct((acc["at"] + 1).alias("at"), F.when(full, F.lit(0).cast("long")).otherwise(total).alias("sum"), F.when(full, F.array_append(acc["begins"], acc["at"])).otherwise(acc["begins"]).alias("begins"))

    def laid(acc: Column) -> Column:
        ends = F.array_append(F.slice(acc["begins"], F.lit(2), F.size(acc["begins"])), acc["at"])
        return F.flatten(F.transform(F.zip_with(acc["begins"], ends, lambda b, e: e - b), lambda n, i: F.array_repeat(i + 1, n)))

    return F.aggregate(lengths, start, step, laid)


def segments(df: DataFrame, doc_id: str, text: str, most: int = 2000) -> DataFrame:
    """chunk_id, doc_id, page_number, paragraph_number, clean_text; ids depend on what they name only."""
    split = F.split(F.coalesce(text, F.lit("")), "\n\n", -1)
    rows = F.filter(
        F.transform(split, lambda p, i: F.struct((i + 1).alias("paragraph_number"), F.trim(p).alias("clean_text"))), lambda r: r["clean_text"] != ""
    )
    listed = df.select(doc_id, rows.alias("_rows"))
    paged = listed.withColumn("_pages", pages_of(F.transform("_rows", lambda r: F.char_length(r["clean_text"]).cast("long")), most))
    each = paged.select(doc_id, F.explode(F.arrays_zip("_rows", "_pages")).alias("_z"))
    out = each.select(doc_id, F.col("_z._pages").alias("page_number"), "_z._rows.paragraph_number", "_z._rows.clean_text")
    name = F.concat_ws("|", F.col(doc_id).cast("string"), F.col("paragraph_number").cast("string"), F.md5("clean_text"))
    return out.withColumn("chunk_id", uuid5(name))


def _split(text: str, size: int, overlap: int, separators: Sequence[str]) -> list[str]:
    at = next((i for i, s in enumerate(separators) if not s or s in text), len(separators) - 1)
    mark, finer = separators[at], separators[at + 1 :]
    # a separator stays with the piece that it begins
    parts = [p for p in ([mark * (i > 0) + p for i, p in enumerate(text.split(mark))] if mark else list(text)) if p]
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        out.extend(_joined(run, size, overlap))
        run.clear()

    for part in parts:
        if len(part) <= size:
            run.append(part)
        else:
            flush()
            out.extend(_split(part, size, overlap, finer) if finer else [part])
    flush()
    return out


def _joined(parts: list[str], size: int, overlap: int) -> list[str]:
    """Parts joined up to size, each chunk beginning with the last parts of the one before, up to overlap."""
    out: list[str] = []
    held: list[str] = []
    total = 0
    for part in parts:
        if held and total + len(part) > size:
            out.append("".join(held).strip())
            while held and (total > overlap or total + len(part) > size):
                total -= len(held.pop(0))
        held.append(part)
        total += len(part)
    if held:
        out.append("".join(held).strip())
    return [c for c in out if c]


def chunks(df: DataFrame, doc_id: str, text: str, size: int = 1000, overlap: int = 200, separators: Sequence[str] = SEPARATORS) -> DataFrame:
    """doc_id, chunk_index, text: cut at the coarsest separator that gives pieces of `size` characters at most."""
    ship(df.sparkSession)

    @pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _split(t, size, overlap, separators) if t else [])

    return df.select(doc_id, F.posexplode(cut(F.col(text))).alias("chunk_index", "text"))
