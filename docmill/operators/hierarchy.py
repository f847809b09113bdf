"""Tagged hierarchical texts: articles with their place, and tables of contents."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docmill.functions import text as T
from docmill.workers import ship

# The tags, from the outermost level down; a level's heading clears those below it.
LEVELS = ("BOOK", "PART", "CHAPTER", "SECTION")
TAG = re.compile(r"\[(/?)(PREFACE|BOOK|PART|CHAPTER|SECTION|ARTICLE)([^\]]*)\]", re.IGNORECASE)
ID = re.compile(r'id\s*=\s*"?([^"\s\]]+)"?')
KINDS = "pos int, tag string, attrs string, content string"


def elements(text: str) -> Iterator[tuple[int, str, str, str]]:
    """(position, tag, attributes, content) as tags close; a closing tag ends the nearest open one of its name."""
    open_: list[tuple[str, str, int]] = []
    n = 0
    for m in TAG.finditer(text):
        name = m[2].upper()
        if not m[1]:
            open_.append((name, m[3].strip(), m.end()))
            continue
        match = next((i for i in reversed(range(len(open_))) if open_[i][0] == name), None)
        if match is not None:
            _, attrs, start = open_.pop(match)
            yield n, name, attrs, text[start : m.start()].strip()
            n += 1


def parse(df: DataFrame, source: str, text: str) -> DataFrame:
    """source, pos, tag, attrs, content of every closed element of every text."""
    ship(df.sparkSession)

    def run(batches):
        for batch in batches:
            rows = [(s, *e) for s, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for e in elements(t or "")]
            columns = list(zip(*rows)) or [()] * 5
            types = [batch.schema.types[0], pa.int32(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=[source, "pos", "tag", "attrs", "content"])

    return df.select(source, text).mapInArrow(run, f"{source} {df.schema[source].dataType.simpleString()}, {KINDS}")


def articles(df: DataFrame, source: str, text: str) -> DataFrame:
    """One row per numbered article with the headings that it stands under, carried down in order."""
    rows = parse(df, source, text).filter("tag <> 'PREFACE'")
    heading = F.when(F.col("tag").isin("BOOK", "PART"), T.squeeze(F.col("content"))).when(F.col("tag") == "CHAPTER", T.first_lines(F.col("content"))).otherwise(T.first_line(F.col("content")))
    w = Window.partitionBy(source).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    seen = rows.withColumn("_heading", heading)
    for i, level in enumerate(LEVELS):
        # the last heading of this level, unless one of a level above has come since
        at = F.max(F.when(F.col("tag") == level, F.col("pos"))).over(w)
        above = F.coalesce(F.max(F.when(F.col("tag").isin(*LEVELS[:i]), F.col("pos"))).over(w), F.lit(-1)) if i else F.lit(-1)
        last = F.last(F.when(F.col("tag") == level, F.col("_heading")), ignorenulls=True).over(w)
        seen = seen.withColumn(level.lower(), F.when(at > above, last))
    number = T.article_id(F.nullif(F.regexp_extract("attrs", ID.pattern, 1), F.lit("")))
    out = seen.filter("tag = 'ARTICLE'").withColumn("article_index", number).filter("article_index is not null")
    return out.select(source, "article_index", *[level.lower() for level in LEVELS], T.squeeze(F.col("content")).alias("body"), "pos")


def contents(df: DataFrame, source: str, text: str) -> DataFrame:
    """source, chapter_id, title, sections (id, title): numbered chapters, sections numbered within each."""
    rows = parse(df, source, text).filter("tag in ('CHAPTER', 'SECTION')")
    w = Window.partitionBy(source).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    numbered = rows.withColumn("chapter_id", F.sum(F.when(F.col("tag") == "CHAPTER", 1).otherwise(0)).over(w)).filter("chapter_id > 0")
    inner = Window.partitionBy(source, "chapter_id").orderBy("pos")
    section = numbered.withColumn("_n", F.row_number().over(inner) - 1)
    listed = F.array_sort(F.collect_list(F.when(F.col("tag") == "SECTION", F.struct(F.col("_n").alias("id"), T.first_line(F.col("content")).alias("title")))))
    return section.groupBy(source, "chapter_id").agg(F.max(F.when(F.col("tag") == "CHAPTER", T.first_lines(F.col("content")))).alias("title"), listed.alias("sections"))
