"""Records of cases, files, conversations and summaries as batch operations on tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def insert_if_absent(target: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The rows of new that target lacks, the first of each key; append them to target."""
    first = new.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")
    return first.join(target.select(*keys), keys, "left_anti")


def upsert(target: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the one written last. An aggregation with partial results, so a hot key costs nothing."""
    rows = target.unionByName(new)
    named = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy(key).agg(F.max_by(named, F.struct(order, *[c for c in rows.columns if c not in (key, order)])).alias("_r")).select("_r.*")


def update(target: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Target with the changes that are not null."""
    given = changes.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    joined = target.join(given, key, "left")
    return joined.select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in target.columns])


def alive(df: DataFrame, owner: str | None = None, status: str = "status") -> DataFrame:
    out = df.filter(F.col(status) != "deleted")
    return out if owner is None else out.filter(F.col("user_id") == owner)


def with_counts(cases: DataFrame, children: DataFrame, key: str, name: str) -> DataFrame:
    """Cases with the number of their children: one aggregation and one join for all."""
    n = children.groupBy(key).agg(F.count("*").alias(name))
    return cases.join(n, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def found_and_missing(ids: DataFrame, files: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    return ids.join(files, key), ids.join(files.select(key), key, "left_anti")


def body(*columns: str) -> Column:
    """The first of the columns that says something, else the row as JSON."""
    return F.coalesce(*[F.when(F.trim(F.coalesce(c, F.lit(""))) != "", F.col(c)) for c in columns], F.to_json(F.struct("*")))


def titles(df: DataFrame, key: str, title: str, doc_type: str, order: str, n: int = 20) -> DataFrame:
    """The first n titles of each key as 'title (type)'."""
    w = Window.partitionBy(key).orderBy(order)
    label = F.concat(F.coalesce(title, F.lit("?")), F.lit(" ("), F.coalesce(doc_type, F.lit("?")), F.lit(")"))
    top = df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).select(key, "_rn", label.alias("label"))
    return top.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_rn", "label"))), lambda x: x["label"]).alias("titles"))


def paired(texts: Column, files: Column) -> Column:
    """(pos, text, file) of texts that say something; a missing file gets a made-up name."""
    rows = F.transform(F.arrays_zip(texts.alias("t"), files.alias("f")), lambda x, i: F.struct(i.alias("pos"), x["t"].alias("text"), F.coalesce(x["f"], F.concat(F.lit("ocr_doc_"), i.cast("string"))).alias("file")))
    return F.filter(rows, lambda r: F.trim(F.coalesce(r["text"], F.lit(""))) != "")


def memory_search(df: DataFrame, prefix: str, limit: int = 10, offset: int = 0) -> DataFrame:
    return df.filter(F.col("namespace").startswith(prefix)).orderBy("namespace", "key").offset(offset).limit(limit)


def namespaces(df: DataFrame, prefix: str, limit: int = 100, offset: int = 0) -> DataFrame:
    return df.filter(F.col("namespace").startswith(prefix)).select("namespace").distinct().orderBy("namespace").offset(offset).limit(limit)


def remembered(facts: DataFrame, key: str, order: str, text: str, n: int = 8, most: int = 800) -> DataFrame:
    """Each key's newest n facts in one text."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    top = facts.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n)
    rows = top.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_rn", text))).alias("_t"))
    return rows.select(key, F.substring(F.array_join(F.transform("_t", lambda x: x[text]), "; "), 1, most).alias("memory"))
