"""From raw documents to token ids: five stages, each written as Parquet and read again by the next.

A stage takes (spark, docs, sf_dir). All but the last return the columns of docs; what a stage
drops or cuts is gone for those after it. Rows are dropped for a toxic score, for being a
near-duplicate of a document with a smaller id, or for overlapping a benchmark item; repeated
passages are cut out of texts, and n_chars then follows the text. Everything else stays, empty
texts too.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm import bpe, decontamination, simhash, suffix_dedup, toxicity
from docmill.llm.common import fold, remove, shared_dir, table
from docmill.llm.queries import VOCABULARY


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5. The weights come from the labels outside fold 0."""
    weights = toxicity.learn(docs, table(spark, sf_dir, "labels").filter(fold() != 0))
    names = [f"_{i}" for i in range(len(docs.columns))]
    held = docs.select(*[F.col(c).alias(n) for c, n in zip(docs.columns, names)])
    id_col, text_col = (names[docs.columns.index(c)] for c in ("doc_id", "text"))
    scored = toxicity.score(held, weights, id_col, text_col, keep=[n for n in names if n != id_col])
    return scored.filter("score < 0.5").select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names)])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id.

    Near-duplicates are within two bits of SimHash, or at Jaccard similarity 0.8 over five words.
    """
    return simhash.keep_one(docs, copies=True)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that documents with smaller ids have."""
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    left = suffix_dedup.dedup(docs, keep=others, as_text=True).withColumnRenamed("kept", "text")
    n_chars = F.char_length("text")
    return left.select(*[n_chars.cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def benchmark_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and decoded, the text that the ids give back."""
    import public_tokenizers

    return bpe.encode_texts(docs, public_tokenizers.path(VOCABULARY))


STAGES = [
    ("toxicity", toxicity_filter),
    ("simhash near-dedup", near_dedup),
    ("suffix-array dedup", passage_dedup),
    ("benchmark decontamination", benchmark_filter),
    ("bpe", tokenize),
]

#: The fitted model, the components and the tokens have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. A stage's files in the shared folder go once the next has read them, or failed."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        where = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
        try:
            stage(spark, docs, sf_dir).write.parquet(where)
        except BaseException:
            remove(spark, where)
            raise
        finally:
            if before:
                remove(spark, before)
        docs, before = spark.read.parquet(where), where
    return docs
