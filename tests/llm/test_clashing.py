"""Results don't change for columns whose names the operators might use for themselves, nor for long texts."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from docmill.llm import bpe, chat_format, fingerprints, warc
from tests.llm.helpers import clashing

PATH = public_tokenizers.path("byte_bpe_50k.json")
ROWS = [(1, "some words here"), (2, None), (3, ""), (4, "a paragraph\n\nand another\n\n" * 40), (5, "some words here"), (9, "long text é 😀 " * 4000)]
#: Names of results, and of columns that operators make on their way.
MORE = ["ids", "decoded", "n_tokens", "n_bytes", "fingerprint", "_range", "_no", "_own", "_next", "_which", "_body", "_h", "_units", "b", "digest", "kind", "block", "number", "refers", "payload", "record_type", "example_no", "turns", "_turns", "formatted", "loss_start", "is_last"]


@pytest.fixture(scope="module")
def tables(spark):
    plain = spark.createDataFrame(ROWS, "doc_id bigint, text string")
    return plain, clashing(spark, ROWS).withColumns({c: F.lit(3) for c in MORE})


def same(a, b):
    rows = lambda df: sorted(str(r) for r in df.select(sorted(df.columns)).collect())
    assert rows(a) == rows(b)


def test_tokens(tables):
    plain, odd = tables
    same(bpe.count_tokens(plain, PATH), bpe.count_tokens(odd, PATH))
    same(bpe.encode_texts(plain, PATH), bpe.encode_texts(odd, PATH))


def test_fingerprints(tables):
    same(*[fingerprints.compare_with_next(t) for t in tables])
    same(*[fingerprints.fingerprints(t, ["doc_id"]) for t in tables])


def test_archives(spark, tables, tmp_path):
    found = []
    for i, t in enumerate(tables):
        pages = t.withColumnsRenamed({"doc_id": "page_id", "text": "html"}).withColumn("url", F.lit("http://x/"))
        warc.write(pages, str(tmp_path / f"w{i}"), segment=5000)
        found.append(warc.resolve(warc.read(spark, str(tmp_path / f"w{i}"))))
    same(*found)


def test_conversations(tables):
    found = []
    for t in tables:
        turns = t.select(F.lit(1).cast("long").alias("conv_id"), F.col("doc_id").alias("turn"), F.when(F.col("doc_id") % 2 == 0, "assistant").otherwise("user").alias("role"), "text", *[c for c in t.columns if c not in ("doc_id", "text")])
        found.append(chat_format.format_conversations(turns).select("conv_id", "example_no", "formatted", "loss_start", "loss_end", "trainable", "is_last"))
    same(*found)
