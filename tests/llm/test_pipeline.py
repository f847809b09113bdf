import public_tokenizers
import pytest
from tokenizers import Tokenizer

from docmill.llm import near_copies
from tests.llm.helpers import SF, needs_data
from tests.llm.test_decontamination import plain as overlaps
from tests.llm.test_simhash import plain_components, plain_fingerprint
from tests.llm.test_suffix_dedup import removed, whole

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@needs_data
def test_each_stage_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r for r in docs.collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = {r.doc_id: r for r in docs.collect()}
        assert len(after) == docs.count() and set(after) <= set(before)
        if name != "bpe":
            assert docs.columns == columns
        texts = {k: r.text for k, r in before.items()}
        if name == "toxicity":
            assert 0.8 * len(before) < len(after) < len(before)
            assert all(after[k] == before[k] for k in after)
        elif name == "simhash near-dedup":
            # within two bits of SimHash, or at a Jaccard similarity of 0.8 over five words
            sets = {k: near_copies.shingles(t) for k, t in texts.items()}
            least = plain_components({k: plain_fingerprint(t) for k, t in texts.items()}, lambda a, b: near_copies.similar(sets[a], sets[b]))
            assert set(after) == {k for k in texts if least[k] == k}
        elif name == "suffix-array dedup":
            order = list(texts)
            want = dict(zip(order, map(whole, removed([(k, texts[k].encode()) for k in order]))))
            assert {k: r.text for k, r in after.items()} == want
            assert all(r.n_chars == len(r.text) and r.lang == before[k].lang for k, r in after.items())
        elif name == "benchmark decontamination":
            assert set(after) == set(texts) - {k for k, _ in overlaps(texts.items(), items)}
        else:
            library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
            assert set(after) == set(texts)
            for k, r in after.items():
                assert r.ids == library.encode(texts[k], add_special_tokens=False).ids and r.decoded == texts[k]
        seen.append((name, len(after)))
        before = after
    assert corpus_pipeline.run(spark, SF).count() == seen[-1][1]


def test_empty_tables_and_odd_columns(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id bigint, text string, y string, _hit string, n_chars bigint, score string")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, str(tmp_path))
        assert out.count() == 0
        assert name == "bpe" or out.columns == empty.columns
    one = spark.createDataFrame([(1, None, None, None, None, "s"), (None, "t", "en", "x", 1, None)], empty.schema)
    docs = one
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
    assert sorted((r.doc_id or 0, r.text or "", r.score or "") for r in docs.collect()) == [(0, "t", ""), (1, "", "s")]
