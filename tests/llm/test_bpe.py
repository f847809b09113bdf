import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from docmill.llm import bpe, queries
from tests.llm.helpers import SF, docs, needs_data

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "aa", "e", " ", "  ", "\n", "the", "<|endoftext|>", "<|endoftext", "é", "ß", "1", "23", "'s", "\x1c", "\x85", "　", "😀", "​", "=", "中", "́", "Zug"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(PATH)


def texts(n=1500):
    pick = random.Random(1)
    mixed = ["".join(pick.choice(PARTS) for _ in range(pick.randint(0, 30))) for _ in range(n)]
    letters = ["".join(chr(pick.randint(97, 122)) for _ in range(pick.randint(1, 30))) for _ in range(n)]
    return [*mixed, *letters, *("a" * k for k in range(60)), "ab" * 3000, "x" * 20000]


def test_automaton_and_merges_agree_with_the_library(library, vocabulary):
    automaton = bpe.Automaton(vocabulary)
    encoder, counter = bpe.Encoder(automaton, vocabulary.special), bpe.Counter(vocabulary, bpe.whole_tokens(vocabulary))
    for text in texts():
        ids = library.encode(text, add_special_tokens=False).ids
        assert encoder.encode(text).tolist() == ids
        assert counter.count(text) == len(ids)
        assert bpe.decode(ids, vocabulary.pieces) == text == library.decode(ids, skip_special_tokens=False)


def test_words_of_the_vocabulary_walk_the_compiled_table(library, vocabulary):
    automaton = bpe.Automaton(vocabulary)
    states, arcs = len(automaton.token), len(automaton.table)
    for token, piece in vocabulary.pieces.items():
        if token in automaton.gadgets.birth:
            assert automaton.encode(piece) == [token]
    assert (len(automaton.token), len(automaton.table)) == (states, arcs)
    before = automaton.encode(b"qzxjv" * 40)
    assert len(automaton.token) > states
    automaton.forget()
    assert (len(automaton.token), len(automaton.table)) == (states, arcs) and automaton.encode(b"qzxjv" * 40) == before


def test_whole_tokens_are_one_token(library, vocabulary):
    whole = sorted(bpe.whole_tokens(vocabulary))[::50]
    assert all(len(library.encode(w, add_special_tokens=False).ids) == 1 for w in whole)


def test_operators_on_odd_rows(spark, library):
    df = docs(spark, [(1, None), (2, ""), (3, "the the"), (3, "the the"), (None, "z" * 5000)])
    rows = bpe.encode_texts(df, PATH).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.decoded) for r in rows) == [
        (False, 1, 0, ""), (False, 2, 0, ""), (False, 3, 2, "the the"), (False, 3, 2, "the the"),
        (True, 0, len(library.encode("z" * 5000).ids), "z" * 5000),
    ]
    counts = bpe.count_tokens(df, PATH).collect()
    assert sorted((r.n_bytes, r.n_tokens) for r in counts)[:4] == [(0, 0), (0, 0), (7, 2), (7, 2)]
    assert bpe.encode_texts(df.filter("doc_id < 0"), PATH).count() == 0
    assert bpe.count_tokens(df.filter("doc_id < 0"), PATH).count() == 0


@needs_data
def test_queries_against_the_library(spark, library):
    truth = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op5_bpe_roundtrip(spark, SF).collect():
        ids = library.encode(truth[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(truth[r.doc_id].encode()).hexdigest()
    for r in queries.op3_token_counts(spark, SF).collect():
        n = len(library.encode(truth[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(truth[r.doc_id].encode()), n, n > 512)
