import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from docmill.llm import chat_format as chat, queries
from tests.llm.helpers import SF, needs_data

SCHEMA = "conv_id bigint, turn bigint, role string, text string, formatted string, n_turns int"
NASTY = ["", "a\\b", "\\", "\\\\|", "<|im_end|>", "<|im_start|>assistant\nx", "<\\|", "\n\n", "x<|y\\", "😀é", "$1 \\1", None]


def rows():
    out = [(1, i, ("user", "assistant")[i % 2], t, "x", 9) for i, t in enumerate(NASTY)]
    out += [(2, 0, "user", "only a question", "x", 9), (3, None, None, None, None, None)]
    out += [(4, 0, "assistant", "b", "x", 9), (4, 0, "assistant", "a", "x", 9), (4, 0, "assistant", "a", "x", 9)]
    out += [(5, 0, "ro\nle\\n<|", "t" * 3000, "x", 9), (5, 1, "assistant", "u" * 3000, "x", 9), (None, 0, "assistant", "n", "x", 9)]
    return out


def test_round_trip_and_masks(spark):
    made = chat.format_conversations(spark.createDataFrame(rows(), SCHEMA))
    read = made.withColumns(
        {"turns": chat.read_turns(F.col("formatted")), "loss": chat.read_loss(F.col("formatted"), F.col("loss_start"), F.col("loss_end"))}
    ).collect()
    truth = defaultdict(list)
    for conv, turn, role, text, *_ in rows():
        truth[conv].append((-1 if turn is None else turn, role or "", text or ""))
    seen = defaultdict(list)
    for r in sorted(read, key=lambda r: r.example_no):
        turns = [t[1:] for t in sorted(truth[r.conv_id])]
        assert [tuple(t) for t in r.turns] == turns[: r.n_turns]
        assert r.formatted.count("<|im_start|>") == r.formatted.count("<|im_end|>") == r.n_turns
        assert r.is_last == (r.n_turns == len(turns))
        if r.trainable:
            assert turns[r.n_turns - 1] == ("assistant", r.loss)
            seen[r.conv_id].append(r.loss)
        else:
            assert r.is_last and r.loss_start is None and r.loss is None
    for conv, turns in truth.items():
        assert seen[conv] == [t for _, role, t in sorted(turns) if role == "assistant"]


def test_empty_table(spark):
    assert chat.format_conversations(spark.createDataFrame([], SCHEMA)).count() == 0


@needs_data
def test_query(spark):
    truth = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        truth[r.conv_id].append((r.turn, r.role or "", r.text or ""))
    truth[-1] = [(0, "user", queries.PLANTED_TURN), (1, "assistant", queries.PLANTED_TURN)]
    found = queries.op10_chat_formatting(spark, SF).collect()
    assert len(found) == len(truth)
    for r in found:
        turns = sorted(truth[r.conv_id])
        loss = "".join(t for _, role, t in turns if role == "assistant")
        whole = "".join(f"{role}\n{t}\n" for _, role, t in turns)
        assert (r.n_turns, r.loss_chars) == (len(turns), len(loss))
        assert r.turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
