"""Toxicity by multiple-instance learning: a document is toxic if one of its sentences is.

A sentence's probability is a logistic function of its words; a document's is the noisy-or of
its sentences', 1 - prod(1 - p). The weights are trained from document labels alone, by
gradient steps on the documents' cross-entropy, so sentences need no labels; afterwards the
sentences' own probabilities locate the offending ones.

Words are lower-cased runs of letters; a word counts once in a sentence, by the weights of the
whole word and of its beginnings, all hashed to WEIGHTS places. Sentences end at . ! ? or a
line's end, at the first such place that leaves at least LEAST words, and after MOST words.
Null and empty texts have one sentence without words, so their score is the bias alone.
Repeated rows are learned from as often as they are sampled, or not at all where one of them is beyond the
sample's size. Without labels of both kinds every score is next to 0, or to 1 if all labels are 1. Empty tables give no rows. Columns of any name do
no harm. A very long text is cut to sentences one after another; what is held of it are its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docmill.llm.common import checkpoint
from docmill.workers import keep_nothing, ship

WEIGHTS = 1 << 20
LEAST, MOST = 8, 64
BEGINNINGS = (3, 4, 5, 6)
#: The classifier is fitted on at most so many rows with label 1 and with label 0: those of each
#: kind whose ids have the smallest hashes. Rows with label 0 are weighted up to their true share.
SAMPLE = (4000, 6000)
#: ... as long as their texts have no more code points than this altogether: in that order, but texts
#: of more than a LONG-th of it come after all others. The first is always taken.
SAMPLE_CHARS = (20_000_000, 30_000_000)
LONG = 20
#: Places that fewer sampled documents have keep the weight 0.
DOCUMENTS = 4
EPOCHS, BATCH, RATE, DECAY = 6, 64, 0.5, 1e-4
PIECE = regex.compile(r"[^.!?\n]+")
WORD = regex.compile(r"\p{L}+")
REMEMBER = 200_000


def word_places(word: str) -> list[int]:
    """Places of the weights that a word adds up; place 0 is the bias."""
    found = [f"{word}_", *(word[:n] for n in BEGINNINGS if n <= len(word))]
    return [xxhash.xxh64_intdigest(x.encode(), 7) % (WEIGHTS - 1) + 1 for x in found]


def lowered(text: str) -> str:
    """text in lower case, with as many code points; a letter that has none of one code point stays."""
    lower = text.lower()
    return lower if len(lower) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def sentences(text: str) -> Iterator[list[str]]:
    """The words of each sentence; one empty sentence if there are none."""
    held: list[str] = []
    none = True
    for piece in PIECE.findall(lowered(text)):
        held += WORD.findall(piece)
        while len(held) >= LEAST:
            yield held[:MOST]
            held, none = held[MOST:], False
            if len(held) < LEAST:
                break
    if held or none:
        yield held


def spans(text: str) -> list[tuple[int, int]]:
    """First and last code point (end excluded) of each sentence in the text."""
    at = [m.span() for m in WORD.finditer(lowered(text))]
    out, i = [], 0
    for sentence in sentences(text):
        out.append((at[i][0], at[i + len(sentence) - 1][1]) if sentence else (0, 0))
        i += len(sentence)
    return out


class Memory(dict):
    """Word -> what make(word) gives; starts afresh when full."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, word: str):
        if len(self) > REMEMBER:
            self.clear()
        self[word] = out = self.make(word)
        return out


class Bags:
    """Documents laid flat: places, and where each sentence and each document begins."""

    def __init__(self, places: np.ndarray, sentences: np.ndarray, docs: np.ndarray):
        self.places, self.sentences, self.docs = places, sentences, docs

    def only(self, keep: np.ndarray) -> Bags:
        """Without the places that keep says no to."""
        stay = keep[self.places]
        up_to = np.cumsum(stay, dtype=np.int32 if len(stay) < 1 << 31 else np.int64)
        ends = self.sentences[1:]
        before = np.zeros(len(self.sentences), np.int64)
        before[1:] = np.where(ends > 0, up_to[np.maximum(ends, 1) - 1], 0) if len(stay) else 0
        return Bags(self.places[stay], before, self.docs)

    def documents_of_places(self) -> np.ndarray:
        n = np.zeros(WEIGHTS, np.int64)
        for i in range(len(self.docs) - 1):
            n[np.unique(self.places[self.sentences[self.docs[i]] : self.sentences[self.docs[i + 1]]])] += 1
        return n

    def take(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """places, the sentence of each place and the document of each sentence, of some documents."""
        parts, sizes, counts = [], [], []
        for i in which:
            edges = self.sentences[self.docs[i] : self.docs[i + 1] + 1]
            parts.append(self.places[edges[0] : edges[-1]])
            sizes.append(np.diff(edges))
            counts.append(len(edges) - 1)
        sizes = np.concatenate(sizes)
        return np.concatenate(parts), np.repeat(np.arange(len(sizes)), sizes), np.repeat(np.arange(len(which)), counts)


def fit(bags: Bags, labels: np.ndarray, clean_weight: float = 1.0, seed: int = 7) -> np.ndarray:
    """Weights (the first is the bias) by adaptive gradient steps on the noisy-or's cross-entropy."""
    weights, moved = np.zeros(WEIGHTS), np.full(WEIGHTS, 1e-8)
    if not 0 < labels.sum() < len(labels):
        weights[0] = 40.0 if len(labels) and labels.all() else -40.0
        return weights
    weights[0] = -6.5
    frequent = bags.documents_of_places() >= DOCUMENTS
    bags = bags.only(frequent)
    share = np.where(labels > 0, 1.0, clean_weight)
    order = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        shuffled = order.permutation(len(labels))
        for at in range(0, len(labels), BATCH):
            which = shuffled[at : at + BATCH]
            places, sentence_of, doc_of = bags.take(which)
            logits = np.bincount(sentence_of, weights[places], len(doc_of)) + weights[0]
            toxic = np.maximum(-np.expm1(np.bincount(doc_of, -np.logaddexp(0, logits), len(which))), 1e-9)
            # d loss / d logit of a sentence is p (1 - y / P), P being the document's noisy-or
            slope = (share[which] * (1 - labels[which] / toxic) / share[which].sum())[doc_of] * 1 / (1 + np.exp(-logits))
            touched, inverse = np.unique(places, return_inverse=True)
            down = np.bincount(inverse, slope[sentence_of], len(touched)) + DECAY * weights[touched]
            moved[touched] += down**2
            weights[touched] -= RATE * down / np.sqrt(moved[touched])
            moved[0] += slope.sum() ** 2
            weights[0] -= 0.1 * RATE * slope.sum() / np.sqrt(moved[0])
    return weights


def sampled(labels: DataFrame, id_col: str = "doc_id", label_col: str = "toxic", sample: tuple[int, int] = SAMPLE) -> tuple[DataFrame, dict[int, int]]:
    """Ids and labels (_id, y) of the rows to learn from, sum(sample) at most, and how many rows there are of each label."""
    y = F.when(F.col(label_col) > 0, 1).otherwise(0).alias("y")
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), y)
    totals = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    kinds = [known.filter(F.col("y") == k).orderBy(F.xxhash64(F.col("_id").cast("string")), "_id").limit(n) for k, n in ((1, sample[0]), (0, sample[1]))]
    return kinds[0].unionByName(kinds[1]), totals


def clean_weight(y: np.ndarray, totals: dict[int, int]) -> float:
    """The weight of a row with label 0 that gives the rows in the sample their kinds' true shares."""
    toxic, clean = ((y == k).sum() / totals.get(k, 1) for k in (1, 0))
    return max(1.0, toxic / clean) if clean else 1.0


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: tuple[int, int] = SAMPLE, sample_chars: tuple[int, int] = SAMPLE_CHARS) -> np.ndarray:
    """Weights from the labelled documents; their words are cut to places on the executors.

    The sampled ids, sum(sample) rows at most, are broadcast to the documents, so no text is
    shuffled. What the driver gets, places, is bounded by sample_chars (code points of the texts
    with label 1 and with label 0).
    """
    ship(docs.sparkSession)

    def cut(batches):
        keep_nothing()
        memory = Memory(word_places)
        for whole in batches:
            for at in range(0, whole.num_rows, 50):
                batch = whole.slice(at, 50)
                docs = [[[p for w in dict.fromkeys(s) for p in memory[w]] for s in sentences(t or "")] for t in batch.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.list_(pa.list_(pa.int32()))), batch.column(1)], names=["doc", "y"])

    ids, totals = sampled(labels, id_col, label_col, sample)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    known = texts.join(F.broadcast(ids.toDF("known", "y")), F.col("id") == F.col("known")).select("id", "body", "y", F.char_length("body").cast("long").alias("n"))
    rows = checkpoint(known)
    # at most sum(sample) labelled ids, so the window is over few rows; sizes come first, texts stay where they are
    most = F.when(F.col("y") == 1, F.lit(sample_chars[0])).otherwise(F.lit(sample_chars[1]))
    order = Window.partitionBy("y").orderBy(F.col("n") * LONG > most, F.xxhash64(F.col("id").cast("string")), "id", "n").rowsBetween(Window.unboundedPreceding, 0)
    so_far = F.sum("n").over(order)
    beyond = rows.select("id", "y", F.when(so_far > most, so_far > F.col("n")).alias("beyond")).filter("beyond").select("id").distinct()
    inside = rows.join(F.broadcast(beyond), "id", "left_anti").select("body", "y")
    got = inside.mapInArrow(cut, "doc array<array<int>>, y int").toArrow()
    if not got.num_rows:
        return fit(Bags(np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64)), np.zeros(0))
    y = got.column("y").to_numpy().astype(float)
    listed = pa.concat_arrays(got.column("doc").chunks)
    del got
    flat = listed.flatten()
    bags = [Bags(flat.flatten().to_numpy(), flat.offsets.to_numpy() - flat.offsets[0].as_py(), listed.offsets.to_numpy() - listed.offsets[0].as_py())]
    del listed, flat
    return fit(bags.pop(), y, clean_weight(y, totals))  # fit drops what it got for less


def score(df: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text", keep: list[str] = (), rows: int = 500) -> DataFrame:
    """id_col, the columns in keep, score double, and worst: the likeliest sentence of a document that scores 0.5 or more."""
    ship(df.sparkSession)
    used = np.flatnonzero(weights)
    shared = df.sparkSession.sparkContext.broadcast((used.astype(np.int32), weights[used].astype(np.float32)))
    held = [id_col, *keep]
    inner = [f"c{i}" for i in range(len(held))]

    def run(batches):
        keep_nothing()
        full = np.zeros(WEIGHTS, np.float32)
        full[shared.value[0]] = shared.value[1]
        bias = float(full[0])
        memory = Memory(lambda word: float(full[word_places(word)].sum()))
        weigh = memory.__getitem__
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                scores, worst = [], []
                for text in batch.column(len(held)).to_pylist():
                    logits = np.array([sum(map(weigh, set(s))) for s in sentences(text or "")]) + bias
                    scores.append(float(np.clip(-np.expm1(-np.logaddexp(0, logits).sum()), 0, 1)))
                    if scores[-1] < 0.5:
                        worst.append(None)
                        continue
                    most = int(np.argmax(logits))
                    start, end = spans(text or "")[most]
                    worst.append({"start": start, "end": end, "p": float(1 / (1 + np.exp(-logits[most])))})
                kind = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())])
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(held)], pa.array(scores, pa.float64()), pa.array(worst, kind)], names=[*inner, "score", "worst"])

    kinds = ", ".join(f"{i} {df.schema[c].dataType.simpleString()}" for i, c in zip(inner, held))
    read = [*[F.col(c).alias(i) for i, c in zip(inner, held)], F.col(text_col).alias("body")]
    scored = df.select(*read).mapInArrow(run, f"{kinds}, score double, worst struct<start:int,end:int,p:double>")
    return scored.toDF(*held, "score", "worst")


def score_held_out(docs: DataFrame, labels: DataFrame, fold, keep: list[str] = ()) -> DataFrame:
    """Learn from labelled documents outside fold 0, then score every document."""
    weights = learn(docs, labels.filter(fold != 0))
    return score(docs, weights, keep=keep)
