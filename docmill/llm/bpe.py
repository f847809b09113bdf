"""Byte-level BPE by a tokenization automaton, for encoding, decoding and counting.

The merges are compiled, one after another, into an automaton whose arcs are labelled with tokens
and whose states are "the token just read". It starts with the 256 byte tokens, every arc allowed.
The gadget of merge (a, b) -> c at time t adds state c, whose incoming arcs are those that a has at
t and whose outgoing arcs are those that b has at t, and then cuts the arc b leaving state a. A path
through the finished automaton is a token sequence that BPE itself would produce, and each byte
string has exactly one such path.

That automaton reads tokens. It is made deterministic over bytes by the subset construction: a
state is the set of (token just read, part of the next label read so far) that the bytes allow,
and says which token, if any, ends there. The driver compiles the states that the vocabulary's own
strings lead through into a transition table and broadcasts it; a worker walks the table byte by
byte, and adds the states that other strings need by the same construction when it meets them.
The tokens are read off backwards from the last state, each saying where the one before it ends.

Nulls count as the empty text; empty texts have no tokens. Rows are handled one by one, so
repeated rows and ties need no rule, and a hot key or a very long text costs no more than its
own bytes. Only the two named columns are read, so other columns of any name do no harm.
"""

from __future__ import annotations

import heapq
import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.workers import keep, ship

#: The pre-token pattern and byte alphabet of public byte-level BPE vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NEVER = 1 << 60
#: Bits of a node of the label trie in a pair.
NODES = 32
LOW = (1 << NODES) - 1
#: Most pre-tokens (or arcs) that a worker remembers; when full, the memory starts afresh.
REMEMBER = 100_000
#: Most states that a worker adds to the compiled ones (about 300 bytes each); when full, it goes back to those.
STATES = 250_000


def byte_alphabet() -> dict[str, int]:
    """Printable stand-in -> byte: printable Latin-1 bytes stand for themselves, others follow 255."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merges and added tokens of a byte-level BPE vocabulary file (.json)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, alphabet = spec["model"], byte_alphabet()
        to_bytes = lambda token: bytes(alphabet[c] for c in token)
        self.pieces = {i: to_bytes(s) for s, i in model["vocab"].items()}
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.pieces.update({i: s.encode() for s, i in self.special.items()})
        vocab = model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        self.bytes = [vocab[c] for c, _ in sorted(alphabet.items(), key=lambda x: x[1])]
        if len({c for _, _, c in self.merges}) != len(self.merges):
            raise ValueError("a token that two merges produce has no single gadget")


class Splitter:
    """Cuts a text at added tokens and the rest into pre-tokens."""

    def __init__(self, special: dict[str, int]):
        self.special = special
        self.find = regex.compile(PATTERN).findall
        longest_first = sorted(special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")").split if special else None

    def parts(self, text: str) -> list[str]:
        """Pre-tokens in order; an added token is a part of its own."""
        if self.cut is None or not any(s in text for s in self.special):
            return self.find(text)
        out: list[str] = []
        for i, piece in enumerate(self.cut(text)):
            if i % 2:
                out.append(piece)
            else:
                out.extend(self.find(piece))
        return out


class Gadgets:
    """The automaton over tokens: each state's two parents and birth, and when arcs were cut."""

    def __init__(self, vocabulary: Vocabulary):
        self.birth = {t: 0 for t in vocabulary.bytes}
        self.into: dict[int, int] = {}  # the state whose incoming arcs a gadget took over
        self.out_of: dict[int, int] = {}  # the state whose outgoing arcs a gadget took over
        self.cut: dict[tuple[int, int], int] = {}  # arc -> time of the merge that cut it
        self.arcs: dict[tuple[int, int], int] = {}
        for time, (a, b, c) in enumerate(vocabulary.merges, 1):
            self.gadget(a, b, c, time)
        self.arcs.clear()

    def gadget(self, a: int, b: int, c: int, time: int) -> None:
        if a not in self.birth or b not in self.birth or self.ends(a, b) == 0:
            return  # no path holds a then b any more: the merge never happens
        self.birth[c], self.into[c], self.out_of[c] = time, a, b
        self.cut[a, b] = self.arcs[a, b] = time

    def ends(self, x: int, y: int) -> int:
        """When the arc y leaving state x ends: 0 if it never was, NEVER if it stays."""
        known = self.arcs.get((x, y))
        if known is not None:
            return known
        bx, by = self.birth[x], self.birth[y]
        if bx < by:
            there = self.ends(x, self.into[y]) > by
        elif bx > by or x == y and bx:
            there = self.ends(self.out_of[x], self.into[y] if x == y else y) >= bx
        else:
            there = True
        end = self.cut.get((x, y), NEVER) if there else 0
        if len(self.arcs) > REMEMBER:
            self.arcs.clear()
        self.arcs[x, y] = end
        return end


class Automaton:
    """The automaton over bytes, as a transition table: state and byte to state, and the token that ends in a state."""

    def __init__(self, vocabulary: Vocabulary):
        self.gadgets, self.sizes = Gadgets(vocabulary), {t: len(p) for t, p in vocabulary.pieces.items()}
        self.step: dict[int, int] = {}  # (node << 8 | byte) -> node of the trie of labels
        spelled: dict[int, int] = {}
        for token in self.gadgets.birth:
            node = 0
            for byte in vocabulary.pieces[token]:
                node = self.step.setdefault(node << 8 | byte, len(self.step) + 1)
            spelled[node] = token
        self.label = [spelled.get(n, -1) for n in range(len(self.step) + 1)]  # the token that a node spells
        self.inner = bytearray(len(self.step) + 1)  # 1 if a label goes on after the node
        for way in self.step:
            self.inner[way >> 8] = 1
        # a state is a set of pairs (token just read, node), each one number: the node, and above it the
        # token + 1, 0 at the start. Nodes that no label goes on from are left out, as no byte leads out of
        # them. The pairs of compiled states lie in one array.
        self.added: list[bytes] = [array("q", [0]).tobytes()]
        self.token, self.table = [-1], {}  # table: (state << 8 | byte) -> state
        self.number: dict[bytes, int] = {}
        self.compiled, self.pairs, self.edges = 0, np.zeros(0, np.int64), np.zeros(1, np.int64)
        for token in self.gadgets.birth:
            state = 0
            for byte in vocabulary.pieces[token]:
                state = self.follow(state, byte)
        self.gadgets.arcs.clear()
        self.compiled = len(self.token)
        self.edges = np.concatenate([[0], np.cumsum([len(x) // 8 for x in self.added])])
        self.pairs = np.frombuffer(b"".join(self.added), np.int64)
        self.added, self.number = [], {}

    def set_of(self, state: int) -> list[int]:
        if state < self.compiled:
            return self.pairs[self.edges[state] : self.edges[state + 1]].tolist()
        return memoryview(self.added[state - self.compiled]).cast("q").tolist()

    def follow(self, state: int, byte: int) -> int:
        """The state after a byte, made by the subset construction if it is not in the table yet."""
        known = self.table.get(state << 8 | byte)
        if known is not None:
            return known
        pairs, ended = [], -1
        step, label, inner = self.step.get, self.label, self.inner
        for pair in self.set_of(state):
            at = pair & LOW
            node = step(at << 8 | byte)
            if node is None:
                continue
            if ended < 0 and label[node] >= 0:  # of the paths to this byte only one is whole
                read = (pair >> NODES) - 1
                if read < 0 or self.gadgets.ends(read, label[node]) == NEVER:
                    ended = label[node]
            if inner[node]:
                pairs.append(pair - at + node)
        if ended >= 0:
            pairs.append((ended + 1) << NODES)
        found = array("q", pairs).tobytes()
        number = self.number.get(found)
        if number is None:
            number = self.number[found] = len(self.token)
            self.added.append(found)
            self.token.append(ended)
        self.table[state << 8 | byte] = number
        return number

    def forget(self) -> None:
        """Back to the compiled states."""
        n = self.compiled
        self.added, self.number = [], {}
        del self.token[n:]
        self.table = {k: v for k, v in self.table.items() if k >> 8 < n and v < n}

    def encode(self, word: bytes) -> list[int]:
        """Token ids of one pre-token: the walk of its bytes, then the tokens from the last one back."""
        if len(self.added) > STATES:
            self.forget()
        state, ended = 0, []
        get, token, follow = self.table.get, self.token, self.follow
        for byte in word:
            onward = get(state << 8 | byte)
            state = follow(state, byte) if onward is None else onward
            ended.append(token[state])
        ids, n, sizes = [], len(ended), self.sizes
        while n:
            ids.append(t := ended[n - 1])
            n -= sizes[t]
        return ids[::-1]


def merge(word: bytes, start: list[int], ranks: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Token ids of one pre-token by applying the merges themselves, lowest rank and leftmost first."""
    ids: list[int] = [start[b] for b in word]
    after, before = [*range(1, len(ids)), -1], [*range(-1, len(ids) - 1)]
    heap = [(ranks[p][0], i, p) for i in range(len(ids) - 1) if (p := (ids[i], ids[i + 1])) in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, pair = heapq.heappop(heap)
        j = after[i]
        if ids[i] != pair[0] or j < 0 or ids[j] != pair[1]:
            continue
        ids[i], ids[j] = ranks[pair][1], -1
        after[i] = k = after[j]
        if k >= 0:
            before[k] = i
            if (p := (ids[i], ids[k])) in ranks:
                heapq.heappush(heap, (ranks[p][0], i, p))
        if (h := before[i]) >= 0 and (p := (ids[h], ids[i])) in ranks:
            heapq.heappush(heap, (ranks[p][0], h, p))
    return [t for t in ids if t >= 0]


class Encoder(dict):
    """Pre-token -> its ids (int32, as bytes), filled as pre-tokens are met.

    When full, it starts afresh but looks up what it had: pre-tokens in use come back from there.
    """

    def __init__(self, automaton: Automaton, special: dict[str, int]):
        super().__init__()
        self.automaton, self.special, self.before = automaton, special, {}
        self.parts = Splitter(special).parts

    def __missing__(self, part: str) -> bytes:
        if len(self) > REMEMBER:
            self.before = dict(self)
            self.clear()
        ids = self.before.get(part)
        if ids is None:
            ids = array("i", [self.special[part]] if part in self.special else self.automaton.encode(part.encode())).tobytes()
        if len(part) < 100:
            self[part] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, self.parts(text))), np.int32)


def decode(ids: list[int], pieces: dict[int, bytes]) -> str:
    """The arcs' labels, one after another; bytes that are no UTF-8 become U+FFFD."""
    return b"".join(map(pieces.__getitem__, ids)).decode("utf-8", "replace")


class Counter(dict):
    """Pre-token -> number of tokens; whole tokens are there from the start, the rest is merged."""

    def __init__(self, vocabulary: Vocabulary, whole: frozenset[str]):
        super().__init__(dict.fromkeys(whole, 1))
        self.whole, self.start = whole, vocabulary.bytes
        self.ranks = ranks(vocabulary)
        self.parts = Splitter(vocabulary.special).parts

    def __missing__(self, part: str) -> int:
        if len(self) > len(self.whole) + REMEMBER:
            self.clear()
            self.update(dict.fromkeys(self.whole, 1))
        n = len(merge(part.encode(), self.start, self.ranks))
        if len(part) < 100:
            self[part] = n
        return n

    def count(self, text: str) -> int:
        return sum(map(self.__getitem__, self.parts(text)))


def ranks(vocabulary: Vocabulary) -> dict[tuple[int, int], tuple[int, int]]:
    return {(a, b): (i, c) for i, (a, b, c) in enumerate(vocabulary.merges)}


def whole_tokens(vocabulary: Vocabulary) -> frozenset[str]:
    """Vocabulary strings proved to be one pre-token that the merges turn into one token."""
    find, table = regex.compile(PATTERN).findall, ranks(vocabulary)
    out = set(vocabulary.special)
    for token, piece in vocabulary.pieces.items():
        try:
            s = piece.decode()
        except UnicodeDecodeError:
            continue
        if find(s) == [s] and merge(piece, vocabulary.bytes, table) == [token]:
            out.add(s)
    return frozenset(out)


def _kept(kind: str, make, shared):
    """What a worker's tasks share, by kind and vocabulary."""
    return keep((kind, shared.value[0]), lambda: make(*shared.value[1:]))


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [t or "" for t in batch.column(1).to_pylist()]


def _slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _schema(df: DataFrame, id_col: str, more: str) -> str:
    return f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, {more}"


def encode_texts(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", rows: int = 100) -> DataFrame:
    """Encode every whole text by the automaton and decode the ids by their arc labels.

    vocabulary: path of the file, read by the driver only; the driver compiles the automaton and
    broadcasts it (its size is the vocabulary's). Returns id_col, n_tokens long, ids array<int>,
    decoded string. Null texts count as empty: no ids, decoded ''.
    """
    spec = Vocabulary(vocabulary)
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast((hash(tuple(spec.merges)), Automaton(spec), spec.special, spec.pieces))

    def run(batches):
        encoder = _kept("encode", lambda automaton, special, _: Encoder(automaton, special), shared)
        pieces = shared.value[3]
        for batch in _slices(batches, rows):
            ids = [encoder.encode(t) for t in _texts(batch)]
            edges = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            flat = pa.array(np.concatenate(ids))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(map(len, ids), pa.int64()),
                    pa.ListArray.from_arrays(pa.array(edges), flat),
                    pa.array([decode(x.tolist(), pieces) for x in ids], pa.string()),
                ],
                names=[id_col, "n_tokens", "ids", "decoded"],
            )

    out = _schema(df, id_col, "n_tokens bigint, ids array<int>, decoded string")
    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, out)


def count_tokens(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", rows: int = 2000) -> DataFrame:
    """Count the tokens of every whole text: id_col, n_bytes long (UTF-8), n_tokens long.

    Which vocabulary strings are whole tokens is proved once, on the driver; they and the
    merges are sent to the workers (their size is the vocabulary's). Null texts count as empty.
    """
    spec = Vocabulary(vocabulary)
    shared = df.sparkSession.sparkContext.broadcast((hash(tuple(spec.merges)), spec, whole_tokens(spec)))
    ship(df.sparkSession)

    def run(batches):
        counter = _kept("count", Counter, shared)
        for batch in _slices(batches, rows):
            texts = _texts(batch)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(t.encode()) for t in texts], pa.int64()),
                    pa.array(map(counter.count, texts), pa.int64()),
                ],
                names=[id_col, "n_bytes", "n_tokens"],
            )

    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, _schema(df, id_col, "n_bytes bigint, n_tokens bigint"))
