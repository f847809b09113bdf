"""Removal of repeated passages by suffix arrays over shards of the corpus.

A byte goes if it is covered by a string of LENGTH bytes that also starts in a document with a
smaller id. Every window of LENGTH bytes is told by its content to one shard: the smallest hash
of the window's K-byte strings. Neighbouring windows with the same smallest hash stay together
as one piece (about 18 windows), so equal windows of any two documents meet in the same shard
and the pieces hold each byte about four times. Shards are dealt by that hash, and their number
grows with the bytes of the corpus.

Texts lie in packs of a few megabytes. A pack first asks the shards which of its pieces' codes
other packs have, and sends only those pieces, each different one once, with the smallest and the
largest id that it has there. So a passage that a third of all documents have reaches its shard
once for each pack.

In a shard, pieces whose hash occurs in one document only are put aside. Over the others, equal
ones merged, suffix arrays of ARRAY bytes are built by Larsson-Sadakane refinement: suffixes are
sorted by eight bytes, then groups that are still tied are sorted by the rank of the suffix 8, 16,
32 ... bytes further on, until none is tied. Common prefixes of neighbours follow by Kasai's
recurrence, which walks all pieces side by side, and cut the array into groups of equal windows.
The arrays' sorted windows are then merged by binary search, and every window gets the smallest id
that any array has for it. Packs get these ids back for the windows of each piece that they sent,
and cut the windows of every document whose own id is larger.

Only texts (once), codes, compressed pieces that documents share, and window ids are shuffled.
Null texts count as empty; an empty or short text has no windows and stays whole. Rows that repeat
an id never take bytes from each other, whatever their texts. A null id ranks with the largest
possible one, after all others. Ids must be integers. Empty tables give empty results, and other
columns may have any name. A very long text is cut into pieces SLICE bytes at a time; the task of
its pack holds the text itself, what is left of it, and the answers for it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.workers import keep_nothing, ship

LENGTH, K = 50, 16
#: Longest piece, in windows; longer runs (texts with a period) are cut.
RUN = 512
#: Bytes of text cut into pieces at a time, of text in a pack and for each shard, and of one suffix array.
SLICE, PACK, SHARD, ARRAY = 8_000_000, 6_000_000, 3_000_000, 2_000_000
LAST = (1 << 63) - 1
PAD = 64


def _words(data: np.ndarray, order: str = "<") -> np.ndarray:
    """The eight bytes from every place on, as one number."""
    return np.ndarray((len(data) - 7,), f"{order}u8", data, 0, (1,))


def _hashes(data: np.ndarray, n: int) -> np.ndarray:
    """A hash of the K = 16 bytes from each of the first n places on."""
    words = _words(data)
    h = words[:n] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h += words[8 : n + 8]
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each width neighbours."""
    size = 1
    while 2 * size <= width:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return np.minimum(h[: len(h) - (width - size)], h[width - size :]) if size < width else h


def pieces(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """data, and of each piece: where it starts in data, its number of windows, and its hash.

    data is all texts, one after another; a piece lies within one text and has LENGTH - 1 bytes
    more than windows.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(texts) + bytes(PAD), np.uint8)
    n = int(ends[-1]) - LENGTH + 1 if len(ends) else 0
    if n <= 0:
        return data, *(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64))
    least = _least(_hashes(data, n + LENGTH - K), LENGTH - K + 1)
    # starts and stops of the ranges of windows that lie within one text
    ok = sizes >= LENGTH
    first, stop = (ends - sizes)[ok], (ends - LENGTH + 1)[ok]
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(least[1:], least[:-1], out=new[1:])
    new[first] = True
    edge = stop[stop < n]
    new[edge] = True
    start = np.flatnonzero(new)
    windows = np.diff(np.append(start, n))
    which = np.searchsorted(first, start, side="right") - 1
    inside = (which >= 0) & (start < stop[which])
    start, windows = start[inside], windows[inside]
    if windows.max(initial=0) > RUN:
        parts = -(-windows // RUN)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        windows = np.minimum(np.repeat(windows, parts) - nth * RUN, RUN)
        start = np.repeat(start, parts) + nth * RUN
    return data, start, windows, least[start]


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Places of data in the order of their suffixes, by Larsson-Sadakane refinement."""
    n = len(data)
    words = _words(np.concatenate([data, np.zeros(8, np.uint8)]), ">")[:n].astype(np.uint64)
    order = np.argsort(words, kind="stable")
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    tied = words[order]
    new = np.concatenate([[True], tied[1:] != tied[:-1]])
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    h = 8
    while True:
        ends = np.append(new[1:], True)
        slots = np.flatnonzero(~(new & ends))  # of groups with more than one suffix
        if not len(slots):
            break
        members = order[slots]
        # beyond the end, the shorter suffix comes first
        onward = np.where(members + h < n, rank[np.minimum(members + h, n)], n - members - h - 1)
        key = (rank[members] << 32) | (onward + (1 << 31))
        by = np.argsort(key, kind="stable")
        key, members = key[by], members[by]
        order[slots] = members
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        new[slots] = fresh
        rank[members] = np.maximum.accumulate(np.where(fresh, slots, 0))
        h *= 2
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray, starts: np.ndarray, sizes: np.ndarray, most: int = LENGTH) -> np.ndarray:
    """For each suffix in order, bytes in common with the one before it, `most` at most (0 for the first).

    Kasai's recurrence: of the prefix that a suffix shares with the one before it in order, the next
    suffix of the text shares all but the first byte with the one before it there. It is followed
    from the start of each piece (starts, sizes) on, for all pieces at once; they must cover data.
    """
    before = np.full(len(data), -1, np.int64)
    before[order[1:]] = order[:-1]
    common = np.zeros(len(data), np.int64)
    longest = np.argsort(-sizes, kind="stable")
    starts, left = starts[longest], -sizes[longest]
    held = np.zeros(len(starts), np.int64)
    for step in range(int(sizes.max(initial=0))):
        n = int(np.searchsorted(left, -step, side="left"))  # pieces of more than `step` bytes
        i = starts[:n] + step
        j = before[i]
        h = np.where(j < 0, 0, np.maximum(held[:n] - 1, 0))
        limit = np.minimum(len(data) - np.maximum(i, j), most)
        open_ = np.flatnonzero((j >= 0) & (h < limit))
        while len(open_):
            open_ = open_[data[i[open_] + h[open_]] == data[j[open_] + h[open_]]]
            h[open_] += 1
            open_ = open_[h[open_] < limit[open_]]
        common[i] = held[:n] = h
    return common[order]


class Array:
    """A suffix array over pieces: their windows in order, cut into groups of equal ones."""

    def __init__(self, data: np.ndarray, windows: np.ndarray, ids: np.ndarray):
        """data: pieces, one after another; windows: of each piece; ids: the smallest id of each piece's documents."""
        sizes = windows + LENGTH - 1
        at = np.cumsum(sizes) - sizes
        places = np.repeat(at - (np.cumsum(windows) - windows), windows) + np.arange(windows.sum())
        number = np.full(len(data), -1, np.int64)
        number[places] = np.arange(len(places))
        order = suffix_array(data)
        common = common_prefixes(data, order, at, sizes)
        is_window = np.flatnonzero(number[order] >= 0)
        # suffixes that are no windows lie between: windows share what all steps between them share
        shared = np.minimum.reduceat(common[: is_window[-1] + 1], np.concatenate([[0], is_window[:-1] + 1])) if len(is_window) else common[:0]
        order = order[is_window]
        new = shared < LENGTH
        new[:1] = True
        self.first = np.flatnonzero(new)
        self.window = number[order]
        self.ids = np.minimum.reduceat(np.repeat(ids, windows)[self.window], self.first)
        self.data, self.order = data, order

    def strings(self) -> np.ndarray:
        """The different windows, in order; bytes of one length compare as they are."""
        at = self.order[self.first]
        return np.ascontiguousarray(self.data[at[:, None] + np.arange(LENGTH)]).view(f"S{LENGTH}").ravel()

    def by_window(self) -> np.ndarray:
        """The smallest id of each window, windows as they lie in the pieces."""
        out = np.empty(len(self.window), np.int64)
        out[self.window] = np.repeat(self.ids, np.diff(np.append(self.first, len(self.window))))
        return out


def _lookup(strings: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each asked string is among the sorted strings, and whether it is there."""
    at = np.searchsorted(strings, asked)
    inside = np.minimum(at, max(len(strings) - 1, 0))
    return at, strings[inside] == asked if len(strings) else np.zeros(len(asked), bool)


def merge(arrays: list[Array]) -> None:
    """Give each array's groups the smallest id of all arrays.

    The sorted windows are merged one array after another, by binary search of its windows among
    those so far; at the end each array's windows are looked up in the whole.
    """
    strings = [a.strings() for a in arrays]
    every, least = strings[0], arrays[0].ids.copy()
    for own, a in zip(strings[1:], arrays[1:]):
        at, known = _lookup(every, own)
        least[at[known]] = np.minimum(least[at[known]], a.ids[known])
        every, least = np.insert(every, at[~known], own[~known]), np.insert(least, at[~known], a.ids[~known])
    for own, a in zip(strings, arrays):
        a.ids = least[_lookup(every, own)[0]]


def smallest_ids(contexts: list[bytes], windows: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For every window of every context, the smallest id of any context that has it."""
    arrays, lo = [], 0
    sizes = np.array([len(c) for c in contexts])
    while lo < len(contexts):
        hi = max(lo + 1, lo + int(np.searchsorted(np.cumsum(sizes[lo:]), ARRAY, side="right")))
        data = np.frombuffer(b"".join(contexts[lo:hi]), np.uint8)
        arrays.append(Array(data, windows[lo:hi], ids[lo:hi]))
        lo = hi
    if len(arrays) > 1:
        merge(arrays)
    return np.concatenate([a.by_window() for a in arrays]) if arrays else np.zeros(0, np.int64)


def shard_runs(key: np.ndarray, ids: np.ndarray, most: np.ndarray, windows: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows of pieces that have a smaller id somewhere: which piece, first window, end, smallest id.

    Pieces as they lie in data, each with the smallest and the largest id that it stands for.
    """
    size = windows + LENGTH - 1
    at = np.cumsum(size) - size
    order = np.argsort(key, kind="stable")
    none = np.zeros(0, np.int64)
    if not len(order):
        return none, none, none, none
    first = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
    shared = np.minimum.reduceat(ids[order], first) < np.maximum.reduceat(most[order], first)
    chosen = order[np.repeat(shared, np.diff(np.append(first, len(order))))]  # by key
    if not len(chosen):
        return none, none, none, none
    raw = data.tobytes()
    number: dict[bytes, int] = {}
    found = np.fromiter((number.setdefault(raw[a : a + z], len(number)) for a, z in zip(at[chosen].tolist(), size[chosen].tolist())), np.int64, len(chosen))
    contexts = list(number)
    least = np.full(len(contexts), LAST, np.int64)
    np.minimum.at(least, found, ids[chosen])
    count = np.array([len(c) for c in contexts]) - LENGTH + 1
    smallest = smallest_ids(contexts, count, least)
    # runs of windows of one context with one smallest id
    begin = np.cumsum(count) - count
    new = np.concatenate([[True], smallest[1:] != smallest[:-1]])
    new[begin] = True
    lo = np.flatnonzero(new)
    hi, of = np.append(lo[1:], len(smallest)), np.searchsorted(begin, lo, side="right") - 1
    per = np.bincount(of, minlength=len(contexts))
    run_at = np.cumsum(per) - per
    n = per[found]
    piece = np.repeat(np.arange(len(chosen)), n)
    run = np.repeat(run_at[found] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    told = smallest[lo[run]] < most[chosen[piece]]
    piece, run = piece[told], run[told]
    return chosen[piece], lo[run] - begin[of[run]], hi[run] - begin[of[run]], smallest[lo[run]]


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of one length, then their bytes: every piece's record fields and text."""
    head = np.array([len(columns[0]), len(columns[-1])], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(np.ascontiguousarray(c).tobytes() for c in columns))


#: Of a piece: hash, smallest and largest id, mark and offset of the row that has the smallest, windows.
KINDS = (np.uint64, np.int64, np.int64, np.int64, np.int64, np.int16)


def _unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, size = np.frombuffer(raw, np.int64, 2)
    out, at = [], 16
    for kind in KINDS:
        out.append(np.frombuffer(raw, kind, n, at))
        at += out[-1].nbytes
    return [*out, np.frombuffer(raw, np.uint8, size, at)]


def _pack_codes(codes: np.ndarray) -> bytes:
    """Ascending 32-bit numbers, as the bytes of their steps, each place of the steps' bytes by itself."""
    steps = np.diff(codes.astype(np.uint32), prepend=np.uint32(0))
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 4).T).tobytes())


def _unpack_codes(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    steps = np.ascontiguousarray(raw.reshape(4, -1).T).view(np.uint32).ravel()
    return np.cumsum(steps, dtype=np.uint32)


def _edges(ordered: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    return np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1], [True]])) if len(ordered) else np.zeros(1, np.int64)


class Slice:
    """Pieces of some texts of a pack: row, offset in the row's text, windows, hash, and code (shard, then 32 bits)."""

    def __init__(self, parts: list[tuple[int, int, bytes]], shards: int):
        self.data, self.start, self.windows, self.key = pieces([t for *_, t in parts])
        sizes = np.array([len(t) for *_, t in parts], np.int64)
        which = np.searchsorted(np.cumsum(sizes), self.start, side="right")
        self.row = np.array([r for r, *_ in parts], np.int64)[which]
        self.offset = self.start - (np.cumsum(sizes) - sizes)[which] + np.array([o for _, o, _ in parts], np.int64)[which]
        self.shard = (self.key >> np.uint64(8)) % np.uint64(shards)
        self.code = (self.shard << np.uint64(32)) | (self.key & np.uint64(0xFFFFFFFF))


def _slices(texts: list[bytes]) -> Iterator[list[tuple[int, int, bytes]]]:
    """(row, offset, bytes) in lists of SLICE bytes or so; a longer text is cut so that each window is in one part."""
    held, size = [], 0
    for row, text in enumerate(texts):
        for at in range(0, max(1, len(text) - LENGTH + 1), SLICE):
            part = text[at : at + SLICE + LENGTH - 1]
            if len(part) < LENGTH:
                continue
            held.append((row, at, part))
            size += len(part)
            if size >= SLICE:
                yield held
                held, size = [], 0
    if held:
        yield held


def _table(**columns: pa.Array) -> pa.Table:
    return pa.table(columns)


def pack_keys(pack: int, texts: list[bytes], shards: int) -> pa.Table:
    """What a pack asks of each shard: its different codes."""
    codes = [np.unique(Slice(parts, shards).code) for parts in _slices(texts)]
    every = np.unique(np.concatenate(codes)) if codes else np.zeros(0, np.uint64)
    shard = every >> np.uint64(32)
    edges = _edges(shard)
    blobs = [_pack_codes(every[a:b] & np.uint64(0xFFFFFFFF)) for a, b in zip(edges[:-1], edges[1:])]
    return _table(shard=pa.array(shard[edges[:-1]].astype(np.int32), pa.int32()), _pack=pa.array([pack] * len(blobs), pa.int32()), blob=pa.array(blobs, pa.binary()))


def shared_keys(shard: int, packs: list[int], blobs: list[bytes]) -> pa.Table:
    """A shard's answer to each pack: those of its codes that another pack has too."""
    codes = [_unpack_codes(b) for b in blobs]
    every = np.concatenate(codes)
    ordered = np.sort(every)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    out = [(p, c) for p, own in zip(packs, codes) if len(c := own[np.isin(own, twice, assume_unique=True)])]
    return _table(_pack=pa.array([p for p, _ in out], pa.int32()), shard=pa.array([shard] * len(out), pa.int32()), blob=pa.array([_pack_codes(c) for _, c in out], pa.binary()))


def pack_pieces(pack: int, rows: list[tuple[int, int, bytes]], shards: int, answers: list[tuple[int, bytes]]) -> pa.Table:
    """A pack's different pieces whose code more than one document has, for each shard. rows: id, mark, text."""
    asked = [(np.uint64(s) << np.uint64(32)) | _unpack_codes(b).astype(np.uint64) for s, b in answers]
    texts, ids, marks = [r[2] for r in rows], np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
    lists = list(_slices(texts))
    first = Slice(lists[0], shards) if len(lists) == 1 else None
    seen = [np.stack([x.code, x.row.astype(np.uint64)]) for x in ([first] if first else (Slice(parts, shards) for parts in lists))]
    wanted = asked
    if seen:
        both = np.concatenate(seen, axis=1)
        order = np.lexsort((both[1], both[0]))
        code, row = both[0][order], both[1][order]
        wanted = [*asked, np.unique(code[1:][(code[1:] == code[:-1]) & (row[1:] != row[:-1])])]
    wanted = np.unique(np.concatenate(wanted)) if wanted else np.zeros(0, np.uint64)
    number: dict[bytes, int] = {}
    fields: list[list[int]] = [[], [], [], [], [], []]  # shard, hash, smallest id, largest id, row, offset
    for parts in lists:
        x = first or Slice(parts, shards)
        kept = np.flatnonzero(np.isin(x.code, wanted))
        raw, size = x.data.data, x.windows[kept] + LENGTH - 1
        columns = (x.start[kept], size, x.shard[kept], x.key[kept], ids[x.row[kept]], x.row[kept], x.offset[kept])
        for a, z, shard, key, own, row, offset in zip(*(c.tolist() for c in columns)):
            n = number.setdefault(bytes(raw[a : a + z]), len(number))
            if n == len(fields[0]):
                for field, value in zip(fields, (shard, key, own, own, row, offset)):
                    field.append(value)
                continue
            if own < fields[2][n]:
                fields[2][n], fields[4][n], fields[5][n] = own, row, offset
            fields[3][n] = max(fields[3][n], own)
    bodies, out = list(number), []
    shard, key = np.array(fields[0], np.int64), np.array(fields[1], np.uint64)
    order = np.lexsort((key, shard))
    least, most, row, offset = (np.array(f, np.int64) for f in fields[2:])
    edges = _edges(shard[order])
    for a, b in zip(edges[:-1], edges[1:]):
        o = order[a:b]
        body = b"".join(bodies[i] for i in o.tolist())
        windows = np.array([len(bodies[i]) - LENGTH + 1 for i in o.tolist()], np.int16)
        out.append((int(shard[o[0]]), _pack(key[o], least[o], most[o], marks[row[o]], offset[o], windows, np.frombuffer(body, np.uint8))))
    return _table(shard=pa.array([s for s, _ in out], pa.int32()), _pack=pa.array([pack] * len(out), pa.int32()), blob=pa.array([b for _, b in out], pa.binary()))


def pack_runs(packs: list[int], blobs: list[bytes]) -> pa.Table:
    """A shard's answer to each pack: pieces (hash, id, mark, offset, windows) and the runs of each."""
    parts = [_unpack(b) for b in blobs]
    key, ids, most, marks, offset, windows, data = (np.concatenate([p[i] for p in parts]) for i in range(7))
    of = np.repeat(np.array(packs, np.int32), [len(p[0]) for p in parts])
    piece, lo, hi, least = shard_runs(key, ids, most, windows.astype(np.int64), data)
    order = np.lexsort((piece, of[piece]))
    piece, lo, hi, least = piece[order], lo[order], hi[order], least[order]
    edges = _edges(of[piece])
    out = []
    for a, b in zip(edges[:-1], edges[1:]):
        runs = piece[a:b]
        own = runs[_edges(runs)[:-1]]
        columns = (key[own].view(np.int64), ids[own], marks[own], offset[own], windows[own].astype(np.int64), np.diff(_edges(runs)), lo[a:b], hi[a:b], least[a:b])
        raw = np.array([len(own)], np.int64).tobytes() + b"".join(np.ascontiguousarray(c, np.int64).tobytes() for c in columns)
        out.append((int(of[runs[0]]), zstandard.ZstdCompressor(level=3).compress(raw)))
    return _table(_pack=pa.array([p for p, _ in out], pa.int32()), runs=pa.array([b for _, b in out], pa.binary()))


def row_spans(rows: list[tuple[int, int, bytes]], answers: list[bytes]) -> dict[int, list[tuple[int, int]]]:
    """Row of a pack -> first bytes and ends of what goes, from the shards' answers."""
    place = {(i, mark): row for row, (i, mark, _) in enumerate(rows)}
    told: dict[bytes, list[tuple[int, int, int]]] = {}
    keys = []
    for blob in answers:
        raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.int64)
        n = int(raw[0])
        key, ids, marks, offset, windows, per = raw[1 : 1 + 6 * n].reshape(6, n)
        lo, hi, least = (x.tolist() for x in raw[1 + 6 * n :].reshape(3, -1))
        keys.append(key.view(np.uint64))
        at = 0
        for i, mark, o, w, k in zip(ids.tolist(), marks.tolist(), offset.tolist(), windows.tolist(), per.tolist()):
            body = rows[place[i, mark]][2][o : o + w + LENGTH - 1]
            told[body] = list(zip(lo[at : at + k], hi[at : at + k], least[at : at + k]))
            at += k
    out: dict[int, list[tuple[int, int]]] = {}
    wanted = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)
    for parts in _slices([r[2] for r in rows]) if len(wanted) else ():
        x = Slice(parts, 1)
        kept = np.flatnonzero(np.isin(x.key, wanted))
        raw = x.data.data
        for a, w, row, offset in zip(x.start[kept].tolist(), x.windows[kept].tolist(), x.row[kept].tolist(), x.offset[kept].tolist()):
            own = rows[row][0]
            for lo, hi, least in told.get(bytes(raw[a : a + w + LENGTH - 1]), ()):
                if least < own:
                    out.setdefault(row, []).append((offset + lo, offset + hi + LENGTH - 1))
    return out


def whole_characters(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans, widened to whole characters of UTF-8."""
    inside = lambda i: 0 < i < len(text) and text[i] & 0xC0 == 0x80
    out = []
    for lo, hi in spans:
        while inside(lo):
            lo -= 1
        while inside(hi):
            hi += 1
        out.append((lo, hi))
    return out


def without_spans(text: bytes, spans: list[tuple[int, int]] | None) -> tuple[bytes, int]:
    """What is left of text, and the number of maximal removed runs."""
    if not spans:
        return text, 0
    kept, runs, end, at = [], 0, -1, 0
    for lo, hi in sorted(spans):
        if lo > end:
            kept.append(text[at if end < 0 else end : lo])
            runs += 1
            end = hi
        elif hi > end:
            end = hi
    kept.append(text[end:])
    return b"".join(kept), runs


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] = (), as_text: bool = False) -> DataFrame:
    """id_col, the columns in keep, n_bytes long, n_removed long, n_spans long and kept, for each row of df.

    kept is what is left: bytes, or with as_text a string; then what is removed is widened to whole
    characters first, so no character that lost a byte stays and none comes about.

    Texts are shuffled once, into packs; what follows reads them there. Packs ask the shards which
    of their pieces' codes (32 bits of a hash, so a few strangers get in, which does no harm) other
    packs have, send those pieces, get back the windows' smallest ids and apply them.
    """
    spark = df.sparkSession
    ship(spark)
    held = [f"_{i}" for i in range(len(keep) + 1)]
    # rows are told apart by id and a hash of the text: rows with both in common lose the same bytes
    rows = df.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("_id"),
        F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("_text"),
        *[F.col(c).alias(h) for h, c in zip(held, [id_col, *keep])],
    ).withColumn("_mark", F.xxhash64("_text"))
    total = rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards, packs = max(least, -(-total // SHARD)), max(2 * least, -(-total // PACK))
    texts = rows.select(F.pmod(F.xxhash64("_id", "_mark"), F.lit(packs)).cast("int").alias("_pack"), "_id", "_mark", "_text", *held)
    listed = lambda table, *names: [table.column(n).to_pylist() for n in names]

    def ask(key, table):
        keep_nothing()
        return pack_keys(key[0].as_py(), table.column("_text").to_pylist(), shards)

    def answer(key, table):
        return shared_keys(key[0].as_py(), *listed(table, "_pack", "blob"))

    def send(key, left, right):
        return pack_pieces(key[0].as_py(), list(zip(*listed(left, "_id", "_mark", "_text"))), shards, list(zip(*listed(right, "shard", "blob"))))

    def judge(table):
        return pack_runs(*listed(table, "_pack", "blob"))

    def apply(key, left, right):
        own = list(zip(*listed(left, "_id", "_mark", "_text")))
        spans = row_spans(own, right.column("runs").to_pylist())
        bodies = [t for *_, t in own]
        gone = [spans.get(i, []) for i in range(len(bodies))]
        if as_text:
            gone = [whole_characters(t, x) for t, x in zip(bodies, gone)]
        after = [without_spans(t, x) for t, x in zip(bodies, gone)]
        kept = pa.array([k.decode("utf-8", "replace") if as_text else k for k, _ in after], pa.string() if as_text else pa.binary())
        sizes = [pa.array(x, pa.int64()) for x in ([len(t) for t in bodies], [len(t) - len(k) for t, (k, _) in zip(bodies, after)], [n for _, n in after])]
        return pa.table([*[left.column(h) for h in held], *sizes, kept], names=[*held, "_bytes", "_removed", "_spans", "_kept"])

    by_pack = lambda d: d.groupBy("_pack")
    asked = by_pack(texts).applyInArrow(ask, "shard int, _pack int, blob binary")
    shared = asked.groupBy("shard").applyInArrow(answer, "_pack int, shard int, blob binary")
    sent = by_pack(texts).cogroup(by_pack(shared)).applyInArrow(send, "shard int, _pack int, blob binary")
    judged = sent.groupBy("shard").applyInArrow(judge, "_pack int, runs binary")
    kinds = "".join(f"{h} {rows.schema[h].dataType.simpleString()}, " for h in held)
    out = by_pack(texts).cogroup(by_pack(judged)).applyInArrow(apply, f"{kinds}_bytes bigint, _removed bigint, _spans bigint, _kept {'string' if as_text else 'binary'}")
    return out.select(
        *[F.col(h).alias(c) for h, c in zip(held, [id_col, *keep])],
        *[F.col(f"_{c}").alias(f"n_{c}") for c in ("bytes", "removed", "spans")],
        F.col("_kept").alias("kept"),
    )
