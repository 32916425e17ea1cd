"""Exact removal of repeated 50-byte strings by a hash-compared suffix sort.

A byte goes if a SPAN-byte string that covers it also starts in a document with a smaller id. Texts are
held in runs, byte arrays of whole documents. Each SPAN-byte window belongs to its anchor, the leftmost
of its GRAM-byte grams with the least hash, which its bytes alone decide; so equal windows have equal
anchors, wherever they stand. Windows in a row with one anchor form a piece. In steps, each one pass:

1. every run sends its distinct anchor hashes to buckets, which tell the runs what other runs have too;
2. runs send the pieces with a shared anchor to buckets by anchor, one for all equal pieces of a run;
3. in a bucket, the pieces' windows are sorted: two suffixes are compared by the length of their common
   prefix, found by binary search over prefix polynomial hashes, and the byte after it, in a bottom-up
   mergesort that merges all groups of a level at once. Neighbours with a common prefix of SPAN bytes are
   equal windows, which their bytes must confirm; of each, the smallest id is known, and so what goes;
4. runs cut the bytes that go.

A run sends one row for equal pieces, whatever the number of documents with them, so a passage in a
third of all documents is one row a run. An anchor that HOT runs or more share is spread: its windows
become pieces of their own and are dealt by their own hash.

Defined cases: a null text is empty; texts under SPAN bytes lose nothing; a null id is after all others
(documents with equal or null ids take nothing from each other); rows are answered one by one, equal
ones too; an empty table gives no rows; other columns are not looked at; a run is at least one whole
document, however long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepfold.llm.common import bucketed, lean, powers, prefix_hash, span_hash

SPAN = 50
GRAM = 20
RUN_BYTES = 1 << 20
BUCKET_BYTES = 24 << 20  # of text for each bucket
HOT = 2048
LAST = np.iinfo(np.int64).max
#: A bucket's pieces are sorted in blocks of whole groups, of about so many pieces.
BLOCK = 40_000


def pack(*arrays: np.ndarray) -> bytes:
    head = np.array([a.nbytes for a in arrays], np.int64)
    return zstandard.compress(b"".join([head.tobytes(), *(np.ascontiguousarray(a).tobytes() for a in arrays)]), 3)


def unpack(blob: bytes, *kinds: type) -> list[np.ndarray]:
    raw = zstandard.decompress(blob)
    sizes = np.frombuffer(raw, np.int64, len(kinds))
    ends = np.cumsum(sizes) + 8 * len(kinds)
    return [np.frombuffer(raw[e - s : e], k) for s, e, k in zip(sizes, ends, kinds)]


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places from each start on, `size` of them."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


# --- pieces ------------------------------------------------------------------------------------


def pieces(data: np.ndarray, sizes: np.ndarray, prefix: np.ndarray, span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """First window, number of windows, place of the anchor in the first window, hash of the anchor, and document of each piece."""
    grams = span - gram + 1
    n = len(data) - span + 1
    none = np.zeros(0, np.int64)
    if n < 1 or not (sizes >= span).any():
        return none, none, none, none.astype(np.uint64), none
    at = np.arange(len(data) - gram + 1)
    h = span_hash(prefix, at, at + gram)
    low, width = h, 1
    while width * 2 <= grams:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[: len(low) - (grams - width)], low[grams - width :]) if grams > width else low
    first = np.cumsum(sizes) - sizes
    within = np.zeros(n + 1, np.int8)
    long = sizes >= span
    np.add.at(within, first[long], 1)
    np.add.at(within, (first + sizes - span + 1)[long], -1)
    valid = np.cumsum(within[:-1]) > 0
    new = np.ones(n, bool)
    new[1:] = (low[1:] != low[:-1]) | (valid[1:] != valid[:-1])
    new[first[long]] = True
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, n))
    keep = valid[start]
    start, size = start[keep], size[keep]
    ahead = np.arange(grams)
    anchor = np.concatenate([(h[s[:, None] + ahead] == low[s][:, None]).argmax(axis=1) for s in np.array_split(start, max(1, len(start) // 50_000))])
    over = size > anchor + 1  # equal hashes follow: each window looks for its own anchor
    if over.any():
        own = spread(start[over], size[over])
        found = np.concatenate([own_ + (h[own_[:, None] + ahead] == low[own_][:, None]).argmax(axis=1) for own_ in np.array_split(own, max(1, len(own) // 50_000))])
        begin = np.ones(len(own), bool)
        begin[1:] = (found[1:] != found[:-1]) | (own[1:] != own[:-1] + 1) | new[own[1:]]
        b = np.flatnonzero(begin)
        start = np.concatenate([start[~over], own[b]])
        size = np.concatenate([size[~over], np.diff(np.append(b, len(own)))])
        anchor = np.concatenate([anchor[~over], found[b] - own[b]])
    doc = np.searchsorted(first, start, "right") - 1
    # of empty documents that begin at the same place, the last is the one with bytes
    return start, size, anchor, h[start + anchor], doc


class Run:
    def __init__(self, ids: bytes, sizes: bytes, z: bytes):
        self.ids, self.sizes = np.frombuffer(ids, np.int64), np.frombuffer(sizes, np.int64)
        self.data = np.frombuffer(zstandard.decompress(z), np.uint8) if len(z) else np.zeros(0, np.uint8)
        self.prefix = prefix_hash(self.data)
        self.start, self.size, self.anchor, self.hash, self.doc = pieces(self.data, self.sizes, self.prefix)


def rows_of(data: np.ndarray, start: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
    """The bytes from each start on, as rows of `width`, zero beyond their size."""
    at = start[:, None] + np.arange(width)
    return np.where(np.arange(width) < size[:, None], data[np.minimum(at, len(data) - 1)], 0)


def equal_spans(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the bytes from a and from b on agree."""
    out = np.ones(len(a), bool)
    for at in range(0, len(a), 50_000):
        s = slice(at, at + 50_000)
        w = int(size[s].max(initial=0))
        out[s] = (rows_of(data, a[s], size[s], w) == rows_of(data, b[s], size[s], w)).all(axis=1)
    return out


# --- the suffix sort ---------------------------------------------------------------------------


def agree(prefix: np.ndarray, a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """Whether the hashes of the `size` bytes from a and from b on agree."""
    _, inv = powers(len(prefix))
    return (prefix[a + size] - prefix[a]) * inv[a] == (prefix[b + size] - prefix[b]) * inv[b]


def common(prefix: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Length, up to `most`, of the common prefixes of the suffixes at a and at b: `most` if their hashes agree, else by binary search."""
    out = np.full(len(a), most, np.int64)
    left = np.flatnonzero(~agree(prefix, a, b, most))
    a, b = a[left], b[left]
    _, inv = powers(len(prefix))
    from_a, from_b, unit_a, unit_b = prefix[a], prefix[b], inv[a], inv[b]
    low, high = np.zeros(len(a), np.int64), np.full(len(a), most - 1, np.int64)
    for _ in range(int(most - 1).bit_length()):
        mid = (low + high + 1) >> 1
        same = (prefix[a + mid] - from_a) * unit_a == (prefix[b + mid] - from_b) * unit_b
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    out[left] = low
    return out


def compare(data: np.ndarray, prefix: np.ndarray, eight: np.ndarray, at: np.ndarray, i: np.ndarray, j: np.ndarray, most: int) -> np.ndarray:
    """-1, 0 or 1: how the suffixes at[i] stand to at[j] by their first `most` bytes; `eight` are their first bytes as numbers."""
    x, y = eight[i], eight[j]
    out = (x > y).astype(np.int8) - (x < y)
    tie = np.flatnonzero(out == 0)
    a, b = at[i[tie]], at[j[tie]]
    n = common(prefix, a, b, most)
    end = len(data) - 1
    x, y = data[np.minimum(a + n, end)], data[np.minimum(b + n, end)]
    out[tie] = np.where(n < most, (x > y).astype(np.int8) - (x < y), 0)
    return out


def suffix_sort(data: np.ndarray, prefix: np.ndarray, at: np.ndarray, group: np.ndarray, most: int) -> np.ndarray:
    """The order of the suffixes `at` within each group (groups stand together), by a stable mergesort."""
    n = len(at)
    order = np.arange(n)
    if n < 2:
        return order
    begin = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    sizes = np.diff(np.append(begin, n))
    first, size = np.repeat(begin, sizes), np.repeat(sizes, sizes)
    local = np.arange(n) - first
    eight = np.ascontiguousarray(rows_of(data, at, np.full(n, min(8, most)), 8)).view(">u8").ravel().astype(np.uint64)
    width = 1
    while width < sizes.max():
        rest = np.flatnonzero(size > width)  # groups that are not one sorted run yet
        run = local[rest] // width
        left = run % 2 == 0
        lo = first[rest] + np.where(left, run + 1, run - 1) * width  # the other run of the pair
        hi = np.minimum(lo + width, first[rest] + size[rest])
        a, b = np.minimum(lo, hi), hi.copy()
        begin_other = a.copy()
        own = order[rest]
        # a suffix of the left run stands before equal ones of the right run
        bound = np.where(left, 0, 1)
        while len(i := np.flatnonzero(a < b)):
            mid = (a[i] + b[i]) >> 1
            after = compare(data, prefix, eight, at, order[mid], own[i], most) < bound[i]
            a[i], b[i] = np.where(after, mid + 1, a[i]), np.where(after, b[i], mid)
        base = first[rest] + (run - run % 2) * width
        new = order.copy()
        new[base + (local[rest] - run * width) + (a - begin_other)] = own
        order = new
        width *= 2
    return order


def smaller_elsewhere(data: np.ndarray, start: np.ndarray, size: np.ndarray, offset: np.ndarray, key: np.ndarray, doc: np.ndarray, span: int = SPAN) -> np.ndarray:
    """For each piece, the bits of its windows that a piece of the same key and a smaller document has too.

    start, size: where its bytes begin and how many windows it has; offset: of the anchor in its first window.
    """
    prefix = prefix_hash(data)
    content = span_hash(prefix, start, start + size + span - 1)
    by = np.lexsort((doc, content, size, key))
    same = np.zeros(len(by), bool)
    same[1:] = (key[by][1:] == key[by][:-1]) & (content[by][1:] == content[by][:-1]) & (size[by][1:] == size[by][:-1])
    first = by[np.maximum.accumulate(np.where(same, 0, np.arange(len(by))))]  # of equal pieces, that of the smallest document
    copy = np.flatnonzero(same)
    sure = equal_spans(data, start[by[copy]], start[first[copy]], size[by[copy]] + span - 1)
    first[copy[~sure]] = by[copy[~sure]]  # a collision of hashes: a piece of its own
    of = np.empty(len(by), np.int64)
    of[by] = first
    # different pieces of one key: compare their windows
    own = np.flatnonzero(of == np.arange(len(of)))
    _, at_key, n = np.unique(key[own], return_inverse=True, return_counts=True)
    own = own[n[at_key] > 1]
    bits = np.zeros(len(start), np.uint64)
    if len(own):
        bits[own] = _compare_windows(data, prefix, start[own], size[own], offset[own], key[own], doc[own], span)
    every = (np.uint64(1) << size.astype(np.uint64)) - np.uint64(1)
    return np.where(doc > doc[of], every, bits[of])


def _compare_windows(data: np.ndarray, prefix: np.ndarray, start: np.ndarray, size: np.ndarray, offset: np.ndarray, key: np.ndarray, doc: np.ndarray, span: int) -> np.ndarray:
    piece = np.repeat(np.arange(len(start)), size)
    at = spread(start, size)
    k = at - start[piece]
    place = offset[piece] - k  # of the anchor in the window: equal windows agree in it
    by = np.lexsort((at, place, key[piece]))
    own, there = key[piece[by]], place[by]
    change = np.append(True, (own[1:] != own[:-1]) | (there[1:] != there[:-1]))
    group = np.cumsum(change) - 1
    several = np.bincount(group)[group] > 1
    by, group = by[several], group[several]
    bits = np.zeros(len(start), np.uint64)
    if not len(by):
        return bits
    at, piece, k = at[by], piece[by], k[by]
    order = suffix_sort(data, prefix, at, group, span)
    at, piece, k = at[order], piece[order], k[order]
    same = np.zeros(len(at), bool)
    near = np.flatnonzero(group[1:] == group[:-1])
    equal = near[agree(prefix, at[near], at[near + 1], span)]
    sure = equal_spans(data, at[equal], at[equal + 1], np.full(len(equal), span))
    if not sure.all():  # a collision of hashes: order the groups it touches by their bytes
        for g in np.unique(group[equal[~sure]]):
            i = np.flatnonzero(group == g)
            text = [data[a : a + span].tobytes() for a in at[i]]
            rank = sorted(range(len(i)), key=text.__getitem__)
            at[i], piece[i], k[i] = at[i][rank], piece[i][rank], k[i][rank]
            same[i[1:]] = [text[b] == text[a] for a, b in zip(rank, rank[1:])]
            equal = equal[group[equal] != g]
    same[equal + 1] = True
    starts = np.flatnonzero(~same)
    least = np.repeat(np.minimum.reduceat(doc[piece], starts), np.diff(np.append(starts, len(at))))
    gone = least < doc[piece]
    np.bitwise_or.at(bits, piece[gone], np.uint64(1) << k[gone].astype(np.uint64))
    return bits


# --- passes ------------------------------------------------------------------------------------


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    rows: list[tuple[int, int, bool]] = []
    texts: list[bytes] = []
    held = number = 0

    def out() -> pa.RecordBatch:
        ids = np.array([LAST if none else i for i, _, none in rows], np.int64)
        sizes = np.array([s for _, s, _ in rows], np.int64)
        nulls = np.array([none for _, _, none in rows], bool)
        return pa.RecordBatch.from_arrays([pa.array([(part << 32) + number]), *(pa.array([x], pa.binary()) for x in (ids.tobytes(), nulls.tobytes(), sizes.tobytes(), zstandard.compress(b"".join(texts), 3)))], ["run", "ids", "nulls", "sizes", "z"])

    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            raw = (t or "").encode("utf-8", "surrogatepass")
            if rows and held + len(raw) > RUN_BYTES:
                yield out()
                rows, texts, held, number = [], [], 0, number + 1
            rows.append((i or 0, len(raw), i is None))
            texts.append(raw)
            held += len(raw)
    if rows:
        yield out()


def _anchors(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for run_id, ids, sizes, z in zip(*(b.column(c).to_pylist() for c in ("run", "ids", "sizes", "z"))):
                h = np.sort(Run(ids, sizes, z).hash)
                h = h[np.append(True, h[1:] != h[:-1])[: len(h)]]
                to = (h % np.uint64(buckets)).astype(np.int64)
                h, to = h[o := np.argsort(to, kind="stable")], to[o]
                cuts = np.flatnonzero(np.append(True, to[1:] != to[:-1])) if len(h) else []
                parts = np.split(h, cuts[1:]) if len(h) else []
                yield pa.RecordBatch.from_arrays([pa.array([int(to[c]) for c in cuts], pa.int32()), pa.array([run_id] * len(parts), pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())], ["bucket", "run", "h"])

    return run


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """The rows of each bucket; they come sorted by it."""
    at, held = None, []
    for b in batches:
        cols = [c.to_pylist() for c in b.columns]
        for row in zip(*cols):
            if row[0] != at and held:
                yield at, held
                held = []
            at = row[0]
            held.append(row[1:])
    if held:
        yield at, held


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Which anchors of a run other runs have too, and which very many have."""
    for _, rows in _by_bucket(batches):
        parts = [np.frombuffer(h, np.uint64) for _, h in rows]
        every = np.sort(np.concatenate(parts))
        start = np.flatnonzero(np.append(True, every[1:] != every[:-1]))
        n = np.diff(np.append(start, len(every)))
        many, hot = every[start[n > 1]], every[start[n >= HOT]]
        out = [(run, p[np.isin(p, many, assume_unique=True)], p[np.isin(p, hot, assume_unique=True)] if len(hot) else hot) for (run, _), p in zip(rows, parts)]
        out = [x for x in out if len(x[1])]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _, _ in out], pa.int64()), pa.array([m.tobytes() for _, m, _ in out], pa.binary()), pa.array([x.tobytes() for _, _, x in out], pa.binary())], ["run", "many", "hot"])


def shared_pieces(run: Run, many: np.ndarray, hot: np.ndarray) -> tuple[tuple[np.ndarray, ...], np.ndarray, np.ndarray]:
    """Start, windows, anchor's place, key and id of the pieces to send, and where the bytes that go anyway begin and end."""
    start, size, anchor, key, doc = run.start, run.size, run.anchor, run.hash, run.ids[run.doc]
    # anchors that several documents of the run have
    by = np.lexsort((doc, key))
    again = (key[by][1:] == key[by][:-1]) & (doc[by][1:] != doc[by][:-1])
    local = np.unique(key[by][1:][again])
    take = np.isin(key, many) | np.isin(key, local)
    start, size, anchor, key, doc = start[take], size[take], anchor[take], key[take], doc[take]
    if len(hot) and (h := np.isin(key, hot)).any():
        one = spread(start[h], size[h])
        start = np.concatenate([start[~h], one])
        doc = np.concatenate([doc[~h], np.repeat(doc[h], size[h])])
        key = np.concatenate([key[~h], span_hash(run.prefix, one, one + SPAN)])
        anchor = np.concatenate([anchor[~h], np.zeros(len(one), np.int64)])
        size = np.concatenate([size[~h], np.ones(len(one), np.int64)])
    # equal pieces: only those of the smallest id are sent, the others go
    content = span_hash(run.prefix, start, start + size + SPAN - 1)
    by = np.lexsort((start, doc, size, content))
    c, s = content[by], size[by]
    begin = np.append(True, (c[1:] != c[:-1]) | (s[1:] != s[:-1])) if len(c) else np.zeros(0, bool)
    first = by[np.flatnonzero(begin)][np.cumsum(begin) - 1] if len(c) else by
    later = np.flatnonzero(doc[first] < doc[by])
    sure = equal_spans(run.data, start[by[later]], start[first[later]], size[by[later]] + SPAN - 1)
    gone = np.zeros(len(start), bool)
    gone[by[later[sure]]] = True
    return (start[~gone], size[~gone], anchor[~gone], key[~gone], doc[~gone]), start[gone], (start + size + SPAN - 1)[gone]


def _pieces(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        join = lambda parts: np.concatenate([np.frombuffer(p, np.uint64) for p in parts]) if parts else np.zeros(0, np.uint64)
        for b in batches:
            for run_id, ids, sizes, z, many, hot in zip(*(b.column(c).to_pylist() for c in ("run", "ids", "sizes", "z", "many", "hot"))):
                r = Run(ids, sizes, z)
                (start, size, anchor, key, doc), a, e = shared_pieces(r, join(many), join(hot))
                to = (key % np.uint64(buckets)).astype(np.int64)
                by = np.argsort(to, kind="stable")
                out = [(run_id % buckets, None, pack(a.astype(np.int32), e.astype(np.int32)))] if len(a) else []
                for part in np.split(by, np.flatnonzero(np.diff(to[by])) + 1) if len(by) else []:
                    text = r.data[spread(start[part], size[part] + SPAN - 1)]
                    out.append((int(to[part[0]]), pack(start[part].astype(np.int32), size[part].astype(np.uint8), anchor[part].astype(np.uint8), key[part], doc[part], text), None))
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([run_id] * len(out), pa.int64()), pa.array([x[1] for x in out], pa.binary()), pa.array([x[2] for x in out], pa.binary())], ["bucket", "run", "pieces", "gone"])

    return run


def _sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (np.int32, np.uint8, np.uint8, np.uint64, np.int64, np.uint8)
    for _, rows in _by_bucket(batches):
        out: list[tuple] = [(run, None, gone) for run, _, gone in rows if gone is not None]
        sent = [(run, unpack(p, *kinds)) for run, p, _ in rows if p is not None]
        if sent:
            of = np.repeat(np.arange(len(sent)), [len(x[0]) for _, x in sent])
            start, size, anchor, key, doc, data = (np.concatenate([x[i] for _, x in sent]) for i in range(6))
            size, anchor = size.astype(np.int64), anchor.astype(np.int64)
            at = np.cumsum(size + SPAN - 1) - (size + SPAN - 1)
            bits = np.zeros(len(start), np.uint64)
            by = np.argsort(key, kind="stable")
            ends = np.flatnonzero(np.append(key[by][1:] != key[by][:-1], True)) + 1
            low = 0
            while low < len(by):
                high = ends[min(np.searchsorted(ends, low + BLOCK), len(ends) - 1)]
                block = by[low:high]
                text = data[spread(at[block], size[block] + SPAN - 1)]
                begin = np.cumsum(size[block] + SPAN - 1) - (size[block] + SPAN - 1)
                bits[block] = smaller_elsewhere(text, begin, size[block], anchor[block], key[block], doc[block])
                low = high
            hit = np.flatnonzero(bits)
            for i in np.split(hit, np.flatnonzero(np.diff(of[hit])) + 1) if len(hit) else []:
                out.append((sent[of[i[0]]][0], pack(start[i], bits[i]), None))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary()), pa.array([x[2] for x in out], pa.binary())], ["run", "bits", "gone"])


def removed(n: int, bits: list[bytes], gone: list[bytes]) -> np.ndarray:
    """Which of n bytes go."""
    edge = np.zeros(n + 1, np.int32)
    for p in gone:
        a, e = unpack(p, np.int32, np.int32)
        np.add.at(edge, a, 1)
        np.add.at(edge, e, -1)
    for p in bits:
        start, mask = unpack(p, np.int32, np.uint64)
        on = np.unpackbits(mask.view(np.uint8), bitorder="little").reshape(-1, 64).nonzero()
        a = start[on[0]] + on[1]
        np.add.at(edge, a, 1)
        np.add.at(edge, a + SPAN, -1)
    return np.cumsum(edge[:-1]) > 0


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for ids, nulls, sizes, z, bits, gone in zip(*(b.column(c).to_pylist() for c in ("ids", "nulls", "sizes", "z", "bits", "gone"))):
            size = np.frombuffer(sizes, np.int64)
            data = np.frombuffer(zstandard.decompress(z), np.uint8) if size.sum() else np.zeros(0, np.uint8)
            off = removed(len(data), bits or [], gone or [])
            rows = []
            for e, s in zip(np.cumsum(size), size):
                o = off[e - s : e]
                rows.append((int(s), int(o.sum()), int(np.count_nonzero(np.diff(o.astype(np.int8), prepend=0) == 1)), hashlib.sha256(data[e - s : e][~o].tobytes()).hexdigest()))
            ids_ = pa.array(np.frombuffer(ids, np.int64), mask=np.frombuffer(nulls, bool))
            yield pa.RecordBatch.from_arrays([ids_, *(pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string())))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def report(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row."""
    lean(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    held = bucketed(rows.mapInArrow(_runs, "run long, ids binary, nulls binary, sizes binary, z binary"), "run")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, -(-int(total) // bucket_bytes))
    # a bucket is a partition: dealt by a hash, several would meet in one
    dealt = lambda d: d.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket")
    anchors = held.mapInArrow(_anchors(buckets), "bucket int, run long, h binary")
    found = dealt(anchors).mapInArrow(_shared, "run long, many binary, hot binary")
    found = found.groupBy("run").agg(F.collect_list("many").alias("many"), F.collect_list("hot").alias("hot"))
    # runs stay where they are: they are bucketed by the key that the joins use
    asked = held.select("run", "ids", "sizes", "z").join(found.hint("shuffle_hash"), "run", "left")
    sent = asked.mapInArrow(_pieces(buckets), "bucket int, run long, pieces binary, gone binary")
    told = dealt(sent).mapInArrow(_sorted, "run long, bits binary, gone binary")
    told = told.groupBy("run").agg(F.collect_list("bits").alias("bits"), F.collect_list("gone").alias("gone"))
    return held.join(told.hint("shuffle_hash"), "run", "left").mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


REPORT_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, a, substr(h, 2 * a + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, greatest(length(h) // 2 - 49, 0))) AS a FROM d)),
l AS (SELECT s, min(doc_id) AS least FROM w GROUP BY ALL HAVING count(*) > 1),
g AS (SELECT doc_id, a FROM w JOIN l USING (s) WHERE least < doc_id),
b AS (SELECT *, CASE WHEN a <= 50 + max(a) OVER (PARTITION BY doc_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM g),
i AS (SELECT doc_id, n, min(a) AS a, max(a) + 50 AS e FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY a) AS n FROM b) GROUP BY ALL),
p AS (SELECT i.doc_id, n, a, e, coalesce(lag(e) OVER (PARTITION BY i.doc_id ORDER BY a), 0) AS before FROM i),
k AS (SELECT p.doc_id, string_agg(substr(h, CAST(2 * before + 1 AS BIGINT), CAST(2 * (a - before) AS BIGINT)), '' ORDER BY a) AS kept, max(e) AS last, CAST(sum(e - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM p JOIN d USING (doc_id) GROUP BY ALL)
SELECT d.doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept || substr(h, CAST(2 * last + 1 AS BIGINT)), h))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
