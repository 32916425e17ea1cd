"""Language-model scores by online logistic context mixing.

A text is its words, A-Z lower-cased, and one end; words are told apart by 64-bit hashes of their bytes.
A word is written in bits: frequent words (the head) by a Huffman code; any other as an escape, a flag
that says whether the training texts have it, and, if so, the first `depth` bits of its hash; what the
words of one such bucket share is dealt out by their counts. Each bit is predicted from counts of its code
node in four contexts: none, the last very frequent word, the previous word, and the two previous words;
the last three are hashed. Their logits and a bias are combined by weights that a gate chooses (how often
the two longer contexts were seen), learned online, bit by bit, by each piece of SEGMENT words as it is
read; an adaptive probability map then corrects the mixed logit. The sum of the log10 probabilities is the
score; with the bytes of the text, it gives the bits per byte.

All grows with the corpus: word and context counts cover every training document, the head, the hash
bits and the context tables grow with the words counted (up to HEAD_MOST, DEPTH_MOST and SLOTS_MOST, which
bound a worker's memory and leave no word out: beyond them, codes are longer and contexts share slots),
and weights and map come from every bit of every training document, with each bit's own count left out: tasks
tally how often a bit was one or zero where its inputs were of some kind (a range of each logit, and the gate), and
the weights with the least cost over this tally, one logistic regression a gate, held near the usual weights because
they go on learning in each text, are what all texts start from. A word that stands once in the training texts counts as unknown where it stands, so the flag is learned. Up to BROADCAST_WORDS words outside the head (12 bytes each) are broadcast; with more, each
text's words are joined with the vocabulary by a shuffle.

Defined cases: a null or empty text is the end alone; whole texts are scored, in bounded runs; without
training rows all words are unknown; null ids belong to the fold of empty text; equal texts get equal
base scores, and scores that differ by rounding at most; equal rows are scored each; an empty table gives
no rows; other columns are not looked at.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepfold.llm.common import ascii_lower, cut, in_fold, lean, word_hashes

HEAD, HEAD_MOST = 1 << 14, 1 << 17
DEPTH_MOST = 20
SLOTS, SLOTS_MOST = 1 << 18, 1 << 21  # of each hashed context
BROADCAST_WORDS = 1 << 23
MARKS = 64  # the very frequent words
SEGMENT = 512
BLOCK = 8  # words of each piece whose bits are held at once
RUN_WORDS = 1_000_000
RUN_BYTES = 1 << 20
CHUNK = 1 << 16
RATE = 0.015
GATES = 12
INPUTS = 5
EDGES = (0.7 * np.sinh(np.linspace(-3, 3, 14))).astype(np.float32)  # of the ranges of a logit that the tally tells apart
BINS = len(EDGES) + 1
RIDGE = 0.1  # a bit
LEVELS = (1, 4, 3)  # how many levels of each hashed context the tally tells apart: those that a gate does
CELLS = (LEVELS[1] * BINS, LEVELS[2] * BINS, BINS, BINS + 1, 2)  # of the tally: kinds of inputs 2, 3, 1 and 0 (the last of these: sure), and the bit
END = np.uint64(0)  # the hash of no bytes
_C = [np.uint32(c) for c in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)]
_BLANK = re.compile(rb"[\x20\x09-\x0D]")
_U1 = np.uint64(1)


# --- words -------------------------------------------------------------------------------------


def hashed(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of the texts, each text's end after them, and how many each text has; in runs of about RUN_BYTES."""
    counts = np.zeros(len(texts), np.int64)
    parts: list[np.ndarray] = []
    run: list[bytes] = []
    owner: list[int] = []
    size = 0

    def flush() -> None:
        if run:
            h, bounds = word_hashes(run)
            parts.append(h)
            np.add.at(counts, owner, np.diff(bounds))
            run.clear()
            owner.clear()

    for i, t in enumerate(texts):
        raw, at = ascii_lower(t), 0
        while at < len(raw):
            end = len(raw)
            if end - at > RUN_BYTES and (blank := _BLANK.search(raw, at + RUN_BYTES)):
                end = blank.start()
            if size + end - at > RUN_BYTES:
                flush()
                size = 0
            run.append(raw[at:end])
            owner.append(i)
            size += end - at
            at = end
    flush()
    sizes = counts + 1
    out = np.full(int(sizes.sum()), END)
    is_word = np.ones(len(out), bool)
    is_word[np.cumsum(sizes) - 1] = False
    if parts:
        out[is_word] = np.concatenate(parts)
    return out, sizes


def huffman(weights: list[float]) -> list[list[tuple[int, int]]]:
    """For each symbol, its path as pairs of node and bit."""
    heap = [(w, i, -1) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    up: dict[int, tuple[int, int]] = {}
    n = len(weights)
    for node in range(n - 1):
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        up[a[1]], up[b[1]] = (node, 0), (node, 1)
        heapq.heappush(heap, (a[0] + b[0], n + node, node))
    paths = []
    for i in range(n):
        path, at = [], i
        while at in up:
            path.append(up[at])
            at = n + up[at][0]
        paths.append(path[::-1])
    return paths


class Vocabulary:
    """What is known of words by their hashes: a symbol from 0 on (head words), or the count c of another, as -1 - c."""

    def __init__(self, hashes: np.ndarray, known: np.ndarray):
        by = np.argsort(hashes)
        self.hashes, self.known = hashes[by], known[by].astype(np.int32)
        self.bits = max(1, len(hashes).bit_length() - 1)
        edges = np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)
        self.first = np.append(np.searchsorted(self.hashes, edges), len(hashes)).astype(np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Symbol, -1 - count, or -1 for unknown words."""
        out = np.full(len(h), -1, np.int32)
        if not len(self.hashes):
            return out
        at = h >> np.uint64(64 - self.bits)
        lo, hi = self.first[at], self.first[at + _U1]
        open_ = np.flatnonzero(lo < hi)
        lo, hi, want = lo[open_], hi[open_], h[open_]
        while len(open_):
            hit = self.hashes[lo] == want
            out[open_[hit]] = self.known[lo[hit]]
            lo += 1
            left = ~hit & (lo < hi)
            open_, lo, hi, want = open_[left], lo[left], hi[left], want[left]
        return out


def usual() -> np.ndarray:
    """The weights that nothing is learned of yet."""
    return np.tile(np.float32([0.2, 0.6, 0.2, 0.2, 0.0]), (GATES, 1))


@dataclass
class Model:
    """What scoring needs; but for `words`, bounded in size whatever the corpus."""

    words: Vocabulary  # head words, and others if they are broadcast
    whole: bool  # whether `words` has all training words
    counts: np.ndarray  # of the head words
    n: int  # training tokens
    v: int  # distinct ones
    start: np.ndarray  # of each symbol's path; the escape is the last symbol
    length: np.ndarray
    codes: np.ndarray  # of the paths, twice the node plus the bit
    order0: np.ndarray  # logits by node: of the Huffman code, the flag, and the hash bits; infinite where one side is empty
    buckets: np.ndarray  # log of the sum of count + 0.5 of the words outside the head, by the first bits of their hash
    slot_bits: int
    kinds: np.ndarray = field(default_factory=lambda: np.zeros((0, 2), np.uint8))  # of a slot without one zero or one, for the tally
    logit: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))  # its last two bits are the level
    weights: np.ndarray = field(default_factory=usual)
    refine: np.ndarray = field(default_factory=lambda: np.zeros((GATES, 64), np.float32))
    loads: tuple[float, ...] = (0.0, 0.0, 0.0)  # mean counts of a slot, by context

    @property
    def escape(self) -> int:
        return len(self.counts)

    @property
    def depth(self) -> int:
        return len(self.buckets).bit_length() - 1

    @property
    def slots(self) -> int:
        return 3 << self.slot_bits


def power(n: int, least: int, most: int) -> int:
    """The least power of two that is n or more, within bounds."""
    return min(most, max(least, 1 << max(0, int(n) - 1).bit_length()))


def start_model(head: list[tuple[int, int]], n: int, v: int, buckets: np.ndarray, once: int, words: Vocabulary, whole: bool) -> Model:
    """The model without contexts. head: hashes and counts; buckets: sums of count + 0.5 by first hash bits; once: how many words stand once."""
    counts = np.array([c for _, c in head], np.int64)
    rest = n - int(counts.sum())
    paths = huffman([float(c) for c in counts] + [max(float(rest), 0.5)])
    own = np.array([*counts, max(rest, 0.5)], np.float64)
    length = np.array([len(p) for p in paths], np.int32)
    nodes = np.array([x for p in paths for x, _ in p], np.int64)
    bits = np.array([b for p in paths for _, b in p], np.uint8)
    own = np.repeat(own, length)
    ones, zeros = (np.bincount(nodes[bits == b], own[bits == b], len(head)) for b in (1, 0))
    code = np.log(ones + 1e-9) - np.log(zeros + 1e-9)
    flag = np.log(rest - once + 0.5) - np.log(once + 0.5) if rest else -np.inf  # known or not
    levels, sums = [], np.asarray(buckets, np.float64)
    while len(sums) > 1:
        with np.errstate(divide="ignore", invalid="ignore"):
            z = np.log(sums[1::2]) - np.log(sums[::2])
        levels.append(np.nan_to_num(z, nan=np.inf, posinf=np.inf, neginf=-np.inf))
        sums = sums[::2] + sums[1::2]
    with np.errstate(divide="ignore"):
        log = np.log(np.asarray(buckets, np.float64))
    return Model(
        words, whole, counts, n, v, np.concatenate([[0], np.cumsum(length)[:-1]]).astype(np.int32), length, (nodes * 2 + bits).astype(np.int32),
        np.concatenate([code, [flag], *levels[::-1]]).astype(np.float32), log, power(n >> 2, SLOTS, SLOTS_MOST).bit_length() - 1,
    )


@dataclass
class Run:
    """The tokens of some texts: how many each has, and of each its hash, what is known of it, and its three contexts."""

    sizes: np.ndarray
    hashes: np.ndarray
    known: np.ndarray
    contexts: list[np.ndarray]


def read(model: Model, texts: list[str | None], rare: list[bytes | None] | None = None) -> Run:
    """rare: of each text, the hashes and counts of its known words outside the head, if these are not broadcast."""
    h, sizes = hashed(texts)
    known = model.words.find(h)
    if rare is not None and any(rare):
        pairs = np.concatenate([np.frombuffer(r, np.int64).reshape(-1, 2) for r in rare if r])
        hashes, at = np.unique(pairs[:, 0].view(np.uint64), return_index=True)
        other = np.flatnonzero(known == -1)
        known[other] = Vocabulary(hashes, -1 - pairs[at, 1]).find(h[other])
    first = np.cumsum(sizes) - sizes
    said = (h >> np.uint64(32)).astype(np.uint32)
    prev1, prev2 = np.empty_like(said), np.empty_like(said)
    prev1[1:], prev2[2:] = said[:-1], said[:-2]
    prev1[first] = prev2[first] = 1
    prev2[(first + 1)[sizes > 1]] = 1
    k1 = prev1 * _C[0]
    k2 = (k1 ^ (k1 >> np.uint32(15))) * _C[2] + prev2 * _C[3]
    # the last very frequent word before each token, in its text
    mark = np.where((known >= 0) & (known < MARKS), np.arange(len(h)), -1)
    last = np.concatenate([[-1], np.maximum.accumulate(mark)[:-1]])
    last[last < np.repeat(first, sizes)] = -1
    k0 = (np.where(last >= 0, known[last], MARKS).astype(np.uint32) + np.uint32(1)) * _C[3]
    return Run(sizes, h, known, [k0, k1, k2])


@dataclass
class Bits:
    """The bits of some tokens, in order: how many each token has, and of each its value, code node, order-0 logit and place in each table."""

    n: np.ndarray
    bit: np.ndarray
    node: np.ndarray
    order0: np.ndarray
    slots: list[np.ndarray]
    sure: np.ndarray  # bits that have only one value


def bits_at(model: Model, run: Run, at: np.ndarray) -> Bits:
    """The bits of the tokens `at`."""
    known, esc, d = run.known[at], model.escape, model.depth
    sym = np.where(known >= 0, known, esc)
    length = model.length[sym]
    other = np.flatnonzero(known < 0)
    n = length.copy()
    n[other] += np.where(known[other] < -1, 1 + d, 1)
    off = np.cumsum(n) - n
    total = int(n.sum())
    place = np.repeat(model.start[sym] - off.astype(np.int32), n)
    place += np.arange(total, dtype=np.int32)
    both = model.codes.take(place, mode="clip") if len(model.codes) else np.zeros(total, np.int32)
    node, bit = both >> 1, (both & 1).astype(np.uint8)
    if len(other):
        flag = off[other] + length[other]
        node[flag], bit[flag] = esc, known[other] < -1
        if d:
            there = np.flatnonzero(known[other] < -1)
            h, down = run.hashes[at[other[there]]], np.arange(d, dtype=np.uint64)
            turn = (h[:, None] >> (np.uint64(63) - down)).astype(np.uint64)
            spots = (flag[there] + 1)[:, None] + np.arange(d)
            node[spots] = ((turn >> _U1) + (_U1 << down) + np.uint64(esc)).astype(np.int32)
            bit[spots] = turn & _U1
    order0 = model.order0.take(node)
    sure = np.flatnonzero(np.isinf(order0))
    order0[sure] = 0
    mixed = node.view(np.uint32) * _C[1]
    slots = []
    for i, k in enumerate(run.contexts):
        s = np.repeat(k[at], n)
        s += mixed
        s *= _C[2]
        s ^= s >> np.uint32(13)
        s *= _C[0]
        s >>= np.uint32(32 - model.slot_bits)
        s += np.uint32(i << model.slot_bits)
        slots.append(s.view(np.int32))
    return Bits(n, bit, node, order0, slots, sure)


# --- mixing ------------------------------------------------------------------------------------


def inputs(model: Model, b: Bits) -> tuple[np.ndarray, np.ndarray]:
    """The logits (INPUTS rows) and gates of bits."""
    x = np.empty((INPUTS, len(b.bit)), np.float32)
    x[0], x[4] = b.order0, 0.3
    seen = []
    for i, slot in enumerate(b.slots):
        z = model.logit.take(slot, out=x[i + 1], mode="clip")
        if i:
            seen.append(z.view(np.uint8)[::4] & np.uint8(3))
    x[:, b.sure] = 0  # nothing is learned from them
    return x, seen[0] * np.uint8(3) + np.minimum(seen[1], np.uint8(2))


def logits(n: np.ndarray, load: float) -> tuple[np.ndarray, np.ndarray]:
    """Logits of counts of zeros and ones, and a level from 0 to 3 of how many there are.

    load: the mean count of a slot. Where contexts share slots, what is no more than others' counts is not trusted.
    """
    total = n[:, 0] + n[:, 1]
    z = (np.log(n[:, 1] + 0.4) - np.log(n[:, 0] + 0.4)).astype(np.float32)
    some = total >= max(1, 0.75 * load)
    level = some.astype(np.uint8) + (total >= max(4, 2 * load)) + (total >= max(32, 8 * load))
    return np.where(total >= 1, z, 0).astype(np.float32), level.astype(np.uint8)


def with_level(z: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Logits whose last two bits are the level."""
    return ((z.astype(np.float32).view(np.uint32) & ~np.uint32(3)) | level).view(np.float32)


def mix(w: np.ndarray, x: np.ndarray, gate: np.ndarray, bit: np.ndarray, lanes: np.ndarray, rate: float = RATE) -> np.ndarray:
    """The mixed logit of each bit, by the weights of its lane and gate so far; w (INPUTS rows; GATES columns a lane) learns from every bit.

    lanes: how many of the bits, in order, each lane has. Every lane reads its bits one after another; all take a step at once.
    """
    order = np.argsort(-lanes, kind="stable")
    begin_of = (np.cumsum(lanes) - lanes)[order]
    live = len(lanes) - np.searchsorted(np.sort(lanes), np.arange(1, int(lanes.max(initial=0)) + 1), "left")
    begin = np.concatenate([[0], np.cumsum(live)])
    rank = np.arange(len(bit)) - np.repeat(begin[:-1], live)
    source = begin_of[rank] + np.repeat(np.arange(len(live)), live)  # by step, then lane
    xs, want = x.take(source, axis=1), bit.take(source) * np.float32(rate)
    rows = order[rank] * GATES + gate.take(source)
    z = np.empty(len(bit), np.float32)
    wide = int(live.max(initial=0))
    held, places = np.empty(INPUTS * wide, np.float32), np.empty(INPUTS * wide, np.int64)
    flat, every = w.reshape(-1), np.arange(INPUTS)[:, None] * w.shape[1]
    for t in range(len(live)):
        a, b = begin[t], begin[t + 1]
        n = INPUTS * (b - a)
        own, r = held[:n].reshape(INPUTS, -1), places[:n].reshape(INPUTS, -1)
        np.add(rows[a:b], every, out=r)
        flat.take(r, out=own, mode="clip")
        xt, zi = xs[:, a:b], z[a:b]
        np.add.reduce(own * xt, axis=0, out=zi)
        p = np.exp(-zi)
        p += 1
        np.divide(rate, p, out=p)
        np.subtract(want[a:b], p, out=p)
        own += xt * p
        flat[r] = own
    out = np.empty_like(z)
    out[source] = z
    return out


def bucket(z: np.ndarray) -> np.ndarray:
    return np.clip(z * 2.5 + 32, 0, 63).astype(np.int32)


def pieces(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First token and number of tokens of each piece of at most SEGMENT tokens of a text; the longest come first."""
    n = -(-sizes // SEGMENT)
    nth = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    first = np.repeat(np.cumsum(sizes) - sizes, n) + nth * SEGMENT
    size = np.minimum(SEGMENT, np.repeat(sizes, n) - nth * SEGMENT)
    by = np.argsort(-size, kind="stable")
    return first[by], size[by]


def blocks(model: Model, run: Run) -> Iterator[tuple[np.ndarray, Bits, np.ndarray, np.ndarray]]:
    """Token places, bits, gates and mixed logits of a run, BLOCK words of each piece at a time."""
    first, size = pieces(run.sizes)
    w = np.tile(model.weights.T, (1, len(first))).astype(np.float32)
    for low in range(0, int(size.max(initial=0)), BLOCK):
        n = np.minimum(BLOCK, size[: np.searchsorted(-size, -low, "left")] - low)
        at = np.repeat(first[: len(n)] + low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        b = bits_at(model, run, at)
        x, gate = inputs(model, b)
        lanes = np.add.reduceat(b.n, np.cumsum(n) - n)
        yield at, b, gate, mix(w, x, gate, b.bit, lanes)


def costs(model: Model, run: Run) -> np.ndarray:
    """The cost of each token, as a natural logarithm."""
    out, refine = np.zeros(len(run.hashes)), model.refine.ravel()
    for at, b, gate, z in blocks(model, run):
        z = z + refine.take(gate * np.int32(64) + bucket(z))
        a = np.where(b.bit == 1, -z, z)
        cost = np.maximum(a, 0) + np.log(1 + np.exp(-np.abs(a)))
        cost[b.sure] = 0
        some = np.flatnonzero(b.n)
        out[at[some]] = np.add.reduceat(cost, (np.cumsum(b.n) - b.n)[some], dtype=np.float64) if len(some) else 0
    # what is left of a bucket falls to its words by their counts
    other = np.flatnonzero(run.known < -1)
    out[other] += model.buckets[(run.hashes[other] >> np.uint64(64 - model.depth)).astype(np.int64) if model.depth else 0] - np.log(-run.known[other] - 0.5)
    return out


def kind(z: np.ndarray, level: np.ndarray | int = 0) -> np.ndarray:
    """The range that each logit falls in, by level."""
    return (np.searchsorted(EDGES, z) + BINS * level).astype(np.uint8)


def graded(model: Model, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Set the loads and kinds by the counts of all slots; gives their logits, and each context's mean logit by kind."""
    by_context = np.split(table, 3)
    model.loads = tuple(float(t.sum()) / len(t) for t in by_context)
    # part by part, so that the driver holds few copies of the table
    model.kinds, logit = np.empty(table.shape, np.uint8), np.empty(len(table), np.float32)
    middle, uses = np.zeros((3, max(LEVELS) * BINS)), np.full((3, max(LEVELS) * BINS), 1e-9)
    at = 0
    for i, (t, load) in enumerate(zip(by_context, model.loads)):
        for part in np.array_split(t, 16):
            end = at + len(part)
            logit[at:end] = with_level(*logits(part.astype(np.float32), load))
            for bit in (0, 1):
                n = part.astype(np.float32)
                n[:, bit] = np.maximum(n[:, bit] - 1, 0)
                z, level = logits(n, load)
                k = model.kinds[at:end, bit] = kind(z, np.minimum(level, LEVELS[i] - 1))
                middle[i] += np.bincount(k, part[:, bit] * z.astype(np.float64), len(middle[i]))
                uses[i] += np.bincount(k, part[:, bit], len(uses[i]))
            at = end
    return logit, middle / uses


def tally(model: Model, run: Run, cells: np.ndarray, sums: np.ndarray) -> None:
    """Add every bit of a run, its own count left out, to the cells (CELLS, flat), and its order-0 logit to the sums of its kind."""
    kinds = model.kinds.ravel()
    kind0 = np.where(np.isinf(model.order0), BINS, kind(model.order0)).astype(np.uint8)
    for low in range(0, len(run.hashes), 1 << 14):
        b = bits_at(model, run, np.arange(low, min(low + (1 << 14), len(run.hashes))))
        one, two, three = (kinds.take(slot * 2 + b.bit) for slot in b.slots)
        own = kind0.take(b.node)
        at = two.astype(np.int32)
        for k, size in ((three, CELLS[1]), (one, CELLS[2]), (own, CELLS[3]), (b.bit, CELLS[4])):
            at *= np.int32(size)
            at += k
        np.add.at(cells, at, 1)
        sums += np.bincount(own, b.order0, len(sums))


def learned(cells: np.ndarray, middle: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Each gate's weights with the least cost over a tally and their distance from the usual ones, and the probability map of what they mix.

    middle: the mean logit of each kind, of input 0 and the three contexts.
    """
    n = cells.reshape(CELLS)[..., :BINS, :]
    two, three, one, own = at = np.nonzero(n.sum(axis=-1))
    zeros, ones = n[at].T
    every = zeros + ones
    x = np.stack([middle[0][own], middle[1][one], middle[2][two], middle[3][three], np.full(len(own), 0.3)], axis=1)
    gate = two // BINS * LEVELS[2] + three // BINS
    weights, z = usual(), np.zeros(len(gate))
    for g in range(GATES):
        here = np.flatnonzero(gate == g)
        xs, began, w = x[here], weights[g].astype(np.float64), weights[g].astype(np.float64)
        ridge = RIDGE * every[here].sum() + 1

        def cost(w: np.ndarray) -> float:
            mixed = xs @ w
            return float((every[here] * np.logaddexp(0, mixed) - ones[here] * mixed).sum() + ridge / 2 * ((w - began) ** 2).sum())

        now = cost(w)
        for _ in range(50):  # Newton's steps, halved until they help
            p = 1 / (1 + np.exp(-(xs @ w)))
            slope = xs.T @ (every[here] * p - ones[here]) + ridge * (w - began)
            step = np.linalg.solve((xs.T * (every[here] * p * (1 - p))) @ xs + ridge * np.eye(INPUTS), slope)
            while (new := cost(w - step)) > now and np.abs(step).max() > 1e-6:
                step = step / 2
            if new >= now:
                break
            w, done, now = w - step, now - new <= 1e-9 * now, new
            if done:
                break
        weights[g], z[here] = w, xs @ w
    place = gate * 64 + bucket(z)
    return weights, refinement(*(np.bincount(place, c, GATES * 64).reshape(GATES, 64) for c in (ones, every)))


def refinement(ones: np.ndarray, all_: np.ndarray) -> np.ndarray:
    """The probability map: half the way from a mixed logit to what was seen there."""
    mid = 1 / (1 + np.exp(-(np.arange(64) - 31.5) / 2.5))
    p = (ones + 200 * mid) / (all_ + 200)
    return (0.5 * (np.log(p / (1 - p)) - np.log(mid / (1 - mid)))).astype(np.float32)


# --- passes ------------------------------------------------------------------------------------


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[list]]:
    """The columns of enough rows for about RUN_WORDS words."""
    held: list[list] = []
    size = 0
    for b in batches:
        text = b.schema.get_field_index("text")
        for row in zip(*(c.to_pylist() for c in b.columns)):
            held.append(row)
            size += len(row[text] or "")
            if size >= 6 * RUN_WORDS:
                yield [list(c) for c in zip(*held)]
                held, size = [], 0
    if held:
        yield [list(c) for c in zip(*held)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word hashes and their counts, summed over as many texts as fit."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def out() -> pa.RecordBatch:
        h, at = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
        n = np.bincount(at, np.concatenate([x for _, x in held]), len(h)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])

    for (texts,) in _runs(batches):
        held.append(np.unique(hashed(texts)[0], return_counts=True))
        if sum(len(x) for x, _ in held) > 2_000_000:
            yield out()
            held = []
    if held:
        yield out()


def _packed(part: np.ndarray) -> bytes:
    """Counts with their bytes sorted by significance, so that they compress."""
    return zstandard.compress(part.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpacked(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view(np.uint32).ravel()


def _contexts(held):
    """Counts of zeros and ones by slot, summed over a task, in chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        table = np.zeros(model.slots * 2, np.uint32)
        for texts, rare in _runs(batches):
            r = read(model, texts, None if model.whole else rare)
            r.known[r.known == -2] = -1  # what stands once, here alone, would else be unknown
            for low in range(0, len(r.hashes), 1 << 15):
                b = bits_at(model, r, np.arange(low, min(low + (1 << 15), len(r.hashes))))
                for slot in b.slots:
                    np.add.at(table, slot * 2 + b.bit, np.uint32(1))
        for at in range(0, len(table), CHUNK):
            part = table[at : at + CHUNK]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([at // CHUNK], pa.int32()), pa.array([_packed(part)], pa.binary())], ["chunk", "counts"])

    return run


def _sum_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for b in batches:
        for k, c in zip(b.column("chunk").to_pylist(), b.column("counts").to_pylist()):
            held[k] = held[k] + _unpacked(c) if k in held else _unpacked(c)
    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([_packed(x) for x in held.values()], pa.binary())], ["chunk", "counts"])


def _tally(held):
    """The tally of a task's texts, as rows of place and value, to be summed: cells, then sums of order-0 logits by kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        cells, sums = np.zeros(int(np.prod(CELLS)), np.int64), np.zeros(CELLS[3])
        for texts, rare in _runs(batches):
            r = read(model, texts, None if model.whole else rare)
            r.known[r.known == -2] = -1
            tally(model, r, cells, sums)
        out = np.concatenate([cells, sums])
        at = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(out[at])], ["i", "x"])

    return run


def _bucket(h: str, depth: int):
    return F.shiftrightunsigned(h, 64 - depth) if depth else F.lit(0).cast("long")


def vocabulary_of(texts: DataFrame) -> DataFrame:
    """h, c: the hashes and counts of all words of `texts`."""
    return cut(texts.select("text").mapInArrow(_count, "h long, n long").groupBy("h").agg(F.sum("n").alias("c")), "vocabulary")


def begin(vocabulary: DataFrame) -> Model:
    """The model without contexts."""
    sums = vocabulary.agg(F.sum("c").alias("n"), F.count("*").alias("v"), F.max(F.when(F.col("h") == 0, F.col("c"))).alias("ends")).first()
    n, v = int(sums["n"] or 0), int(sums["v"])
    top = vocabulary.where("h <> 0").orderBy(F.desc("c"), "h").limit(power(v >> 5, HEAD, HEAD_MOST) - 1).toArrow()
    pairs = list(zip(top["h"].to_pylist(), top["c"].to_pylist()))
    head = sorted([(0, int(sums["ends"]))] + pairs, key=lambda x: (-x[1], x[0])) if v else []
    last, least = pairs[-1] if pairs else (0, 0)
    rest = vocabulary.where((F.col("h") != 0) & ((F.col("c") < least) | ((F.col("c") == least) & (F.col("h") > last))))
    others = v - len(head)
    depth = power(others >> 2, 1, 1 << DEPTH_MOST).bit_length() - 1
    buckets = np.zeros(1 << depth)
    once = 0
    if others > 0:
        got = rest.groupBy(_bucket("h", depth).alias("b")).agg(F.sum(F.col("c") + 0.5).alias("s"), F.count_if(F.col("c") == 1).alias("once")).toArrow()
        buckets[got["b"].to_numpy()] = got["s"].to_numpy().astype(np.float64)
        once = int(got["once"].to_numpy().sum())
    hashes, known = np.array([h for h, _ in head], np.int64), np.arange(len(head))
    whole = others <= BROADCAST_WORDS
    if whole and others > 0:
        got = rest.toArrow()
        hashes, known = np.concatenate([hashes, got["h"].to_numpy()]), np.concatenate([known, -1 - got["c"].to_numpy()])
    return start_model(head, n, v, buckets, once, Vocabulary(hashes.view(np.uint64), known), whole)


def with_rare(texts: DataFrame, vocabulary: DataFrame, model: Model) -> DataFrame:
    """`texts` with `rare`: null if the model has all words, else the hashes and counts of each text's training words outside the head.

    Beyond BROADCAST_WORDS, this is a shuffle join on hashes; the pairs of equal texts are joined once.
    """
    if model.whole:
        return texts.withColumn("rare", F.lit(None).cast("binary"))
    held = texts.sparkSession.sparkContext.broadcast(model.words)

    def others(text: pa.Array) -> pa.Array:
        out = []
        for t in text.to_pylist():
            h = np.unique(hashed([t])[0])
            out.append(h[held.value.find(h) == -1].view(np.int64))
        return pa.array(out, pa.list_(pa.int64()))

    keyed = texts.withColumn("_k", F.xxhash64("text", F.octet_length("text")))
    asked = keyed.dropDuplicates(["_k"]).select("_k", F.explode(F.arrow_udf(others, "array<long>")("text")).alias("h"))
    found = asked.join(vocabulary, "h").groupBy("_k").agg(F.collect_list(F.struct("h", "c")).alias("p"))

    def pairs(p: pa.Array) -> pa.Array:
        return pa.array([np.array([(x["h"], x["c"]) for x in row], np.int64).tobytes() for row in p.to_pylist()], pa.binary())

    own = cut(found.select("_k", F.arrow_udf(pairs, "binary")("p").alias("rare")), "rare-words")
    return keyed.join(own, "_k", "left").drop("_k")


def fit(model: Model, train: DataFrame) -> Model:
    """The model with the contexts of the training rows (text, rare), and the weights learned from all of them."""
    spark = train.sparkSession
    if not model.escape:
        model.logit = np.zeros(model.slots, np.float32)
        return model
    held = spark.sparkContext.broadcast(model)
    kind = "chunk int, counts binary"
    chunks = train.select("text", "rare").mapInArrow(_contexts(held), kind).repartition("chunk").mapInArrow(_sum_chunks, kind)
    table = np.zeros(-(-model.slots * 2 // CHUNK) * CHUNK, np.uint32)
    for r in chunks.toLocalIterator():
        got = _unpacked(r["counts"])
        table[r["chunk"] * CHUNK :][: len(got)] = got
    held.destroy()
    table = table[: model.slots * 2].reshape(-1, 2)
    logit, middle = graded(model, table)
    del table
    held = spark.sparkContext.broadcast(model)
    sums = train.select("text", "rare").mapInArrow(_tally(held), "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).toArrow()
    held.destroy()
    cells = np.zeros(int(np.prod(CELLS)) + CELLS[3])
    cells[sums["i"].to_numpy()] = sums["x"].to_numpy()
    cells, own = np.split(cells, [-CELLS[3]])
    middle0 = own / np.maximum(cells.reshape(CELLS).sum(axis=(0, 1, 2, 4)), 1)
    model.weights, model.refine = learned(cells, [middle0, *middle])
    model.kinds, model.logit = np.zeros((0, 2), np.uint8), logit
    return model


def _score(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        size = np.log10(model.n + 0.5 * (model.v + 1))
        base = np.append(np.log10(model.counts + 0.5), 0.0) - size
        for doc_id, out, texts, rare in _runs(batches):
            r = read(model, texts, None if model.whole else rare)
            first = np.cumsum(r.sizes) - r.sizes
            log = base[np.where(r.known >= 0, r.known, model.escape)]
            other = r.known < 0
            log[other] += np.log10(-r.known[other] - 0.5)
            score = np.add.reduceat(costs(model, r), first) / -np.log(10)
            n_bytes = np.array([len(ascii_lower(t)) for t in texts])
            yield pa.RecordBatch.from_arrays([
                pa.array(doc_id, pa.int64()), pa.array(out, pa.bool_()), pa.array(r.sizes, pa.int64()),
                pa.array(np.add.reduceat((r.known != -1).astype(np.int64), first), pa.int64()), pa.array(np.full(len(texts), model.n), pa.int64()),
                pa.array(np.add.reduceat(log, first), pa.float64()), pa.array(score, pa.float64()), pa.array(-score / np.log10(2) / np.maximum(n_bytes, 1), pa.float64()),
            ], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"])

    return run


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte (of the text, of one byte at least) of every row."""
    lean(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), in_fold(F.col("doc_id"), 5, 1).alias("held_out"), "text")
    vocabulary = vocabulary_of(rows.where("not held_out"))
    model = begin(vocabulary)
    rows = with_rare(rows, vocabulary, model)
    model = fit(model, rows.where("not held_out"))
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    return rows.select("doc_id", "held_out", "text", "rare").mapInArrow(_score(held), kind)
