"""Runs of repeated words, found in a grammar of the texts.

A run is a stretch of consecutive words with smallest period q that no
neighbouring word extends keeping period q, of length >= max(6, 4 q).

1. Words of a batch of whole texts become numbers; equal numbers are equal bytes.
2. Re-Pair: adjacent pairs that occur twice or more become nonterminals.  A round
   replaces, all over the batch, the pairs that no more frequent pair overlaps
   (frequencies are counted in hashed cells, rules are told apart exactly), until
   a round replaces fewer than one symbol in ``LEAST``.  What is left of each text
   is folded into a balanced binary tree, so a text has one root.
3. A nonterminal's boundary is where its two halves meet.  Runs inside its
   expansion that cross the boundary are computed once, on its first occurrence.
   Such a run has two periods to the right or to the left of the boundary, which
   leaves as candidates the periods up to half of either side: three words are
   compared for each, then hashes, and ends are found by binary search; every
   result is verified word by word.
4. The runs are translated to all positions where the nonterminal was put in.
   The lowest nonterminal that covers a run crosses it and finds it whole; lower
   ones find parts, so of intervals with equal period the contained ones go.

Texts never leave their row: no shuffle, and memory is bounded by the larger of a
batch and one text.

Defined results: null, empty and blank texts have no words and no runs; rows that
repeat an id are searched one by one; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stakeperf.llm.common import Texts, chunks, empty, per_task
from stakeperf.llm.spans import BASES, U, _powers, mix, ranges, word_ids, words

SHORTEST, REPEATS = 6, 4
#: Re-Pair stops when a round replaces fewer than one symbol in so many.
LEAST = 48
#: Text of a batch, and candidate periods looked at together.
BATCH_BYTES, CANDIDATES = 1 << 20, 1 << 21

FOUND = pa.schema([("doc_id", pa.int64()), ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])))])
DIGEST = pa.schema([("doc_id", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())])


class Sequence:
    """Word numbers with hashes of all their stretches."""

    def __init__(self, word: np.ndarray):
        self.word = word
        up, self.down = _powers(BASES[0], len(word) + 1)
        self.prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(word.astype(np.uint64) + U(1)) * up[:len(word)], dtype=np.uint64)])

    def hash(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        return (self.prefix[start + length] - self.prefix[start]) * self.down[start]

    def forward(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """How far the words from ``a`` and ``b`` on agree, at most ``limit``."""
        low, high = np.zeros(len(a), np.int64), limit.copy()
        while (low < high).any():
            mid = (low + high + 1) >> 1
            good = self.hash(a, mid) == self.hash(b, mid)
            low, high = np.where(good, mid, low), np.where(good, high, mid - 1)
        return low

    def backward(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """How far the words before ``a`` and ``b`` agree, at most ``limit``."""
        low, high = np.zeros(len(a), np.int64), limit.copy()
        while (low < high).any():
            mid = (low + high + 1) >> 1
            good = self.hash(a - mid, mid) == self.hash(b - mid, mid)
            low, high = np.where(good, mid, low), np.where(good, high, mid - 1)
        return low

    def periodic(self, start: int, end: int, q: int) -> bool:
        return np.array_equal(self.word[start:end - q], self.word[start + q:end])

    def stretch(self, low: int, high: int, at: int, q: int) -> tuple[int, int]:
        """The stretch of period ``q`` around ``at``, word by word."""
        equal = self.word[low:high - q] == self.word[low + q:high]
        p = at - low
        left, right = np.flatnonzero(~equal[:p]), np.flatnonzero(~equal[p:])
        return (low + left[-1] + 1 if len(left) else low), q + (at + right[0] if len(right) else high - q)


def _candidates(seq: Sequence, low: np.ndarray, mid: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, q, place) where two periods q lie on one side of the node's boundary, from ``place`` on."""
    w = seq.word
    out = []
    for right in (True, False):
        most = np.minimum((high - low) // REPEATS, (high - mid if right else mid - low) // 2)
        cut = np.concatenate([[0], np.flatnonzero(np.diff(np.cumsum(most) // CANDIDATES)) + 1, [len(most)]])
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
            node = np.repeat(np.arange(a, b), most[a:b])
            q = ranges(np.ones(b - a, np.int64), most[a:b])
            m = mid[node]
            for probe in (lambda q: 0 * q, lambda q: q - 1, lambda q: q // 2):
                k = probe(q)
                good = w[m + k] == w[m + k + q] if right else w[m - 1 - k] == w[m - 1 - k - q]
                node, q, m = node[good], q[good], m[good]
            at = m if right else m - 2 * q
            good = seq.hash(at, q) == seq.hash(at + q, q)
            out.append((node[good], q[good], at[good]))
    return tuple(np.concatenate(x) for x in zip(*out))


def crossing(seq: Sequence, low: np.ndarray, mid: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Rows (node, start, end, period) of the runs in [low, high) that cross ``mid``."""
    none = np.empty((0, 4), np.int64)
    big = np.flatnonzero(high - low >= SHORTEST)
    if not len(big):
        return none
    low, mid, high = low[big], mid[big], high[big]
    node, q, at = _candidates(seq, low, mid, high)
    if not len(node):
        return none
    m = mid[node]
    start = at - seq.backward(at, at + q, at - low[node])
    end = at + q + seq.forward(at, at + q, high[node] - at - q)
    good = (end - start >= np.maximum(SHORTEST, REPEATS * q)) & (start < m) & (end > m)
    rows, at = np.stack([node, start, end, q], axis=1)[good], at[good]
    for r, p in zip(rows, at):  # few; a hash that lied is put right word by word
        if not seq.periodic(r[1], r[2], r[3]):
            r[1:3] = seq.stretch(low[r[0]], high[r[0]], p, r[3])
    rows = rows[(rows[:, 2] - rows[:, 1] >= np.maximum(SHORTEST, REPEATS * rows[:, 3])) & (rows[:, 1] < mid[rows[:, 0]]) & (rows[:, 2] > mid[rows[:, 0]])]
    if not len(rows):
        return none
    # multiples of the smallest period give the same stretch
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, :3] != rows[:-1, :3]).any(axis=1)
    rows = rows[new]
    rows[:, 0] = big[rows[:, 0]]
    return rows


def _chosen(key: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Places of the pairs to replace: no more frequent pair overlaps them, nor they each other."""
    bits = max(8, int(len(key)).bit_length() + 1)
    cell = (mix(key.astype(np.uint64)) >> U(64 - bits)).astype(np.int64)
    count = np.bincount(cell[valid], minlength=1 << bits)[cell]
    rank = np.where(valid & (count > 1), (count << 32) | cell, 0)
    first = np.concatenate([[0], np.flatnonzero(rank[1:] != rank[:-1]) + 1])  # of every stretch of one pair
    top = rank[first]
    left = np.concatenate([[0], top[:-1]])
    right = np.concatenate([top[1:], [0]])
    peak = np.flatnonzero((top > left) & (top > right))
    size = np.diff(np.concatenate([first, [len(rank)]]))
    return np.repeat(first[peak], (size[peak] + 1) // 2) + 2 * ranges(np.zeros(len(peak), np.int64), (size[peak] + 1) // 2)


def runs(word: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Rows (start, end, period) of all runs; ``doc`` ascends, no run spans two of its values."""
    seq = Sequence(word)
    symbol, at, size, d = word.astype(np.int64), np.arange(len(word)), np.ones(len(word), np.int64), doc
    symbols = int(word.max()) + 1 if len(word) else 0
    found = []
    while len(symbol) > 1:  # Re-Pair
        key = symbol[:-1] * symbols + symbol[1:]
        chosen = _chosen(key, d[:-1] == d[1:])
        _, rule, count = np.unique(key[chosen], return_inverse=True, return_counts=True)
        often = count > 1
        chosen, number = chosen[often[rule]], (np.cumsum(often) - 1)[rule[often[rule]]]
        if len(chosen) * LEAST < len(symbol):
            break
        lead = np.empty(int(often.sum()), np.int64)
        lead[number[::-1]] = chosen[::-1]  # the first place of every rule
        r = crossing(seq, at[lead], at[lead + 1], at[lead + 1] + size[lead + 1])
        if len(r):
            order = np.argsort(number, kind="stable")
            begin = np.searchsorted(number[order], np.arange(len(lead) + 1))
            k = r[:, 0]
            n = begin[k + 1] - begin[k]
            place = at[chosen[order[ranges(begin[k], n)]]]
            row = np.repeat(np.arange(len(r)), n)
            shift = place - at[lead][k][row]
            found.append(np.stack([r[row, 1] + shift, r[row, 2] + shift, r[row, 3]], axis=1))
        symbol[chosen] = symbols + number
        symbols += len(lead)
        size[chosen] += size[chosen + 1]
        stay = np.ones(len(symbol), bool)
        stay[chosen + 1] = False
        symbol, at, size, d = symbol[stay], at[stay], size[stay], d[stay]
    while True:  # a balanced tree over what is left of each text
        edge = np.concatenate([[0], np.flatnonzero(d[1:] != d[:-1]) + 1]) if len(d) else np.empty(0, np.int64)
        inside = np.arange(len(d)) - np.repeat(edge, np.diff(np.concatenate([edge, [len(d)]])))
        left = np.flatnonzero((inside[:-1] % 2 == 0) & (d[:-1] == d[1:])) if len(d) else edge
        if not len(left):
            break
        r = crossing(seq, at[left], at[left + 1], at[left + 1] + size[left + 1])
        found.append(r[:, 1:])
        size[left] += size[left + 1]
        stay = np.ones(len(at), bool)
        stay[left + 1] = False
        at, size, d = at[stay], size[stay], d[stay]
    return _merged(np.concatenate(found) if found else np.empty((0, 3), np.int64), doc)


def _merged(rows: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The maximal ones of the intervals with equal period, by start and period."""
    if not len(rows):
        return rows
    rows = rows[np.lexsort((-rows[:, 1], rows[:, 0], rows[:, 2]))]
    # a larger period starts above all ends of smaller ones
    end = rows[:, 1] + rows[:, 2] * (len(doc) + 1)
    before = np.maximum.accumulate(np.concatenate([[-1], end[:-1]]))
    rows = rows[end > before]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def _batches(batches: Iterator[pa.RecordBatch], places: Callable | None):
    """(slice of the batch, bytes, start and length of every word, n + 1 word offsets, runs with starts in the batch)."""
    for batch in batches:
        for part in chunks(batch, limit=BATCH_BYTES):
            t = Texts(part.column("text"))
            start, length, doc = words(t.data, t.offsets)
            count = np.bincount(doc, minlength=t.n)
            edge = np.concatenate([np.zeros(1, np.int64), np.cumsum(count)])
            if places is not None:
                for i, key in enumerate(part.column("doc_id").to_pylist()):
                    if (to := places(key, int(count[i]))) is not None:
                        a, b = edge[i], edge[i + 1]
                        start[a:b], length[a:b] = start[a + to], length[a + to]
            number, _ = word_ids(t.data, start, length)
            yield part, t.data, start, length, edge, runs(number, doc)


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, runs) of every row; runs: (start, length, period) by start and period."""
    @per_task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, _, _, edge, r in _batches(batches, None):
            owner = np.searchsorted(edge, r[:, 0], "right") - 1
            fields = [pa.array(x) for x in (r[:, 0] - edge[owner], r[:, 1] - r[:, 0], r[:, 2])]
            at = pa.array(np.searchsorted(owner, np.arange(part.num_rows + 1)).astype(np.int32))
            lists = pa.ListArray.from_arrays(at, pa.StructArray.from_arrays(fields, fields=list(FOUND.field("runs").type.value_type)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], schema=FOUND)
        yield empty(FOUND)
    rows = docs.selectExpr("cast(doc_id as bigint) doc_id", "text")
    return rows.mapInArrow(run, "doc_id bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>")


def collapse(data: np.ndarray, start: np.ndarray, length: np.ndarray, edge: np.ndarray, r: np.ndarray) -> list[bytes]:
    """Every text's words joined by one space, of each run only the first period."""
    cover = np.zeros(len(start) + 1, np.int64)
    np.add.at(cover, r[:, 0] + r[:, 2], 1)
    np.add.at(cover, r[:, 1], -1)
    keep = np.cumsum(cover[:-1]) == 0
    s, n = start[keep], length[keep] + 1
    line = data[ranges(s, n)]
    line[np.cumsum(n) - 1] = 0x20
    line = line.tobytes()
    size = np.concatenate([np.zeros(1, np.int64), np.cumsum(n)])
    ends = size[np.concatenate([np.zeros(1, np.int64), np.cumsum(keep)])[edge]].tolist()
    return [line[a:max(a, b - 1)] for a, b in zip(ends, ends[1:])]


def collapsed(docs: DataFrame) -> DataFrame:
    """(doc_id, text): the words without repeats of a run's first period, joined by one space."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    @per_task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, start, length, edge, r in _batches(batches, None):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([x.decode() for x in collapse(data, start, length, edge, r)], pa.string())], schema=schema)
        yield empty(schema)
    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, "doc_id bigint, text string")


def digests(docs: DataFrame, places: Callable[[int | None, int], np.ndarray | None] | None = None) -> DataFrame:
    """Number of runs, the longest one, and hashes of all runs and of the collapsed
    text.  ``places(doc_id, n)`` may name other words of the text to stand at its n
    places; None leaves them."""
    @per_task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, start, length, edge, r in _batches(batches, places):
            owner = np.searchsorted(edge, r[:, 0], "right") - 1
            first, size, period = r[:, 0] - edge[owner], r[:, 1] - r[:, 0], r[:, 2]
            at = np.searchsorted(owner, np.arange(part.num_rows + 1))
            columns = [[] for _ in range(6)]
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                best = (None,) * 4
                if b > a:
                    k = a + int(np.lexsort((period[a:b], first[a:b], -size[a:b]))[0])
                    best = (int(first[k]), int(size[k]), int(period[k]), 1000 * int(size[k]) // int(period[k]))
                lines = "".join(f"{x},{y},{z}\n" for x, y, z in zip(first[a:b].tolist(), size[a:b].tolist(), period[a:b].tolist()))
                for c, v in zip(columns, (b - a, *best, hashlib.sha256(lines.encode()).hexdigest())):
                    c.append(v)
            text = [hashlib.sha256(x).hexdigest() for x in collapse(data, start, length, edge, r)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, f.type) for c, f in zip(columns, list(DIGEST)[1:])), pa.array(text, pa.string())], schema=DIGEST)
        yield empty(DIGEST)
    schema = "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"
    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, schema)
