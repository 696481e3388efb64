"""Periodic runs of words in a text, found by a harmonic grid of longest-common-extension queries.

A run is a stretch of words with smallest period q, at least ``max(MIN_WORDS, MIN_POWER * q)`` words long, that no
neighbouring word extends. In a run of period p the places i with ``w[i] == w[i + p]`` form a stretch of at least
``max(MIN_WORDS, MIN_POWER * p) - p`` places, so a grid of that step meets every run; over all periods the grids have
O(n log n) places (a harmonic sum). From each place where the words agree, the agreement is extended to the right and to
the left by longest-common-extension (LCE) queries; what is long enough is a run. A stretch found again under a multiple
of its smallest period has the same ends, since both periods divide it evenly.

LCE queries use a difference cover modulo V: only suffixes at places whose remainder is in the cover are sorted. For any
two places there is a shift below V that takes both into the cover, so a query compares those few words, and then asks
for the least common-prefix length between two sorted samples (a sparse table). Samples are sorted by naming blocks of V
words, then doubling over the sequence of blocks; the doubled names also give the common prefixes of neighbours.

Spark deals the documents to tasks; inside a task short documents are searched together, put end to end with words of
their own between them, in slices of ``SLICE_WORDS`` words. A document is always whole.

A null text has no words. Repeated rows and rows that share an id are judged one by one. Extra columns are ignored, an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netvigil.llm.common import parts, whole_text

MIN_WORDS = 6
MIN_POWER = 4
SLICE_WORDS = 40_000
QUERIES_AT_ONCE = 1 << 15
GRID_AT_ONCE = 1 << 20
# A perfect difference set: every remainder modulo V is the difference of two of its members.
V, COVER = 31, (1, 5, 11, 24, 25, 27)


class Run(NamedTuple):
    start: int
    length: int
    period: int


def _shifts() -> np.ndarray:
    """[i mod V, j mod V]: the least shift that takes both places into the cover."""
    member = np.isin(np.arange(V), COVER)
    out = np.full((V, V), V)
    for shift in reversed(range(V)):
        hit = np.roll(member, -shift)
        out[np.ix_(hit, hit)] = shift
    return out


SHIFT = _shifts()


class Extension:
    """Longest common extensions to the right of two places of a word sequence (positive ints)."""

    def __init__(self, words: np.ndarray) -> None:
        self.n = n = len(words)
        self.words = np.concatenate([words, np.zeros(2 * V, words.dtype)])
        # samples, remainder class after class; one beyond the end closes each class
        classes = [np.arange(c, n + V, V) for c in COVER]
        self.places = np.concatenate(classes)
        m = len(self.places)
        self.number = np.full(n + 2 * V, -1)
        self.number[self.places] = np.arange(m)
        after = np.arange(1, m + 1)
        after[np.cumsum([len(c) for c in classes]) - 1] = m
        padded = np.concatenate([self.words, np.zeros(V, words.dtype)])
        self.blocks = np.lib.stride_tricks.sliding_window_view(padded, V)
        names = np.ascontiguousarray(self.blocks[self.places].astype(">u4")).view(f"V{4 * V}").ravel()
        rank = np.append(np.unique(names, return_inverse=True)[1].ravel() + 1, 0)
        levels, step = [(rank, np.append(after, m))], 1
        while step < max(map(len, classes)):
            rank, jump = levels[-1]
            both = rank.astype(np.int64) * (m + 2) + rank[jump]
            levels.append((np.unique(both, return_inverse=True)[1].ravel(), jump[jump]))
            step *= 2
        order = np.argsort(levels[-1][0][:m], kind="stable")
        self.rank = np.empty(m, np.int64)
        self.rank[order] = np.arange(m)
        self.table = [self._neighbours(order, levels, m)]
        width = 1
        while 2 * width < m:
            last = self.table[-1]
            self.table.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def _neighbours(self, order: np.ndarray, levels: list, m: int) -> np.ndarray:
        """Common prefix, in words, of each sorted sample and the next one: equal blocks by doubling, then the block that differs."""
        a, b, same = order[:-1].copy(), order[1:].copy(), np.zeros(max(m - 1, 0), np.int64)
        for k in reversed(range(len(levels))):
            rank, jump = levels[k]
            equal = (rank[a] == rank[b]) & (a < m) & (b < m)
            same += equal * (V << k)
            a, b = np.where(equal, jump[a], a), np.where(equal, jump[b], b)
        inside = (a < m) & (b < m)
        for at in range(0, len(a), QUERIES_AT_ONCE):
            part = np.flatnonzero(inside[at:at + QUERIES_AT_ONCE]) + at
            differ = self.blocks[self.places[a[part]]] != self.blocks[self.places[b[part]]]
            same[part] += np.where(differ.any(axis=1), differ.argmax(axis=1), V)
        return same

    def lce(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words common to the sequence from ``i`` on and from ``j`` on, i < j <= n."""
        out = np.empty(len(i), np.int64)
        for at in range(0, len(i), QUERIES_AT_ONCE):
            out[at:at + QUERIES_AT_ONCE] = self._lce(i[at:at + QUERIES_AT_ONCE], j[at:at + QUERIES_AT_ONCE])
        return out

    def _lce(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        shift = SHIFT[i % V, j % V]
        width = int(shift.max(initial=0))
        got = shift.copy()
        if width:
            near = np.arange(width)
            differ = (self.blocks[i][:, :width] != self.blocks[j][:, :width]) & (near < shift[:, None])
            got = np.where(differ.any(axis=1), differ.argmax(axis=1), shift)
        far = np.flatnonzero((got == shift) & (j + shift < self.n))
        x, y = (self.rank[self.number[k[far] + shift[far]]] for k in (i, j))
        low, high = np.minimum(x, y), np.maximum(x, y)
        level = np.frexp(np.maximum(high - low, 1))[1] - 1
        least = np.empty(len(far), np.int64)
        for k in np.unique(level):
            at = level == k
            t = self.table[k]
            least[at] = np.minimum(t[low[at]], t[high[at] - (1 << k)])
        got[far] += least
        return np.minimum(got, self.n - j)


def _grid(starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and periods of the harmonic grids of documents that lie at ``starts`` with ``sizes`` words, in pieces."""
    starts, sizes = starts[sizes >= MIN_WORDS], sizes[sizes >= MIN_WORDS]
    periods = np.maximum(sizes // MIN_POWER, 1)
    first, size = np.repeat(starts, periods), np.repeat(sizes, periods)
    p = np.arange(len(first)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    step = np.maximum(MIN_WORDS, MIN_POWER * p) - p
    # a stretch of ``step`` agreeing places holds one of step - 1, 2 * step - 1, ...
    count = np.maximum((size - p) // step, 0)
    for part in np.array_split(np.arange(len(p)), count.sum() // GRID_AT_ONCE + 1):
        k = np.arange(count[part].sum()) - np.repeat(np.cumsum(count[part]) - count[part], count[part]) + 1
        yield np.repeat(first[part], count[part]) + k * np.repeat(step[part], count[part]) - 1, np.repeat(p[part], count[part])


def find_runs(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Rows (start, length, period), by start and period, of all runs of the documents in ``words``.

    Neighbouring documents must be told apart by a word of their own between them.
    """
    alike = [(i[same], p[same]) for i, p in _grid(starts, sizes) for same in [words[i] == words[i + p]]]
    i, p = (np.concatenate(c) for c in zip(*alike, strict=True))
    if not len(i):
        return np.empty((0, 3), np.int64)
    n = len(words)
    right = Extension(words).lce(i, i + p)
    left = Extension(words[::-1].copy()).lce(n - i - p, n - i)
    start, length = i - left, left + right + p
    long = length >= np.maximum(MIN_WORDS, MIN_POWER * p)
    found = np.unique(np.column_stack([start[long], length[long], p[long]]), axis=0)
    if len(found):  # of equal ends, the least period
        found = found[np.append(True, (found[1:, :2] != found[:-1, :2]).any(axis=1))]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def runs_of(docs: list[list[bytes]]) -> list[list[Run]]:
    """Runs of each document, by start, then period."""
    ids: dict[bytes, int] = {}
    coded, starts, at = [], [], 0
    for k, words in enumerate(docs):
        coded += [ids.setdefault(w, len(ids) + len(docs) + 1) for w in words]
        coded.append(k + 1)
        starts.append(at)
        at += len(words) + 1
    first = np.array(starts, np.int64)
    rows = find_runs(np.array(coded, np.uint32), first, np.array([len(d) for d in docs], np.int64))
    out: list[list[Run]] = [[] for _ in docs]
    for owner, (start, length, period) in zip(np.searchsorted(first, rows[:, 0], "right") - 1, rows.tolist(), strict=True):
        out[owner].append(Run(start - starts[owner], length, period))
    return out


def strongest(runs: list[Run]) -> Run | None:
    """The run with the greatest length / period; ties: least start, then period."""
    best = None
    for run in runs:
        if best is None or run.length * best.period > best.length * run.period:
            best = run
    return best


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for run in runs:
        edge[run.start + run.period] += 1
        edge[run.start + run.length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The contract's repetition: every tenth document, by the checksum of its id, ends in a repeated stretch."""
    h = zlib.crc32(b"" if doc_id is None else b"%d" % doc_id)
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


FIELDS = (("doc_id", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()),
          ("exponent_milli", pa.int64()), ("runs", pa.list_(pa.list_(pa.int64()))), ("collapsed", pa.string()))


def _told(ids: list, docs: list[list[bytes]]) -> pa.RecordBatch:
    rows = []
    for doc_id, words, runs in zip(ids, docs, runs_of(docs), strict=True):
        best = strongest(runs)
        rows.append((doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best.length // best.period, list(map(list, runs)),
                     b" ".join(collapsed(words, runs)).decode()))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), FIELDS, strict=True)],
                                      names=[n for n, _ in FIELDS])


def periodic_runs(docs: DataFrame, change: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """Of every row: doc_id, n_runs, the strongest run (start, length, period, exponent_milli; null without runs),
    ``runs`` (start, length, period of each, by start, then period) and ``collapsed`` (the words kept, one blank between).

    ``change`` may alter a document's words before the search.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in parts(b, 100)):
            ids, held, size = [], [], 0
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                words = text.as_py().split()  # bytes: splits at the six ASCII blanks only
                doc_id = doc_id.as_py()
                words = change(doc_id, words) if change else words
                if ids and size + len(words) > SLICE_WORDS:
                    yield _told(ids, held)
                    ids, held, size = [], [], 0
                ids.append(doc_id)
                held.append(words)
                size += len(words)
            if ids:
                yield _told(ids, held)

    return docs.select(F.col("doc_id").cast("long"), whole_text().cast("binary").alias("text")).mapInArrow(
        run, "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
             "runs array<array<bigint>>, collapsed string")
