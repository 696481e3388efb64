"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Seeds are the test items' runs of ``SEED_WORDS`` words that should hardly meet by chance: the product of the words'
corpus frequencies, times the corpus size, stays under ``CHANCE`` occurrences. Rarity is that of the words, not of
the run, so a passage copied into a third of the corpus stays rare. Seeds join passages of documents to items; the
passage around the seeds of one item is then aligned with the whole item, word by word, and its score is the
alignment's share of a perfect one. Copies with edited, missing or added words keep most of it.

Words are runs of letters and digits in lower case, so case, punctuation and line breaks do not hide a copy. Null or
empty texts match nothing; items shorter than a seed are matched as a whole. Rows and items with a repeated or null id
are judged one by one and reported once per (doc_id, item_id) pair with their best score. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netvigil.llm.common import parts, row_name, whole_text
from netvigil.session import materialize

SEED_WORDS = 3
CHANCE = 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
MIN_SCORE = 0.5
# Words that are used in seeds are sent to the tasks up to this many; beyond, items are taken in several rounds.
MAX_WORDS = 1 << 20

SCHEMA = "doc_id long, item_id long, score double, first_word int, end_word int"

_WORD = re.compile(r"[^\W_]+")


def tokens(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def align(passage: np.ndarray, item: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment score with its start and end (exclusive) in the passage, by one row per item word.

    The gap along a row is a running maximum, so each row is a few vector operations; starts travel with the scores.
    """
    n = len(passage)
    score, start = np.zeros(n + 1, np.int64), np.arange(n + 1)
    best = (0, 0, 0)
    place = np.arange(n + 1)
    for word in item:
        up, up_start = score + GAP, start
        diagonal = np.concatenate([[0], score[:-1] + np.where(passage == word, MATCH, MISMATCH)])
        diagonal_start = np.concatenate([[0], start[:-1]])
        take = diagonal >= up
        fresh = np.where(take, diagonal, up)
        origin = np.where(take, diagonal_start, up_start)
        origin = np.where(fresh > 0, origin, place)
        fresh = np.maximum(fresh, 0)
        # along the row: value at j is the best of fresh[k] + GAP * (j - k) for k <= j
        lifted = fresh - GAP * place
        run = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == run, place, 0))
        score, start = run + GAP * place, origin[source]
        start = np.where(score > 0, start, place)
        score = np.maximum(score, 0)
        at = int(score.argmax())
        if score[at] > best[0]:
            best = (int(score[at]), int(start[at]), at)
    return best


class Seeds:
    """Words of some items as numbers, and the table (key, item, place) of their rare runs."""

    def __init__(self, texts: list[str], counts: dict[str, int], total: int) -> None:
        self.word: dict[str, int] = {}
        items = [np.array([self.word.setdefault(w, len(self.word)) for w in tokens(t)], np.int64) for t in texts]
        frequency = np.ones(len(self.word))
        for w, i in self.word.items():
            frequency[i] = max(counts.get(w, 0), 1) / max(total, 1)
        self.table: list[tuple[int, int, int]] = []
        self.longest = max(map(len, items), default=0)
        for i, item in enumerate(items):
            width = min(SEED_WORDS, len(item))
            if not width:
                continue
            grams = np.lib.stride_tricks.sliding_window_view(item, width)
            rare = frequency[grams].prod(axis=1) * total < CHANCE
            if not rare.any():
                rare[:] = True  # an item of common words only keeps all its seeds
            keys = self._keys(item, width)
            self.table += [(int(keys[k]), i, int(k)) for k in np.flatnonzero(rare)]
        self.keys = np.unique(np.array([row[0] for row in self.table], np.int64))
        self.widths = sorted({min(SEED_WORDS, len(item)) for item in items} - {0})

    def _keys(self, words: np.ndarray, width: int) -> np.ndarray:
        key = np.zeros(len(words) - width + 1, np.int64)
        for k in range(width):
            key = key * (len(self.word) + 1) + words[k:k + len(key)] + 1
        return key

    def hits(self, found: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Places in a list of words where a seed stands, in order, and the seeds' keys."""
        doc = np.array([self.word.get(w, -1) for w in found], np.int64)
        ats, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for width in self.widths:
            if len(doc) < width:
                break
            known = doc[:len(doc) - width + 1] >= 0
            for k in range(1, width):
                known &= doc[k:k + len(known)] >= 0
            at = np.flatnonzero(known)
            key = self._keys(doc, width)[at]
            hit = self.keys[np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)] == key
            ats.append(at[hit])
            keys.append(key[hit])
        at, key = np.concatenate(ats), np.concatenate(keys)
        order = np.argsort(at, kind="stable")
        return at[order], key[order]


def _spare(length: int) -> int:
    return length // 2 + 2


def _word_counts(docs: DataFrame, wanted: set[str]) -> tuple[dict[str, int], int]:
    """Corpus counts of the wanted words, and the corpus size in words."""
    sent = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        total = 0
        for batch in (p for b in batches for p in parts(b)):
            for text in batch.column(0).to_pylist():
                found = tokens(text)
                total += len(found)
                held.update(filter(sent.value.__contains__, found))
        yield pa.RecordBatch.from_arrays([pa.array([*held, None], pa.string()), pa.array([*held.values(), total], pa.int64())],
                                         names=["word", "n"])

    rows = docs.select(whole_text().alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(
        F.sum("n").alias("n")).collect()  # at most one row per wanted word
    counts = {r["word"]: r["n"] for r in rows}
    return counts, counts.pop(None, 0)


def _rounds(items: DataFrame) -> Iterator[list]:
    """Items in groups whose words stay under MAX_WORDS."""
    held, size = [], 0
    for row in items.toLocalIterator():
        n = len(row["text"]) // 2 + 1
        if held and size + n > MAX_WORDS:
            yield held
            held, size = [], 0
        held.append(row)
        size += n
    if held:
        yield held


def _passages(source: DataFrame, seeds: Seeds) -> DataFrame:
    """Stretches of documents around seeds: passage, doc_id, first_word, words, and the seeds' keys and places in it."""
    sent = source.sparkSession.sparkContext.broadcast(seeds)
    reach = seeds.longest + _spare(seeds.longest)
    names = ["passage", "doc_id", "first_word", "words", "keys", "places"]
    types = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in parts(b)):
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = tokens(text)
                at, key = sent.value.hits(found)
                if not len(at):
                    continue
                cuts = np.flatnonzero(np.diff(at) > 2 * reach) + 1
                name = f"{doc_id}:{hashlib.md5(text.encode()).hexdigest()}"
                for places, keys in zip(np.split(at, cuts), np.split(key, cuts), strict=True):
                    low = max(int(places[0]) - reach, 0)
                    out.append((f"{name}:{low}", doc_id, low, " ".join(found[low:int(places[-1]) + reach + SEED_WORDS]),
                                keys.tolist(), (places - low).tolist()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)],
                                                 names=names)

    return source.mapInArrow(run, "passage string, doc_id long, first_word int, words string, keys array<long>, places array<int>")


def _aligned(pairs: DataFrame, min_score: float) -> DataFrame:
    """Align each pair's stretch of the passage with its item; keep scores of ``min_score`` or more."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in parts(b)):
            out = []
            for r in batch.to_pylist():
                item, words = r["item_words"].split(" "), r["words"].split(" ")
                low = max(r["low"] - _spare(len(item)), 0)
                part = words[low:r["high"] + len(item) + _spare(len(item))]
                number = {w: i for i, w in enumerate(dict.fromkeys(item))}
                score, start, end = align(np.array([number.get(w, -1) for w in part], np.int64),
                                          np.array([number[w] for w in item], np.int64))
                share, first = score / (MATCH * len(item)), r["first_word"] + low
                if share >= min_score:
                    out.append((r["doc_id"], r["item_id"], share, first + start, first + end))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)],
                                                 names=["doc_id", "item_id", "score", "first_word", "end_word"])

    return pairs.mapInArrow(run, SCHEMA)


def matches(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """doc_id, item_id, score, first_word, end_word: every document holding a copy of an item, once per pair."""
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))
    items = benchmark.select(F.col("item_id").cast("long"), whole_text().alias("text")).where(F.col("text") != "")
    out = spark.createDataFrame([], SCHEMA)
    for rows in _rounds(items):
        counts, total = _word_counts(source, {w for r in rows for w in tokens(r["text"])})
        seeds = Seeds([r["text"] for r in rows], counts, total)
        if not seeds.table:
            continue
        table = spark.createDataFrame(seeds.table, "key long, item int, place int")
        named = spark.createDataFrame([(i, r["item_id"], " ".join(tokens(r["text"]))) for i, r in enumerate(rows)],
                                      "item int, item_id long, item_words string")
        found = materialize(_passages(source, seeds), "passages")
        hits = found.select("passage", F.explode(F.arrays_zip("keys", "places")).alias("hit")).select(
            "passage", F.col("hit.keys").alias("key"), F.col("hit.places").alias("at"))
        at = F.col("at") - F.col("place")
        pairs = hits.join(table, "key").groupBy("passage", "item").agg(F.min(at).alias("low"), F.max(at).alias("high"))
        whole = found.select("passage", "doc_id", "first_word", "words").dropDuplicates(["passage"])
        out = out.unionByName(_aligned(pairs.join(whole, "passage").join(named, "item"), min_score))
    best = F.max(F.struct("score", "first_word", "end_word"))
    return out.groupBy("doc_id", "item_id").agg(best.alias("best")).select("doc_id", "item_id", "best.*")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows that hold no match. Rows are told apart by id and text, so one without an id goes like any other."""
    marked = docs.withColumn("_row", row_name())
    hits = materialize(matches(marked.select(F.col("_row").alias("doc_id"), "text"), benchmark, min_score).select(
        F.col("doc_id").alias("_row")).distinct(), "hits")
    return marked.join(hits, "_row", "left_anti").drop("_row")
