"""Toxicity by two class-conditional Kneser-Ney models over shared backoff counts.

An expression is a word, spelled letter by letter (the first ``DEPTH`` letters, then an end mark for words that short). Each
class (toxic, ordinary) has a Kneser-Ney model of the next letter after the whole beginning of a word: of each count, that
is in how many of the class's documents a continuation stands, a discount by its size (1, 2, 3 and more) is taken away, and
what the discounts free goes to the lower order. The lower order is a continuation count as Kneser-Ney has it, the number of
different words that go on that way, and it is shared: both classes take it from all words of the whole corpus. So a
beginning seen in neither class has the same probability in both, and a rare word is judged by its beginning.

The log-likelihood ratio of a word sums those of its letters. A document's ratios are normalised by length twice: over its
worst passage of ``WINDOW`` words (or the whole of a shorter text), and over its ``WORST`` worst different words. A logistic
curve turns the two into a score. It is fitted on one training row in ``APART``, read by models that leave those rows out.

All labelled rows are learned from. Counts, discounts and probabilities are Spark tables, and the curve is fitted on sums
that Spark takes. What the tasks get of the model is one number per beginning of a labelled word, as two sorted arrays, for
the ``TABLE`` most frequent beginnings at most. The others are joined: a document's beginnings that go on where the sent ones
end meet the table of the rest by a shuffle, and come back as a short list next to its text. So every beginning counts, and
the memory of a task is the same whatever the corpus.

Null or empty texts have ratio zero and get the curve's value there. Without rows of both classes the score
is the share of label 1 among the training rows (0 if none). Rows with a null or repeated id are scored one by
one; labels with a null id or value are ignored, an id labelled twice counts as its larger label. Extra
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netvigil.llm.common import parts, row_name, whole_text
from netvigil.session import materialize

TABLE = 1 << 22            # beginnings that are sent to the tasks (50 MB); the rest is joined
DEPTH = 8                  # letters of a word that are spelled
END = "$"
DISCOUNTS = (0.95, 1.6, 2.0)   # of counts 1, 2, 3 and more
UNSEEN = 0.5               # added to the number of words that go on with a letter, as if of LETTERS letters
LETTERS = 30
WINDOW = 16
WORST = 3
APART = 3
THRESHOLD = 0.3

FEATURES = ("passage", "word")

_WORD = re.compile(r"\w+")
_CLASSES = ("toxic", "ordinary")


class Model(NamedTuple):
    """Ratios by beginning, sorted by its hash."""

    keys: np.ndarray
    ratios: np.ndarray


def tokens(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def spelled(word: str) -> str:
    return word + END if len(word) <= DEPTH else word[:DEPTH]


# --- fitting, as Spark tables ---------------------------------------------------------------------

def _words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)(\w+)"), 1))


def _beginnings(word: Column) -> Column:
    """All beginnings of the spelled word, the empty one left out."""
    path = F.when(F.length(word) <= DEPTH, F.concat(word, F.lit(END))).otherwise(F.substring(word, 1, DEPTH))
    return F.transform(F.sequence(F.lit(1), F.length(path)), lambda i: F.substring(path, 1, i))


def _discount(n: Column) -> Column:
    return F.when(n <= 0, 0.0).when(n == 1, DISCOUNTS[0]).when(n == 2, DISCOUNTS[1]).otherwise(DISCOUNTS[2])


def class_counts(labelled: DataFrame) -> DataFrame:
    """Per beginning of the words in ``labelled`` (text, label, apart): in each class, of the rows kept apart and of the
    others, how many (document, word) hold it."""
    rows = labelled.select("label", "apart", F.explode(_words(F.col("text"))).alias("word"))
    cells = {f"{c}_{side}": (F.col("label") == int(c == "toxic")) & (F.col("apart") == (side == "apart"))
             for c in _CLASSES for side in ("apart", "other")}
    words = rows.groupBy("word").agg(*[F.count_if(hit).alias(name) for name, hit in cells.items()])
    return words.select(F.explode(_beginnings(F.col("word"))).alias("node"), *cells).groupBy("node").agg(
        *[F.sum(name).alias(name) for name in cells])


def shared_counts(corpus: DataFrame) -> DataFrame:
    """Per beginning: how many different words of the whole corpus have it (the empty beginning: all words)."""
    words = corpus.select(F.explode(_words(F.col("text"))).alias("word")).distinct()
    return words.select(F.explode(F.concat(F.array(F.lit("")), _beginnings(F.col("word")))).alias("node")).groupBy("node").agg(
        F.count(F.lit(1)).alias("words"))


def letter_ratios(counts: DataFrame, shared: DataFrame) -> DataFrame:
    """node, its count ``n`` and the log-ratio of its last letter after the rest: ``whole``, and ``partly`` without the rows
    kept apart."""
    sides = {"whole": ("apart", "other"), "partly": ("other",)}
    named = counts.select("node", F.substring("node", 1, F.length("node") - 1).alias("before"),
                          *[sum((F.col(f"{c}_{x}") for x in used), F.lit(0)).alias(f"{c}_{m}") for c in _CLASSES for m, used in sides.items()])
    cells = [f"{c}_{m}" for c in _CLASSES for m in sides]
    sums = named.groupBy("before").agg(*[F.sum(x).alias(f"all_{x}") for x in cells],
                                       *[F.sum(_discount(F.col(x))).alias(f"free_{x}") for x in cells])
    words = shared.select("node", "words")
    joined = named.join(sums, "before").join(words, "node", "left").join(
        words.select(F.col("node").alias("before"), F.col("words").alias("words_before")), "before", "left")
    lower = (F.coalesce("words", F.lit(0)) + UNSEEN) / (F.coalesce("words_before", F.lit(0)) + UNSEEN * LETTERS)

    def p(x: str) -> Column:
        own = (F.col(x) - _discount(F.col(x)) + F.col(f"free_{x}") * lower) / F.col(f"all_{x}")
        return F.when(F.col(f"all_{x}") > 0, own).otherwise(lower)

    met = sum((F.col(f"{c}_whole") for c in _CLASSES), F.lit(0)).alias("n")
    return joined.select("node", met, *[F.log(p(f"toxic_{m}") / p(f"ordinary_{m}")).alias(m) for m in sides])


def word_beginnings(labelled: DataFrame, corpus: DataFrame) -> DataFrame:
    """key (the hash of a beginning), its count ``n``, and by model the sum of its letters' ratios. ``labelled``: text, label,
    apart; ``corpus``: text."""
    steps = materialize(letter_ratios(materialize(class_counts(labelled), "counts"), materialize(shared_counts(corpus), "shared")), "steps")
    path = steps.select("node", "n", F.explode(F.transform(F.sequence(F.lit(1), F.length("node")), lambda i: F.substring("node", 1, i))).alias("part"))
    letters = steps.select(F.col("node").alias("part"), "whole", "partly")
    return path.join(letters.hint("merge"), "part").groupBy("node").agg(
        F.max("n").alias("n"), *[F.sum(m).cast("float").alias(m) for m in ("whole", "partly")]).select(
        F.xxhash64("node").alias("key"), "n", "whole", "partly")


def split_by_count(beginnings: DataFrame, size: int) -> tuple[DataFrame, DataFrame | None]:
    """The most frequent beginnings, ``size`` at most, and the others (None without any).

    A beginning is at least as frequent as what goes on from it, so the first part holds the beginnings of all it holds.
    """
    step = F.floor(F.log2(F.greatest(F.col("n"), F.lit(1))) * 8)
    sizes = sorted(((r["step"], r["count"]) for r in beginnings.groupBy(step.alias("step")).count().collect()), reverse=True)  # 512 rows at most
    held, least = 0, None
    for at, n in sizes:
        if held + n > size:
            break
        held, least = held + n, at
    if held == sum(n for _, n in sizes):
        return beginnings, None
    frequent = F.lit(False) if least is None else step >= least
    return beginnings.where(frequent), beginnings.where(~frequent)


def model_of(beginnings: DataFrame, column: str = "whole") -> Model:
    """The arrays that tasks get, 12 bytes a beginning."""
    got = beginnings.select("key", column).toArrow()
    return _sorted(got.column("key").to_numpy(), got.column(column).to_numpy())


def _sorted(keys: np.ndarray, values: np.ndarray) -> Model:
    keys, first = np.unique(keys, return_index=True)
    return Model(keys, values[first])


# --- reading --------------------------------------------------------------------------------------

def _found(model: Model, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which hashes the model knows, and where."""
    if not len(model.keys):
        return np.zeros(len(hashes), bool), np.zeros(len(hashes), np.int64)
    at = np.minimum(np.searchsorted(model.keys, hashes), len(model.keys) - 1)
    return model.keys[at] == hashes, at


def looked_up(words: list[str], *models: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ratio of each word: that of its longest beginning known to any model, zero without one. Also the beginnings longer than
    that: the word's place and the key."""
    out, left = np.zeros(len(words), np.float32), np.arange(len(words))
    paths, missed = [spelled(w) for w in words], [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for size in range(DEPTH + 1, 0, -1):
        here = np.array([i for i in left.tolist() if len(paths[i]) >= size], np.int64)
        if not len(here):
            continue
        hashes = np.array([xxhash.xxh64_intdigest(paths[i][:size].encode(), 42) for i in here.tolist()], np.uint64).view(np.int64)
        fresh = np.ones(len(here), bool)
        for model in models:
            known, at = _found(model, hashes)
            out[here[known]] = model.ratios[at[known]]
            fresh &= ~known
        missed.append((here[fresh], hashes[fresh]))
        left = np.setdiff1d(left, here[~fresh], assume_unique=True)
    return out, *map(np.concatenate, zip(*missed, strict=True))


def word_ratios(model: Model, words: list[str]) -> np.ndarray:
    """Ratio of each word: that of its longest known beginning, zero without one."""
    return looked_up(words, model)[0]


def ratios(x: np.ndarray, distinct: np.ndarray) -> tuple[float, float]:
    """Mean ratio of the worst passage of WINDOW words, and of the WORST worst different words."""
    if not len(x):
        return 0.0, 0.0
    sums = np.concatenate([[0.0], np.cumsum(x, dtype=np.float64)])
    size = min(WINDOW, len(x))
    return float((sums[size:] - sums[:-size]).max() / size), float(np.sort(distinct)[-WORST:].mean())


def _numbered(texts: list[str]) -> tuple[list[str], list[np.ndarray]]:
    """The different words of some texts, and each text as their numbers."""
    ids: dict[str, int] = {}
    read = [np.array([ids.setdefault(w, len(ids)) for w in tokens(t)], np.int64) for t in texts]
    return list(ids), read


def _rest_by_row(rows: DataFrame, sent: Broadcast, rest: DataFrame, column: str) -> DataFrame:
    """row_name, and the keys and ratios of the beginnings of its words that stand in ``rest``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in parts(b, 100)):
            words, read = _numbered(batch.column(0).to_pylist())
            _, place, keys = looked_up(words, sent.value)
            order = np.argsort(place, kind="stable")
            keys, ends = keys[order], np.searchsorted(place[order], np.arange(len(words) + 1))
            asked = [np.concatenate([np.zeros(0, np.int64), *(keys[ends[w]:ends[w + 1]] for w in np.unique(at).tolist())]) for at in read]
            names = np.repeat(batch.column(1).to_numpy(), [len(k) for k in asked])
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(np.concatenate(asked), pa.int64())], names=["row_name", "key"])

    asked = rows.select("text", "row_name").mapInArrow(run, "row_name long, key long")
    met = asked.join(rest.select("key", F.col(column).alias("ratio")).hint("merge"), "key")
    return met.groupBy("row_name").agg(F.collect_set(F.struct("key", "ratio")).alias("rest")).select(
        "row_name", F.col("rest.key").alias("keys"), F.col("rest.ratio").alias("ratios"))


def features(docs: DataFrame, beginnings: DataFrame, column: str = "whole", size: int = TABLE) -> DataFrame:
    """doc_id, row_name and FEATURES of every row of ``docs`` (doc_id, text) by the model in ``column``."""
    frequent, rest = split_by_count(beginnings, size)
    sent = docs.sparkSession.sparkContext.broadcast(model_of(frequent, column))
    rows = docs.select("doc_id", "text", row_name().alias("row_name"))
    if rest is not None:
        found = _rest_by_row(rows, sent, rest, column)
        rows = rows.join(found.hint("merge"), "row_name", "left").select("doc_id", "text", "row_name", "keys", "ratios")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in parts(b, 100)):
            words, read = _numbered(batch.column(1).to_pylist())
            models = [sent.value]
            if batch.num_columns > 3:
                models.append(_sorted(*(batch.column(i).flatten().to_numpy() for i in (3, 4))))
            of = looked_up(words, *models)[0]
            table = np.array([ratios(of[at], of[np.unique(at)]) for at in read], float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *map(pa.array, table.T.copy())], names=["doc_id", "row_name", *FEATURES])

    return rows.mapInArrow(run, "doc_id long, row_name long, passage double, word double")


def _sums(rows: DataFrame, columns: list[Column]) -> np.ndarray:
    """Sums that do not depend on the order of the rows."""
    got = rows.agg(*[F.sum(c.cast("decimal(28,12)")) for c in columns]).first()
    return np.array([float(x or 0) for x in got])


def fit_curve(rows: DataFrame, ridge: float = 0.1) -> np.ndarray:
    """Intercept and weights of a ridge logistic regression of ``label`` on standardised FEATURES, in raw units: Newton's steps
    over sums taken by Spark."""
    n = rows.count()
    mean = _sums(rows, [F.col(f) for f in FEATURES]) / n
    scale = np.maximum(np.sqrt(_sums(rows, [(F.col(f) - float(m)) ** 2 for f, m in zip(FEATURES, mean, strict=True)]) / n), 1e-9)
    z = [F.lit(1.0), *[(F.col(f) - float(m)) / float(s) for f, m, s in zip(FEATURES, mean, scale, strict=True)]]
    k = len(z)
    w, penalty = np.zeros(k), ridge * np.diag([1e-6] + [1.0] * (k - 1))
    cells = [(i, j) for i in range(k) for j in range(i, k)]
    for _ in range(50):
        margin = sum((F.lit(float(a)) * x for a, x in zip(w, z, strict=True)), F.lit(0.0))
        p = 1 / (1 + F.exp(-F.greatest(F.least(margin, F.lit(30.0)), F.lit(-30.0))))
        got = _sums(rows, [(F.col("label") - p) * x for x in z] + [(p * (1 - p) + 1e-9) * z[i] * z[j] for i, j in cells])
        curved = np.zeros((k, k))
        for (i, j), value in zip(cells, got[k:], strict=True):
            curved[i, j] = curved[j, i] = value
        step = np.linalg.solve(curved + penalty, got[:k] - penalty @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    raw = w[1:] / scale
    return np.concatenate([[w[0] - raw @ mean], raw])


def score(docs: DataFrame, labels: DataFrame, train: Column, label: str = "toxic", named: bool = False, size: int = TABLE) -> DataFrame:
    """doc_id and score (0 to 1) of every row, with its ``row_name`` if ``named``. ``train`` says which rows of ``labels`` may
    be learned from; all of those are. ``size``: how many beginnings are sent to the tasks at most."""
    out = ["doc_id", *(["row_name"] if named else [])]
    known = materialize(labels.where(train & F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy(
        F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("label")), "labels")
    apart = (F.pmod(F.xxhash64("doc_id"), F.lit(APART)) == 0).alias("apart")
    source = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))
    labelled = materialize(source.join(known, "doc_id").select("doc_id", "text", "label", apart), "labelled")
    sides = {r["apart"]: r["n"] for r in labelled.groupBy("apart").agg(F.count_distinct("label").alias("n")).collect()}
    if labelled.agg(F.count_distinct("label")).first()[0] == 2:
        beginnings = materialize(word_beginnings(labelled, source), "beginnings")
        # with both classes on both sides the curve is fitted on the rows kept apart, else on all of them
        split = sides.get(False) == 2 and sides.get(True) == 2
        read = features(labelled.where("apart") if split else labelled, beginnings, "partly" if split else "whole", size)
        rows = materialize(read.join(known, "doc_id").select(*FEATURES, "label"), "curve")
        start, *weights = map(float, fit_curve(rows))
        margin = sum((F.lit(w) * F.col(f) for w, f in zip(weights, FEATURES, strict=True)), F.lit(start))
        return features(source, beginnings, size=size).select(*out, (1 / (1 + F.exp(-margin))).alias("score"))
    share = known.agg(F.avg("label")).first()[0]
    return source.select("doc_id", row_name().alias("row_name"), F.lit(float(share or 0.0)).alias("score")).select(*out, "score")
