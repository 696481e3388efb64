"""Classifiers, outliers and shards: held-out accuracy, exact counts, laws and edge cases."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from netvigil.llm import outliers, quality, sharding, textstats, toxicity
from netvigil.llm.common import fold

SF_DIR = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, score double, n_words string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, 0.5, "clash") for i, t, lang, source in rows], DOCS)


def read(spark, name):
    return spark.read.parquet(f"{SF_DIR}/{name}.parquet")


def held_out_auc(spark, scores, label, parts, held):
    rows = scores.join(read(spark, "labels"), "doc_id").where(fold(parts) == held).select("score", label).collect()
    good, bad = ([r[0] for r in rows if r[1] == k] for k in (1, 0))
    return np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])


def test_fold_is_crc32(spark):
    rows = spark.createDataFrame([(0,), (12,), (-7,), (None,)], "doc_id long").select("doc_id", fold(5).alias("f")).collect()
    assert [r["f"] for r in rows] == [zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 5 for r in rows]


def test_toxicity_held_out(spark):
    scores = toxicity.score(read(spark, "documents"), read(spark, "labels"), fold(4) != 2)
    assert scores.count() == read(spark, "documents").count()
    assert held_out_auc(spark, scores, "toxic", 4, 2) > 0.9


def test_quality_held_out(spark):
    scores = quality.score(read(spark, "documents"), read(spark, "labels"), fold(5) != 0)
    assert scores.count() == read(spark, "documents").count()
    assert held_out_auc(spark, scores, "quality", 5, 0) > 0.95


@pytest.mark.parametrize("model,label", [(toxicity, "toxic"), (quality, "quality")])
def test_scores_without_two_classes(spark, model, label):
    docs = frame(spark, [(1, "a b c", "en", "s"), (None, None, None, None), (1, "", "en", "s")])
    labels = spark.createDataFrame([(1, 1), (None, 0), (2, None)], f"doc_id long, {label} int")
    got = model.score(docs, labels, F.lit(True), label).collect()
    assert sorted((str(r["doc_id"]), r["score"]) for r in got) == [("1", 1.0), ("1", 1.0), ("None", 1.0)]
    none = model.score(docs, labels.limit(0), F.lit(True), label).collect()
    assert [r["score"] for r in none] == [0.0] * 3
    assert model.score(docs.limit(0), labels, F.lit(True), label).count() == 0


def test_labels_outside_the_fold_change_nothing(spark):
    docs, labels = read(spark, "documents"), read(spark, "labels")
    flipped = labels.withColumn("toxic", F.when(fold(4) == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = ({r["doc_id"]: r["score"] for r in toxicity.score(docs, x, fold(4) != 2).collect()} for x in (labels, flipped))
    assert one == two


def test_toxicity_learns_from_every_label(spark, monkeypatch):
    """No bound of the labelled rows and none of the beginnings: what is not sent to the tasks is joined, with equal scores."""
    assert not hasattr(toxicity, "MAX_LABELS")
    monkeypatch.setattr("netvigil.llm.common.bounded_labels", None)
    docs, labels = read(spark, "documents"), read(spark, "labels")
    docs = docs.unionByName(docs.limit(3)).unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    whole, few, none = (sorted((str(r["doc_id"]), r["score"]) for r in toxicity.score(docs, labels, fold(4) != 2, size=size).collect())
                        for size in (1 << 30, 300, 0))
    assert len(whole) == docs.count()
    assert [d for d, _ in few] == [d for d, _ in none] == [d for d, _ in whole]
    assert [s for _, s in few] == pytest.approx([s for _, s in whole], abs=1e-12)
    assert [s for _, s in none] == pytest.approx([s for _, s in whole], abs=1e-12)


def brute_letter_ratios(rows, corpus, left_out=None):
    """The class models' letter ratios from plain counts: rows (label, apart, text)."""
    import math

    def beginnings(word):
        path = word + "$" if len(word) <= 8 else word[:8]
        return [path[:i] for i in range(1, len(path) + 1)]

    counts = [Counter(), Counter()]
    nodes = {b for _, _, t in rows for w in toxicity.tokens(t) for b in beginnings(w)}
    for label, apart, text in rows:
        if apart != left_out:
            counts[label].update(b for w in set(toxicity.tokens(text)) for b in beginnings(w))
    shared = Counter(b for w in {w for t in corpus for w in toxicity.tokens(t)} for b in ["", *beginnings(w)])
    cut = lambda n: (0, 0.95, 1.6, 2.0)[min(n, 3)]
    out = {}
    for node in nodes:
        lower = (shared[node] + 0.5) / (shared[node[:-1]] + 15)
        p = []
        for c in counts:
            below = [c[x] for x in nodes if x[:-1] == node[:-1]]
            p.append((c[node] - cut(c[node]) + sum(map(cut, below)) * lower) / sum(below) if sum(below) else lower)
        out[node] = math.log(p[1] / p[0])
    return out


def test_toxicity_counts_are_brute_force(spark):
    rows = [(1, True, "You scoundrel, you rat"), (1, False, "scoundrels! rat Rat"), (1, False, "a scoundrelly thing"), (0, True, "a scout and a thing"),
            (0, False, "the rate of things"), (0, False, "été naïve_x 12 scoundrel")]
    labelled = spark.createDataFrame(rows, "label int, apart boolean, text string")
    texts = [t for _, _, t in rows] + ["scoundrelism rates", "zebra zebra", ""]
    corpus = spark.createDataFrame([(t,) for t in texts], "text string")
    got = toxicity.letter_ratios(toxicity.class_counts(labelled), toxicity.shared_counts(corpus)).collect()
    for column, left_out in (("whole", None), ("partly", True)):
        want = brute_letter_ratios(rows, texts, left_out)
        assert {r["node"]: r[column] for r in got} == pytest.approx(want, abs=1e-9)
    model = toxicity.model_of(toxicity.word_beginnings(labelled, corpus))
    words = ["scoundrel", "scoundrelism", "zebra", "rat", "x" * 500, "scou"]
    whole = brute_letter_ratios(rows, texts)
    sums = {n: sum(whole[n[:i]] for i in range(1, len(n) + 1)) for n in whole}
    want = [sums.get(next((p[:i] for p in [toxicity.spelled(w)] for i in range(9, 0, -1) if p[:i] in sums), ""), 0.0) for w in words]
    assert toxicity.word_ratios(model, words).tolist() == pytest.approx(want, abs=1e-5)
    assert want[0] > 1 and want[2] == 0.0


def test_toxicity_reads_passages_and_words():
    x = np.array([0.0] * 40 + [4.0, 4.0] + [0.0] * 40)
    assert toxicity.ratios(x, np.array([0.0, 4.0])) == (0.5, 2.0)
    assert toxicity.ratios(x[:0], x[:0]) == (0.0, 0.0)
    assert toxicity.ratios(x[38:44], np.array([4.0])) == pytest.approx((8 / 6, 4.0))


def test_tree_rules():
    text = """Forest
  Tree 0 (weight 1.0):
    If (feature 1 <= 0.5)
     If (feature 0 <= 2.0)
      Predict: 0.0
     Else (feature 0 > 2.0)
      Predict: 1.0
    Else (feature 1 > 0.5)
     Predict: 1.0
  Tree 1 (weight 1.0):
    If (feature 1 <= 0.5)
     Predict: 0.0
    Else (feature 1 > 0.5)
     Predict: 1.0
"""
    low, high = quality.Condition("b", False, 0.5), quality.Condition("b", True, 0.5)
    small, large = quality.Condition("a", False, 2.0), quality.Condition("a", True, 2.0)
    assert set(quality.tree_rules(text, ["a", "b"])) == {(low,), (high,), (small, low), (large, low)}
    assert len(quality.tree_rules(text, ["a", "b"])) == 4


# Outliers

def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    covered = [False] * len(words)
    for i in range(len(words) - 4):
        if grams[tuple(words[i:i + 5])] > 1:
            covered[i:i + 5] = [True] * 5
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), sum(covered)


TEXTS = ["", None, " \n\t", "one", "a b c d e a b c d e", "a a a a a a", "a a a a a", "x y z " * 40, "l1 w\nl1 w\n\n\nl1 w\n l1 w", "é ü\x0bß\x1cq $5 <b> | & % # *",
         "p q r s t u p q r s t v q r s t u", "w x   y", "word" * 5000, " ".join(f"w{i % 50}" for i in range(500))]


def test_counts_match_brute_force(spark):
    docs = frame(spark, [(i, t, "en", "s") for i, t in enumerate(TEXTS)])
    rows = {r["doc_id"]: r for r in textstats.base_stats(docs).collect()}
    for i, text in enumerate(TEXTS):
        r = rows[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == plain_counts(text), repr(text)[:60]


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(n))


def test_outliers_go_and_clean_texts_stay(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.randint(12, 200)), rng.choice(["en", None]), rng.choice(["hot", "hot", "a", None])) for i in range(600)]
    rows += [(1000 + i, " ".join(w + "$$$" for w in prose(rng, 80).split()), "en", "hot") for i in range(15)]   # a tenth of the group
    rows += [(2000 + i, prose(rng, 60).upper(), "en", "hot") for i in range(5)]
    rows += [(3000, None, None, None), (3001, "", "en", "hot"), (3002, "a b c", "en", "hot"), (3003, "same five words here again " * 5, "en", "lonely"),
             (3004, prose(rng, 50), "xx", "lonely")]
    docs = frame(spark, rows)
    judged = outliers.judge(docs)
    assert not re.search("Python|Pandas|Arrow", judged._jdf.queryExecution().toString())
    got = {r["doc_id"]: r for r in judged.collect()}
    assert len(got) == len(rows)
    for i, text, _, _ in rows:
        n, _, _, _, repeated = plain_counts(text)
        assert got[i]["base_failed"] == (n < 10 or 100 * repeated > 20 * n)
        assert not (got[i]["kept"] and got[i]["base_failed"])
    assert sum(got[i]["kept"] for i in range(600)) >= 598
    assert not any(got[i]["kept"] for i in [*range(1000, 1015), *range(2000, 2005)])
    assert got[3004]["kept"]
    assert outliers.judge(docs.limit(0)).count() == 0


def test_core_distance_matches_numpy(spark):
    """The spelled-out triangular solve equals numpy's Mahalanobis distance."""
    rng = np.random.default_rng(5)
    names = list(outliers.VECTOR)
    x = rng.normal(size=(200, 5)) @ rng.normal(size=(5, 5))
    rows = spark.createDataFrame([("k", *map(float, r)) for r in x], "key string, " + ", ".join(f"{n} double" for n in names))
    factors = outliers._factor(outliers._moments(rows, F.lit(True)))
    got = [r["d"] for r in outliers._distance(rows, factors).orderBy(names[0]).collect()]
    x = x[np.argsort(x[:, 0])]
    cov = outliers.CONSISTENCY * np.cov(x.T, bias=True) + np.diag([outliers.VECTOR[n] ** 2 for n in names])
    centred = x - x.mean(axis=0)
    assert np.allclose(got, np.einsum("ij,jk,ik->i", centred, np.linalg.inv(cov), centred))


# Shards

def test_shard_laws(spark):
    rng = random.Random(1)
    rows = [(i, "é" * rng.randint(0, 9), "en", rng.choice(["hot"] * 8 + ["b", None])) for i in range(1030)]
    rows += [(None, None, "en", "hot"), (5000, "twice", "en", "b"), (5000, "twice", "en", "b")]
    plan = sharding.assign(frame(spark, rows)).collect()
    assert len(plan) == len(rows)
    shards = defaultdict(list)
    for r in plan:
        shards[r["shard"]].append(r)
    assert set(shards) == set(range(40))
    sizes = [len(s) for s in shards.values()]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(r["slot"] for r in s) == list(range(len(s))) for s in shards.values())
    for source in ("hot", "b", None):
        each = [sum(r["source"] == source for r in s) for s in shards.values()]
        assert max(each) - min(each) <= 2, source
    by_id = {i: (t or "").encode() for i, t, _, _ in rows}
    assert all(r["size"] == len(by_id[r["doc_id"]]) + 16 and r["text_crc32"] == zlib.crc32(by_id[r["doc_id"]]) for r in plan)


def test_shards_of_few_rows(spark, tmp_path):
    assert sharding.assign(frame(spark, [])).count() == 0
    few = frame(spark, [(i, f"t{i}", "en", "s") for i in range(3)])
    assert sorted((r["shard"], r["slot"]) for r in sharding.assign(few, shards=2).collect()) == [(0, 0), (0, 1), (1, 0)]
    sharding.write(few, str(tmp_path / "out"), shards=2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r["doc_id"], r["text"]) for r in back.select("doc_id", "text").collect()) == [(i, f"t{i}") for i in range(3)]
