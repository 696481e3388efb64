"""Windows, quantiles, sampling, cleaning and metrics against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from netvigil.models.scaling import fit_scaler
from netvigil.operators import clean, metrics, quantiles, sampling, select, windows


def flows(spark, sizes):
    rows = [(c, i + 1, float(i + 1), float(10 * (i + 1)), f"L{i + 1}") for c, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "capture_id string, flow_seq long, x double, y double, label string")


@pytest.mark.parametrize("n,rows", [(3, 1), (5, 1), (7, 3), (23, 19)])
def test_window_counts_and_labels(spark, n, rows):
    got = windows.sliding_windows(flows(spark, {"a": n}), ["x", "y"], keep=("label",), bucket_rows=6).orderBy("flow_seq").collect()
    assert len(got) == rows
    assert got[-1]["label"] == f"L{n}"
    x = np.column_stack([np.arange(1, n + 1), 10 * np.arange(1, n + 1)]).astype(float)
    if n < 5:
        x = np.vstack([np.repeat(x[:1], 5 - n, axis=0), x])
    assert [r["window"] for r in got] == [x[i:i + 5].ravel().tolist() for i in range(len(x) - 4)]


def test_no_padding_for_anomaly_training(spark):
    got = windows.sliding_windows(flows(spark, {"a": 3, "b": 6}), ["x"], pad=False)
    assert {r["capture_id"] for r in got.collect()} == {"b"} and got.count() == 2


@pytest.mark.parametrize("q", [0.0, 0.01, 0.25, 0.5, 0.8, 1.0])
@pytest.mark.parametrize("limit", [10, 500, 10**6])
def test_exact_quantile_equals_numpy(spark, q, limit):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(size=3000), np.full(3000, 0.25)])
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    assert quantiles.exact_quantiles(df, ["x"], q, limit)["x"] == pytest.approx(float(np.percentile(x, q * 100)), abs=1e-12)


def test_seeded_rank_is_a_permutation_and_repeats(spark):
    df = spark.createDataFrame([(i, "big" if i % 10 else "small") for i in range(2000)], "id long, c string")
    first = sampling.seeded_rank(df, "id", ["c"]).collect()
    ranks = sorted(r["seed_rank"] for r in first if r["c"] == "big")
    assert ranks == list(range(1, 1801))
    again = {r["id"]: r["seed_rank"] for r in sampling.seeded_rank(df.repartition(5), "id", ["c"]).collect()}
    assert all(again[r["id"]] == r["seed_rank"] for r in first)


def test_first_in_seeded_order_keeps_exactly_the_cap(spark):
    df = spark.createDataFrame([(i, "big" if i % 10 else "small") for i in range(3000)], "id long, c string")
    got = sampling.first_in_seeded_order(df, "id", ["c"], 500)
    assert {r["c"]: r["count"] for r in got.groupBy("c").count().collect()} == {"big": 500, "small": 300}
    ranked = sampling.seeded_rank(df, "id", ["c"]).filter("seed_rank <= 500")
    assert {r["id"] for r in got.collect()} == {r["id"] for r in ranked.collect()}


def test_split_shares(spark):
    df = spark.createDataFrame([(i, "a" if i % 4 else "b") for i in range(4000)], "id long, c string")
    got = {(r["c"], r["split"]): r["count"] for r in sampling.stratified_split(df, "id", ["c"]).groupBy("c", "split").count().collect()}
    assert got == {("a", "test"): 600, ("a", "validation"): 300, ("a", "train"): 2100,
                   ("b", "test"): 200, ("b", "validation"): 100, ("b", "train"): 700}


def test_scaler_population_std_and_constant_column(spark):
    df = spark.createDataFrame([(1.0, 3.0), (2.0, 3.0), (4.0, 3.0)], "x double, c double")
    got = np.array([tuple(r) for r in fit_scaler(df, ["x", "c"]).transform(df).collect()])
    x = np.array([1.0, 2.0, 4.0])
    assert np.allclose(got[:, 0], (x - x.mean()) / x.std()) and np.allclose(got[:, 1], 0.0)


INF, NAN = float("inf"), float("nan")


def test_dirty_values(spark):
    df = spark.createDataFrame([(1.0,), (INF,), (-INF,), (NAN,), (None,), (4.0,)], "x double")
    assert [r[0] for r in clean.zero_fill(df, ["x"]).collect()] == [1.0, 0.0, 0.0, 0.0, 0.0, 4.0]
    assert [r[0] for r in clean.median_impute(df, ["x"]).collect()] == [1.0, 2.5, 2.5, 2.5, 2.5, 4.0]
    assert [r[0] for r in clean.drop_dirty(df, ["x"]).collect()] == [1.0, 4.0]


def test_repeated_header_and_aliases(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0)], [" Fwd Header Length", "Fwd Header Length.1", "dst_port"])
    assert clean.canonical_headers(df).columns == ["fwd_header_len", "fwd_header_length_2", "dst_port"]


def test_repeated_csv_header(spark, tmp_path):
    from netvigil.sources import flows as source

    (tmp_path / "one.csv").write_text(" Fwd Header Length, Label,Fwd Header Length\n1,BENIGN,2\n")
    row = source.read_flow_files(spark, str(tmp_path)).first()
    assert (row["fwd_header_len"], row["fwd_header_length_2"], row["label"], row["capture_id"]) == ("1", "2", "BENIGN", "one.csv")


def test_header_mismatch_fails_loudly(spark, tmp_path):
    from netvigil.sources import flows as source

    (tmp_path / "a.csv").write_text("x,label\n1,BENIGN\n")
    (tmp_path / "b.csv").write_text("label,x\nBENIGN,1\n")
    with pytest.raises(Exception):
        source.read_flow_files(spark, str(tmp_path)).collect()


def test_web_attack_labels_with_damaged_dash(spark):
    labels = ["Web Attack � XSS", "Web Attack � Sql Injection", "Bot", "new thing"]
    df = spark.createDataFrame([(x,) for x in labels], "label string")
    assert [r[0] for r in df.select(clean.attack_category(F.col("label"))).collect()] == ["Web Attack", "Web Attack", "Bot", "Unknown"]


def test_rare_class_bound(spark):
    df = spark.createDataFrame([("a",)] * 1000 + [("b",)] * 999, "c string")
    assert {r[0] for r in select.drop_rare_classes(df, "c").distinct().collect()} == {"a"}


def test_correlation_rounding_decides(spark):
    corr = spark.createDataFrame([("low", 0.01), ("kept", 0.02), ("same", 1.0), ("neg", -0.5)], "column string, corr double")
    assert {r["column"] for r in select.rank_correlations(corr).collect()} == {"kept", "neg"}


def sklearn_like_auc(y, s):
    order = np.argsort(-s, kind="stable")
    y, s = y[order], s[order]
    ends = np.append(np.flatnonzero(np.diff(s)), len(s) - 1)
    tp = np.cumsum(y)[ends]
    p, r = np.r_[1.0, tp / (ends + 1)], np.r_[0.0, tp / y.sum()]
    return float(np.sum(np.diff(r) * (p[1:] + p[:-1]) / 2))


def test_pr_auc_equals_direct_curve(spark):
    rng = np.random.default_rng(3)
    s = np.round(rng.random(800), 2)
    y = (rng.random(800) < s).astype(int)
    df = spark.createDataFrame([("c", float(a), bool(b)) for a, b in zip(s, y)], "class string, score double, positive boolean")
    assert metrics.pr_auc(df).first()["pr_auc"] == pytest.approx(sklearn_like_auc(y, s), abs=1e-9)


def test_confusion_sums_to_rows(spark):
    df = spark.createDataFrame([(i % 3, i % 2) for i in range(60)], "label int, pred int")
    assert metrics.confusion(df).agg(F.sum("rows")).first()[0] == 60
    o = metrics.overall(metrics.confusion(df)).first()
    assert o["accuracy"] == pytest.approx(o["recall_weighted"])


def test_quantile_jobs_do_not_grow_with_columns_and_quantiles(spark):
    from netvigil.operators.quantiles import exact_quantile_table

    df = spark.range(20_000).select(*[((F.col("id") * k) % 7919 / 3 + k).alias(f"c{k}") for k in (3, 5, 7, 11)], F.lit(4.0).alias("flat"))
    tracker, used = spark.sparkContext.statusTracker(), []
    for columns, qs in ((["c3"], [0.5]), (["c3", "c5", "c7", "c11", "flat"], [0.1, 0.5, 0.99])):
        group = f"quantiles-{len(columns)}"
        spark.sparkContext.setJobGroup(group, group)
        got = exact_quantile_table(df, columns, qs, exact_rows=500)
        used.append(len(tracker.getJobIdsForGroup(group)))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        want = df.agg(*[F.percentile(c, qs).alias(c) for c in columns]).first()
        assert all(got[c] == pytest.approx(want[c]) for c in columns)
    assert used[1] <= used[0] + 8, used


def test_alignment_keeps_values_under_every_spelling(spark):
    from netvigil.operators import clean

    one = spark.createDataFrame([(1.0, None)], "`Flow IAT Max` double, flow_iat_max double")
    two = spark.createDataFrame([(2.0,)], "flow_iat_max double")
    three = spark.createDataFrame([(None, 3.0, 9.0)], "`Flow IAT Max` double, `flow-iat-max` double, other double")
    rows = clean.union_aligned([one, two, three]).orderBy("Flow IAT Max").collect()
    assert [tuple(r) for r in rows] == [(1.0, None), (2.0, None), (3.0, 9.0)]


def test_areas_by_label_are_the_one_against_rest_areas(spark):
    """One pass over the scores gives what a copy of all rows to each class gives; ties and rare classes included."""
    from netvigil.operators import metrics

    rng = np.random.default_rng(8)
    rows = [("abc"[int(k)], float(s)) for k, s in zip(rng.choice(3, 900, p=[0.6, 0.39, 0.01]), rng.integers(0, 60, 900) / 7, strict=True)]
    df = spark.createDataFrame([*rows, (None, 3.0)], "label string, score double")
    copied = df.select("score", F.explode(F.array(*map(F.lit, "abc"))).alias("class"), "label").withColumn(
        "positive", F.coalesce(F.col("label") == F.col("class"), F.lit(False)))
    want = {r["class"]: r["pr_auc"] for r in metrics.pr_auc(copied).collect()}
    got = {r["class"]: r["pr_auc"] for r in metrics.pr_auc_by_label(df).collect()}
    assert got == pytest.approx(want) and set(got) == set("abc")


@pytest.mark.parametrize("size", [2_000, 16_000])
def test_buckets_follow_the_class_size(spark, monkeypatch, size):
    """The largest bucket keeps its bound at either size, and the ranks do not depend on the width."""
    df = spark.range(size).select("id", F.when(F.col("id") % 10 == 0, "few").otherwise("many").alias("label"))
    wide = sampling.seeded_rank(df, "id", ["label"], digits=1).orderBy("id").collect()
    monkeypatch.setattr(sampling, "BUCKET_ROWS", 40)
    hashed = sampling._with_hash(df, "id", 42)
    _, offsets = sampling._in_buckets(hashed, ["label"], 1)
    assert offsets.agg(F.max("_rows")).first()[0] <= 80
    assert sampling.seeded_rank(df, "id", ["label"], digits=1).orderBy("id").collect() == wide
    cut = sampling.first_in_seeded_order(df, "id", ["label"], 50, digits=1)
    assert sorted(r["id"] for r in cut.collect()) == sorted(r["id"] for r in wide if r["seed_rank"] <= 50)
