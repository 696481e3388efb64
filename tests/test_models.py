"""Detectors separate planted outliers, repeat by seed, and survive a save."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from netvigil.models import classifiers, isolation, oversample, reconstruction
from netvigil.models.preparation import fit_preparation
from netvigil.operators import metrics, slices


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    benign = rng.normal(size=(1500, 2)) @ rng.normal(size=(2, 6)) + 0.05 * rng.normal(size=(1500, 6))
    odd = rng.normal(size=(60, 6)) * 4.0
    rows = [(f"b{i:05d}", v.tolist(), 0) for i, v in enumerate(benign)] + [(f"o{i:05d}", v.tolist(), 1) for i, v in enumerate(odd)]
    return spark.createDataFrame(rows, "row_id string, window array<double>, attack int").persist()


def test_isolation_forest_separates_and_repeats(data):
    benign = data.filter("attack = 0")
    forest = isolation.fit_isolation_forest(benign, "row_id", trees=40)
    scored = forest.transform(data).groupBy("attack").agg(F.avg(F.col("outlier").cast("int")).alias("share")).collect()
    share = {r["attack"]: r["share"] for r in scored}
    # Planted rows overlap the benign spread, so only their rate is compared; far rows must all be found.
    assert share[0] == pytest.approx(0.01, abs=0.005) and share[1] > 20 * share[0]
    far = data.filter("attack = 1").withColumn("window", F.transform("window", lambda v: v * 10))
    assert forest.transform(far).agg(F.avg(F.col("outlier").cast("int"))).first()[0] > 0.95
    again = isolation.fit_isolation_forest(benign.repartition(3), "row_id", trees=40)
    assert again.offset == forest.offset


def test_mean_path_values():
    assert isolation.mean_path(1) == 0 and isolation.mean_path(2) == 1
    assert float(isolation.mean_path(256)) == pytest.approx(10.24, abs=0.01)


def test_linear_reconstruction(data):
    model = reconstruction.fit_linear_reconstruction(data.filter("attack = 0"), 2)
    rate = {r["attack"]: r["rate"] for r in model.transform(data).groupBy("attack").agg(
        F.avg((F.col("score") > model.threshold).cast("int")).alias("rate")).collect()}
    assert rate[0] == pytest.approx(0.2, abs=0.01) and rate[1] > 0.9


def test_attacks_change_neither_scaler_nor_threshold(spark):
    """Preparation and detector are fitted on benign flows alone, whatever else the table holds."""
    from netvigil.models.preparation import fit_preparation
    from netvigil.operators import clean

    rng = np.random.default_rng(4)
    rows = [("c", f"{i:04d}", "BENIGN", float(rng.normal(200, 30)), float(rng.normal())) for i in range(300)]
    dirty = [("c", "9000", "BENIGN", None, 1.0), ("c", "9001", "BENIGN", float("inf"), 1.0)]
    attacks = [("c", f"{i:04d}a", "DDoS", 1e9, -50.0) for i in range(100)]
    fits = []
    for more in ([], attacks):
        table = spark.createDataFrame(rows + dirty + more, "capture_id string, flow_id string, label string, x double, y double")
        benign, _ = clean.split_benign(table)
        fitted = fit_preparation(benign, ["x", "y"])
        windows = fitted.training_windows(benign, "capture_id", "flow_id", ("flow_id",))
        assert windows.count() == 296
        assert fitted.scoring_windows(table, "capture_id", "flow_id").count() == table.count() - 4
        fits.append((fitted, reconstruction.fit_linear_reconstruction(windows, 2).threshold))
    one, two = fits[0][0], fits[1][0]
    assert one.logged == two.logged == ["x"]
    assert one.scaler.mean == pytest.approx(two.scaler.mean) and one.scaler.std == pytest.approx(two.scaler.std)
    assert fits[0][1] == pytest.approx(fits[1][1])


def test_nearest_in_class_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    points = {c: rng.integers(0, 5, (n, 2)).astype(float) for c, n in ((1, 40), (2, 7), (3, 2))}
    df = spark.createDataFrame([(c, i + 1, x.tolist()) for c, xs in points.items() for i, x in enumerate(xs)], "label int, pos long, v array<double>")
    for block_rows in (5, 1000):
        got = {(r["label"], r["pos"]): r["near"] for r in oversample.nearest_in_class(df, "v", "label", 3, block_rows).collect()}
        assert len(got) == 49
        for c, xs in points.items():
            for i, x in enumerate(xs):
                order = sorted((float(((y - x) ** 2).sum()), j + 1) for j, y in enumerate(xs) if j != i)
                assert got[c, i + 1] == [j for _, j in order[:3]]


def test_oversample_reaches_target_inside_class(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=3) + (10 if i % 5 else 0)).tolist(), 0 if i % 5 else 1) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, v array<double>, attack_number int")
    out = oversample.oversample_minorities(df, "id", "v", target=200)
    assert {r["attack_number"]: r["count"] for r in out.groupBy("attack_number").count().collect()} == {0: 320, 1: 200}
    made = np.array([r["v"] for r in out.filter("id like 'synthetic%'").collect()])
    real = np.array([v for _, v, c in rows if c == 1])
    assert (made >= real.min(0) - 1e-9).all() and (made <= real.max(0) + 1e-9).all()


def test_classifiers_beat_chance_and_score(spark, data):
    train = classifiers.to_vector(data.withColumn("attack_number", F.col("attack")))
    trained = classifiers.train_all(train, {
        "tree": classifiers.decision_tree(5), "forest": classifiers.random_forest(10, 5),
        "boosted": classifiers.boosted_trees(3, 3)})
    table = classifiers.compare(trained, train)
    assert table.count() == 3 and table.agg(F.min("f1_macro")).first()[0] > 0.8
    assert metrics.best_model(table).count() == 1
    for model in trained.models.values():
        got = classifiers.score(model, train, ["benign", "odd"]).select("label", "confidence").distinct().collect()
        assert {r["label"] for r in got} == {"BENIGN", "ODD"} and all(0.5 <= r["confidence"] <= 1.0 for r in got)


def test_isolation_scores_are_those_of_a_plain_walk():
    """All rows of a slice step together; a leaf keeps its rows, whatever they hold."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2 * isolation.SLICE + 5, 4))
    x[0, 1], x[1, 2], x[2, 0] = np.nan, np.inf, -np.inf
    grown = [isolation._grow(rng.normal(size=(n, 4)), np.random.default_rng(n)) for n in (1, 2, 60, 256)]
    trees = [{k: np.array(v, np.int64 if k in ("feature", "left", "right") else float) for k, v in t.items()} for t in grown]

    def walked(row):
        total = 0.0
        for t in trees:
            at = 0
            while t["feature"][at] >= 0:
                at = t["left" if row[t["feature"][at]] <= t["cut"][at] else "right"][at]
            total += t["depth"][at]
        return total

    assert isolation._depths(x, [isolation._walkable(t) for t in trees]).tolist() == [walked(row) for row in x]


def test_thresholds_read_written_scores(data, monkeypatch):
    """The quantile passes over the scores several times; the detector runs once."""
    plans = []
    for module in (isolation, reconstruction):
        real = module.exact_quantiles
        monkeypatch.setattr(module, "exact_quantiles", lambda df, *how, real=real: (
            plans.append(df._jdf.queryExecution().executedPlan().toString()), real(df, *how))[1])
    benign = data.filter("attack = 0")
    isolation.fit_isolation_forest(benign, "row_id", trees=4)
    reconstruction.fit_linear_reconstruction(benign, 2)
    assert len(plans) == 2 and not any("Arrow" in p or "UDF" in p for p in plans)


def _leaf(tree, row):
    at = 0
    while tree["feature"][at] >= 0:
        at = tree["left" if row[tree["feature"][at]] <= tree["cut"][at] else "right"][at]
    return tree["depth"][at]


def test_values_count_as_places_among_the_cuts(monkeypatch):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(300, 4)), 1)
    grown = [isolation._grow(x[rng.choice(300, n, replace=False)], rng) for n in (1, 2, 9, 64, 256)]
    trees = [{k: np.array(v, float if k in ("cut", "depth") else np.int64) for k, v in t.items()} for t in grown]
    rows = np.concatenate([x, [[np.nan] * 4, [np.inf] * 4, [-np.inf] * 4]])
    monkeypatch.setattr(isolation, "SLICE", 128)
    placed = isolation._placed([isolation._walkable(t) for t in trees])
    assert placed[2] is np.uint16 and len(placed[1]) == 5
    assert isolation._walked(rows, *placed).tolist() == [sum(_leaf(t, r) for t in trees) for r in rows]
    alone = isolation._placed([isolation._walkable(trees[0])])
    assert isolation._walked(rows, *alone).tolist() == [_leaf(trees[0], r) for r in rows]


def test_numbering_carries_what_windows_read_alone(spark, monkeypatch):
    rows = [("c", f"{i}", float(i), "x" * 9, i) for i in range(9)]
    flows = spark.createDataFrame(rows, "capture_id string, flow_id string, x double, src_ip string, dst_port int")
    seen, number = [], slices.number_rows
    monkeypatch.setattr(slices, "number_rows", lambda df, *a: seen.append(df.columns) or number(df, *a))
    fit = fit_preparation(flows, ["x"])
    for made in (fit.training_windows, fit.scoring_windows):
        assert made(flows, "capture_id", "flow_id", ("dst_port",)).count() == 5
    assert seen == [["capture_id", "flow_id", "dst_port", "x"]] * 2
