"""Fitted layers: one pass equals each layer's own preparation and scoring, what is saved reads back, counts follow from the scores."""

from collections import Counter

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from netvigil import session
from netvigil.models import layers
from netvigil.models.preparation import fit_preparation
from netvigil.models.stages import WindowScaler
from netvigil.operators import clean, detect, slices, windows
from netvigil.plans import adapters as a
from netvigil.plans import models as plans

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def fitted(spark):
    return plans.fitted_layers(spark, SF_DIR)


def test_window_scaler_is_the_preparation(spark):
    odd = [("c", f"{i:02d}", "BENIGN", x, y) for i, (x, y) in enumerate([(500.0, 1.0), (None, 2.0), (float("inf"), -1.0), (-1.0, float("nan")), (-9.0, 0.5), (900.0, 3.0)])]
    flows = spark.createDataFrame(odd, "capture_id string, flow_id string, label string, x double, y double")
    sound = spark.createDataFrame([("c", f"{i}", "BENIGN", 100.0 * i, 0.1 * i) for i in range(20)], flows.schema)
    fit = fit_preparation(sound, ["x", "y"])
    assert fit.logged == ["x"]
    want = fit.scoring_windows(flows, "capture_id", "flow_id", ("flow_id",)).orderBy("flow_id").collect()
    numbered = slices.number_rows(clean.zero_fill(flows, ["x", "y"]), ["capture_id"], ["flow_id"])
    raw = windows.sliding_windows(numbered, ["x", "y"], keep=("flow_id",))
    got = WindowScaler.of(fit, "window", "scaled").transform(raw).orderBy("flow_id").collect()
    assert [r["scaled"] for r in got] == [pytest.approx(r["window"]) for r in want] and len(got) == 2


def test_every_flow_with_a_past_is_scored(spark, fitted):
    _, known, scored = fitted
    flows = a.flows(spark, SF_DIR)
    sizes = {r["capture_id"]: r["count"] for r in flows.groupBy("capture_id").count().collect()}
    assert scored.count() == sum(n - known["window_size"] + 1 for n in sizes.values())
    assert {r["held_out"] for r in scored.select("held_out").distinct().collect()} == {True, False}
    assert scored.where("confidence not between 0 and 1 or error < 0").count() == 0


def test_saved_layers_score_alike(spark, fitted, tmp_path):
    pipeline, known, scored = fitted
    pipeline.write().overwrite().save(str(tmp_path / "layers"))
    again = layers.scored_windows(PipelineModel.load(str(tmp_path / "layers")), plans.model_flows(spark, SF_DIR), known["feature_columns"])
    columns = ["capture_id", "flow_id", "label", "confidence", "isolation_score", "outlier", "error"]
    assert sorted(again.select(*columns).collect()) == sorted(scored.select(*columns).collect())


def test_detections_follow_from_the_scores(spark, fitted):
    _, known, scored = fitted
    limit = known["thresholds"]["reconstruction_error"]
    rows = scored.collect()
    want = Counter()
    for r in rows:
        want["xgboost"] += r["label"] != "BENIGN"
        want["isolation_forest"] += r["outlier"] or r["isolation_score"] < -0.5
        want["vae"] += r["error"] > limit
    found = layers.layer_detections(scored, limit)
    assert {r["layer"]: r["count"] for r in found.groupBy("layer").count().collect()} == want
    assert found.select("det_seq").distinct().count() == found.count() == sum(want.values())


def test_fitted_cycle_fires_every_layer_rule(spark):
    out = plans.u02_fitted(spark, SF_DIR).collect()
    rules = {r["layer"]: r["rules"].split(",") for r in out}
    assert "100110" in rules["suricata"] and "100111" in rules["xgboost"] and "100112" in rules["isolation_forest"]
    assert all(r["actions"] >= r["unique_attacks"] and r["flows"] >= r["unique_attacks"] for r in out)
    kept = detect.drop_whitelisted(detect.signature_detections(a.signature_alerts(spark, SF_DIR)), a.whitelist(spark, SF_DIR))
    assert sum(r["flows"] for r in out if r["layer"] == "suricata") == kept.count()


def test_the_classifier_is_fitted_on_every_window(spark):
    rows = [(f"c{i % 2}", f"{i:06d}", "BENIGN" if i % 3 else "DDoS", float(i % 7), float(i % 3)) for i in range(7_000)]
    flows = spark.createDataFrame(rows, "capture_id string, flow_id string, label string, x double, y double")
    pipeline, _ = layers.fit_layers(flows, ["x", "y"], components=2)
    assert pipeline.stages[1]._call_java("rootNode").impurityStats().rawCount() == 7_000 - 2 * 4


def test_what_is_read_to_fit_is_gone_before_scoring(spark):
    rows = [("c", f"{i:04d}", "BENIGN" if i % 4 else "DDoS", float(i % 7), float(i % 3)) for i in range(400)]
    flows = spark.createDataFrame(rows, "capture_id string, flow_id string, label string, x double, y double")
    before = list(session._created)
    layers.fit_layers(flows, ["x", "y"], components=2)
    assert session._created == before
