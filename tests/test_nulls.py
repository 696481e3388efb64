"""Null keys, unknown confidences and addresses of other kinds keep their rows and their place."""

import pytest
from pyspark.sql import functions as F

from netvigil.operators import detect, sampling, slices
from netvigil.schemas import DETECTION_COLUMNS


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(f"r{i:02d}", None if i % 3 == 0 else "ab"[i % 2], i) for i in range(30)],
                                 "row_id string, label string, n int")


def test_sampling_keeps_null_labels(rows):
    assert sampling.stratified_split(rows, "row_id", ["label"]).count() == 30
    assert sampling.seeded_rank(rows, "row_id", ["label"]).filter("label is null and class_rows = 10").count() == 10
    assert sampling.per_class_sample(rows, "row_id", "label", 4).groupBy("label").count().filter("count = 4").count() == 3
    assert sampling.undersample(rows, "row_id", "label", "a", 2).count() == 10 + 10 + 2
    codes = {r["label"]: r["attack_number"] for r in sampling.encode_labels(rows, "label").distinct().collect()}
    assert codes == {None: None, "a": 0, "b": 1}


def test_order_keeps_null_keys(spark, rows):
    numbered = slices.number_rows(rows, ["label"], ["row_id"])
    assert numbered.count() == 30 and numbered.filter("label is null").agg(F.max("flow_seq")).first()[0] == 10
    timed = rows.withColumn("ts", F.timestamp_seconds(F.col("n") * 1000))
    before = {r["n"]: r["previous"] for r in slices.with_previous(timed, ["label"], ["ts", "row_id"], "n").filter("label is null").collect()}
    assert before == {n: n - 3 if n else None for n in range(0, 30, 3)}
    sums = slices.running_sums(timed, ["label"], F.floor(F.col("n") / 7), ["n"], {"total": "n"}).filter("label is null")
    assert {r["n"]: r["total"] for r in sums.collect()} == {n: sum(range(0, n + 1, 3)) for n in range(0, 30, 3)}


def test_unknown_confidence_comes_last(spark):
    schema = "capture_id string, src_ip string, dst_ip string, attack_type string, confidence double, det_seq string, flow_count long"
    found = spark.createDataFrame([("c", "s", "d", "x", None, "1", 1), ("c", "s", "d", "x", 0.9, "2", 1), ("c", "s", "e", "x", None, "1", 1)], schema)
    for c in DETECTION_COLUMNS:
        if c not in found.columns:
            found = found.withColumn(c, F.lit(None).cast("string"))
    best = {r["dst_ip"]: (r["confidence"], r["flow_count"]) for r in detect.dedup(found).collect()}
    assert best == {"d": (0.9, 2), "e": (None, 1)}


def test_whitelist_of_all_kinds(spark, monkeypatch):
    flows = spark.createDataFrame([("fe80::1", "a"), ("10.1.2.3", "b"), ("b", "10.9.9.9"), (None, "c")], "src_ip string, dst_ip string")
    listed = spark.createDataFrame([("fe80::1",), ("10.1.0.0/16",), ("junk",)], "ip string")
    kept = detect.drop_whitelisted_networks(flows, listed)
    assert sorted((str(r[0]), r[1]) for r in kept.collect()) == [("None", "c"), ("b", "10.9.9.9")]
    # the predicate and the join agree
    exact = spark.createDataFrame([("fe80::1",), ("10.9.9.9",)], "ip string")
    inline = sorted(map(str, detect.drop_whitelisted(flows, exact).collect()))
    monkeypatch.setattr(detect, "INLINE_ENTRIES", 0)
    assert sorted(map(str, detect.drop_whitelisted(flows, exact).collect())) == inline and len(inline) == 2


def test_detections_without_a_time_keep_their_hits(spark):
    """Rules that look at one event see them; no rule that looks back in time counts them."""
    from netvigil.operators import rules

    schema = ("det_seq string, src_ip string, dst_ip string, dst_port int, attack_type string, confidence double, layer string, "
              "threat_level int, anomaly_score double, ts timestamp_ntz")
    rows = spark.createDataFrame([(f"{i}", "10.0.0.1", "10.0.0.2", 22, "DOS", 0.97, "suricata", 4, None, None) for i in range(9)], schema)
    alone = rules.hits(rules.with_static_flags(rows)).groupBy("rule_id").count().collect()
    assert sorted(rules.evaluate(rows).groupBy("rule_id").count().collect()) == sorted(alone) and len(alone) > 3
