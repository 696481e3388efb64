"""Queries that read the unique detections in several ways compute them once."""

import datetime as dt

import pytest

from netvigil.plans import QUERIES
from netvigil.plans import adapters

DETECTIONS = ("capture_id string, flow_id string, src_ip string, dst_ip string, src_port int, dst_port int, protocol string, "
              "attack_type string, confidence double, layer string, threat_level int, anomaly_score double, ts timestamp, "
              "det_seq string, flow_count long")


@pytest.fixture
def unique(spark, monkeypatch):
    rows = [("c", "f", "10.0.0.1", "172.16.0.1", 1, 80, "TCP", attack, sure, layer, level, None, dt.datetime(2024, 1, 1, hour), seq, 1)
            for hour, (seq, attack, sure, layer, level) in enumerate([
                ("2-a", "DDOS", 0.97, "xgboost", 4), ("3-b", "VAE_ANOMALY", 0.5, "vae", 2), ("1-c", "[x] sig", 0.95, "suricata", 1)])]
    table = spark.createDataFrame(rows, DETECTIONS)
    monkeypatch.setattr(adapters, "unique_detections", lambda *_: table)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_line_decode(spark, unique):
    got = QUERIES["p22_line_decode"](spark, "")
    assert plan(got).count("ExistingRDD") == 1
    rows = {(r["det_seq"], r["attack_type"], r["layer"], r["extra_data"] is not None) for r in got.collect()}
    assert rows == {(s, a, x, False) for s, a, x in (("2-a", "DDOS", "xgboost"), ("3-b", "VAE_ANOMALY", "vae"), ("1-c", "[x] sig", "suricata"))} | {
        (s, None, None, True) for s in ("1-c", "2-a", "3-b")}


@pytest.mark.parametrize("name", ["f07_rule_search", "f07_rule_search_all_rules"])
def test_rule_search(spark, unique, name):
    got = QUERIES[name](spark, "")
    assert "ExistingRDD" not in plan(got)
    found = {(r["det_seq"], r["rule_id"], r["search"]) for r in got.collect()}
    assert {("2-a", 100104, "group"), ("2-a", 100104, "id"), ("2-a", 100111, "id or layer"), ("3-b", 100126, "id or layer")} <= found
    assert not any(s == "1-c" for s, _, _ in found)
