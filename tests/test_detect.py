"""Edge semantics of grading, dedup, whitelist and actions on hand-written rows."""

import pytest
from pyspark.sql import functions as F

from netvigil.functions import levels, text
from netvigil.operators import detect, respond, rules

SCHEMA = ("capture_id string, flow_id string, src_ip string, dst_ip string, src_port int, dst_port int, protocol string, "
          "attack_type string, confidence double, layer string, threat_level int, anomaly_score double, flow_count long, "
          "ts timestamp, det_seq string")


def det(spark, *rows):
    import datetime as dt

    base = dt.datetime(2024, 1, 1)
    full = []
    for i, r in enumerate(rows):
        row = {"capture_id": "c", "flow_id": str(i), "src_ip": "1.1.1.1", "dst_ip": "2.2.2.2", "src_port": 1, "dst_port": 80,
               "protocol": "TCP", "attack_type": "DDOS", "confidence": 0.9, "layer": "xgboost", "threat_level": 4,
               "anomaly_score": None, "flow_count": 1, "ts": base, "det_seq": f"2-{i:04d}"}
        at = r.pop("at", 0)
        full.append({**row, **r, "ts": base + dt.timedelta(seconds=at)})
    return spark.createDataFrame(full, SCHEMA)


def values(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def test_dedup_keeps_first_on_equal_confidence_and_counts_flows(spark):
    d = det(spark, {"confidence": 0.5}, {"confidence": 0.7, "layer": "vae"}, {"confidence": 0.7}, {"attack_type": "SCAN"})
    got = sorted(values(detect.dedup(d), "attack_type", "flow_id", "layer", "flow_count"))
    assert got == [("DDOS", "1", "vae", 3), ("SCAN", "3", "xgboost", 1)]


def test_dedup_flow_counts_sum_to_input(spark):
    d = det(spark, *[{"src_ip": f"1.1.1.{i % 3}", "confidence": i / 10} for i in range(10)])
    assert detect.dedup(d).agg(F.sum("flow_count")).first()[0] == 10


def test_whitelist_drops_on_either_end(spark):
    d = det(spark, {"src_ip": "9.9.9.9"}, {"dst_ip": "9.9.9.9"}, {})
    wl = spark.createDataFrame([("9.9.9.9",), ("8.8.8.8",)], "ip string")
    assert values(detect.drop_whitelisted(d, wl), "flow_id") == [("2",)]


def test_whitelist_networks(spark):
    d = det(spark, {"src_ip": "10.1.2.3"}, {"dst_ip": "10.1.255.255"}, {"src_ip": "10.2.0.0"}, {"src_ip": "host"})
    wl = spark.createDataFrame([("10.1.0.0/16",)], "ip string")
    assert sorted(values(detect.drop_whitelisted_networks(d, wl), "flow_id")) == [("2",), ("3",)]


@pytest.mark.parametrize("attack,conf,want", [
    ("DDoS", 0.81, 4), ("DDoS", 0.8, 3), ("infiltration", 0.1, 3), ("PortScan", 0.99, 2), ("SSH-Patator", 0.1, 2),
    ("Port Scan", 0.99, 1), ("Bot", 0.9, 1),
])
def test_attack_level(spark, attack, conf, want):
    row = spark.range(1).select(levels.attack_level(F.lit(attack), F.lit(conf))).first()
    assert row[0] == want


def test_normalized_names_grade_port_scan_medium(spark):
    assert spark.range(1).select(levels.attack_level(F.lit("Port Scan"), F.lit(0.5), True)).first()[0] == 2


@pytest.mark.parametrize("score,want", [(-0.3, 1), (-0.31, 2), (-0.5, 2), (-0.51, 3), (-0.7, 3), (-0.71, 4)])
def test_isolation_level_bounds(spark, score, want):
    assert spark.range(1).select(levels.isolation_level(F.lit(score))).first()[0] == want


@pytest.mark.parametrize("score,threshold,want", [(1.5, 1.0, 1), (1.51, 1.0, 2), (3.0, 1.0, 2), (5.0, 1.0, 3), (5.1, 1.0, 4),
                                                  (9.0, 0.0, 1)])
def test_error_level_bounds(spark, score, threshold, want):
    assert spark.range(1).select(levels.error_level(F.lit(score), F.lit(threshold))).first()[0] == want


@pytest.mark.parametrize("level,want", [(6, 1), (7, 2), (10, 3), (12, 4)])
def test_host_level_inclusive(spark, level, want):
    assert spark.range(1).select(levels.host_level(F.lit(level))).first()[0] == want


@pytest.mark.parametrize("a,b,kind,want", [(1, 1, "ip_match", 2), (2, 2, "ip_match", 3), (3, 1, "ip_match", 3),
                                           (1, 1, "attack_pattern", 1), (4, 1, "ip_match", 4)])
def test_combined_level(spark, a, b, kind, want):
    assert spark.range(1).select(levels.combined_level(F.lit(a), F.lit(b), F.lit(kind))).first()[0] == want


def test_time_parse(spark):
    cols = [text.parse_time(F.lit(s), F.lit("2000-01-01").cast("timestamp")).cast("string")
            for s in ("2024-01-01T00:00:00Z", "2024-01-01T02:00:00+02:00", "junk")]
    assert tuple(spark.range(1).select(*cols).first()) == ("2024-01-01 00:00:00", "2024-01-01 00:00:00", "2000-01-01 00:00:00")


ALL = ("log", "alert", "block", "webhook", "email", "siem")


def test_action_gates(spark):
    d = det(spark, *[{"threat_level": i, "attack_type": str(i)} for i in (1, 2, 3, 4)])
    got = {}
    for level, action in values(respond.outbox(d, ALL).orderBy("threat_level", "action_order"), "threat_level", "action"):
        got.setdefault(level, []).append(action)
    assert got == {1: ["log", "siem"], 2: ["log", "alert", "webhook", "siem"],
                   3: ["log", "alert", "block", "webhook", "siem"], 4: list(ALL)}


def test_default_actions_are_log_and_alert(spark):
    assert sorted(values(respond.outbox(det(spark, {})), "action")) == [("alert",), ("log",)]


def hit_ids(df):
    return {r[0] for r in df.select("rule_id").collect()}


def test_published_sample_rule(spark):
    d = det(spark, {"src_ip": "192.168.1.100", "dst_ip": "10.0.0.1", "attack_type": "DDOS", "confidence": 0.95})
    hit = rules.evaluate(d).filter("rule_id = 100104").first()
    assert (hit["level"], hit["description"]) == (13, "Hybrid NIDS [CRITICAL]: DDOS from 192.168.1.100 to 10.0.0.1")


@pytest.mark.parametrize("conf,sure", [(0.949, False), (0.95, True), (1.0, True)])
def test_confidence_text_rule(spark, conf, sure):
    assert (100132 in hit_ids(rules.evaluate(det(spark, {"confidence": conf})))) is sure


@pytest.mark.parametrize("gap,want", [(300, True), (301, False)])
def test_scan_then_attack_bound(spark, gap, want):
    d = det(spark, {"attack_type": "PORTSCAN", "threat_level": 2, "at": 10}, {"attack_type": "DDOS", "at": 10 + gap})
    assert (100143 in hit_ids(rules.evaluate(d))) is want


def test_scan_after_attack_is_no_chain(spark):
    d = det(spark, {"attack_type": "DDOS"}, {"attack_type": "PORTSCAN", "threat_level": 2, "at": 5})
    assert 100143 not in hit_ids(rules.evaluate(d))


@pytest.mark.parametrize("n,spread,want", [(5, 15, True), (4, 15, False), (5, 16, False)])
def test_frequency_needs_five_in_sixty_seconds(spark, n, spread, want):
    # The run crosses a slice boundary, so the overlap carries the history.
    d = det(spark, *[{"threat_level": 1, "attack_type": f"X{i}", "at": 3570 + i * spread} for i in range(n)])
    assert (100140 in hit_ids(rules.evaluate(d))) is want


def test_winner_is_highest_level_then_lowest_id(spark):
    w = rules.winners(rules.evaluate(det(spark, {"confidence": 0.97}))).first()
    assert (w["rule_id"], w["level"]) == (100132, 14)


def block_times(spark, seconds, duration=300, **kw):
    import datetime as dt

    base = dt.datetime(2024, 1, 1)
    rows = [("ip", base + dt.timedelta(seconds=s), "r") for s in seconds]
    df = respond.block_events(spark.createDataFrame(rows, "ip string, ts timestamp, reason string"), duration, **kw)
    return sorted(int((r["blocked_at"] - base).total_seconds()) for r in df.collect())


def test_cooldown_bounds(spark):
    assert block_times(spark, [0, 299, 300, 301, 600]) == [0, 300, 600]


def greedy(seconds, duration):
    out, allowed = [], None
    for s in sorted(set(seconds)):
        if allowed is None or s >= allowed:
            out.append(s)
            allowed = s + duration
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_hot_address_levels_equal_plain_walk(spark, seed):
    import random

    rng = random.Random(seed)
    seconds = [rng.randrange(0, 20000) for _ in range(400)] + [30000 + 7 * i for i in range(500)] + [10**6, 10**6 + 299]
    want = greedy(seconds, 300)
    assert block_times(spark, seconds, hot_events=10) == want
    assert block_times(spark, seconds, hot_events=10_000) == want


def test_hot_addresses_of_one_duration_and_beside_cold_ones(spark):
    import datetime as dt

    base = dt.datetime(2024, 1, 1)
    times = {"dense": range(0, 250), "sparse": range(0, 40_000, 301), "cold": [5, 400], "two": [*range(100, 140), *range(390, 430)]}
    rows = [(ip, base + dt.timedelta(seconds=s), "r") for ip, ss in times.items() for s in ss] + [(None, base, "r"), ("x", None, "r")]
    got = respond.block_events(
        spark.createDataFrame(rows, "ip string, ts timestamp, reason string"), 300, hot_events=10).collect()
    for ip, seconds in times.items():
        assert sorted(int((r["blocked_at"] - base).total_seconds()) for r in got if r["ip"] == ip) == greedy(seconds, 300)
    assert {r["ip"] for r in got} == set(times)


def test_a_million_events_of_one_address_in_a_day(spark):
    """The whole day equals the plain walk, and no operator groups by the address."""
    n, step = 1_000_000, 86_400
    events = spark.range(n).selectExpr(
        "'hot' as ip", f"timestamp_micros(1704067200000000 + id * {step} + pmod(xxhash64(id), 80000)) as ts", "'r' as reason")
    blocks = respond.block_events(events, 300)
    got = sorted(r[0] for r in blocks.select(F.unix_micros("blocked_at")).collect())
    times = sorted({r[0] for r in events.select(F.unix_micros("ts")).collect()})
    assert got == greedy(times, 300 * 1_000_000)
    plan = blocks._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan


def test_expired_blocks(spark):
    import datetime as dt

    df = spark.createDataFrame([("a", dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1, 0, 5))],
                               "ip string, blocked_at timestamp, expires_at timestamp")
    assert respond.expired_blocks(df, "2024-01-01 00:05:00").count() == 1
    assert respond.expired_blocks(df, "2024-01-01 00:04:59").count() == 0
