"""Correlation and chains against a literal double loop."""

import datetime as dt
import random

import pytest

from netvigil.operators import correlate, slices

BASE = dt.datetime(2024, 1, 1)
DET = "det_seq string, src_ip string, dst_ip string, attack_type string, threat_level int, confidence double, ts timestamp"
ALERT = ("ts timestamp, event_id long, rule_id string, rule_level int, rule_description string, agent_ip string, "
         "src_ip string, groups array<string>")


def brute(dets, alerts):
    """First match per (source, attack, rule), in detection then alert order."""
    seen, out = set(), {}
    for d in sorted(dets, key=lambda r: r[0]):
        for a in sorted(alerts, key=lambda r: (r[0], r[1])):
            by_ip = bool(a[6]) and (a[6] == d[1] or a[5] == d[2])
            related = any(k in d[3].lower() and any(t in g.lower() for g in a[7] for t in ts)
                          for k, ts in correlate.RELATED_GROUPS.items())
            if not by_ip and not related:
                continue
            key = (d[1], d[3], a[2])
            if key not in seen:
                seen.add(key)
                out[key] = ("ip_match" if by_ip else "attack_pattern", d[0], a[1])
    return out


@pytest.mark.parametrize("seed", range(4))
def test_correlation_equals_double_loop(spark, seed):
    rng = random.Random(seed)
    ips, attacks = [f"10.0.0.{i}" for i in range(4)], ["DDOS", "SSH-PATATOR", "PORTSCAN", "BOT", "WEB ATTACK"]
    dets = [(f"2-{i:03d}", "10.0.0.0" if rng.random() < .4 else rng.choice(ips), rng.choice(ips), rng.choice(attacks),
             rng.randint(1, 4), rng.random(), BASE) for i in range(40)]
    groups = [["sshd"], ["Web_Attack", "x"], ["network_scan"], [], ["local"]]
    alerts = [(BASE + dt.timedelta(seconds=rng.randrange(50)), i, f"R{rng.randrange(5)}", rng.randint(0, 15), "d",
               rng.choice(ips), rng.choice([None, "", *ips]), rng.choice(groups)) for i in range(40)]
    got = correlate.correlate(spark.createDataFrame(dets, DET), spark.createDataFrame(alerts, ALERT))
    rows = {(r["src_ip"], r["attack_type"], r["rule_id"]): (r["correlation_type"], r["nids"]["det_seq"], r["hids"]["event_id"])
            for r in got.collect()}
    assert rows == brute(dets, alerts)


def chains(spark, levels, gap=1000):
    rows = [(BASE + dt.timedelta(seconds=i * gap), i, f"R{i}", v, "d", "a", "10.0.0.1", ["x"]) for i, v in enumerate(levels)]
    return correlate.attack_chains(spark.createDataFrame(rows, ALERT), slice_seconds=1500).collect()


@pytest.mark.parametrize("levels,found", [([3, 5, 4], True), ([5, 4, 3], False), ([1, 2], False), ([1, 2, 3, 4], True),
                                          ([4, 4, 4, 5], False), ([1, 2, 1, 2, 1, 2], True)])
def test_chain_rule(spark, levels, found):
    got = chains(spark, levels)
    assert bool(got) is found
    if found:
        assert got[0]["rule_id"] == f"R{len(levels) - 1}"
        assert got[0]["description"] == f"Attack chain from 10.0.0.1: {len(levels)} progressive alerts"


def test_alert_without_source_is_never_an_address_match(spark):
    d = spark.createDataFrame([("2-0", "1.1.1.1", "2.2.2.2", "DDOS", 1, .5, BASE)], DET)
    a = spark.createDataFrame([(BASE, 1, "R", 1, "d", "2.2.2.2", None, ["network"])], ALERT)
    assert [r["correlation_type"] for r in correlate.correlate(d, a).collect()] == ["attack_pattern"]


def test_previous_value_across_empty_slices(spark):
    rows = [("k", BASE + dt.timedelta(seconds=s), i, v) for i, (s, v) in enumerate([(0, 1), (10, 2), (5000, 3), (5001, 4), (90000, 5)])]
    df = spark.createDataFrame(rows, "k string, ts timestamp, id int, v int")
    got = slices.with_previous(df, ["k"], ["ts", "id"], "v", 60).orderBy("id").collect()
    assert [r["previous"] for r in got] == [None, 1, 2, 3, 4]


def test_row_numbers_are_dense_under_a_dominant_key(spark):
    rows = [("hot" if i % 3 else f"k{i % 7}", f"{(i * 7919) % 3001:05d}") for i in range(3001)]
    got = slices.number_rows(spark.createDataFrame(rows, "k string, o string"), ["k"], ["o"]).collect()
    want = {}
    for k, o in sorted(rows):
        want[(k, o)] = want.get("n" + k, 0) + 1
        want["n" + k] = want[(k, o)]
    assert all(want[(r["k"], r["o"])] == r["flow_seq"] for r in got) and len(got) == len(rows)


def test_related_alerts_are_sent_to_the_detections(spark):
    """Few alerts by cycle, attack and rule do not make detections move a third time, whatever the planner's own limit."""
    dets = spark.createDataFrame([("2-1", "10.0.0.1", "10.0.0.2", "PORTSCAN", 2, 0.5, BASE)], DET)
    alerts = spark.createDataFrame([(BASE, 1, "R", 5, "d", "10.0.0.9", "10.0.0.8", ["scan"])], ALERT)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = correlate.correlate(dets, alerts)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert [(r["rule_id"], r["nids"]["dst_ip"], r["correlation_type"]) for r in found.collect()] == [("R", "10.0.0.2", "attack_pattern")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("BroadcastHashJoin") == 1 and plan.count("SortMergeJoin") == 2
