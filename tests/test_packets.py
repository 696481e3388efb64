"""Packets to flows: slices do not show in the result, and rows are exchanged once."""

import datetime as dt
import random

from netvigil.operators import packets

SCHEMA = ("packet_id long, ts timestamp, src_ip string, dst_ip string, src_port int, dst_port int, protocol string, "
          "len long, header_len int, flags int, win int")


def conversation(spark, n=400, seed=5):
    rng, t, rows = random.Random(seed), 0.0, []
    for i in range(n):
        t += rng.choice([0.0, 0.2, 1.0, 6.0, 40.0, 119.0, 121.0, 900.0])
        a, b = ("10.0.0.1", 1000), ("10.0.0.2", 80)
        if rng.random() < 0.4:
            a, b = b, a
        rows.append((i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=t), a[0], b[0], a[1], b[1],
                     rng.choice(["TCP", None]), rng.randrange(40, 1500), 20, rng.randrange(256), i))
    return spark.createDataFrame(rows, SCHEMA)


def rounded(df):
    return sorted(str([round(v, 6) if isinstance(v, float) else v for v in r]) for r in df.collect())


def test_slice_length_does_not_show(spark):
    df = conversation(spark)
    whole = rounded(packets.to_flows(df, slice_seconds=10**8))
    assert len(whole) > 20
    assert rounded(packets.to_flows(df, slice_seconds=7)) == whole
    assert rounded(packets.to_flows(df, slice_seconds=600)) == whole


def test_sessions_and_bursts_of_a_plain_walk(spark):
    got = sorted(packets.sessionize(conversation(spark), slice_seconds=60).collect(), key=lambda r: (r["ts"], r["packet_id"]))
    last, state = {}, {}
    for r in got:
        key, t = r["protocol"], r["t"]
        s = state.setdefault(key, {"session": 0, "burst": 0, "sides": {}})
        gap = t - last[key] if key in last else None
        if gap is not None:
            s["burst"] += gap > 5
            if gap > 120:
                s["session"] += 1
                s["sides"] = {}
        assert (r["session"], r["burst"]) == (s["session"], s["burst"])
        assert r["iat"] == (gap if gap is not None and gap <= 120 else None)
        side = s["sides"].get(r["from_a"])
        assert r["dir_iat"] == (t - side if side is not None else None)
        s["sides"][r["from_a"]], last[key] = t, t
    ends = {}
    for r in got:
        ends.setdefault((r["protocol"], r["burst"]), []).append(r)
    for rows in ends.values():
        told = [r["burst_length"] for r in rows if r["burst_length"] is not None]
        assert told == [max(r["t"] for r in rows) - min(r["t"] for r in rows)]


def test_one_scan_and_four_exchanges(spark, tmp_path):
    conversation(spark).write.parquet(str(tmp_path / "packets"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        flows = packets.to_flows(spark.read.parquet(str(tmp_path / "packets")))
        plan = flows._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert plan.count("FileScan") == 1
    exchanges = [line for line in plan.splitlines() if "Exchange " in line]
    assert sum("ReusedExchange" in line for line in exchanges) == 1
    assert sum("ReusedExchange" not in line for line in exchanges) == 4


def test_empty_and_untimed_packets(spark):
    df = conversation(spark, 3)
    assert packets.to_flows(df.limit(0)).count() == 0
    untimed = df.selectExpr("packet_id", "cast(null as timestamp) ts", *df.columns[2:])
    assert packets.to_flows(df.unionByName(untimed)).count() >= 1
