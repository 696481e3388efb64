"""Streams over engine-kept state: equal to the batch operators for any cut, late rows counted, state bounded."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from netvigil.operators import correlate, respond, rules
from netvigil.plans.streams import Feed, closing_mark, replay_feeds
from netvigil.streaming import correlation, keyed
from netvigil.streaming.batches import late_rows, state_rows

T0 = datetime(2024, 1, 1)
EVENT = "ip string, ts timestamp, reason string, chunk int"
DET = ("capture_id string, flow_id string, src_ip string, dst_ip string, src_port int, dst_port int, protocol string, ts timestamp_ntz, "
       "attack_type string, confidence double, layer string, threat_level int, anomaly_score double, det_seq string, chunk int")
HOST = ("ts timestamp_ntz, event_id long, rule_id string, rule_level int, rule_description string, agent_ip string, src_ip string, "
        "groups array<string>, chunk int")


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def run(spark, feeds, start):
    """Root of the outputs and the queries of all chunks."""
    queries = []

    def begin(root):
        streams = {n: spark.readStream.schema(f.rows.drop("chunk").schema).parquet(f"{root}/source/{n}") for n, f in feeds.items()}
        queries.append(start(root, streams))
        return queries[-1]

    return replay_feeds(spark, feeds, begin), queries


def blocks_of(spark, events, lateness):
    root, queries = run(spark, {"events": Feed(events)}, lambda root, s: keyed.block_stream(s["events"], f"{root}/out", f"{root}/c", 300, lateness))
    return spark.read.parquet(f"{root}/out"), queries


def test_blocks_and_unblocks_of_shuffled_events(spark):
    draw = random.Random(1)
    rows = [(f"10.0.0.{draw.randrange(6)}", at(draw.randrange(4000) + draw.random()), f"r{draw.randrange(3)}", draw.randrange(3)) for _ in range(400)]
    rows += [(None, at(5), "r", 0), ("10.0.0.1", None, "r", 1)]
    events = spark.createDataFrame(rows, EVENT)
    out, queries = blocks_of(spark, closing_mark(events, at(4000), 9000), 5000)
    want = respond.block_events(events.where("ip is not null and ts is not null").drop("chunk"), 300)
    columns = ["ip", "blocked_at", "expires_at", "reason"]
    for action in ("block", "unblock"):
        assert sorted(out.where(F.col("action") == action).select(*columns).collect()) == sorted(want.select(*columns).collect())
    assert sum(map(late_rows, queries)) == 0 and state_rows(queries[-1]) == 0


def test_late_events_are_counted_and_do_not_block(spark):
    rows = [("a", at(0), "r", 0), ("a", at(1000), "r", 1), ("a", at(2000), "r", 2), ("a", at(500), "late", 3)]
    out, queries = blocks_of(spark, closing_mark(spark.createDataFrame(rows, EVENT), at(2000), 900), 60)
    assert sorted(r["blocked_at"] for r in out.where("action = 'block'").collect()) == [at(0), at(1000), at(2000)]
    assert sum(map(late_rows, queries)) == 1


def test_a_hot_address_keeps_little_state(spark):
    """What falls into a running block is not held."""
    rows = spark.range(60_000).select(F.lit("a").alias("ip"), (F.lit(T0) + F.make_dt_interval(secs=F.col("id") / 20)).alias("ts"),
                                      F.lit("r").alias("reason"), F.floor(F.col("id") / 20_000).cast("int").alias("chunk"))
    out, queries = blocks_of(spark, closing_mark(rows, at(3000), 900), 60)
    assert sorted(r["blocked_at"] for r in out.where("action = 'block'").collect()) == [at(300 * i) for i in range(10)]
    assert state_rows(queries[0]) < 20 and state_rows(queries[-1]) == 0


def detection(i, seconds, src, attack, level, chunk, dst="10.0.0.99"):
    return ("c", f"f{i}", src, dst, 1, 22, "TCP", None if seconds is None else at(seconds), attack, 0.97, "suricata", level, None, f"{i:05d}", chunk)


def test_rules_of_shuffled_detections(spark):
    draw = random.Random(2)
    rows = [detection(i, draw.randrange(3000), f"10.0.0.{draw.randrange(4)}", draw.choice(["PORTSCAN", "DOS HULK", "SSH-PATATOR", "BOT"]),
                      draw.randint(1, 4), draw.randrange(3)) for i in range(500)]
    rows.append(detection(900, None, "10.0.0.1", "DOS HULK", 4, 0))
    det = spark.createDataFrame(rows, DET)
    root, queries = run(spark, {"d": Feed(closing_mark(det, at(3000), 9000))}, lambda root, s: keyed.rule_stream(
        s["d"], f"{root}/out", f"{root}/c", lateness=4000))
    got = spark.read.parquet(f"{root}/out").where("det_seq is not null")
    want = rules.evaluate(det)
    columns = ["det_seq", "rule_id", "level", "description"]
    assert sorted(got.select(*columns).collect()) == sorted(want.select(*columns).collect())
    assert {r.id for r in rules.RULES if r.matched} <= {r["rule_id"] for r in got.collect()}
    assert state_rows(queries[-1]) < 5


def test_a_batch_reads_its_own_sources_only(spark):
    """The history of the first batch's sources stays untouched while others report."""
    rows = [detection(i, i % 50, f"10.0.1.{i % 40}", "DOS", 4, 0) for i in range(400)] + [detection(900 + i, 100 + i, "10.0.2.1", "DOS", 4, 1) for i in range(5)]
    _, queries = run(spark, {"d": Feed(spark.createDataFrame(rows, DET))}, lambda root, s: keyed.rule_stream(
        s["d"], f"{root}/out", f"{root}/c", lateness=3600))
    second = [r for r in queries[1].recentProgress if r["numInputRows"]]
    assert second[0]["numInputRows"] == 2 * 5  # the rules on one event read the batch too
    assert second[0]["stateOperators"][0]["numRowsUpdated"] <= 3


@pytest.fixture(scope="module")
def sides(spark):
    draw = random.Random(3)
    attacks = ["PORTSCAN", "DOS", "SSH-PATATOR", "WEB XSS", "BOT", None]
    det = [detection(i, draw.randrange(600), draw.choice(["10.0.0.1", "10.0.0.2", None]), draw.choice(attacks), draw.randint(1, 4), draw.randrange(3),
                     f"10.0.9.{draw.randrange(3)}") for i in range(120)]
    host = [(at(draw.randrange(600)), i, f"R{draw.randrange(4)}", draw.randrange(16), "d", f"10.0.9.{draw.randrange(4)}",
             draw.choice(["10.0.0.1", "10.0.0.3", "", None]), draw.choice([["scan"], ["sshd", "x"], ["flood"], []]), draw.randrange(3)) for i in range(80)]
    return spark.createDataFrame(det, DET), spark.createDataFrame(host, HOST)


@pytest.mark.parametrize("lookback", [300, 40, 10])
def test_two_streams_equal_the_batch(spark, sides, lookback):
    det, host = sides
    feeds = {"d": Feed(closing_mark(det, at(600), 3000)), "h": Feed(closing_mark(host, at(600), 3000))}
    root, queries = run(spark, feeds, lambda root, s: correlation.append_correlations(
        s["d"], s["h"], f"{root}/out", f"{root}/c", interval=15, lookback=lookback, detection_lateness=700, alert_lateness=700, salts=2))
    columns = ["cycle", "src_ip", "attack_type", "rule_id", "correlation_type", "threat_level", "description"]
    got = spark.read.parquet(f"{root}/out").select(*columns, "nids.det_seq", "hids.event_id")
    want = correlate.correlate(*correlate.assign_cycles(det.drop("chunk"), host.drop("chunk"), 15, lookback), scope=("cycle",))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*columns, "nids.det_seq", "hids.event_id").collect()))
    assert state_rows(queries[-1]) == 0 and sum(map(late_rows, queries)) == 0


def test_closed_cycles_leave_the_state(spark):
    """State follows the open cycles, not the length of the stream; what comes behind the watermark is counted."""
    det = [detection(i, 30 * i, "10.0.0.1", "PORTSCAN", 2, i // 20) for i in range(80)] + [detection(999, 3, "10.0.0.1", "PORTSCAN", 2, 3)]
    host = [(at(30 * i), i, "R", 5, "d", "10.0.9.1", "10.0.0.1", ["scan"], i // 20) for i in range(80)]
    feeds = {"d": Feed(spark.createDataFrame(det, DET)), "h": Feed(spark.createDataFrame(host, HOST))}
    _, queries = run(spark, feeds, lambda root, s: correlation.append_correlations(
        s["d"], s["h"], f"{root}/out", f"{root}/c", interval=15, lookback=15, detection_lateness=30, alert_lateness=30, salts=2))
    sizes = [state_rows(q) for q in queries]
    assert max(sizes) == sizes[0] < 40 and sum(map(late_rows, queries)) >= 1


def test_alert_files_are_tailed(spark, tmp_path):
    source = tmp_path / "alerts"
    source.mkdir()
    (source / "one.json").write_text('{"timestamp": "2024-01-01T00:00:00Z", "rule": {"id": "1", "level": 5}}\nbroken\n\n')
    seen = []
    for more in ("", '{"timestamp": "2024-01-01T00:01:00Z", "rule": {"id": "2"}}\n'):
        if more:
            (source / "two.json").write_text(more)
        query = correlation.tail_host_alerts(spark, str(source)).writeStream.foreachBatch(
            lambda batch, _: seen.append(sorted(r["rule_id"] for r in batch.collect()))).option(
            "checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
    assert seen == [["1"], ["2"]]


def test_state_holds_an_address_pair_once_and_terms_unsalted(spark):
    """Tokens of a detection and the salted copies of an alert are made of what leaves the first state."""
    feeds = {"d": Feed(spark.createDataFrame([detection(i, i, "10.0.0.1", "PORTSCAN", 2, 0) for i in range(5)], DET)),
             "h": Feed(spark.createDataFrame([(at(1), 1, "R", 5, "d", "10.0.9.1", "10.0.0.1", ["scan"], 0)], HOST))}
    _, queries = run(spark, feeds, lambda root, s: correlation.append_correlations(
        s["d"], s["h"], f"{root}/out", f"{root}/c", interval=15, lookback=15, detection_lateness=700, alert_lateness=700, salts=8))
    assert state_rows(queries[0]) == 1 + 3  # the alert by source, agent and term
