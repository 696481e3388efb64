"""Streams equal batches whatever the cut: cycles over two batches, late events, closed cycles."""

from datetime import datetime, timedelta
from pathlib import Path

from pyspark.sql import functions as F

from netvigil.operators import detect, rules
from netvigil.plans.streams import Feed, replay, replay_feeds
from netvigil.streaming import detect_loop, rule_stream, summaries
from netvigil.streaming.batches import read_updates

T0 = datetime(2024, 1, 1)
DET = ("capture_id string, flow_id string, src_ip string, dst_ip string, src_port int, dst_port int, protocol string, ts timestamp_ntz, "
       "attack_type string, confidence double, layer string, threat_level int, anomaly_score double, det_seq string, batch int")


def detections(spark, *rows):
    """(seconds, batch) rows of one source and attack."""
    return spark.createDataFrame([("c", f"f{i}", "10.0.0.1", "10.0.0.2", 1, 22, "TCP", T0 + timedelta(seconds=t), "PORTSCAN", 0.9, "suricata", 2, None,
                                   f"{i:04d}", b) for i, (t, b) in enumerate(rows)], DET)


def hosts(spark):
    schema = ("ts timestamp_ntz, event_id long, rule_id string, rule_level int, rule_description string, agent_id string, agent_name string, "
              "agent_ip string, src_ip string, dst_ip string, full_log string, groups array<string>")
    return spark.createDataFrame([(T0, 1, "R-1", 5, "d", "1", "a", "10.0.0.2", "10.0.0.1", None, "l", ["scan"])], schema)


def correlated(spark, rows, lateness):
    config = lambda root: detect_loop.LoopConfig(f"{root}/out", f"{root}/ckpt", cycle_seconds=15, lookback_seconds=300,
                                                 lateness_seconds=lateness)
    root = replay(detections(spark, *rows), F.col("batch"), lambda s, root: detect_loop.correlation_loop(s, hosts(spark), config(root)))
    found = read_updates(spark, f"{root}/out/correlated", "cycle").select("cycle", "nids.det_seq").collect()
    return sorted(r["det_seq"] for r in found), spark.read.parquet(f"{root}/out/late").count()


def test_a_cycle_over_two_batches_is_reported_once(spark):
    assert correlated(spark, [(3, 0), (9, 1)], 60) == (["0000"], 0)


def test_late_detections_join_open_cycles_only(spark):
    # the first row arrives last: its cycle is open, it takes the report over
    assert correlated(spark, [(3, 2), (9, 0), (40, 1)], 60) == (["0000", "0002"], 0)
    assert correlated(spark, [(3, 2), (9, 0), (140, 1)], 60) == (["0001", "0002"], 1)


def test_late_events_complete_a_rule(spark):
    rows = [(0, 0), (10, 0), (20, 0), (50, 0), (30, 1)]
    root = replay(detections(spark, *rows), F.col("batch"), lambda s, root: rule_stream.rule_stream(s, f"{root}/out", f"{root}/ckpt", lateness_seconds=60))
    stream = read_updates(spark, f"{root}/out/hits", "det_seq").select("det_seq", "rule_id").collect()
    batch = rules.hits(rules.with_history_flags(rules.with_static_flags(detections(spark, *rows), rules.RULES), rules.RULES), rules.RULES)
    assert sorted(stream) == sorted(batch.select("det_seq", "rule_id").collect())
    stateful = {r.id for r in rules.RULES if r.timeframe}
    assert any(r["rule_id"] in stateful for r in stream)


def test_replayed_files_move_and_rows_without_a_chunk_come_first(spark):
    rows = spark.createDataFrame([("a", T0, 1), ("b", T0, None), ("c", T0, 10), ("d", T0, 2)], "k string, ts timestamp, chunk int")
    seen = []
    root = replay_feeds(spark, {"x": Feed(rows)}, lambda root: spark.readStream.schema("k string, ts timestamp").parquet(f"{root}/source/x")
                        .writeStream.foreachBatch(lambda b, _: seen.append([r["k"] for r in b.collect()]))
                        .option("checkpointLocation", f"{root}/c").trigger(availableNow=True).start())
    assert seen == [["b"], ["a"], ["d"], ["c"]]
    staged = [p for p in Path(root.removeprefix("file:")).glob("staged/x/chunk=*/*") if p.name.startswith("part")]
    assert not staged and spark.read.parquet(f"{root}/source/x").count() == 4


def test_the_late_side_is_one_join(spark):
    landed = spark.createDataFrame([("a", 1), ("b", 2), (None, 3), ("b", 4)], "k string, n int")
    late = summaries.late_side(landed, spark.createDataFrame([("b",), ("b",)], "k string"), ["k"])
    assert sorted(r["n"] for r in late.collect()) == [1, 3]
    assert "Aggregate" not in late._jdf.queryExecution().optimizedPlan().toString()


def test_the_loop_caches_no_rows(spark, monkeypatch):
    flows = detections(spark, (0, 1), (1, 1), (2, 2)).withColumn("label", F.lit("PortScan"))

    def refuse(self, *_):
        raise AssertionError("rows of a batch are cached")

    monkeypatch.setattr(type(flows), "persist", refuse)
    none = spark.createDataFrame([], "ip string")
    root = replay(flows.drop("batch", "attack_type", "layer", "threat_level", "anomaly_score", "det_seq"), F.lit(1),
                  lambda s, root: detect_loop.detection_loop(s, lambda b: detect.flow_detections(b, detect.classifier_hit()), none,
                                                             detect_loop.LoopConfig(f"{root}/out", f"{root}/ckpt")))
    summary = spark.read.parquet(f"{root}/out/summary").collect()
    assert [(r["total_flows"], r["unique_attacks"], r["attack_flows"], r["filtered_count"]) for r in summary] == [(3, 1, 3, 0)]
    assert spark.read.parquet(f"{root}/out/outbox").count() > 0
