"""Queries: files written to scratch folders and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from netvigil.models import classifiers, store
from netvigil.operators import clean, detect, metrics, report, respond
from netvigil.plans import adapters as a
from netvigil.plans.correlation import BLOCK_CTES, DAY, FEED_EXTRA, _feed, block_input
from netvigil.plans.detection import DET_OUT, DET_SQL, _summary
from netvigil.plans.models import labelled_vectors
from netvigil.plans.oracle import LEVEL_NAME, sql
from netvigil.plans.registry import query
from netvigil.plans.sources import _now
from netvigil.plans.training import PRED, predictions
from netvigil.session import scratch_path
from netvigil.sources import flows, sinks


@query("s01_flow_csv_scan", sql("""
  select flow_duration, tot_fwd_pkts, case when protocol = 'TCP' then active_mean end as active_mean, label, protocol from flows""", "flows"))
def s01(spark, d):
    """Two header dialects: long names with stray blanks, and short names."""
    f, root = a.flows(spark, d), scratch_path(spark, "csv")
    long = f.filter("protocol = 'TCP'").select(
        F.col("flow_duration").alias(" Flow Duration"), F.col("tot_fwd_pkts").alias("Total Fwd Packets"),
        F.col("active_mean").alias(" Active Mean"), F.col("label").alias(" Label"), F.col("protocol").alias("Protocol"))
    short = f.filter("protocol = 'UDP'").select("label", "protocol", "tot_fwd_pkts", "flow_duration")
    sinks.write_csv(long, f"{root}/long")
    sinks.write_csv(short, f"{root}/short")
    numeric = ["flow_duration", "tot_fwd_pkts", "active_mean"]
    read = flows.read_flow_files(spark, [f"{root}/long", f"{root}/short"], numeric=numeric)
    return read.select(*numeric, "label", "protocol")


@query("s02_load_for_test", sql("""
  select case when dst_port = 21 then 0.0 when dst_port = 22 then 0.0 else flow_duration end as flow_duration, label from flows
  where dst_port <> 23""", "flows"))
def s02(spark, d):
    port = F.col("dst_port")
    f = a.flows(spark, d).select(
        F.when(port == 21, None).when(port == 22, float("inf")).when(port == 23, None).otherwise(F.col("flow_duration")).alias(" flow_duration"),
        F.when(port != 23, F.col("label")).alias("label "))
    return flows.load_for_test(f, ["flow_duration"])


@query("s11_correlation_log", sql(f"""
  select concat('{{"timestamp":"2024-02-01T00:00:00.000000","action":"correlation","correlation_type":"', correlation_type,
    '","threat_level":"', {LEVEL_NAME}, '","description":"', description, '","nids":', case when attack_type is null then 'null' else concat('"', attack_type, '"') end,
    ',"hids_rule":"', rule_id, '"}}') as value from feed""", "kept", "alerts", extra=FEED_EXTRA))
def s11(spark, d):
    path = scratch_path(spark, "correlation-log")
    sinks.append_lines(sinks.correlation_log(_feed(spark, d), _now()), path)
    return spark.read.text(path)


@query("s12_block_log", sql(f"""
  select concat('{{"timestamp":"', strftime(blocked_at, '%Y-%m-%dT%H:%M:%S.%f'), '","action":"block","ip":"', ip, '","duration":{DAY},"reason":"',
    reason, '"}}') as value from blocks""", "alerts", recursive=True, extra=BLOCK_CTES))
def s12(spark, d):
    path = scratch_path(spark, "block-log")
    sinks.append_lines(sinks.block_log(respond.block_events(block_input(spark, d), DAY), DAY), path)
    return spark.read.text(path)


@query("s18_model_store")
def s18(spark, d):
    path = scratch_path(spark, "model")
    rows = labelled_vectors(spark, d)
    model = classifiers.decision_tree().fit(rows.filter("split = 'train'"))
    store.save_model(spark, [model], path, {"feature_columns": ["embedding"], "window_size": 1, "label_mapping": {}})
    loaded, meta = store.load_model(spark, path)
    again = loaded.transform(rows).select("vec_id", F.col("prediction").alias("stored"))
    both = classifiers.predict(model, rows).join(again, "vec_id")
    return both.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("pred") == F.col("stored")).alias("equal"),
                    F.lit(meta["window_size"]).alias("window_size"))


@query("s19_results_json", sql("""select 'rule' as model, round(avg(f1), 6) as f1_macro from graded""", "flows", extra=PRED))
def s19(spark, d):
    path = scratch_path(spark, "results")
    out = metrics.model_metrics(predictions(spark, d), "rule")
    sinks.write_json(out, path)
    return spark.read.schema(out.schema).json(path).select("model", F.round("f1_macro", 6).alias("f1_macro"))


@query("s20_session_stats_json", sql("""select max(cycles) as cycles, cast(max(session_flows) as bigint) as total_flows,
    cast(max(session_attacks) as bigint) as total_attacks from (select count(*) as cycles, sum(total_flows) as session_flows,
    sum(unique_attacks) as session_attacks from summary where unique_attacks > 0)""", "summary"))
def s20(spark, d):
    path = scratch_path(spark, "stats")
    totals = report.session_totals(_summary(spark, d)).agg(
        F.max("cycles").alias("cycles"), F.max("session_flows").alias("total_flows"),
        F.max("session_attacks").alias("total_attacks"))
    sinks.write_json(totals, path)
    return spark.read.schema(totals.schema).json(path)


@query("s21_latest_artifact", "select 'model_latest.json' as name, count(*) as rows from nation")
def s21(spark, d):
    root = scratch_path(spark, "artifacts")
    nations = a.table(spark, d, "nation")
    for name in ("model_latest.json", "model_20240101.json", "other.json"):
        sinks.write_json(nations, f"{root}/{name}")
    folder = sinks.latest_artifact(spark, root, "model_", ".json").first()["name"]
    return spark.read.json(f"{root}/{folder}").agg(F.lit(folder).alias("name"), F.count(F.lit(1)).alias("rows"))


@query("f01_whitelist_networks", sql(f"""
  select {DET_SQL} from det where not (src_ip like '10.0.0.%' and cast(split_part(src_ip, '.', 4) as integer) between 64 and 127)
    and dst_ip <> '172.16.0.5'""", "det"))
def f01_networks(spark, d):
    entries = spark.createDataFrame([("10.0.0.64/26",), ("172.16.0.5",)], "ip string")
    return detect.drop_whitelisted_networks(a.raw_detections(spark, d), entries).selectExpr(*DET_OUT)


@query("p19_constant_label", sql("select flow_id, 'BENIGN' as label from flows", "flows"))
def p19(spark, d):
    return a.flows(spark, d).select("flow_id").withColumn("label", F.lit("BENIGN"))


@query("p03_long_headers", sql('select flow_duration as "Flow Duration", tot_fwd_pkts as "Total Fwd Packets" from flows', "flows"))
def p03(spark, d):
    return clean.long_headers(a.flows(spark, d).select("flow_duration", "tot_fwd_pkts"))


@query("t06_preview", sql("select flow_id, label from flows order by flow_id limit 5", "flows"))
def t06(spark, d):
    return a.flows(spark, d).select("flow_id", "label").orderBy("flow_id").limit(5)
