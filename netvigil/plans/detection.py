"""Queries: layer union, whitelist, dedup, reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from netvigil.operators import detect, report
from netvigil.plans import adapters as a
from netvigil.plans.oracle import LEVEL_NAME, sql
from netvigil.plans.registry import query

DET_OUT = [
    "capture_id", "flow_id", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "attack_type",
    "round(confidence, 6) as confidence", "layer", "threat_level",
    "round(anomaly_score, 6) as anomaly_score", "det_seq",
]
DET_SQL = """capture_id, flow_id, src_ip, dst_ip, src_port, dst_port, protocol, attack_type,
  round(confidence, 6) as confidence, layer, threat_level, round(anomaly_score, 6) as anomaly_score, det_seq"""


@query("u02_layer_union", sql(f"select {DET_SQL} from det", "det"))
def u02(spark, d):
    return a.raw_detections(spark, d).selectExpr(*DET_OUT)


@query("f01_whitelist_filter", sql(f"select {DET_SQL} from kept", "kept"))
def f01(spark, d):
    return a.kept_detections(spark, d).selectExpr(*DET_OUT)


@query("a01_dedup", sql(f"select {DET_SQL}, flow_count from uniq", "uniq"))
def a01(spark, d):
    return a.unique_detections(spark, d).selectExpr(*DET_OUT, "flow_count")


@query("a02_by_level", sql(f"""
  select threat_level, {LEVEL_NAME} as threat_name, count(*) as detections, cast(sum(flow_count) as bigint) as flows
  from uniq group by threat_level""", "uniq"))
def a02(spark, d):
    return report.by_level(a.unique_detections(spark, d, "threat_level"))


@query("a03_by_attack_cycle", sql("""
  select capture_id, attack_type, cast(sum(flow_count) as bigint) as flows, arg_min(threat_level, det_seq) as threat_level
  from uniq group by capture_id, attack_type""", "uniq"))
def a03(spark, d):
    return report.by_attack_cycle(a.unique_detections(spark, d, "threat_level"))


@query("a04_by_layer", sql("""
  select layer, count(*) as detections, cast(sum(flow_count) as bigint) as flows from uniq group by layer""", "uniq"))
def a04(spark, d):
    return report.by_layer(a.unique_detections(spark, d, "layer"))


SUMMARY_SQL = """select attack_type, count(*) as detections, cast(sum(flow_count) as bigint) as flows,
  round(max(confidence), 6) as max_confidence from uniq group by attack_type"""


@query("a05_attack_summary", sql(SUMMARY_SQL, "uniq"))
def a05(spark, d):
    return report.attack_summary(a.unique_detections(spark, d, "confidence")).withColumn(
        "max_confidence", F.round("max_confidence", 6))


@query("t02_attack_sort", sql(f"""
  select cast(row_number() over (order by flows desc, attack_type) as integer) as position, attack_type, flows
  from ({SUMMARY_SQL})""", "uniq"))
def t02(spark, d):
    # One row per attack type, already aggregated: the ranking window is over that short report.
    w = Window.orderBy(F.desc("flows"), "attack_type")
    return report.attack_summary(a.unique_detections(spark, d, "confidence")).select(
        F.row_number().over(w).alias("position"), "attack_type", "flows")


def _summary(spark, d):
    raw = a.raw_detections(spark, d)
    kept = detect.drop_whitelisted(raw, a.whitelist(spark, d))
    return detect.cycle_summary(a.flows(spark, d), raw, detect.dedup(kept, columns=[]))


@query("a06_cycle_summary", sql("select * from summary", "summary"))
def a06(spark, d):
    return _summary(spark, d)


@query("a25_session_totals", sql("""
  select capture_id, count(*) over w as cycles, cast(sum(total_flows) over w as bigint) as session_flows,
    cast(sum(unique_attacks) over w as bigint) as session_attacks
  from summary where unique_attacks > 0
  window w as (order by capture_id rows between unbounded preceding and current row)""", "summary"))
def a25(spark, d):
    return report.session_totals(_summary(spark, d))


@query("a07_attack_ips", sql("select distinct src_ip from uniq", "uniq"))
def a07(spark, d):
    return report.attack_ips(a.unique_detections(spark, d, "threat_level"))


@query("a07_attack_ip_count", sql("select count(distinct src_ip) as attack_ips from uniq", "uniq"))
def a07_count(spark, d):
    return report.attack_ip_count(a.unique_detections(spark, d, "threat_level"))


@query("a28_report_grouping_sets", sql("""
  select threat_level, attack_type, layer, cast(grouping(threat_level, attack_type, layer) as bigint) as report_id,
    count(*) as detections, cast(sum(flow_count) as bigint) as flows, round(max(confidence), 6) as max_confidence
  from uniq group by grouping sets ((threat_level), (attack_type), (layer), ())""", "uniq"))
def a28(spark, d):
    return report.one_pass_report(a.unique_detections(spark, d, "threat_level", "layer", "confidence")).withColumn(
        "max_confidence", F.round("max_confidence", 6))


TOP_SQL = "src_ip, dst_ip, attack_type, round(confidence, 6) as confidence, layer, threat_level, flow_count, det_seq"
TOP_OUT = ["src_ip", "dst_ip", "attack_type", "round(confidence, 6) as confidence", "layer",
           "threat_level", "flow_count", "det_seq"]


@query("t01_top5", sql(f"select {TOP_SQL} from uniq order by uniq.confidence desc, uniq.det_seq limit 5", "uniq"))
def t01(spark, d):
    return report.top_threats(a.unique_detections(spark, d, "confidence", "layer", "threat_level")).selectExpr(*TOP_OUT)


@query("w07_top5_per_level", sql(f"""
  select {TOP_SQL}, cast(rk as integer) as rank, level_total, level_flows,
    greatest(level_total - 5, 0) as more from (
    select *, row_number() over (partition by threat_level order by confidence desc, det_seq) as rk,
      count(*) over (partition by threat_level) as level_total,
      cast(sum(flow_count) over (partition by threat_level) as bigint) as level_flows from uniq) where rk <= 5""", "uniq"))
def w07(spark, d):
    return report.top_per_level(a.unique_detections(spark, d, "confidence", "layer", "threat_level")).selectExpr(*TOP_OUT, "rank", "level_total", "level_flows", "more")


@query("f02_non_benign", sql("select flow_id, label from flows where upper(label) <> 'BENIGN'", "flows"))
def f02(spark, d):
    return detect.non_benign(a.flows(spark, d)).select("flow_id", "label")


@query("f03_anomaly_predicate", sql("""
  select flow_id, round(-score, 4) as isolation_score, score > cast(0.0888 as double) as error_anomaly,
    (-score < -0.45 or label = 'Bot') as isolation_anomaly
  from flows where score > cast(0.0888 as double) or -score < -0.45 or label = 'Bot'""", "flows"))
def f03(spark, d):
    f = a.flows(spark, d)
    iso = detect.isolation_predicate(-F.col("score"), F.col("label") == "Bot", -0.45)
    err = F.col("score") > a.ERROR_THRESHOLD
    return f.filter(iso | err).select(
        "flow_id", F.round(-F.col("score"), 4).alias("isolation_score"), err.alias("error_anomaly"),
        iso.alias("isolation_anomaly"))
