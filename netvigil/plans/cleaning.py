"""Queries: header repair, null handling, column statistics, feature selection."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from netvigil.operators import clean, quantiles, report, select
from netvigil.plans import adapters as a
from netvigil.plans.oracle import sql
from netvigil.plans.registry import query

FEATURES = a.FLOW_FEATURES


def dirty_flows(spark, d):
    """Flows with missing and non-finite feature values."""
    f = a.flows(spark, d)
    line, dur = F.col("dst_port"), F.col("flow_duration")
    return f.select(
        "flow_id", "label",
        F.when(line == 21, None).when(line == 22, float("inf")).when(line == 23, float("-inf"))
        .when(line == 24, float("nan")).otherwise(dur).alias("flow_duration"),
        F.when(F.col("protocol") == "UDP", None).otherwise(F.col("tot_fwd_pkts")).alias("tot_fwd_pkts"),
        F.when(line != 27, None).otherwise(F.col("active_mean")).alias("idle_mean"),
        F.when((line != 27) | (F.col("protocol") == "UDP") | (F.col("label") != "BENIGN"), None)
        .otherwise(F.col("active_mean")).alias("idle_std"),
        "down_up_ratio",
    )


DIRTY = """dirty as (select flow_id, label,
  case dst_port when 21 then null when 22 then cast('inf' as double) when 23 then cast('-inf' as double)
    when 24 then cast('nan' as double) else flow_duration end as flow_duration,
  case when protocol = 'UDP' then null else tot_fwd_pkts end as tot_fwd_pkts,
  case when dst_port <> 27 then null else active_mean end as idle_mean,
  case when dst_port <> 27 or protocol = 'UDP' or label <> 'BENIGN' then null else active_mean end as idle_std,
  down_up_ratio from flows)"""
FINITE = "(not isnan(flow_duration) and not isinf(flow_duration))"


def dsql(body: str) -> str:
    return sql(body, "flows", extra=DIRTY)


@query("p01_p03_headers", sql("""
  select flow_id, flow_duration, tot_fwd_pkts, active_mean as pkt_len_min, label from flows""", "flows"))
def p01(spark, d):
    f = a.flows(spark, d).select(
        F.col("flow_id").alias("Flow ID"), F.col("flow_duration").alias(" Flow Duration"),
        F.col("tot_fwd_pkts").alias("Total Fwd Packets "), F.when(F.lit(False), 0.0).alias("min_pkt_len"),
        F.col("active_mean").alias(" Min Packet Length"), F.col("label").alias(" Label"))
    return clean.canonical_headers(f)


@query("p02_p04_reference_columns", sql("select tot_fwd_pkts, flow_duration, label from flows", "flows"))
def p02(spark, d):
    f = a.flows(spark, d).select(
        F.col("tot_fwd_pkts").alias(" tot_fwd_pkts"), "flow_duration", F.col("label").alias("label "), "protocol")
    return clean.keep_reference_columns(clean.trim_headers(f), FEATURES)


@query("p05_feature_cols", sql("""
  select src_port, dst_port, confidence, score, flow_duration, tot_fwd_pkts, down_up_ratio, active_mean from flows""", "flows"))
def p05(spark, d):
    f = a.flows(spark, d).withColumn("protocol number", F.lit(6)).withColumn("attack number", F.lit(1))
    return f.select(*clean.feature_columns(f))


@query("p06_align", sql("""
  select cast(dst_port as double) as "dst port", flow_duration, cast(null as double) as tot_fwd_pkts from flows
  union all select cast(dst_port as double), null, tot_fwd_pkts from flows""", "flows"))
def p06(spark, d):
    f = a.flows(spark, d)
    one = f.select(F.col("dst_port").alias("dst port"), "flow_duration", "label")
    two = f.select(F.col("dst_port").alias("dst port"), "tot_fwd_pkts", "src_ip")
    return clean.union_aligned([one, two])


@query("p06_align_spellings", sql("""
  select flow_duration as "Flow Duration", coalesce(case when dst_port > 22 then tot_fwd_pkts end, active_mean) as "tot fwd-pkts" from flows
  union all select case when protocol = 'TCP' then flow_duration end, tot_fwd_pkts from flows""", "flows"))
def p06_spellings(spark, d):
    """Two sources spell a feature differently, one has it twice; nulls stand in either."""
    f = a.flows(spark, d)
    one = f.select(F.col("flow_duration").alias("Flow Duration"), F.when(F.col("dst_port") > 22, F.col("tot_fwd_pkts")).alias("tot fwd-pkts"),
                   F.col("active_mean").alias("TOT_FWD_PKTS"))
    two = f.select(F.when(F.col("protocol") == "TCP", F.col("flow_duration")).alias("flow_duration"), F.col("tot_fwd_pkts").alias("Tot_Fwd_Pkts"))
    return clean.union_aligned([one, two])


@query("p07_sparse", dsql(f"select flow_id, label, flow_duration, tot_fwd_pkts, idle_mean, down_up_ratio from dirty"))
def p07(spark, d):
    return clean.drop_sparse_columns(dirty_flows(spark, d))


@query("p08_zero_fill", dsql(f"""
  select flow_id, case when {FINITE} then flow_duration else 0 end as flow_duration,
    coalesce(tot_fwd_pkts, 0) as tot_fwd_pkts from dirty"""))
def p08(spark, d):
    return clean.zero_fill(dirty_flows(spark, d), ["flow_duration", "tot_fwd_pkts"]).select(
        "flow_id", "flow_duration", "tot_fwd_pkts")


@query("p09_median_impute", dsql(f"""
  select flow_id, round(case when {FINITE} then flow_duration else (select median(flow_duration) from dirty where {FINITE}) end, 4)
    as flow_duration,
    round(coalesce(tot_fwd_pkts, (select median(tot_fwd_pkts) from dirty)), 4) as tot_fwd_pkts, down_up_ratio from dirty"""))
def p09(spark, d):
    out = clean.median_impute(dirty_flows(spark, d), ["flow_duration", "tot_fwd_pkts", "down_up_ratio"])
    return out.select("flow_id", F.round("flow_duration", 4).alias("flow_duration"),
                      F.round("tot_fwd_pkts", 4).alias("tot_fwd_pkts"), "down_up_ratio")


@query("p10_drop_empty_rows", dsql("select flow_duration, idle_std from dirty where (flow_duration is not null and not isnan(flow_duration)) or idle_std is not null"))
def p10(spark, d):
    return dirty_flows(spark, d).select("flow_duration", "idle_std").dropna(how="all")


@query("p11_drop_dirty", dsql(f"""
  select flow_id, flow_duration, tot_fwd_pkts from dirty where {FINITE} and tot_fwd_pkts is not null"""))
def p11(spark, d):
    return clean.drop_dirty(dirty_flows(spark, d), ["flow_duration", "tot_fwd_pkts"]).select(
        "flow_id", "flow_duration", "tot_fwd_pkts")


@query("p12_feature_project", sql("""
  select flow_id, tot_fwd_pkts, cast(0.0 as double) as idle_max, cast(dst_port as double) as dst_port, flow_duration from flows""", "flows"))
def p12(spark, d):
    return clean.project_features(
        a.flows(spark, d), ["tot_fwd_pkts", "idle_max", "dst_port", "flow_duration"], keep=("flow_id",))


@query("p13_log1p", sql("""
  select flow_id, round(ln(1 + flow_duration), 6) as flow_duration, round(ln(1 + tot_fwd_pkts), 6) as tot_fwd_pkts,
    case when confidence - 1.5 > -1 then round(ln(1 + (confidence - 1.5)), 6) end as shifted from flows""", "flows"))
def p13(spark, d):
    f = a.flows(spark, d).withColumn("shifted", F.col("confidence") - 1.5)
    out = clean.log_columns(f, ["flow_duration", "tot_fwd_pkts", "shifted", "absent"])
    return out.select("flow_id", *[F.round(c, 6).alias(c) for c in ("flow_duration", "tot_fwd_pkts", "shifted")])


@query("p14_auto_log1p", sql("""
  select flow_id, round(ln(1 + flow_duration), 6) as flow_duration, tot_fwd_pkts, down_up_ratio from flows""", "flows"))
def p14(spark, d):
    f = a.flows(spark, d)
    out = clean.log_columns(f, clean.choose_log_columns(f, ["flow_duration", "tot_fwd_pkts", "down_up_ratio"]))
    return out.select("flow_id", F.round("flow_duration", 6).alias("flow_duration"), "tot_fwd_pkts", "down_up_ratio")


CATEGORY = """case label when 'BENIGN' then 'BENIGN' when 'DDoS' then 'DDoS' when 'DoS Hulk' then 'DoS'
  when 'PortScan' then 'Port Scan' when 'SSH-Patator' then 'Brute Force' when 'Bot' then 'Bot'
  when 'Web Attack XSS' then 'Web Attack' when 'Infiltration' then 'Infiltration' else 'Unknown' end"""


@query("p15_label_map", sql(f"select flow_id, label, {CATEGORY} as attack_type from (select flow_id, "
                            "case label when 'Infiltration' then 'Mystery' else label end as label from flows)", "flows"))
def p15(spark, d):
    label = F.when(F.col("label") == "Infiltration", "Mystery").otherwise(F.col("label"))
    f = a.flows(spark, d).select("flow_id", label.alias("label"))
    return f.withColumn("attack_type", clean.attack_category(F.col("label")))


@query("p16_benign_split", sql("select 'benign' as part, count(*) as rows from flows where label = 'BENIGN' union all "
                               "select 'attack', count(*) from flows where label <> 'BENIGN'", "flows"))
def p16(spark, d):
    f = a.flows(spark, d).withColumn("label", F.when(F.col("label") == "BENIGN", " benign ").otherwise(F.col("label")))
    benign, attack = clean.split_benign(f)
    return benign.agg(F.lit("benign").alias("part"), F.count(F.lit(1)).alias("rows")).union(
        attack.agg(F.lit("attack").alias("part"), F.count(F.lit(1)).alias("rows")))


@query("p18_downcast", sql("select cast(event_id as integer) as event_id, cast(value as float) as value from events"))
def p18(spark, d):
    return clean.downcast(a.table(spark, d, "events").select("event_id", "value"), ["event_id", "value"])


@query("f04_rare_class", sql("""
  select flow_id, label from flows where label in (select label from flows group by label having count(*) >=
    (select count(*) / 20.0 from flows))""", "flows"))
def f04(spark, d):
    f = a.flows(spark, d).select("flow_id", "label")
    return select.drop_rare_classes(f, "label", math.ceil(f.count() / 20))


@query("f05_zero_var", sql("select flow_duration, tot_fwd_pkts from flows", "flows"))
def f05(spark, d):
    f = a.flows(spark, d).select("flow_duration", "tot_fwd_pkts", F.lit(1.5).alias("idle_max"))
    return f.drop(*select.zero_variance_columns(f, f.columns))


TARGET = "dst_port"
CORR_SQL = " union all ".join(
    f"select '{c}' as \"column\", round(corr({c}, target), 2) as corr from t" for c in
    ("flow_duration", "tot_fwd_pkts", "down_up_ratio", "mixed", "inverse"))
CORR_CTE = """t as (select flow_duration, tot_fwd_pkts, down_up_ratio, tot_fwd_pkts + 8.0 * dst_port as mixed,
  tot_fwd_pkts - 8.0 * dst_port as inverse, dst_port as target from flows)"""


def _corr_input(spark, d):
    port = F.col("dst_port")
    return a.flows(spark, d).select(
        "flow_duration", "tot_fwd_pkts", "down_up_ratio", (F.col("tot_fwd_pkts") + port * 8.0).alias("mixed"),
        (F.col("tot_fwd_pkts") - port * 8.0).alias("inverse"), port.alias("target"), F.lit(0.5).alias("flat"))


@query("a14_corr_rank", sql(f"""
  select "column", corr, case when corr > 0 then 'positive' else 'negative' end as sign from ({CORR_SQL})
  where abs(corr) > 0.01 and abs(corr) < 1""", "flows", extra=CORR_CTE))
def a14(spark, d):
    cols = ["flow_duration", "tot_fwd_pkts", "down_up_ratio", "mixed", "inverse"]
    return select.rank_correlations(select.correlations(_corr_input(spark, d), cols, "target"))


SELECT_SQL = " union all ".join(
    f"select '{c}' as feature from t having abs(round(corr({c}, target), 2)) > 0.01 and abs(round(corr({c}, target), 2)) < 1" for c in
    ("flow_duration", "tot_fwd_pkts", "down_up_ratio", "mixed", "inverse"))


@query("f06_corr_select", sql(SELECT_SQL, "flows", extra=CORR_CTE))
def f06(spark, d):
    cols = ["flow_duration", "tot_fwd_pkts", "down_up_ratio", "mixed", "inverse", "flat"]
    kept = select.select_by_correlation(_corr_input(spark, d), cols, "target")
    return spark.createDataFrame([(c,) for c in kept], "feature string")


@query("a08_labels", sql("select label, count(*) as rows from flows group by label", "flows"))
def a08(spark, d):
    return report.label_distribution(a.flows(spark, d))


@query("a09_dups", sql("""
  select cast(sum(n) as bigint) as rows, count(*) as distinct_rows, cast(sum(n - 1) as bigint) as duplicates from (
    select count(*) as n from flows group by src_ip, dst_ip, label, down_up_ratio)""", "flows"))
def a09(spark, d):
    return clean.duplicate_count(a.flows(spark, d).select("src_ip", "dst_ip", "label", "down_up_ratio"))


STATS = ["flow_duration", "tot_fwd_pkts", "idle_mean", "down_up_ratio"]


def _stats_sql(expr: str) -> str:
    return " union all ".join(expr.replace("@", c) for c in STATS)


def _finite(spark, d):
    return clean.finite_or_null(dirty_flows(spark, d), STATS)


FIN = """, fin as (select flow_id, case when not isnan(flow_duration) and not isinf(flow_duration) then flow_duration end
  as flow_duration, tot_fwd_pkts, idle_mean, down_up_ratio from dirty)"""


def fsql(body: str) -> str:
    return sql(body, "flows", extra=DIRTY + FIN)


@query("a10_missing", fsql(_stats_sql("""select '@' as "column", count(*) - count(@) as missing from fin""")))
def a10(spark, d):
    return select.column_stats(_finite(spark, d), STATS).select("column", "missing")


@query("a11_profile", fsql(_stats_sql("""select '@' as "column", count(@) as count, round(avg(@), 4) as mean,
  round(stddev_samp(@), 4) as std, min(@) as min, max(@) as max, count(*) - count(@) as missing,
  round(quantile_cont(@, 0.25), 4) as p25, round(quantile_cont(@, 0.5), 4) as p50, round(quantile_cont(@, 0.75), 4) as p75
  from fin""")))
def a11(spark, d):
    return select.profile(_finite(spark, d), STATS).select(
        "column", "count", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "min", "max", "missing",
        *[F.round(p, 4).alias(p) for p in ("p25", "p50", "p75")])


@query("a12_std", fsql(_stats_sql("""select '@' as "column", round(stddev_samp(@), 4) as std from fin""")))
def a12(spark, d):
    return select.column_stats(_finite(spark, d), STATS).select("column", F.round("std", 4).alias("std"))


@query("a13_minmax", fsql(_stats_sql("""select '@' as "column", min(@) as min, max(@) as max from fin""")))
def a13(spark, d):
    return select.column_stats(_finite(spark, d), STATS).select("column", "min", "max")


@query("a15_median", fsql(_stats_sql("""select '@' as "column", round(median(@), 6) as median from fin""")))
def a15(spark, d):
    f = _finite(spark, d)
    # A small exact limit makes the bracketing passes run on the test tables too.
    medians = quantiles.exact_quantiles(f, STATS, 0.5, exact_rows=2000)
    return spark.createDataFrame(
        [(c, None if v is None else round(v, 6)) for c, v in medians.items()], "column string, median double")


@query("a16_percentile", sql("select round(quantile_cont(score, 0.8), 6) as threshold, round(quantile_cont(flow_duration, 0.8), 4) as duration from flows", "flows"))
def a16(spark, d):
    t = quantiles.exact_quantiles(a.flows(spark, d), ["score", "flow_duration"], 0.8, exact_rows=2000)
    return spark.createDataFrame([(round(t["score"], 6), round(t["flow_duration"], 4))], "threshold double, duration double")


@query("u03_distinct", sql("select distinct src_ip, label from flows", "flows"))
def u03(spark, d):
    f = a.flows(spark, d).select("src_ip", "label")
    return f.distinct()


@query("u04_column_diff", sql("""select flow_id, tot_fwd_pkts, cast(0 as double) as idle_max, cast(0 as double) as idle_min from flows""", "flows"))
def u04(spark, d):
    f = a.flows(spark, d).select("flow_id", "tot_fwd_pkts")
    missing = clean.missing_features(f, ["tot_fwd_pkts", "idle_max", "idle_min"])
    return f.withColumns({c: F.lit(0.0) for c in missing})
