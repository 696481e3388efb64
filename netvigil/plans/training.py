"""Queries: windows, scaling, splits, balancing, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from netvigil.models.scaling import fit_scaler
from netvigil.operators import clean, metrics, quantiles, sampling, slices, windows
from netvigil.plans import adapters as a
from netvigil.plans.cleaning import CATEGORY
from netvigil.plans.oracle import sql
from netvigil.plans.registry import query

FEATURES = ["flow_duration", "tot_fwd_pkts"]
NUMBERED = """numbered as (select *, row_number() over (partition by capture_id order by flow_id) as flow_seq from flows),
  lagged as (select *, count(*) over (partition by capture_id) as n from numbered)"""


def numbered_flows(spark, d):
    return slices.number_rows(
        a.flows(spark, d).select("capture_id", "flow_id", "src_ip", "label", "score", *a.FLOW_FEATURES),
        ["capture_id"], ["flow_id"])


def _cell(c: str) -> str:
    return f"cast(cast({c} as decimal(18, 2)) as varchar)"


def _window_sql(size: int) -> str:
    parts = []
    for k in range(size - 1, -1, -1):
        for f in FEATURES:
            parts.append(_cell(f"lag({f}, {k}) over w") if k else _cell(f))
    return "concat_ws(',', " + ", ".join(parts) + ")"


WINDOW_BODY = f"""select capture_id, flow_seq, flow_id, src_ip, label, {_window_sql(5)} as "window" from numbered
  window w as (partition by capture_id order by flow_seq) qualify flow_seq >= 5"""


@query("w00_number_rows", sql("select capture_id, flow_id, flow_seq from numbered", "flows", extra=NUMBERED))
def w00(spark, d):
    return numbered_flows(spark, d).select("capture_id", "flow_id", "flow_seq")


@query("w01_sliding_window", sql(f'select capture_id, flow_seq, "window" from ({WINDOW_BODY})', "flows", extra=NUMBERED))
def w01(spark, d):
    w = windows.sliding_windows(numbered_flows(spark, d), FEATURES, bucket_rows=1000)
    text = F.array_join(F.transform("window", lambda v: v.cast("decimal(18,2)").cast("string")), ",")
    return w.select("capture_id", "flow_seq", text.alias("window"))


@query("w02_window_label", sql(f"select capture_id, flow_seq, flow_id, src_ip, label from ({WINDOW_BODY})", "flows", extra=NUMBERED))
def w02(spark, d):
    w = windows.sliding_windows(
        numbered_flows(spark, d), FEATURES, keep=("flow_id", "src_ip", "label"), bucket_rows=1000)
    return w.select("capture_id", "flow_seq", "flow_id", "src_ip", "label")


@query("m01_scale", sql("""
  select flow_id, round((flow_duration - avg(flow_duration) over ()) / stddev_pop(flow_duration) over (), 5) as flow_duration,
    round((tot_fwd_pkts - avg(tot_fwd_pkts) over ()) / stddev_pop(tot_fwd_pkts) over (), 5) as tot_fwd_pkts,
    cast(0.0 as double) as idle_max from flows""", "flows"))
def m01(spark, d):
    f = a.flows(spark, d).withColumn("idle_max", F.lit(3.0))
    cols = [*FEATURES, "idle_max"]
    return fit_scaler(f, cols).transform(f).select("flow_id", *[F.round(c, 5).alias(c) for c in cols])


@query("m02_encode", sql("select flow_id, cast(dense_rank() over (order by label) - 1 as integer) as attack_number from flows", "flows"))
def m02(spark, d):
    return sampling.encode_labels(a.flows(spark, d).select("flow_id", "label"), "label").select("flow_id", "attack_number")


RANKED = """ranked as (select *, row_number() over (partition by label order by md5(concat('42-', flow_id)), flow_id) as rk,
  count(*) over (partition by label) as n from flows)"""


@query("m03_split", sql("""
  select flow_id, label, case when rk <= nt then 'test' when rk <= nt + round((n - nt) * 0.125) then 'validation' else 'train' end as split
  from (select *, round(n * 0.2) as nt from ranked)""", "flows", extra=RANKED))
def m03(spark, d):
    return sampling.stratified_split(a.flows(spark, d).select("flow_id", "label"), "flow_id", ["label"])


@query("m05_undersample", sql("select flow_id, label from ranked where label <> 'BENIGN' or rk <= 5000", "flows", extra=RANKED))
def m05(spark, d):
    return sampling.undersample(a.flows(spark, d).select("flow_id", "label"), "flow_id", "label", "BENIGN", 5000)


@query("m06_per_class", sql("select flow_id, label from ranked where rk <= 100", "flows", extra=RANKED))
def m06(spark, d):
    return sampling.per_class_sample(a.flows(spark, d).select("flow_id", "label"), "flow_id", "label", 100, include_benign=True)


@query("m07_downsample", sql("select flow_id from flows order by md5(concat('42-', flow_id)), flow_id limit 3000", "flows"))
def m07(spark, d):
    return sampling.downsample(a.flows(spark, d).select("flow_id"), "flow_id", 3000)


@query("t05_shuffle", sql("select flow_id, row_number() over (order by md5(concat('42-', flow_id)), flow_id) as position from flows", "flows"))
def t05(spark, d):
    return sampling.seeded_rank(a.flows(spark, d).select("flow_id"), "flow_id", [], name="position").select("flow_id", "position")


@query("a26_balance_counts", sql(f"""
  select 'before' as stage, {CATEGORY} as attack_type, count(*) as rows from flows group by 2 union all
  select 'after', {CATEGORY}, count(*) from ranked where label <> 'BENIGN' or rk <= 5000 group by 2""", "flows", extra=RANKED))
def a26(spark, d):
    f = a.flows(spark, d).select("flow_id", "label")
    after = sampling.undersample(f, "flow_id", "label", "BENIGN", 5000)
    count = lambda df, stage: df.groupBy(clean.attack_category(F.col("label")).alias("attack_type")).agg(
        F.count(F.lit(1)).alias("rows")).select(F.lit(stage).alias("stage"), "attack_type", "rows")
    return count(f, "before").union(count(after, "after"))


@query("m18_threshold", sql("""select round(quantile_cont(score, 0.8), 6) as threshold from flows where label = 'BENIGN'""", "flows"))
def m18(spark, d):
    benign, _ = clean.split_benign(a.flows(spark, d))
    t = quantiles.exact_quantiles(benign, ["score"], 0.8, exact_rows=2000)["score"]
    return spark.createDataFrame([(round(t, 6),)], "threshold double")


# --- evaluation over a deterministic pseudo-prediction --------------------------------------------

PRED = """preds as (select flow_id, label as truth, case when confidence > 0.3 then label when l_len % 3 = 0 then 'BENIGN'
    when l_len % 3 = 1 then 'DDoS' else 'Phantom' end as pred, confidence from (select *, length(label) + dst_port as l_len from flows)),
  matrix as (select truth as label, pred, count(*) as rows from preds group by truth, pred),
  classes as (select label as class from matrix union select pred from matrix),
  report as (select class,
    coalesce((select sum(rows) from matrix where label = class), 0) as support,
    coalesce((select sum(rows) from matrix where pred = class), 0) as called,
    coalesce((select sum(rows) from matrix where label = class and pred = class), 0) as hit from classes),
  scored as (select *, case when called > 0 then hit * 1.0::double / called else 0 end as precision,
    case when support > 0 then hit * 1.0::double / support else 0 end as recall from report),
  graded as (select *, case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0 end as f1 from scored)"""


def predictions(spark, d):
    n = F.length("label") + F.col("dst_port")
    other = F.when(n % 3 == 0, "BENIGN").when(n % 3 == 1, "DDoS").otherwise("Phantom")
    return a.flows(spark, d).select(
        "flow_id", "label", F.when(F.col("confidence") > 0.3, F.col("label")).otherwise(other).alias("pred"), "confidence")


@query("a17_confusion", sql("select * from matrix", "flows", extra=PRED))
def a17(spark, d):
    return metrics.confusion(predictions(spark, d))


@query("a18_macro", sql("""
  select (select round(sum(rows) filter (label = pred) * 1.0 / sum(rows), 6) from matrix) as accuracy,
    round(avg(precision), 6) as precision_macro, round(avg(recall), 6) as recall_macro, round(avg(f1), 6) as f1_macro,
    round(sum(precision * support) / sum(support), 6) as precision_weighted,
    round(sum(recall * support) / sum(support), 6) as recall_weighted, round(sum(f1 * support) / sum(support), 6) as f1_weighted
  from graded""", "flows", extra=PRED))
def a18(spark, d):
    out = metrics.overall(metrics.confusion(predictions(spark, d)))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("a19_per_class", sql("""select class, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1,
  cast(support as bigint) as support from graded""", "flows", extra=PRED))
def a19(spark, d):
    return metrics.per_class(metrics.confusion(predictions(spark, d))).select(
        "class", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


AUC = """pts as (select c.class, s.score, sum(case when s.label = c.class then 1 else 0 end) as tp, count(*) as n
    from (select distinct label as class from flows) c,
      (select label, case when label = 'DDoS' then flow_duration / 1000 + 10 else flow_duration / 1000 end as score from flows) s
    group by c.class, s.score),
  cum as (select *, sum(tp) over w as ctp, sum(n) over w as cn from pts window w as (partition by class order by score desc)),
  curve as (select class, ctp * 1.0::double / cn as p, ctp * 1.0::double / max(ctp) over (partition by class) as r, score from cum),
  seg as (select class, p, r, coalesce(lag(p) over v, 1.0) as p0, coalesce(lag(r) over v, 0.0) as r0 from curve
    window v as (partition by class order by score desc))"""


@query("a20_pr_auc", sql("""select class, round(area, 6) as pr_auc from area
  union all select 'macro', round(avg(area), 6) from area""", "flows", extra=AUC + """,
  area as (select class, sum((r - r0) * (p + p0) / 2) as area from seg group by class)"""))
def a20(spark, d):
    f = a.flows(spark, d)
    score = F.when(F.col("label") == "DDoS", F.col("flow_duration") / 1000 + 10).otherwise(F.col("flow_duration") / 1000)
    areas = metrics.pr_auc_by_label(f.select("label", score.alias("score")))
    return metrics.with_macro(areas).select("class", F.round("pr_auc", 6).alias("pr_auc"))


@query("a21_best_model", sql("""
  select model, f1_macro from (select 'rule' as model, round(avg(f1), 6) as f1_macro from graded union all
    select 'constant', round(avg(case when class = 'BENIGN' then 2 * (n * 1.0::double / t) / (1 + n * 1.0::double / t) else 0 end), 6)
    from (select label as class, count(*) as n, (select count(*) from flows) as t from flows group by label))
  order by f1_macro desc limit 1""", "flows", extra=PRED))
def a21(spark, d):
    p = predictions(spark, d)
    table = metrics.compare_models([
        metrics.model_metrics(p, "rule"), metrics.model_metrics(p.withColumn("pred", F.lit("BENIGN")), "constant")])
    return metrics.best_model(table).select("model", F.round("f1_macro", 6).alias("f1_macro"))


@query("a22_eval_set", sql("""
  select flow_id, 0 as label from (select flow_id from flows where label = 'BENIGN' order by flow_id limit 2000) union all
  select flow_id, 1 from (select flow_id from flows where label <> 'BENIGN' order by flow_id limit 2000)""", "flows"))
def a22(spark, d):
    benign, attack = clean.split_benign(a.flows(spark, d))
    return metrics.anomaly_eval_set(benign.select("flow_id"), attack.select("flow_id"), "flow_id", 2000)


@query("a23_error_hist", sql("""
  select cast(least(floor((flow_duration - lo) / ((hi - lo) / 50)), 49) as integer) as bin, count(*) as rows
  from flows, (select min(flow_duration) as lo, max(flow_duration) as hi from flows) group by 1""", "flows"))
def a23(spark, d):
    return metrics.error_histogram(a.flows(spark, d), "flow_duration", 50).select("bin", "rows")


@query("a23_error_summary", sql("""select label, round(avg(score), 6) as mean, max(score) as max, round(stddev_pop(score), 6) as std
  from flows group by label""", "flows"))
def a23_summary(spark, d):
    return a.flows(spark, d).groupBy("label").agg(
        F.round(F.avg("score"), 6).alias("mean"), F.max("score").alias("max"), F.round(F.stddev_pop("score"), 6).alias("std"))
