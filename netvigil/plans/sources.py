"""Queries: alert scans, searches, projections of events, scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from netvigil.functions import levels, scores, text
from netvigil.operators import clean, report, sampling
from netvigil.plans import adapters as a
from netvigil.plans.oracle import LEVEL_NAME, THR, _host, _server, level_case, sql
from netvigil.plans.registry import query
from netvigil.session import scratch_path
from netvigil.sources import alerts, flows, siem_lines, sinks, whitelist

AS_OF = "2024-01-30 12:00:00"
NOW = "2024-02-01 00:00:00"


def _now():
    return F.lit(NOW).cast("timestamp")


def eve_lines(spark, d):
    """Signature-alert JSON lines: 'view' events are flow records, some alerts lack
    their alert object, lines of 'signup' by user 7 are cut short."""
    ev = a.table(spark, d, "events")
    kind = F.col("event_type")
    alert = F.struct(
        (F.col("user_id") + 2000000).cast("int").alias("signature_id"),
        F.concat(F.lit("sig "), kind).alias("signature"),
        F.when(kind == "error", "Attempted DoS").otherwise("Misc Activity").alias("category"),
        (F.length(kind) % 4).cast("int").alias("severity"),
    )
    line = F.to_json(F.struct(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
        F.when(kind == "view", "flow").otherwise("alert").alias("event_type"),
        a.host_ip(F.col("user_id")).alias("src_ip"), a.server_ip(F.col("user_id")).alias("dest_ip"),
        F.lit(40000).alias("src_port"), F.lit(443).alias("dest_port"), F.lit("TCP").alias("proto"),
        F.when(F.col("value") < 200, alert).alias("alert"),
    ))
    broken = (kind == "signup") & (F.col("user_id") == 7)
    return ev.select("event_id", F.when(broken, F.substring(line, 1, 40)).otherwise(line).alias("value"))


EVE_SQL = f"""
  select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') as timestamp,
    case when value < 200 then cast(user_id + 2000000 as varchar) else 'unknown' end as signature_id,
    case when value < 200 then concat('sig ', event_type) else 'Unknown' end as message,
    case when value >= 200 then 'Unknown' when event_type = 'error' then 'Attempted DoS' else 'Misc Activity' end as category,
    case when value < 200 then cast(length(event_type) % 4 as integer) else 3 end as severity,
    {_host('user_id')} as src_ip, {_server('user_id')} as dst_ip, 40000 as src_port, 443 as dst_port, 'TCP' as protocol,
    'suricata' as layer
  from events where event_type <> 'view' and not (event_type = 'signup' and user_id = 7)"""


@query("p21_eve_flatten", EVE_SQL)
def p21(spark, d):
    return alerts.parse_eve(eve_lines(spark, d), keep=("event_id",))


@query("s03_eve_scan", f"""select * from ({EVE_SQL})
  where timestamp >= '2024-01-27T12:00:00' order by timestamp desc, signature_id desc limit 500""")
def s03(spark, d):
    return alerts.recent_signature_alerts(alerts.parse_eve(eve_lines(spark, d), keep=("event_id",)), AS_OF, 3 * 86400)


def host_lines(spark, d):
    """Host-alert JSON lines with the usual irregularities: address under three
    different keys, missing objects, text levels, a bad timestamp, broken lines."""
    ev = a.table(spark, d, "events")
    kind, uid = F.col("event_type"), F.col("user_id")
    ip = a.host_ip(uid)
    line = F.to_json(F.struct(
        F.when(uid == 11, "not a time").otherwise(
            F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))).alias("timestamp"),
        F.struct(
            F.concat(F.lit("R-"), kind).alias("id"), (F.floor("value").cast("int") % 16).alias("level"),
            F.concat(F.lit("host rule "), kind).alias("description"),
            F.when(kind != "purchase", F.array(kind, F.lit("local"))).alias("groups"),
        ).alias("rule"),
        F.when(uid != 3, F.struct(F.lit("00").alias("id"), a.server_ip(uid).alias("ip"))).alias("agent"),
        F.when(kind != "view", F.struct(
            F.when(kind == "click", ip).when(kind == "error", "").alias("srcip"),
            F.when(kind == "error", ip).alias("src_ip"),
            F.when(kind == "signup", a.server_ip(uid)).alias("dst_ip"),
            F.when(kind == "click", "51515").when(kind == "error", "").alias("srcport"),
            F.when(kind == "error", F.lit(22)).alias("dstport"),
            F.when(kind == "error", F.concat(F.lit("user"), uid.cast("string"))).alias("srcuser"),
        )).alias("data"),
        F.when(kind == "purchase", F.struct(ip.alias("srcip"))).alias("predecoder"),
        F.when(kind == "purchase", F.struct(F.lit("/etc/passwd").alias("path"))).alias("syscheck"),
        F.concat(F.lit("log of "), ip).alias("full_log"),
    ))
    return ev.select("event_id", F.when(uid == 5, F.lit("{broken")).otherwise(line).alias("value"))


HOST_SQL = f"""
  select event_id, case when user_id = 11 then timestamp '{NOW}' else ts end as ts,
    concat('R-', event_type) as rule_id, cast(floor(value) as integer) % 16 as rule_level,
    concat('host rule ', event_type) as rule_description,
    case when user_id = 3 then '000' else '00' end as agent_id, 'unknown' as agent_name,
    case when user_id = 3 then 'unknown' else {_server('user_id')} end as agent_ip,
    case when event_type in ('click', 'error', 'purchase') then {_host('user_id')} end as src_ip,
    case when event_type = 'signup' then {_server('user_id')} end as dst_ip,
    case when event_type = 'click' then 51515 end as src_port, case when event_type = 'error' then 22 end as dst_port,
    case when event_type = 'error' then concat('user', cast(user_id as varchar)) end as "user",
    cast(null as varchar) as process_name, case when event_type = 'purchase' then '/etc/passwd' end as file_path,
    concat('log of ', {_host('user_id')}) as full_log,
    case when event_type = 'purchase' then '' else concat(event_type, ',local') end as groups
  from events where user_id <> 5"""


def _host_parsed(spark, d):
    flat = alerts.parse_host_alerts(host_lines(spark, d), _now(), keep=("event_id",))
    return flat.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("p20_host_flatten", HOST_SQL)
def p20(spark, d):
    return _host_parsed(spark, d).withColumn("groups", F.array_join("groups", ","))


@query("s04_alert_scan", f"select * from ({HOST_SQL}) where ts >= timestamp '{AS_OF}' - interval 2 day")
def s04(spark, d):
    return alerts.since(_host_parsed(spark, d), AS_OF, 2 * 86400).withColumn("groups", F.array_join("groups", ","))


ALERT_OUT = ["ts", "event_id", "rule_id", "rule_level", "agent_id", "agent_ip", "src_ip", "dst_ip"]
ALERT_SQL = ", ".join(ALERT_OUT)


@query("s05_recent", sql(f"""select {ALERT_SQL} from alerts
  where ts > timestamp '{AS_OF}' - interval 2880 minute order by ts desc, event_id desc limit 500""", "alerts"))
def s05(spark, d):
    return alerts.recent_alerts(a.host_alerts(spark, d), AS_OF, 2880).select(*ALERT_OUT)


@query("s06_index_search", sql(f"""select {ALERT_SQL} from alerts
  where ts >= timestamp '{AS_OF}' - interval 10000 minute and agent_id = '003' and rule_level >= 7
  order by ts desc, event_id desc limit 500""", "alerts"))
def s06(spark, d):
    return alerts.search_alerts(a.host_alerts(spark, d), AS_OF, 10000, "003", 7).select(*ALERT_OUT)


@query("s07_by_ip", sql(f"""select {ALERT_SQL} from alerts
  where ts >= timestamp '{AS_OF}' - interval 20000 minute and (src_ip = '10.0.0.17' or dst_ip = '10.0.0.17'
    or agent_ip = '10.0.0.17' or full_log like '% 10.0.0.17 %')
  order by ts desc, event_id desc limit 100""", "alerts"))
def s07(spark, d):
    return alerts.alerts_by_ip(a.host_alerts(spark, d), "10.0.0.17", AS_OF, 20000).select(*ALERT_OUT)


@query("s08_source_pick", sql(f"select {ALERT_SQL} from alerts where rule_level >= 12", "alerts"))
def s08(spark, d):
    picked = alerts.alerts_source({"index": None, "file": a.host_alerts(spark, d), "api": None})
    return picked.filter("rule_level >= 12").select(*ALERT_OUT)


@query("d05_recent_view", sql("""select strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') as timestamp, rule_id, rule_level,
  rule_description, agent_id, agent_name, src_ip, dst_ip from alerts""", "alerts"))
def d05(spark, d):
    return alerts.recent_view(a.host_alerts(spark, d))


@query("t03_newest_n", sql("select event_id, ts from alerts order by ts desc, event_id desc limit 500", "alerts"))
def t03(spark, d):
    return report.newest(a.host_alerts(spark, d), 500, tie="event_id").select("event_id", "ts")


@query("s09_whitelist_load", f"""
  select distinct {_host('s_suppkey')} as ip from supplier where s_nationkey <> 0
  union select '8.8.8.8' union select '1.1.1.1'""")
def s09(spark, d):
    sup = a.table(spark, d, "supplier")
    ip = a.host_ip(F.col("s_suppkey"))
    line = (
        F.when(F.col("s_nationkey") == 0, F.concat(F.lit("# retired "), ip))
        .when(F.col("s_nationkey") == 1, F.concat(F.lit("  "), ip, F.lit("   # trusted ")))
        .otherwise(ip)
    )
    lines = sup.select(F.explode(F.array(line, F.lit("   "))).alias("value"))
    path = scratch_path(spark, "whitelist")
    lines.write.text(path)
    return whitelist.load(spark, path, "'8.8.8.8', \"1.1.1.1\",,")


def _log(spark, d):
    path = scratch_path(spark, "detection-log")
    sinks.append_lines(sinks.detection_log(a.unique_detections(spark, d), _now()), path)
    return sinks.read_detection_log(spark.read.text(path))


@query("s10_detection_log", sql(f"""
  select '2024-02-01T00:00:00.000000' as timestamp, flow_id, src_ip, dst_ip, src_port, dst_port, protocol, attack_type,
    round(confidence, 6) as confidence, layer, {LEVEL_NAME} as threat_level from uniq""", "uniq"))
def s10(spark, d):
    return _log(spark, d).withColumn("confidence", F.round("confidence", 6))


@query("a27_log_rollup", sql("select attack_type, count(*) as detections from uniq group by attack_type", "uniq"))
def a27(spark, d):
    return report.log_rollup(_log(spark, d))


@query("t07_last10", sql("""select ts, attack_type, src_ip from uniq order by ts desc, det_seq desc limit 10""", "uniq"))
def t07(spark, d):
    return report.newest(a.unique_detections(spark, d, "ts"), 10, tie="det_seq").select("ts", "attack_type", "src_ip")


SIEM_SQL = f"""
  select det_seq, concat('{{"timestamp":"2024-02-01T00:00:00.000000","source":"hybrid-nids","attack_type":"', attack_type,
    '","threat_level":"', {LEVEL_NAME}, '","confidence":', cast(round(confidence, 4) as varchar), ',"src_ip":"', src_ip,
    '","dst_ip":"', dst_ip, '","dst_port":', cast(dst_port as varchar), ',"layer":"', layer, '"}}') as body from uniq"""


@query("s13_siem_lines", sql(f"""
  select concat('hybrid-nids: ', body) as value from ({SIEM_SQL}) union all
  select concat('1:hybrid-nids:', body) from ({SIEM_SQL})""", "uniq"))
def s13(spark, d):
    u = a.unique_detections(spark, d)
    return sinks.siem_lines(u, _now(), "api").union(sinks.siem_lines(u, _now(), "socket"))


@query("s14_webhook_payloads", sql(f"""
  select det_seq, concat('{{"timestamp":"2024-02-01T00:00:00.000000","source":"hybrid-nids","detection":{{"src_ip":"', src_ip,
    '","dst_ip":"', dst_ip, '","attack_type":"', attack_type, '","confidence":', cast(round(confidence, 4) as varchar),
    ',"threat_level":"', {LEVEL_NAME}, '","layer":"', layer, '"}}}}') as payload from uniq where threat_level >= 2""", "uniq"))
def s14(spark, d):
    u = a.unique_detections(spark, d).filter("threat_level >= 2").withColumn("confidence", F.round("confidence", 4))
    return sinks.webhook_payloads(u, _now())


@query("s15_email_messages", sql(f"""
  select det_seq, concat('[', {LEVEL_NAME}, '] NIDS Alert: ', attack_type) as subject,
    concat('NIDS Alert: ', {LEVEL_NAME}, chr(10), 'Attack: ', attack_type, ' | Confidence: ',
      printf('%.2f', round(confidence * 100, 2)), '% | Layer: ', layer, chr(10), 'Source: ', src_ip, ':',
      cast(src_port as varchar), ' -> ', dst_ip, ':', cast(dst_port as varchar), ' (', protocol, ')', chr(10),
      'Time: 2024-02-01T00:00:00.000000') as body
  from uniq where threat_level >= 4""", "uniq"))
def s15(spark, d):
    return sinks.email_messages(a.unique_detections(spark, d).filter("threat_level >= 4"), _now())


@query("p22_line_decode", sql(f"""
  select det_seq, src_ip as srcip, dst_ip as dstip, cast(null as varchar) as srcport, cast(dst_port as varchar) as dstport,
    attack_type, cast(round(confidence, 4) as varchar) as confidence, {LEVEL_NAME} as threat_level,
    cast(null as varchar) as threat_level_value, layer, cast(null as varchar) as protocol,
    cast(null as varchar) as anomaly_score, cast(null as varchar) as extra_data from uniq
  union all select det_seq, null, null, null, null, null, null, null, null, null, null, null, body from ({SIEM_SQL})""",
  "uniq"))
def p22(spark, d):
    # One spelling with a blank after the colon (as the emitter writes it) and one without.
    event = sinks.siem_event(_now(), "api")
    api = F.when(F.col("layer") == "vae", F.regexp_replace(event, '":', '": ')).otherwise(event)
    # all lines of a detection from one pass over the detections
    lines = F.array(api, sinks.siem_event(_now(), "socket"), F.lit("sshd: unrelated line"))
    return siem_lines.decode(a.unique_detections(spark, d).select("det_seq", F.explode(lines).alias("value")), keep=("det_seq",))


@query("s16_merge_benign", sql("""
  select distinct tot_fwd_pkts, down_up_ratio, active_mean, 'BENIGN' as label from flows""", "flows"))
def s16(spark, d):
    """Two folders of captures as CSV, read, merged, written as CSV and read back."""
    f, root = a.flows(spark, d), scratch_path(spark, "benign")
    names = ["tot_fwd_pkts", "down_up_ratio", "active_mean"]
    sinks.write_csv(f.filter("protocol = 'TCP'").select(*names), f"{root}/one")
    sinks.write_csv(f.filter("protocol = 'UDP'").select(*reversed(names)), f"{root}/two")
    captures = [flows.read_flow_files(spark, f"{root}/{n}", numeric=names).select(*names) for n in ("one", "two")]
    sinks.write_csv(clean.merge_benign(captures), f"{root}/merged")
    return flows.read_flow_files(spark, f"{root}/merged", numeric=names).select(*names, "label")


@query("s17_test_dataset", sql("""
  select flow_id, label, flow_duration, rk as position from (
    select *, row_number() over (order by md5(concat('42-', flow_id))) as rk from (
      select *, row_number() over (partition by label order by md5(concat('42-', flow_id)), flow_id) as k from flows
      where upper(label) <> 'BENIGN') where k <= 100)""", "flows"))
def s17(spark, d):
    sample = sampling.per_class_sample(a.flows(spark, d), "flow_id", "label", 100)
    """The sample in its shuffled order, its place in a column, as CSV and read back."""
    ranked = sampling.seeded_rank(sample, "flow_id", [], name="position").select("flow_id", "label", "flow_duration", "position")
    path = scratch_path(spark, "test-set")
    sinks.write_csv(ranked.orderBy("position"), path)
    return spark.read.option("header", True).schema(ranked.schema).csv(path)


@query("p17_endpoints", sql("""
  select flow_id, src_ip, dst_ip, src_port, cast(0 as integer) as dst_port, 'unknown' as protocol from flows""", "flows"))
def p17(spark, d):
    f = a.flows(spark, d).select(
        "flow_id", F.col("src_ip").alias("source_ip"), F.col("dst_ip").alias("dst"),
        F.col("src_port").cast("string").alias("sport"))
    return flows.with_endpoints(f).select("flow_id", *flows.ENDPOINTS)


# --- scalar functions, evaluated over whole tables -------------------------------------------------

@query("x01_x05_levels", sql(f"""
  select flow_id,
    case dst_port % 4 when 1 then 4 when 2 then 3 else 2 end as severity_level,
    {level_case('label', 'confidence')} as attack_level,
    case when -confidence < -0.7 then 4 when -confidence < -0.5 then 3 when -confidence < -0.3 then 2 else 1 end as isolation_level,
    case when score / {THR} > 5.0 then 4 when score / {THR} > 3.0 then 3 when score / {THR} > 1.5 then 2 else 1 end as error_level,
    case when tot_fwd_pkts >= 12 then 4 when tot_fwd_pkts >= 10 then 3 when tot_fwd_pkts >= 7 then 2 else 1 end as host_level,
    round(least(1.0, greatest(0.0, confidence - 0.5)), 6) as isolation_confidence,
    round(least(cast(1.0 as double), score / ({THR} * cast(3.0 as double))), 6) as error_confidence
  from flows""", "flows"))
def x01(spark, d):
    c, s, thr = F.col("confidence"), F.col("score"), F.lit(a.ERROR_THRESHOLD)
    return a.flows(spark, d).select(
        "flow_id", levels.severity_level(F.col("dst_port") % 4).alias("severity_level"),
        levels.attack_level(F.col("label"), c).alias("attack_level"),
        levels.isolation_level(-c).alias("isolation_level"), levels.error_level(s, thr).alias("error_level"),
        levels.host_level(F.col("tot_fwd_pkts")).alias("host_level"),
        F.round(levels.isolation_confidence(0.5 - c), 6).alias("isolation_confidence"),
        F.round(levels.error_confidence(s, thr), 6).alias("error_confidence"),
    )


@query("x06_x09_combined", sql("""
  select event_id, case when event_type in ('click', 'error') then 'ip_match' else 'attack_pattern' end as correlation_type,
    case when event_type in ('click', 'error') and greatest(a, b) < 3 then greatest(a, b) + 1 else greatest(a, b) end as level,
    case when event_type in ('click', 'error') and greatest(a, b) < 3 then greatest(a, b) + 1 else greatest(a, b) end as value,
    case (case when event_type in ('click', 'error') and greatest(a, b) < 3 then greatest(a, b) + 1 else greatest(a, b) end)
      when 4 then 'IMMEDIATE: Block IP, isolate host, investigate' when 3 then 'URGENT: Block IP, review logs, escalate'
      when 2 then 'MONITOR: Add to watchlist, review in 1 hour' else 'LOG: Record for analysis' end as advice,
    concat('[Misc] sig ', event_type) as attack_type
  from (select *, cast(event_id % 4 + 1 as integer) as a, cast(user_id % 4 + 1 as integer) as b from events)"""))
def x06(spark, d):
    ev = a.table(spark, d, "events")
    kind = F.when(F.col("event_type").isin("click", "error"), "ip_match").otherwise("attack_pattern")
    level = levels.combined_level(
        (F.col("event_id") % 4 + 1).cast("int"), (F.col("user_id") % 4 + 1).cast("int"), F.col("correlation_type"))
    out = ev.withColumn("correlation_type", kind).withColumn("level", level)
    return out.select(
        "event_id", "correlation_type", "level", levels.level_value(levels.level_name(F.col("level"))).alias("value"),
        levels.advice(F.col("level")).alias("advice"),
        text.signature_attack(F.lit("Misc"), F.concat(F.lit("sig "), F.col("event_type"))).alias("attack_type"),
    )


@query("x11_x13_text", """
  select event_id, case when event_type = 'view' then timestamp '2024-02-01 00:00:00' else ts end as ts,
    case event_type when 'click' then 'A' when 'error' then 'B' end as first_value,
    round(value / 500, 4) as rounded, concat(printf('%.2f', round(value / 500 * 100, 2)), '%') as percent
  from events""")
def x11(spark, d):
    ev, kind = a.table(spark, d, "events"), F.col("event_type")
    raw = F.when(kind == "view", "yesterday").otherwise(
        F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.when(kind == "error", "Z").otherwise("+00:00")))
    return ev.select(
        "event_id", text.parse_time(raw, _now()).cast("timestamp_ntz").alias("ts"),
        text.first_truthy(F.when(kind == "click", "A").otherwise(""), F.when(kind == "error", "B")).alias("first_value"),
        F.round(F.col("value") / 500, 4).alias("rounded"), text.percent(F.col("value") / 500).alias("percent"),
    )


@query("x10_x14_scores", """
  select vec_id, round(list_max(p), 6) as confidence, upper(concat('class', cast(list_position(p, list_max(p)) - 1 as varchar))) as label,
    round(list_sum(list_transform(p, lambda v: v * v * 0.25)) / len(p), 6) as mse,
    round(-0.5 * list_sum(list_transform(p, lambda v: 1.0 + v - v * v - exp(v))), 6) as kl,
    round(list_sum(list_transform(p, lambda v: v * v * 0.25)) / len(p)
      + 0.5 * (-0.5 * list_sum(list_transform(p, lambda v: 1.0 + v - v * v - exp(v)))) / len(p), 6) as combined
  from (select vec_id, list_transform(embedding, lambda v: cast(v as double)) as p from embeddings)""")
def x10(spark, d):
    p = F.transform("embedding", lambda v: v.cast("double"))
    e = a.table(spark, d, "embeddings").select("vec_id", p.alias("p"))
    dims = len(a.table(spark, d, "embeddings").select("embedding").first()[0])
    half = F.transform("p", lambda v: v * 0.5)
    mse, kl = scores.squared_error(F.col("p"), half), scores.kl_divergence(F.col("p"), F.col("p"))
    return e.select(
        "vec_id", F.round(scores.max_probability(F.col("p")), 6).alias("confidence"),
        scores.argmax_label(F.col("p"), [f"class{i}" for i in range(dims)]).alias("label"),
        F.round(mse, 6).alias("mse"), F.round(kl, 6).alias("kl"),
        F.round(scores.combined_error(mse, kl, 0.5, dims), 6).alias("combined"),
    )
