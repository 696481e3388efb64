"""Queries: correlation, chains, rules, responses, cooldown."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from netvigil.functions.text import epoch_micros
from netvigil.operators import correlate, detect, respond, rules
from netvigil.plans import adapters as a
from netvigil.plans.oracle import sql
from netvigil.plans.registry import query
from netvigil.plans.sources import AS_OF
from netvigil.session import materialize
from netvigil.sources import alerts as host

REL = ", ".join(f"('{k}', '{t}')" for k, terms in correlate.RELATED_GROUPS.items() for t in terms)
SESS = """sess as (select * exclude (rn) from (select *, row_number() over (
    partition by src_ip, dst_ip, attack_type order by confidence desc, det_seq) as rn from kept) where rn = 1)"""
RECENT = f"recent as (select * from alerts where ts >= timestamp '{AS_OF}' - interval 1 day)"
PAIRS = f"""rel(k, t) as (values {REL}),
  related as (select distinct d.attack_type, x.grp from (select distinct attack_type from sess) d,
    (select distinct grp from alerts) x, rel where contains(lower(d.attack_type), k) and contains(x.grp, t)),
  pairs as (select d.det_seq, d.src_ip, d.dst_ip, d.attack_type, d.threat_level as dl, r.ts, r.event_id, r.rule_id,
      r.rule_level, r.rule_description,
      case when r.src_ip is not null and (r.src_ip = d.src_ip or r.agent_ip = d.dst_ip) then 'ip_match'
           when q.grp is not null then 'attack_pattern' end as ctype
    from sess d cross join recent r left join related q on q.attack_type = d.attack_type and q.grp = r.grp),
  firsts as (select * from (select *, row_number() over (partition by src_ip, attack_type, rule_id
      order by det_seq, ts, event_id) as rn from pairs where ctype is not null) where rn = 1),
  graded as (select *, case when rule_level >= 12 then 4 when rule_level >= 10 then 3 when rule_level >= 7 then 2 else 1 end as hl from firsts),
  corr as (select *, case when ctype = 'ip_match' and greatest(dl, hl) < 3 then greatest(dl, hl) + 1 else greatest(dl, hl) end
      as threat_level from graded)"""
CORR_EXTRA = ",\n".join([SESS, RECENT, PAIRS])


def _session(spark, d):
    return detect.dedup(a.kept_detections(spark, d), scope=(), columns=["threat_level", "confidence"])


def _recent(spark, d):
    return host.since(a.host_alerts(spark, d), AS_OF, 86400)


def _correlated(spark, d):
    return correlate.correlate(_session(spark, d), _recent(spark, d))


CORR_COLS = """src_ip, attack_type, rule_id, ctype as correlation_type, threat_level, det_seq, event_id,
  concat('Correlated ', ctype, ': NIDS ', attack_type, ' from ', src_ip, ', HIDS rule ', rule_id, ': ', rule_description) as description,
  case threat_level when 4 then 'IMMEDIATE: Block IP, isolate host, investigate' when 3 then 'URGENT: Block IP, review logs, escalate'
    when 2 then 'MONITOR: Add to watchlist, review in 1 hour' else 'LOG: Record for analysis' end as recommended_action"""


@query("j01_correlate", sql(f"select {CORR_COLS} from corr", "kept", "alerts", extra=CORR_EXTRA))
def j01(spark, d):
    return _correlated(spark, d).select(
        "src_ip", "attack_type", "rule_id", "correlation_type", "threat_level", F.col("nids.det_seq").alias("det_seq"),
        F.col("hids.event_id").alias("event_id"), "description", "recommended_action")


@query("w04_first_match", sql("select src_ip, attack_type, rule_id, det_seq, ts from firsts", "kept", "alerts", extra=CORR_EXTRA))
def w04(spark, d):
    return _correlated(spark, d).select("src_ip", "attack_type", "rule_id", "nids.det_seq", "hids.ts")


CYCLE_EXTRA = f"""rel(k, t) as (values {REL}),
  cdet as (select *, cast(floor(epoch(ts) / 3600) as bigint) as cycle from kept where layer = 'suricata'),
  calert as (select *, floor(epoch(ts) / 3600) as lo, floor((epoch(ts) + 7200) / 3600) - 1 as hi from alerts),
  related as (select distinct d.attack_type, x.grp from (select distinct attack_type from cdet) d,
    (select distinct grp from alerts) x, rel where contains(lower(d.attack_type), k) and contains(x.grp, t)),
  pairs as (select d.cycle, d.det_seq, d.src_ip, d.attack_type, r.ts, r.event_id, r.rule_id,
      case when r.src_ip is not null and (r.src_ip = d.src_ip or r.agent_ip = d.dst_ip) then 'ip_match'
           when q.grp is not null then 'attack_pattern' end as ctype
    from cdet d join calert r on d.cycle between r.lo and greatest(r.lo, r.hi)
    left join related q on q.attack_type = d.attack_type and q.grp = r.grp)"""


CYCLE_SQL = """
  select cycle, src_ip, attack_type, rule_id, ctype as correlation_type, det_seq, event_id from (
    select *, row_number() over (partition by cycle, src_ip, attack_type, rule_id order by det_seq, ts, event_id) as rn
    from pairs where ctype is not null) where rn = 1"""


def _correlated_by_cycle(spark, d, det):
    det, al = correlate.assign_cycles(det, a.host_alerts(spark, d), interval=3600, lookback=7200)
    return correlate.correlate(det, al, scope=("cycle",)).select(
        "cycle", "src_ip", "attack_type", "rule_id", "correlation_type", "nids.det_seq", "hids.event_id")


@query("j01_correlate_cycles", sql(CYCLE_SQL, "kept", "alerts", extra=CYCLE_EXTRA))
def j01_cycles(spark, d):
    return _correlated_by_cycle(spark, d, a.kept_detections(spark, d).filter("layer = 'suricata'"))


# The same over the detections of all layers.
ALL_CYCLE_EXTRA = CYCLE_EXTRA.replace(" from kept where layer = 'suricata'", " from kept")


@query("j01_correlate_cycles_all_layers", sql(CYCLE_SQL, "kept", "alerts", extra=ALL_CYCLE_EXTRA))
def j01_cycles_all(spark, d):
    return _correlated_by_cycle(spark, d, a.kept_detections(spark, d))


@query("j02_attack_group", sql(f"""
  select distinct d.attack_type, x.grp as term from (select distinct attack_type from kept) d, (select distinct grp from alerts) x, rel
  where contains(lower(d.attack_type), k) and contains(x.grp, t)""", "kept", "alerts", extra=f"rel(k, t) as (values {REL})"))
def j02(spark, d):
    names = a.kept_detections(spark, d).select("attack_type").distinct()
    groups = a.host_alerts(spark, d).select(F.lower(F.col("groups")[0]).alias("grp"), "groups").distinct()
    left = correlate._explode_terms(names, correlate.attack_terms(F.col("attack_type")))
    right = correlate._explode_terms(groups, correlate.group_terms(F.col("groups")))
    return left.join(right, "term").select("attack_type", F.col("grp").alias("term")).distinct()


RISING = """rising as (select *, cast(ts as date) as day, coalesce(rule_level > lag(rule_level) over (
    partition by src_ip, cast(ts as date) order by ts, event_id), false) as rising from alerts where src_ip is not null)"""


def _daily(spark, d):
    return a.host_alerts(spark, d).withColumn("day", F.col("ts").cast("date"))


@query("w03_rising", sql("select event_id, src_ip, rule_level, rising from rising", "alerts", extra=RISING))
def w03(spark, d):
    return correlate.rising_steps(_daily(spark, d), ["src_ip", "day"]).select("event_id", "src_ip", "rule_level", "rising")


CHAIN = """chain as (select src_ip, day, count(*) as alerts, count(*) filter (rising) as rises,
    arg_max(rule_id, ts) as rule_id, arg_max(event_id, ts) as event_id, arg_max(rule_description, ts) as rule_description
  from rising group by src_ip, day having count(*) >= 3 and count(*) filter (rising) >= count(*) // 2)"""


def _chains(spark, d):
    return correlate.attack_chains(_daily(spark, d), ["src_ip", "day"])


@query("a24_chain_daily", sql("""
  select src_ip, cast(day as varchar) as day, alerts, rises, rule_id, event_id, 4 as threat_level,
    concat('Attack chain from ', src_ip, ': ', cast(alerts as varchar), ' progressive alerts') as description from chain""",
    "alerts", extra=RISING + ",\n" + CHAIN))
def a24(spark, d):
    return _chains(spark, d).select(
        "src_ip", F.col("day").cast("string").alias("day"), "alerts", "rises", "rule_id", "hids.event_id",
        "threat_level", "description")


# --- rules ----------------------------------------------------------------------------------------

# The rule set's patterns, stated again for the SQL side.
_RE = {
    100120: "(dos|ddos|hulk|slowloris|goldeneye)", 100121: "(portscan|port_scan|scan)", 100122: "(brute|patator|ssh-patator|ftp-patator)",
    100123: "(web|sql|xss|injection|rfi|lfi)", 100124: "(botnet|bot|c2|command_control)",
    100125: "(infiltration|infiltrate|exfil)",
}
CT = "cast(round(confidence, 4) as varchar)"
_PRED = {
    100100: "true", 100101: "threat_level = 1", 100102: "threat_level = 2", 100103: "threat_level = 3",
    100104: "threat_level = 4", 100110: "layer = 'suricata'", 100111: "layer = 'xgboost'",
    100112: "layer = 'isolation_forest'",
    **{i: f"regexp_matches(lower(attack_type), '{p}')" for i, p in _RE.items()},
    100126: "contains(attack_type, 'ANOMALY')",
    100130: f"threat_level = 2 and regexp_matches({CT}, '^0\\.9[5-9]|^1\\.0')",
    100131: f"threat_level = 3 and regexp_matches({CT}, '^0\\.9[5-9]|^1\\.0')",
    100132: f"threat_level = 4 and regexp_matches({CT}, '^0\\.9[5-9]|^1\\.0')",
    100150: f"threat_level = 4 and regexp_matches({CT}, '^0\\.[89]|^1\\.0')",
    100151: f"regexp_matches(lower(attack_type), '{_RE[100120]}') and threat_level >= 3",
}
_LEVEL = {r.id: r.level for r in rules.RULES}
_TEXT = {r.id: r.description for r in rules.RULES}
_NAMES = {"attack_type": "attack_type", "srcip": "src_ip", "dstip": "dst_ip", "dstport": "cast(dst_port as varchar)",
          "confidence": CT, "anomaly_score": "coalesce(cast(round(anomaly_score, 4) as varchar), '')"}


def _desc(rule_id: int) -> str:
    text = "'" + _TEXT[rule_id] + "'"
    for name, expr in _NAMES.items():
        text = text.replace(f"$({name})", f"', {expr}, '")
    return f"concat({text})"


STATIC = " union all ".join(
    f"select det_seq, src_ip, ts, {i} as rule_id, {_LEVEL[i]} as level, {_desc(i)} as description from uniq where {p}"
    for i, p in _PRED.items())
RULE_INPUT = ("dst_port", "confidence", "layer", "threat_level", "anomaly_score", "ts")
HIT_OUT = ["det_seq", "src_ip", "ts", "rule_id", "level", "description"]


def _static_hits(spark, d):
    return rules.hits(rules.with_static_flags(a.unique_detections(spark, d, *RULE_INPUT)))


@query("g1xx_static_rules", sql(STATIC, "uniq"))
def g1xx(spark, d):
    return _static_hits(spark, d).select(*HIT_OUT)


@query("g1xx_winners", sql(f"""select det_seq, rule_id, level, description from (select *, row_number() over (
  partition by det_seq order by level desc, rule_id) as rn from ({STATIC})) where rn = 1""", "uniq"))
def g1xx_winners(spark, d):
    return rules.winners(_static_hits(spark, d))


def _searched(hits):
    """What the searches read of all hits, written once: else every search deduplicates and sorts all detections again."""
    return materialize(hits.select("det_seq", "layer", "rule_id", "groups"), "hits")


@query("f07_rule_search", sql(f"""
  select det_seq, rule_id, 'group' as search from ({STATIC}) where rule_id in (100103, 100104, 100120, 100123, 100130, 100131, 100132)
  union all select det_seq, rule_id, 'id' from ({STATIC}) where rule_id = 100104
  union all select det_seq, rule_id, 'id or layer' from ({STATIC}) join uniq using (det_seq) where rule_id = 100126 or layer = 'xgboost'""",
  "uniq"))
def f07(spark, d):
    h = _searched(rules.hits(rules.with_static_flags(a.unique_detections(spark, d, *RULE_INPUT)), keep=("det_seq", "layer")))
    group = rules.in_group(h, "attack").withColumn("search", F.lit("group"))
    by_id = h.filter("rule_id = 100104").withColumn("search", F.lit("id"))
    either = h.filter((F.col("rule_id") == 100126) | (F.col("layer") == "xgboost")).withColumn("search", F.lit("id or layer"))
    return group.union(by_id).union(either).select("det_seq", "rule_id", "search")


def history_sql(table: str, scale: int) -> str:
    lag = ("select det_seq, {id} as rule_id from (select *, lag(ts, {n}) over (partition by src_ip order by ts, det_seq) as p "
           "from {table} where {cond}) where p >= ts - interval {s} second")
    scan, attack = _PRED[100121], " or ".join(_PRED[i] for i in (100120, 100122, 100123))
    return " union all ".join([
        lag.format(id=100140, n=4, cond="true", s=60 * scale, table=table),
        lag.format(id=100141, n=2, cond="threat_level = 3", s=120 * scale, table=table),
        lag.format(id=100142, n=2, cond="threat_level = 4", s=120 * scale, table=table),
        f"""select det_seq, 100143 as rule_id from (select *, max(case when {scan} then ts end) over (partition by src_ip
            order by ts, det_seq rows between unbounded preceding and 1 preceding) as p from {table})
          where ({attack}) and p >= ts - interval {300 * scale} second"""])


def scaled_rules(scale: int):
    return tuple(replace(r, timeframe=r.timeframe * scale) if r.timeframe else r for r in rules.RULES)


def _history(spark, d, scale):
    flagged = rules.with_static_flags(a.unique_detections(spark, d, *RULE_INPUT))
    out = rules.with_history_flags(flagged, scaled_rules(scale))
    stateful = tuple(r for r in rules.RULES if r.matched)
    return rules.hits(out, stateful).select("det_seq", "rule_id")


@query("w05_frequency_rules", sql(history_sql("uniq", 1), "uniq"))
def w05(spark, d):
    return _history(spark, d, 1)


# The supplied flows carry whole days, so the same rules also run with timeframes in half days.
@query("w05_frequency_rules_slow", sql(history_sql("uniq", 43200), "uniq"))
def w05_slow(spark, d):
    return _history(spark, d, 43200)


@query("j05_scan_then_attack", sql(f"select det_seq from ({history_sql('uniq', 43200)}) where rule_id = 100143", "uniq"))
def j05(spark, d):
    return _history(spark, d, 43200).filter("rule_id = 100143").select("det_seq")


@query("g200_active_response", sql(f"""
  select det_seq, rule_id, case when rule_id in (100150, 100151, 100122) then 'local' else 'all' end as location, timeout,
    ts + to_seconds(timeout) as expires_at
  from (select *, case rule_id when 100120 then 7200 when 100122 then 1800 else 3600 end as timeout from ({STATIC})
    where rule_id in (100150, 100151, 100120, 100122))""", "uniq"))
def g200(spark, d):
    return rules.active_responses(_static_hits(spark, d)).select("det_seq", "rule_id", "location", "timeout", "expires_at")


@query("g201_integration", sql(f"select det_seq, rule_id from ({STATIC}) where rule_id in (100104, 100150, 100151)", "uniq"))
def g201(spark, d):
    return rules.integrated(_static_hits(spark, d)).select("det_seq", "rule_id")


# The same over all hits of the rule set: those that look back in time as well.
def _by_rule(value) -> str:
    return "case rule_id " + " ".join(f"when {r.id} then {value(r.id)}" for r in rules.RULES if r.matched) + " end"


ALL_HITS = f"""{STATIC} union all select det_seq, src_ip, ts, rule_id, {_by_rule(_LEVEL.get)} as level, {_by_rule(_desc)} as description
  from ({history_sql('uniq', 1)}) join uniq using (det_seq)"""


def _all_hits(spark, d):
    return rules.evaluate(a.unique_detections(spark, d, *RULE_INPUT))


@query("g1xx_winners_all_rules", sql(f"""select det_seq, rule_id, level, description from (select *, row_number() over (
  partition by det_seq order by level desc, rule_id) as rn from ({ALL_HITS})) where rn = 1""", "uniq"))
def g1xx_winners_all(spark, d):
    return rules.winners(_all_hits(spark, d))


@query("f07_rule_search_all_rules", sql(f"""
  select det_seq, rule_id, 'group' as search from ({ALL_HITS}) where rule_id in (100103, 100104, 100120, 100123, 100130, 100131, 100132)
  union all select det_seq, rule_id, 'chain' from ({ALL_HITS}) where rule_id in (100141, 100142, 100143)
  union all select det_seq, rule_id, 'id' from ({ALL_HITS}) where rule_id = 100104
  union all select det_seq, rule_id, 'id or layer' from ({ALL_HITS}) join uniq using (det_seq) where rule_id = 100126 or layer = 'xgboost'""",
  "uniq"))
def f07_all(spark, d):
    flagged = rules.with_history_flags(rules.with_static_flags(a.unique_detections(spark, d, *RULE_INPUT)))
    h = _searched(rules.hits(flagged, keep=("det_seq", "layer")))
    group = rules.in_group(h, "attack").withColumn("search", F.lit("group"))
    chain = rules.in_group(h, "attack_chain").withColumn("search", F.lit("chain"))
    by_id = h.filter("rule_id = 100104").withColumn("search", F.lit("id"))
    either = h.filter((F.col("rule_id") == 100126) | (F.col("layer") == "xgboost")).withColumn("search", F.lit("id or layer"))
    return group.union(chain).union(by_id).union(either).select("det_seq", "rule_id", "search")


@query("g200_active_response_all_rules", sql(f"""
  select det_seq, rule_id, case when rule_id in (100150, 100151, 100122) then 'local' else 'all' end as location, timeout,
    ts + to_seconds(timeout) as expires_at
  from (select *, case when rule_id = 100120 then 7200 when rule_id = 100122 then 1800 when rule_id in (100141, 100142) then 14400
      else 3600 end as timeout from ({ALL_HITS}) where rule_id in (100150, 100151, 100120, 100122, 100141, 100142))""", "uniq"))
def g200_all(spark, d):
    return rules.active_responses(_all_hits(spark, d)).select("det_seq", "rule_id", "location", "timeout", "expires_at")


# --- responses ------------------------------------------------------------------------------------

ALL_ACTIONS = ("log", "alert", "block", "webhook", "email", "siem")


@query("d01_outbox", sql(" union all ".join(
    f"select det_seq, {i} as action_order, '{n}' as action from uniq where threat_level >= {g}"
    for i, (n, g) in enumerate((("log", 1), ("alert", 2), ("block", 3), ("webhook", 2), ("email", 4), ("siem", 1)))), "uniq"))
def d01(spark, d):
    return respond.outbox(a.unique_detections(spark, d, "threat_level"), ALL_ACTIONS).select("det_seq", "action_order", "action")


FEED = """feed as (select ctype as correlation_type, src_ip, attack_type, rule_id, threat_level,
    concat('Correlated ', ctype, ': NIDS ', attack_type, ' from ', src_ip, ', HIDS rule ', rule_id, ': ', rule_description) as description,
    rule_description from corr
  union all select 'attack_chain', src_ip, null, rule_id, 4,
    concat('Attack chain from ', src_ip, ': ', cast(alerts as varchar), ' progressive alerts'), rule_description from chain)"""
FEED_EXTRA = ",\n".join([CORR_EXTRA, RISING, CHAIN, FEED])


def _feed(spark, d):
    return correlate.correlation_feed(_correlated(spark, d), _chains(spark, d))


@query("d02_correlated_dispatch", sql("""
  select correlation_type, src_ip, attack_type, rule_id, threat_level, description, 'log' as action from feed
  union all select correlation_type, src_ip, attack_type, rule_id, threat_level, substr(description, 1, 100), 'alert' from feed
  union all select correlation_type, src_ip, attack_type, rule_id, threat_level, description, 'block' from feed where threat_level >= 3""",
  "kept", "alerts", extra=FEED_EXTRA))
def d02(spark, d):
    return respond.correlated_outbox(_feed(spark, d), ALL_ACTIONS).select(
        "correlation_type", "src_ip", "attack_type", "rule_id", "threat_level", "description", "action")


@query("j07_host_only_blocks", sql("""
  select src_ip, concat('[HIDS] ', rule_description) as attack_type, cast(0.9 as double) as confidence, threat_level
  from feed where attack_type is null""", "kept", "alerts", extra=FEED_EXTRA))
def j07(spark, d):
    return respond.host_only_detections(_feed(spark, d)).select("src_ip", "attack_type", "confidence", "threat_level")


DAY = 86400
BLOCK_CTES = f"""ev as (select src_ip as ip, ts, min(rule_id) as reason from alerts where src_ip is not null group by src_ip, ts),
  b(ip, ts) as (select ip, min(ts) from ev group by ip union all
    select e.ip, min(e.ts) from b join ev e on e.ip = b.ip and e.ts >= b.ts + interval {DAY} second group by e.ip),
  blocks as (select b.ip, b.ts as blocked_at, b.ts + interval {DAY} second as expires_at, ev.reason
    from b join ev on ev.ip = b.ip and ev.ts = b.ts)"""


def block_input(spark, d):
    return a.host_alerts(spark, d).filter("src_ip is not null").select(
        F.col("src_ip").alias("ip"), "ts", F.col("rule_id").alias("reason"))


@query("w06_block_cooldown", sql("select * from blocks", "alerts", recursive=True, extra=BLOCK_CTES))
def w06(spark, d):
    return respond.block_events(block_input(spark, d), DAY)


@query("d04_expired", sql(f"select ip, blocked_at from blocks where expires_at <= timestamp '{AS_OF}'", "alerts",
                          recursive=True, extra=BLOCK_CTES))
def d04(spark, d):
    return respond.expired_blocks(respond.block_events(block_input(spark, d), DAY), AS_OF).select("ip", "blocked_at")
