"""Oracle building blocks: named CTEs in ANSI SQL over the supplied tables."""

from __future__ import annotations


def _host(k: str) -> str:
    return (f"concat('10.', cast(cast(floor({k} / 65536.0) as bigint) % 256 as varchar), '.', "
            f"cast(cast(floor({k} / 256.0) as bigint) % 256 as varchar), '.', cast({k} % 256 as varchar))")


def _server(k: str) -> str:
    return f"concat('172.16.0.', cast(({k}) % 8 as varchar))"


def level_case(attack: str, conf: str) -> str:
    severe = " or ".join(f"lower({attack}) like '%{t}%'" for t in ("dos", "infiltration", "botnet"))
    moderate = " or ".join(f"lower({attack}) like '%{t}%'" for t in ("portscan", "bruteforce", "patator"))
    return (f"case when ({severe}) and {conf} > 0.8 then 4 when ({severe}) then 3 "
            f"when ({moderate}) then 2 else 1 end")


THR = "cast(0.0888 as double)"
LEVEL_NAME = "case threat_level when 1 then 'LOW' when 2 then 'MEDIUM' when 3 then 'HIGH' else 'CRITICAL' end"

CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "flows": ((), f"""
      select cast(year(l_shipdate) as varchar) as capture_id,
        concat(cast(cast(l_shipdate as date) as varchar), '-', lpad(cast(l_orderkey as varchar), 12, '0'), '-',
          lpad(cast(l_linenumber as varchar), 2, '0'), '-', lpad(cast(l_partkey as varchar), 10, '0'), '-',
          lpad(cast(l_suppkey as varchar), 8, '0')) as flow_id,
        l_shipdate as ts, {_host('l_suppkey')} as src_ip, {_server('l_partkey')} as dst_ip,
        cast(l_orderkey % 60000 + 1024 as integer) as src_port, cast(l_linenumber + 20 as integer) as dst_port,
        case when l_linestatus = 'F' then 'TCP' else 'UDP' end as protocol,
        case when l_returnflag = 'A' and l_linestatus = 'F' then 'DoS Hulk'
             when l_returnflag = 'A' and l_linestatus = 'O' then 'DDoS'
             when l_returnflag = 'R' and l_linestatus = 'O' then 'PortScan'
             when l_returnflag = 'R' and l_linestatus = 'F' then 'SSH-Patator'
             when l_returnflag = 'N' and l_linestatus = 'F' and l_linenumber = 1 then 'Web Attack XSS'
             when l_returnflag = 'N' and l_linestatus = 'F' and l_linenumber = 2 then 'Infiltration'
             when l_returnflag = 'N' and l_linestatus = 'O' and l_linenumber = 1 then 'Bot'
             else 'BENIGN' end as label,
        round(l_discount * 10 + 0.0, 4) as confidence, round(l_tax * 6 + 0.0, 4) as score,
        l_extendedprice as flow_duration, l_quantity as tot_fwd_pkts,
        l_discount + 0.0 as down_up_ratio, l_tax + 0.0 as active_mean
      from lineitem"""),
    "eve": ((), f"""
      select cast(year(ts) as varchar) as capture_id, lpad(cast(event_id as varchar), 12, '0') as row_key, ts,
        cast(user_id + 2000000 as varchar) as signature_id, concat('sig ', event_type) as message,
        case when event_type = 'error' then 'Attempted DoS' else 'Misc Activity' end as category,
        cast(length(event_type) % 4 as integer) as severity,
        {_host('user_id')} as src_ip, {_server('user_id')} as dst_ip, 40000 as src_port, 443 as dst_port,
        'TCP' as protocol
      from events where event_type <> 'view'"""),
    "alerts": ((), f"""
      select ts, event_id, concat('R-', event_type) as rule_id, cast(floor(value) as integer) % 16 as rule_level,
        concat('host rule ', event_type) as rule_description,
        lpad(cast(user_id % 8 as varchar), 3, '0') as agent_id, concat('agent-', cast(user_id % 8 as varchar)) as agent_name,
        {_server('user_id')} as agent_ip, case when event_type <> 'view' then {_host('user_id')} end as src_ip,
        case when event_type = 'click' then {_server('user_id + 1')} end as dst_ip,
        concat('event from ', {_host('user_id')}, ' kind ', event_type) as full_log,
        case event_type when 'click' then 'web_attack' when 'error' then 'sshd' when 'purchase' then 'syscheck'
             when 'signup' then 'pam' else 'network_scan' end as grp
      from events"""),
    "wl": ((), f"""
      select distinct {_host('s_suppkey')} as ip from supplier where s_acctbal > 9000
      union select '172.16.0.5'"""),
    "det": (("flows", "eve"), f"""
      select capture_id, signature_id as flow_id, src_ip, dst_ip, src_port, dst_port, protocol,
        concat('[', category, '] ', message) as attack_type, cast(0.95 as double) as confidence, 'suricata' as layer,
        case severity when 1 then 4 when 2 then 3 else 2 end as threat_level,
        cast(null as double) as anomaly_score, ts, concat('1-', row_key) as det_seq from eve
      union all
      select capture_id, flow_id, src_ip, dst_ip, src_port, dst_port, protocol, upper(label), confidence, 'xgboost',
        {level_case('label', 'confidence')}, null, ts, concat('2-', flow_id) from flows where upper(label) <> 'BENIGN'
      union all
      select capture_id, flow_id, src_ip, dst_ip, src_port, dst_port, protocol, 'VAE_ANOMALY',
        least(cast(1.0 as double), score / ({THR} * cast(3.0 as double))), 'vae',
        case when score / {THR} > 5.0 then 4 when score / {THR} > 3.0 then 3 when score / {THR} > 1.5 then 2 else 1 end,
        score, ts, concat('3-', flow_id) from flows where score > {THR}"""),
    "kept": (("det", "wl"), """
      select * from det where src_ip not in (select ip from wl) and dst_ip not in (select ip from wl)"""),
    "uniq": (("kept",), """
      select * exclude (rn) from (select *,
          row_number() over (partition by capture_id, src_ip, dst_ip, attack_type order by confidence desc, det_seq) as rn,
          count(*) over (partition by capture_id, src_ip, dst_ip, attack_type) as flow_count from kept) where rn = 1"""),
    "summary": (("flows", "det", "kept", "uniq"), """
      select c.capture_id,
        (select count(*) from flows f where f.capture_id = c.capture_id) as total_flows,
        (select count(*) from uniq u where u.capture_id = c.capture_id) as unique_attacks,
        (select cast(coalesce(sum(u.flow_count), 0) as bigint) from uniq u where u.capture_id = c.capture_id) as attack_flows,
        (select count(*) from det d where d.capture_id = c.capture_id)
          - (select count(*) from kept k where k.capture_id = c.capture_id) as filtered_count
      from (select capture_id from flows union select capture_id from det) c"""),
}


def sql(body: str, *needs: str, recursive: bool = False, extra: str = "") -> str:
    """``WITH`` clause of the needed CTEs in dependency order, then the body."""
    order: list[str] = []

    def visit(name: str) -> None:
        for dep in CTES[name][0]:
            visit(dep)
        if name not in order:
            order.append(name)

    for name in needs:
        visit(name)
    parts = [f"{n} as ({CTES[n][1]})" for n in order]
    if extra:
        parts.append(extra)
    if not parts:
        return body
    return f"with {'recursive ' if recursive else ''}" + ",\n".join(parts) + "\n" + body
