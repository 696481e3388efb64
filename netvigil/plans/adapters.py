"""Flow, alert and detection tables derived from the supplied tables.

The supplied data hold no network flows, so ``lineitem`` stands for flows,
``events`` for signature and host alerts, ``supplier`` for the whitelist.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netvigil.operators import detect

ERROR_THRESHOLD = 0.0888


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def host_ip(key: Column) -> Column:
    """One private address per key: 10.<b2>.<b1>.<b0>."""
    return F.concat_ws(
        ".", F.lit("10"),
        (F.shiftright(key, 16) % 256).cast("string"),
        (F.shiftright(key, 8) % 256).cast("string"),
        (key % 256).cast("string"),
    )


def server_ip(key: Column) -> Column:
    return F.concat(F.lit("172.16.0."), (key % 8).cast("string"))


def flows(spark: SparkSession, sf_dir: str, deal: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """Labelled, scored flows. flow_id sorts in arrival order within a capture. ``deal`` may spread the input rows."""
    li = deal(table(spark, sf_dir, "lineitem"))
    flag = F.concat("l_returnflag", "l_linestatus")
    line = F.col("l_linenumber")
    label = (
        F.when(flag == "AF", "DoS Hulk").when(flag == "AO", "DDoS").when(flag == "RO", "PortScan")
        .when(flag == "RF", "SSH-Patator")
        .when((flag == "NF") & (line == 1), "Web Attack XSS")
        .when((flag == "NF") & (line == 2), "Infiltration")
        .when((flag == "NO") & (line == 1), "Bot")
        .otherwise("BENIGN")
    )
    return li.select(
        F.year("l_shipdate").cast("string").alias("capture_id"),
        F.concat_ws(
            "-", F.col("l_shipdate").cast("date").cast("string"),
            F.lpad(F.col("l_orderkey").cast("string"), 12, "0"),
            F.lpad(line.cast("string"), 2, "0"),
            F.lpad(F.col("l_partkey").cast("string"), 10, "0"),
            F.lpad(F.col("l_suppkey").cast("string"), 8, "0"),
        ).alias("flow_id"),
        F.col("l_shipdate").alias("ts"),
        host_ip(F.col("l_suppkey")).alias("src_ip"),
        server_ip(F.col("l_partkey")).alias("dst_ip"),
        (F.col("l_orderkey") % 60000 + 1024).cast("int").alias("src_port"),
        (line + 20).cast("int").alias("dst_port"),
        F.when(F.col("l_linestatus") == "F", "TCP").otherwise("UDP").alias("protocol"),
        label.alias("label"),
        F.round(F.col("l_discount") * 10 + 0.0, 4).alias("confidence"),
        F.round(F.col("l_tax") * 6 + 0.0, 4).alias("score"),
        F.col("l_extendedprice").alias("flow_duration"),
        F.col("l_quantity").alias("tot_fwd_pkts"),
        (F.col("l_discount") + 0.0).alias("down_up_ratio"),
        (F.col("l_tax") + 0.0).alias("active_mean"),
    )


FLOW_FEATURES = ["flow_duration", "tot_fwd_pkts", "down_up_ratio", "active_mean"]


def signature_alerts(spark: SparkSession, sf_dir: str, deal: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """Flattened signature alerts (the same rows the JSON scan yields)."""
    ev = table(spark, sf_dir, "events")
    return deal(ev.filter(F.col("event_type") != "view")).select(
        F.year("ts").cast("string").alias("capture_id"),
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("row_key"),
        "ts",
        (F.col("user_id") + 2000000).cast("string").alias("signature_id"),
        F.concat(F.lit("sig "), F.col("event_type")).alias("message"),
        F.when(F.col("event_type") == "error", "Attempted DoS").otherwise("Misc Activity").alias("category"),
        (F.length("event_type") % 4).cast("int").alias("severity"),
        host_ip(F.col("user_id")).alias("src_ip"),
        server_ip(F.col("user_id")).alias("dst_ip"),
        F.lit(40000).cast("int").alias("src_port"),
        F.lit(443).cast("int").alias("dst_port"),
        F.lit("TCP").alias("protocol"),
    )


HOST_GROUPS = {
    "click": "web_attack", "error": "sshd", "purchase": "syscheck", "signup": "pam", "view": "network_scan",
}


def host_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flattened host alerts; one in the 'view' family has no source address."""
    ev = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    group = F.create_map(*[F.lit(x) for kv in HOST_GROUPS.items() for x in kv])[kind]
    return ev.select(
        "ts", "event_id",
        F.concat(F.lit("R-"), kind).alias("rule_id"),
        (F.floor("value").cast("int") % 16).alias("rule_level"),
        F.concat(F.lit("host rule "), kind).alias("rule_description"),
        F.lpad((F.col("user_id") % 8).cast("string"), 3, "0").alias("agent_id"),
        F.concat(F.lit("agent-"), (F.col("user_id") % 8).cast("string")).alias("agent_name"),
        server_ip(F.col("user_id")).alias("agent_ip"),
        F.when(kind != "view", host_ip(F.col("user_id"))).alias("src_ip"),
        F.when(kind == "click", server_ip(F.col("user_id") + 1)).alias("dst_ip"),
        F.concat(F.lit("event from "), host_ip(F.col("user_id")), F.lit(" kind "), kind).alias("full_log"),
        F.array(F.upper(group), F.lit("local")).alias("groups"),
    )


def whitelist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trusted hosts: suppliers in very good standing, and one server."""
    sup = table(spark, sf_dir, "supplier").filter("s_acctbal > 9000").select(host_ip(F.col("s_suppkey")).alias("ip"))
    return sup.union(spark.sql("select '172.16.0.5' as ip")).distinct()


def raw_detections(spark: SparkSession, sf_dir: str, rebalanced: bool = False) -> DataFrame:
    """Detections of all layers; ``rebalanced`` deals the narrow input rows anew, those of a source together.

    Wide detections of one task are then as many as an advised partition gives, whatever the files, so sorting them stays in
    memory; a source too large for one partition is split.
    """
    f, alerts = flows(spark, sf_dir), signature_alerts(spark, sf_dir)
    if rebalanced:
        f = flows(spark, sf_dir, lambda li: li.hint("rebalance", "l_suppkey"))
        alerts = signature_alerts(spark, sf_dir, lambda ev: ev.hint("rebalance", "user_id"))
    return detect.union_layers(
        detect.signature_detections(alerts),
        detect.flow_detections(f, detect.classifier_hit(), detect.error_hit(ERROR_THRESHOLD)),
    )


def kept_detections(spark: SparkSession, sf_dir: str, rebalanced: bool = False) -> DataFrame:
    return detect.drop_whitelisted(raw_detections(spark, sf_dir, rebalanced), whitelist(spark, sf_dir))


def unique_detections(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Unique detections; naming columns carries only those besides the keys."""
    return detect.dedup(kept_detections(spark, sf_dir, rebalanced=True), columns=list(columns) or None)
