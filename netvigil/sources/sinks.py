"""Event projections and append-only text sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netvigil.functions.levels import level_name
from netvigil.functions.text import percent

# Event framing per transport.
SIEM_PREFIX = {"api": "hybrid-nids: ", "socket": "1:hybrid-nids:", "log": ""}
SIEM_SOURCE = "hybrid-nids"


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def detection_log(unique: DataFrame, now: Column) -> DataFrame:
    """One JSON line per detection: timestamp, action, ten detection fields."""
    body = F.struct(
        "flow_id", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "attack_type", "confidence",
        "layer", level_name(F.col("threat_level")).alias("threat_level"),
    )
    line = F.struct(iso(now).alias("timestamp"), F.lit("log").alias("action"), body.alias("detection"))
    return unique.select(F.to_json(line).alias("value"))


def read_detection_log(lines: DataFrame) -> DataFrame:
    """Log lines back to columns; other actions and broken lines drop out."""
    schema = (
        "timestamp string, action string, detection struct<flow_id:string,src_ip:string,dst_ip:string,"
        "src_port:int,dst_port:int,protocol:string,attack_type:string,confidence:double,layer:string,"
        "threat_level:string>"
    )
    parsed = lines.select(F.from_json("value", schema).alias("j")).filter(F.col("j.action") == "log")
    return parsed.select("j.timestamp", "j.detection.*")


def correlation_log(correlated: DataFrame, now: Column) -> DataFrame:
    line = F.struct(
        iso(now).alias("timestamp"), F.lit("correlation").alias("action"), "correlation_type",
        level_name(F.col("threat_level")).alias("threat_level"), "description",
        F.col("attack_type").alias("nids"), F.col("rule_id").alias("hids_rule"),
    )
    return correlated.select(F.to_json(line, {"ignoreNullFields": "false"}).alias("value"))


def block_log(blocks: DataFrame, duration: int) -> DataFrame:
    line = F.struct(
        iso(F.col("blocked_at")).alias("timestamp"), F.lit("block").alias("action"), "ip",
        F.lit(duration).alias("duration"), "reason",
    )
    return blocks.select(F.to_json(line).alias("value"))


def siem_event(now: Column, transport: str = "api") -> Column:
    """Nine-field event with confidence to 4 decimals, framed for the transport."""
    event = F.struct(
        iso(now).alias("timestamp"), F.lit(SIEM_SOURCE).alias("source"), "attack_type",
        level_name(F.col("threat_level")).alias("threat_level"),
        F.round("confidence", 4).alias("confidence"), "src_ip", "dst_ip", "dst_port", "layer",
    )
    return F.concat(F.lit(SIEM_PREFIX[transport]), F.to_json(event))


def siem_lines(unique: DataFrame, now: Column, transport: str = "api") -> DataFrame:
    return unique.select(siem_event(now, transport).alias("value"))


def webhook_payloads(unique: DataFrame, now: Column) -> DataFrame:
    body = F.struct(
        "src_ip", "dst_ip", "attack_type", "confidence",
        level_name(F.col("threat_level")).alias("threat_level"), "layer",
    )
    line = F.struct(iso(now).alias("timestamp"), F.lit(SIEM_SOURCE).alias("source"), body.alias("detection"))
    return unique.select("det_seq", F.to_json(line).alias("payload"))


def email_messages(unique: DataFrame, now: Column) -> DataFrame:
    # Subject and body texts.
    level = level_name(F.col("threat_level"))
    subject = F.concat(F.lit("["), level, F.lit("] NIDS Alert: "), F.col("attack_type"))
    body = F.concat(
        F.lit("NIDS Alert: "), level,
        F.lit("\nAttack: "), F.col("attack_type"), F.lit(" | Confidence: "), percent(F.col("confidence")),
        F.lit(" | Layer: "), F.col("layer"),
        F.lit("\nSource: "), F.col("src_ip"), F.lit(":"), F.col("src_port").cast("string"),
        F.lit(" -> "), F.col("dst_ip"), F.lit(":"), F.col("dst_port").cast("string"),
        F.lit(" ("), F.col("protocol"), F.lit(")\nTime: "), iso(now),
    )
    return unique.select("det_seq", subject.alias("subject"), body.alias("body"))


def append_lines(lines: DataFrame, path: str) -> None:
    lines.select("value").write.mode("append").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def deliver(payloads: DataFrame, send) -> None:
    """Hand each partition's rows to a caller-supplied ``send(iterator)``."""
    payloads.foreachPartition(send)


def latest_artifact(spark: SparkSession, folder: str, prefix: str, suffix: str = "") -> DataFrame:
    """Newest artifact (file or folder under ``folder``) by name: one marked
    ``latest`` wins, else the last modified. Only file metadata is read.
    """
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
        .select("path", "modificationTime")
    )
    inside = F.substring_index("path", f"{folder.rstrip('/')}/", -1)
    named = files.select(F.substring_index(inside, "/", 1).alias("name"), "modificationTime").filter(
        F.col("name").startswith(prefix) & F.col("name").endswith(suffix))
    return named.agg(
        F.max_by("name", F.struct(F.col("name").contains("latest").alias("l"), "modificationTime", "name")).alias("name"))
