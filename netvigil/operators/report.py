"""Reports over the deduplicated detection table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netvigil.functions.levels import level_name
from netvigil.operators.slices import running_sums


def _count() -> Column:
    return F.count(F.lit(1)).alias("detections")


def by_level(unique: DataFrame) -> DataFrame:
    """Detections and flows per level, CRITICAL first."""
    return (
        unique.groupBy("threat_level").agg(_count(), F.sum("flow_count").alias("flows"))
        .withColumn("threat_name", level_name(F.col("threat_level")))
        .orderBy(F.desc("threat_level"))
    )


def by_attack_cycle(unique: DataFrame) -> DataFrame:
    """Flows per attack type within each capture; level is that of the first seen."""
    return (
        unique.groupBy("capture_id", "attack_type")
        .agg(F.sum("flow_count").alias("flows"), F.min_by("threat_level", "det_seq").alias("threat_level"))
        .orderBy("capture_id", F.desc("flows"), "attack_type")
    )


def by_layer(unique: DataFrame) -> DataFrame:
    return unique.groupBy("layer").agg(_count(), F.sum("flow_count").alias("flows")).orderBy("layer")


def attack_summary(unique: DataFrame) -> DataFrame:
    return (
        unique.groupBy("attack_type")
        .agg(_count(), F.sum("flow_count").alias("flows"), F.max("confidence").alias("max_confidence"))
        .orderBy(F.desc("flows"), "attack_type")
    )


def attack_ips(unique: DataFrame) -> DataFrame:
    return unique.select("src_ip").distinct()


def attack_ip_count(unique: DataFrame, exact: bool = True) -> DataFrame:
    count = F.count_distinct("src_ip") if exact else F.approx_count_distinct("src_ip", 0.01)
    return unique.agg(count.alias("attack_ips"))


def one_pass_report(unique: DataFrame) -> DataFrame:
    """Level, attack, layer and grand totals from a single grouping-sets aggregate."""
    return (
        unique.groupingSets(
            [["threat_level"], ["attack_type"], ["layer"], []], "threat_level", "attack_type", "layer"
        )
        .agg(
            F.grouping_id().alias("report_id"), _count(), F.sum("flow_count").alias("flows"),
            F.max("confidence").alias("max_confidence"),
        )
    )


def top_threats(unique: DataFrame, n: int = 5) -> DataFrame:
    """Highest-confidence detections; arrival order breaks ties."""
    return unique.orderBy(F.desc("confidence"), "det_seq").limit(n)


def top_per_level(unique: DataFrame, n: int = 5) -> DataFrame:
    """Top n per level plus how many more the level holds.

    The rank filter runs as a per-task limit before the shuffle, so a hot level
    ships at most n rows per task.
    """
    ranked = unique.withColumn(
        "rank", F.row_number().over(Window.partitionBy("threat_level").orderBy(F.desc("confidence"), "det_seq"))
    ).filter(F.col("rank") <= n)
    totals = unique.groupBy("threat_level").agg(
        F.count(F.lit(1)).alias("level_total"), F.sum("flow_count").alias("level_flows"))
    return ranked.join(F.broadcast(totals), "threat_level").withColumn(  # at most four rows
        "more", F.greatest(F.col("level_total") - n, F.lit(0))
    )


def session_totals(summary: DataFrame, bucket: Column | None = None) -> DataFrame:
    """Running totals over captures in id order; only captures with a detection count.

    ``bucket`` groups capture ids into ordered runs (default: first 4 characters).
    """
    attacked = summary.filter(F.col("unique_attacks") > 0).withColumn("one", F.lit(1))
    totals = running_sums(
        attacked, [], F.substring("capture_id", 1, 4) if bucket is None else bucket, ["capture_id"],
        {"cycles": "one", "session_flows": "total_flows", "session_attacks": "unique_attacks"},
    )
    return totals.select("capture_id", "cycles", "session_flows", "session_attacks")


def label_distribution(df: DataFrame, column: str = "label") -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), column)


def newest(df: DataFrame, n: int, ts: str = "ts", tie: str | None = None) -> DataFrame:
    """The n most recent rows (top-k report, no global sort)."""
    order = [F.col(ts).desc()] + ([F.col(tie).desc()] if tie else [])
    return df.orderBy(*order).limit(n)


def log_rollup(log: DataFrame) -> DataFrame:
    """Detections per attack type over the detection log."""
    return log.groupBy("attack_type").agg(_count()).orderBy(F.desc("detections"), "attack_type")
