"""From layer outputs to one clean detection table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netvigil.functions import levels
from netvigil.functions.text import signature_attack
from netvigil.schemas import DETECTION_COLUMNS
from netvigil.session import bounded_broadcast
from netvigil.sources.whitelist import expand_cidr, ip_number, network_number

SIGNATURE_CONFIDENCE = 0.95
# Arrival order of the layers; det_seq is "<ordinal>-<row key>".
LAYER_ORDINAL = {"suricata": 1, "xgboost": 2, "vae": 3, "isolation_forest": 4}


def _seq(layer: str, key: Column) -> Column:
    return F.concat(F.lit(f"{LAYER_ORDINAL[layer]}-"), key)


def _finish(df: DataFrame) -> DataFrame:
    return df.withColumn("flow_count", F.lit(1).cast("long")).select(*DETECTION_COLUMNS)


def signature_detections(eve: DataFrame) -> DataFrame:
    """Signature alerts -> detections (needs capture_id, row_key next to the alert fields)."""
    return _finish(
        eve.select(
            "capture_id", F.col("signature_id").alias("flow_id"), "src_ip", "dst_ip", "src_port",
            "dst_port", "protocol", signature_attack(F.col("category"), F.col("message")).alias("attack_type"),
            F.lit(SIGNATURE_CONFIDENCE).alias("confidence"), F.lit("suricata").alias("layer"),
            levels.severity_level(F.col("severity")).alias("threat_level"),
            F.lit(None).cast("double").alias("anomaly_score"), "ts",
            _seq("suricata", F.col("row_key")).alias("det_seq"),
        )
    )


def non_benign(df: DataFrame, label: str = "label") -> DataFrame:
    return df.filter(F.upper(F.col(label)) != "BENIGN")


FLOW_COLUMNS = ["capture_id", "flow_id", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "ts"]


def _hit(layer: str, attack: Column, confidence: Column, level: Column, score: Column) -> Column:
    return F.struct(
        attack.alias("attack_type"), confidence.alias("confidence"), F.lit(layer).alias("layer"),
        level.alias("threat_level"), score.cast("double").alias("anomaly_score"),
        _seq(layer, F.col("flow_id")).alias("det_seq"),
    )


def classifier_hit(normalize_names: bool = False) -> Column:
    """Hit struct of a flow scored by the classifier, null when benign."""
    label, confidence = F.col("label"), F.col("confidence")
    return F.when(
        F.upper(label) != "BENIGN",
        _hit("xgboost", F.upper(label), confidence,
             levels.attack_level(label, confidence, normalize_names), F.lit(None)),
    )


def error_hit(threshold: float, score: str = "score") -> Column:
    """Hit struct of a flow whose reconstruction error exceeds the threshold."""
    limit, score = F.lit(float(threshold)), F.col(score)
    return F.when(
        score > limit,
        _hit("vae", F.lit("VAE_ANOMALY"), levels.error_confidence(score, limit),
             levels.error_level(score, limit), score),
    )


def isolation_predicate(score: Column, outlier: Column, threshold: float) -> Column:
    return outlier | (score < threshold)


def isolation_hit(threshold: float = -0.5, score: str = "score") -> Column:
    """Hit struct of a flow the isolation forest calls an outlier."""
    score = F.col(score)
    return F.when(
        isolation_predicate(score, F.col("outlier"), threshold),
        _hit("isolation_forest", F.lit("ANOMALY"), levels.isolation_confidence(score),
             levels.isolation_level(score), score),
    )


def flow_detections(scored: DataFrame, *hits: Column) -> DataFrame:
    """Detections of all flow layers from one pass over the scored flows."""
    return _finish(
        scored.select(*FLOW_COLUMNS, F.explode(F.array(*hits)).alias("hit"))
        .filter(F.col("hit").isNotNull())
        .select(*FLOW_COLUMNS, "hit.*")
    )


def union_layers(*layers: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), layers)


INLINE_ENTRIES = 2_000


def drop_whitelisted(detections: DataFrame, whitelist: DataFrame) -> DataFrame:
    """Drop detections whose source or destination is listed (column ``ip``).

    A list proven short becomes a set predicate inside the scan stage; a longer
    one is anti-joined (broadcast only when its size is proven too).
    """
    entries = whitelist.select("ip").distinct()
    short = [r["ip"] for r in entries.limit(INLINE_ENTRIES + 1).collect()]
    if len(short) <= INLINE_ENTRIES:
        if not short:
            return detections
        listed = F.col("src_ip").isin(short) | F.col("dst_ip").isin(short)
        return detections.filter(~F.coalesce(listed, F.lit(False)))
    listed = bounded_broadcast(entries)
    return detections.join(listed, detections["src_ip"] == listed["ip"], "left_anti").join(
        listed, detections["dst_ip"] == listed["ip"], "left_anti")


def drop_whitelisted_networks(detections: DataFrame, entries: DataFrame) -> DataFrame:
    """As ``drop_whitelisted`` with CIDR entries: one equi-join per listed prefix length.

    Entries that are not IPv4 (an IPv6 address, a host name) match by their text.
    """
    other = bounded_broadcast(entries.filter(ip_number(F.substring_index("ip", "/", 1)).isNull()).select("ip").distinct())
    for side in ("src_ip", "dst_ip"):
        detections = detections.join(other, F.col(side) == F.col("ip"), "left_anti")
    networks = expand_cidr(entries)
    lengths = sorted(r[0] for r in networks.select("prefix_bits").distinct().collect())  # at most 33
    for bits in lengths:
        listed = bounded_broadcast(networks.filter(F.col("prefix_bits") == bits).select("network"))
        for side in ("src_ip", "dst_ip"):
            detections = detections.join(
                listed, network_number(F.col(side), bits) == F.col("network"), "left_anti")
    return detections


def dedup(
    detections: DataFrame, scope: tuple[str, ...] = ("capture_id",), columns: list[str] | None = None
) -> DataFrame:
    """Best detection per (scope, src, dst, attack): highest confidence, first on ties.

    One aggregate with map-side combine, so a hot key ships one row per task. The
    key hash leads the grouping because the sort behind the aggregate then
    compares one long instead of similar strings. ``columns`` limits what is
    carried along to what the caller reads.
    """
    keys = [*scope, "src_ip", "dst_ip", "attack_type"]
    wanted = DETECTION_COLUMNS if columns is None else [*keys, *columns, "det_seq", "flow_count"]
    rest = [c for c in wanted if c not in {*keys, "flow_count", "det_seq", "confidence"}]
    # an unknown confidence comes last
    best = F.min(F.struct(F.col("confidence").isNull().alias("_unknown"), (-F.col("confidence")).alias("_less"), "det_seq", *rest))
    found = detections.groupBy(F.xxhash64(*keys).alias("_h"), *keys).agg(
        best.alias("best"), F.sum("flow_count").alias("flow_count"))
    out = found.select(*keys, "best.*", "flow_count").withColumn("confidence", -F.col("_less"))
    return out.select(*[c for c in DETECTION_COLUMNS if c in wanted])


def cycle_summary(flows: DataFrame, raw: DataFrame, unique: DataFrame) -> DataFrame:
    """One row per capture: flows seen, unique attacks, attack flows, whitelisted count.

    The flow counts of the unique detections sum to the detections that passed the
    whitelist, so those need no pass of their own.
    """
    parts = [
        flows.groupBy("capture_id").agg(F.count(F.lit(1)).alias("total_flows")),
        raw.groupBy("capture_id").agg(F.count(F.lit(1)).alias("raw_count")),
        unique.groupBy("capture_id").agg(
            F.count(F.lit(1)).alias("unique_attacks"), F.sum("flow_count").alias("attack_flows")
        ),
    ]
    joined = reduce(lambda a, b: a.join(b, "capture_id", "full"), parts).fillna(0)
    return joined.select(
        "capture_id", "total_flows", "unique_attacks", "attack_flows",
        (F.col("raw_count") - F.col("attack_flows")).alias("filtered_count"),
    )
