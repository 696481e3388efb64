"""Field extraction from emitted event lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Decoded field -> (JSON keys accepted, value pattern).
_TEXT, _INT, _NUMBER, _SIGNED = r'"([^"]+)"', r"(\d+)", r"([0-9.]+)", r"(-?[0-9.]+)"
FIELDS = {
    "srcip": ("src_ip", _TEXT),
    "dstip": ("dst_ip", _TEXT),
    "srcport": ("src_port", _INT),
    "dstport": ("dst_port", _INT),
    "attack_type": ("attack_type", _TEXT),
    "confidence": ("confidence", _NUMBER),
    "threat_level": ("threat_level", _TEXT),
    "threat_level_value": ("threat_level_value", _INT),
    "layer": ("detection_layer|layer", _TEXT),
    "protocol": ("protocol", _TEXT),
    "anomaly_score": ("anomaly_score", _SIGNED),
}
LINE_PREFIX = "hybrid-nids: "
SOCKET_PREFIX = "1:hybrid-nids:"


def _extract(keys: str, pattern: str) -> Column:
    return F.nullif(F.regexp_extract("value", rf'"(?:{keys})":\s*{pattern}', 1), F.lit(""))


def decode(lines: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Lines with the event prefix -> eleven text fields; socket-framed lines carry
    their remainder in ``extra_data``; anything else drops out."""
    value = F.col("value")
    is_line, is_socket = value.startswith(LINE_PREFIX), value.startswith(SOCKET_PREFIX)
    fields = [F.when(is_line, _extract(*spec)).alias(name) for name, spec in FIELDS.items()]
    extra = F.when(is_socket, F.nullif(F.substring(value, len(SOCKET_PREFIX) + 1, 1 << 30), F.lit("")))
    return lines.filter(is_line | is_socket).select(*keep, *fields, extra.alias("extra_data"))
