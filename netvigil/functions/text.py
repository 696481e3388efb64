"""String, JSON and time expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_truthy(*cols: Column) -> Column:
    """First value that is neither null nor the empty string."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def parse_time(text: Column, fallback: Column | None = None) -> Column:
    """ISO timestamp text (``Z`` or offset or naive, read as UTC) with a fallback."""
    parsed = text.try_cast("timestamp")
    return parsed if fallback is None else F.coalesce(parsed, fallback)


def signature_attack(category: Column, message: Column) -> Column:
    return F.concat(F.lit("["), category, F.lit("] "), message)


def percent(value: Column) -> Column:
    return F.format_string("%.2f%%", F.round(value * 100, 2))


def confidence_text(confidence: Column) -> Column:
    """Confidence as it appears in an emitted event (4 decimals, no padding)."""
    return F.round(confidence, 4).cast("string")


def template_pieces(template: str) -> list[str]:
    """Texts at even places and field names at odd ones of ``text $(field) text``."""
    return re.split(r"\$\(([^)]+)\)", template)


def epoch_seconds(ts: Column) -> Column:
    """Seconds since the epoch as double, for either timestamp type."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1_000_000.0)


def epoch_micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))
