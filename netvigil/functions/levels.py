"""Threat grading: detector output -> level 1..4 (LOW..CRITICAL)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from netvigil.schemas import CRITICAL, HIGH, LEVELS, LOW, MEDIUM

# Name fragments that grade a classified attack.
SEVERE_FRAGMENTS = ["dos", "ddos", "infiltration", "botnet"]
MODERATE_FRAGMENTS = ["portscan", "bruteforce", "patator"]

# Advice per combined level.
ADVICE = {
    CRITICAL: "IMMEDIATE: Block IP, isolate host, investigate",
    HIGH: "URGENT: Block IP, review logs, escalate",
    MEDIUM: "MONITOR: Add to watchlist, review in 1 hour",
    LOW: "LOG: Record for analysis",
}
CHAIN_ADVICE = "CRITICAL: Active attack, block immediately"


def level_name(level: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in LEVELS]), level.cast("int"))


def level_value(name: Column) -> Column:
    position = F.array_position(F.array(*[F.lit(n) for n in LEVELS]), F.upper(name)).cast("int")
    return F.when(position > 0, position)


def severity_level(severity: Column) -> Column:
    """Signature severity: 1 is CRITICAL, 2 HIGH, anything else MEDIUM."""
    return F.when(severity == 1, CRITICAL).when(severity == 2, HIGH).otherwise(MEDIUM)


def _has_any(text: Column, fragments: list[str]) -> Column:
    return text.rlike("|".join(fragments))


def attack_level(attack: Column, confidence: Column, normalize_names: bool = False) -> Column:
    """Grade a classified attack by name fragment and confidence.

    ``normalize_names`` also matches spellings with spaces, ``_`` or ``-``.
    """
    text = F.lower(attack)
    if normalize_names:
        text = F.regexp_replace(text, r"[ _-]", "")
    severe = _has_any(text, SEVERE_FRAGMENTS)
    return (
        F.when(severe & (confidence > 0.8), CRITICAL)
        .when(severe, HIGH)
        .when(_has_any(text, MODERATE_FRAGMENTS), MEDIUM)
        .otherwise(LOW)
    )


def isolation_level(score: Column) -> Column:
    return (
        F.when(score < -0.7, CRITICAL).when(score < -0.5, HIGH).when(score < -0.3, MEDIUM).otherwise(LOW)
    )


def isolation_confidence(score: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), -score))


def error_ratio(score: Column, threshold: Column) -> Column:
    return F.when(threshold > 0, F.try_divide(score, threshold)).otherwise(1.0)


def error_level(score: Column, threshold: Column) -> Column:
    ratio = error_ratio(score, threshold)
    return F.when(ratio > 5.0, CRITICAL).when(ratio > 3.0, HIGH).when(ratio > 1.5, MEDIUM).otherwise(LOW)


def error_confidence(score: Column, threshold: Column) -> Column:
    return F.least(F.lit(1.0), F.try_divide(score, threshold * F.lit(3.0)))


def host_level(rule_level: Column) -> Column:
    return F.when(rule_level >= 12, CRITICAL).when(rule_level >= 10, HIGH).when(rule_level >= 7, MEDIUM).otherwise(LOW)


def combined_level(network: Column, host: Column, correlation_type: Column) -> Column:
    """Higher of both; an address match below HIGH is raised one level."""
    top = F.greatest(network, host)
    return F.when((correlation_type == "ip_match") & (top < HIGH), top + 1).otherwise(top)


def advice(level: Column) -> Column:
    return F.element_at(F.array(*[F.lit(ADVICE[i]) for i in (LOW, MEDIUM, HIGH, CRITICAL)]), level.cast("int"))
