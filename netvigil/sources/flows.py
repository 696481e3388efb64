"""Flow tables from header-dirty CSV captures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netvigil.operators import clean

CAPTURE_FILE = "capture_id"


def read_flow_files(
    spark: SparkSession, paths: str | list[str], columns: list[str] | None = None, numeric: list[str] | None = None
) -> DataFrame:
    """Read CSV captures whose headers differ by source.

    Each path or glob names files of one header dialect; only the first line of
    one file is read to learn it, and a file with another header fails loudly
    instead of shifting columns. Headers are trimmed and renamed to canonical
    names, the sources united by name, the file name kept as ``capture_id``.
    """
    frames = []
    for path in [paths] if isinstance(paths, str) else paths:
        reader = (
            spark.read.option("header", True).option("mode", "PERMISSIVE").option("pathGlobFilter", "*.csv")
            .option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True)
        )
        strict = reader.option("enforceSchema", False).csv(path)
        # A repeated header is renamed by the reader and cannot be checked against the files.
        raw = reader.option("enforceSchema", True).csv(path) if clean.repeated_headers(strict.columns) else strict
        frame = clean.canonical_headers(raw.withColumn(CAPTURE_FILE, F.col("_metadata.file_name")))
        frames.append(frame.select(*[c for c in [*columns, CAPTURE_FILE] if c in frame.columns]) if columns else frame)
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return clean.cast_numeric(merged, numeric) if numeric else merged


def load_for_test(df: DataFrame, features: list[str]) -> DataFrame:
    """Trimmed headers, no all-null rows, non-finite and null features as 0."""
    trimmed = clean.trim_headers(df)
    return clean.zero_fill(trimmed.dropna(how="all"), [c for c in features if c in trimmed.columns])


# Accepted spellings of the endpoint columns, in order of preference.
ENDPOINTS = {
    "src_ip": (["src_ip", "source_ip", "src"], "unknown"),
    "dst_ip": (["dst_ip", "destination_ip", "dst"], "unknown"),
    "src_port": (["src_port", "source_port", "sport"], 0),
    "dst_port": (["dst_port", "destination_port", "dport"], 0),
    "protocol": (["protocol", "proto"], "unknown"),
}


def endpoint(df: DataFrame, name: str) -> Column:
    """Endpoint by the first existing spelling, else its default."""
    spellings, default = ENDPOINTS[name]
    found = next((s for s in spellings if s in df.columns), None)
    if isinstance(default, int):
        return F.coalesce(F.col(found).try_cast("int"), F.lit(default)) if found else F.lit(default)
    return F.coalesce(F.col(found).cast("string"), F.lit(default)) if found else F.lit(default)


def with_endpoints(df: DataFrame) -> DataFrame:
    return df.select(
        *[c for c in df.columns if c not in ENDPOINTS], *[endpoint(df, n).alias(n) for n in ENDPOINTS]
    )
