"""Whitelisted addresses from list files and from a comma list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_lines(lines: DataFrame) -> DataFrame:
    """One address per line; blank lines and ``#`` comments (whole or trailing) drop out."""
    entry = F.trim(F.regexp_replace(F.col("value"), r"#.*$", ""))
    return lines.select(entry.alias("ip")).filter(F.col("ip") != "")


def parse_list(text: DataFrame) -> DataFrame:
    """Comma list in column ``value``; quotes are removed."""
    bare = F.regexp_replace(F.col("value"), "[\"']", "")
    entries = text.select(F.explode(F.split(bare, ",")).alias("ip"))
    return entries.select(F.trim("ip").alias("ip")).filter(F.col("ip") != "")


def load(spark: SparkSession, path: str | None, comma_list: str = "") -> DataFrame:
    """Entries of the file united with those of the comma list."""
    entries = spark.range(1).select(F.lit(comma_list).alias("value")).transform(parse_list)
    if path:
        entries = parse_lines(spark.read.text(path)).union(entries)
    return entries.distinct()


def ip_number(ip: Column) -> Column:
    """IPv4 text as a number; null when it is not an IPv4 address."""
    parts = F.split(ip, r"\.")
    number = sum(
        (F.get(parts, i).try_cast("long") * (256 ** (3 - i)) for i in range(1, 4)),
        F.get(parts, 0).try_cast("long") * 256 ** 3,
    )
    return F.when(ip.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), number)


def expand_cidr(entries: DataFrame) -> DataFrame:
    """Entries as (prefix_bits, network) pairs; a plain address is a /32.

    Matching is an equi-join per prefix length on ``network_number``, never a
    range scan per row.
    """
    address = F.substring_index("ip", "/", 1)
    bits = F.when(F.col("ip").contains("/"), F.substring_index("ip", "/", -1).try_cast("int")).otherwise(32)
    return (
        entries.select(address.alias("a"), bits.alias("prefix_bits"))
        .select("prefix_bits", F.floor(ip_number(F.col("a")) / F.pow(F.lit(2.0), 32 - F.col("prefix_bits")))
                .cast("long").alias("network"))
        .dropna().distinct()
    )


def network_number(ip: Column, bits: int) -> Column:
    """The address shifted to its network of the given prefix length."""
    return F.floor(ip_number(ip) / F.lit(float(2 ** (32 - bits)))).cast("long")
