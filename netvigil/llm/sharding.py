"""Shards with the corpus mixture: stratified ranks, interleaved by fraction and cut into equal counts.

Rows are put in a seeded order within their source; the row of rank r among n gets the fraction (r - 1/2) / n.
In the order of fractions every stretch holds each source in proportion, so cutting that order into equal
counts gives shards that differ by one row at most and match the mixture.

Both orders are global and neither is one sort by one key: rows fall into buckets along the order (the seeded
hash is uniform, and so are fractions), bucket counts give each bucket's offset, and only buckets are sorted,
so a source with a third of all rows is spread like any other. Only ids, sizes and checksums are shuffled.

A null text has no bytes, null ids and repeated rows are placed like others (ties are settled by id, checksum and
size, after that the rows are alike), a null source is a source of its own. Other columns are ignored.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netvigil.llm.common import whole_text
from netvigil.session import materialize

SHARDS = 40
SEED = 42
ROW_OVERHEAD = 16
LAW = "rows"


def _place(rows: DataFrame, stratum: list[str], bucket: str, order: list[str]) -> DataFrame:
    """Adds ``place``, the row's number from 1 along (bucket, order) within its stratum."""
    offsets = rows.groupBy(*stratum, bucket).count().withColumn(
        "before", F.sum("count").over(Window.partitionBy(*stratum).orderBy(bucket)) - F.col("count"))
    within = Window.partitionBy(*stratum, bucket).orderBy(*order)
    return rows.withColumn("within", F.row_number().over(within)).join(
        offsets.drop("count"), [*stratum, bucket]).withColumn("place", F.col("before") + F.col("within")).drop(
        "within", "before", bucket)


def assign(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, text_crc32, shard and slot (gapless from 0 within the shard) of every row."""
    text = whole_text().cast("binary")
    rows = materialize(docs.select(
        F.col("doc_id").cast("long"), F.col("source").cast("string"),
        (F.octet_length(text).cast("long") + ROW_OVERHEAD).alias("size"), F.crc32(text).alias("text_crc32"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")).alias("draw"),
    ).withColumn("stratum", F.coalesce(F.concat(F.lit("="), "source"), F.lit("null"))), "rows")
    total = rows.count()
    if not total:
        return rows.select("doc_id", "source", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    buckets = max(1, isqrt(total))
    along = F.conv(F.substring("draw", 1, 8), 16, 10).cast("long") * F.lit(buckets)
    sizes = rows.groupBy("stratum").agg(F.count(F.lit(1)).alias("members"))
    tie = ["doc_id", "text_crc32", "size"]
    ranked = _place(rows.withColumn("bucket", F.shiftright(along, 32)), ["stratum"], "bucket", ["draw", *tie])
    mixed = ranked.join(sizes, "stratum").withColumn("fraction", (F.col("place") - 0.5) / F.col("members"))
    mixed = materialize(mixed.withColumn("bucket", F.floor(F.col("fraction") * buckets)).drop("place", "members"), "ranks")
    mixed = mixed.withColumn("all", F.lit(0))
    placed = _place(mixed, ["all"], "bucket", ["fraction", "stratum", "draw", *tie])
    at = (F.col("place") - 1).cast("long")
    # integer division, as doubles cannot tell neighbours apart in very long orders
    shard = F.expr(f"cast(((place - 1) * {shards}) div {total} as int)")
    first = F.expr(f"(cast(((place - 1) * {shards}) div {total} as long) * {total} + {shards - 1}) div {shards}")
    return placed.select("doc_id", "source", "size", "text_crc32", shard.alias("shard"), (at - first).alias("slot"))


def write(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED) -> None:
    """The rows themselves, one folder per shard, in slot order. Ids must be unique here."""
    plan = assign(docs, shards, seed).select("doc_id", "shard", "slot")
    docs.join(plan, "doc_id").repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy(
        "shard").parquet(path)
