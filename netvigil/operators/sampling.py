"""Seeded sampling, splitting and balancing by hash rank.

A row's place in a seeded shuffle is the order of md5(seed-id). The place is
found from bucket counts over the leading hex digits, which are spread evenly,
so ranking a class needs no task larger than one bucket of that class, and rows
in buckets wholly inside or outside a cut are decided without any shuffle. Buckets are as narrow as the largest class asks
for; their counts are taken once and written.
"""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netvigil.operators.slices import join_null_safe
from netvigil.session import bounded_broadcast, materialize

BUCKET_DIGITS = 3      # 4096 buckets per class, or more:
BUCKET_ROWS = 250_000  # beyond this size of the largest bucket, further digits split it


def seeded_hash(row_id: Column, seed: int = 42) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}-"), row_id.cast("string")))


def _with_hash(df: DataFrame, row_id: str, seed: int) -> DataFrame:
    return df.withColumn("_hash", seeded_hash(F.col(row_id), seed))


def seeded_rank(
    df: DataFrame, row_id: str, by: list[str], seed: int = 42, name: str = "seed_rank", digits: int = BUCKET_DIGITS
) -> DataFrame:
    """1-based rank of every row in the seeded order of its class, and the class size."""
    rows, offsets = _in_buckets(_with_hash(df, row_id, seed), by, digits)
    inside = Window.partitionBy(*by, "_bucket").orderBy("_hash", row_id)
    ranked = rows.withColumn("_in", F.row_number().over(inside))
    return (
        join_null_safe(ranked, bounded_broadcast(offsets), [*by, "_bucket"])
        .withColumn(name, F.col("_before") + F.col("_in"))
        .withColumnRenamed("_class_rows", "class_rows")
        .drop("_hash", "_bucket", "_in", "_before", "_rows")
    )


def _in_buckets(hashed: DataFrame, by: list[str], digits: int) -> tuple[DataFrame, DataFrame]:
    """Rows with ``_bucket``, and the written offsets of the buckets. The hash is even, so digits enough for the largest
    bucket bound all; rows that repeat one id cannot be told apart and stay in one."""
    rows = hashed.withColumn("_bucket", F.substring("_hash", 1, digits))
    offsets = materialize(_bucket_offsets(rows, by), "buckets")
    largest = offsets.agg(F.max("_rows")).first()[0] or 0
    more = ceil(log(largest / BUCKET_ROWS, 16)) if largest > BUCKET_ROWS else 0
    if more:
        rows = hashed.withColumn("_bucket", F.substring("_hash", 1, digits + more))
        offsets = materialize(_bucket_offsets(rows, by), "buckets")
    return rows, offsets


def _bucket_offsets(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows before each bucket of a class, and the class total (classes x buckets rows)."""
    counts = rows.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    w = Window.partitionBy(*by).orderBy("_bucket")
    return counts.select(
        *by, "_bucket", "_rows",
        F.coalesce(F.sum("_rows").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_rows").over(Window.partitionBy(*by)).alias("_class_rows"),
    )


def first_in_seeded_order(
    df: DataFrame, row_id: str, by: list[str], cap: Column | int, seed: int = 42, digits: int = BUCKET_DIGITS
) -> DataFrame:
    """The first ``cap`` rows of each class in seeded order (all rows of smaller classes).

    ``cap`` may depend on the class columns. Only the bucket that crosses the
    cap is ranked; every other row is kept or dropped by its bucket alone.
    """
    cap = F.lit(cap) if isinstance(cap, int) else cap
    rows, offsets = _in_buckets(_with_hash(df, row_id, seed), by, digits)
    cuts = offsets.withColumn("_cap", cap).filter(F.col("_before") < F.col("_cap"))
    cuts = cuts.select(
        *by, "_bucket", "_before", "_cap", (F.col("_before") + F.col("_rows") <= F.col("_cap")).alias("_whole")
    )
    placed = join_null_safe(rows, bounded_broadcast(cuts), [*by, "_bucket"])
    edge = Window.partitionBy(*by, "_bucket").orderBy("_hash", row_id)
    crossing = (
        placed.filter(~F.col("_whole")).withColumn("_in", F.row_number().over(edge))
        .filter(F.col("_before") + F.col("_in") <= F.col("_cap")).drop("_in")
    )
    return placed.filter("_whole").unionByName(crossing).select(*df.columns)


def encode_labels(df: DataFrame, label: str, name: str = "attack_number") -> DataFrame:
    """Alphabetical label codes from 0; distinct labels are a small aggregate. A null label keeps its row, without a code."""
    codes = (
        df.select(label).dropna().distinct()
        .withColumn(name, (F.dense_rank().over(Window.orderBy(label)) - 1).cast("int"))
    )
    return df.join(bounded_broadcast(codes), label, "left")


def stratified_split(
    df: DataFrame, row_id: str, by: list[str], test: float = 0.2, validation: float = 0.125, seed: int = 42
) -> DataFrame:
    """Column ``split``: per class, ``test`` of all rows, ``validation`` of the rest, else train. Null is a class."""
    ranked = seeded_rank(df, row_id, by, seed)
    n_test = F.round(F.col("class_rows") * test).cast("long")
    n_val = F.round((F.col("class_rows") - n_test) * validation).cast("long")
    split = (
        F.when(F.col("seed_rank") <= n_test, "test")
        .when(F.col("seed_rank") <= n_test + n_val, "validation").otherwise("train")
    )
    return ranked.withColumn("split", split).drop("seed_rank", "class_rows")


def undersample(df: DataFrame, row_id: str, by: str, value, cap: int, seed: int = 42) -> DataFrame:
    """Cut one class to ``cap`` rows by seeded order; other classes, null among them, stay whole."""
    chosen = first_in_seeded_order(df.filter(F.col(by) == value), row_id, [by], cap, seed)
    return df.filter(~F.col(by).eqNullSafe(F.lit(value))).unionByName(chosen)


def per_class_sample(
    df: DataFrame, row_id: str, label: str, n: int = 100, include_benign: bool = False, seed: int = 42
) -> DataFrame:
    """Up to ``n`` rows of every label (benign optional, once); null is a label."""
    rows = df if include_benign else df.filter(~F.upper(label).eqNullSafe(F.lit("BENIGN")))
    return first_in_seeded_order(rows, row_id, [label], n, seed)


def downsample(df: DataFrame, row_id: str, n: int, seed: int = 42) -> DataFrame:
    """Uniform sample of ``n`` rows over the whole table."""
    return first_in_seeded_order(df, row_id, [], n, seed)


def shuffle_rows(df: DataFrame, row_id: str, seed: int = 42) -> DataFrame:
    """Seeded full shuffle: a range-partitioned sort on the hash."""
    return df.orderBy(seeded_hash(F.col(row_id), seed), row_id)
