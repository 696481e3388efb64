"""Ordered computation in bounded pieces.

A window partitioned by one key puts that whole key in one task. The helpers
here cut an ordered group into pieces whose size does not grow with the group:
dense row numbers from a range partitioning, time slices with overlap, and
two-level running totals.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netvigil.functions.text import epoch_micros
from netvigil.session import bounded_broadcast, materialize

_POSITION_MASK = (1 << 33) - 1  # low bits of monotonically_increasing_id


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equality join in which a null key meets a null key; the keys are the left side's."""
    named = right.select(*[F.col(c).alias(f"_j_{c}") if c in keys else F.col(c) for c in right.columns])
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_j_{k}")) for k in keys])
    return left.join(named, on, how).drop(*[f"_j_{k}" for k in keys])


def number_rows(df: DataFrame, keys: list[str], order: list[str], name: str = "flow_seq") -> DataFrame:
    """Dense 1-based position of each row within its key, without a per-key task.

    Range partitioning on (keys, order) spreads even one dominant key over many
    tasks; each task numbers its own rows, and the per-task counts give the
    offsets. The numbered rows are materialized once, because range bounds are
    sampled and would move on recomputation.
    """
    cols = [*keys, *order]
    local = (
        df.repartitionByRange(*cols).sortWithinPartitions(*cols)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_pos", F.monotonically_increasing_id().bitwiseAND(F.lit(_POSITION_MASK)))
    )
    local = materialize(local)
    pieces = local.groupBy("_part", *keys).agg(
        F.count(F.lit(1)).alias("_rows"), F.min("_pos").alias("_first")
    )
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.select(
        "_part", *keys, "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset")
    )
    return (
        join_null_safe(local, bounded_broadcast(offsets), ["_part", *keys])
        .withColumn(name, F.col("_offset") + F.col("_pos") - F.col("_first") + 1)
        .drop("_part", "_pos", "_first", "_offset")
    )


UNTIMED_SLICES = 4096


def with_time_slices(df: DataFrame, ts: str, slice_seconds: int, overlap_seconds: int) -> DataFrame:
    """Add (time_slice, is_copy): each row in its slice, and again in the next one
    when it lies within the overlap before that slice starts. Rows without a time are spread over slices before all others."""
    if overlap_seconds > slice_seconds:
        raise ValueError("overlap must not exceed the slice")
    width, overlap = slice_seconds * 1_000_000, overlap_seconds * 1_000_000
    micros = epoch_micros(F.col(ts))
    apart = F.lit(-(1 << 40)) - F.pmod(F.xxhash64(*df.columns), F.lit(UNTIMED_SLICES))
    own = F.coalesce(F.floor(micros / F.lit(width)).cast("long"), apart)
    near_end = F.pmod(micros, F.lit(width)) >= width - overlap
    homes = F.array(
        F.struct(own.alias("time_slice"), F.lit(False).alias("is_copy")),
        F.when(near_end, F.struct((own + 1).alias("time_slice"), F.lit(True).alias("is_copy"))),
    )
    return df.select("*", F.inline(homes)).filter(F.col("time_slice").isNotNull())


def running_sums(
    df: DataFrame, keys: list[str], bucket: Column, order: list[Column | str], sums: dict[str, str]
) -> DataFrame:
    """Running totals in two levels: totals per ordered bucket, then within the bucket.

    ``bucket`` must be monotone in ``order``. Each task sees one bucket; the
    bucket totals are a small aggregate.
    """
    rows = df.withColumn("_bucket", bucket)
    totals = rows.groupBy(*keys, "_bucket").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "_bucket", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums]
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.select("*", *[F.sum(c).over(inside).alias(f"_i_{n}") for n, c in sums.items()])
    joined = join_null_safe(summed, offsets, [*keys, "_bucket"])
    return joined.select(
        *[c for c in df.columns], *[(F.col(f"_o_{n}") + F.col(f"_i_{n}")).alias(n) for n in sums]
    )


def with_previous(
    df: DataFrame, keys: list[str], order: list[str], column: str, slice_seconds: int = 3600, name: str = "previous"
) -> DataFrame:
    """The column's value on the previous row of the same key (first of ``order`` is a timestamp).

    Lag runs inside (key, time slice); the first row of a slice takes the last
    value of the key's nearest earlier slice from a small per-slice table.
    """
    sliced = df.withColumn("_slice", F.floor(epoch_micros(F.col(order[0])) / F.lit(slice_seconds * 1_000_000)))
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order)
    rows = sliced.withColumn("_lag", F.lag(column).over(inside)).withColumn(
        "_first", F.row_number().over(inside) == 1
    )
    tails = sliced.groupBy(*keys, "_slice").agg(F.max_by(column, F.struct(*order)).alias("_last"))
    carry = tails.withColumn("_carry", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_slice")))
    joined = join_null_safe(rows, carry.select(*keys, "_slice", "_carry"), [*keys, "_slice"])
    return joined.withColumn(name, F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_lag"))).drop(
        "_slice", "_lag", "_first", "_carry"
    )
