"""Row and column selection from fused one-pass statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netvigil.operators.quantiles import exact_quantile_table
from netvigil.session import bounded_broadcast


def drop_rare_classes(df: DataFrame, label: str, minimum: int = 1000) -> DataFrame:
    """Keep rows of classes with at least ``minimum`` rows."""
    kept = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= minimum).select(label)
    return df.join(bounded_broadcast(kept), label, "left_semi")


def column_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: count, mean, sample std, min, max, missing. One pass."""
    exprs = []
    for c in columns:
        x = F.col(c)
        exprs.append(
            F.struct(
                F.lit(c).alias("column"), F.count(x).alias("count"), F.avg(x).alias("mean"),
                F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"),
                F.count_if(x.isNull()).alias("missing"),
            ).alias(c)
        )
    return df.agg(F.array(*exprs).alias("s")).select(F.inline("s"))


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Column statistics with exact quartiles."""
    stats = column_stats(df, columns).collect()  # one row per column
    counts = {r["column"]: r["count"] for r in stats}
    quartiles = exact_quantile_table(df, columns, [0.25, 0.5, 0.75], counts=counts)
    rows = [(*r, *quartiles[r["column"]]) for r in stats]
    return df.sparkSession.createDataFrame(
        rows, "column string, count long, mean double, std double, min double, max double, missing long, "
              "p25 double, p50 double, p75 double")


def zero_variance_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """Columns with zero sample std (a null std, n <= 1, is kept).

    Decided by min = max: merging partial deviations of a constant can leave a
    rounding residue.
    """
    flat = df.agg(*[((F.count(c) > 1) & (F.min(c) == F.max(c))).alias(c) for c in columns]).first()
    return [c for c in columns if flat[c]]


def correlations(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """Pearson correlation of each column with the target, rounded to 2 decimals.

    Columns must vary: drop zero-variance columns first.
    """
    pairs = F.array(
        *[F.struct(F.lit(c).alias("column"), F.round(F.corr(c, target), 2).alias("corr")) for c in columns]
    )
    return df.agg(pairs.alias("p")).select(F.inline("p"))


def rank_correlations(corr: DataFrame, minimum: float = 0.01) -> DataFrame:
    """Columns with minimum < abs(corr) < 1, signed, strongest first within each sign."""
    r = F.col("corr")
    return (
        corr.filter((F.abs(r) > minimum) & (F.abs(r) < 1))
        .withColumn("sign", F.when(r > 0, "positive").otherwise("negative"))
        .orderBy(F.desc("sign"), F.abs(r).desc(), "column")
    )


def select_by_correlation(df: DataFrame, columns: list[str], target: str, minimum: float = 0.01) -> list[str]:
    """Feature names surviving the zero-variance and correlation filters, in input order."""
    flat = set(zero_variance_columns(df, columns))
    varying = [c for c in columns if c not in flat]
    if not varying:
        return []
    kept = {r["column"] for r in rank_correlations(correlations(df, varying, target), minimum).collect()}
    return [c for c in columns if c in kept]
