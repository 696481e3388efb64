"""Quality rules: robust multivariate outliers among documents of one language and source.

Five transformed statistics describe a document. Per language and source a minimum-covariance-determinant
estimate (the mean and covariance of the tightest ``CORE`` share of its documents) is found from two starts by
concentration steps; documents whose Mahalanobis distance from it is beyond ``CUTOFF`` are rejected. All of it
is SQL aggregates and column arithmetic: group medians and thresholds are exact percentiles of rounded values
(a bounded number of distinct values, so the aggregate's state is bounded and a hot group is combined map-side),
covariances are mergeable sums, and the triangular solve is spelled out as columns.

A null text has no words, and fewer than ten words fail the base rule; such rows take no part in the estimates.
Null languages and sources are values of their own. Groups of fewer than ``SMALL`` documents are judged with the
other small groups of their language. Repeated rows are judged alike. Other columns are ignored, an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netvigil.llm.textstats import base_stats
from netvigil.session import materialize

CORE = 0.75
# Makes the core's covariance consistent for five normal columns at that share: 0.75 / P(chi2_7 <= 6.626).
CONSISTENCY = 1.41
STEPS = 3
SMALL = 50
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
# Beyond this squared distance a document is an outlier (the 1 - 1e-9 point of chi2 with 5 degrees of freedom).
CUTOFF = 50.0
# Statistic and the least standard deviation it is credited with: differences below it never make an outlier.
VECTOR = {"word_length": 0.08, "symbols": 0.08, "duplicate_lines": 0.12, "repeats": 0.1, "capitals": 0.03}


def vectors(stats: DataFrame) -> DataFrame:
    """Adds the transformed statistics; counts are pulled to a common value in very short texts."""
    n = F.col("n_words")
    return stats.withColumns({
        "word_length": F.log((F.col("word_chars") + 120) / (n + 20)),
        "symbols": F.sqrt(F.col("n_symbols") / (n + 20)),
        "duplicate_lines": F.sqrt(F.col("n_dup_lines") / (F.col("n_lines") + 10)),
        "repeats": F.sqrt(F.col("n_repeat_words") / (n + 40)),
        "capitals": F.col("n_upper") / (F.col("word_chars") + 100)})


def _percentile(value: Column, share: float) -> Column:
    return F.percentile(F.round(value, 3), F.lit(share))


def _moments(rows: DataFrame, inside: Column) -> DataFrame:
    """Means and ridged, consistent covariance of the rows inside, per key."""
    names = list(VECTOR)
    pick = {a: F.when(inside, F.col(a)) for a in names}
    out = [F.avg(pick[a]).alias(f"m_{a}") for a in names]
    for i, a in enumerate(names):
        for b in names[:i + 1]:
            cov = F.covar_pop(pick[a], pick[b]) * CONSISTENCY
            out.append((cov + (VECTOR[a] ** 2 if a == b else 0.0)).alias(f"c_{a}_{b}"))
    return rows.groupBy("key").agg(*out)


def _factor(moments: DataFrame) -> DataFrame:
    """Means, the lower Cholesky factor of the covariance, and the log of its determinant."""
    names = list(VECTOR)
    for i, a in enumerate(names):
        for j, b in enumerate(names[:i + 1]):
            rest = F.col(f"c_{a}_{b}")
            for k in names[:j]:
                rest = rest - F.col(f"l_{a}_{k}") * F.col(f"l_{b}_{k}")
            moments = moments.withColumn(f"l_{a}_{b}", F.sqrt(rest) if a == b else rest / F.col(f"l_{b}_{b}"))
    log_det = sum((2 * F.log(F.col(f"l_{a}_{a}")) for a in names), F.lit(0.0))
    return moments.select("key", *[f"m_{a}" for a in names], *[c for c in moments.columns if c.startswith("l_")],
                          log_det.alias("log_det"))


def _distance(rows: DataFrame, factors: DataFrame) -> DataFrame:
    """Adds ``d``, the squared Mahalanobis distance by the row's key."""
    names = list(VECTOR)
    out = rows.join(factors, "key")
    for i, a in enumerate(names):
        part = F.col(a) - F.col(f"m_{a}")
        for b in names[:i]:
            part = part - F.col(f"l_{a}_{b}") * F.col(f"y_{b}")
        out = out.withColumn(f"y_{a}", part / F.col(f"l_{a}_{a}"))
    return out.select(*rows.columns, sum((F.col(f"y_{a}") ** 2 for a in names), F.lit(0.0)).alias("d"))


def _core(rows: DataFrame) -> DataFrame:
    """Moments of the share CORE of each key's rows with the least ``d``."""
    close = F.log1p("d")
    limit = rows.groupBy("key").agg(_percentile(close, CORE).alias("limit"))
    return _moments(rows.join(limit, "key"), F.round(close, 3) <= F.col("limit"))


def estimate(rows: DataFrame) -> DataFrame:
    """Per key (column ``key``) the factors of the start that ends with the smaller determinant."""
    names = list(VECTOR)
    mid = materialize(rows.groupBy("key").agg(*[_percentile(F.col(a), 0.5).alias(f"mid_{a}") for a in names]), "medians")
    near = rows.join(mid, "key")
    spread = materialize(near.groupBy("key").agg(
        *[_percentile(F.abs(F.col(a) - F.col(f"mid_{a}")), 0.5).alias(f"mad_{a}") for a in names]), "spreads")
    near = near.join(spread, "key")
    z = [(F.col(a) - F.col(f"mid_{a}")) / F.greatest(1.4826 * F.col(f"mad_{a}"), F.lit(VECTOR[a])) for a in names]
    starts = [sum((x * x for x in z), F.lit(0.0)), F.greatest(*[F.abs(x) for x in z])]
    ends = []
    for at, start in enumerate(starts):
        factors = materialize(_factor(_core(near.select(*rows.columns, start.alias("d")))), "factors")
        for _ in range(STEPS):
            factors = materialize(_factor(_core(_distance(rows, factors))), "factors")
        ends.append(factors.withColumn("start", F.lit(at)))
    both = ends[0].unionByName(ends[1])
    return both.groupBy("key").agg(F.min_by(F.struct(*[c for c in both.columns if c != "key"]),
                                            F.struct("log_det", "start")).alias("best")).select("key", "best.*").drop("start")


def judge(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """doc_id, the counts, base_failed, distance (null where the base rule decides) and kept of every row."""
    stats = vectors(base_stats(docs, "lang", "source")).withColumn(
        "base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))

    def named(c: str) -> Column:
        return F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))

    stats = materialize(stats.withColumn("lang_key", named("lang")).withColumn(
        "own", F.concat_ws("\t", "lang_key", named("source"))).drop("lang", "source"), "stats")
    sound = stats.where(~F.col("base_failed"))
    sizes = sound.groupBy("own").agg(F.count(F.lit(1)).alias("members"))
    keyed = sound.join(sizes, "own").withColumn("key", F.when(F.col("members") < SMALL, F.col("lang_key")).otherwise(F.col("own")))
    keyed = materialize(keyed.drop("lang_key", "own", "members"), "keyed")
    rows = keyed.select("key", *VECTOR)
    factors = materialize(estimate(rows), "estimate")
    judged = _distance(keyed, factors)
    counts = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    failed = stats.where(F.col("base_failed")).select(*counts, F.lit(None).cast("double").alias("distance"))
    return judged.select(*counts, F.col("d").alias("distance")).unionByName(failed).withColumn(
        "kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= cutoff, F.lit(False)))
