"""Classifier and detector evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netvigil.operators.slices import running_sums
from netvigil.session import materialize


def confusion(predictions: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """(label, pred, rows): at most classes squared rows."""
    return predictions.groupBy(F.col(label).alias("label"), F.col(pred).alias("pred")).agg(
        F.count(F.lit(1)).alias("rows"))


def _ratio(a, b):
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def per_class(matrix: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class; empty denominators give 0."""
    cells = matrix.select(
        F.explode(F.array(
            F.struct(F.col("label").alias("class"), F.col("rows").alias("support"), F.lit(0).cast("long").alias("called"),
                     F.when(F.col("label") == F.col("pred"), F.col("rows")).otherwise(0).alias("hit")),
            F.struct(F.col("pred").alias("class"), F.lit(0).cast("long").alias("support"), F.col("rows").alias("called"),
                     F.lit(0).cast("long").alias("hit")),
        )).alias("c")).select("c.*")
    sums = cells.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("support", "called", "hit")])
    scored = sums.withColumns({
        "precision": _ratio(F.col("hit"), F.col("called")), "recall": _ratio(F.col("hit"), F.col("support"))})
    p, r = F.col("precision"), F.col("recall")
    return scored.withColumn("f1", _ratio(p * r * 2, p + r)).select("class", "precision", "recall", "f1", "support")


def overall(matrix: DataFrame) -> DataFrame:
    """Accuracy with macro and support-weighted averages, in one row."""
    classes = per_class(matrix)
    weight = F.col("support") / F.sum("support").over(Window.partitionBy())  # one row per class
    named = classes.withColumn("_w", weight)
    averages = named.agg(
        *[F.avg(m).alias(f"{m}_macro") for m in ("precision", "recall", "f1")],
        *[F.sum(F.col(m) * F.col("_w")).alias(f"{m}_weighted") for m in ("precision", "recall", "f1")],
    )
    hits = matrix.agg((F.sum(F.when(F.col("label") == F.col("pred"), F.col("rows")).otherwise(0)) / F.sum("rows")).alias("accuracy"))
    return hits.withColumn("_one", F.lit(1)).join(averages.withColumn("_one", F.lit(1)), "_one").drop("_one")  # one row each


def _in_ranges(points: DataFrame, *order: Column) -> DataFrame:
    """Points dealt by ranges of their order, the number of the range in ``_range``; written, since bounds are sampled."""
    return materialize(points.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")


def _area(curve: DataFrame) -> DataFrame:
    """Trapezoids under the points (tp, n, and their running sums ctp, cn), per class.

    The previous point of the curve is this point without its own counts, except that the very first previous point has
    precision 1 by definition. A point without positives adds no area.
    """
    before_n, before_tp = F.col("cn") - F.col("n"), F.col("ctp") - F.col("tp")
    precision = F.col("ctp") / F.col("cn")
    before_precision = F.coalesce(F.try_divide(before_tp, before_n), F.lit(1.0))
    totals = curve.groupBy("class").agg(F.sum("tp").alias("positives"))
    area = _ratio(F.col("tp"), F.col("positives")) * (precision + before_precision) / 2
    return curve.join(totals, "class").groupBy("class").agg(F.sum(area).alias("pr_auc"))


def pr_auc(scores: DataFrame) -> DataFrame:
    """Area under the precision-recall curve per class, one against the rest.

    Input: (class, score, positive). The curve runs over distinct scores, highest first, from (recall 0, precision 1),
    trapezoid rule. Equal scores combine before any ordering. The points are dealt by ranges of class and score; running
    sums take the totals of the ranges before, so no task orders a whole class and the driver sees none of the scores.
    """
    points = materialize(scores.groupBy("class", "score").agg(
        F.sum(F.col("positive").cast("long")).alias("tp"), F.count(F.lit(1)).alias("n")), "points")
    placed = _in_ranges(points, F.col("class"), F.desc("score"))
    return _area(materialize(running_sums(placed, ["class"], F.col("_range"), [F.desc("score")], {"ctp": "tp", "cn": "n"}), "curve"))


def pr_auc_by_label(scores: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """``pr_auc`` of every label's rows against all others under one score, without copying the rows to each class.

    All curves run over the same scores, so the counts of all rows are summed once; a class's own points are those scores
    at which it has rows, as no other point adds area.
    """
    counted = materialize(scores.groupBy(F.col(label).alias("class"), F.col(score).alias("score")).agg(F.count(F.lit(1)).alias("tp")), "points")
    every = _in_ranges(counted.groupBy("score").agg(F.sum("tp").alias("n")), F.desc("score"))
    together = running_sums(every, [], F.col("_range"), [F.desc("score")], {"cn": "n"}).select("score", "n", "cn")
    own = _in_ranges(counted.where(F.col("class").isNotNull()), F.col("class"), F.desc("score"))
    curve = running_sums(own, ["class"], F.col("_range"), [F.desc("score")], {"ctp": "tp"}).select("class", "score", "tp", "ctp")
    return _area(materialize(curve.join(together, "score"), "curve"))


def with_macro(per_class: DataFrame, name: str = "macro") -> DataFrame:
    """The classes' areas and, as one more row, their mean."""
    return per_class.unionByName(per_class.agg(F.lit(name).alias("class"), F.avg("pr_auc").alias("pr_auc")))


def model_metrics(predictions: DataFrame, model: str) -> DataFrame:
    return overall(confusion(predictions)).withColumn("model", F.lit(model))


def compare_models(tables: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), tables).orderBy(F.desc("f1_macro"), "model")


def best_model(comparison: DataFrame) -> DataFrame:
    return comparison.agg(
        F.max_by("model", F.struct("f1_macro", "model")).alias("model"), F.max("f1_macro").alias("f1_macro"))


def error_histogram(errors: DataFrame, column: str = "error", bins: int = 50) -> DataFrame:
    """Equal-width bins between min and max (last bin closed) with row counts."""
    low, high = errors.agg(F.min(column), F.max(column)).first()
    width = (high - low) / bins or 1.0
    index = F.least(F.floor((F.col(column) - low) / F.lit(width)), F.lit(bins - 1)).cast("int")
    return errors.groupBy(index.alias("bin")).agg(F.count(F.lit(1)).alias("rows")).withColumns({
        "from_error": F.lit(low) + F.col("bin") * width, "to_error": F.lit(low) + (F.col("bin") + 1) * width})


def error_summary(errors: DataFrame, column: str = "error") -> DataFrame:
    return errors.agg(F.avg(column).alias("mean"), F.max(column).alias("max"), F.stddev_pop(column).alias("std"))


def anomaly_eval_set(benign: DataFrame, attack: DataFrame, order: str, n: int = 5000) -> DataFrame:
    """The first min(attack rows, n) rows of each side in ``order``, labelled 0 and 1."""
    size = attack.limit(n).count()
    side = lambda df, value: df.orderBy(order).limit(size).withColumn("label", F.lit(value))
    return side(benign, 0).unionByName(side(attack, 1))
