"""Quality classifier: a sparse ensemble of rules over text statistics.

Shallow trees of a random forest are grown on labelled documents' statistics; every path from a root to one of its
nodes is a conjunction of thresholds, a rule. A lasso logistic regression over the rules' truth values keeps a few of
them with a weight. The result is one column expression: no model object, no Python on the executors at scoring.

Null or empty texts have zero statistics and are scored like any other. Labels with a null id or value are ignored,
an id labelled twice counts as its larger label. Without two classes among the training rows the score is the share of
label 1 there (0 if none). Extra columns are ignored.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netvigil.llm.common import bounded_labels
from netvigil.llm.textstats import SHAPE, shape_stats
from netvigil.session import materialize

MAX_LABELS = 50_000   # labelled rows the rules are fitted on, a documented bound
TREES, DEPTH = 20, 3
LASSO = 0.001
SEED = 42
THRESHOLD = 0.3


class Condition(NamedTuple):
    column: str
    above: bool
    value: float


Rule = tuple[Condition, ...]

_BRANCH = re.compile(r"^( *)(If|Else) \(feature (\d+) (<=|>) (\S+)\)$")


def tree_rules(description: str, columns: list[str]) -> list[Rule]:
    """All root-to-node paths of the trees in a printed model."""
    rules, path = [], []
    for line in description.splitlines():
        m = _BRANCH.match(line)
        if not m:
            continue
        path = [(depth, c) for depth, c in path if depth < len(m[1])]
        path.append((len(m[1]), Condition(columns[int(m[3])], m[4] == ">", float(m[5]))))
        rules.append(tuple(sorted(c for _, c in path)))
    return list(dict.fromkeys(rules))


def rule_column(rule: Rule) -> Column:
    """The rule as a condition on the statistics, repeated bounds on a column merged."""
    bounds: dict[tuple[str, bool], float] = {}
    for column, above, value in rule:
        held = bounds.get((column, above), value)
        bounds[column, above] = max(held, value) if above else min(held, value)
    out = F.lit(True)
    for (column, above), value in bounds.items():
        out = out & (F.col(column) > value if above else F.col(column) <= value)
    return out


def fit(train: DataFrame) -> tuple[float, list[tuple[Rule, float]]]:
    """Intercept and weighted rules from rows with the SHAPE columns and ``label``."""
    columns = list(SHAPE)
    rows = VectorAssembler(inputCols=columns, outputCol="features").transform(train)
    forest = RandomForestClassifier(labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED, maxBins=64,
                                    featureSubsetStrategy="onethird").fit(rows)
    rules = tree_rules(forest.toDebugString, columns)
    if not rules:
        return 0.0, []
    truth = F.array(*[rule_column(r).cast("double") for r in rules])
    points = materialize(train.select(F.col("label").cast("double").alias("label"), truth.alias("truth")), "rules").select(
        "label", array_to_vector("truth").alias("features"))
    lasso = LogisticRegression(regParam=LASSO, elasticNetParam=1.0, standardization=False, maxIter=100).fit(points)
    weights = [float(w) for w in lasso.coefficients.toArray()]
    return float(lasso.intercept), [(r, w) for r, w in zip(rules, weights, strict=True) if w]


def compile_score(intercept: float, weighted: list[tuple[Rule, float]]) -> Column:
    margin = sum((F.when(rule_column(r), F.lit(w)).otherwise(0.0) for r, w in weighted), F.lit(intercept))
    return 1 / (1 + F.exp(-margin))


def score(docs: DataFrame, labels: DataFrame, train: Column, label: str = "quality") -> DataFrame:
    """doc_id and score (0 to 1) of every row. ``train`` says which rows of ``labels`` may be learned from."""
    stats = materialize(shape_stats(docs), "shape")
    known = materialize(bounded_labels(labels, label, train, MAX_LABELS), "labels")
    rows = materialize(stats.join(known, "doc_id"), "train")
    classes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}  # two rows
    if len(classes) < 2:
        return stats.select("doc_id", F.lit(float(next(iter(classes), 0))).alias("score"))
    return stats.select("doc_id", compile_score(*fit(rows)).alias("score"))
