"""Synthetic minority oversampling."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netvigil.operators.slices import number_rows
from netvigil.session import bounded_broadcast, materialize

MINORITY_TARGET, NEIGHBOURS, BLOCK_ROWS = 10_000, 3, 1024


def nearest_in_class(numbered: DataFrame, vector: str, label: str, neighbours: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(label, pos, near): the positions of each row's nearest rows of its class, nearest first, ties by position.

    ``numbered`` has a dense ``pos`` from 1 within the class. Every pair of blocks
    of a class is one task of two blocks, which keeps the best few per row; those
    are merged per row. No task holds a class.
    """
    rows = numbered.select(label, "pos", F.col(vector).cast("array<double>").alias("x"),
                           F.floor((F.col("pos") - 1) / F.lit(block_rows)).cast("int").alias("block"))
    blocks = rows.groupBy(label).agg((F.max("block")).alias("_last"))
    spread = rows.join(bounded_broadcast(blocks), label).withColumn("other", F.explode(F.sequence(F.lit(0), "_last")))
    asked = spread.select(label, F.col("block").alias("i"), F.col("other").alias("j"), F.lit(True).alias("asks"), "pos", "x")
    known = spread.select(label, F.col("other").alias("i"), F.col("block").alias("j"), F.lit(False).alias("asks"), "pos", "x")

    def best(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ask, know = pdf[pdf["asks"]], pdf[~pdf["asks"]].sort_values("pos")
        x, y = np.stack(ask["x"].to_numpy()), np.stack(know["x"].to_numpy())
        here, there = ask["pos"].to_numpy(), know["pos"].to_numpy()
        gaps, near = [], []
        for at, pos in enumerate(here):
            gap = ((y - x[at]) ** 2).sum(axis=1)
            order = np.argsort(gap, kind="stable")
            order = order[there[order] != pos][:neighbours]
            gaps.append(gap[order].tolist())
            near.append(there[order].tolist())
        return pd.DataFrame({label: key[0], "pos": here, "gap": gaps, "near": near})

    kind = numbered.schema[label].dataType.simpleString()
    found = asked.unionByName(known).groupBy(label, "i", "j").applyInPandas(
        best, f"{label} {kind}, pos long, gap array<double>, near array<long>")
    # One entry per block and neighbour: a few per block of the class.
    merged = F.slice(F.array_sort(F.flatten(F.collect_list(F.arrays_zip("gap", "near")))), 1, neighbours)
    return found.groupBy(label, "pos").agg(merged.alias("_m")).select(label, "pos", F.col("_m.near").alias("near"))


def oversample_minorities(
    df: DataFrame, row_id: str, vector: str, label: str = "attack_number", target: int = MINORITY_TARGET,
    neighbours: int = NEIGHBOURS, majority: int = 0, seed: int = 42, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Raise every class below ``target`` (but the majority code) to ``target`` rows.

    A synthetic row lies between a class row and one of its nearest neighbours
    in the class; which ones, and where between, follows from a hash of the
    seed, the class and the row's number. Larger classes, null labels and
    classes with fewer than two vectors pass untouched.
    """
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"), F.count(vector).alias("_v"))
    minor = materialize(
        counts.filter((F.col("_n") < target) & (F.col("_v") > 1) & (F.col(label) != majority)), "minorities")
    members = df.filter(F.col(vector).isNotNull()).select(row_id, vector, label).join(
        bounded_broadcast(minor.select(label)), label, "left_semi")
    numbered = number_rows(members, [label], [row_id], "pos")
    near = nearest_in_class(numbered, vector, label, neighbours, block_rows)

    def draw(what: int, below: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), F.col(label), F.col("_i"), F.lit(what)), below)

    drawn = minor.withColumn("_i", F.explode(F.sequence(F.lit(0), (F.lit(target) - F.col("_n") - 1).cast("int")))).select(
        label, "_i", (draw(1, F.col("_v")) + 1).alias("pos"),
        draw(2, F.least(F.lit(neighbours), F.col("_v") - 1)).cast("int").alias("_pick"),
        (draw(3, F.lit(1 << 30)) / F.lit(float(1 << 30))).alias("_w"))
    x = numbered.select(label, "pos", F.col(vector).cast("array<double>").alias("_x"))
    placed = drawn.join(near, [label, "pos"]).join(x, [label, "pos"]).withColumn("_other", F.get("near", F.col("_pick")))
    ends = placed.join(x.select(label, F.col("pos").alias("_other"), F.col("_x").alias("_y")), [label, "_other"])
    synthetic = ends.select(
        F.concat_ws("-", F.lit("synthetic"), label, "_i").alias(row_id),
        F.zip_with("_x", "_y", lambda a, b: a + F.col("_w") * (b - a)).alias(vector), label)
    original = df.select(F.col(row_id).cast("string").alias(row_id), F.col(vector).cast("array<double>").alias(vector), label)
    return original.unionByName(synthetic)
