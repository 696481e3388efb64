"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Words are runs of anything but these: blank and the control characters 9 to 13.
BLANKS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(name: str = "text") -> Column:
    """The text, with null read as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANKS, -1), "")


def fold(parts: int, key: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def row_key() -> list[Column]:
    """id_key, text_key: names a row by its id (null included) and its text; rows equal in both share the name."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id_key"), F.xxhash64(whole_text()).alias("text_key")]


def row_name() -> Column:
    """``row_key`` as one number, for filters that must tell rows apart under null or repeated ids."""
    return F.xxhash64(*row_key())


HOT_KEYS = 10_000


def join_counted(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` that have a partner in ``keys``: distinct keys with ``n``, the number of rows each of them may meet.

    Keys with a share of 1 / HOT_KEYS or more of all of ``n`` are HOT_KEYS at most, whatever the input, so they are
    broadcast. None of the others is hot, so they are joined by a shuffle. ``keys`` should be a written table.
    """
    total = keys.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("decimal(38,0)")).first()[0]
    hot = F.col("n").cast("decimal(38,0)") * HOT_KEYS >= F.lit(total)
    few = keys.where(hot).drop("n")
    met = rows.join(F.broadcast(few), on)
    rest = rows.join(F.broadcast(few.select(*on)), on, "left_anti").join(keys.where(~hot).drop("n"), on)
    return met.unionByName(rest)


def bounded_labels(labels: DataFrame, label: str, keep: Column, bound: int) -> DataFrame:
    """At most ``bound`` labelled ids, picked by a hash of the id; ids labelled twice keep the larger label.

    The bound is what makes the result safe to broadcast: two small columns per row.
    """
    one = labels.where(keep & F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(
        F.max(F.col(label).cast("int")).alias("label"))
    # a cut of the hash leaves little more than the bound, so no task sorts or hands on more than that
    n = one.count()
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31))
    return one.where(draw <= F.lit(int((1 << 31) * min(1.0, 1.05 * bound / max(n, 1))))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)


def parts(batch: pa.RecordBatch, rows: int = 200) -> Iterator[pa.RecordBatch]:
    """The batch in short slices, where a row becomes many Python objects."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def map_batches(df: DataFrame, schema: str, fn: Callable[[dict[str, list]], dict[str, list] | None]) -> DataFrame:
    """Run ``fn`` on each Arrow batch as columns of Python values."""
    names = [part.strip().split(" ")[0] for part in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = None
        for batch in (p for b in batches for p in parts(b)):
            got = fn({n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)})
            if got is None or not len(got[names[0]]):
                continue
            if types is None:
                types = _arrow_types(schema)
            yield pa.RecordBatch.from_arrays([pa.array(got[n], types[n]) for n in names], names=names)

    return df.mapInArrow(run, schema)


def _arrow_types(schema: str) -> dict[str, pa.DataType]:
    known = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(),
             "binary": pa.binary(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()),
             "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}
    return {part.strip().split(" ")[0]: known[part.strip().split(" ")[1]] for part in schema.split(",")}
