"""Shared plumbing of micro-batch jobs: idempotent batch outputs and carried state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """One folder per batch, overwritten on replay, so a retried batch leaves no duplicates."""
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def written_batch(schema: StructType, path: str, batch_id: int, spark: SparkSession) -> DataFrame:
    """What ``write_batch`` wrote."""
    return spark.read.schema(schema).parquet(f"{path}/batch_id={batch_id}")


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_updates(spark: SparkSession, path: str, *keys: str) -> DataFrame:
    """Of the rows written under each key, those of the last batch that wrote any: later batches replace earlier ones."""
    rows = spark.read.parquet(path)
    last = rows.groupBy(*keys).agg(F.max("batch_id").alias("_last"))
    match = [rows[k].eqNullSafe(last[k]) for k in keys] + [rows["batch_id"] == last["_last"]]
    return rows.join(last, match, "left_semi").drop("batch_id")


class CarriedState:
    """A table handed from batch to batch, one version per batch id.

    Batch n reads version n-1 and writes version n; a replayed batch reads the
    same input again, so the outcome does not depend on retries. Versions before
    n-1 are removed, as no replay can ask for them.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema

    def before(self, batch_id: int) -> DataFrame:
        if batch_id == 0:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/version={batch_id - 1}")

    def save(self, df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/version={batch_id}")
        if batch_id > 1:
            jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
            old = jvm.org.apache.hadoop.fs.Path(f"{self.path}/version={batch_id - 2}")
            old.getFileSystem(conf).delete(old, True)


def run_available(
    stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append",
    interval: str | None = None,
) -> StreamingQuery:
    """Start a micro-batch query: all available input and stop, or every ``interval``."""
    writer = stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
    return writer.start()


def late_rows(query: StreamingQuery) -> int:
    """Rows that the engine dropped behind the watermark, over the progress reports the query still holds."""
    return sum(op["numRowsDroppedByWatermark"] for report in query.recentProgress for op in report["stateOperators"])


def state_rows(query: StreamingQuery) -> int:
    """Rows held in all state stores after the last batch."""
    reports = query.recentProgress
    return sum(op["numRowsTotal"] for op in reports[-1]["stateOperators"]) if reports else 0
