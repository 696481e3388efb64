"""Session construction and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only after a bounded count proves it is at most this many rows.
BROADCAST_ROW_LIMIT = 200_000


def build_session(app: str = "netvigil", master: str | None = None, **conf: str) -> SparkSession:
    """Session with UTC time and adaptive execution; cluster settings win over these."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Only a local session without the setting gets a temporary folder; a cluster
    without it is a configuration error, because a machine-local folder would be
    lost with its executor.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(folder)
        return folder
    current = sc.getCheckpointDir()
    if current:
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="netvigil-", dir="/tmp")
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


_created: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path under the shared folder; ``release_scratch`` removes what lies there."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _created.append(path)
    return path


def release_scratch(spark: SparkSession, since: int = 0) -> int:
    """Remove the scratch tables made since the given mark; results that still read them must have been written.

    Gives the number of paths that were there.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    removed = 0
    for text in _created[since:]:
        path = jvm.org.apache.hadoop.fs.Path(text)
        removed += bool(path.getFileSystem(conf).delete(path, True))
    del _created[since:]
    return removed


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Owns the scratch tables made inside: they are gone when the block ends. Write or collect results within it."""
    mark = len(_created)
    try:
        yield
    finally:
        release_scratch(spark, mark)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files behind; otherwise they lie on disk until the driver collects garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Cut the lineage by writing a table to the shared folder and reading it back.

    Unlike an eager checkpoint this computes the rows once, and readers prune columns.
    """
    path = scratch_path(df.sparkSession, name)
    with _shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_broadcast(df: DataFrame, limit: int = BROADCAST_ROW_LIMIT) -> DataFrame:
    """Hint a broadcast only when a bounded count proves the side small.

    Beyond the limit the side is returned unhinted and the planner falls back to
    a shuffled join, which adaptive execution can split on skewed keys.
    """
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df
