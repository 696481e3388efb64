"""The continuous loop: score, whitelist, dedup, correlate, dispatch, summarize."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from netvigil.functions.text import epoch_seconds
from netvigil.operators import correlate, detect, respond
from netvigil.streaming.batches import CarriedState, run_available, write_batch, written_batch


@dataclass(frozen=True)
class LoopConfig:
    out: str
    checkpoint: str
    enabled_actions: tuple[str, ...] = respond.DEFAULT_ACTIONS
    block_threshold: str = "HIGH"
    interval: str | None = None  # None: process what is available and stop
    cycle_seconds: int = 15
    lookback_seconds: int = 300
    lateness_seconds: int = 3600


def detection_loop(
    flows: DataFrame, to_raw: Callable[[DataFrame], DataFrame], whitelist: DataFrame, config: LoopConfig
) -> StreamingQuery:
    """Per micro-batch: raw detections -> kept -> unique -> outbox and summary tables.

    A capture (input file) never spans batches, so dedup is per capture as in batch.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        raw = to_raw(batch)
        write_batch(detect.dedup(detect.drop_whitelisted(raw, whitelist)), f"{config.out}/detections", batch_id)
        # the written rows are read again, narrow; the raw ones are only counted, from the columns that tell them
        unique = written_batch(raw.schema, f"{config.out}/detections", batch_id, batch.sparkSession)
        write_batch(respond.outbox(unique, config.enabled_actions, config.block_threshold)
                    .select("det_seq", "action_order", "action"), f"{config.out}/outbox", batch_id)
        write_batch(detect.cycle_summary(batch, raw, unique), f"{config.out}/summary", batch_id)

    return run_available(flows, each, f"{config.checkpoint}/loop", interval=config.interval)


def correlation_loop(detections: DataFrame, alerts: DataFrame, config: LoopConfig) -> StreamingQuery:
    """Detections of each cycle against the host-alert table's lookback.

    A cycle stays open until the newest event is ``lateness_seconds`` past its end, and its detections are carried until
    then. A batch computes the cycles it adds to anew from all their detections; readers take each cycle's last
    version (``read_updates`` by cycle), so a cycle that spans batches is reported once. Detections of closed cycles are
    written to ``late`` and not used.
    """
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in detections.schema.fields)
    state = CarriedState(detections.sparkSession, f"{config.out}/open", types)
    width, late = config.cycle_seconds, config.lateness_seconds
    end = (F.floor(epoch_seconds(F.col("ts")) / width) + 1) * width

    def each(batch: DataFrame, batch_id: int) -> None:
        held = state.before(batch_id)
        before = held.agg(F.max(epoch_seconds(F.col("ts")))).first()[0]
        closed = F.lit(False) if before is None else end <= before - late
        write_batch(batch.filter(closed), f"{config.out}/late", batch_id)
        fresh = batch.filter(~closed)
        span = fresh.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"), F.max(epoch_seconds(F.col("ts"))).alias("newest")).first()
        if span["lo"] is None:
            state.save(held, batch_id)
            return
        cycles = fresh.select(F.floor(epoch_seconds(F.col("ts")) / width).alias("cycle")).distinct()
        both = held.unionByName(fresh)
        touched = both.withColumn("cycle", F.floor(epoch_seconds(F.col("ts")) / width)).join(cycles, "cycle", "left_semi").drop("cycle")
        kind = alerts.schema["ts"].dataType.typeName()
        low = F.lit(span["lo"]).cast(kind) - F.make_dt_interval(secs=F.lit(config.lookback_seconds + width))
        high = F.lit(span["hi"]).cast(kind) + F.make_dt_interval(secs=F.lit(width))
        near = alerts.filter((F.col("ts") >= low) & (F.col("ts") <= high))
        det, host = correlate.assign_cycles(touched, near, width, config.lookback_seconds)
        write_batch(correlate.correlate(det, host, scope=("cycle",)), f"{config.out}/correlated", batch_id)
        newest = max(span["newest"], before or span["newest"])
        state.save(both.filter(end > newest - late), batch_id)

    return run_available(detections, each, f"{config.checkpoint}/correlation", interval=config.interval)
