"""Block cooldown and expiry over a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from netvigil.functions.text import epoch_micros
from netvigil.operators.respond import BLOCK_SECONDS, block_events
from netvigil.streaming.batches import CarriedState, run_available, write_batch


def block_stream(
    events: DataFrame, out: str, checkpoint: str, duration: int = BLOCK_SECONDS, cells: int = 288,
    interval: str | None = None,
) -> StreamingQuery:
    """Blocks per micro-batch; the carried state is one number per address.

    The choice inside a batch is the sliced batch operator, so a dominant
    address does not land in one task. State older than the newest event by
    more than the duration can no longer suppress anything and is dropped.
    """
    state = CarriedState(events.sparkSession, f"{out}/state", "ip string, allowed_micros long")

    def each(batch: DataFrame, batch_id: int) -> None:
        before = state.before(batch_id)
        blocks = block_events(batch, duration, cells, carried=before).persist()
        write_batch(blocks, f"{out}/blocks", batch_id)
        fresh = blocks.groupBy("ip").agg(F.max(epoch_micros(F.col("expires_at"))).alias("allowed_micros"))
        newest = batch.agg(F.max(epoch_micros(F.col("ts")))).first()[0]
        merged = before.unionByName(fresh).groupBy("ip").agg(F.max("allowed_micros").alias("allowed_micros"))
        horizon = F.lit(newest if newest is not None else -(1 << 62)).cast("long")
        state.save(merged.filter(F.col("allowed_micros") > horizon), batch_id)
        blocks.unpersist()

    return run_available(events, each, f"{checkpoint}/blocks", interval=interval)
