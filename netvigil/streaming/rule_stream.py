"""Frequency and sequence rules over a stream of detections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from netvigil.functions.text import epoch_micros
from netvigil.operators import rules as ruleset
from netvigil.streaming.batches import CarriedState, run_available, write_batch

NEEDED = ["det_seq", "src_ip", "dst_ip", "dst_port", "attack_type", "confidence", "layer", "threat_level",
          "anomaly_score", "ts"]


def rule_stream(
    detections: DataFrame, out: str, checkpoint: str, rules: tuple[ruleset.Rule, ...] = ruleset.RULES,
    interval: str | None = None, lateness_seconds: int = 3600,
) -> StreamingQuery:
    """All rule hits of the detections each micro-batch adds or can change.

    The carried tail holds detections within ``lateness_seconds`` and the longest timeframe of the newest event. A late
    event changes the history of newer ones, so everything from a batch's first event on is judged again; readers take
    each detection's last version (``read_updates`` by det_seq). Events later than the lateness are written to ``late``.
    """
    longest = max(r.timeframe for r in rules if r.timeframe)
    types = {f.name: f.dataType.simpleString() for f in detections.schema.fields}
    state = CarriedState(detections.sparkSession, f"{out}/tail", ", ".join(f"{c} {types[c]}" for c in NEEDED))

    def each(batch: DataFrame, batch_id: int) -> None:
        micros = epoch_micros(F.col("ts"))
        history = state.before(batch_id).select(*NEEDED)
        before = history.agg(F.max(micros)).first()[0]
        closed = F.lit(False) if before is None else micros < before - lateness_seconds * 1_000_000
        write_batch(batch.filter(closed), f"{out}/late", batch_id)
        fresh = batch.filter(~closed).select(*NEEDED)
        first, newest = fresh.agg(F.min(micros), F.max(micros)).first()
        if first is None:
            state.save(history, batch_id)
            return
        both = history.unionByName(fresh)
        flagged = ruleset.with_history_flags(ruleset.with_static_flags(both, rules), rules)
        write_batch(ruleset.hits(flagged.filter(micros >= first), rules), f"{out}/hits", batch_id)
        keep = max(newest, before or newest) - (longest + lateness_seconds) * 1_000_000
        state.save(both.filter(micros >= keep), batch_id)

    return run_available(detections, each, f"{checkpoint}/rules", interval=interval)
