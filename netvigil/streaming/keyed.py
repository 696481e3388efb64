"""Jobs over state that the engine keeps per address or bucket of sources, with event-time timers.

Rows may come in any order within the lateness. Each key's rows wait in list state until the watermark has passed them and
are then walked in order, so the outcome is that of the batch operators whatever the cut into micro-batches. A batch touches
the keys it holds rows of, and those whose timer is due; nothing else of the state is read. Rows behind the watermark are
dropped and counted by the engine (``late_rows``).
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from netvigil.functions.text import epoch_micros
from netvigil.operators import rules as ruleset
from netvigil.operators.respond import BLOCK_SECONDS

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocks_store(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in the store that timers and state variables need."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


class InOrder(StatefulProcessor):
    """Holds rows (t in microseconds, then ``columns``) until the watermark has passed them, then calls ``walk``.

    A subclass says in ``columns`` what a row carries besides its time, drops rows that cannot matter in ``thin``, and
    gives output rows and the next time it wants to be woken (None: never) from ``walk``.
    """

    columns: dict[str, str] = {}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        arrays = ", ".join(f"{name} array<{kind}>" for name, kind in self.columns.items())
        self.waiting = handle.getListState("waiting", f"t array<bigint>, {arrays}")
        self.timer = handle.getValueState("timer", "at long")
        self.open(handle)

    def open(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def thin(self, rows: list[tuple]) -> list[tuple]:
        return rows

    def walk(self, key: tuple, rows: list[tuple], passed: int) -> tuple[list[Row], int | None]:
        raise NotImplementedError

    def _hold(self, rows: list[tuple]) -> None:
        self.waiting.appendValue(tuple(list(c) for c in zip(*rows, strict=True)))

    def _wake(self, micros: int) -> None:
        at = -(-micros // 1000)
        current = self.timer.get()[0] if self.timer.exists() else None
        if current is None or at < current:
            if current is not None:
                self.handle.deleteTimer(current)
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        names = ["t", *self.columns]
        fresh = self.thin([tuple(r[n] for n in names) for r in rows])
        if fresh:
            self._hold(fresh)
            self._wake(min(r[0] for r in fresh))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = [row for chunk in self.waiting.get() for row in zip(*chunk, strict=True)]
        self.waiting.clear()
        self.timer.clear()
        out, wake = self.walk(key, sorted(r for r in held if r[0] <= passed), passed)
        later = [r for r in held if r[0] > passed]
        if later:
            self._hold(later)
            self._wake(min(r[0] for r in later))
        if wake is not None:
            self._wake(max(wake, passed + 1))
        return iter(out)

    def close(self) -> None:
        pass


def _timed(stream: DataFrame, lateness: int) -> DataFrame:
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", f"{lateness} seconds")


def _in_order(timed: DataFrame, key: str, wanted: Column, columns: dict[str, Column]):
    """The rows that are ``wanted``, cut down to key, time and ``columns``, grouped by the key.

    The time comes out of an explode that unwanted rows do not survive. A filter would be pushed below the watermark, which
    would then stand still while no wanted row comes.
    """
    t = F.explode(F.when(wanted & F.col("ts").isNotNull(), F.array(epoch_micros(F.col("ts"))))).alias("t")
    return timed.select(key, "ts", *[c.alias(n) for n, c in columns.items()], t).groupBy(key)


def _started(out: DataFrame, path: str, checkpoint: str, interval: str | None) -> StreamingQuery:
    writer = out.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    with rocks_store(out.sparkSession):
        return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def _row_of(schema: str) -> Row:
    return Row(*[f.strip().split(" ")[0] for f in schema.split(",")])


# --- blocks: cooldown and expiry ------------------------------------------------------------------

class Cooldown(InOrder):
    """One value per address, its running block; a timer lifts it."""

    columns = {"reason": "string"}
    OUTPUT = "ip string, action string, began long, ends long, reason string"

    def __init__(self, duration: int) -> None:
        self.duration = duration * 1_000_000

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.block = handle.getValueState("block", "began long, ends long, reason string")

    def thin(self, rows: list[tuple]) -> list[tuple]:
        """Of each time the least reason; what falls into the running block can neither block nor matter."""
        ends = self.block.get()[1] if self.block.exists() else None
        least: dict[int, str] = {}
        for t, reason in rows:
            if (ends is None or t >= ends) and (t not in least or (reason or "") < (least[t] or "")):
                least[t] = reason
        return list(least.items())

    def walk(self, key: tuple, rows: list[tuple], passed: int) -> tuple[list[Row], int | None]:
        told = _row_of(self.OUTPUT)
        block, out = tuple(self.block.get()) if self.block.exists() else None, []
        for t, reason in rows:
            if block is None or t >= block[1]:
                if block is not None:
                    out.append(told(key[0], "unblock", *block))
                block = (t, t + self.duration, reason)
                out.append(told(key[0], "block", *block))
        if block is not None and block[1] <= passed:
            out.append(told(key[0], "unblock", *block))
            block = None
        if block is None:
            self.block.clear()
            return out, None
        self.block.update(block)
        return out, block[1]


def block_actions(events: DataFrame, duration: int = BLOCK_SECONDS, lateness: int = 60) -> DataFrame:
    """Blocks and unblocks of a stream of (ip, ts, reason): ip, action, blocked_at, expires_at, reason.

    An event blocks unless a block of its address began less than ``duration`` seconds before; an unblock comes once the
    watermark has passed the end of a block. Rows without an address or a time are ignored.
    """
    held = _in_order(_timed(events, lateness), "ip", F.col("ip").isNotNull(), {"reason": F.col("reason")})
    out = held.transformWithState(Cooldown(duration), Cooldown.OUTPUT, "append", "eventTime")
    return out.select("ip", "action", F.timestamp_micros("began").alias("blocked_at"), F.timestamp_micros("ends").alias("expires_at"), "reason")


def block_stream(
    events: DataFrame, out: str, checkpoint: str, duration: int = BLOCK_SECONDS, lateness: int = 60, interval: str | None = None,
) -> StreamingQuery:
    return _started(block_actions(events, duration, lateness), out, f"{checkpoint}/actions", interval)


# --- rules that look back in time -----------------------------------------------------------------

BUCKETS = 1024
HELD = pa.schema({"src_ip": pa.string(), "t": pa.int64(), "det_seq": pa.string(), "marks": pa.int64(), "fields": pa.string()})
SEEN = pa.schema({"src_ip": pa.string(), "k": pa.int64(), "t": pa.int64()})
TOLD = pa.schema({"rule_id": pa.int64(), "fields": pa.string()})
TOLD_ROWS = 10_000  # hits handed on at a time


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(packed: list[bytes], schema: pa.Schema) -> pa.Table:
    return pa.concat_tables([schema.empty_table(), *(pa.ipc.open_stream(p).read_all() for p in packed)])


class History(StatefulProcessor):
    """For a bucket of sources, the rows that wait for the watermark and, per source, the last match times of each stateful
    rule, as many as the rule asks for and no older than its timeframe. Both are held as packed columns, so a bucket costs a
    few calls to the state a batch, however many sources and rows it has.

    ``marks`` of a row: bit 2k, it matches what rule k looks back for; bit 2k + 1, rule k may fire on it.
    """

    OUTPUT = "rule_id long, fields string"

    def __init__(self, rules: tuple[ruleset.Rule, ...]) -> None:
        self.rules = [(r.id, (r.frequency or 2) - 1, r.timeframe * 1_000_000) for r in rules]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.matches = handle.getValueState("matches", "rows binary")
        self.timer = handle.getValueState("timer", "at long")

    def _wake(self, micros: int) -> None:
        at = -(-micros // 1000)
        current = self.timer.get()[0] if self.timer.exists() else None
        if current is None or at < current:
            if current is not None:
                self.handle.deleteTimer(current)
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fresh = pa.concat_tables([pa.Table.from_pandas(part[HELD.names], HELD, preserve_index=False) for part in rows])
        if fresh.num_rows:
            self.waiting.appendValue((_packed(fresh),))
            self._wake(pc.min(fresh["t"]).as_py())
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = _unpacked([v[0] for v in self.waiting.get()], HELD)
        seen = _unpacked([self.matches.get()[0]] if self.matches.exists() else [], SEEN)
        self.waiting.clear()
        self.timer.clear()
        due = pc.less_equal(held["t"], passed)
        later = held.filter(pc.invert(due))
        out, kept = self.walk(held.filter(due) if later.num_rows else held, seen, passed)
        if later.num_rows:
            self.waiting.appendValue((_packed(later),))
            self._wake(pc.min(later["t"]).as_py())
        if kept.num_rows:
            self.matches.update((_packed(kept),))
            frames = np.array([timeframe for _, _, timeframe in self.rules])
            self._wake(max(int((kept["t"].to_numpy() + frames[kept["k"].to_numpy()]).max()) + 1, passed + 1))
        else:
            self.matches.clear()
        for low in range(0, len(out), TOLD_ROWS):
            yield out.iloc[low:low + TOLD_ROWS]

    def walk(self, rows: pa.Table, seen: pa.Table, passed: int) -> tuple[pd.DataFrame, pa.Table]:
        """Hits of the rows and the match times that remain. Each source's earlier matches come before its rows."""
        before = pa.table({"src_ip": seen["src_ip"], "t": seen["t"], "det_seq": pa.nulls(len(seen), pa.string()),
                           "marks": pc.shift_left(pa.scalar(1, pa.int64()), pc.multiply(seen["k"], 2)),
                           "fields": pa.nulls(len(seen), pa.string()), "new": pa.repeat(False, len(seen))})
        both = pa.concat_tables([before, rows.append_column("new", pa.repeat(True, len(rows)))])
        order = pc.sort_indices(both, [(c, "ascending") for c in ("src_ip", "new", "t", "det_seq", "marks", "fields")])
        fields = both["fields"]  # the widest by far: only those of hits are put in order
        both = both.select(["src_ip", "t", "marks"]).take(order).combine_chunks()
        source = _codes(both["src_ip"])
        t, marks = both["t"].to_numpy(), both["marks"].to_numpy()
        told, kept = [TOLD.empty_table()], []
        for k, (rule_id, back, timeframe) in enumerate(self.rules):
            match = marks >> (2 * k) & 1
            at = np.flatnonzero(match)
            if not len(at):
                continue
            nth = np.cumsum(match) - match - back  # the match that many before a row, as a place in ``at``
            earlier = at[np.maximum(nth, 0)]
            hit = (marks >> (2 * k + 1) & 1 == 1) & (nth >= 0) & (source[earlier] == source) & (t[earlier] >= t - timeframe)
            told.append(pa.table({"rule_id": pa.repeat(pa.scalar(rule_id, pa.int64()), int(hit.sum())),
                                  "fields": fields.take(order.filter(pa.array(hit)))}))
            last = np.ones(len(at), bool)
            last[:-back] = source[at[:-back]] != source[at[back:]]
            stay = at[last & (t[at] >= passed - timeframe)]
            kept.append(pa.table({"src_ip": both["src_ip"].take(pa.array(stay)), "k": pa.repeat(k, len(stay)),
                                  "t": t[stay]}).cast(SEEN))
        return pa.concat_tables(told).to_pandas(), pa.concat_tables([SEEN.empty_table(), *kept])

    def close(self) -> None:
        pass


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    """A number per value, null included."""
    return column.combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()


_FIELDS = ("det_seq string, src_ip string, dst_ip string, dst_port int, attack_type string, confidence double, layer string, "
           "threat_level int, anomaly_score double, ts timestamp")


def rule_hits(
    detections: DataFrame, rules: tuple[ruleset.Rule, ...] = ruleset.RULES, lateness: int = 60, buckets: int = BUCKETS,
) -> DataFrame:
    """All hits of a detection stream. Rules that look at one event report at once, the others when the watermark has passed
    the event. Events without a time take part in the former only.

    The state is kept per bucket of sources; ``buckets`` is fixed for a checkpoint. A batch touches the buckets of its sources.
    """
    stateful = tuple(r for r in rules if r.matched is not None)
    flagged = ruleset.with_static_flags(_timed(detections, lateness), rules)
    at_once = ruleset.hits(flagged, tuple(r for r in rules if r.matched is None))
    flag = lambda rule_id: F.col(f"_r{rule_id}")
    marks = F.lit(0).cast("long")
    for k, r in enumerate(stateful):
        fires = flag(r.matched) if r.frequency else ruleset.any_of([flag(p) for p in r.parents])
        marks = marks + flag(r.matched).cast("long") * (1 << 2 * k) + fires.cast("long") * (1 << 2 * k + 1)
    names = [f.strip().split(" ")[0] for f in _FIELDS.split(",")]
    micros = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
    bucketed = flagged.withColumns({"marks": marks, "bucket": F.pmod(F.xxhash64("src_ip"), F.lit(buckets)).cast("int")})
    held = _in_order(bucketed, "bucket", F.col("marks") != 0, {
        "src_ip": F.col("src_ip"), "det_seq": F.col("det_seq"), "marks": F.col("marks"),
        "fields": F.to_json(F.struct(*names), micros)})
    fired = held.transformWithStateInPandas(History(stateful), History.OUTPUT, "append", "eventTime")
    told = fired.select("rule_id", F.from_json("fields", _FIELDS, micros).alias("e")).select("rule_id", "e.*")
    late = ruleset.hits(told.withColumns({f"_r{r.id}": F.col("rule_id") == r.id for r in stateful}), stateful)
    return at_once.unionByName(late)


def rule_stream(
    detections: DataFrame, out: str, checkpoint: str, rules: tuple[ruleset.Rule, ...] = ruleset.RULES, lateness: int = 60,
    interval: str | None = None, buckets: int = BUCKETS,
) -> StreamingQuery:
    return _started(rule_hits(detections, rules, lateness, buckets), out, f"{checkpoint}/hits", interval)
