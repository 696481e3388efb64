"""The state of stateful rules is a few packed rows per bucket of sources, whatever the sources and rows."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from netvigil.operators import rules
from netvigil.plans.streams import Feed, closing_mark
from netvigil.streaming import keyed
from netvigil.streaming.batches import state_rows
from test_keyed_streams import DET, at, detection, run

STATEFUL = tuple(r for r in rules.RULES if r.matched)


def plain_walk(rows):
    """Hits (rule, fields) of rows (source, t, det_seq, marks, fields), one by one."""
    seen, out = {}, []
    for source, t, _, marks, fields in rows:
        for k, r in enumerate(STATEFUL):
            back, times = (r.frequency or 2) - 1, seen.setdefault((source, k), [])
            if marks >> (2 * k + 1) & 1 and len(times) >= back and times[-back] >= t - r.timeframe * 1_000_000:
                out.append((r.id, fields))
            if marks >> (2 * k) & 1:
                times.append(t)
    return sorted(out)


def test_walk_in_pieces_equals_the_plain_walk():
    draw = random.Random(5)
    rows = sorted(((draw.choice(["a", "b", None]), draw.randrange(900) * 1_000_000, f"{i:04d}", draw.randrange(1, 256), f"f{i}")
                   for i in range(600)), key=lambda r: (r[1], r[2]))
    history, seen, got = keyed.History(STATEFUL), keyed.SEEN.empty_table(), []
    for low in range(0, 900, 100):
        part = [r for r in rows if low * 1_000_000 <= r[1] < (low + 100) * 1_000_000]
        table = pa.table(dict(zip(keyed.HELD.names, zip(*part, strict=True), strict=True)), schema=keyed.HELD)
        out, seen = history.walk(table, seen, (low + 100) * 1_000_000 - 1)
        got += out.itertuples(index=False, name=None)
    assert got and sorted(got) == plain_walk(rows)
    assert seen.num_rows <= 3 * sum(max(1, (r.frequency or 2) - 1) for r in STATEFUL)


def test_state_follows_buckets_and_events_without_a_number_are_walked(spark):
    rows = [detection(i, i % 50, f"10.0.{i % 150}.1", "DOS", 4, 0) for i in range(600)]
    nameless = [detection(i, 7, "10.1.0.1", "DOS", 4, 0) for i in range(6)]
    det = spark.createDataFrame(rows + nameless, DET)
    det = det.withColumn("det_seq", F.when(F.col("src_ip") != "10.1.0.1", F.col("det_seq")))
    root, queries = run(spark, {"d": Feed(closing_mark(det, at(50), 9000))}, lambda root, s: keyed.rule_stream(
        s["d"], f"{root}/out", f"{root}/c", lateness=600, buckets=4))
    assert 0 < state_rows(queries[0]) <= 4 * 5
    got = spark.read.parquet(f"{root}/out").where("src_ip = '10.1.0.1' and rule_id = 100140")
    assert got.count() == 2


def test_waiting_rows_are_held_compressed():
    rows = [("10.0.0.1", i, f"{i:06d}", 3, f'{{"attack_type":"DOS","layer":"vae","threat_level":{i % 5}}}') for i in range(5000)]
    table = pa.table(dict(zip(keyed.HELD.names, zip(*rows, strict=True), strict=True)), schema=keyed.HELD)
    packed = keyed._packed(table)
    assert len(packed) < table.nbytes / 2 and keyed._unpacked([packed], keyed.HELD).equals(table)
