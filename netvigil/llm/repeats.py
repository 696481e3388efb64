"""Exact removal of long repeats by prefix-free parsing of the corpus.

A byte is removed when a string of ``length`` bytes that covers it also starts anywhere else. Trigger: the place
whose rolling hash over ``WINDOW`` bytes is least among all places inside a string (the last of equals). Triggers
depend on content alone, so equal strings hold their trigger at the same offset, and consecutive start places with one
trigger form a phrase: its core are the ``WINDOW`` bytes at the trigger, its hull all bytes of its strings. The
dictionary holds the distinct hulls under their cores; the parse is each document's sequence of phrases.

Suffix order matters here only through its first ``length`` bytes, and only for equality: two places are neighbours
with a common prefix of that length or they are not. So ranks are names (hashes) instead of sorted positions, refined
level by level like prefix doubling does, and only where the coarser name leaves the question open:

1. a core seen once: none of the phrase's strings is repeated; equal hulls: all of them are;
2. cores with different hulls: the hulls are cut into blocks of ``BLOCK`` start places and named in the same way;
3. blocks that still differ inside: every start place is named by its string.

Each level groups by name with map-side combine, so copies, however many, collapse to one row a task, and joins the
few repeated names back; no group of equal or similar texts ever meets in one task. Names are pairs of independent
64-bit hashes. Texts travel twice: to the phrases in question, and to the final cut.

A null text is empty. Repeated rows and rows that share an id are documents of their own; a null id is an id like any
other. Texts shorter than ``length`` keep all bytes. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netvigil.llm.common import parts, whole_text
from netvigil.session import materialize

LENGTH = 400
WINDOW = 64
BLOCK = 16
# Multiplier of the rolling hash: any odd number, here the golden ratio's bits.
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_BYTE = np.array([xxhash.xxh64_intdigest(bytes([b]), 1) for b in range(256)], np.uint64)
_LOW = np.uint64(0xFFFFFFFF)
_ID = ["doc_key", "text_key"]


def rolling(data: np.ndarray, window: int) -> np.ndarray:
    """Polynomial hash of every ``window`` bytes (a power of two), by doubling."""
    out, factor, width = _BYTE[data], _FACTOR, 1
    while width < window:
        out = out[:-width] * factor + out[width:]
        with np.errstate(over="ignore"):
            factor = factor * factor
        width *= 2
    return out


def triggers(data: np.ndarray, length: int, window: int) -> np.ndarray:
    """For each start place of a string of ``length`` bytes, the place of its trigger."""
    h = rolling(data, window)
    key = (h & ~_LOW) | (_LOW - np.arange(len(h), dtype=np.uint64))  # on equal hashes the last place is least
    reach, width = length - window + 1, 1
    while 2 * width <= reach:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    if reach > width:
        key = np.minimum(key[:width - reach], key[reach - width:])
    return (_LOW - (key & _LOW)).astype(np.int64)


def _name(data: bytes, seed: int) -> int:
    value = xxhash.xxh3_64_intdigest(data, seed)
    return value - (1 << 64) if value >> 63 else value


def phrases(text: bytes, length: int, window: int) -> list[tuple[int, int, int, int, int]]:
    """(core name, hull name, first and last start place, trigger) of each phrase."""
    if len(text) < length:
        return []
    at = triggers(np.frombuffer(text, np.uint8), length, window)
    cuts = np.flatnonzero(np.diff(at)) + 1
    low, high = np.concatenate([[0], cuts]).tolist(), np.concatenate([cuts - 1, [len(at) - 1]]).tolist()
    return [(_name(text[t:t + window], 1), _name(text[a:b + length], 2), a, b, t)
            for a, b, t in zip(low, high, at[low].tolist(), strict=True)]


def _spread(df: DataFrame, schema: str, fn) -> DataFrame:
    """Flat map over rows: ``fn`` gives output tuples for one row's values."""
    names = [p.strip().split(" ")[0] for p in schema.split(",")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    types = [kinds[p.strip().split(" ")[1]] for p in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in parts(b)):
            columns = [c.to_pylist() for c in batch.columns]
            out = []
            for row in zip(*columns, strict=True):
                out.extend(fn(*row))
                if len(out) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return df.mapInArrow(run, schema)


def _identified(docs: DataFrame) -> DataFrame:
    """Rows with a key that tells documents apart; rows equal in id and text share it and are cut alike."""
    text = whole_text().cast("binary")
    return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc_key"),
                       F.xxhash64(text).alias("text_key"), text.alias("text"))


def _named(rows: DataFrame, weight: Column, *names: str) -> DataFrame:
    """``names`` repeated in ``rows``: their total weight, and whether hulls differ under them."""
    return rows.groupBy(*names).agg(F.sum(weight).alias("n"), (F.min("hull") != F.max("hull")).alias("mixed")).where("n > 1")


def starts_repeated(docs: DataFrame, length: int = LENGTH, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """doc_key, text_key, low, high: ranges of start places whose string of ``length`` bytes also starts elsewhere."""
    if not 0 < window < length or window & (window - 1):
        raise ValueError("the trigger window is a power of two below the length")
    parse = materialize(_spread(
        docs.where(F.octet_length("text") >= length).select(*_ID, "text"),
        "doc_key long, text_key long, core long, hull long, low int, high int, trigger int",
        lambda d, k, text: [(d, k, *p) for p in phrases(text, length, window)]), "parse")
    one = F.lit(1)
    # written first, so that both sides of the join are dealt by it and a hot core can be split
    repeated = materialize(_named(parse, one, "core").select("core", "mixed"), "cores")
    seen = materialize(parse.join(repeated, "core"), "repeated")
    span = [*_ID, "low", "high"]
    whole = seen.where(~F.col("mixed")).select(*span)

    # hulls under a core with several: one row stands for each, and says how many there are
    place = F.struct(*span, "trigger")
    entry = materialize(seen.where("mixed").groupBy("core", "hull").agg(F.count(one).alias("weight"), F.min(place).alias("at"))
                        .select("core", "hull", "weight", "at.*"), "dictionary")
    copied = seen.where("mixed").join(entry.where("weight > 1").select("core", "hull"), ["core", "hull"], "left_semi").select(*span)
    asked = entry.groupBy(*_ID).agg(F.collect_list(F.struct("low", "high", "trigger", "weight")).alias("asked"))

    def bodies(d, k, asked, text):
        return [(d, k, a["low"], a["high"], a["trigger"], min(a["weight"], 2), text[a["low"]:a["high"] + length]) for a in asked]

    texts = docs.select(*_ID, "text").join(asked, _ID).select(*_ID, "asked", "text")
    body = materialize(_spread(texts, "doc_key long, text_key long, low int, high int, trigger int, weight int, body binary",
                               bodies).dropDuplicates([*_ID, "low"]), "bodies")

    def blocks(d, k, low, high, trigger, weight, body):
        out = []
        for index in range((trigger - high) // block, (trigger - low) // block + 1):
            a, b = max(low, trigger - index * block - block + 1), min(high, trigger - index * block)
            first, last = trigger - index * block - low, trigger - (index + 1) * block + 1 - low + length
            out.append((d, k, index, _name(body[first:last], 3), _name(b"%d:" % (trigger - a) + body[a - low:b - low + length], 4),
                        a, b, low, weight))
        return out

    cut = materialize(_spread(body.select(*_ID, "low", "high", "trigger", "weight", "body"),
                              "doc_key long, text_key long, index int, core long, hull long, low int, high int, owner int, weight int",
                              blocks), "blocks")
    names = materialize(_named(cut, F.col("weight"), "index", "core"), "names")
    known = cut.join(names.select("index", "core", "mixed"), ["index", "core"])
    alike = known.where(~F.col("mixed") & (F.col("weight") == 1)).select(*span)

    mixed = known.where("mixed").groupBy(*_ID, F.col("owner").alias("low")).agg(
        F.collect_list(F.struct(F.col("low").alias("a"), F.col("high").alias("b"))).alias("blocks"))

    def singles(d, k, low, weight, body, blocks):
        out = []
        for x in blocks:
            for i in range(x["a"], x["b"] + 1):
                string = body[i - low:i - low + length]
                out.append((d, k, i, _name(string, 5), _name(string, 6), weight))
        return out

    single = materialize(_spread(body.join(mixed, [*_ID, "low"]).select(*_ID, "low", "weight", "body", "blocks"),
                                 "doc_key long, text_key long, low int, core long, hull long, weight int", singles), "singles")
    again = single.groupBy("core", "hull").agg(F.sum("weight").alias("n")).where("n > 1").select("core", "hull")
    again = materialize(again, "strings")
    alone = single.where("weight = 1").join(again, ["core", "hull"], "left_semi").select(*_ID, "low", F.col("low").alias("high"))
    return whole.unionByName(copied).unionByName(alike).unionByName(alone)


def cut(text: bytes, ranges: list, length: int) -> tuple[int, int, int, bytes]:
    """Bytes of the text, bytes removed, runs removed, and what is left. ``ranges``: (low, high) start places."""
    removed, runs, kept, end = 0, 0, [], 0
    for low, high in sorted(ranges):
        stop = high + length
        if low > end or not runs:
            kept.append(text[end:low])
            runs += 1
            removed += stop - low
            end = stop
        elif stop > end:
            removed += stop - end
            end = stop
    kept.append(text[end:])
    return len(text), removed, runs, b"".join(kept)


def remove_repeats(docs: DataFrame, length: int = LENGTH, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the remaining bytes) of every row."""
    return _cut_docs(docs, length, window, block, "kept", pa.binary(), lambda kept: kept)


def remove_repeats_digest(docs: DataFrame, length: int = LENGTH, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """As ``remove_repeats``, with the remaining bytes' SHA-256 in place of them."""
    return _cut_docs(docs, length, window, block, "kept_sha256", pa.string(), lambda kept: hashlib.sha256(kept).hexdigest())


def _cut_docs(docs: DataFrame, length: int, window: int, block: int, name: str, kind: pa.DataType, last) -> DataFrame:
    rows = _identified(docs)
    found = materialize(starts_repeated(rows, length, window, block).distinct(), "ranges")
    ranges = found.groupBy(*_ID).agg(F.collect_list(F.struct("low", "high")).alias("ranges"))
    schema = f"doc_id long, n_bytes long, n_removed long, n_spans long, {name} {'binary' if pa.types.is_binary(kind) else 'string'}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in parts(b)):
            ids, texts, ranges = (c.to_pylist() for c in batch.columns)
            got = [cut(t, [(r["low"], r["high"]) for r in rs or ()], length) for t, rs in zip(texts, ranges, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64())] + [pa.array([g[i] for g in got], pa.int64()) for i in range(3)]
                + [pa.array([last(g[3]) for g in got], kind)], names=["doc_id", "n_bytes", "n_removed", "n_spans", name])

    return rows.join(ranges, _ID, "left").select("doc_id", "text", "ranges").mapInArrow(run, schema)
