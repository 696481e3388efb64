"""Near-duplicate groups by 64-bit similarity fingerprints and one-wildcard segment variants.

Four differing bits over three segments leave one segment with at most one of them. Such a segment is equal
in both fingerprints once the differing bit is masked, so every fingerprint is indexed under its 64 segment
variants (one per masked bit) and an equality join on (segment variant) finds all candidates. Each pair is
verified and emitted by one variant only, the first that can see it, inside the join condition.

Null or blank text has fingerprint zero and links like any other. Equal texts, repeated rows and null ids share
their fingerprint's component; the component id is the smallest id that is not null (null if all are). Extra
columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netvigil.llm.common import map_batches, row_name, whole_text
from netvigil.llm.components import components
from netvigil.session import materialize

MAX_BITS = 4
SHINGLE = 4
SEED = 42
# Bit ranges of the three segments.
SEGMENTS = ((0, 22), (22, 43), (43, 64))


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Majority bits of the hashes of all word shingles, repeats included; zero without words."""
    words = text.lower().split()  # bytes: only A-Z are lowered, only ASCII blanks split
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), seed)]
    else:
        line = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = (ends - [len(w) + 1 for w in words]).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[s:e], seed) for s, e in zip(starts, (ends[shingle - 1:] - 1).tolist(), strict=False)]
    rows = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(rows), 1 << 15):
        ones += np.unpackbits(rows[at:at + (1 << 15)], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(rows), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, its row's name and its fingerprint as a signed long."""
    source = docs.select(F.col("doc_id").cast("long"), row_name().alias("row_name"), whole_text().cast("binary").alias("text"))
    return map_batches(source, "doc_id long, row_name long, fp long", lambda b: {
        "doc_id": b["doc_id"], "row_name": b["row_name"], "fp": [fingerprint(t) for t in b["text"]]})


def _variants(fp: Column) -> Column:
    """Structs (slot, key): the fingerprint's segment bits with the slot's bit masked."""
    out = []
    for low, high in SEGMENTS:
        mask = ((1 << high) - 1) & ~((1 << low) - 1)
        for bit in range(low, high):
            part = mask & ~(1 << bit)
            out.append(F.struct(F.lit(bit).alias("slot"), fp.bitwiseAND(F.lit(_signed(part))).alias("key")))
    return F.array(*out)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def _first_slot(diff: Column) -> Column:
    """The one slot that reports a pair: of its first segment with at most one differing bit, that bit, or else the first."""
    out = F.lit(-1)
    for low, high in reversed(SEGMENTS):
        part = diff.bitwiseAND(F.lit(_signed(((1 << high) - 1) & ~((1 << low) - 1))))
        # the number of bits below the differing one is its position; bit 63 is the sign
        position = F.when(part == 0, F.lit(low)).when(part < 0, F.lit(63)).otherwise(F.bit_count(part - F.lit(1)))
        out = F.when(F.bit_count(part) <= 1, position).otherwise(out)
    return out


def links(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """All pairs of distinct fingerprints (column fp) that differ in at most ``max_bits`` (4 at most) bits.

    The join is a sort-merge whatever the sizes: the planner takes the 64 variants of a fingerprint for one row, and would
    send the whole index through the driver while the fingerprints alone are below its broadcast limit.
    """
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError("three segments cover at most four differing bits")
    index = prints.select("fp", F.explode(_variants(F.col("fp"))).alias("x")).select("fp", "x.slot", "x.key")
    a, b = index.alias("a"), index.alias("b")
    diff = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    pair = a.join(b.hint("merge"), (F.col("a.slot") == F.col("b.slot")) & (F.col("a.key") == F.col("b.key"))
                  & (F.col("a.fp") < F.col("b.fp")) & (F.bit_count(diff) <= max_bits)
                  & (_first_slot(diff) == F.col("a.slot")))
    return pair.select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))


def _classes(marked: DataFrame, max_bits: int) -> DataFrame:
    """fp, first_id and root of every distinct fingerprint: the root names its component."""
    prints = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "prints")
    roots = components(links(prints, max_bits))
    return prints.join(roots.select(F.col("node").alias("fp"), "root").hint("merge"), "fp", "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root"))


def groups(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row."""
    marked = materialize(fingerprints(docs), "prints")
    named = _classes(marked, max_bits)
    ids = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    class_of = materialize(named.join(ids, "root").select("fp", "component_id"), "classes")
    return marked.join(class_of.hint("merge"), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of each group with all columns of ``docs``: that of the smallest id (null last), then of the least hash of id and text.

    Different texts under one id are judged apart; of rows equal in id and text one stays at most.
    """
    marked = materialize(fingerprints(docs), "prints")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row_name")
    heads = marked.groupBy("fp").agg(F.min(order).alias("head"))
    least = heads.join(_classes(marked, max_bits).select("fp", "root"), "fp").groupBy("root").agg(F.min("head").alias("head"))
    chosen = materialize(least.select(F.col("head.row_name").alias("_row")), "heads")
    return docs.withColumn("_row", row_name()).join(chosen, "_row", "left_semi").dropDuplicates(["_row"]).drop("_row")
