"""Lines that stand in many documents are taken out of all of them.

A text is split at line feeds; a line's key is the line without the blanks at both its ends, A-Z lowered. Keys are
hashed, each document counts once per key (its keys are made distinct before they leave the row, so the count is a
plain sum with map-side combine), keys found in ``min_docs`` documents or more lose all their lines, and the lines that
stay are put together again by position.

A key found in very many documents would put all its lines into one task of the join back. Such keys are few by
arithmetic and are broadcast; each of the others holds too small a share of the rows to be hot (``join_counted``).

A null text is one empty line, as is an empty one. Keys of fewer than ``min_chars`` code points are never dropped: empty
and blank lines stay. Repeated rows, and rows that share an id, are documents of their own, also for the count; a null
id is an id like any other. A text that loses all lines is empty. Extra columns are ignored, an empty table gives an
empty result. Keys are told apart by two 64-bit hashes.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netvigil.llm.common import join_counted, row_key, whole_text
from netvigil.session import materialize

MIN_DOCS = 10
MIN_CHARS = 1
# Blank and the control characters 9 to 13.
STRIPPED = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """Trimming at the right end and lowering by a table cost a pass over all characters each; most lines need neither."""
    cut = F.ltrim(F.when(F.substring(line, -1, 1).isin(*STRIPPED), F.rtrim(line, F.lit(STRIPPED))).otherwise(line), F.lit(STRIPPED))
    plain = F.octet_length(line) == F.length(line)
    return F.when(plain, F.lower(cut)).otherwise(F.translate(cut, string.ascii_uppercase, string.ascii_lowercase))


def _hashed(key: Column, min_chars: int) -> Column:
    """Two hashes of the key, null where the key is too short."""
    return F.when(F.length(key) >= min_chars, F.struct(F.xxhash64(key).alias("h"), F.xxhash64(F.lit(1), key).alias("g")))


def hashed_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """id_key, text_key and ``keys``, the hashes of each line's key by position, of every row of ``docs``."""
    lines = F.split(whole_text(), "\n", -1)
    return docs.select(*row_key(), F.transform(lines, lambda x: _hashed(line_key(x), min_chars)).alias("keys"))


def common_keys(hashed: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """h, g, n: the keys found in ``min_docs`` rows or more, and in how many."""
    once = hashed.select(F.explode(F.array_distinct("keys")).alias("key")).where(F.col("key").isNotNull())
    return once.groupBy(F.col("key.h").alias("h"), F.col("key.g").alias("g")).agg(F.count(F.lit(1)).alias("n")).where(
        F.col("n") >= min_docs)


def drop_common_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, kept (the text without its common lines), n_lines, n_dropped of every row."""
    rows = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))
    hashed = materialize(hashed_lines(rows, min_chars), "hashed")
    common = materialize(common_keys(hashed, min_docs), "common")
    marked = hashed.select("id_key", "text_key", F.posexplode("keys").alias("at", "key")).where(F.col("key").isNotNull()).select(
        "id_key", "text_key", "at", "key.*")
    gone = join_counted(marked, common, ["h", "g"]).groupBy("id_key", "text_key").agg(F.collect_set("at").alias("gone"))
    keyed = rows.select("doc_id", "text", *row_key())
    lines = F.split("text", "\n", -1)
    n = F.size(lines)
    stay = F.array_except(F.sequence(F.lit(0), n - 1), F.col("gone"))
    put = F.transform(F.array(lines), lambda x: F.array_join(F.transform(stay, lambda i: F.get(x, i)), "\n"))[0]
    found = F.col("gone").isNotNull()
    return keyed.join(gone, ["id_key", "text_key"], "left").select(
        "doc_id", F.when(found, put).otherwise(F.col("text")).alias("kept"), n.cast("long").alias("n_lines"),
        F.when(found, F.size("gone")).otherwise(0).cast("long").alias("n_dropped"))
