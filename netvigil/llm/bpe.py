"""Subword ids of whole texts by a table of distinct words, and decoding by a table of pieces.

Texts are split at ASCII blanks. That is safe for a tokenizer that drops white space and never joins characters
across it: the ids of a text are the ids of its words in a row. A word count over the corpus gives the table of the
``TABLE_WORDS`` most frequent words; each is encoded once, and the table, bounded by that number and by
``LONGEST_WORD``, is sent to all tasks, where words take their ids by position. Words outside the table, mostly seen
once in the whole corpus, are gathered into a table of the distinct ones of each batch, encoded once there, and
joined back the same way: shuffling a hundred million rare words and all texts to meet them costs more than encoding
them where they stand.

Decoding joins ids with the table of pieces (one row per vocabulary entry), in order.

A null or empty text has no ids. Repeated rows and null ids are encoded one by one. Other columns are ignored. Strings
of special tokens inside a text become those tokens, as the library does by default.
"""

from __future__ import annotations

import hashlib
import os
from collections import Counter
from collections.abc import Iterator
from itertools import chain
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netvigil.llm.common import parts, whole_text

TABLE_WORDS = 1 << 17
LONGEST_WORD = 64
FLUSH = 200_000

_loaded: dict[int, object] = {}


def read_definition(path: str) -> str:
    """The tokenizer file's text. It is read by the driver and sent along, so tasks need no path."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def _tokenizer(definition: str):
    """One tokenizer per worker process; loading takes longer than a batch."""
    key = hash(definition)
    if key not in _loaded:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        made = Tokenizer.from_str(definition)
        made.no_truncation()
        made.no_padding()
        _loaded[key] = made
    return _loaded[key]


def encode_words(definition: str, words: list[bytes]) -> list[list[int]]:
    """Ids of each word."""
    made = _tokenizer(definition)
    return [e.ids for e in made.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]


def word_counts(docs: DataFrame) -> DataFrame:
    """word (binary) and n: how often each distinct word stands in the corpus."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for part in parts(batch):
                for text in part.column(0).to_pylist():
                    held.update(text.split())
                    if len(held) > FLUSH:
                        yield flush()
        if held:
            yield flush()

    return docs.select(whole_text().cast("binary").alias("text")).mapInArrow(run, "word binary, n long").groupBy("word").agg(
        F.sum("n").alias("n"))


def word_table(docs: DataFrame, definition: str, size: int = TABLE_WORDS) -> DataFrame:
    """word and ids of the most frequent words."""
    top = word_counts(docs).where(F.octet_length("word") <= LONGEST_WORD).orderBy(F.desc("n"), "word").limit(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = encode_words(definition, batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["word", "ids"])

    return top.select("word").repartition(docs.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, "word binary, ids array<int>")


def _encoded(docs: DataFrame, definition: str, size: int, schema: str, last) -> DataFrame:
    """Encode every row; ``last`` turns a row's ids into the output columns behind doc_id."""
    table = {bytes(r["word"]): list(r["ids"]) for r in word_table(docs, definition, size).toLocalIterator()}  # at most ``size`` rows
    sent = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in parts(batch, 500)):
            words = [text.split() for text in part.column(1).to_pylist()]
            distinct = set(chain.from_iterable(words))
            known = {w: sent.value[w] for w in distinct if w in sent.value}
            rare = list(distinct.difference(known))
            get = {**known, **dict(zip(rare, encode_words(definition, rare), strict=True))}.__getitem__
            yield _batch(part.column(0), [last(list(chain.from_iterable(map(get, row)))) for row in words], schema)

    return docs.select(F.col("doc_id").cast("long"), whole_text().cast("binary").alias("text")).mapInArrow(run, schema)


def _batch(ids: pa.Array, rows: list[tuple], schema: str) -> pa.RecordBatch:
    columns = [pa.array(c, pa.list_(pa.int32())) if isinstance(c[0], list) else pa.array(c) for c in zip(*rows, strict=True)]
    return pa.RecordBatch.from_arrays([ids, *columns], [p.strip().split(" ")[0] for p in schema.split(",")])


def encode(docs: DataFrame, definition: str, size: int = TABLE_WORDS) -> DataFrame:
    """doc_id and ids of every row."""
    return _encoded(docs, definition, size, "doc_id long, ids array<int>", lambda ids: (ids,))


def piece_table(definition: str) -> list[str]:
    """Piece by id, special tokens included."""
    made = _tokenizer(definition)
    return [made.id_to_token(i) or "" for i in range(made.get_vocab_size(with_added_tokens=True))]


def decode_ids(pieces: list[str], ids: list[int]) -> str:
    """The text of some ids: their pieces, separated by blanks, as the library does for a file without a decoder."""
    return " ".join(map(pieces.__getitem__, ids))


def decode(encoded: DataFrame, definition: str) -> DataFrame:
    """doc_id and text of every row of (doc_id, ids)."""
    pieces, schema = encoded.sparkSession.sparkContext.broadcast(piece_table(definition)), "doc_id long, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in parts(batch)):
            yield _batch(part.column(0), [(decode_ids(pieces.value, ids),) for ids in part.column(1).to_pylist()], schema)

    return encoded.select("doc_id", "ids").mapInArrow(run, schema)


def _digest(table: list[bytes], ids: list[int]) -> str:
    """SHA-256 of the table's entries by id, separated by blanks."""
    found = itemgetter(*ids)(table) if len(ids) > 1 else [table[i] for i in ids]
    return hashlib.sha256(b" ".join(found)).hexdigest()


def encode_digests(docs: DataFrame, definition: str, size: int = TABLE_WORDS, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of the ids (decimal, separated by blanks) and of the text they decode to; ids on demand.

    Both directions run in one pass, so the ids of a text need not leave their task. Ids as text and pieces as bytes are
    taken from tables by id, a row's at once.
    """
    pieces = [p.encode() for p in piece_table(definition)]
    sent = docs.sparkSession.sparkContext.broadcast(([b"%d" % i for i in range(len(pieces))], pieces))

    def last(ids: list[int]) -> tuple:
        told = len(ids), *(_digest(table, ids) for table in sent.value)
        return (*told, ids) if with_ids else told

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _encoded(docs, definition, size, schema + ", ids array<int>" if with_ids else schema, last)
