"""Per-document text statistics as built-in column expressions, without Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netvigil.llm.common import words_of, whole_text

SYMBOLS = r"[#*$%&|<>]"
REPEAT_WINDOW = 5


def count_of(text: Column, pattern: str) -> Column:
    """Characters matching a one-character pattern."""
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return F.aggregate(F.array(F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))), F.lit(0).cast("long"),
                       lambda acc, x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def repeated_words(words: Column, window: int = REPEAT_WINDOW) -> Column:
    """Words covered by windows of ``window`` words that stand twice or more in the text, the first one included.

    Windows are compared by a 64-bit hash within one text. Only texts with a repeat sort their windows; equal
    neighbours are then repeats, and their start positions, in order, give the words covered.
    """
    last = F.size(words) - window
    hashes = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(window)]))

    def covered(hashes: Column) -> Column:
        ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        starts = F.transform(F.array(ordered), lambda s: F.array_sort(F.transform(F.filter(
            s, lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False))
            | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))), lambda x: x["i"])))[0]
        zero = F.struct(F.lit(-window).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(starts, zero, lambda acc, i: F.struct(
            i.alias("last"), (acc["n"] + F.least(F.lit(window), i - acc["last"])).alias("n")), lambda acc: acc["n"])

    found = F.transform(F.array(hashes), lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(0))[0]
    return F.when(last >= 1, found).otherwise(0).cast("long")


def base_stats(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, ``keep`` and n_words, n_chars, n_lines, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper."""
    text = F.col("text")
    split = docs.select(F.col("doc_id").cast("long"), *keep, whole_text().alias("text")).withColumn("words", words_of(text))
    return split.select(
        "doc_id", *keep, F.size("words").cast("long").alias("n_words"), F.length("text").cast("long").alias("n_chars"),
        (count_of(text, "\n") + 1).alias("n_lines"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        count_of(text, SYMBOLS).alias("n_symbols"), duplicate_lines(text).alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"), count_of(text, r"\p{Lu}").alias("n_upper"))


# Statistics that the quality classifier's rules may test.
SHAPE = ("word_length", "symbol_share", "upper_share", "digit_share", "mark_share", "exclaim_share", "distinct_share",
         "line_words", "duplicate_line_share", "log_words")


def shape_stats(docs: DataFrame) -> DataFrame:
    """doc_id and the SHAPE columns; a text without words has zero everywhere."""
    text = F.col("text")
    split = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).withColumn("words", words_of(text))
    n, chars = F.col("n"), F.greatest(F.col("chars"), F.lit(1))
    counted = split.select(
        "doc_id", F.size("words").alias("n"), F.length("text").alias("chars"), F.length(F.array_join("words", "")).alias("solid"),
        F.size(F.array_distinct("words")).alias("distinct"), duplicate_lines(text).alias("dup"),
        (count_of(text, "\n") + 1).alias("lines"),
        *[count_of(text, p).alias(a) for a, p in (("symbol", SYMBOLS), ("upper", r"\p{Lu}"), ("digit", r"\p{Nd}"),
                                                  ("mark", r"[.,;:?]"), ("exclaim", "!"))])
    some = F.greatest(n, F.lit(1))
    return counted.select(
        "doc_id", (F.col("solid") / some).alias("word_length"),
        *[(F.col(c) / chars).alias(f"{c}_share") for c in ("symbol", "upper", "digit", "mark", "exclaim")],
        (F.col("distinct") / some).alias("distinct_share"),
        (n / F.col("lines")).alias("line_words"), (F.col("dup") / F.col("lines")).alias("duplicate_line_share"),
        F.log1p(n.cast("double")).alias("log_words"))
