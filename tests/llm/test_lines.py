"""Common lines: against brute force, with hot lines and odd rows."""

import re
from collections import Counter

import pytest

from netvigil.llm import common, linededup

DOCS = "doc_id long, text string, n_lines string, keys string, h int"


def brute(texts, min_docs, min_chars=1):
    def key(line):
        return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))

    counts = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")})
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < min_chars or counts[key(x)] < min_docs]
        out.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


@pytest.mark.parametrize("hot_keys", [10_000, 3])
def test_common_lines_are_brute_force(spark, monkeypatch, hot_keys):
    """With few or many keys broadcast as hot, the rest joined by a shuffle."""
    monkeypatch.setattr(common, "HOT_KEYS", hot_keys)
    texts = [None, "", "\n\n", "head\n\n A b \nfoot", "Head\na B\t\n\nbody", "HEAD\x0b\nÄ é\nfoot", "head\nä é\n head", "head " * 9,
             "\r\nfoot \x0c\n x", "only\nhead\nhead"] + ["head\nboiler plate\nfoot"] * 3 + ["x\n" * 5000 + "head"]
    rows = [(i % 9 or None, t, "clash", "clash", 1) for i, t in enumerate(texts)]
    got = [(r["doc_id"], r["kept"], r["n_lines"], r["n_dropped"])
           for r in linededup.drop_common_lines(spark.createDataFrame(rows, DOCS).repartition(3), 3).collect()]
    want = [(r[0], *w) for r, w in zip(rows, brute(texts, 3), strict=True)]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert any(w[3] for w in want)


def test_short_keys_and_equal_rows(spark):
    """Equal rows are documents of their own; keys under the least length stay."""
    rows = spark.createDataFrame([(1, "a\nlong", "c", "c", 1)] * 4 + [(1, "a\nother", "c", "c", 1)], DOCS)
    got = sorted((r["kept"], r["n_dropped"]) for r in linededup.drop_common_lines(rows, 4, 2).collect())
    assert got == [("a", 1)] * 4 + [("a\nother", 0)]
    assert linededup.drop_common_lines(rows.limit(0)).count() == 0
