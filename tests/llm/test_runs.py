"""Periodic runs: the difference-cover extension and the runs against brute force, the query on whole small tables."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from netvigil.llm import runs
from netvigil.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, n_runs string, words string"


def brute_runs(words):
    """Stretches of agreeing places of every period; of equal ends the least period stays."""
    found, n = {}, len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i > start and i - start + q >= max(6, 4 * q):
                found.setdefault((start, i - start + q), q)
            i += i == start
    return sorted(((s, size, q) for (s, size), q in found.items()), key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    words = text.encode().split()
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute_runs(words)
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
    gone = {i for s, size, q in found for i in range(s + q, s + size)}
    sha = [hashlib.sha256(x).hexdigest() for x in ("".join(f"{s},{size},{q}\n" for s, size, q in found).encode(),
                                                   b" ".join(w for i, w in enumerate(words) if i not in gone))]
    return (doc_id, len(found), *best, best[0] if best[0] is None else 1000 * best[1] // best[2], *sha)


def test_cover_has_every_difference():
    assert {(a - b) % runs.V for a in runs.COVER for b in runs.COVER} == set(range(runs.V))
    assert runs.SHIFT.max() < runs.V


@pytest.mark.parametrize("letters,size", [(1, 90), (2, 31), (2, 700), (3, 62), (5, 2000)])
def test_extension_is_brute_force(letters, size):
    words = np.random.default_rng(size).integers(1, letters + 1, size).astype(np.uint32)
    words[size // 2:size // 2 + size // 3] = words[:size // 3]
    i, j = np.triu_indices(size + 1, 1) if size < 100 else np.sort(np.random.default_rng(1).choice(size, (2, 4000)), axis=0)
    i, j = i[i < j], j[i < j]
    want = [next((k for k in range(size - b) if words[a + k] != words[b + k]), size - b) for a, b in zip(i, j, strict=True)]
    assert runs.Extension(words).lce(i, j).tolist() == want


def test_runs_are_brute_force():
    draw = random.Random(3)
    for _ in range(120):
        docs = []
        for _ in range(draw.randint(1, 5)):
            n, letters = draw.choice([0, 1, 5, 6, 7, 30, 90, 400]), draw.choice([1, 2, 3, 12])
            words = [b"%d" % draw.randrange(letters) for _ in range(n)]
            if n and draw.random() < 0.7:
                a = draw.randrange(n)
                p = draw.randint(1, max(1, (n - a) // 4))
                words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
            docs.append(words)
        assert [[tuple(r) for r in got] for got in runs.runs_of(docs)] == [brute_runs(d) for d in docs]


def test_grid_in_pieces(monkeypatch):
    words = [b"a", b"b"] * 300 + [b"c", b"d", b"e"] * 200
    whole = runs.runs_of([words])
    monkeypatch.setattr(runs, "GRID_AT_ONCE", 7)
    monkeypatch.setattr(runs, "QUERIES_AT_ONCE", 5)
    assert runs.runs_of([words]) == whole and len(whole[0]) == 2


def test_query_is_brute_force(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(tuple(r) for r in QUERIES["op13_runs"](spark, SF_DIR).collect())
    want = [brute_row(r["doc_id"], r["text"] or "") for r in docs if len((r["text"] or "").split()) < 3000]
    short = {r[0] for r in want}
    assert [r for r in got if r[0] in short] == sorted(want)
    assert len(got) == len(docs) and any(r[1] for r in got)


def test_odd_rows(spark):
    """Null, empty, very long, repeated rows, shared and null ids, clashing columns, no rows."""
    long = " ".join(f"w{i % 7}" if i % 5000 < 4000 else f"x{i}" for i in range(60_000))
    texts = [(1, None), (2, ""), (3, " \t\n"), (4, "a a a a a a"), (4, "a a a a a a"), (4, "b a"), (None, "é é é é é é é"), (5, long),
             (6, "x\u00a0y " * 6), (7, "x y " * 6)]
    docs = spark.createDataFrame([(i, t, "clash", "clash") for i, t in texts], DOCS)
    got = {}
    for r in runs.periodic_runs(docs).collect():
        got.setdefault(r["doc_id"], []).append((r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"], r["collapsed"][:9]))
    assert got[1] == got[2] == got[3] == [(0, None, None, None, None, "")]
    assert sorted(got[4]) == [(0, None, None, None, None, "b a"), (1, 0, 6, 1, 6000, "a"), (1, 0, 6, 1, 6000, "a")]
    assert got[None] == [(1, 0, 7, 1, 7000, "é")]
    assert got[5][0][:4] == (12, 0, 4000, 7)
    assert got[6] == [(1, 0, 6, 1, 6000, "x\u00a0y")]  # a no-break space is no blank
    assert got[7] == [(1, 0, 12, 2, 6000, "x y")]
    assert runs.periodic_runs(docs.limit(0)).count() == 0
