"""Fingerprint groups and long repeats against brute force."""

import hashlib
import re
from collections import Counter

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from netvigil.llm import repeats, simhash
from netvigil.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long, core long"


def frame(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", 0, 7, 7) for i, t in zip(ids, texts, strict=True)], DOCS)


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    grams = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(prints):
        for j in range(i):
            if bin(a ^ prints[j]).count("1") <= 4:
                low, high = sorted((find(i), find(j)))
                root[high] = low
    return [find(i) for i in range(len(prints))]


@given(st.text(alphabet="aB é \t\x1cß.\n", max_size=60))
@settings(max_examples=200, deadline=None)
def test_fingerprint_bits(text):
    assert simhash.fingerprint(text.encode()) % (1 << 64) == plain_fingerprint(text)


def test_groups_match_brute_force(spark):
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen".split()
    texts = [" ".join(base * 9 + [f"tail{i % 7}"] * (i % 4)) for i in range(30)] + ["", None, "  ", "x", "X y", "x y"] + [
        " ".join(f"w{i * j % 101}" for j in range(60)) for i in range(20)] + ["one two three"] * 3
    rows = {r["doc_id"]: r for r in simhash.groups(frame(spark, texts)).collect()}
    prints = [plain_fingerprint(t or "") for t in texts]
    assert [int(rows[i]["fingerprint"], 16) for i in range(len(texts))] == prints
    assert [rows[i]["component_id"] for i in range(len(texts))] == plain_groups(prints)


def test_links_at_the_edges(spark):
    """Every split of up to four differing bits over the segments, the sign bit included, is found once; five are not."""
    flips = [(63,), (0, 21), (21, 22), (0, 22, 43), (1, 2, 3, 63), (0, 1, 22, 23), (0, 22, 43, 63), (42, 43, 62, 63), (22, 23, 43, 44)]
    base = 0x0123456789ABCDEF
    prints = [base] + [base ^ sum(1 << b for b in f) for f in flips] + [base ^ 0b11111 << 30]
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    found = Counter((r["a"], r["b"]) for r in simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long")).collect())
    want = {tuple(sorted((a, b))) for i, a in enumerate(signed) for j, b in enumerate(signed)
            if i < j and bin(prints[i] ^ prints[j]).count("1") <= 4}
    assert set(found) == want and set(found.values()) == {1}
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([(1,)], "fp long"), 5)


def test_links_index_is_never_broadcast(spark):
    """64 variants a fingerprint: a table below the broadcast limit has an index far above it."""
    plan = simhash.links(spark.range(2000).selectExpr("xxhash64(id) as fp"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(5, 5), (7, 3)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}}


def test_groups_without_rows_and_ids(spark):
    assert simhash.groups(frame(spark, [])).count() == 0
    rows = simhash.groups(frame(spark, ["a b", "a b", "c"], [None, 5, None])).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in rows) == [("5", "5"), ("None", "5"), ("None", "None")]


def test_keep_first(spark):
    """One row a group, also of rows that share an id or have none; different texts under one id are judged apart."""
    docs = frame(spark, ["a b c", "a b c", "d", "a b c", "e", "e", "f", "a b c"], [3, 2, 9, 2, None, None, 9, None])
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept.collect()) == [("2", "a b c"), ("9", "d"), ("9", "f"), ("None", "e")]
    assert simhash.keep_first(docs.limit(0)).count() == 0


# Long repeats

def plain_cut(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(t[i:i + length] for t in data for i in range(len(t) - length + 1))
    out = []
    for t in data:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                gone[i:i + length] = [True] * length
        runs = sum(g and (not i or not gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def cut_rows(spark, texts, **how):
    rows = repeats.remove_repeats_digest(frame(spark, texts), **how).orderBy("doc_id").collect()
    return [(r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows]


def noise(seed, n):
    return hashlib.shake_128(str(seed).encode()).hexdigest(n)[:n]


def repeat_texts():
    common = noise("common", 500)
    texts = [noise(i, 300) + common[i:450 - i] + noise(-i, 200) for i in range(30)]       # edges at many offsets
    texts += [noise(1, 300) + common[3:300], common[:399], common[:400], noise(7, 2000), noise(7, 2000)]
    texts += ["ab" * 900, "a" * 1200, "a" * 400, "a" * 399, "é" * 300, "", None, "short"]  # periodic, runs, two-byte signs
    whole = noise("whole", 3000)
    texts += [whole, whole[:1500] + "X" + whole[1501:], whole[:700] + whole[720:2000], whole[1000:1390], whole + whole]
    return texts


def test_repeats_match_brute_force(spark):
    texts = repeat_texts()
    assert cut_rows(spark, texts) == plain_cut(texts, 400)


@pytest.mark.parametrize("how", [{"length": 30, "window": 4, "block": 3}, {"length": 21, "window": 8, "block": 1}])
def test_repeats_with_small_strings(spark, how):
    texts = [t and t[:700] for t in repeat_texts()] + ["the cat sat on the mat " * 4, "the cat sat on the mat and ran"]
    assert cut_rows(spark, texts, **how) == plain_cut(texts, how["length"])


def test_repeats_of_rows_and_ids(spark):
    text = noise("row", 600)
    rows = repeats.remove_repeats(frame(spark, [text, text, noise("other", 600)], [4, 4, None])).collect()
    assert sorted((r["doc_id"] or -1, r["n_removed"], len(r["kept"])) for r in rows) == [(-1, 0, 600), (4, 600, 0), (4, 600, 0)]
    assert repeats.remove_repeats(frame(spark, [])).count() == 0


@given(st.binary(max_size=600))
@settings(max_examples=50, deadline=None)
def test_triggers_depend_on_content(data):
    import numpy as np

    if len(data) >= 40:
        whole = repeats.triggers(np.frombuffer(data, np.uint8), 30, 8)
        for i in range(0, len(data) - 30 + 1, 7):
            assert repeats.triggers(np.frombuffer(data[i:i + 30], np.uint8), 30, 8)[0] == whole[i] - i
