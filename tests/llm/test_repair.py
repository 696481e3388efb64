"""Structure repair: the search against enumeration of all edits, segments of any cut, collisions, odd rows."""

import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from netvigil.llm import repair

ROWS = "conv_id long, turn long, role string, text string, cost long, part string"


def brute(rows):
    """Cheapest, then least audit of sound/doomed/open rows (initial, doomed, truncated), with the roles it gives."""
    best = None
    options = []
    for initial, doomed, truncated in rows:
        w = 5 * truncated
        options.append([("D", "", 2)] + ([] if doomed else [("K", initial, w), ("R", "u", w + 1), ("R", "a", w + 1)]))
    for puts in itertools.product(["", "u", "a", "ua", "au"], repeat=len(rows) + 1):
        if sum(map(len, puts)) > 2:
            continue
        for edits in itertools.product(*options):
            cost = 5 * sum(map(len, puts)) + sum(e[2] for e in edits)
            roles, audit = "", ""
            for put, edit in itertools.zip_longest(puts, edits):
                audit += "I" * len(put) + (edit[0] if edit else "")
                roles += put + (edit[1] if edit else "")
            if re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, roles)
    return best


def searched(rows, cuts):
    """The same by segments, cut at the given places."""
    segments = []
    for low, high in itertools.pairwise([0, *cuts, len(rows)]):
        costs, audits = [None] * 16, [None] * 16
        for start in range(4):
            search = repair.Search(repair.Audits(), start)
            for row in rows[low:high]:
                search.row(*row)
            for end, held in enumerate(search.cells):
                if held:
                    costs[4 * start + end], audits[4 * start + end] = held[0], search.audits.text(held[1])
        segments.append((costs, audits))
    cost, pieces = repair.cheapest(segments)
    return cost, "".join(p for p, _ in pieces)


def draws(count, longest, seed):
    draw = random.Random(seed)
    for _ in range(count):
        yield [(draw.choice("suaux"), draw.random() < 0.2, draw.random() < 0.3) for _ in range(draw.randint(0, longest))]


def test_search_is_enumeration():
    for rows in draws(60, 4, 1):
        want = brute(rows)[:2]
        for n in range(min(3, len(rows)) + 1):
            for cuts in itertools.combinations(range(1, len(rows)), n):
                assert searched(rows, cuts) == want, (rows, cuts)


def test_cuts_do_not_matter():
    for rows in draws(40, 60, 2):
        whole = searched(rows, ())
        assert searched(rows, range(1, len(rows))) == searched(rows, range(7, len(rows), 7)) == whole


def test_collisions_are_seen(monkeypatch):
    """With a hash that tells next to nothing apart, the least audits are still found."""
    rows = list(draws(40, 40, 3))
    want = [searched(r, ()) for r in rows]
    monkeypatch.setattr(repair.Audits, "MODULUS", 2)
    assert [searched(r, ()) for r in rows] == want


def test_audits_compare_like_strings():
    draw, audits = random.Random(4), repair.Audits()
    nodes = [0]
    for _ in range(400):
        nodes.append(audits.add(draw.choice(nodes[-40:]), draw.choice("DIKR")))
    for _ in range(2000):
        a, b = draw.choice(nodes), draw.choice(nodes)
        assert audits.less(a, b) == (audits.text(a) < audits.text(b))


def collected(audits, repaired):
    told = {}
    for r in sorted(repaired.collect(), key=lambda r: r["position"]):
        told.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    return {r["conv_id"]: (*[r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")],
                           told.get(r["conv_id"], [])) for r in audits.collect()}


@pytest.fixture(scope="module")
def messy(spark):
    draw = random.Random(5)
    rows = [(c, t, draw.choice(["system", "user", "assistant", "user", "tool", None]), draw.choice(["a.", "b", "", " ", None, "c?", "d e!\n"]), 9, "x")
            for c in range(30) for t in range(draw.randint(0, 9)) for _ in range(1 + (draw.random() < 0.2))]
    rows += [(77, t, "user" if t % 2 else "assistant", f"word {t % 50}{'.' if t % 3 else ''}", 9, "x") for t in range(400)]
    rows += [(78, 1, "user", "again.", 9, "x")] * 300
    return spark.createDataFrame(rows, ROWS).repartition(7)


def test_segments_of_any_size(spark, messy):
    whole = collected(*repair.repair(messy))
    assert collected(*repair.repair(messy, segment_rows=3)) == whole
    assert whole[78] == (0, 0, 299, 0, 299, 600, "D" * 300, [])


def test_counts_and_cost_by_hand(spark):
    def one(*rows):
        df = spark.createDataFrame([(1, t, r, x, 0, "p") for t, r, x in rows], ROWS)
        return collected(*repair.repair(df))[1]

    assert one((0, "system", "s."), (1, "user", "q?"), (2, "assistant", "a.")) == (
        0, 0, 0, 0, 0, 0, "KKK", ["system:s.", "user:q?", "assistant:a."])
    assert one((0, "user", "q?"), (5, "user", "more.")) == (4, 0, 0, 0, 1, 1, "KR", ["user:q?", "assistant:more."])
    assert one((0, "user", "q?"), (0, "user", "q?"), (1, "assistant", "a.")) == (
        0, 0, 1, 0, 1, 2, "KDK", ["user:q?", "assistant:a."])
    assert one((None, "user", " \t"), (None, "user", "q")) == (0, 1, 0, 1, 1, 4, "DD", [])
    assert one((3, "assistant", "x" * 200_000 + ".")) == (0, 0, 0, 0, 0, 2, "D", [])


def test_digests(spark, messy):
    audits, repaired = repair.repair(messy)
    want = {k: hashlib.sha256("\n".join(v[-1]).encode()).hexdigest() for k, v in collected(audits, repaired).items() if v[-1]}
    assert {r["conv_id"]: r["repaired_sha256"] for r in repair.digests(repaired).collect()} == want


def test_no_rows_and_null_ids(spark):
    empty = spark.createDataFrame([], ROWS)
    audits, repaired = repair.repair(empty)
    assert audits.count() == repaired.count() == repair.digests(repaired).count() == 0
    rows = spark.createDataFrame([(None, 1, "user", "q.", 0, "p"), (None, None, "system", "s.", 0, "p"), (0, 0, "user", "q.", 0, "p"),
                                  (None, 2, "assistant", "a.", 0, "p"), (0, 1, "assistant", "a.", 0, "p")], ROWS)
    got = collected(*repair.repair(rows))
    assert got[None] == (0, 0, 0, 0, 0, 0, "KKK", ["system:s.", "user:q.", "assistant:a."])
    assert got[0] == (0, 0, 0, 0, 0, 0, "KK", ["user:q.", "assistant:a."])


def test_damage_reads_nulls_as_a_blank(spark):
    import zlib

    rows = spark.createDataFrame([(None, t, None, None, 0, "p") for t in [*range(60), None]], ROWS)
    got = [(r["turn"], r["role"], r["text"]) for r in repair.damaged(rows).collect()]
    want = []
    for t in [*range(60), None]:
        fault = zlib.crc32(f" :{' ' if t is None else t}".encode()) % 20
        want += [(t, "user" if fault == 4 else " ", "" if fault == 1 else " ")] * {0: 0, 3: 2}.get(fault, 1)
    assert sorted(got, key=str) == sorted(want, key=str)
    assert repair.damaged(rows.where(F.lit(False))).count() == 0
