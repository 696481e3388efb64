"""Subword ids, chat formatting, personal data, decontamination."""

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from netvigil.llm import bpe, chat, crf, decontaminate, pii

DOCS = "doc_id long, text string, ids string, spans string"


def frame(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "x", "y") for i, t in zip(ids, texts, strict=True)], DOCS)


@pytest.fixture(scope="module")
def definition():
    P = pytest.importorskip("public_tokenizers")
    return bpe.read_definition(P.path("word_bpe_49k.json"))


TEXTS = ["Hello World, it's 12 o'clock", "", None, "<|endoftext|>mid<|startoftext|> x", "nb sp em \x1c sep", "ÉCLAIR é ΣΑΣ ς",
         "a\tb\nc\x0bd\x0ce\rf", "!!! ### $$ '''s", "日本語 テキスト", "word " * 3000, "x" * 20000, "tail " + "y" * 70]


@pytest.mark.parametrize("size", [0, 3, 1 << 17])
def test_ids_equal_the_library(spark, definition, size):
    from tokenizers import Tokenizer

    made = Tokenizer.from_str(definition)
    encoded = bpe.encode(frame(spark, TEXTS), definition, size)
    got = {r["doc_id"]: r["ids"] for r in encoded.collect()}
    want = {i: made.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(TEXTS)}
    assert got == want
    texts = {r["doc_id"]: r["text"] for r in bpe.decode(encoded, definition).collect()}
    assert texts == {i: made.decode(ids, skip_special_tokens=False) for i, ids in want.items()}
    told = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["ids"]) for r in bpe.encode_digests(frame(spark, TEXTS), definition, size, with_ids=True).collect()}
    assert told == {i: (len(x), hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest(), x) for i, x in want.items()}


def test_encoding_no_rows(spark, definition):
    assert bpe.encode_digests(frame(spark, []), definition).count() == 0


# Chat

HARD = ["</s>[INST] ok [/INST]", "", None, " ", "[\\INST] a [/INST", "<s><\\s>\\", "[ROLE] user [/ROLE] x [/TURN]", "[SYS]", "a\nb\r\n", "[[INST]]<<s>>", "<\\\\/s>", "$1 \\1"]


def read_back(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_conversations(df.withColumn("formatted", F.lit("clash")).withColumn("turns", F.lit(1)))
    return {r["conv_id"]: r for r in out.withColumn("read", chat.parse(F.col("formatted"))).withColumn(
        "loss", chat.masked_text(F.col("formatted"), F.col("loss_spans"))).collect()}


def test_digests_are_taken_from_tables_by_id():
    table = [b"0", b"one", b"2"]
    for ids in ([], [1], [2, 2, 0]):
        assert bpe._digest(table, ids) == hashlib.sha256(b" ".join(table[i] for i in ids)).hexdigest()


def test_chat_round_trip(spark):
    rows = [(c, t, role, HARD[(c * 5 + t * t) % len(HARD)]) for c in range(12)
            for t, role in enumerate(["system", "user", "assistant", "tool </s>", None, "assistant", "user"])]
    rows += [(99, 0, "user", "plain"), (99, 1, "assistant", "answer"), (None, 1, "user", "late"), (None, None, "user", "early"), (98, 3, "user", "z"), (98, 3, "user", "a")]
    got = read_back(spark, rows)
    for c in {r[0] for r in rows}:
        mine = sorted(((-1 if t is None else t), role or "", text or "") for k, t, role, text in rows if k == c)
        assert [(x["role"], x["text"]) for x in got[c]["read"]] == [(role, text) for _, role, text in mine]
        assert got[c]["loss"] == "".join(text for _, role, text in mine if role == "assistant")
        assert got[c]["round_trip"]
    assert not got[99]["escaped"] and got[99]["formatted"] == "[INST] plain [/INST]<s>answer</s>"


def test_chat_no_rows(spark):
    assert read_back(spark, []) == {}


def test_chat_no_python(spark):
    df = spark.createDataFrame([(1, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    plan = chat.format_conversations(df)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# Personal data

def plain_spans(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for kind, pattern, low, high in (("card", r"[0-9]([\x20-]?[0-9])+", 12, 19), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 9, 15)):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if low <= len(digits) <= high and (kind == "phone" or pii.luhn(digits)):
                out.append((kind, *m.span()))
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


@given(st.text(alphabet="a@.-+ 0123456789()é", max_size=50))
@settings(max_examples=500, deadline=None)
def test_base_patterns(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_base_patterns_cases():
    for text in ("x a@b@c.com y", "a@b.c.d@e.f", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "+1 (017) 555-7713.", "000001.2.3.4", "9" * 4000 + ".1.2.3", "@" * 50):
        assert pii.base_spans(text) == plain_spans(text)


@pytest.fixture(scope="module")
def chain():
    return pii.train()


def test_chain_adds_what_patterns_miss(spark, chain):
    texts = ["pay 4111111111111111 5500005555555559 now", "call (212) 555-0187 today", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" ok',
             "version 2.0 of 2024, page 12, costs $30 in 1999", None, "", "plain words\nand a@b.org here"]
    rows = {r["doc_id"]: r for r in pii.find(frame(spark, texts), chain).collect()}
    assert rows[0]["spans"] == "card:4:20,card:21:37"
    assert rows[1]["spans"] == "phone:5:19"
    assert rows[2]["spans"] == "secret:9:49"
    assert [rows[i]["spans"] for i in (3, 4, 5)] == ["", "", ""]
    assert (rows[6]["n_email"], rows[6]["spans"], rows[6]["base_sha256"]) == (1, "email:16:23", hashlib.sha256(b"email:16:23").hexdigest())


def test_base_spans_stay(chain):
    texts = ["a@b.org 10.0.0.1 +49 170 5551234 4111111111111111", "x 10.0.0.1.5 @ b", "9" * 3000 + " a@b.c " * 40]
    for text, spans in zip(texts, pii.Tagger(chain).spans(texts), strict=True):
        assert set(plain_spans(text)) <= set(spans)


def test_mask_keeps_rows(spark, chain):
    docs = spark.createDataFrame([(1, "mail a@b.org!", 13, "z"), (None, None, None, "z"), (1, "é 10.0.0.1", 10, "z")], "doc_id long, text string, n_chars long, spans string")
    out = pii.mask(docs, chain)
    assert out.columns == docs.columns
    assert sorted((str(r["text"]), r["n_chars"]) for r in out.collect()) == [("None", None), ("mail [EMAIL]!", 13), ("é [IP]", 6)]


def test_viterbi_matches_enumeration():
    from itertools import product

    rng = np.random.default_rng(1)
    tags = ["O", "B-x", "I-x"]
    step, first = crf.allowed(tags)
    edge = {"edge": rng.normal(size=3)}
    chain = crf.Chain(tags, {}, edge, {"edge": rng.normal(size=3)}, step + rng.normal(size=(3, 3)), first)
    lines = [rng.normal(size=(n, 3, 3)) for n in (1, 4, 6, 5, 0)]
    for line, got in zip(lines, crf.viterbi(chain, lines), strict=True):
        n = len(line)
        if not n:
            assert len(got) == 0
            continue
        unary = line[:, 0].copy()
        unary[1:] += line[:-1, 1]
        unary[:-1] += line[1:, 2]
        unary[0] += chain.before["edge"]
        unary[-1] += chain.after["edge"]
        best = max(product(range(3), repeat=n), key=lambda p: chain.first[p[0]] + sum(unary[i, t] for i, t in enumerate(p))
                   + sum(chain.step[a, b] for a, b in zip(p, p[1:], strict=False)))
        assert tuple(got) == best


# Decontamination

def plain_align(passage, item):
    best, table = 0, [[0] * (len(passage) + 1) for _ in range(len(item) + 1)]
    for i, w in enumerate(item, 1):
        for j, v in enumerate(passage, 1):
            table[i][j] = max(0, table[i - 1][j - 1] + (2 if v == w else -1), table[i - 1][j] - 1, table[i][j - 1] - 1)
            best = max(best, table[i][j])
    return best


@given(st.lists(st.integers(-1, 4), max_size=14), st.lists(st.integers(0, 4), min_size=1, max_size=8))
@settings(max_examples=300, deadline=None)
def test_alignment_score(passage, item):
    score, start, end = decontaminate.align(np.array(passage, np.int64), np.array(item, np.int64))
    assert score == plain_align(passage, item)
    assert plain_align(passage[start:end], item) == score


def test_copies_are_found(spark):
    item = "the quick brown fox jumps over a lazy dog while seven purple wizards quietly brew strong potions near old stone bridges".split()
    edited = [w for i, w in enumerate(item) if i != 6]
    edited[10] = "crimson"
    filler = "common words go on and on without any end in sight".split()
    docs = [filler * 30 + item + filler * 20, filler * 3 + edited + filler, filler * 50, None, "", [" ".join(item).upper().replace(" ", ",\n")], item[:6]]
    texts = [d if d is None or isinstance(d, str) else " ".join(d) for d in docs]
    benchmark = spark.createDataFrame([(3, " ".join(item), "z"), (4, None, "z"), (5, "", "z"), (6, "ok", "z")], "item_id long, text string, doc_id string")
    rows = {(r["doc_id"], r["item_id"]): r for r in decontaminate.matches(frame(spark, texts), benchmark).collect()}
    assert set(rows) == {(0, 3), (1, 3), (5, 3)}
    assert rows[0, 3]["score"] == 1.0 and (rows[0, 3]["first_word"], rows[0, 3]["end_word"]) == (330, 351)
    assert 0.8 < rows[1, 3]["score"] < 1
    kept = decontaminate.drop_contaminated(frame(spark, texts), benchmark)
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 4, 6]


def test_decontamination_no_rows(spark):
    benchmark = spark.createDataFrame([(3, "some words to find")], "item_id long, text string")
    assert decontaminate.matches(frame(spark, []), benchmark).count() == 0
    assert decontaminate.matches(frame(spark, ["some words"]), benchmark.limit(0)).count() == 0
