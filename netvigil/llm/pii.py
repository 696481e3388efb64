"""Personal data in texts: fixed patterns, and a conditional random field for what they miss.

The base patterns are matched as given. The chain tags the words of every line that holds a digit or an at-sign (all
kinds sought have one); its features are word shapes, those of the neighbours, and words of the small labelled table it
is trained on. Its spans are added where they meet no base span: cards that stand side by side, numbers without a
country code, spelled-out or broken addresses, access tokens (kind ``secret``).

Null or empty texts have no spans. Repeated rows and null ids are handled one by one, other columns are ignored (or kept,
by ``mask``). Positions count code points, the end is exclusive.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netvigil.llm import crf
from netvigil.llm.common import parts, whole_text

KINDS = ("email", "ip", "card", "phone", "secret")
TAGS = ["O"] + [f"{p}-{k}" for k in KINDS for p in "BI"]
Span = tuple[str, int, int]

_SEEN = re.compile(r"[0-9@]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only begin where a run of digits begins: from inside the run the same rest would be met.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[Span]:
    """One try per at-sign, as its left part reaches back to the last foreign character: linear in long texts."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and _LOCAL.match(text[start - 1]):
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            yield "email", start, end
        elif start < at:
            end = max(end, at)  # what stands before this sign cannot reach a later one
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, by start, then in the order of KINDS."""
    if not _SEEN.search(text):
        return []
    out = list(_emails(text))
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        d = _digits(m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


# Word features

def _run(m: re.Match) -> str:
    run = m[0]
    if run[0].isdigit():
        n = len(run)
        return f"d{n}" if n < 8 else "d8+" if n < 12 else "dcard" if n < 20 else "dlong"
    return "A" if run.isupper() else "a" if run.islower() else "Aa"


def features(word: str) -> list[str]:
    core = word.strip("\"'<>[]{}.,;:!?")
    digits = _digits(core)
    shape = re.sub(r"[0-9]+|[^\W\d_]+", _run, core) if len(core) <= 24 else "long"
    out = ["bias", f"shape={shape}"]
    if not digits and core.isalpha():
        return [*out, f"word={core.lower()}" if len(core) <= 10 else "word=long"]
    mixed = bool(digits) and any(c.isalpha() for c in core) and core.isalnum()
    out.append(f"digits={min(len(digits), 20) if len(digits) < 7 else '7-11' if len(digits) < 12 else '12-19' if len(digits) < 20 else '20+'}")
    if mixed and len(core) >= 16:
        out.append("mixed=32+" if len(core) >= 32 else "mixed=16+")
    if 12 <= len(digits) <= 19 and re.fullmatch(r"[0-9-]+", core):
        out.append("luhn" if luhn(digits) else "noluhn")
    if re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", core):
        out.append("quad" if all(int(p) <= 255 for p in core.split(".")) else "noquad")
    if "@" in core:
        out.append("at+dot" if re.search(r"[^@]@[^@]+\.[^@.]", core) else "at")
    return out


# The labelled table: fixed sentences; a slot in braces is filled with examples of its kind, ``plain`` and ``number`` with
# words and numbers that are none.
SENTENCES = (
    "call me at {phone} after noon", "tel {phone}", "phone : {phone} or {phone}", "my number is {phone} , thanks", "fax {phone}",
    "{plain} {phone} {plain}", "{plain} {plain} {phone}", "reach {plain} on {phone} .", "{phone}",
    "write to {email} today", "mail {email}", "contact : {email} or {email}", "{plain} {email} {plain} {plain}", "{email}",
    "send it to {email} , please", "{plain} {plain} {email} .",
    "card {card} expires soon", "pay with {card}", "{plain} {card} {plain}", "{plain} {card} {card} {plain}", "card number {card} , code {number}",
    "{card} {card}", "{plain} {plain} {card}", "{card}",
    "host {ip} is down", "ping {ip}", "{plain} {ip} {plain}", "from {ip} to {ip}", "{ip}", "{plain} {plain} {ip} .",
    "token = {secret}", 'token = "{secret}"', "key : {secret}", "secret {secret} {plain}", "{plain} password = {secret} {plain}",
    'api key "{secret}" {plain}', "{plain} {secret} {plain}",
    "{plain} {plain} {plain} {plain}", "{plain} {number} {plain}", "{number} {plain} {number} {plain}", "version {number} of {plain}",
    "page {number} , line {number}", "in {number} {plain} {number} {plain} {plain}", "licensed under the apache license , version {number} .",
    "on {number} at {number} {plain}", "{plain} costs {number} today", "{number}", "{plain} {plain} {plain} @ {plain}", "@ {plain} {number}",
    "total {number} {number} {number} {plain}", "{plain} {number} {number} {plain}", "table {number} : {number} {number} {number}",
    "order {number} was sent", "see section {number} {plain}", "copyright {number} {plain} {plain}", "call {plain} at {number} {plain}",
    "token {plain} key {number} {plain}", "isbn {number} {plain}")
PLAIN = ("the", "of", "and", "table", "words", "There", "house", "under", "la", "der", "que", "nicht", "River", "green", "walked", "says", "MIT", "UND!!",
         "than.", "est,", "run;", "(see", "it)", "read###", "was&&&", "a|b", "e.g.", "mañana", "Größe", "très")
NUMBERS = ("1", "12", "42,", "3.5", "2.0.", "1999", "2024-05-17", "17/05/2024", "12:30", "10,000", "1.2.3", "999.999.1.2", "v2", "x86", "3rd", "50%", "$20",
           "123456", "1-2", "1990-2000", "#7", "12345678", "9781234567897000000000", "1111222233334444", "0x1f", "h2o", "(12)", "1.000.000", "007")


def _fill(kind: str, rng: random.Random) -> str:
    def d(n: int) -> str:
        return "".join(rng.choice("0123456789") for _ in range(n))

    def name() -> str:
        return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 8)))

    if kind == "phone":
        return rng.choice(["+{0} ({1}) {2}-{3}", "({1}) {2}-{3}", "{1}-{2}-{3}", "{1}.{2}.{3}", "+{0} {1} {2} {3}", "+{0}-{1}-{2}-{3}", "({1}) {2} {3}",
                           "+{0}{1}{2}{3}"]).format(rng.choice(["1", "49", "33", "34"]), d(3), d(3), d(4))
    if kind == "email":
        return rng.choice(["{0}.{1}@{2}.com", "{0}{3}@{2}.org", "{0}_{1}@mail{3}.{2}.net", "{0} @ {2}.com", "{0}@{2} .com", "{0}.{3}@{2}.example.com"]).format(
            name(), name(), name(), d(2))
    if kind == "card":
        body = rng.choice("3456") + d(rng.choice([13, 14, 14, 14]))
        body += next(c for c in "0123456789" if luhn(body + c))
        groups = [body[:4], body[4:8], body[8:12], body[12:]]
        return rng.choice([body, body, body, " ".join(groups), "-".join(groups)])
    if kind == "ip":
        return ".".join(str(rng.randint(0, 255)) for _ in range(4))
    if kind == "secret":
        return "".join(rng.choice(rng.choice(["0123456789abcdef", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"]))
                       for _ in range(rng.choice([20, 24, 32, 40, 40, 64])))
    return rng.choice(PLAIN if kind == "plain" else NUMBERS)


def labelled_table(copies: int = 5, seed: int = 42) -> list[tuple[list[str], list[str]]]:
    """Words and tags of each labelled sentence."""
    rng, out = random.Random(seed), []
    for sentence in SENTENCES:
        for _ in range(copies):
            words: list[str] = []
            tags: list[str] = []
            for slot in sentence.split(" "):
                m = re.search(r"\{(\w+)\}", slot)
                filled = slot.replace(m[0], _fill(m[1], rng)).split(" ") if m else [slot]
                words += filled
                inner = m[1] if m and m[1] in KINDS else None
                tags += [f"{'I' if i else 'B'}-{inner}" if inner else "O" for i in range(len(filled))]
            out.append((words, tags))
    return out


def train(copies: int = 5, seed: int = 42) -> crf.Chain:
    rows = labelled_table(copies, seed)
    kept = {f"word={w.lower().strip('.,;:!?')}" for s in SENTENCES for w in s.split(" ") if w.isalpha()}

    def known(word: str) -> list[str]:
        return [f for f in features(word) if not f.startswith("word=") or f in kept]

    return crf.fit([([known(w) for w in words], tags) for words, tags in rows], TAGS)


_LEAST_DIGITS = {"phone": 7, "card": 12, "ip": 4, "email": 0, "secret": 1}


def _plausible(kind: str, text: str) -> bool:
    n = len(_digits(text))
    if kind == "email":
        return "@" in text and "." in text
    if kind == "secret":
        return len(text) >= 16 and n >= 1
    if kind == "ip":
        return text.count(".") == 3 and n >= 4
    return _LEAST_DIGITS[kind] <= n <= (19 if kind == "card" else 15)


class Tagger:
    """Finds spans in batches of texts; words' scores are kept for the worker's life, up to a bound."""

    def __init__(self, chain: crf.Chain, memory: int = 200_000) -> None:
        self.chain, self.memory, self.scores = chain, memory, {}

    def _score(self, word: str) -> np.ndarray:
        got = self.scores.get(word)
        if got is None:
            got = crf.score_word(self.chain, features(word))
            if len(self.scores) < self.memory and len(word) <= 64:
                self.scores[word] = got
        return got

    def _lines(self, text: str) -> Iterator[tuple[int, int]]:
        end = 0
        for m in _SEEN.finditer(text):
            if m.start() >= end:
                start = text.rfind("\n", end, m.start()) + 1 or end
                end = text.find("\n", m.end())
                end = len(text) if end < 0 else end
                yield start, end

    def spans(self, texts: list[str]) -> list[list[Span]]:
        """All spans of each text: the base ones, and the chain's where they meet none."""
        out = [base_spans(t) for t in texts]
        owners, words, lines = [], [], []
        for i, text in enumerate(texts):
            for start, end in self._lines(text):
                found = [m.span() for m in _WORD.finditer(text, start, end)]
                owners.append(i)
                words.append(found)
                lines.append(np.array([self._score(text[a:b]) for a, b in found]))
        for i, found, tags in zip(owners, words, crf.viterbi(self.chain, lines), strict=True):
            taken = sorted((a, b) for _, a, b in out[i])
            for kind, first, last in _chunks([TAGS[t] for t in tags]):
                start, end = _trim(texts[i], kind, found[first][0], found[last][1])
                if start < end and _plausible(kind, texts[i][start:end]) and not any(a < end and start < b for a, b in taken):
                    out[i].append((kind, start, end))
        return [sorted(s, key=lambda x: (x[1], KINDS.index(x[0]))) for s in out]


def _chunks(tags: list[str]) -> Iterator[tuple[str, int, int]]:
    first = None
    for i, tag in enumerate([*tags, "O"]):
        if first is not None and tag[0] != "I":
            yield tags[first][2:], first, i - 1
            first = None
        if tag[0] == "B":
            first = i


def _trim(text: str, kind: str, start: int, end: int) -> tuple[int, int]:
    """Without quotes and marks around; a phone number keeps its bracket."""
    left = "\"'<[{.,;:!?" + ("" if kind == "phone" else "(")
    while start < end and text[start] in left:
        start += 1
    while start < end and text[end - 1] in "\"'>]}.,;:!?)#$%&*|":
        end -= 1
    return start, end


def _told(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _batches(texts: list[str], most: int = 2000) -> Iterator[list[str]]:
    for at in range(0, len(texts), most):
        yield texts[at:at + most]


def find(docs: DataFrame, chain: crf.Chain | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256 and spans (all) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(chain or train())
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(sent.value)
        for batch in (p for b in batches for p in parts(b)):
            texts = batch.column(1).to_pylist()
            found = [s for part in _batches(texts) for s in tagger.spans(part)]
            base = [base_spans(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)] + [pa.array([sum(s[0] == k for s in b) for b in base], pa.int64()) for k in KINDS[:4]]
                + [pa.array([hashlib.sha256(_told(b).encode()).hexdigest() for b in base]), pa.array([_told(s) for s in found])],
                names=[p.strip().split(" ")[0] for p in schema.split(",")])

    return docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).mapInArrow(run, schema)


def masked(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    out, end = [], 0
    for kind, a, b in spans:
        if a >= end:
            out += [text[end:a], f"[{kind.upper()}]"]
        end = max(end, b)
    return "".join([*out, text[end:]])


def mask(docs: DataFrame, chain: crf.Chain | None = None) -> DataFrame:
    """``docs`` with its spans masked in ``text`` and, if there, ``n_chars`` counted anew. Null texts stay null."""
    sent = docs.sparkSession.sparkContext.broadcast(chain or train())
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(sent.value)
        for batch in (p for b in batches for p in parts(b)):
            texts = batch.column(at).to_pylist()
            found = [s for part in _batches([t or "" for t in texts]) for s in tagger.spans(part)]
            new = pa.array([None if t is None else masked(t, s) for t, s in zip(texts, found, strict=True)], pa.string())
            yield batch.set_column(at, batch.schema.field(at).name, new)

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out
