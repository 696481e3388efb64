"""Conversation structure repair: the cheapest edits that give each conversation a legal order of roles.

Rows of a conversation are taken by turn (nulls first; then by role and a hash of the text, so the order is defined).
Each row is blank, a duplicate of an earlier row (role and text), truncated (no closing mark) or sound. Edits: K keeps a
row, R gives it the role user or assistant, D deletes it (blank and duplicate rows must go), I inserts an empty user or
assistant row. The roles left must read ``(s?(ua)+)?`` by their initials. Of the cheapest edit strings ("audits") the least
one in ASCII order is taken.

The search is a dynamic program over four states of that pattern. Audits are persistent: each is a node linked to the audit
it extends, so all of them share their prefixes. Nodes carry a rolling hash and their ancestors at distances of powers of two;
of two audits with equal costs the longest common prefix is found by lifting over the hashes, then the next letter decides. A
prefix believed equal is verified letter by letter down to the shared node; after a collision the letters are compared plainly.

At any size: rows are cut down to hashes and flags (equal rows become one with a count) and dealt by ranges of conversation
and turn, so a conversation of any length is spread over tasks, in segments of at most ``SEGMENT_ROWS``. A segment gives its
cheapest audits from each state to each state; these compose like matrices. Texts travel twice: to the rows that stay, and
to whoever writes a conversation out. What one task must hold of one conversation is its audit, which is one value anyway.

Nulls in role or text are read as one blank; a null turn is a turn before all others and ignored by the gap count; rows
without a conversation id form one conversation. Empty texts are blank; equal rows are adjacent. Extra columns are
ignored, an empty table gives empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netvigil.llm.common import join_counted
from netvigil.session import materialize

DELETE, REROLE, INSERT, UNFINISHED = 2, 1, 5, 5
SEGMENT_ROWS = 5_000
STRIPPED = " \t\n\x0b\x0c\r"
# States: nothing yet, after the system row, after a user row, after an assistant row. Only 0 and 3 may end.
ENDS = (0, 3)
INITIALS = "sua"
STEP = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
INSERTED = (2, 2, 3, 2)
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
ROLES = {"u": "user", "a": "assistant"}


class Audits:
    """Edit strings as linked nodes; node 0 is the empty string."""

    BASE, MODULUS = 1_000_003, (1 << 61) - 1

    def __init__(self) -> None:
        self.letter, self.depth, self.hash, self.up = [""], [0], [0], [[]]

    def add(self, node: int, letter: str) -> int:
        up, at, k = [node], node, 0
        while k < len(self.up[at]):
            at = self.up[at][k]
            up.append(at)
            k += 1
        self.letter.append(letter)
        self.depth.append(self.depth[node] + 1)
        self.hash.append((self.hash[node] * self.BASE + ord(letter)) % self.MODULUS)
        self.up.append(up)
        return len(self.up) - 1

    def text(self, node: int, stop: int = 0) -> str:
        out = []
        while node != stop:
            out.append(self.letter[node])
            node = self.up[node][0]
        return "".join(reversed(out))

    def ancestor(self, node: int, depth: int) -> int:
        rise = self.depth[node] - depth
        while rise:
            k = rise.bit_length() - 1
            node = self.up[node][k]
            rise -= 1 << k
        return node

    def _same(self, a: int, b: int) -> bool:
        """Whether two nodes of one depth spell the same, letter by letter down to the node they share."""
        while a != b:
            if self.letter[a] != self.letter[b]:
                return False
            a, b = self.up[a][0], self.up[b][0]
        return True

    def less(self, a: int, b: int) -> bool:
        """Whether a's string stands before b's."""
        depth = min(self.depth[a], self.depth[b])
        x, y = self.ancestor(a, depth), self.ancestor(b, depth)
        if self.hash[x] == self.hash[y]:
            if self._same(x, y):
                return self.depth[a] < self.depth[b]
            return self.text(a) < self.text(b)
        for k in reversed(range(len(self.up[x]))):
            if k < len(self.up[x]) and self.hash[self.up[x][k]] != self.hash[self.up[y][k]]:
                x, y = self.up[x][k], self.up[y][k]
        if self.letter[x] == self.letter[y] or not self._same(self.up[x][0], self.up[y][0]):
            return self.text(a) < self.text(b)
        return self.letter[x] < self.letter[y]


Cells = list[tuple[int, int] | None]  # by state: cost and audit node


class Search:
    """The dynamic program over the rows of one segment, from one state."""

    def __init__(self, audits: Audits, state: int) -> None:
        self.audits, self.cells = audits, [None] * 4
        self.cells[state] = (0, 0)

    def _offer(self, cells: Cells, state: int, cost: int, node: int, letter: str) -> None:
        held = cells[state]
        if held is None or cost < held[0]:
            cells[state] = (cost, self.audits.add(node, letter))
        elif cost == held[0]:
            new = self.audits.add(node, letter)
            if self.audits.less(new, held[1]):
                cells[state] = (cost, new)

    def insert(self) -> None:
        """Rows may be put in here; more than two would come back to a state at a higher cost."""
        for _ in range(2):
            base = list(self.cells)
            for state, held in enumerate(base):
                if held:
                    self._offer(self.cells, INSERTED[state], held[0] + INSERT, held[1], "I")

    def row(self, initial: str, doomed: bool, truncated: bool) -> None:
        self.insert()
        new: Cells = [None] * 4
        more = UNFINISHED if truncated else 0
        for state, held in enumerate(self.cells):
            if held is None:
                continue
            cost, node = held
            self._offer(new, state, cost + DELETE, node, "D")
            if doomed:
                continue
            for role, to in STEP[state].items():
                if role == initial:
                    self._offer(new, to, cost + more, node, "K")
                elif role != "s":
                    self._offer(new, to, cost + more + REROLE, node, "R")
        self.cells = new


# --- segments -------------------------------------------------------------------------------------

_SEGMENT = pa.schema([
    ("known", pa.int32()), ("conv", pa.int64()), ("part", pa.int32()), ("number", pa.int32()),
    *[(n, pa.int64()) for n in ("blank", "duplicate", "truncated", "illegal", "turns", "low", "high")],
    ("first", pa.string()), ("last", pa.string()), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string())),
    ("initials", pa.string()), ("at", pa.list_(pa.int32())), ("timed", pa.list_(pa.int32())), ("turn", pa.list_(pa.int64())),
    ("h", pa.list_(pa.int64())), ("g", pa.list_(pa.int64()))])
_SEGMENT_DDL = ("known int, conv long, part int, number int, blank long, duplicate long, truncated long, illegal long, turns long, "
                "low long, high long, first string, last string, costs array<bigint>, audits array<string>, initials string, "
                "at array<int>, timed array<int>, turn array<bigint>, h array<bigint>, g array<bigint>")


class _Segment:
    def __init__(self, conv: tuple, part: int, number: int, starts: tuple[int, ...]) -> None:
        self.conv, self.part, self.number, self.size = conv, part, number, 0
        self.audits = Audits()
        self.searches = {s: Search(self.audits, s) for s in starts}
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "turns": 0}
        self.low = self.high = None
        self.first = self.last = None
        self.kept: list[tuple] = []
        self.initials: list[str] = []

    def add(self, timed: int, turn: int, initial: str, h: int, g: int, blank: bool, truncated: bool, repeated: bool) -> None:
        if timed and turn != self.high:
            self.counts["turns"] += 1
            self.low, self.high = turn if self.low is None else self.low, turn
        fault = "blank" if blank else "duplicate" if repeated else "truncated" if truncated else None
        if fault:
            self.counts[fault] += 1
        if self.last is not None:
            self.counts["illegal"] += (self.last, initial) not in LEGAL
        self.first, self.last = initial if self.first is None else self.first, initial
        doomed = blank or repeated
        for search in self.searches.values():
            search.row(initial, doomed, truncated)
        if not doomed:
            self.kept.append((self.size, timed, turn, h, g))
            self.initials.append(initial if initial in INITIALS else "?")
        self.size += 1

    def told(self) -> tuple:
        costs, audits = [None] * 16, [None] * 16
        for start, search in self.searches.items():
            for end, held in enumerate(search.cells):
                if held:
                    costs[4 * start + end], audits[4 * start + end] = held[0], self.audits.text(held[1])
        kept = list(map(list, zip(*self.kept, strict=True))) if self.kept else [[]] * 5
        return (*self.conv, self.part, self.number, *self.counts.values(), self.low, self.high, self.first, self.last, costs, audits,
                "".join(self.initials), *kept)


def _segments(segment_rows: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, opening, number, out, size = TaskContext.get().partitionId(), None, True, 0, [], 0

        def batch_of(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SEGMENT, strict=True)],
                                              schema=_SEGMENT)

        for batch in batches:
            for known, conv, timed, turn, initial, h, g, blank, truncated, later, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for copy in range(n):
                    if held is None or held.conv != (known, conv) or held.size == segment_rows:
                        if held is not None:
                            out.append(held.told())
                            size += held.size
                            opening = held.conv == (known, conv)
                            number = number + 1 if opening else 0
                        if size >= segment_rows:
                            yield batch_of(out)
                            out, size = [], 0
                        # the first conversation of a task, or one that goes on, may start in any state
                        held = _Segment((known, conv), part, number, (0, 1, 2, 3) if opening else (0,))
                    held.add(timed, turn, initial, h, g, blank, truncated, later or copy > 0)
        if held is not None:
            out.append(held.told())
        if out:
            yield batch_of(out)

    return run


# --- whole conversations --------------------------------------------------------------------------

class Path:
    """A chain of segment audits; chains share their beginnings."""

    __slots__ = ("before", "piece", "states")

    def __init__(self, before: Path | None, piece: str, states: tuple[int, int]) -> None:
        self.before, self.piece, self.states = before, piece, states

    def pieces(self) -> list[tuple[str, tuple[int, int]]]:
        out, at = [], self
        while at is not None:
            out.append((at.piece, at.states))
            at = at.before
        return out[::-1]


def _less(a: Path, b: Path) -> bool:
    """Whether chain a spells less than chain b; both have the same number of pieces."""
    left, right, x, y = [], [], a, b
    while x is not y:
        left.append(x.piece)
        right.append(y.piece)
        x, y = x.before, y.before
    return "".join(reversed(left)) < "".join(reversed(right))


def _best(options: list[tuple[int, Path]]) -> tuple[int, Path] | None:
    best = None
    for cost, path in options:
        if best is None or cost < best[0] or (cost == best[0] and _less(path, best[1])):
            best = (cost, path)
    return best


def cheapest(segments: list[tuple[list, list]]) -> tuple[int, list[tuple[str, tuple[int, int]]]]:
    """Cost and, per segment, the audit with its state before and after. ``segments``: costs and audits by 4 * from + to."""
    cells: list[tuple[int, Path] | None] = [(0, None), None, None, None]
    for costs, audits in segments:
        cells = [_best([(cells[s][0] + costs[4 * s + t], Path(cells[s][1], audits[4 * s + t], (s, t)))
                        for s in range(4) if cells[s] and costs[4 * s + t] is not None]) for t in range(4)]
    # rows put in after the last one
    done = []
    for s, held in enumerate(cells):
        for many, end in ((0, s), (1, INSERTED[s]), (2, INSERTED[INSERTED[s]])):
            if held and end in ENDS:
                done.append((held[0] + INSERT * many, Path(held[1], "I" * many, (s, end))))
    cost, path = _best(done)
    return cost, path.pieces()


_EDIT_DDL = ("known int, conv long, position long, timed int, turn long, h long, g long, new_role string, gaps long, blank long, "
             "duplicate long, truncated long, illegal long, cost long, audit string")
_EDIT_TYPES = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), *[pa.int64()] * 6, pa.string()]


def _edits_of(segment: dict, audit: str, state: int, position: int) -> Iterator[tuple]:
    """Rows that the audit of one segment leaves: (position, timed, turn, h, g, new role)."""
    row, keys = -1, {at: k for k, at in enumerate(segment["at"])}
    for letter in audit:
        row += letter != "I"
        if letter == "D":
            continue
        if letter == "K":
            k = keys[row]
            state, new = STEP[state][segment["initials"][k]], None
        else:
            role = "u" if "u" in STEP[state] else "a"
            state, new = STEP[state][role], ROLES[role]
        source = (None,) * 4 if letter == "I" else tuple(segment[n][keys[row]] for n in ("timed", "turn", "h", "g"))
        yield position, *source, new
        position += 1


def _compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [p.strip().split(" ")[0] for p in _EDIT_DDL.split(",")]

    def batch_of(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _EDIT_TYPES, strict=True)], names=names)

    def rows_in() -> Iterator[dict]:
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                yield from batch.slice(at, 100).to_pylist()

    out: list[tuple] = []
    for conv, group in groupby(rows_in(), lambda s: (s["known"], s["conv"])):
        segments = list(group)
        cost, pieces = cheapest([(s["costs"], s["audits"]) for s in segments])
        counts = [sum(s[n] for s in segments) for n in ("blank", "duplicate", "truncated", "illegal")]
        turns, high, last = 0, None, None
        for s in segments:
            turns += s["turns"] - (high is not None and s["low"] == high)
            high = s["high"] if s["high"] is not None else high
            counts[3] += last is not None and (last, s["first"]) not in LEGAL
            last = s["last"]
        low = next((s["low"] for s in segments if s["low"] is not None), None)
        gaps = 0 if low is None else high - low + 1 - turns
        out.append((*conv, None, None, None, None, None, None, gaps, *counts, cost, "".join(p for p, _ in pieces)))
        position = 0
        nothing = {"at": [], "initials": ""}
        for (audit, (state, _)), segment in zip(pieces, [*segments, nothing], strict=True):
            for edit in _edits_of(segment, audit, state, position):
                out.append((*conv, *edit, *(None,) * 7))
                position += 1
                if len(out) >= 10_000:
                    yield batch_of(out)
                    out = []
    if out:
        yield batch_of(out)


_CONV, _TURN, _HASHES = ["known", "conv"], ["timed", "turn"], ["h", "g"]


def _keyed(rows: DataFrame) -> DataFrame:
    """Non-null keys: known and conv, timed and turn (nulls are 0, 0), the hashes of role and text, and both of these."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    ids = [x for name, known, value in (("conv_id", "known", "conv"), ("turn", "timed", "turn")) for x in (
        F.col(name).isNotNull().cast("int").alias(known), F.coalesce(F.col(name).cast("long"), F.lit(0)).alias(value))]
    return rows.select(*ids, role.alias("role"), text.alias("text"), F.xxhash64(role, text).alias("h"), F.xxhash64(F.lit(1), role, text).alias("g"))


def _conv_id() -> Column:
    return F.when(F.col("known") == 1, F.col("conv")).alias("conv_id")


def repair(rows: DataFrame, segment_rows: int = SEGMENT_ROWS) -> tuple[DataFrame, DataFrame]:
    """Audits (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit), one row per conversation in ``rows``
    (conv_id, turn, role, text), and the repaired rows (conv_id, position, role, text)."""
    keyed = _keyed(rows)
    solid = F.rtrim("text", F.lit(STRIPPED))
    order = [*_CONV, *_TURN, "role", *_HASHES]
    narrow = materialize(keyed.select(
        *order, (F.length(solid) == 0).alias("blank"), (~F.substring(solid, -1, 1).isin(".", "!", "?")).alias("truncated"))
        .groupBy(*order, "blank", "truncated").agg(F.count(F.lit(1)).cast("int").alias("n")), "rows")
    first = narrow.groupBy(*_CONV, *_HASHES).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct(*_TURN)).alias("first")).where("n > 1")
    again = join_counted(narrow.drop("n"), materialize(first, "repeats"), [*_CONV, *_HASHES])
    later = again.where(F.struct(*_TURN) > F.col("first")).select(*order, F.lit(True).alias("later"))
    ready = materialize(narrow.join(later, order, "left").select(
        *_CONV, *_TURN, "role", F.substring("role", 1, 1).alias("initial"), *_HASHES, "blank", "truncated",
        F.coalesce("later", F.lit(False)).alias("later"), "n"), "flags")
    dealt = ready.repartitionByRange(*order).sortWithinPartitions(*order).drop("role")
    segments = materialize(dealt.mapInArrow(_segments(segment_rows), _SEGMENT_DDL), "segments")
    whole = segments.repartition(*_CONV).sortWithinPartitions(*_CONV, "part", "number")
    told = materialize(whole.mapInArrow(_compose, _EDIT_DDL), "edits")
    audits = told.where(F.col("position").isNull()).select(
        _conv_id(), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    edits = told.where(F.col("position").isNotNull())
    keys = [*_CONV, *_TURN, *_HASHES]
    texts = keyed.groupBy(*keys).agg(F.first("role").alias("role"), F.first("text").alias("text"))
    stayed = edits.where(F.col("h").isNotNull()).select(*keys, "position", "new_role").join(texts, keys).select(
        _conv_id(), "position", F.coalesce("new_role", "role").alias("role"), "text")
    put = edits.where(F.col("h").isNull()).select(_conv_id(), "position", F.col("new_role").alias("role"), F.lit("").alias("text"))
    return audits, stayed.unionByName(put)


def digests(repaired: DataFrame) -> DataFrame:
    """conv_id and the SHA-256 of each conversation's ``role:text``, joined by line feeds.

    The digest reads a conversation in order, so one task reads it, row by row as it comes out of the sort.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = digest = None

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([held[0]], pa.int64()), pa.array([digest.hexdigest()])],
                                              names=["conv_id", "repaired_sha256"])

        for batch in batches:
            for conv_id, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held != (conv_id,):
                    if held:
                        yield told()
                    held, digest = (conv_id,), hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(f"{role}:{text}".encode())
        if held:
            yield told()

    ordered = repaired.repartition("conv_id").sortWithinPartitions("conv_id", "position").select("conv_id", "role", "text")
    return ordered.mapInArrow(run, "conv_id long, repaired_sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """The contract's faults, by crc32 of ``conv_id:turn`` modulo 20: 0 drops a row, 1 empties its text, 2 takes the closing
    marks out of it, 3 repeats it, 4 makes it a user's. Nulls are read as one blank."""
    conv, turn, role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text"))
    marked = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"),
                         F.pmod(F.crc32(F.concat(conv, F.lit(":"), turn).cast("binary")), F.lit(20)).alias("fault"))
    fault = F.col("fault")
    copies = F.explode(F.array_repeat(F.lit(1), F.when(fault == 3, 2).otherwise(1)))
    return marked.where(fault != 0).select(
        "conv_id", "turn", F.when(fault == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"), copies.alias("copy")).drop("copy")
