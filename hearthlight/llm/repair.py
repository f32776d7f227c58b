"""Repair of conversation structure: the cheapest edits that lead to ``(system? (user assistant)+)?``.

A conversation's rows are read once, in order. Each row is kept, given another role, or deleted, and
turns without text may be inserted; a Viterbi search over four states (nothing yet, after system,
after user, after assistant) finds the cheapest edits, the ASCII-least ones of equal cost. The states
that survive are leaves of a tree of backpointers, whose edges are runs of edits with a count of the
leaves below: as soon as all survivors share an ancestor, the edits up to it are emitted and forgotten.
Within one state every edit leads to another state, so two survivors differ right below their last
common ancestor, and comparing those edges compares their whole unresolved edits. A survivor that
another one can follow at less cost, whatever comes, is dropped, which lets ancestors meet early.

What a task holds of a conversation is one byte an unresolved edit, besides the edits themselves
where a caller asks for them as one string; texts are not held, since each survivor carries its own
running digest, and texts join the edits afterwards. Rows are sorted by Spark, and which rows repeat an earlier one is found by an
aggregate and a join keyed by role and text, so that a conversation with a third of all rows is
spread there. Its own edits depend on each other and its digest is one chain, so the search reads it
in one task, as a stream. Rows that are equal are one row with a count.

Defined results: rows are ordered by turn (nulls first), then role and text; a null role or text is
one space; a null conversation id is a conversation like others. A row has one fault at most: it is
blank, or repeats an earlier role and text, or is truncated (does not end in ``. ! ?``). Blank and
repeated rows must go. Conversations without rows have no edits. An empty table gives no rows. Extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import chain, groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthlight.session import cut_lineage

NOTHING, SYSTEM, USER, ASSISTANT = range(4)
KEEP, REROLE, DELETE, INSERT = 0, 1, 2, 5
TRUNCATED = 5
#: Initials of roles that may follow each other.
_LEGAL = ("su", "ua", "au")
#: What it may cost a path in one state more, whatever comes, to end as well as a path in another:
#: _FOLLOW[another][one]. It makes up for a missing turn (5), deletes a system row that only a path
#: without turns can keep (2), or adds two turns at an end that a path without turns has already (10).
_FOLLOW = ((0, 10, 7, 2), (0, 0, 5, 0), (5, 5, 0, 5), (0, 10, 5, 0))
_NEXT = {"s": {NOTHING: SYSTEM}, "u": {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
_ROLE = {USER: "user", ASSISTANT: "assistant"}
#: Whose turn it is after each state.
_TURN = (USER, USER, ASSISTANT, USER)


class Edge:
    """A run of edits below a parent, and the edges below it."""

    __slots__ = ("parent", "edits", "below")

    def __init__(self, parent: Edge | None, edits: bytes):
        self.parent, self.edits, self.below = parent, bytearray(edits), 0
        if parent is not None:
            parent.below += 1


def precedes(a: Edge, x: bytes, b: Edge, y: bytes) -> bool:
    """Whether the edits that end with x below a come before those that end with y below b."""
    if a is b:
        return x < y
    above, edge = {}, a
    while edge is not None:
        above[id(edge.parent)] = edge
        edge = edge.parent
    edge = b
    while id(edge.parent) not in above:
        edge = edge.parent
    return above[id(edge.parent)].edits < edge.edits


class Search:
    """The survivors after each row of one conversation; ``sure`` gets edits once they are certain."""

    def __init__(self, sure: Callable[[bytes], object]):
        self.sure, root = sure, Edge(None, b"")
        #: By state: cost, edge, digest of what the edits leave.
        self.alive: dict[int, tuple[int, Edge, Digest]] = {NOTHING: (0, root, Digest())}

    def delete(self, times: int) -> None:
        """Rows that must go: every survivor deletes them."""
        for state, (cost, edge, digest) in self.alive.items():
            edge.edits += b"D" * times
            self.alive[state] = (cost + DELETE * times, edge, digest)
        self._settle()

    def row(self, role: str, text: str, truncated: bool) -> None:
        new: dict[int, tuple[int, Edge, bytes, int, str]] = {}

        def offer(state: int, cost: int, edge: Edge, edits: bytes, origin: int, left: str) -> None:
            old = new.get(state)
            if old is None or cost < old[0] or cost == old[0] and precedes(edge, edits, old[1], old[2]):
                new[state] = (cost, edge, edits, origin, left)

        keeps = _NEXT.get(role[:1], {})
        for origin, (cost, edge, _) in self.alive.items():
            offer(origin, cost + DELETE, edge, b"D", origin, "")
            here = cost + (TRUNCATED if truncated else 0)
            for edits, at, paid in ((b"", origin, here), (b"I", _TURN[origin], here + INSERT)):
                kept, other = keeps.get(at), _TURN[at]
                if kept is not None:
                    offer(kept, paid + KEEP, edge, edits + b"K", origin, role)
                if other != kept:
                    offer(other, paid + REROLE, edge, edits + b"R", origin, _ROLE[other])
        costs = {state: x[0] for state, x in new.items()}
        self._grow({
            state: x for state, x in new.items()
            if not any(costs[by] + _FOLLOW[state][by] < x[0] for by in costs if by != state)
        }, text)

    def _grow(self, new: dict[int, tuple[int, Edge, bytes, int, str]], text: str) -> None:
        uses = [0, 0, 0, 0]
        for x in new.values():
            uses[x[3]] += 1
        alive = {}
        for state, (cost, edge, edits, origin, role) in new.items():
            digest = self.alive[origin][2]
            if uses[origin] > 1:
                edge, digest = Edge(edge, edits), digest.copy()
            else:
                edge.edits += edits
            if role:
                if len(edits) > 1:
                    digest.add(_ROLE[_TURN[origin]], "")
                digest.add(role, text)
            alive[state] = (cost, edge, digest)
        for origin, (_, edge, _) in self.alive.items():
            if not uses[origin]:
                while edge.parent is not None:
                    edge = edge.parent
                    edge.below -= 1
                    if edge.below:
                        break
        self.alive = alive
        self._settle()

    def _settle(self) -> None:
        """An edge that is alone below its parent takes the parent's place; what is above all
        survivors is certain."""
        for _, edge, _ in self.alive.values():
            while edge.parent is not None:
                parent = edge.parent
                if parent.below == 1:
                    parent.edits += edge.edits
                    edge.edits, edge.parent = parent.edits, parent.parent
                else:
                    edge = parent
        if edge.edits:
            self.sure(bytes(edge.edits))
            edge.edits.clear()

    def end(self) -> tuple[int, Digest]:
        """The cost of the best edits and the digest of what they leave, after the rest is emitted."""
        best = None
        for state, (cost, edge, digest) in self.alive.items():
            missing = {USER: b"I", SYSTEM: b"II"}.get(state, b"")
            cost += INSERT * len(missing)
            if best is None or cost < best[0] or cost == best[0] and precedes(edge, missing, best[1], best[2]):
                best = cost, edge, missing, digest
        cost, edge, missing, digest = best
        for role in ("user", "assistant")[2 - len(missing):]:
            digest.add(role, "")
        rest = missing
        while edge is not None:
            rest, edge = bytes(edge.edits) + rest, edge.parent
        if rest:
            self.sure(rest)
        return cost, digest


class Digest:
    """SHA-256 of ``role:text`` lines, joined by newlines."""

    __slots__ = ("hash", "some")

    def __init__(self, of=None, some: bool = False):
        self.hash, self.some = of or hashlib.sha256(), some

    def copy(self) -> Digest:
        return Digest(self.hash.copy(), self.some)

    def add(self, role: str, text: str) -> None:
        self.hash.update(f"{chr(10) if self.some else ''}{role}:{text}".encode())
        self.some = True

    def hex(self) -> str:
        return self.hash.hexdigest()


def _key(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


#: Whether a text holds anything but white space, and whether that ends in a full stop or the like.
_SOME, _ENDED = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*\z"


def prepared(rows: DataFrame) -> DataFrame:
    """Distinct rows with their number and faults.

    ``rows``: conv_id, turn, role, text, n (copies of the row; with 0, the conversation is known but
    the row is not there).
    """
    merged = cut_lineage(
        rows.select(
            "conv_id", _key("conv_id").alias("conv"), "turn", F.coalesce("role", F.lit(" ")).alias("role"),
            F.coalesce("text", F.lit(" ")).alias("text"), "n",
        )
        .withColumns({c: F.when(F.col("n") > 0, F.col(c)) for c in ("role", "text")})
        .groupBy("conv_id", "conv", "turn", "role", "text").agg(F.sum("n").alias("n"))
        .withColumn("same", F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    )
    # Equal turns are one row here, so a text is first seen at its least turn.
    at = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    seen = cut_lineage(
        merged.where("n > 0").groupBy("conv", "same").agg(F.min(at).alias("first"), F.count("*").alias("times"))
        .where("times > 1").select("conv", "same", "first")
    )
    blank = ~F.col("text").rlike(_SOME)
    return merged.join(seen, ["conv", "same"], "left").select(
        "conv", "conv_id", "turn", "role", "text", "n", blank.alias("blank"),
        (F.col("first").isNotNull() & (F.col("first") < at)).alias("repeated"),
        (~F.col("text").rlike(_ENDED)).alias("truncated"),
    )


def _streamed(rows: DataFrame) -> DataFrame:
    order = F.col("turn").asc_nulls_first()
    return rows.repartition("conv").sortWithinPartitions("conv", order, "role", "text")


_COLUMNS = ("conv", "conv_id", "turn", "role", "text", "n", "blank", "repeated", "truncated")


def conversations(
    batches: Iterable[pa.RecordBatch], columns: tuple[str, ...]
) -> Iterator[tuple[pa.Array, Iterator[tuple]]]:
    """For each run of rows with one ``conv``, its conv_id (an array of one) and its rows, as a stream."""
    def rows() -> Iterator[tuple]:
        for batch in batches:
            lists = (batch.column(c).to_pylist() for c in columns)
            yield from zip(*lists, *(([batch] * len(batch), range(len(batch)))), strict=True)

    for _, group in groupby(rows(), itemgetter(0)):
        first = next(group)
        conv_id = first[-2].column("conv_id").slice(first[-1], 1)
        yield conv_id, (row[:-2] for row in chain([first], group))


def batched(rows: Iterable[tuple[pa.Array, tuple]], kinds: Sequence[pa.DataType], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Record batches of (an array of one, further values), of at most 1,024 rows and some megabytes."""
    firsts, values, size = [], [], 0
    for first, value in chain(rows, [(None, ())]):
        if values and (first is None or len(values) >= 1024 or size > 1 << 22):
            columns = [pa.array(c, k) for c, k in zip(zip(*values, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(firsts), *columns], names)
            firsts, values, size = [], [], 0
        firsts.append(first)
        values.append(value)
        size += sum(len(x) for x in value if isinstance(x, (str, list)))


def _rows_of(rows: Iterable[tuple]) -> Iterator[tuple]:
    """(turn, role, text, fault, how often): copies after the first are repeated rows of their own."""
    for _, _, turn, role, text, n, blank, repeated, truncated in rows:
        if n:
            fault = 0 if blank else 1 if repeated else 2 if truncated else None
            yield turn, role, text, fault, 1
            if n > 1:
                yield turn, role, text, 0 if blank else 1, n - 1


def _searched(search: Search, role: str, text: str, fault: int | None, times: int) -> None:
    if fault in (0, 1):
        search.delete(times)
    else:
        search.row(role, text, fault == 2)


def _audit(rows: Iterable[tuple]) -> tuple:
    edits: list[bytes] = []
    search = Search(edits.append)
    faults, illegal, turns, low, high, before = [0, 0, 0], 0, 0, None, None, None
    for turn, role, text, fault, times in _rows_of(rows):
        if turn is not None and turn != high:
            low, high, turns = turn if low is None else low, turn, turns + 1
        illegal += before is not None and before + role[:1] not in _LEGAL
        illegal += (times - 1) * (role[:1] * 2 not in _LEGAL)
        before = role[:1]
        if fault is not None:
            faults[fault] += times
        _searched(search, role, text, fault, times)
    cost, digest = search.end()
    gaps = 0 if low is None else high - low + 1 - turns
    return gaps, *faults, illegal, cost, b"".join(edits).decode(), digest.hex()


def audited(rows: DataFrame) -> DataFrame:
    """One row per conversation: what is wrong with it, the cheapest edits, and a digest of what they
    leave: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 6 + [pa.string()] * 2
        names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
        found = ((first, _audit(rows)) for first, rows in conversations(batches, _COLUMNS))
        yield from batched(found, kinds, names)

    kind = rows.schema["conv_id"].dataType.simpleString()
    return _streamed(prepared(rows)).mapInArrow(work, (
        f"conv_id {kind}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
        "cost bigint, audit string, repaired_sha256 string"
    ))


def _steps(rows: Iterable[tuple]) -> Iterator[tuple]:
    """(step, row, edit, role) of one conversation, as soon as they are certain. Rows count from 0; an
    inserted turn has none. Kept and deleted rows have the role that they have."""
    waiting, certain, row, step, state = deque(), [], 0, 0, NOTHING
    search = Search(certain.append)

    def emitted() -> Iterator[tuple]:
        nonlocal row, step, state
        for edit in b"".join(certain).decode():
            initial = None if edit == "I" else waiting.popleft()
            if edit != "D":
                state = _NEXT[initial][state] if edit == "K" else _TURN[state]
            yield step, None if edit == "I" else row, edit, _ROLE[state] if edit in "IR" else None
            row, step = row + (edit != "I"), step + 1
        certain.clear()

    for _, role, text, fault, times in _rows_of(rows):
        waiting.extend(role[:1] * times if role else [""] * times)
        _searched(search, role, text, fault, times)
        yield from emitted()
    search.end()
    yield from emitted()


def edits(rows: DataFrame) -> DataFrame:
    """conv_id, conv, step, row, edit, role: the cheapest edits of each conversation, in their order."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, names = (pa.int64(), pa.int64(), pa.string(), pa.string()), ["conv_id", "step", "row", "edit", "role"]
        for first, rows in conversations(batches, _COLUMNS):
            yield from batched(((first, step) for step in _steps(rows)), kinds, names)

    kind = rows.schema["conv_id"].dataType.simpleString()
    return _streamed(prepared(rows)).mapInArrow(work, f"conv_id {kind}, step bigint, row bigint, edit string, role string")


def _kept(rows: Iterable[tuple]) -> Iterator[tuple]:
    """(row, role, text) of the rows that need not go."""
    at = 0
    for _, role, text, fault, times in _rows_of(rows):
        if fault not in (0, 1):
            yield at, role, text
        at += times


def repaired(rows: DataFrame) -> DataFrame:
    """conv_id, step, edit, role, text: what the cheapest edits leave, in the order of the steps."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "row", "own_role", "text"]
        kinds = (pa.int64(), pa.string(), pa.string())
        for first, rows in conversations(batches, _COLUMNS):
            yield from batched(((first, row) for row in _kept(rows)), kinds, names)

    kind = rows.schema["conv_id"].dataType.simpleString()
    left = edits(rows).where("edit != 'D'").withColumn("conv", _key("conv_id"))
    texts = _streamed(prepared(rows)).mapInArrow(work, f"conv_id {kind}, row bigint, own_role string, text string")
    return left.join(texts.select(_key("conv_id").alias("conv"), "row", "own_role", "text"), ["conv", "row"], "left").select(
        "conv_id", "step", "edit", F.coalesce("role", "own_role").alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with planted damage, by the CRC-32 of ``conv_id:turn`` modulo 20: 0 drops a row, 1 empties
    its text, 2 removes full stops and the like, 3 repeats it, 4 makes it the user's."""
    code = F.pmod(F.crc32(F.concat(_key("conv_id"), F.lit(":"), _key("turn"))), F.lit(20))
    role, text = _key("role"), _key("text")
    return rows.select(
        "conv_id", "turn", F.when(code == 4, "user").otherwise(role).alias("role"),
        F.when(code == 1, "").when(code == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(code == 0, 0).when(code == 3, 2).otherwise(1).alias("n"),
    )
