"""Conversation structure repair: least-cost edits by Four-Russians block tables."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mektup.llm.common import partitions, small_first
from mektup.session import written

BLANKS = " \t\n\v\f\r"
ENDINGS = ".!?"
KEEP, REROLE, DELETE, INSERT, UNFINISHED = 0, 1, 2, 5, 5

#: States: nothing yet, after system, after user, after assistant. The first and the last may end a conversation.
STATES = 4
NEVER = 1 << 20
#: Kinds of rows: by role initial (system, user, assistant, other), the same again unfinished, and rows that must go.
SYSTEM, USER, ASSISTANT, OTHER, GONE = 0, 1, 2, 3, 8
KINDS = 9
#: Next state when a row of a role stands in a state (None: not allowed), and when the role may be chosen.
_KEPT = {(0, SYSTEM): 1, (0, USER): 2, (1, USER): 2, (3, USER): 2, (2, ASSISTANT): 3}
_CHOSEN = (2, 2, 3, 2)
ROLES = {2: "user", 3: "assistant"}

SUMMARY = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
    "audit string, repaired_sha256 string"
)
MENDED = "conv_id long, place long, edit string, role string, text string"
OPEN = "part int, piece int, chunk int, seq long, turn long, live boolean, role string, text string, fault int"


@dataclass(frozen=True)
class Limits:
    """Rows and characters that are worked on at once; longer conversations are cut into chunks."""

    rows: int = 4096
    chars: int = 4_000_000
    #: Rows of a block, whose cost vectors are looked up in one step.
    block: int = 3


Vector = tuple[int, ...]


def _inserted(v: list[int]) -> Vector:
    """Costs to go after insertions are allowed as well."""
    user, assistant = min(v[2], v[3] + INSERT), min(v[3], v[2] + INSERT)
    return tuple(min(x, NEVER) for x in (min(v[0], user + INSERT), min(v[1], user + INSERT), user, assistant))


END = _inserted([0, NEVER, NEVER, 0])
#: Costs to go when only one state is the goal; their images tell what a whole chunk does to any vector.
GOALS = [_inserted([0 if q == goal else NEVER for q in range(STATES)]) for goal in range(STATES)]


def _choices(v: Vector, kind: int, q: int) -> list[tuple[int, str, int]]:
    """(cost to go, letter, next state) of each way to use a row of this kind in state ``q``."""
    found = [(DELETE + v[q], "D", q)]
    if kind != GONE:
        extra, role = (UNFINISHED if kind > OTHER else 0), kind % 4
        if (q, role) in _KEPT:
            found.append((KEEP + extra + v[_KEPT[q, role]], "K", _KEPT[q, role]))
        found.append((REROLE + extra + v[_CHOSEN[q]], "R", _CHOSEN[q]))
    return found


def _before(v: Vector, kind: int) -> Vector:
    """Costs to go before a row, from those after it."""
    return _inserted([min(c[0] for c in _choices(v, kind, q)) for q in range(STATES)])


def _normal(v: Vector) -> tuple[Vector, int]:
    least = min(v)
    return tuple(NEVER if x >= NEVER // 2 else x - least for x in v), least


@dataclass
class Tables:
    """All normalised cost vectors, and what a row or a whole block of rows turns each of them into."""

    vectors: list[Vector]
    number: dict[Vector, int]
    one: np.ndarray  # [vector, kind] -> vector before the row
    one_cost: np.ndarray
    many: np.ndarray  # [vector, block of kinds, first row as leading digit] -> vector before the block
    many_cost: np.ndarray
    #: [vector after, kind, state] -> letters up to the row's own one, their cost, states after them
    moves: list[list[list[tuple[str, int, tuple[int, ...]]]]]


def _moves(v: Vector, kind: int, q: int) -> tuple[str, int, tuple[int, ...]]:
    """The least letters by ASCII order among the cheapest, up to and with the one that uses the row."""
    w = _before(v, kind)
    letters, cost, states = "", 0, []
    while True:
        choices = {letter: (go, then) for go, letter, then in _choices(v, kind, q)}
        choices["I"] = (INSERT + w[_CHOSEN[q]], _CHOSEN[q])
        letter = next((x for x in "DIKR" if x in choices and choices[x][0] == w[q] < NEVER // 2), "")
        if not letter:
            return "", NEVER, ()  # a state from which this goal cannot be reached
        go, then = choices[letter]
        letters += letter
        states.append(then)
        cost += w[q] - (w[then] if letter == "I" else v[then])
        q = then
        if letter != "I":
            return letters, cost, tuple(states)


@cache
def tables(block: int) -> Tables:
    number: dict[Vector, int] = {}
    vectors: list[Vector] = []

    def known(v: Vector) -> int:
        if v not in number:
            number[v] = len(vectors)
            vectors.append(v)
        return number[v]

    for v in (END, *GOALS):
        known(_normal(v)[0])
    one, one_cost, at = [], [], 0
    while at < len(vectors):
        steps = [_normal(_before(vectors[at], kind)) for kind in range(KINDS)]
        one.append([known(v) for v, _ in steps])
        one_cost.append([c for _, c in steps])
        at += 1
    first, first_cost = np.array(one), np.array(one_cost)
    many, many_cost = first, first_cost
    for _ in range(block - 1):  # a further row in front of the block
        cost = first_cost[many] + many_cost[:, :, None]
        after = first[many]
        size = many.shape[1]
        many = after.transpose(0, 2, 1).reshape(len(vectors), size * KINDS)
        many_cost = cost.transpose(0, 2, 1).reshape(len(vectors), size * KINDS)
    moves = [[[_moves(v, kind, q) for q in range(STATES)] for kind in range(KINDS)] for v in vectors]
    return Tables(vectors, number, first, first_cost, many, many_cost, moves)


def _codes(kinds: list[int], block: int) -> np.ndarray:
    whole = len(kinds) // block * block
    digits = np.array(kinds[:whole], dtype=np.int64).reshape(-1, block)
    return digits @ (KINDS ** np.arange(block - 1, -1, -1))


def backward(kinds: list[int], after: int, block: int) -> tuple[list[int], int, int]:
    """Vectors after each whole block, from the one after all rows; then the vector before all rows and its cost."""
    t = tables(block)
    cost, v = 0, after
    for kind in reversed(kinds[len(kinds) // block * block :]):
        cost += int(t.one_cost[v, kind])
        v = int(t.one[v, kind])
    borders = []
    for code in _codes(kinds, block)[::-1].tolist():
        borders.append(v)
        cost += int(t.many_cost[v, code])
        v = int(t.many[v, code])
    return borders[::-1], v, cost


def trace(kinds: list[int], after: int, q: int, block: int) -> Iterator[tuple[str, int, tuple[int, ...]]]:
    """For each row the letters up to it, their cost and the states after them; blocks are expanded from their right border."""
    t = tables(block)
    borders, _, _ = backward(kinds, after, block)
    for k in range(-(-len(kinds) // block)):
        part = kinds[k * block : (k + 1) * block]
        inside = [borders[k] if k < len(borders) else after]
        for kind in reversed(part[1:]):
            inside.append(int(t.one[inside[-1], kind]))
        for kind, v in zip(part, reversed(inside)):
            move = t.moves[v][kind][q]
            yield move
            if not move[2]:
                return
            q = move[2][-1]


def ending(q: int) -> tuple[str, tuple[int, ...]]:
    """Insertions that end a conversation in state ``q``."""
    states: list[int] = []
    while q not in (0, 3):
        q = _CHOSEN[q]
        states.append(q)
    return "I" * len(states), tuple(states)


def fault(role: str, text: str) -> int:
    """The kind of a row by itself; repeats are found elsewhere. A blank row must go."""
    bare = text.rstrip(BLANKS)
    if not bare:
        return GONE
    role_kind = {"s": SYSTEM, "u": USER, "a": ASSISTANT}.get(role[:1], OTHER)
    return role_kind + (0 if bare[-1] in ENDINGS else 4)


@dataclass
class Told:
    """What is known of some adjacent rows of a conversation."""

    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    turns: int = 0
    first_turn: int | None = None
    last_turn: int | None = None
    first_role: str | None = None
    last_role: str | None = None
    cost: int = 0
    audit: list[str] = field(default_factory=list)

    def row(self, turn: int | None, role: str, kind: int, repeated: bool) -> None:
        initial = role[:1]
        self.blank += kind == GONE
        self.duplicate += kind != GONE and repeated
        self.truncated += GONE > kind > OTHER and not repeated
        one = Told(first_role=initial, last_role=initial)
        if turn is not None:
            one.turns, one.first_turn, one.last_turn = 1, turn, turn
        self.follow(one)

    def follow(self, other: Told) -> None:
        """Add the rows after these."""
        self.blank += other.blank
        self.duplicate += other.duplicate
        self.truncated += other.truncated
        self.cost += other.cost
        self.audit += other.audit
        self.illegal += other.illegal
        if other.first_role is not None:
            if self.last_role is not None:
                self.illegal += self.last_role + other.first_role not in ("su", "ua", "au")
            else:
                self.first_role = other.first_role
            self.last_role = other.last_role
        if other.first_turn is not None:
            self.turns += other.turns - (self.last_turn == other.first_turn)
            self.first_turn = other.first_turn if self.first_turn is None else self.first_turn
            self.last_turn = other.last_turn

    def gaps(self) -> int:
        return 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.turns


@dataclass
class Rows:
    """Live rows of a conversation or of a chunk of one, in order."""

    turns: list = field(default_factory=list)
    roles: list[str] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    faults: list[int] = field(default_factory=list)
    repeated: list[bool] = field(default_factory=list)

    def kinds(self) -> list[int]:
        return [GONE if again else kind for kind, again in zip(self.faults, self.repeated)]

    def edited(self, after: int, q: int, block: int, last: bool) -> tuple[Told, list[tuple[str, str, str]], int]:
        """What is known of these rows, the rows to keep as (letter, role, text), and the state after them."""
        told, out = Told(), []
        for row in zip(self.turns, self.roles, self.faults, self.repeated):
            told.row(*row)
        steps = trace(self.kinds(), after, q, block)
        for (letters, cost, states), role, text in zip(steps, self.roles, self.texts):
            told.audit.append(letters)
            told.cost += cost
            for letter, state in zip(letters, states):
                if letter != "D":
                    out.append((letter, role if letter == "K" else ROLES[state], "" if letter == "I" else text))
            q = states[-1]
        if last:
            letters, states = ending(q)
            told.audit.append(letters)
            told.cost += INSERT * len(letters)
            out += [("I", ROLES[state], "") for state in states]
        return told, out, q


def _bytes(out: list[tuple[str, str, str]]) -> list[bytes]:
    return [f"{role}:{text}".encode("utf-8", "surrogatepass") for _, role, text in out]


def _summary(conv_id: int | None, told: Told, digest: str) -> tuple:
    return (
        conv_id, told.gaps(), told.blank, told.duplicate, told.truncated, told.illegal, told.cost,
        "".join(told.audit), digest,
    )


def _schema(text: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
    kinds["ints"] = pa.list_(pa.int32())
    return pa.schema([(name, kinds["ints" if kind.startswith("array") else kind]) for name, kind in (c.split() for c in text.split(", "))])


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 2048) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


Solved = Callable[[int | None, Told, list[tuple[str, str, str]]], Iterator[tuple]]


def _summed(conv: int | None, told: Told, out: list[tuple[str, str, str]]) -> Iterator[tuple]:
    yield _summary(conv, told, hashlib.sha256(b"\n".join(_bytes(out))).hexdigest())


def _kept(conv: int | None, told: Told, out: list[tuple[str, str, str]], first: int = 0) -> Iterator[tuple]:
    for place, row in enumerate(out, start=first):
        yield conv, place, *row


class _Pieces:
    """Cuts the sorted rows of a partition into conversations; those that may go on elsewhere stay open."""

    def __init__(self, limits: Limits, solved: Solved, width: int):
        self.limits, self.solved, self.width = limits, solved, width
        self.part = TaskContext.get().partitionId()

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held: list[tuple] = []  # rows of the conversation at hand
        chars, conv, piece, open_, chunk, seq = 0, None, -1, True, 0, 0
        def flush_open() -> Iterator[tuple]:
            nonlocal held, chars, chunk, seq
            for turn, live, role, text in held:
                yield (conv, *[None] * (self.width - 1), self.part, piece, chunk, seq, turn, live, role, text, fault(role, text))
                seq += 1
            held, chars, chunk = [], 0, chunk + 1

        for batch in batches:
            for own, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if piece < 0 or own != conv:
                    if piece >= 0 and (piece == 0 or chunk):
                        yield from flush_open()
                    elif piece >= 0:
                        for found in self._closed(conv, held):
                            yield (*found, *[None] * len(OPEN.split(", ")))
                        held, chars = [], 0
                    conv, piece, chunk, seq = own, piece + 1, 0, 0
                elif len(held) >= self.limits.rows or chars >= self.limits.chars:
                    yield from flush_open()
                held.append(tuple(row))
                chars += len(row[3])
        if piece >= 0:
            yield from flush_open()

    def _closed(self, conv: int | None, held: list[tuple]) -> Iterator[tuple]:
        rows, seen = Rows(), set()
        for turn, live, role, text in held:
            if live:
                rows.turns.append(turn)
                rows.roles.append(role)
                rows.texts.append(text)
                rows.faults.append(fault(role, text))
                rows.repeated.append((role, text) in seen)
                seen.add((role, text))
        t = tables(self.limits.block)
        told, out, _ = rows.edited(t.number[END], 0, self.limits.block, True)
        return self.solved(conv, told, out)


def _ordered(turns: DataFrame) -> DataFrame:
    """Rows in ranges of (conversation, turn, role, text), so that a long conversation lies in several partitions."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit(" ")), F.coalesce(F.col("text").cast("string"), F.lit(" "))
    live = F.coalesce(F.col("live"), F.lit(True)) if "live" in turns.columns else F.lit(True)
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        live.alias("live"), role.alias("role"), text.alias("text"),
    )
    ranged = rows.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 32))
    return ranged.sortWithinPartitions("conv_id", "turn", "role", "text")


def _with_repeats(rows: DataFrame) -> DataFrame:
    """``rows`` with ``repeated``: whether the conversation has the same role and text before."""
    same = F.sha2(F.to_json(F.struct(F.col("conv_id").cast("string"), "role", "text")), 256)
    marked = rows.withColumn("same", F.when(F.col("live"), same))
    firsts = (
        marked.where("live")
        .groupBy("same")
        .agg(F.min(F.struct("part", "seq")).alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select(F.col("same").alias("known"), "first")
    )
    joined = small_first(marked, written(firsts, "repeated-turns"), F.col("same") == F.col("known"), "left")
    repeated = F.col("first").isNotNull() & (F.struct("part", "seq") != F.col("first"))
    return joined.withColumn("repeated", F.coalesce(repeated, F.lit(False))).drop("same", "known", "first")


def _in_order(chunks: DataFrame, column: Column, out: str, step: Callable[[list[list[int]]], list[list[int]]]) -> DataFrame:
    """For every conversation the narrow values of its chunks in order, turned into as many other values."""
    listed = chunks.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", "piece", "chunk", column.alias("v")))).alias("c"))
    schema = f"part int, piece int, chunk int, {out} array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for found in batch.column(0).to_pylist():
                    for chunk, value in zip(found, step([c["v"] for c in found])):
                        yield chunk["part"], chunk["piece"], chunk["chunk"], value

        yield from _batches(rows(), _schema(schema))

    return listed.select("c").mapInArrow(run, schema)


def _images(chunks: DataFrame, limits: Limits) -> DataFrame:
    """What each chunk makes of the costs to go: costs before it by state, for each single goal state after it."""
    schema = "conv_id long, part int, piece int, chunk int, image array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tables(limits.block)
        goals = [_normal(g) for g in GOALS]

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for *key, kinds in zip(*(c.to_pylist() for c in batch.columns)):
                    image = []
                    for goal, extra in goals:
                        _, v, cost = backward(kinds, t.number[goal], limits.block)
                        image += [min(NEVER, x + cost + extra) if x < NEVER // 2 else NEVER for x in t.vectors[v]]
                    yield *key, image

        yield from _batches(rows(), _schema(schema))

    return chunks.select("conv_id", "part", "piece", "chunk", "kinds").mapInArrow(run, schema)


def _vectors_after(images: list[list[int]]) -> list[list[int]]:
    """The normalised costs to go after each chunk."""
    v, found = _normal(END)[0], []
    for image in reversed(images):
        found.append(list(v))
        v = _normal(tuple(min(image[g * STATES + q] + v[g] for g in range(STATES)) for q in range(STATES)))[0]
    return found[::-1]


def _exits(chunks: DataFrame, limits: Limits) -> DataFrame:
    """The state after each chunk, for each state before it (-1: not on a cheapest way)."""
    schema = "conv_id long, part int, piece int, chunk int, exits array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tables(limits.block)

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for *key, kinds, after in zip(*(c.to_pylist() for c in batch.columns)):
                    exits = []
                    for q in range(STATES):
                        for _, _, states in trace(kinds, t.number[tuple(after)], q, limits.block):
                            q = states[-1] if states else -1
                        exits.append(q)
                    yield *key, exits

        yield from _batches(rows(), _schema(schema))

    return chunks.select("conv_id", "part", "piece", "chunk", "kinds", "after").mapInArrow(run, schema)


def _states_before(exits: list[list[int]]) -> list[list[int]]:
    """The state before each chunk, and 1 for the last chunk of the conversation."""
    q, found = 0, []
    for k, options in enumerate(exits):
        found.append([q, int(k == len(exits) - 1)])
        q = options[q]
    return found


_TOLD = (
    "blank int, duplicate int, truncated int, illegal int, turns long, first_turn long, last_turn long, "
    "first_role string, last_role string, cost long"
)


def _traced(chunks: DataFrame, limits: Limits) -> DataFrame:
    """Each chunk's part of the result: its counts, its letters and the rows it leaves, as one run of bytes."""
    schema = f"conv_id long, part int, chunk int, {_TOLD}, audit string, rest binary"
    names = [c.split()[0] for c in _TOLD.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tables(limits.block)

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for conv, part, chunk, found, after, (q, last) in zip(*(c.to_pylist() for c in batch.columns)):
                    held = Rows(*([r[c] for r in found] for c in ("turn", "role", "text", "fault", "repeated")))
                    told, out, _ = held.edited(t.number[tuple(after)], q, limits.block, bool(last))
                    rest = b"".join(b"\n" + x for x in _bytes(out))
                    yield conv, part, chunk, *(getattr(told, n) for n in names), "".join(told.audit), rest

        yield from _batches(rows(), _schema(schema), 16)

    return chunks.select("conv_id", "part", "chunk", "rows", "after", "before").mapInArrow(run, schema)


def _joined(traced: DataFrame) -> DataFrame:
    """One row for each conversation from the parts of its chunks, which pass by in order and are not held."""
    ordered = traced.repartition(partitions(traced.sparkSession), "conv_id").sortWithinPartitions("conv_id", "part", "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            conv, told, digest, started = None, None, None, False
            for batch in batches:
                for own, _, _, *about, audit, rest in zip(*(c.to_pylist() for c in batch.columns)):
                    if told is None or own != conv:
                        if told is not None:
                            yield _summary(conv, told, digest.hexdigest())
                        conv, told, digest, started = own, Told(), hashlib.sha256(), False
                    told.follow(Told(*about, audit=[audit]))
                    digest.update(rest if started else rest[1:])
                    started = started or bool(rest)
            if told is not None:
                yield _summary(conv, told, digest.hexdigest())

        yield from _batches(rows(), _schema(SUMMARY))

    return ordered.mapInArrow(run, SUMMARY)


def _open(pieces: DataFrame, limits: Limits) -> DataFrame:
    """Chunks of the open conversations (conv_id, part, piece, chunk, rows, kinds, after, before), fit to be traced each on its own."""
    rows = _with_repeats(pieces)
    fields = F.struct("seq", "turn", "role", "text", "fault", "repeated")
    chunks = rows.groupBy("conv_id", "part", "piece", "chunk").agg(
        F.array_sort(F.collect_list(F.when(F.col("live"), fields)), lambda a, b: a["seq"].cast("int") - b["seq"].cast("int")).alias("rows")
    )
    kinds = F.transform("rows", lambda r: F.when(r["repeated"], F.lit(GONE)).otherwise(r["fault"]))
    chunks = written(chunks.withColumn("kinds", kinds), "chunks")
    key = ["part", "piece", "chunk"]
    after = written(_in_order(_images(chunks, limits), F.col("image"), "after", _vectors_after), "vectors")
    chunks = chunks.join(after, key)
    before = written(_in_order(_exits(chunks, limits), F.col("exits"), "before", _states_before), "states")
    return chunks.join(before, key)


def repair(turns: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row for every conversation: its faults, the cheapest edits and a digest of what they leave.

    ``turns`` has conv_id, turn, role, text, and may have ``live``: rows where it is false only
    keep their conversation in the result. Rows are taken by turn (nulls first), then role and
    text; null roles and texts count as one blank. The first fault of a row counts: blank
    (nothing but white space), duplicate (role and text came before), truncated (the last
    character but white space is none of ``.!?``). Edits: keep (0), rerole to user or assistant
    (1), delete (2; blank and duplicate rows must go) and insert an empty turn (5); a truncated
    row that stays costs 5 more. The cheapest edits that leave ``(s?(ua)+)?`` by role initials
    are told as letters, K, R, D and I; of equally cheap ones those whose letters come first in
    ASCII order. gaps counts missing turn numbers, illegal adjacent roles other than su, ua, au.
    A conversation without live rows has zeros and an empty audit; null ids are one
    conversation; rows that repeat are duplicates; an empty table gives no rows. Other columns
    are not read.

    Costs to go from the four states form few vectors once their least is taken off, so tables
    hold what each block of ``limits.block`` row kinds does to each vector. A conversation is
    looked up from its end block by block; from the left, each block is then expanded backward
    to its inner vectors and traced by the least letter that stays cheapest.

    Rows are sorted in ranges, so that a conversation of any length is spread over partitions.
    One that lies inside a partition is solved there. Others are cut into chunks: the tables give
    each chunk's effect on any vector, the effects of a conversation are composed in order, and
    all chunks are traced at once. Only the digest passes over the pieces of a conversation one
    by one, without holding them.
    """
    closed, rest = _solved(turns, limits, _summed, SUMMARY)
    return closed.unionByName(_joined(_traced(_open(rest, limits), limits)))


def mended(turns: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The repaired conversations themselves: conv_id, place, edit, role and text of every turn that stays or is put in.

    place orders the turns of a conversation (it may skip numbers); edit is K, R or I. All else
    is as in `repair`, of which this is the result in full.
    """
    closed, rest = _solved(turns, limits, _kept, MENDED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tables(limits.block)

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for conv, part, chunk, found, after, (q, last) in zip(*(c.to_pylist() for c in batch.columns)):
                    held = Rows(*([r[c] for r in found] for c in ("turn", "role", "text", "fault", "repeated")))
                    told, out, _ = held.edited(t.number[tuple(after)], q, limits.block, bool(last))
                    # room for a row put in before each row and two at the end
                    yield from _kept(conv, told, out, ((part << 28) + chunk) * (2 * limits.rows + 2))

        yield from _batches(rows(), _schema(MENDED))

    chunks = _open(rest, limits).select("conv_id", "part", "chunk", "rows", "after", "before")
    return closed.unionByName(chunks.mapInArrow(run, MENDED))


def _solved(turns: DataFrame, limits: Limits, solved: Solved, schema: str) -> tuple[DataFrame, DataFrame]:
    """Results of the conversations that lie inside a partition, and the rows of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _Pieces(limits, solved, len(schema.split(", ")))
        # the rows' own columns are named apart from those of the result
        yield from _batches(pieces(batches), _schema(f"{schema}, {own}"))

    own = ", ".join(f"own_{c}" for c in OPEN.split(", "))
    pieces = written(_ordered(turns).mapInArrow(run, f"{schema}, {own}"), "conversations")
    rest = [F.col(f"own_{c.split()[0]}").alias(c.split()[0]) for c in OPEN.split(", ")]
    closed = pieces.where(F.col("own_part").isNull()).select(*[c.split()[0] for c in schema.split(", ")])
    return closed, pieces.where(F.col("own_part").isNotNull()).select("conv_id", *rest)
