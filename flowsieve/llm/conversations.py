"""Conversation repair by a Viterbi search that emits edits as soon as they are certain.

A conversation is to read ``(system? (user assistant)+)?``.  Each row is kept (K, free), given the role that
fits (R, 3) or deleted (D, 4); empty rows of user or assistant may be inserted anywhere (I, 3).  Blank rows and those
that repeat role and text of an earlier row must be deleted; a truncated row costs 3 more unless it is.  The cheapest
edits win, of equally cheap ones those whose letters are least.

The search goes through the rows in order with one survivor per state: nothing yet, after system, after user,
after assistant.  Survivors are leaves of a tree of backpointers whose nodes count their references.  A
survivor that loses gives its reference up, and with it every node only it needed; so does one that costs more
than another whose every future is open to it as well.  A node with one child is merged into it.  Once all survivors descend from one child of the root, the edits up to there are certain: they are
emitted and leave memory together with their rows.  Equal costs are settled by comparing the whole unresolved
suffixes of the two survivors from where they part.

Conversations are spread by id.  Faults are found by a window over equal rows of a conversation and the rows then sorted by
turn, both on the one shuffle by id and by Spark's sort, which spills; tasks read the sorted rows as a stream, so a
conversation of any length is never gathered.  In memory are the rows between the first and the last
uncertain edit.  One conversation is one task's work: the order of its edits is one chain.

Rows are taken by turn (nulls first), then role, then text.  Null roles and texts count as one space, null ids form one
conversation.  A role's first character decides; any other than s, u and a cannot be kept.  An
empty table gives no row, very long texts are single cells of the stream, and columns other than
``conv_id``, ``turn``, ``role`` and ``text`` are not read, whatever they are called.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from hashlib import sha256
from itertools import chain, zip_longest

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RECAST = INSERT = TRUNCATED = 3
DELETE = 4
WHITE = " \t\n\x0b\x0c\r"
ENDINGS = ".!?"
LEGAL = ("su", "ua", "au")

START, SYSTEM, USER, ASSISTANT = range(4)
# Where a row of that initial leads, by state.
MOVES = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
FITTING = {START: "user", SYSTEM: "user", ASSISTANT: "user", USER: "assistant"}

# Rows and characters of a batch that leaves a task.
BATCH_ROWS = 5_000
BATCH_CHARS = 4_000_000

EDITS = "step bigint, edit string, turn bigint, old_role string, role string, text string, fault string, cost bigint"
DIGEST = "gaps string, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


class Node:
    """Edits ``(letter, role)`` that follow those of ``parent``; ``refs`` counts children and the states that stand here."""

    __slots__ = ("edits", "parent", "refs")

    def __init__(self, parent: Node | None, edits: list[tuple[str, str | None]]) -> None:
        self.parent, self.edits, self.refs = parent, edits, 0
        if parent:
            parent.refs += 1


def _path(node: Node) -> list[Node]:
    found = [node]
    while node.parent:
        node = node.parent
        found.append(node)
    return found[::-1]


def _letters(nodes: list[Node], last: str) -> Iterator[str]:
    return chain((letter for node in nodes for letter, _ in node.edits), last)


def precedes(a: Node, last_a: str, b: Node, last_b: str) -> bool:
    """Whether the letters up to ``a`` and ``last_a`` are less than those up to ``b`` and ``last_b``."""
    left, right = _path(a), _path(b)
    same = 0
    while same < min(len(left), len(right)) and left[same] is right[same]:
        same += 1
    for x, y in zip_longest(_letters(left[same:], last_a), _letters(right[same:], last_b), fillvalue=""):
        if x != y:
            return x < y
    return False


class Repair:
    """The search over one conversation: ``row`` for each row and ``end`` return the edits that became certain."""

    def __init__(self) -> None:
        self.root = Node(None, [])
        self.states: dict[int, tuple[int, Node]] = {START: (0, self.root)}
        self.root.refs = 1

    def row(self, initial: str, fault: str | None) -> list[tuple[str, str | None]]:
        self._inserted()
        best: dict[int, tuple[int, Node, str, str | None]] = {}
        extra = TRUNCATED if fault == "truncated" else 0
        for state, (cost, node) in self.states.items():
            self._offer(best, state, cost + DELETE, node, "D", None)
            if fault not in ("blank", "duplicate"):
                if state in MOVES.get(initial, ()):
                    self._offer(best, MOVES[initial][state], cost + extra, node, "K", None)
                role = FITTING[state]
                self._offer(best, MOVES[role[0]][state], cost + RECAST + extra, node, "R", role)
        self._survive({s: (cost, Node(node, [(letter, role)])) for s, (cost, node, letter, role) in best.items()})
        return self._certain()

    def end(self) -> list[tuple[str, str | None]]:
        self._inserted()
        ends = [self.states[s] for s in (START, ASSISTANT) if s in self.states]
        best = ends[0]
        for other in ends[1:]:
            if other[0] < best[0] or (other[0] == best[0] and precedes(other[1], "", best[1], "")):
                best = other
        return [edit for node in _path(best[1]) for edit in node.edits]

    @staticmethod
    def _offer(best: dict, state: int, cost: int, node: Node, letter: str, role: str | None) -> None:
        held = best.get(state)
        if held is None or cost < held[0] or (cost == held[0] and precedes(node, letter, held[1], held[2])):
            best[state] = (cost, node, letter, role)

    def _inserted(self) -> None:
        """Survivors that gain by inserted rows; more than two in a row never pay."""
        states = dict(self.states)
        for sources, target in (((START, SYSTEM, ASSISTANT), USER), ((USER,), ASSISTANT)):
            for source in sources:
                if source in states:
                    cost, node = states[source]
                    role, held = FITTING[source], states.get(target)
                    if held is None or cost + INSERT < held[0] or (cost + INSERT == held[0] and precedes(node, "I", held[1], "")):
                        states[target] = (cost + INSERT, Node(node, [("I", role)]))
        # What follows the start or a system row can follow a full exchange as well, but for one system row, which then goes.
        full = states[ASSISTANT][0] if ASSISTANT in states else None
        for state, more in ((START, DELETE), (SYSTEM, 0)):
            if full is not None and state in states and full + more < states[state][0]:
                del states[state]
        self._survive(states)

    def _survive(self, states: dict[int, tuple[int, Node]]) -> None:
        old, self.states = self.states, states
        for _, node in states.values():
            node.refs += 1
        for _, node in old.values():
            node.refs -= 1
        for _, node in old.values():
            self._release(node)

    @staticmethod
    def _release(node: Node) -> None:
        while node.refs == 0 and node.parent:
            parent, node.parent = node.parent, None
            parent.refs -= 1
            node = parent

    def _certain(self) -> list[tuple[str, str | None]]:
        """Merges nodes with one child; the edits all survivors share are returned and become the root."""
        out: list[tuple[str, str | None]] = []
        for _, node in self.states.values():
            while node.parent:
                parent = node.parent
                if parent.refs > 1:
                    node = parent
                elif parent is self.root:
                    out, node.edits, node.parent, self.root = out + node.edits, [], None, node
                else:
                    parent.edits.extend(node.edits)
                    node.edits, node.parent = parent.edits, parent.parent
        return out


def damage(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text)`` after faults that the checksum of id and turn decides."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ENDINGS, "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    rows = rows.where(F.col("kind") != 0).withColumn("copy", F.explode(copies))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"))


def faults(rows: DataFrame) -> DataFrame:
    """``rows(conv_id, turn, role, text)`` with the first fault of each, every conversation in one partition."""
    filled = rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")])
    said: Column = F.rtrim("text", F.lit(WHITE))
    same = Window.partitionBy("conv_id", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    seen = filled.repartition("conv_id").withColumn("seen", F.row_number().over(same))
    fault = (
        F.when(said == "", "blank")
        .when(F.col("seen") > 1, "duplicate")
        .when(~F.right(said, F.lit(1)).isin(*ENDINGS), "truncated")
    )
    return seen.select("conv_id", "turn", "role", "text", fault.alias("fault"))


def _columns(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(c.to_pylist() for c in batch.columns))


def repair(rows: DataFrame) -> DataFrame:
    """The edits of every conversation of ``rows``, in order: ``conv_id, step, edit, turn, old_role, role, text, fault, cost``.

    ``role`` and ``text`` are what stands after the edit, null where a row is deleted; inserted rows have no turn
    and no old role.  A conversation's edits follow each other in one partition.
    """
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    ordered = faults(rows).sortWithinPartitions(*order)
    kinds = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, {EDITS}"

    def edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, search, at, waiting, out, step, chars = None, None, None, deque(), [], 0, 0

        def take(certain: list[tuple[str, str | None]]) -> None:
            nonlocal step, chars
            for letter, role in certain:
                step += 1
                if letter == "I":
                    out.append((at, step, "I", None, None, role, "", None, INSERT))
                    continue
                turn, old, text, fault = waiting.popleft()
                chars += len(text)
                if letter == "D":
                    out.append((at, step, "D", turn, old, None, None, fault, DELETE))
                else:
                    cost = (RECAST if letter == "R" else 0) + (TRUNCATED if fault == "truncated" else 0)
                    out.append((at, step, letter, turn, old, role or old, text, fault, cost))

        def batch_of(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), schema.types)], schema=schema)

        for batch in batches:
            if schema is None:
                whole, text = pa.int64(), pa.string()
                names = ["conv_id", *[kind.split()[0] for kind in EDITS.split(", ")]]
                schema = pa.schema(list(zip(names, [batch.schema.field("conv_id").type, whole, text, whole, text, text, text, text, whole])))
            for conv, turn, role, said, fault in _columns(batch):
                if search is None or conv != at:
                    if search:
                        take(search.end())
                    search, at, step = Repair(), conv, 0
                waiting.append((turn, role, said, fault))
                take(search.row(role[:1], fault))
                if len(out) >= BATCH_ROWS or chars >= BATCH_CHARS:
                    yield batch_of(out)
                    out.clear()
                    chars = 0
        if search:
            take(search.end())
        if out:
            yield batch_of(out)

    return ordered.select("conv_id", "turn", "role", "text", "fault").mapInArrow(edits, kinds)


def digest(edits: DataFrame) -> DataFrame:
    """One row per conversation of ``edits`` as ``repair`` returns them: faults, cost, letters and the hash of the result.

    Only running values are held: the hash takes each text as it comes.
    """

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, id_type = None, None
        done: list[tuple] = []

        def close() -> None:
            low, high, turns = one["low"], one["high"], one["turns"]
            gaps = str(high - low + 1 - turns) if turns else "0"
            counts = [one[k] for k in ("blank", "duplicate", "truncated", "illegal", "cost")]
            done.append((one["conv"], gaps, *counts, one["audit"].decode(), one["sha"].hexdigest()))

        def batch_of(found: list[tuple]) -> pa.RecordBatch:
            types = [id_type, pa.string(), *[pa.int64()] * 5, pa.string(), pa.string()]
            names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], names)

        for batch in batches:
            id_type = batch.schema.field("conv_id").type
            for conv, step, edit, turn, old, role, text, fault, cost in _columns(batch):
                if step == 1:
                    if one:
                        close()
                    one = {"conv": conv, "low": None, "high": None, "turns": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
                    one |= {"cost": 0, "audit": bytearray(), "sha": sha256(), "before": None, "lines": 0}
                one["audit"] += edit.encode()
                one["cost"] += cost
                if edit != "I":
                    if one["before"] is not None and one["before"] + old[:1] not in LEGAL:
                        one["illegal"] += 1
                    one["before"] = old[:1]
                    if fault:
                        one[fault] += 1
                    if turn is not None and turn != one["high"]:
                        one["low"] = turn if one["low"] is None else one["low"]
                        one["high"], one["turns"] = turn, one["turns"] + 1
                if edit != "D":
                    one["sha"].update(f"{chr(10) if one['lines'] else ''}{role}:{text}".encode())
                    one["lines"] += 1
            if len(done) >= BATCH_ROWS:
                yield batch_of(done)
                done.clear()
        if one:
            close()
        if done:
            yield batch_of(done)

    id_type = edits.schema["conv_id"].dataType.simpleString()
    found = edits.mapInArrow(digested, f"conv_id {id_type}, {DIGEST}")
    return found.withColumn("gaps", F.expr("try_cast(gaps AS bigint)"))


def repaired(rows: DataFrame, conv_ids: DataFrame) -> DataFrame:
    """``digest`` for every id of ``conv_ids(conv_id)``, also those without a row."""
    found = digest(repair(rows)).withColumnRenamed("conv_id", "found")
    ids = conv_ids.select("conv_id").distinct()
    joined = ids.join(found, F.col("conv_id").eqNullSafe(F.col("found")), "left").drop("found")
    nothing = {c: F.lit(0).cast("bigint") for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    nothing |= {"audit": F.lit(""), "repaired_sha256": F.lit(sha256().hexdigest())}
    # A number of gaps beyond 64 bits stays null.
    there = F.col("audit").isNotNull()
    return joined.select("conv_id", *[F.when(there, F.col(c)).otherwise(v).alias(c) for c, v in nothing.items()])
