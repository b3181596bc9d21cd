"""Repair of conversation structure: generalised LR parsing of the roles, with weighted edits.

Rows of a conversation are read by role initial. A keep shifts a row as it is, a rerole as another role, a delete skips it, an
insert shifts a role that has no row. The parser keeps every stack that some sequence of edits leads to in a graph: a node is
an LR state on the node below it, equal stack tops are one node, held at the minimum (cost, audit), where the audit is the
string of edits so far. Of two equally cheap audits for the same rows neither begins the other, so the smaller one stays
the smaller whatever follows, and keeping the minimum of each top is exact.

At scale. Rows are dealt by ranges of (conversation, turn), so a conversation of any length lies on many tasks. It is
parsed in blocks of BLOCK rows from every stack it could begin with (the grammar's stacks are few and enumerated); the blocks'
results are small and are put together in order. Only the hash of the repaired text, which is sequential by definition, reads a
conversation in one stream, a row at a time.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonewise.llm import common

# The role grammar: (s?(ua)+)? as left-recursive productions.
GRAMMAR = (("Doc", ""), ("Doc", "P"), ("Doc", "sP"), ("P", "T"), ("P", "PT"), ("T", "ua"))
# Roles that a rerole or an insert may give, by initial.
GIVEN = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
# Kinds of rows: sound, blank, duplicate (both must go), truncated.
SOUND, BLANK, DUPLICATE, CUT = range(4)
# Rows parsed in one block, and rows of those whose results are remembered.
BLOCK, SHORT = 1024, 12
END = "$"


class Parser:
    """SLR tables of a grammar whose nonterminals begin with a capital, and its nodes of stacks (state, node below)."""

    def __init__(self, grammar: tuple[tuple[str, str], ...] = GRAMMAR):
        start = grammar[0][0]
        rules = [("Start", (start,))]
        names = {head for head, _ in grammar}
        for head, body in grammar:
            rules.append((head, tuple(body)))
        self.rules = rules
        follow = self._follow(rules, names | {"Start"})
        self.states: list[frozenset] = []
        self.goto: dict[tuple[int, str], int] = {}
        self._number(self._closed({(0, 0)}, names))
        for state in self.states:
            here = self._number(state)
            onward: dict[str, set] = {}
            for rule, dot in state:
                body = rules[rule][1]
                if dot < len(body):
                    onward.setdefault(body[dot], set()).add((rule, dot + 1))
            for symbol, items in sorted(onward.items()):
                self.goto[here, symbol] = self._number(self._closed(items, names))
        # Reductions of a state: (rule, symbols they may stand before).
        self.reductions = [
            [(r, follow[rules[r][0]]) for r, dot in sorted(s) if dot == len(rules[r][1]) and r] for s in self.states
        ]
        self.accepting = {k for k, s in enumerate(self.states) if (0, 1) in s}
        self.nodes: list[tuple[int, int]] = [(0, -1)]
        self.known = {(0, -1): 0}
        self.moves: dict[tuple[int, str], tuple[int, ...]] = {}
        self.terminals = sorted({c for _, body in rules[1:] for c in body if c not in names})
        self.tops: list[int] = []

    @staticmethod
    def _follow(rules, names):
        nullable, first = set(), {n: set() for n in names}
        follow = {n: set() for n in names}
        follow["Start"].add(END)
        changed = True
        while changed:
            before = (len(nullable), sum(map(len, first.values())), sum(map(len, follow.values())))
            for head, body in rules:
                if all(s in nullable for s in body):
                    nullable.add(head)
                for s in body:
                    first[head] |= first.get(s, {s})
                    if s not in nullable:
                        break
                tail = set(follow[head])
                for s in reversed(body):
                    if s in names:
                        follow[s] |= tail
                        tail = first[s] | (tail if s in nullable else set())
                    else:
                        tail = {s}
            changed = before != (len(nullable), sum(map(len, first.values())), sum(map(len, follow.values())))
        return follow

    def _closed(self, items: set, names: set) -> frozenset:
        items, waiting = set(items), list(items)
        while waiting:
            rule, dot = waiting.pop()
            body = self.rules[rule][1]
            if dot < len(body) and body[dot] in names:
                for r, (head, _) in enumerate(self.rules):
                    if head == body[dot] and (r, 0) not in items:
                        items.add((r, 0))
                        waiting.append((r, 0))
        return frozenset(items)

    def _number(self, state: frozenset) -> int:
        if state not in self.states:
            self.states.append(state)
        return self.states.index(state)

    def _push(self, below: int, symbol: str) -> int | None:
        state = self.goto.get((self.nodes[below][0], symbol))
        if state is None:
            return None
        if (state, below) not in self.known:
            self.known[state, below] = len(self.nodes)
            self.nodes.append((state, below))
        return self.known[state, below]

    def _reduced(self, node: int, ahead: str | None) -> set[int]:
        """The node and all it reduces to before ``ahead``; None: only what every next symbol reduces anyway."""
        out, waiting = {node}, [node]
        while waiting:
            top = waiting.pop()
            for rule, before in self.reductions[self.nodes[top][0]]:
                if ahead is None and len(self.states[self.nodes[top][0]]) > 1 or ahead is not None and ahead not in before:
                    continue
                head, body = self.rules[rule]
                base = top
                for _ in body:
                    base = self.nodes[base][1]
                reached = self._push(base, head)
                if ahead is None:
                    out.discard(top)
                if reached is not None and reached not in out:
                    out.add(reached)
                    waiting.append(reached)
        return out

    def shift(self, node: int, symbol: str) -> tuple[int, ...]:
        """Nodes after ``symbol`` is read on ``node``, with the reductions that need no look ahead done."""
        if (node, symbol) not in self.moves:
            reached = set()
            for top in self._reduced(node, symbol):
                pushed = self._push(top, symbol)
                if pushed is not None:
                    reached |= self._reduced(pushed, None)
            self.moves[node, symbol] = tuple(sorted(reached))
        return self.moves[node, symbol]

    def stacks(self) -> list[int]:
        """All stacks that a row can stand before. The role grammar has eight; one that nests without end has no such list."""
        if not self.tops:
            self.tops = [0]
            for node in self.tops:
                for symbol in self.terminals:
                    self.tops += [n for n in self.shift(node, symbol) if n not in self.tops]
        return self.tops

    def accepts(self, node: int) -> bool:
        return any(self.nodes[n][0] in self.accepting for n in self._reduced(node, END))


@lru_cache(maxsize=1)
def parser() -> Parser:
    """The role parser with all its stacks found at once, so that every process numbers them alike."""
    made = Parser()
    made.stacks()
    return made


Tops = dict[int, tuple[int, str]]


def _better(tops: Tops, node: int, cost: int, audit: str) -> bool:
    if node not in tops or (cost, audit) < tops[node]:
        tops[node] = (cost, audit)
        return True
    return False


def _inserted(tops: Tops) -> Tops:
    """The tops with any number of inserts behind them."""
    p, out, waiting = parser(), dict(tops), list(tops)
    while waiting:
        node = waiting.pop()
        cost, audit = out[node]
        for role in GIVEN:
            for reached in p.shift(node, role):
                if _better(out, reached, cost + INSERT, audit + "I"):
                    waiting.append(reached)
    return out


def step(tops: Tops, initial: str, kind: int) -> Tops:
    """The tops after one more row."""
    p, out = parser(), {}
    extra = TRUNCATED if kind == CUT else 0
    for node, (cost, audit) in _inserted(tops).items():
        _better(out, node, cost + DELETE, audit + "D")
        if kind in (BLANK, DUPLICATE):
            continue
        if initial in p.terminals:
            for reached in p.shift(node, initial):
                _better(out, reached, cost + extra, audit + "K")
        for role in GIVEN:
            for reached in p.shift(node, role):
                _better(out, reached, cost + REROLE + extra, audit + "R")
    return out


def finish(tops: Tops) -> tuple[int, str]:
    """Cost and audit of the cheapest repair."""
    return min(v for node, v in _inserted(tops).items() if parser().accepts(node))


def block(initials: str, kinds: bytes) -> tuple[tuple[tuple[int, int, str], ...], ...]:
    """For each stack that a block of rows may begin with, the stacks it ends with: (node, cost, audit)."""
    starts = parser().stacks()
    out = [()] * len(parser().nodes)
    for node in starts:
        tops: Tops = {node: (0, "")}
        for initial, kind in zip(initials, kinds, strict=True):
            tops = step(tops, initial, kind)
        out[node] = tuple((n, c, a) for n, (c, a) in sorted(tops.items()))
    return tuple(out)


def _pack(initials: str, kinds: bytes) -> str:
    return json.dumps(block(initials, kinds), separators=(",", ":"))


# Short conversations repeat each other; of longer ones nothing is kept, so the memory is bounded.
_short_pack, _short_unpack = lru_cache(maxsize=4_096)(_pack), lru_cache(maxsize=4_096)(json.loads)


def packed_block(initials: str, kinds: bytes) -> str:
    """``block`` as text."""
    return (_short_pack if len(kinds) <= SHORT else _pack)(initials, kinds)


def unpacked(moves: str) -> list[list[list]]:
    return (_short_unpack if len(moves) <= 64 * SHORT * SHORT else json.loads)(moves)


class Fold:
    """Blocks of a conversation put together in order; what all audits begin with is set aside."""

    def __init__(self):
        self.tops: Tops = {0: (0, "")}
        self.settled: list[str] = []

    def add(self, moves) -> None:
        """``moves`` as ``block`` gives them."""
        out: Tops = {}
        for node, (cost, audit) in self.tops.items():
            for reached, more, letters in moves[node]:
                _better(out, reached, cost + more, audit + letters)
        shared = commonprefix([a for _, a in out.values()])
        self.settled.append(shared)
        self.tops = {n: (c, a[len(shared) :]) for n, (c, a) in out.items()}

    def result(self) -> tuple[int, str]:
        cost, rest = finish(self.tops)
        return cost, "".join(self.settled) + rest


def role_given(node: int) -> tuple[str, int]:
    """The role that a rerole or an insert gives on this stack, and the stack after it."""
    for initial, role in GIVEN.items():
        reached = parser().shift(node, initial)
        if reached:
            return role, reached[0]
    raise ValueError("no role can follow")


class Writer:
    """Follows an audit through the rows of a conversation; gives the lines of the repaired text."""

    def __init__(self, audit: str):
        self.audit, self.at, self.node = audit, 0, 0

    def _inserts(self) -> Iterator[str]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            role, self.node = role_given(self.node)
            self.at += 1
            yield f"{role}:"

    def row(self, role: str, text: str) -> Iterator[str]:
        yield from self._inserts()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            self.node = parser().shift(self.node, role[:1])[0]
            yield f"{role}:{text}"
        elif letter == "R":
            role, self.node = role_given(self.node)
            yield f"{role}:{text}"

    def rest(self) -> Iterator[str]:
        yield from self._inserts()


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with planted faults, by crc32 of "conv_id:turn" modulo 20; a null stands as one space.

    0 drops a row, 1 empties its text, 2 removes its full stops, exclamation and question marks, 3 repeats it, 4 makes it the user's.
    """
    space = F.lit(" ")
    conv, turn = (F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn"))
    key = F.concat(conv, F.lit(":"), turn)
    fault = F.crc32(key.cast("binary")) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), space) for c in ("role", "text"))
    changed = rows.select(
        "conv_id",
        "turn",
        F.when(fault == 4, "user").otherwise(role).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        fault.alias("fault"),
    ).where("fault <> 0")
    copies = F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return changed.select("conv_id", "turn", "role", "text", F.explode(copies)).drop("col")


SPACES = " \t\n\x0b\f\r"


def _own_kind(text: Column) -> Column:
    """Blank, truncated or sound; whether a row is a duplicate depends on others."""
    trimmed = F.rtrim(text, F.lit(SPACES))
    return (
        F.when(trimmed == "", BLANK).when(F.substring(trimmed, -1, 1).isin(".", "!", "?"), SOUND).otherwise(CUT)
    )


def ordered(rows: DataFrame, folder: str) -> DataFrame:
    """The rows with ``place``, a number ascending by conversation, turn (nulls first), role and text, as a written table.

    Ranges are cut by row number as well, so no conversation, however long or repetitive, has to lie in one.
    """
    given = rows.select(
        "conv_id",
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
    )
    given = given.withColumns(
        {
            "tie": F.xxhash64("role", "text"),
            "kind": _own_kind(F.col("text")),
            "number": F.monotonically_increasing_id(),
        }
    )
    keys = ["conv_id", "turn", "tie", "number"]
    ranged = given.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("tie", "number")
    return common.written(ranged.withColumn("place", F.monotonically_increasing_id()), folder, "ordered")


def _kinds(rows: DataFrame) -> DataFrame:
    """(conv_id, place, turn, initial, kind) of each row, duplicates told by the first place of their role and text."""
    said = F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")
    light = rows.select(
        "conv_id", "place", "turn", F.substring("role", 1, 1).alias("initial"), "kind", F.sha2(said, 256).alias("said")
    )
    first = light.groupBy("conv_id", "said").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    again = first.where("n > 1").select(*(F.col(c).alias(f"o_{c}") for c in ("conv_id", "said", "first")))
    same = light["conv_id"].eqNullSafe(again["o_conv_id"]) & (light["said"] == again["o_said"])
    met = light.join(again, same, "left")
    repeated = (F.col("kind") != BLANK) & (F.col("place") > F.col("o_first"))
    kind = F.when(repeated, DUPLICATE).otherwise(F.col("kind"))
    return met.select("conv_id", "place", "turn", "initial", kind.cast("int").alias("kind"))


_COUNTS = ("blank", "duplicate", "truncated", "illegal", "turns")
_EDGES = ("first_initial", "last_initial")
_TURNS = ("first_turn", "last_turn")
_LEGAL = {"su", "ua", "au"}


@dataclass
class _Block:
    initials: list[str]
    kinds: bytearray
    turns: int = 0
    first_turn: int | None = None
    last_turn: int | None = None

    def add(self, turn: int | None, initial: str, kind: int) -> None:
        self.initials.append(initial)
        self.kinds.append(kind)
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.last_turn = turn
            if self.first_turn is None:
                self.first_turn = turn

    def row(self) -> dict:
        counted = [self.kinds.count(k) for k in (BLANK, DUPLICATE, CUT)]
        pairs = zip(self.initials, self.initials[1:], strict=False)
        # A role without a first character is read as a space, which no rule accepts.
        return {
            "moves": packed_block("".join(i or " " for i in self.initials), bytes(self.kinds)),
            **dict(zip(_COUNTS, (*counted, sum(a + b not in _LEGAL for a, b in pairs), self.turns), strict=True)),
            "first_initial": self.initials[0],
            "last_initial": self.initials[-1],
            "first_turn": self.first_turn,
            "last_turn": self.last_turn,
        }


def _blocks(kinds: DataFrame) -> DataFrame:
    """Each block of a conversation: its place, what it does to every stack, and its counts."""
    dealt = kinds.withColumn("block", F.floor(F.col("place") / BLOCK))
    dealt = dealt.repartition("conv_id", "block").sortWithinPartitions("conv_id", "place")
    conv = kinds.schema["conv_id"].dataType.simpleString()
    schema = (
        f"conv_id {conv}, place bigint, moves string, {', '.join(f'{c} bigint' for c in _COUNTS)}, "
        f"{', '.join(f'{c} string' for c in _EDGES)}, {', '.join(f'{c} bigint' for c in _TURNS)}"
    )
    out_type = common.arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, ready = None, None, []

        def close():
            if held is not None:
                ready.append({"conv_id": now[0], "place": now[2], **held.row()})

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "block", "place", "turn", "initial", "kind")]
            for conv_id, number, place, turn, initial, kind in zip(*columns, strict=True):
                if now is None or (conv_id, number) != now[:2]:
                    close()
                    now, held = (conv_id, number, place), _Block([], bytearray())
                held.add(turn, initial, kind)
            if len(ready) >= common.BATCH_ROWS:
                yield pa.RecordBatch.from_pylist(ready, out_type)
                ready.clear()
        close()
        if ready:
            yield pa.RecordBatch.from_pylist(ready, out_type)

    return dealt.select("conv_id", "block", "place", "turn", "initial", "kind").mapInArrow(run, schema)


class _Conversation:
    """One conversation as its stream passes: first its blocks, then its rows."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.fold, self.counts = Fold(), dict.fromkeys(_COUNTS, 0)
        self.last_initial = self.first_turn = self.last_turn = self.writer = None
        self.hash, self.lines = hashlib.sha256(), 0

    def add_block(self, b: dict) -> None:
        self.fold.add(unpacked(b["moves"]))
        for c in _COUNTS:
            self.counts[c] += b[c]
        if self.last_initial is not None and self.last_initial + b["first_initial"] not in _LEGAL:
            self.counts["illegal"] += 1
        self.last_initial = b["last_initial"]
        if b["first_turn"] is not None:
            if self.first_turn is None:
                self.first_turn = b["first_turn"]
            elif b["first_turn"] == self.last_turn:
                self.counts["turns"] -= 1
            self.last_turn = b["last_turn"]

    def _write(self, lines: Iterator[str]) -> None:
        for line in lines:
            self.hash.update((b"\n" if self.lines else b"") + line.encode())
            self.lines += 1

    def add_row(self, role: str, text: str) -> None:
        if self.writer is None:
            self.cost, self.audit = self.fold.result()
            self.writer = Writer(self.audit)
        self._write(self.writer.row(role, text))

    def row(self) -> dict:
        self._write(self.writer.rest())
        first, last = self.first_turn, self.last_turn
        gaps = 0 if first is None else last - first + 1 - self.counts["turns"]
        return {
            "conv_id": self.conv_id, "gaps": gaps, **{c: self.counts[c] for c in _COUNTS if c != "turns"},
            "cost": self.cost, "audit": self.audit, "repaired_sha256": self.hash.hexdigest(), "n_repaired": self.lines,
        }


def repair(rows: DataFrame) -> DataFrame:
    """The cheapest repair of each conversation of (conv_id, turn, role, text): gaps, blank, duplicate, truncated, illegal,
    cost, audit, repaired_sha256 and n_repaired (its lines).

    Rows are taken by turn, nulls first; rows of one turn by a hash of role and text, which keeps copies together. A null conv_id is
    a conversation of its own, a null role or text one space. An empty table gives an empty one; other columns are not read.
    """
    spark = common.prepare(rows.sparkSession)
    table = ordered(rows, common.work_folder(spark, "conversations"))
    blocks = _blocks(_kinds(table))
    names = ["conv_id", "place", "role", "text", "b"]
    packed = F.struct(*[c for c in blocks.columns if c not in ("conv_id", "place")])
    none = F.lit(None)
    told = blocks.select("conv_id", "place", none.cast("string").alias("role"), none.cast("string").alias("text"), packed.alias("b"))
    said = table.select("conv_id", "place", "role", "text").withColumn("b", none.cast(told.schema["b"].dataType))
    stream = said.unionByName(told).withColumn("b_last", F.col("b").isNull())
    stream = stream.repartition("conv_id").sortWithinPartitions("conv_id", "b_last", "place").select(*names)
    conv = rows.schema["conv_id"].dataType.simpleString()
    schema = (
        f"conv_id {conv}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, "
        "audit string, repaired_sha256 string, n_repaired bigint"
    )
    out_type = common.arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ready = None, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "b")]
            for conv_id, role, text, b in zip(*columns, strict=True):
                if now is None or conv_id != now.conv_id:
                    if now is not None:
                        ready.append(now.row())
                    now = _Conversation(conv_id)
                if b is not None:
                    now.add_block(b)
                else:
                    now.add_row(role, text)
            if len(ready) >= common.BATCH_ROWS:
                yield pa.RecordBatch.from_pylist(ready, out_type)
                ready.clear()
        if now is not None:
            ready.append(now.row())
        if ready:
            yield pa.RecordBatch.from_pylist(ready, out_type)

    return stream.mapInArrow(run, schema)


def report(conversations: DataFrame) -> DataFrame:
    """``repair`` of the damaged conversations, one row for every given conv_id; those without rows are sound and empty."""
    given = conversations.select("conv_id").distinct()
    fixed = repair(damaged(conversations)).withColumnRenamed("conv_id", "o_conv_id")
    empty = hashlib.sha256(b"").hexdigest()
    blanks = {"audit": F.lit(""), "repaired_sha256": F.lit(empty)}
    met = given.join(fixed, given["conv_id"].eqNullSafe(fixed["o_conv_id"]), "left")
    columns = [c for c in fixed.columns if c not in ("o_conv_id", "n_repaired")]
    return met.select("conv_id", *(F.coalesce(c, blanks.get(c, F.lit(0).cast("bigint"))).alias(c) for c in columns))
