"""Packing documents into sequences of a fixed number of tokens, with as few sequences as possible.

Only the histogram of piece lengths decides the packing. It has at most ``capacity`` entries
however many documents there are, so the plan is made on the driver from those entries:

1. Dominance reduction. A set of pieces that dominates every other set holding its largest
   piece is fixed for good: it can be exchanged into some optimal packing. The three rules used
   are those of Martello and Toth for sets of one, two and three pieces. A rule that fixes
   one set fixes as many copies of it as the counts allow.
2. Best-fit decreasing on what is left, again with counts instead of single pieces.

The plan is a list of patterns (the lengths in a sequence) with counts. Pieces find their place by
rank among pieces of their length; ranks come from per-task counts, never from a global sort.
"""

from __future__ import annotations

import bisect
import itertools
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from zonewise.llm import common
from zonewise.llm.encoding import encoder


@dataclass(frozen=True)
class Pattern:
    """``count`` sequences that hold ``repeat`` pieces of each of the ``lengths`` (length, repeat)."""

    lengths: tuple[tuple[int, int], ...]
    count: int
    fixed: bool  # by a dominance rule


def dominance_reduction(counts: dict[int, int], capacity: int) -> tuple[list[Pattern], dict[int, int]]:
    """Fix dominating sets of up to three pieces; returns the patterns and the counts that are left.

    Lengths are looked at from the longest. For the longest piece j of a set:

    * no other piece fits beside it: j alone dominates;
    * the largest piece k that fits fills the sequence, or no two pieces fit beside j: {j, k} dominates,
      because whatever else stands beside j can be exchanged for k;
    * no three pieces fit beside j, and one pair (a, b) beside j fills the sequence and each piece that
      can stand beside j alone, or as the larger of two, is at most a, and the smaller at most b.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    lengths = sorted(left)
    found: dict[tuple[int, ...], int] = {}

    def take(pieces: tuple[int, ...]) -> None:
        copies = min(left[n] // pieces.count(n) for n in set(pieces))
        for n in pieces:
            left[n] -= copies
        for n in set(pieces):
            if left[n] == 0:
                del left[n]
                lengths.remove(n)
        found[pieces] = found.get(pieces, 0) + copies

    def largest(room: int, used: tuple[int, ...]) -> int | None:
        """The longest piece of at most ``room`` besides those in ``used``."""
        for i in range(bisect.bisect_right(lengths, room) - 1, -1, -1):
            if left[lengths[i]] > used.count(lengths[i]):
                return lengths[i]
        return None

    def smallest(how_many: int, used: tuple[int, ...]) -> list[int]:
        out: list[int] = []
        for n in lengths:
            out += [n] * min(left[n] - used.count(n), how_many - len(out))
            if len(out) == how_many:
                break
        return out

    def dominating(j: int) -> tuple[int, ...] | None:
        room = capacity - j
        k = largest(room, (j,))
        if k is None:
            return (j,)
        low = smallest(3, (j,))
        if k == room or len(low) < 2 or low[0] + low[1] > room:
            return (j, k)
        if len(low) < 3 or sum(low) > room:
            # At most two pieces fit beside j. k is the longest; with the longest b that fits beside
            # it, (k, b) bounds every pair only if no pair without k has a smaller part above b.
            b = largest(room - k, (j, k))
            if b is not None and k + b == room:
                middle = largest(room // 2, (j,))
                if middle is None or middle <= b:
                    return (j, k, b)
        return None

    changed = True
    while changed:
        changed = False
        for j in sorted(left, reverse=True):
            while j in left and (pieces := dominating(j)) is not None:
                take(pieces)
                changed = True
    patterns = [
        Pattern(tuple((n, len(list(same))) for n, same in itertools.groupby(p)), c, True) for p, c in found.items()
    ]
    return patterns, left


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing over counts: the longest pieces first, each into the fullest sequence that has room."""
    open_: dict[int, dict[tuple[tuple[int, int], ...], int]] = {}

    def put(room: int, lengths: tuple[tuple[int, int], ...], copies: int) -> None:
        at = open_.setdefault(room, {})
        at[lengths] = at.get(lengths, 0) + copies

    for n in sorted(counts, reverse=True):
        rest = counts[n]
        # Rooms below n after placing are not looked at again for this length.
        for room in sorted(r for r in open_ if r >= n):
            if not rest:
                break
            fit = room // n
            for lengths in list(open_[room]):
                if not rest:
                    break
                copies = min(open_[room][lengths], -(-rest // fit))
                full, partial = divmod(min(rest, copies * fit), fit)
                left = open_[room].pop(lengths) - full - (partial > 0)
                if left:
                    open_[room][lengths] = left
                if full:
                    put(room - fit * n, (*lengths, (n, fit)), full)
                if partial:
                    put(room - partial * n, (*lengths, (n, partial)), 1)
                rest -= full * fit + partial
            if not open_[room]:
                del open_[room]
        if rest:
            fit = capacity // n
            full, partial = divmod(rest, fit)
            if full:
                put(capacity - fit * n, ((n, fit),), full)
            if partial:
                put(capacity - partial * n, ((n, partial),), 1)
    return [Pattern(lengths, c, False) for at in open_.values() for lengths, c in at.items()]


def plan(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Patterns that hold all pieces: fixed ones first, then best-fit decreasing on what is left."""
    fixed, left = dominance_reduction(counts, capacity)
    return fixed + best_fit_decreasing(left, capacity)


class Places:
    """Where the piece of a length and rank goes: (sequence, offset). Holds one entry for each pattern and length."""

    def __init__(self, patterns: list[Pattern]):
        entries = []
        next_rank: dict[int, int] = {}
        sequence = 0
        for p in patterns:
            offset = 0
            for n, repeat in p.lengths:
                entries.append((n, next_rank.get(n, 0), repeat, sequence, offset))
                next_rank[n] = next_rank.get(n, 0) + repeat * p.count
                offset += n * repeat
            sequence += p.count
        entries.sort()
        table = np.array(entries, np.int64).reshape(-1, 5)
        self.key = self._key(table[:, 0], table[:, 1])
        self.rank, self.repeat, self.sequence, self.offset = table[:, 1:].T.copy()

    @staticmethod
    def _key(length: np.ndarray, rank: np.ndarray) -> np.ndarray:
        return (length << 44) + rank

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, self._key(length, rank), side="right") - 1
        within = rank - self.rank[at]
        return (
            self.sequence[at] + within // self.repeat[at],
            self.offset[at] + within % self.repeat[at] * length,
        )


PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, task int, nth bigint"


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, spaces_matter: bool) -> DataFrame:
    """The pieces of all documents: the first takes what is over, the others are full.

    ``task`` and ``nth`` number the pieces of one length within the task that made them.
    """

    def run(batches):
        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        encode = encoder(tokenizer, spaces_matter)
        for batch in batches:
            if not batch.num_rows:
                continue
            out: list[tuple] = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode.ids(batch.column(1)), strict=True):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                at, number = 0, 0
                while at < len(ids):
                    n = capacity if at else (len(ids) - 1) % capacity + 1
                    out.append((doc_id, number, at, n, zlib.crc32(ids[at : at + n].tobytes()), task, int(seen[n])))
                    seen[n] += 1
                    at, number = at + n, number + 1
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"]
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            for i in range(0, len(out), 50_000):
                columns = zip(*out[i : i + 50_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, PIECES)


def pack(
    docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 1024, spaces_matter: bool = True
) -> DataFrame:
    """Pack the documents (``doc_id``, ``text``) into sequences of at most ``capacity`` tokens.

    One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, fixed (whether
    a dominance rule placed it). A null text counts as empty: one piece that holds the end id. Rows with a null or
    repeated doc_id are packed like any other, each on its own. No documents give no rows. Other
    columns are ignored.
    """
    spark = common.prepare(docs.sparkSession)
    folder = common.work_folder(spark, "packing")
    made = common.written(pieces(docs, tokenizer, end_id, capacity, spaces_matter), folder, "pieces")
    per_task = made.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = common.written(per_task.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), folder, "bases")
    # At most one row for each possible length.
    counts = {r.length: r.n for r in bases.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    patterns = plan(counts, capacity)
    places = spark.sparkContext.broadcast(Places(patterns))
    n_fixed = sum(p.count for p in patterns if p.fixed)

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
        sequence, offset = places.value.of(length, rank)
        keep = ["doc_id", "piece", "start", "length", "ids_crc32"]
        return pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in keep), pa.array(sequence), pa.array(offset), pa.array(sequence < n_fixed)],
            [*keep, "sequence_id", "offset", "fixed"],
        )

    ranked = made.join(bases.select("task", "length", "base"), ["task", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("nth") + F.col("base")).alias("rank")
    )
    return common.over_batches(
        ranked,
        place,
        "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, "
        "offset bigint, fixed boolean",
    )
