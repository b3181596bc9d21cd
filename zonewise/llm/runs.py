"""Periodic runs of words: suffix trees of a text and of its reversal answer how far two places agree.

A run is a stretch of words with smallest period q (words q apart are equal) that no neighbouring word extends.

1. Words that cannot stand in a wanted run go first. In a stretch of at least six words and four periods every three
   consecutive words occur three times or more, so a word in no such triple is in no run. What remains of a text is a list
   of segments; a separator of its own stands between each two, so no match crosses one.
2. Ukkonen's algorithm builds the suffix trees of this list and of its reversal. The Euler tour of a tree, kept at the
   inner nodes between their children, and a sparse table of its minima give the depth of the lowest common ancestor of
   two leaves in constant time: the common extension of two places to the right, and in the other tree to the left.
3. The leaves' order in the forward tree, for the words in ascending and in descending order, gives the longest Lyndon
   word at every place (it ends before the next smaller suffix). Each run has such a word as a root, so extending every
   one by its own length to both sides finds all runs, at most two candidates a place.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonewise.llm import common

# A wanted run has at least so many words and periods; step 1 relies on both.
MIN_WORDS, MIN_PERIODS = 6, 4
# Rounds of step 1; each can only take away more words.
ROUNDS = 3
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def words(text: bytes | None) -> list[bytes]:
    """Words between spaces and the characters 9 to 13."""
    return text.split() if text else []


def suffix_tree(s: list[int]) -> tuple[list[dict[int, int]], list[int], list[int]]:
    """Ukkonen's tree of ``s``, whose last number occurs once: children by first number, and the edge (first, behind)
    into each node. Leaves have ``behind`` = len(s); node 0 is the root."""
    end = len(s)
    children: list[dict[int, int]] = [{}]
    first, behind, link = [0], [0], [0]
    node = edge = length = waiting = 0
    for i, c in enumerate(s):
        waiting += 1
        unlinked = 0
        while waiting:
            if not length:
                edge = i
            below = children[node].get(s[edge])
            if below is None:
                children[node][s[edge]] = len(first)
                first.append(i)
                behind.append(end)
                link.append(0)
                children.append({})
                if unlinked:
                    link[unlinked] = node
                    unlinked = 0
            else:
                span = min(behind[below], i + 1) - first[below]
                if length >= span:
                    edge += span
                    length -= span
                    node = below
                    continue
                at = first[below] + length
                if s[at] == c:
                    length += 1
                    if unlinked:
                        link[unlinked] = node
                    break
                inner = len(first)
                first += (first[below], i)
                behind += (at, end)
                link += (0, 0)
                children += ({c: inner + 1, s[at]: below}, {})
                children[node][s[edge]] = inner
                first[below] = at
                if unlinked:
                    link[unlinked] = inner
                unlinked = inner
            waiting -= 1
            if not node and length:
                length -= 1
                edge = i - waiting + 1
            elif node:
                node = link[node]
    return children, first, behind


class Extensions:
    """How far the sequence agrees with itself from two places on, in constant time."""

    def __init__(self, s: list[int], falling: bool = False):
        end = len(s)
        self.tree = suffix_tree(s)
        order, tour = self._walk(end, rising=True, tour=True)
        self.rank = np.empty(end, np.int64)
        self.rank[order] = np.arange(end)
        self.falling = self._walk(end, rising=False, tour=False)[0] if falling else None
        self.table = [np.array(tour, np.int32)]
        width = 1
        while 2 * width <= len(tour):
            last = self.table[-1]
            self.table.append(np.minimum(last[:-width], last[width:]))
            width *= 2
        del self.tree

    def _walk(self, end: int, rising: bool, tour: bool) -> tuple[list[int], list[int]]:
        """Starts of the suffixes in order, and the depth of the inner node between each two.

        Numbers below 0 are separators: they come first in both orders.
        """
        children, first, behind = self.tree
        order: list[int] = []
        depths: list[int] = []
        stack = [(0, 0)]
        while stack:
            node, depth = stack.pop()
            if node < 0:
                # The tour is back at an inner node, on its way to the next child.
                depths.append(depth)
                continue
            depth += behind[node] - first[node]
            below = children[node]
            if not below:
                order.append(end - depth)
                continue
            ranked = sorted(below) if rising else sorted(below, key=lambda c: c if c < 0 else end - c)
            for n, c in enumerate(reversed(ranked)):
                if n and tour:
                    stack.append((-1, depth))
                stack.append((below[c], depth))
        return order, depths

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common extension to the right from places ``a`` and ``b``, which differ."""
        ra, rb = self.rank[a], self.rank[b]
        low, high = np.minimum(ra, rb), np.maximum(ra, rb)
        level = np.frexp((high - low).astype(float))[1] - 1
        out = np.empty(len(low), np.int64)
        for k in np.unique(level):
            at = level == k
            row = self.table[k]
            out[at] = np.minimum(row[low[at]], row[high[at] - (1 << int(k))])
        return out


def _next_smaller(order: list[int]) -> np.ndarray:
    """For each place the next one whose suffix comes earlier in ``order`` (the end, where there is none)."""
    n = len(order)
    rank = [0] * n
    for k, place in enumerate(order):
        rank[place] = k
    out, stack = np.full(n, n, np.int64), []
    for i in range(n - 1, -1, -1):
        r = rank[i]
        while stack and rank[stack[-1]] > r:
            stack.pop()
        if stack:
            out[i] = stack[-1]
        stack.append(i)
    return out


def runs_of(s: list[int]) -> np.ndarray:
    """Rows (start, length, period) of the wanted runs of ``s``, by start and period; numbers below 0 occur once each."""
    m = len(s)
    if m < MIN_WORDS:
        return np.zeros((0, 3), np.int64)
    forward = Extensions([*s, -m - 1], falling=True)
    backward = Extensions([*reversed(s), -m - 1])
    rising = np.argsort(forward.rank).tolist()
    found = []
    for order in (rising, forward.falling):
        period = _next_smaller(order)[:m] - np.arange(m)
        place = np.flatnonzero((np.asarray(s) >= 0) & (np.arange(m) + period <= m))
        period = period[place]
        right = forward(place, place + period)
        left = np.zeros(len(place), np.int64)
        inner = place > 0
        left[inner] = backward(m - place[inner], m - place[inner] - period[inner])
        length = left + period + right
        wanted = length >= np.maximum(MIN_WORDS, MIN_PERIODS * period)
        found.append(np.stack([(place - left)[wanted], length[wanted], period[wanted]], axis=1))
    out = np.unique(np.concatenate(found), axis=0)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def _candidates(hashes: np.ndarray, document: np.ndarray) -> np.ndarray:
    """Places that step 1 leaves, ascending. Equal hashes of different words only leave more."""
    place = np.arange(len(hashes))
    for _ in range(ROUNDS):
        if len(place) < 3:
            return place[:0]
        h, d = hashes[place], document[place]
        whole = (place[2:] - place[:-2] == 2) & (d[2:] == d[:-2])
        triple = ((h[:-2] * _M1 + h[1:-1]) * _M2 + h[2:]) * _M1 + d[:-2].astype(np.uint64)
        triple = triple[whole] * _M2
        bits = max(8, int(len(triple)).bit_length() + 2)
        bucket = (triple >> np.uint64(64 - bits)).astype(np.int64)
        often = np.bincount(bucket, minlength=1)[bucket] >= 3 if len(bucket) else np.zeros(0, bool)
        starts = np.flatnonzero(whole)[often]
        kept = np.zeros(len(place), bool)
        for k in range(3):
            kept[starts + k] = True
        if kept.all():
            return place
        place = place[kept]
    return place


def find(documents: list[list[bytes]]) -> list[np.ndarray]:
    """Rows (start, length, period) of the wanted runs of each document."""
    none = np.zeros((0, 3), np.int64)
    out = [none] * len(documents)
    tokens = [w for d in documents for w in d]
    if not tokens:
        return out
    sizes = np.array([len(d) for d in documents])
    behind = np.cumsum(sizes)
    hashes = np.fromiter(map(hash, tokens), np.int64, len(tokens)).view(np.uint64)
    place = _candidates(hashes, np.repeat(np.arange(len(documents)), sizes))
    owner = np.searchsorted(behind, place, side="right")
    for d in np.unique(owner):
        offset = int(behind[d] - sizes[d])
        own = place[owner == d] - offset
        given, numbers, where, s = documents[d], {}, [], []
        last = -1
        for at in own.tolist():
            if at != last + 1 and s:
                s.append(-len(s) - 1)
                where.append(-1)
            s.append(numbers.setdefault(given[at], len(numbers)))
            where.append(at)
            last = at
        rows = runs_of(s)
        if len(rows):
            rows[:, 0] = np.asarray(where)[rows[:, 0]]
            out[d] = rows
    return out


def best_of(rows: np.ndarray) -> tuple[int, int, int] | None:
    """The run of the greatest exact length/period; ties go to the smallest start, then period."""
    best = None
    for start, length, period in rows.tolist():
        if best is None or length * best[2] > best[1] * period:
            best = (start, length, period)
    return best


def collapse(tokens: list[bytes], rows: np.ndarray) -> bytes:
    """The words that no run holds behind its first period, joined by one space."""
    if not len(rows):
        return b" ".join(tokens)
    steps = np.zeros(len(tokens) + 1, np.int64)
    np.add.at(steps, rows[:, 0] + rows[:, 2], 1)
    np.add.at(steps, rows[:, 0] + rows[:, 1], -1)
    kept = np.flatnonzero(np.cumsum(steps[:-1]) == 0)
    return b" ".join([tokens[i] for i in kept.tolist()])


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_RUN_SQL = "struct<start:bigint,length:bigint,period:bigint>"


def periodic_runs(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` as a struct (row), with ``runs`` by start and period, the ``best`` of them and the
    ``collapsed`` text.

    A null or empty text has no words, no runs, a null ``best`` and an empty ``collapsed``. Rows are read each on its own:
    repeated ones get equal results, an empty table gives an empty one, other columns are not touched.
    """
    common.prepare(docs.sparkSession)
    given = docs.select(F.struct(*[docs[c] for c in keep]).alias("row"), docs["text"].cast("binary").alias("text"))
    row_type = given.schema["row"].dataType.simpleString()

    def detect(batch: pa.RecordBatch) -> pa.RecordBatch:
        documents = [words(t) for t in batch.column("text").to_pylist()]
        found = find(documents)
        sizes = [len(r) for r in found]
        flat = np.concatenate(found)
        parts = [pa.array(flat[:, k], pa.int64()) for k in range(3)]
        runs = pa.ListArray.from_arrays(
            pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()),
            pa.StructArray.from_arrays(parts, fields=list(_RUN)),
        )
        best = [b and dict(zip(("start", "length", "period"), b, strict=True)) for b in map(best_of, found)]
        collapsed = [collapse(t, r).decode() for t, r in zip(documents, found, strict=True)]
        return pa.RecordBatch.from_arrays(
            [batch.column("row"), runs, pa.array(best, _RUN), pa.array(collapsed, pa.string())],
            ["row", "runs", "best", "collapsed"],
        )

    schema = f"row {row_type}, runs array<{_RUN_SQL}>, best {_RUN_SQL}, collapsed string"
    return common.over_batches(given, detect, schema)


def plant_tail(doc_id: Column, text: Column) -> Column:
    """The text with a periodic tail, in one of ten documents: h = crc32 of the id, g = floor(h / 10); where h % 10 is 0,
    words from a = g % n on repeat the p = 1 + floor((n - a) / (3 + g % 8)) words from there. A null id has no tail."""
    tokens = F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    n = F.size(tokens)

    def tailed(t: Column) -> Column:
        a = (g % F.size(t)).cast("int")
        p = (F.lit(1) + F.floor((F.size(t) - a) / (F.lit(3) + g % 8))).cast("int")
        places = F.transform(F.sequence(F.lit(0), F.size(t) - 1), lambda i: F.when(i < a, i).otherwise(a + (i - a) % p))
        return F.array_join(F.transform(places, lambda i: F.get(t, i)), " ")

    planted = F.element_at(F.transform(F.array(tokens), tailed), 1)
    return F.when((h % 10 == 0) & (n > 0), planted).otherwise(text)


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the best run with its exponent in thousandths, and hashes of all runs and of the collapsed text."""
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = F.col("best")
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        F.size("runs").cast("bigint").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
