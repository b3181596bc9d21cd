"""Benchmark decontamination: test n-grams as a broadcast hash set, hits verified word by word.

An item's windows are all its runs of ``window`` words; a shorter item is one window. Windows of
the training text are hashed with a rolling sum over word hashes, looked up in the set, and each hit is compared
with the words of the item. The benchmark is broadcast in blocks of a bounded size.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonewise.llm import common

WINDOW = 10
# Bytes of benchmark text in one broadcast block; a larger benchmark takes several blocks, each against all texts.
BLOCK_BYTES = 4 << 20
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_FILTER_BITS = 22

# Bytes of words: digits, letters and all of UTF-8 beyond ASCII; A-Z become a-z, the rest separates.
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


def _hashes(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))


def _rolled(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` words."""
    out = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
    for k in range(n):
        out *= _MULTIPLIER
        out += hashes[k : k + len(out)]
    return out ^ (out >> np.uint64(29))


@dataclass
class Index:
    """The windows of a block of items, by window length: sorted hashes, with the item and word they start at."""

    items: list[str] = field(default_factory=list)
    tokens: list[bytes] = field(default_factory=list)
    by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)

    @staticmethod
    def of(rows: list[tuple[str, bytes | None]], window: int) -> Index:
        index = Index()
        found: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for number, (item, text) in enumerate(rows):
            index.items.append(item)
            tokens = words(text)
            n = min(window, len(tokens))
            if n:
                rolled = _rolled(_hashes(tokens), n)
                starts = len(index.tokens) + np.arange(len(rolled))
                found.setdefault(n, []).append((rolled, np.full(len(rolled), number), starts))
            index.tokens += tokens
        for n, parts in found.items():
            rolled, item, start = (np.concatenate(p) for p in zip(*parts, strict=True))
            order = np.argsort(rolled, kind="stable")
            seen = np.zeros(1 << _FILTER_BITS, bool)
            seen[rolled >> np.uint64(64 - _FILTER_BITS)] = True
            index.by_length[n] = (rolled[order], item[order], start[order], seen)
        return index

    def scan(self, documents: list[list[bytes]]) -> list[tuple[list[tuple[int, int]], set[str]]]:
        """For each document the spans of hit words (first, behind the last) and the items that occur."""
        tokens = [w for d in documents for w in d]
        ends = np.cumsum([len(d) for d in documents])
        hashes = _hashes(tokens)
        spans: list[list[tuple[int, int]]] = [[] for _ in documents]
        items: list[set[str]] = [set() for _ in documents]
        for n, (known, item, start, seen) in self.by_length.items():
            rolled = _rolled(hashes, n)
            maybe = np.flatnonzero(seen[rolled >> np.uint64(64 - _FILTER_BITS)])
            low = np.searchsorted(known, rolled[maybe], side="left")
            high = np.searchsorted(known, rolled[maybe], side="right")
            for at, i, j in zip(maybe[high > low].tolist(), low[high > low], high[high > low], strict=True):
                d = int(np.searchsorted(ends, at, side="right"))
                first = at - (int(ends[d - 1]) if d else 0)
                if at + n > ends[d]:
                    continue
                matching = [k for k in range(i, j) if tokens[at : at + n] == self.tokens[start[k] : start[k] + n]]
                if matching:
                    spans[d].append((first, first + n))
                    items[d].update(self.items[item[k]] for k in matching)
        return [(_merged(s), i) for s, i in zip(spans, items, strict=True)]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _blocks(benchmark: DataFrame):
    """Blocks of at most about BLOCK_BYTES, each collected on its own. A null item id stands as the empty text."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("binary"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // BLOCK_BYTES) or 1
    for i in range(n):
        yield [tuple(r) for r in items.where(F.pmod(F.xxhash64("text"), F.lit(n)) == i).collect()]


def scan(docs: DataFrame, benchmark: DataFrame, columns: list[str], window: int = WINDOW) -> DataFrame:
    """Each document's ``columns`` (with ``text`` among them) as a struct (row), with n_words, spans and items.

    ``spans`` are runs of hit words (first, behind the last word), ``items`` the ids of the items that occur. A null
    or empty text has no words, an item without words no windows; an empty benchmark hits nothing. Rows are scanned
    each on its own, so repeated ones get equal results.
    """
    spark = common.prepare(docs.sparkSession)
    span = "array<struct<first:bigint,behind:bigint>>"
    out = docs.select(
        F.struct(*[docs[c] for c in columns]).alias("row"),
        F.lit(0).cast("bigint").alias("n_words"),
        F.array().cast(span).alias("spans"),
        F.array().cast("array<string>").alias("items"),
    )
    for rows in _blocks(benchmark):
        shared = spark.sparkContext.broadcast(Index.of(rows, window))

        def run(batch: pa.RecordBatch, shared=shared) -> pa.RecordBatch:
            row = batch.column("row")
            documents = [words(t) for t in row.field("text").cast(pa.binary()).to_pylist()]
            found = shared.value.scan(documents)
            earlier = zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist(), found, strict=True)
            spans, items = [], []
            for old_spans, old_items, (new_spans, new_items) in earlier:
                both = [(s["first"], s["behind"]) for s in old_spans] + new_spans
                spans.append([{"first": a, "behind": b} for a, b in _merged(both)])
                items.append(sorted(new_items.union(old_items)))
            return pa.RecordBatch.from_arrays(
                [
                    row,
                    pa.array([len(d) for d in documents], pa.int64()),
                    pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("behind", pa.int64())]))),
                    pa.array(items, pa.list_(pa.string())),
                ],
                ["row", "n_words", "spans", "items"],
            )

        out = common.over_batches(out, run, out.schema)
    return out


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit (words inside any occurrence), n_items, items_sha256 and contaminated for each document."""
    hits = F.aggregate("spans", F.lit(0).cast("bigint"), lambda total, s: total + s["behind"] - s["first"])
    return scan(docs, benchmark, ["doc_id", "text"], window).select(
        F.col("row.doc_id").alias("doc_id"),
        "n_words",
        hits.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def without_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans and what stands between them."""
    places = [m.span() for m in _WORD.finditer(text.translate(_FOLD))]
    out, at = [], 0
    for first, behind in spans:
        out.append(text[at : places[first][0]])
        at = places[behind - 1][1]
    return b"".join([*out, text[at:]])


def clean(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", window: int = WINDOW) -> DataFrame:
    """The documents without contaminated ones (``remove="documents"``) or without their hit spans ("spans").

    Columns stay as they are; clean documents pass unchanged.
    """
    found = scan(docs, benchmark, docs.columns, window)
    if remove == "documents":
        return found.where(F.size("spans") == 0).select("row.*")
    if remove != "spans":
        raise ValueError("remove is 'documents' or 'spans'")

    names, schema = docs.columns, docs.schema

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        row = batch.column("row")
        kept = [
            without_spans(t, [(s["first"], s["behind"]) for s in spans]).decode() if spans else t and t.decode()
            for t, spans in zip(row.field("text").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist(), strict=True)
        ]
        return pa.RecordBatch.from_arrays(
            [pa.array(kept, pa.string()) if c == "text" else row.field(i) for i, c in enumerate(names)], names
        )

    return common.over_batches(found, cut, schema)
