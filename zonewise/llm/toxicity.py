"""Toxicity scores by a factorization machine over hashed terms.

score = sigmoid(w0 + sum of w_i + sum over pairs of <v_i, v_j>) over the terms present in a text. The pair
part learns what no additive weight can, such as an insult next to a group's name. Terms are the distinct lower-case words of
the whole text and the beginnings of longer ones, by 64-bit hash; those that tell the labels apart best get parameters.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonewise.llm import common

# Labelled rows of each label that are learned from at most (about; chosen by a hash of the id).
ROWS_PER_LABEL = {1: 2_500, 0: 5_000}
# Terms with parameters at most, texts a term must occur in, size of the pair vectors.
MAX_TERMS, MIN_TEXTS, FACTORS = 8_192, 4, 8
# Lengths in bytes of the beginnings.
BEGINNINGS = (4, 6)
EPOCHS, RATE, DECAY, KEPT_SHARE = 25, 0.15, 1e-4, 0.85
LIMIT = 0.7
_FILTER_BITS = 20

# Bytes of words: digits, letters and all of UTF-8 beyond ASCII; the rest separates.
_WORDS = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def _terms(text: str) -> set[bytes]:
    """Distinct words, and marked beginnings of those that are longer."""
    words = set(text.lower().encode("utf-8", "replace").translate(_WORDS).split())
    starts = {b" " + w[:n] for n in BEGINNINGS for w in words if len(w) > n}
    return words | starts


def terms(text: str) -> np.ndarray:
    """Sorted hashes of the terms of the whole text."""
    found = _terms(text)
    return np.sort(np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found)))


@dataclass(frozen=True)
class Model:
    terms: np.ndarray  # sorted hashes
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def __post_init__(self):
        seen = np.zeros(1 << _FILTER_BITS, bool)
        seen[self.terms >> np.uint64(64 - _FILTER_BITS)] = True
        object.__setattr__(self, "seen", seen)

    def active(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of the terms among ``hashes`` that have parameters."""
        maybe = hashes[self.seen[hashes >> np.uint64(64 - _FILTER_BITS)]]
        at = np.searchsorted(self.terms, maybe)
        inside = at < len(self.terms)
        at, maybe = at[inside], maybe[inside]
        return np.unique(at[self.terms[at] == maybe])

    def margin(self, active: np.ndarray) -> float:
        v = self.factors[active]
        total = v.sum(axis=0)
        return float(self.bias + self.weights[active].sum() + 0.5 * (total @ total - (v * v).sum()))

    def score(self, hashes: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.margin(self.active(hashes)), -30, 30))))


def _chosen_terms(rows: list[np.ndarray], label: np.ndarray) -> np.ndarray:
    """The MAX_TERMS terms of the largest chi-square between presence and label."""
    every = np.concatenate(rows) if rows else np.zeros(0, np.uint64)
    owner = np.repeat(label, [len(r) for r in rows])
    known, number = np.unique(every, return_inverse=True)
    texts = np.bincount(number, minlength=len(known)).astype(float)
    toxic = np.bincount(number, weights=owner, minlength=len(known))
    n, positive = len(label), label.sum()
    expected = texts * positive / max(1, n)
    spread = expected * (1 - positive / max(1, n)) * (1 - texts / max(1, n))
    chi = (toxic - expected) ** 2 / np.maximum(spread, 1e-9)
    # 6.6 is the one-percent point: terms below it tell nothing.
    good = np.flatnonzero((texts >= MIN_TEXTS) & (chi >= 6.6))
    best = good[np.lexsort((known[good], -chi[good]))][:MAX_TERMS]
    return np.sort(known[best])


def train(rows: list[np.ndarray], label: np.ndarray) -> Model:
    """Stochastic gradient descent on the log loss, with adaptive steps. Without rows every score is 0.5."""
    names = _chosen_terms(rows, label)
    random = np.random.default_rng(11)
    share = (label.sum() + 1) / (len(label) + 2) if len(label) else 0.5
    bias = float(np.log(share / (1 - share)))
    model = Model(names, bias, np.zeros(len(names)), random.normal(0, 0.05, (len(names), FACTORS)))
    active = [model.active(r) for r in rows]
    w, v = model.weights, model.factors
    seen_w, seen_v, seen_b = np.full(len(names), 1e-6), np.full((len(names), FACTORS), 1e-6), 1e-6
    for _ in range(EPOCHS):
        for i in random.permutation(len(rows)):
            # Leaving out terms at random: each must carry weight without its usual companions.
            at = active[i][random.random(len(active[i])) < KEPT_SHARE]
            va = v[at]
            total = va.sum(axis=0)
            margin = bias + w[at].sum() + 0.5 * (total @ total - (va * va).sum())
            error = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - label[i]
            seen_b += error * error
            bias -= RATE * error / np.sqrt(seen_b)
            if len(at):
                gw = error + DECAY * w[at]
                gv = error * (total - va) + DECAY * va
                seen_w[at] += gw * gw
                seen_v[at] += gv * gv
                w[at] -= RATE * gw / np.sqrt(seen_w[at])
                v[at] -= RATE * 0.3 * gv / np.sqrt(seen_v[at])
    return Model(names, float(bias), w, v)


def fit(docs: DataFrame, labels: DataFrame, eligible: Column) -> Model:
    """Train on documents with a toxic label that ``eligible`` admits, about ROWS_PER_LABEL of each label.

    Of several labels of one doc_id the larger counts. Only term hashes come to the driver.
    """
    known = (
        labels.where(eligible & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
    )
    sizes = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    scale = 1 << 30
    rate = F.lit(0)
    for label, bound in ROWS_PER_LABEL.items():
        rate = F.when(F.col("toxic") == label, int(scale * min(1.0, bound / max(1, sizes.get(label, 0))))).otherwise(rate)
    chosen = known.where(F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(scale)) < rate).limit(
        2 * sum(ROWS_PER_LABEL.values())
    )

    def hashed(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [terms(t).tobytes() for t in common.texts(batch.column(1))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["toxic", "terms"])

    common.prepare(docs.sparkSession)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("toxic", "text")
    rows = common.over_batches(texts, hashed, "toxic int, terms binary").collect()
    rows.sort(key=lambda r: (r.toxic, bytes(r.terms)))
    return train([np.frombuffer(r.terms, np.uint64) for r in rows], np.array([float(r.toxic > 0) for r in rows]))


def score(docs: DataFrame, model: Model, columns: list[str]) -> DataFrame:
    """``columns`` of each document with score (0 to 1) and predicted (1 from LIMIT on), from ``text`` alone.

    A null or empty text has no terms and scores as the bias says. Repeated rows get equal scores; no rows give none.
    """
    shared = common.prepare(docs.sparkSession).sparkContext.broadcast(model)
    names = [c for c in columns if c not in ("score", "predicted")]
    schema = docs.select(*[docs[c] for c in names]).schema.add("score", "double").add("predicted", "integer")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        known = shared.value
        words = [_terms(t) for t in common.texts(batch.column(len(names)))]
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for d in words for w in d), np.uint64)
        ends = np.cumsum([len(d) for d in words])
        found = np.array([known.score(h) for h in np.split(hashes, ends[:-1])])
        return pa.RecordBatch.from_arrays(
            [*batch.columns[: len(names)], pa.array(found), pa.array((found >= LIMIT).astype(np.int32))],
            [*names, "score", "predicted"],
        )

    return common.over_batches(docs.select(*[docs[c] for c in names], docs["text"].alias("__text")), run, schema)
