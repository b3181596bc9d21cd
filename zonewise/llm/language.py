"""Language identification: averaged embeddings of hashed subwords under a linear softmax.

A text's vector is the mean of the embeddings of its byte n-grams (words bounded by single spaces), trained
together with the softmax by stochastic gradient descent. Averaging and softmax layer are linear, so for
prediction the two are multiplied once into a table of class scores per bucket. A temperature fitted on
calibration rows turns scores into probabilities, and texts below the calibrated limit are marked as rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonewise.llm import common

BUCKETS, DIMENSION, ORDERS = 1 << 15, 16, (2, 3, 4)
# Labelled rows per language that are learned from at most (about; chosen by a hash of the id).
ROWS_PER_LANGUAGE = 400
EPOCHS, RATE, CALIBRATION_SHARE = 10, 0.5, 5
# Share of right calibration rows that the rejection limit may turn away.
REJECTED_SHARE = 0.01
# Scores are whole numbers of 1 / UNIT.
UNIT = 1 << 20
# Bytes of text scored at once.
SLICE = 1 << 20

# Bytes of words: letters and all of UTF-8 beyond ASCII; the rest becomes a space.
_LETTERS = bytes(b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def _letters(text: str) -> bytes:
    """Lower-case words with a space before and behind each."""
    return b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_LETTERS).split()) + b" "


def _has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _buckets(data: np.ndarray, n: int) -> np.ndarray:
    """Bucket of the n-gram at each position of ``data`` (bytes as uint32)."""
    h = np.full(max(0, len(data) - n + 1), n, np.uint32)
    for k in range(n):
        h *= np.uint32(0x01000193)
        h ^= data[k : k + len(h)]
    h *= np.uint32(0x9E3779B1)
    return h >> np.uint32(32 - (BUCKETS - 1).bit_length())


def _counts(text: str) -> np.ndarray:
    """How often each bucket occurs in the whole text."""
    out = np.zeros(BUCKETS, np.int64)
    data = _letters(text)
    for at in range(0, len(data), SLICE):
        for n in ORDERS:
            part = np.frombuffer(data[at : at + SLICE + n - 1], np.uint8).astype(np.uint32)
            out += np.bincount(_buckets(part, n), minlength=BUCKETS)
    return out


@dataclass(frozen=True)
class Model:
    languages: list[str]
    scores: np.ndarray  # BUCKETS x languages: embeddings times softmax weights, in units of 1 / UNIT
    bias: np.ndarray
    temperature: float
    limit: float

    def logits(self, texts: list[str]) -> np.ndarray:
        """Scores of whole texts: the mean over all their n-grams."""
        parts = [_letters(t) for t in texts]
        joined = b"".join(parts)
        ends = np.cumsum([len(p) for p in parts])
        starts = ends - [len(p) for p in parts]
        total, n_grams = np.zeros((len(texts), len(self.languages)), np.int64), np.zeros(len(texts), np.int64)
        for at in range(0, len(joined), SLICE):
            first, last = np.searchsorted(ends, at, side="right"), np.searchsorted(starts, at + SLICE, side="left")
            for n in ORDERS:
                part = np.frombuffer(joined[at : at + SLICE + n - 1], np.uint8).astype(np.uint32)
                buckets = _buckets(part, n)
                # Sums over whole numbers: the same whatever texts share the batch. N-grams across two texts are left out.
                sums = np.zeros((len(buckets) + 1, len(self.languages)), np.int64)
                np.cumsum(self.scores[buckets], axis=0, out=sums[1:])
                low = np.clip(starts[first:last] - at, 0, len(buckets))
                high = np.maximum(np.clip(ends[first:last] - n + 1 - at, 0, len(buckets)), low)
                total[first:last] += sums[high] - sums[low]
                n_grams[first:last] += high - low
        return total / UNIT / np.maximum(n_grams, 1)[:, None] + self.bias

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        p = _softmax(self.logits(texts) / self.temperature)
        best = p.argmax(axis=1)
        return [self.languages[i] for i in best], p[np.arange(len(best)), best]


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(rows: list[tuple[str, np.ndarray, np.ndarray]]) -> Model | None:
    """Train on (language, buckets, counts) rows; every CALIBRATION_SHARE-th calibrates. None without rows."""
    languages = sorted({r[0] for r in rows})
    if not languages:
        return None
    random = np.random.default_rng(7)
    order = random.permutation(len(rows))
    calibrating = order[::CALIBRATION_SHARE] if len(rows) >= 2 * CALIBRATION_SHARE else order[:0]
    training = np.setdiff1d(order, calibrating)
    embeddings = random.normal(0, 0.1, (BUCKETS, DIMENSION))
    weights, bias = random.normal(0, 0.1, (DIMENSION, len(languages))), np.zeros(len(languages))
    target = np.array([languages.index(r[0]) for r in rows])
    shares = [r[2] / max(1, r[2].sum()) for r in rows]
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for i in random.permutation(training):
            at, x = rows[i][1], shares[i]
            vector = x @ embeddings[at]
            error = _softmax((vector @ weights + bias)[None])[0]
            error[target[i]] -= 1
            back = weights @ error
            weights -= rate * np.outer(vector, error)
            bias -= rate * 0.1 * error
            # The mean spreads a text's gradient thinly over its n-grams; the factor makes up for it.
            embeddings[at] -= rate * 20 * np.outer(x, back)
    scores = np.rint(embeddings @ weights * UNIT).astype(np.int64)
    logits = np.array([shares[i] @ scores[rows[i][1]] / UNIT + bias for i in calibrating]).reshape(-1, len(languages))
    temperature, limit = _calibrated(logits, target[calibrating])
    return Model(languages, scores, bias, temperature, limit)


def _calibrated(logits: np.ndarray, target: np.ndarray) -> tuple[float, float]:
    """The temperature of the least log loss, and the limit that right rows pass but for REJECTED_SHARE."""
    if not len(logits):
        return 1.0, 0.0
    rows = np.arange(len(target))
    tried = np.geomspace(0.5, 10, 41)
    losses = [-np.log(np.maximum(_softmax(logits / t)[rows, target], 1e-12)).mean() for t in tried]
    temperature = float(tried[int(np.argmin(losses))])
    p = _softmax(logits / temperature)
    right = p.argmax(axis=1) == target
    return temperature, float(np.quantile(p.max(axis=1)[right], REJECTED_SHARE)) if right.any() else 0.0


def fit(docs: DataFrame, eligible: Column) -> Model | None:
    """Train on the rows of ``docs`` (``doc_id``, ``text``, ``lang``) that ``eligible`` admits.

    Rows are chosen by a hash of doc_id, at about one rate per language so that each gives at most about ROWS_PER_LANGUAGE; a
    hard limit of twice that many per language follows. Executors count n-grams; only counts come to the driver.
    """
    spark = common.prepare(docs.sparkSession)
    known = docs.where(eligible & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return None
    scale = 1 << 30
    rates = spark.createDataFrame(
        [(k, int(scale * min(1.0, ROWS_PER_LANGUAGE / n))) for k, n in sizes.items()], "lang string, rate bigint"
    )
    chosen = (
        known.select("doc_id", "lang", "text")
        .join(F.broadcast(rates), "lang")
        .where(F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(scale)) < F.col("rate"))
        .limit(2 * ROWS_PER_LANGUAGE * len(sizes))
        .select("lang", "text")
    )

    def counted(batch: pa.RecordBatch) -> pa.RecordBatch:
        at, n = [], []
        for text in batch.column(1).to_pylist():
            counts = _counts(text)
            found = np.flatnonzero(counts)
            at.append(found.astype(np.uint16).tobytes())
            n.append(counts[found].astype(np.float32).tobytes())
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(at, pa.binary()), pa.array(n, pa.binary())], ["lang", "at", "n"]
        )

    rows = common.over_batches(chosen, counted, "lang string, at binary, n binary").collect()
    rows.sort(key=lambda r: (r.lang, bytes(r.at), bytes(r.n)))
    return train([(r.lang, np.frombuffer(r.at, np.uint16), np.frombuffer(r.n, np.float32)) for r in rows])


def predict(docs: DataFrame, model: Model | None, columns: list[str]) -> DataFrame:
    """``columns`` of each document with lang_pred, score (probability) and rejected, from ``text`` alone.

    ``und`` with score 0 for a null text or one without a letter, and for every text without a model; such rows are
    rejected. Repeated rows get equal answers; no rows give none.
    """
    shared = common.prepare(docs.sparkSession).sparkContext.broadcast(model)
    names = [c for c in columns if c not in ("lang_pred", "score", "rejected")]
    rows = docs.select(*[docs[c] for c in names], docs["text"].alias("__text"))
    schema = docs.select(*[docs[c] for c in names]).schema
    for name, kind in (("lang_pred", "string"), ("score", "double"), ("rejected", "boolean")):
        schema = schema.add(name, kind)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        given = common.texts(batch.column(len(names)))
        language, score, rejected = ["und"] * len(given), np.zeros(len(given)), np.ones(len(given), bool)
        at = [i for i, t in enumerate(given) if _has_letter(t)] if shared.value else []
        if at:
            found, p = shared.value.predict([given[i] for i in at])
            for i, name in zip(at, found, strict=True):
                language[i] = name
            score[at], rejected[at] = p, p < shared.value.limit
        return pa.RecordBatch.from_arrays(
            [*batch.columns[: len(names)], pa.array(language), pa.array(score), pa.array(rejected)],
            [*names, "lang_pred", "score", "rejected"],
        )

    return common.over_batches(rows, run, schema)
