import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from zonewise.llm import neardup


def brute(rows, k, similarity):
    """Components by comparing all pairs."""

    def shingles(text):
        w = (text or "").encode().lower().split()
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())

    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= similarity * len(a | b):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: (len(s), find(i)) for i, s in sets}


def corpus(seed=3):
    """Copies, near copies, chains whose ends are not similar, shared passages and short texts."""
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for _ in range(12):
        base = draw.choices(vocabulary, k=draw.randint(30, 200))
        for _ in range(draw.randint(1, 6)):
            words = list(base)
            for _ in range(draw.randint(0, 3)):
                words[draw.randrange(len(words))] = draw.choice(vocabulary)
            rows.append((n, " ".join(words)))
            n += 1
    chain = draw.choices(vocabulary, k=120)
    for _ in range(12):
        rows.append((n, " ".join(chain)))
        n += 1
        for _ in range(2):
            chain[draw.randrange(len(chain))] = draw.choice(vocabulary)
    passage = draw.choices(vocabulary, k=60)
    for _ in range(15):
        rows.append((n, " ".join(passage + draw.choices(vocabulary, k=draw.randint(5, 60)))))
        n += 1
    rows += [(n, "a b"), (n + 1, "A  b"), (n + 2, "a"), (n + 3, ""), (n + 4, None), (n + 5, " \t\n"), (n + 6, "a b c d " * 4000)]
    order = list(range(len(rows)))
    draw.shuffle(order)
    return [(order[i], t) for i, t in rows]


@pytest.mark.parametrize("k, similarity, bands, rows_each", [(3, 85, 25, 5), (5, 80, 32, 4)])
def test_components_equal_brute_force(docs, k, similarity, bands, rows_each):
    rows = corpus()
    out = neardup.near_duplicates(docs(rows).repartition(3), k, similarity, bands, rows_each).collect()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in out}
    assert len(out) == len(rows) and got == brute(rows, k, similarity)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_null_and_repeated_ids(docs):
    text = "one two three four five six seven"
    rows = [(None, text), (5, text), (5, text), (9, text), (9, "something else entirely written here today"), (4, "")]
    got = sorted(map(str, neardup.near_duplicates(docs(rows)).select("doc_id", "component_id", "kept").collect()))
    assert got == sorted(
        [
            "Row(doc_id=None, component_id=None, kept=True)",
            *["Row(doc_id=5, component_id=5, kept=True)"] * 2,
            *["Row(doc_id=9, component_id=5, kept=False)"] * 2,
            "Row(doc_id=4, component_id=4, kept=True)",
        ]
    )
    kept = neardup.keep_one(docs(rows))
    assert kept.columns == docs(rows).columns
    # The text of 9 that is like no other stays, and so does one row of the copies: that of the smallest id.
    assert sorted(r.doc_id for r in kept.collect()) == [4, 5, 9]


def test_keep_one_loses_no_text_of_its_own(docs):
    a, b, c = ("a b c d e f g h", "one two three four five six", "uno dos tres cuatro cinco seis")
    rows = [(1, a), (1, b), (7, b), (None, c), (None, c), (None, ""), (None, None), (1, "")]
    kept = [(r.doc_id, r.text) for r in neardup.keep_one(docs(rows).repartition(3)).collect()]
    assert sorted(kept, key=str) == sorted([(1, a), (1, b), (None, c), (None, ""), (None, None), (1, "")], key=str)
    assert neardup.keep_one(docs([])).collect() == []


def test_no_documents(docs):
    assert neardup.near_duplicates(docs([])).collect() == []
    assert neardup.keep_one(docs([])).collect() == []


def test_estimates_are_near_the_similarity(spark):
    draw = np.random.default_rng(5)
    pool = draw.integers(0, 1 << 63, 3_000).astype(np.uint64)
    a = np.unique(pool[:2_000])
    for shared in (0, 1_000, 1_800):
        b = np.unique(pool[2_000 - shared : 3_000])
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        bits = [neardup.packed(neardup.minima(x)).tolist() for x in (a, b)]
        row = spark.createDataFrame([tuple(bits)], "a array<bigint>, b array<bigint>")
        assert row.select(neardup.estimate(F.col("a"), F.col("b")).alias("s")).first().s == pytest.approx(true, abs=0.2)
