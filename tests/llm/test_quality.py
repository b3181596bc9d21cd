import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from zonewise.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


TEXTS = [
    None, "", " \t\n", "one", "a b", "a b c", "a b c a b c", "x x x x x", "l1\nl1\n\n \nl1 \nl2", "#*$%&|<> é ü\x1f y\xa0z",
    "a b c d a b c e f a b c", "Ab! CD", "the end. " * 3000, "\x0bq\x0cr\rs", "a b c d b c d",
]


def test_statistics_equal_brute_force(spark, docs, table):
    rows = list(enumerate(TEXTS)) + [(1000 + r.doc_id, r.text) for r in table("documents").collect()]
    made = quality.judge(docs(rows), [])
    got = {r.row.doc_id: tuple(r[c] for c in quality.STATISTICS) for r in made.collect()}
    assert got == {i: brute(t) for i, t in rows}
    failed = {r.row.doc_id for r in made.where("base_failed").collect()}
    assert failed == {i for i, t in rows if brute(t)[0] < 50 or 100 * brute(t)[4] > 50 * brute(t)[0]}
    assert made.where("base_failed = kept").count() == 0


def test_rows_travel_unchanged(docs):
    given = docs([(1, "a b"), (1, "a b"), (None, None)])
    back = quality.judge(given, []).select("row.*")
    assert back.columns == given.columns and back.count() == 3
    assert quality.judge(docs([]), []).collect() == []


def test_learning_finds_planted_rules_and_spares_the_rest():
    draw = np.random.default_rng(1)
    values = draw.random((3_000, len(quality.FEATURES)))
    symbols, share = values[:, quality.FEATURES.index("symbols_per_word")], values[:, quality.FEATURES.index("capital_share")]
    bad = (symbols > 0.8) | ((share > 0.7) & (symbols < 0.3))
    rules = quality.learn(values, bad)
    rejected = np.zeros(len(bad), bool)
    for rule in rules:
        rejected |= quality._covers(rule, values)
    assert (rejected & bad).sum() > 0.9 * bad.sum() and (rejected & ~bad).sum() <= 0.02 * (~bad).sum()
    assert quality.learn(values[:5], bad[:5]) == [] and quality.learn(values[:0], bad[:0]) == []
    assert quality.learn(values, draw.random(3_000) < 0.1) == []


def test_expressions_agree_with_the_rules(spark, table):
    rules = [
        (quality.Condition("symbols_per_word", True, 0.2),),
        (quality.Condition("words", False, 80.0), quality.Condition("capital_share", True, 0.03)),
    ]
    measured = quality.with_statistics(table("documents").select(F.struct("doc_id").alias("row"), "text"))
    rows = measured.select(quality.verdict(rules).alias("kept"), quality.base_failed().alias("f"), *[v.alias(k) for k, v in quality._features().items()]).collect()
    values = np.array([[r[f] for f in quality.FEATURES] for r in rows])
    held = np.array([r.f for r in rows])
    for rule in rules:
        held |= quality._covers(rule, values)
    assert [not r.kept for r in rows] == held.tolist()


def test_fitted_rules_keep_good_documents(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rules = quality.fit(docs, labels)
    judged = quality.judge(docs, rules).where("not base_failed").select("row.doc_id", "kept").join(labels, "doc_id")
    good = judged.where("quality = 1").agg(F.avg(F.col("kept").cast("int"))).first()[0]
    bad = judged.where("quality = 0").agg(F.avg(F.col("kept").cast("int"))).first()[0]
    assert good >= 0.98 and bad <= 0.3


def test_no_labels_no_rules(spark, docs):
    labels = spark.createDataFrame([(1, None), (None, 0)], "doc_id long, quality int")
    assert quality.fit(docs([(1, "a b c")]), labels) == []
