"""Quality rules: text statistics, base limits, and a decision list learned from labelled statistics.

Sequential covering: a rule is a conjunction of thresholds, grown on one part of the labelled rows by
information gain and pruned on the other; the rows it covers are set aside and the next one is grown.
The list becomes one ordered conditional expression over built-in functions.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the contract: white space, symbol characters, base limits.
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
# Labelled rows the list is learned from at most.
LABELLED_ROWS = 20_000
# Thresholds tried for each statistic, conditions in a rule, rules in a list.
CUTS, MAX_CONDITIONS, MAX_RULES = 32, 4, 16
# A rule stays if it is right about this share of the pruning rows it covers, and covers this many growing rows.
MIN_PRECISION, MIN_COVERED = 0.97, 8

STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = [
    "words", "chars_per_word", "symbols_per_word", "dup_lines_per_word", "repeat_share", "capital_share", "bangs_per_word",
]


def _char_count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def with_statistics(rows: DataFrame) -> DataFrame:
    """From (row, text): row, the five statistics as bigint, n_capitals and n_bangs. A null text has no words.

    Every step is linear or a sort within the row, so very long texts cost in proportion. Steps that are
    used more than once are columns of their own: within a lambda function they would be computed for each element.
    """
    text = F.coalesce("text", F.lit(""))
    one = rows.select("row", text.alias("text")).select("row", "text", F.btrim("text", F.lit(SPACE)).alias("trimmed"))
    two = one.select(
        "row",
        (F.length("text") - F.length(F.translate("text", SPACE, ""))).alias("spaces"),
        F.length("text").alias("chars"),
        _char_count(F.col("text"), SYMBOLS).alias("n_symbols"),
        _char_count(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_capitals"),
        _char_count(F.col("text"), "!").alias("n_bangs"),
        F.when(F.col("trimmed") == "", F.array().cast("array<string>"))
        .otherwise(F.split("trimmed", r"[\x20\x09-\x0D]+"))
        .alias("words"),
        F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "").alias("lines"),
    )
    three = two.select(
        "row", "spaces", "chars", "n_symbols", "n_capitals", "n_bangs",
        F.size("words").alias("n_words"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    four = three.withColumn(
        "windows",
        F.when(F.col("n_words") < 3, F.array().cast("array<bigint>")).otherwise(
            F.transform(
                F.sequence(F.lit(0), F.col("n_words") - 3),
                lambda i: F.xxhash64(F.col("hashes")[i], F.col("hashes")[i + 1], F.col("hashes")[i + 2]),
            )
        ),
    ).drop("hashes")
    # Windows that occur once need no positions; most texts have no other.
    five = four.withColumn("repeats", F.size("windows") > F.size(F.array_distinct("windows")))
    six = five.withColumn(
        "sorted",
        F.when(
            F.col("repeats"), F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        ),
    ).drop("windows")
    found = F.col("sorted")
    seven = six.withColumn(
        "starts",
        F.sort_array(
            F.transform(
                F.filter(found, lambda x, k: _twin(found, x, k)),
                lambda x: x["i"],
            )
        ),
    ).drop("sorted")
    starts = F.col("starts")
    covered = F.aggregate(
        F.transform(starts, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(starts, k + 1) - p, F.lit(3)))),
        F.lit(0),
        lambda total, n: total + n,
    )
    counts = F.struct(
        F.col("n_words").cast("bigint").alias("n_words"),
        (F.col("chars") - F.col("spaces")).cast("bigint").alias("word_chars"),
        F.col("n_symbols").cast("bigint").alias("n_symbols"),
        F.col("n_dup_lines").cast("bigint").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("bigint").alias("n_repeat_words"),
        "n_capitals",
        "n_bangs",
    )
    # A filter on the counts would be pushed below the steps, every step written out in it again and again. It
    # can't pass a generator.
    return seven.select("row", F.inline(F.array(counts)))


def _twin(found: Column, x: Column, k: Column) -> Column:
    """Whether the entry before or after ``k`` in the sorted windows has the same hash."""
    before = F.when(k > 0, F.get(found, k - 1)["h"])
    return F.coalesce(before == x["h"], F.lit(False)) | F.coalesce(F.get(found, k + 1)["h"] == x["h"], F.lit(False))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _features() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    values = [
        F.col("n_words"), F.col("word_chars") / words, F.col("n_symbols") / words, F.col("n_dup_lines") / words,
        F.col("n_repeat_words") / words, F.col("n_capitals") / F.greatest(F.col("word_chars"), F.lit(1)),
        F.col("n_bangs") / words,
    ]
    return {name: value.cast("double") for name, value in zip(FEATURES, values, strict=True)}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def holds(self, values: np.ndarray) -> np.ndarray:
        column = values[:, FEATURES.index(self.feature)]
        return column > self.cut if self.above else column <= self.cut

    def expression(self) -> Column:
        value = _features()[self.feature]
        return value > self.cut if self.above else value <= self.cut

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:.6g}"


Rule = tuple[Condition, ...]


def _covers(rule: Rule, values: np.ndarray) -> np.ndarray:
    out = np.ones(len(values), bool)
    for condition in rule:
        out &= condition.holds(values)
    return out


def _grow(values: np.ndarray, bad: np.ndarray) -> Rule:
    """Add the condition of the largest information gain until no good row is covered or nothing is gained."""
    rule: Rule = ()
    inside = np.ones(len(values), bool)
    while len(rule) < MAX_CONDITIONS and (inside & ~bad).any():
        p0, n0 = (inside & bad).sum(), (inside & ~bad).sum()
        best, best_gain = None, 1e-9
        for f, feature in enumerate(FEATURES):
            column = values[inside, f]
            for cut in np.unique(np.quantile(column, np.linspace(0, 1, CUTS), method="lower")):
                for above in (True, False):
                    held = (values[:, f] > cut if above else values[:, f] <= cut) & inside
                    p, n = (held & bad).sum(), (held & ~bad).sum()
                    if p >= MIN_COVERED:
                        gain = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))
                        if gain > best_gain:
                            best, best_gain = Condition(feature, above, float(cut)), gain
        if best is None:
            break
        rule = (*rule, best)
        inside &= best.holds(values)
    return rule


def _prune(rule: Rule, values: np.ndarray, bad: np.ndarray) -> Rule:
    """The shortest start of the rule that does best on the pruning rows."""

    def worth(r: Rule) -> float:
        held = _covers(r, values)
        p, n = (held & bad).sum(), (held & ~bad).sum()
        return (p - n) / (p + n) if p + n else -1.0

    starts = [rule[:k] for k in range(1, len(rule) + 1)]
    return max(starts, key=worth) if starts else ()


def learn(values: np.ndarray, bad: np.ndarray) -> list[Rule]:
    """An ordered list of rules that reject. ``values``: a row per text, a column per feature; ``bad``: its label.

    Rows that hold for the growing and pruning parts are told apart by their place, every third one prunes.
    """
    rules: list[Rule] = []
    left = np.ones(len(values), bool)
    pruning = np.arange(len(values)) % 3 == 2
    while len(rules) < MAX_RULES:
        grow, prune = left & ~pruning, left & pruning
        if (grow & bad).sum() < MIN_COVERED or not (grow & ~bad).any():
            break
        rule = _prune(_grow(values[grow], bad[grow]), values[prune], bad[prune])
        held = _covers(rule, values) & left
        p, n = (held & prune & bad).sum(), (held & prune & ~bad).sum()
        if not rule or p == 0 or p < MIN_PRECISION * (p + n) or (held & grow & bad).sum() < MIN_COVERED:
            break
        rules.append(rule)
        left &= ~held
    return rules


def fit(docs: DataFrame, labels: DataFrame) -> list[Rule]:
    """Learn the list from at most LABELLED_ROWS labelled documents that pass the base limits.

    ``labels`` has doc_id and quality (1 good, 0 bad; null is no label). The rows with the smallest hashes are taken. Without
    enough labels of both kinds the list is empty and rejects nothing.
    """
    known = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(LABELLED_ROWS)
    )
    joined = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    measured = with_statistics(joined.select(F.struct("doc_id", "quality").alias("row"), "text"))
    features = [value.alias(name) for name, value in _features().items()]
    rows = (
        measured.where(~base_failed())
        .select(F.xxhash64("row.doc_id").alias("h"), F.col("row.quality").alias("quality"), *features)
        .orderBy("h", *FEATURES)
        .limit(LABELLED_ROWS)
        .collect()
    )
    values = np.array([[r[f] for f in FEATURES] for r in rows], float).reshape(-1, len(FEATURES))
    return learn(values, np.array([r.quality == 0 for r in rows], bool))


def verdict(rules: list[Rule]) -> Column:
    """True for rows to keep: the first rule that holds rejects."""
    out = F.when(base_failed(), F.lit(False))
    for rule in rules:
        held = rule[0].expression()
        for condition in rule[1:]:
            held = held & condition.expression()
        out = out.when(held, F.lit(False))
    return out.otherwise(F.lit(True))


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """For every document its row as a struct (row), the statistics, base_failed and kept.

    A null or empty text has no words, so it fails the base limits. Rows are judged each on its own: repeated
    ones alike; no rows give none; columns of any name travel within ``row``.
    """
    measured = with_statistics(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["text"]))
    return measured.select("row", *STATISTICS, base_failed().alias("base_failed"), verdict(rules).alias("kept"))
