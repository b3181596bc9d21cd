"""b-bit MinHash near-duplicate detection, with links confirmed on the full shingle sets.

1. One pass over the texts: the set of hashed shingles, its minima under HASHES hash functions, band keys over groups
   of minima, and the low bits of the minima packed in four integers.
2. Equal sets are one class, held by its smallest doc_id. Only classes go on.
3. A band bucket links its members to one of them, the class of the most copies (of edited copies of a text the text
   itself is usually the one): as many candidates as members, never all pairs. The packed bits estimate
   each candidate's similarity, corrected for chance agreement; those clearly below the limit go, the others are
   confirmed on the full sets. Connected components follow.
4. A link inside a bucket may join two members that the first one is not similar to. Buckets whose
   members are in more than one component after step 3 are therefore compared member by member, across
   components only, inside the join, by the packed bits and then by a wide signature made for these members; a pair
   is looked at in the first band it shares. Survivors are confirmed like the others.

All candidates of all buckets are covered that way, whatever a bucket's size.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zonewise.llm import common

HASHES, BITS = 128, 2
# Default of the operator: five words, similarity 0.8. With 32 bands of 4 minima a pair at 0.8 shares
# no band with probability 5e-8, and at 0.85 with probability 9e-11.
SHINGLE, SIMILARITY = 5, 80
BANDS, ROWS = 32, 4
# Candidates with an estimate this far below the limit go unconfirmed: over six standard deviations.
MARGIN = 0.25
# The wide signature: 1,024 minima tell similarity to 0.013, so this margin is 4.5 standard deviations.
WIDE_HASHES, WIDE_MARGIN = 1024, 0.06
# Ids that are broadcast to find the texts to confirm; more than that are joined.
BROADCAST_IDS = 2_000_000

_RANDOM = np.random.default_rng(20_240_501)
_XOR = _RANDOM.integers(0, 1 << 32, WIDE_HASHES, dtype=np.uint32)
_ODD = _RANDOM.integers(0, 1 << 31, WIDE_HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M2
    return x ^ (x >> np.uint64(29))


def shingles(text: bytes | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; a shorter text is one shingle, one without words has none."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(k, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        out = out * _M1 + h[i : i + len(out)]
    return np.unique(_mixed(out))


def minima(hashes: np.ndarray, n: int = HASHES) -> np.ndarray:
    """Minima of the set under the first ``n`` hash functions."""
    out = np.full(n, 0xFFFFFFFF, np.uint32)
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    step = 4096 * HASHES // n
    for i in range(0, len(low), step):
        part = low[None, i : i + step] ^ _XOR[:n, None]
        part *= _ODD[:n, None]
        np.minimum(out, part.min(axis=1), out=out)
    return out


def band_keys(m: np.ndarray, bands: int, rows: int) -> np.ndarray:
    grouped = m[: bands * rows].reshape(bands, rows).astype(np.uint64)
    key = np.arange(1, bands + 1, dtype=np.uint64) * _M2
    for r in range(rows):
        key = _mixed(key * _M1 + grouped[:, r])
    return key.view(np.int64)


def packed(m: np.ndarray) -> np.ndarray:
    """The low BITS bits of the minima, in 64-bit integers."""
    per = 64 // BITS
    low = (m & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(-1, per)
    return (low << (np.arange(per, dtype=np.uint64) * np.uint64(BITS))).sum(axis=1, dtype=np.uint64).view(np.int64)


SIGNATURES = "doc_id bigint, n_shingles bigint, h1 bigint, h2 bigint, bands array<bigint>, bits array<bigint>"


def signatures(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, h1, h2, keys, bits = [], [], [], [], []
        for text in batch.column(1).to_pylist():
            s = shingles(text, k)
            m = minima(s)
            sizes.append(len(s))
            h1.append(s.sum(dtype=np.uint64))
            h2.append(_mixed(s * _M1).sum(dtype=np.uint64))
            keys.append(band_keys(m, bands, rows) if len(s) else [])
            bits.append(packed(m))
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(sizes, pa.int64()),
                pa.array(np.array(h1, np.uint64).view(np.int64)),
                pa.array(np.array(h2, np.uint64).view(np.int64)),
                pa.array(keys, pa.list_(pa.int64())),
                pa.array(bits, pa.list_(pa.int64())),
            ],
            ["doc_id", "n_shingles", "h1", "h2", "bands", "bits"],
        )

    return common.over_batches(docs, run, SIGNATURES)


def _again(docs: DataFrame, k: int, wide: bool) -> DataFrame:
    """doc_id and h1 of each document, with its full set or its wide signature."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(t, k) for t in batch.column(1).to_pylist()]
        h1 = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
        made = [packed(minima(s, WIDE_HASHES)) if wide else s.view(np.int64) for s in sets]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(h1), pa.array(made, pa.list_(pa.int64()))], ["doc_id", "h1", "made"]
        )

    return common.over_batches(docs, run, "doc_id bigint, h1 bigint, made array<bigint>")


def estimate(a: Column, b: Column, hashes: int = HASHES) -> Column:
    """Similarity by agreeing low bits, less what agrees by chance."""
    per = 64 // BITS
    ones = sum(1 << (BITS * i) for i in range(per))
    mask = F.lit(ones - (1 << 64) if ones >> 63 else ones).cast("bigint")
    differing = []
    for i in range(hashes // per):
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        folded = reduce(lambda y, z: y.bitwiseOR(z), [F.shiftrightunsigned(x, j) for j in range(BITS)])
        differing.append(F.bit_count(folded.bitwiseAND(mask)))
    agreeing = 1 - reduce(lambda y, z: y + z, differing) / hashes
    chance = 2.0**-BITS
    return (agreeing - chance) / (1 - chance)


def _may_link(similarity: int, a: str, b: str) -> Column:
    """Sizes allow the similarity, and the estimate is not clearly below it."""
    na, nb = F.col(f"{a}.n_shingles"), F.col(f"{b}.n_shingles")
    sizes = F.least(na, nb) * 100 >= F.greatest(na, nb) * similarity
    return sizes & (estimate(F.col(f"{a}.bits"), F.col(f"{b}.bits")) >= similarity / 100 - MARGIN)


def components(edges: DataFrame, folder: str, name: str) -> DataFrame:
    """Connected components of (a, b): node and the smallest node it reaches, for every node with an edge.

    Large-star and small-star steps by turns, each written to the work folder, until the edges stay.
    """
    turn, before = 0, None
    held = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    while True:
        held = common.written(held, folder, f"{name}-{turn}")
        state = held.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == before or state[0] == 0:
            return held.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                held.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        before, turn = state, turn + 1
        both = held.union(held.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select("u", "v", "m")
        moved = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        held = small.select("u", F.col("m").alias("v")).union(moved).distinct()


def _confirmed(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    one = sets.select(F.col("doc_id").alias("a"), F.col("made").alias("sa"))
    two = sets.select(F.col("doc_id").alias("b"), F.col("made").alias("sb"))
    common_size = F.size(F.array_intersect("sa", "sb"))
    union_size = F.size("sa") + F.size("sb") - F.col("both")
    # The side of the many first: its sets move once, and rows of a hot ``a`` are then wide enough to be seen and split.
    return (
        pairs.join(two, "b")
        .join(one, "a")
        .withColumn("both", common_size)
        .where(100 * F.col("both") >= similarity * union_size)
        .select("a", "b")
    )


def near_duplicates(
    docs: DataFrame, k: int = SHINGLE, similarity: int = SIMILARITY, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every document (``doc_id``, ``text``).

    Documents are linked where 100 * common >= ``similarity`` * united shingles; component_id is the smallest doc_id
    reachable over links, and kept marks the document that bears it. A text without words has no shingles and no
    link. Rows of one doc_id are one node. A row with a null doc_id is not linked: its component is null and it is kept.
    No documents give no rows; other columns are ignored.
    """
    spark = common.prepare(docs.sparkSession)
    folder = common.work_folder(spark, "neardup")
    rows_in = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    made = common.written(signatures(rows_in, k, bands, rows), folder, "signatures")
    linkable = made.where("n_shingles > 0 and doc_id is not null")
    classes = linkable.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    member = common.written(linkable.join(classes, ["h1", "h2"]), folder, "members")
    reps = member.where("doc_id = rep").select("rep", "copies", "n_shingles", "h1", "bits", "bands")
    signature = reps.select("rep", "n_shingles", "bits")

    # Buckets of one class are of no use; the others keep their members with the first one.
    banded = reps.select("rep", "copies", F.posexplode("bands").alias("band", "key"))
    buckets = (
        banded.groupBy("key")
        .agg(
            F.min("rep").alias("low"),
            F.max("rep").alias("high"),
            F.max(F.struct("copies", (-F.col("rep")).alias("id"))).alias("top"),
        )
        .where("low < high")
        .select("key", (-F.col("top.id")).alias("first"))
    )
    bucket = common.written(
        banded.select("rep", "band", "key").join(buckets, "key").distinct(), folder, "buckets"
    )

    def texts_of(ids: DataFrame, wide: bool, name: str) -> DataFrame:
        """Sets or wide signatures of the classes in ``ids``, made anew from the texts in question only."""
        ids = common.written(ids.distinct(), folder, f"{name}-ids")
        wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
        made = common.written(
            _again(rows_in.join(wanted, "doc_id", "left_semi"), k, wide), folder, f"{name}-sets"
        )
        if made.select("doc_id").distinct().count() < made.count():
            # A repeated doc_id may have a text that does not bear its class.
            bearing = reps.select(F.col("rep").alias("doc_id"), "h1").distinct()
            made = made.join(bearing, ["doc_id", "h1"], "left_semi").dropDuplicates(["doc_id", "h1"])
        return made

    def with_signatures(pairs: DataFrame) -> DataFrame:
        a, b = signature.alias("x"), signature.alias("y")
        joined = pairs.join(a, F.col("a") == F.col("x.rep")).join(b, F.col("b") == F.col("y.rep"))
        return joined.where(_may_link(similarity, "x", "y")).select("a", "b").distinct()

    def confirm(pairs: DataFrame, name: str) -> DataFrame:
        """Pairs confirmed on full sets."""
        pairs = common.written(pairs, folder, f"{name}-candidates")
        ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id")))
        sets = texts_of(ids, False, name)
        return common.written(_confirmed(pairs, sets, similarity).distinct(), folder, f"{name}-links")

    star = bucket.where("rep <> first").select(F.col("first").alias("a"), F.col("rep").alias("b")).distinct()
    links = confirm(with_signatures(star), "star")
    # A doc_id with several texts joins their classes.
    several = member.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b")
    links = links.union(several.select("a", "b")).union(several.select(F.col("doc_id").alias("a"), "b"))
    group = components(links, folder, "components")

    # Buckets that still hold more than one component: members across components, compared in the join.
    placed = bucket.join(group.withColumnRenamed("node", "rep"), "rep", "left").select(
        "key", "band", "rep", F.coalesce("component", "rep").alias("component")
    )
    open_ = placed.groupBy("key").agg(F.min("component").alias("c1"), F.max("component").alias("c2")).where("c1 < c2")
    unsettled = common.written(placed.join(open_.select("key"), "key", "left_semi"), folder, "open-buckets")
    wide = texts_of(unsettled.select(F.col("rep").alias("doc_id")), True, "wide")
    wide = wide.select(F.col("doc_id").alias("rep"), F.col("made").alias("wide"))
    rest = unsettled.join(reps.select("rep", "n_shingles", "bits", "bands").join(wide, "rep"), "rep")
    x, y = rest.alias("x"), rest.alias("y")
    earlier = [F.slice(f"{side}.bands", F.lit(1), F.col("x.band")) for side in ("x", "y")]
    close = estimate(F.col("x.wide"), F.col("y.wide"), WIDE_HASHES) >= similarity / 100 - WIDE_MARGIN
    across = (
        x.join(
            y,
            (F.col("x.key") == F.col("y.key"))
            & (F.col("x.rep") < F.col("y.rep"))
            & (F.col("x.component") != F.col("y.component"))
            & _may_link(similarity, "x", "y")
            & close
            # Keys of different bands never agree: no overlap means that this is the first band in common.
            & ~F.arrays_overlap(*earlier),
        )
        .select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))
        .distinct()
    )
    more = confirm(across, "across")
    if more.limit(1).count():
        # Every node stands for its component now.
        named = group.withColumnRenamed("component", "c")
        ends = more
        for end in ("a", "b"):
            ends = ends.join(named.withColumnRenamed("node", end), end, "left").withColumn(
                end, F.coalesce("c", end)
            ).drop("c")
        upper = components(ends, folder, "upper")
        group = (
            group.join(upper.select(F.col("node").alias("component"), F.col("component").alias("top")), "component", "left")
            .select("node", F.coalesce("top", "component").alias("component"))
            .union(upper.join(group, upper["node"] == group["node"], "left_anti"))
        )
        group = common.written(group.distinct(), folder, "groups")

    linked = member.select("doc_id", "n_shingles", "rep").join(
        group.withColumnRenamed("node", "rep"), "rep", "left"
    ).select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    alone = made.where("n_shingles = 0 or doc_id is null").select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id")
    )
    return linked.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, **settings) -> DataFrame:
    """The documents with one of each group of near-duplicates: the row of its smallest doc_id (a null one comes last).

    A document is its doc_id and text together: rows of one doc_id with different texts are compared like any others, so
    no text is lost that is like no other. Of rows that agree in both one stays, those without doc_id too.
    """
    row = F.struct(*[docs[c] for c in docs.columns])
    node = F.xxhash64(docs["doc_id"].cast("string"), F.lit("/"), docs["text"])
    named = docs.select(row.alias("row"), node.alias("node"))
    found = near_duplicates(docs.select(node.alias("doc_id"), docs["text"]), **settings)
    group = found.select(F.col("doc_id").alias("node"), F.col("component_id").alias("group")).distinct()
    ids = named.select("node", F.col("row.doc_id").cast("bigint").alias("id")).distinct()
    order = F.struct(F.col("id").isNull().alias("none"), "id", "node")
    first = group.join(ids, "node").groupBy("group").agg(F.min_by("node", order).alias("node")).select("node")
    kept = named.join(first, "node")
    # Rows of one node agree in doc_id and text but for equal hashes, which lose no row here.
    same = Window.partitionBy("node", "row.doc_id", "row.text").orderBy(F.xxhash64("row"))
    return kept.withColumn("nth", F.row_number().over(same)).where("nth = 1").select("row.*")
