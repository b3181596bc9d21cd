"""Jump consistent hashing: shards for stable keys without a table of the ring.

A key's jumps b0 < b1 < ... depend on the key alone; its shard among n is the last jump below n. One more
shard therefore takes keys only into itself, and just the share that belongs there. The random
draws come from the built-in 64-bit hash of (key, step).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A shard's rows are numbered in this many parts, so that no task holds a whole shard.
PARTS = 256
# Rows that agree in all columns are numbered in runs of this many.
RUN = 1_000_000


def jump_shards(key: Column, shards: int) -> Column:
    """Struct (shard, grown_shard) of a key: its shard among ``shards`` and among one more. A null key is a key too."""
    start = F.struct(F.lit(-1).alias("before"), F.lit(-1).alias("at"), F.lit(0).cast("double").alias("next"))

    def step(state: Column, i: Column) -> Column:
        draw = (F.shiftrightunsigned(F.xxhash64(key, i), 33) + 1).cast("double")
        at = state["next"].cast("int")
        jumped = F.struct(
            state["at"].alias("before"), at.alias("at"), F.floor((at + 1) * (2.0**31 / draw)).cast("double").alias("next")
        )
        return F.when(state["next"] <= shards, jumped).otherwise(state)

    # Jumps grow by one at least, so there are at most shards + 1 of them.
    last = F.aggregate(F.sequence(F.lit(0), F.lit(shards)), start, step)
    return F.transform(
        F.array(last),
        lambda s: F.struct(
            F.when(s["at"] == shards, s["before"]).otherwise(s["at"]).alias("shard"), s["at"].alias("grown_shard")
        ),
    )[0]


def with_shards(rows: DataFrame, key: str, shards: int) -> DataFrame:
    """Add (or replace) the columns shard and grown_shard. Nothing is shuffled.

    Rows with a null key share one shard; equal keys always do.
    """
    kept = [rows[c] for c in rows.columns if c not in ("shard", "grown_shard")]
    placed = jump_shards(rows[key], shards)
    inner = rows.select(F.struct(*kept).alias("row"), placed.alias("placed"))
    return inner.select("row.*", "placed.shard", "placed.grown_shard")


def write_shards(rows: DataFrame, key: str, shards: int, path: str) -> None:
    """Write the rows as Parquet, one folder per shard."""
    with_shards(rows, key, shards).write.mode("overwrite").partitionBy("shard").parquet(path)


def assign(docs: DataFrame, shards: int = 40) -> DataFrame:
    """Place of every document (``doc_id``, ``text``): shard, gapless slot in it, and shard once one more is added.

    Returns doc_id, size (UTF-8 bytes of the text and 16), text_crc32, law, shard, slot, grown_shard.
    A null text has no bytes and the checksum 0. Equal rows are numbered like different ones. No rows give none.
    Other columns are ignored.
    """
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(16)).cast("bigint").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("bigint").alias("text_crc32"),
    )
    same = ["doc_id", "size", "text_crc32"]
    counted = rows.groupBy(*same).agg(F.count(F.lit(1)).alias("n"))
    runs = (
        with_shards(counted, "doc_id", shards)
        .withColumn("run", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / RUN))))
        .withColumn("n", F.least(F.lit(RUN), F.col("n") - F.col("run") * RUN))
        .withColumn("part", F.pmod(F.xxhash64(*same, "run", F.lit("part")), F.lit(PARTS)))
    )
    # At most shards * PARTS rows.
    totals = runs.groupBy("shard", "part").agg(F.sum("n").alias("total"))
    earlier = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("shard", "part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))
    ahead = Window.partitionBy("shard", "part").orderBy(*same, "run").rowsBetween(Window.unboundedPreceding, -1)
    placed = runs.withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0))).join(
        F.broadcast(bases), ["shard", "part"]
    )
    first = F.col("base") + F.col("ahead")
    return placed.select(
        *same,
        F.lit("key").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        F.explode(F.sequence(first, first + F.col("n") - 1)).alias("slot"),
        F.col("grown_shard").cast("int").alias("grown_shard"),
    )
