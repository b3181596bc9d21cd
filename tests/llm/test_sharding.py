import zlib
from collections import Counter

from pyspark.sql import functions as F

from zonewise.llm import sharding


def test_jumps_equal_the_plain_algorithm(spark):
    draws = spark.range(300).select("id", *[
        (F.shiftrightunsigned(F.xxhash64("id", F.lit(i)), 33) + 1).alias(f"d{i}") for i in range(41)
    ]).collect()
    got = {(n, r.id): (r.shard, r.grown_shard) for n in (1, 7, 40) for r in sharding.with_shards(spark.range(300), "id", n).collect()}

    def shard(row, n):
        b, j, i = -1, 0, 0
        while j < n:
            b, j, i = j, int((j + 1) * (2.0**31 / row[f"d{i}"])), i + 1
        return b

    for n in (1, 7, 40):
        for r in draws:
            assert got[(n, r.id)] == (shard(r, n), shard(r, n + 1))


def test_one_more_shard_takes_its_share_only_into_itself(spark):
    rows = sharding.with_shards(spark.range(40_000), "id", 40).collect()
    assert all(r.grown_shard in (r.shard, 40) for r in rows)
    sizes = Counter(r.shard for r in rows)
    assert len(sizes) == 40 and max(sizes.values()) < 1.25 * 1000 and min(sizes.values()) > 0.75 * 1000
    assert 700 < sum(r.grown_shard == 40 for r in rows) < 1300


def test_assign(docs, monkeypatch):
    monkeypatch.setattr(sharding, "RUN", 7)
    rows = [(i, "é" * (i % 5) if i % 11 else None) for i in range(200)] + [(3, "same")] * 50 + [(None, "x"), (None, None)]
    out = sharding.assign(docs(rows).repartition(4)).collect()
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in out) == want
    assert {r.law for r in out} == {"key"}
    assert len({(r.doc_id, r.shard, r.grown_shard) for r in out}) == len({r.doc_id for r in out})
    for shard in {r.shard for r in out}:
        slots = sorted(r.slot for r in out if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert sharding.assign(docs([])).collect() == []


def test_write_shards(spark, docs, tmp_path):
    given = docs([(i, str(i)) for i in range(50)])
    sharding.write_shards(given, "doc_id", 4, str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 50 and back.select("shard").distinct().count() <= 4
