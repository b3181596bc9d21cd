"""Registered queries of the training-data operators, one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zonewise.llm import (
    common,
    decontaminate,
    html_text,
    language,
    licenses,
    neardup,
    packing,
    pseudonyms,
    quality,
    role_repair,
    runs,
    sharding,
    token_files,
    toxicity,
)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(_table(spark, folder, "documents"), vocabulary("byte_bpe_50k.json"), end_id=2, capacity=1024)


def _held_out(classes: int, remainder: int) -> Column:
    """Whether crc32 of doc_id as text leaves the remainder; a null doc_id is never held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % classes == remainder, F.lit(False))


def op2_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    model = language.fit(docs, ~_held_out(4, 2))
    found = language.predict(docs, model, ["doc_id"])
    return found.select("doc_id", _held_out(4, 2).alias("held_out"), "lang_pred", "score", "rejected")


# Production reads the key from a secret store; the session setting stands in for it here.
KEY_SETTING, DEMONSTRATION_KEY = "spark.zonewise.pseudonymKey", "demonstration key"


def pseudonym_key(spark: SparkSession) -> bytes:
    return spark.conf.get(KEY_SETTING, DEMONSTRATION_KEY).encode()


def op3_feistel_pseudonyms(spark: SparkSession, folder: str) -> DataFrame:
    return pseudonyms.digest(_table(spark, folder, "documents"), pseudonym_key(spark))


def op4_bbit_minhash(spark: SparkSession, folder: str) -> DataFrame:
    # 25 bands of 5 minima: a pair at 0.85 shares no band with probability 4e-7.
    return neardup.near_duplicates(_table(spark, folder, "documents"), k=3, similarity=85, bands=25, rows=5)


def op5_toxicity_fm(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    model = toxicity.fit(docs, _table(spark, folder, "labels"), ~_held_out(3, 1))
    found = toxicity.score(docs, model, ["doc_id"])
    return found.select("doc_id", _held_out(3, 1).alias("held_out"), "score", "predicted")


def op6_html_lstm(spark: SparkSession, folder: str) -> DataFrame:
    pages = _table(spark, folder, "pages")
    return html_text.extract(pages, html_text.fit(pages))


def op7_jump_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.assign(_table(spark, folder, "documents"), shards=40)


def op8_token_files(spark: SparkSession, folder: str) -> DataFrame:
    place = common.work_folder(spark, "tokens")
    store = token_files.write(_table(spark, folder, "documents"), place, vocabulary("word_bpe_49k.json"), end_id=1)
    return token_files.read(spark, store)


def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    rules = quality.fit(docs, _table(spark, folder, "labels"))
    return quality.judge(docs, rules).select(F.col("row.doc_id").alias("doc_id"), *quality.STATISTICS, "base_failed", "kept")


def op10_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.report(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    planted = docs.select("doc_id", runs.plant_tail(F.col("doc_id"), F.col("text")).alias("text"))
    return runs.digest(runs.periodic_runs(planted, ["doc_id"]))


def op12_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.report(licenses.scan(_table(spark, folder, "documents"), ["doc_id"])).drop("spans")


def op13_role_repair(spark: SparkSession, folder: str) -> DataFrame:
    return role_repair.report(_table(spark, folder, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_language_id": op2_language_id,
    "op3_feistel_pseudonyms": op3_feistel_pseudonyms,
    "op4_bbit_minhash": op4_bbit_minhash,
    "op5_toxicity_fm": op5_toxicity_fm,
    "op6_html_lstm": op6_html_lstm,
    "op7_jump_sharding": op7_jump_sharding,
    "op8_token_files": op8_token_files,
    "op9_quality_rules": op9_quality_rules,
    "op10_decontamination": op10_decontamination,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_license_scan": op12_license_scan,
    "op13_role_repair": op13_role_repair,
}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS_SQL = (
    f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)

# The others have no SQL form: a tokenizer, 64-bit hashes or a trained model stands in them.
ORACLES: dict[str, str] = {
    "op10_decontamination": f"""
with d as (select row_number() over () as rid, doc_id, {WORDS_SQL} as w from documents),
b as (select coalesce(cast(item_id as varchar), '') as item, {WORDS_SQL} as w from benchmark),
items as (select item, w, least(10, len(w)) as n from b where len(w) > 0),
windows as (
  select distinct item, n, array_to_string(w[i : i + n - 1], ' ') as g
  from (select *, unnest(range(1, len(w) - n + 2)) as i from items)),
sizes as (select distinct n from windows),
scanned as (
  select rid, n, i, array_to_string(w[i : i + n - 1], ' ') as g
  from (select rid, w, n, unnest(range(1, len(w) - n + 2)) as i from d, sizes where len(w) >= n)),
hits as (select rid, i, scanned.n as n, item from scanned join windows on scanned.n = windows.n and scanned.g = windows.g),
places as (select rid, count(distinct p) as n_hit from (select rid, unnest(range(i, i + n)) as p from hits) group by 1),
found as (
  select rid, count(*) as n_items, string_agg(item, ',' order by item) as names
  from (select distinct rid, item from hits) group by 1)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join places using (rid) left join found using (rid)""",
}
