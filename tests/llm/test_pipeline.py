"""The stages against brute force on the small tables, one after the other."""

from collections import Counter

import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

from tests_llm_brute import components, hit_documents

from zonewise.llm import common, pseudonyms, quality
from zonewise.llm.queries import pseudonym_key


def test_stages(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    work = common.work_folder(spark, "test")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.written(stage(spark, docs, folder), work, name)
        assert out.columns == docs.columns
        kept.append({r.doc_id: r for r in out.collect()})
        docs = out
    first = {r.doc_id: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    # 9: base limits hold for all that is kept; what only the learned list rejects is labelled bad, mostly.
    judged = quality.judge(spark.createDataFrame(list(first.values())), []).select("row.doc_id", "base_failed").collect()
    failed = {r.doc_id for r in judged if r.base_failed}
    assert not failed & kept[0].keys()
    rejected = first.keys() - failed - kept[0].keys()
    assert sum(labels.get(i) == 1 for i in rejected) <= 0.02 * len(first)
    # 4: one document of each group.
    groups = components({i: r.text for i, r in kept[0].items()}, 5, 80)
    assert kept[1].keys() == set(groups.values())
    # 10: no document with a benchmark window.
    items = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    assert kept[2].keys() == kept[1].keys() - hit_documents({i: r.text for i, r in kept[1].items()}, items)
    # 3: every text is the pseudonymised one, all else as it was.
    replace = pseudonyms.Pseudonyms(pseudonym_key(spark))
    assert {i: r.text for i, r in kept[3].items()} == {i: replace(r.text)[0] for i, r in kept[2].items()}
    assert all(r.lang == first[i].lang and r.source == first[i].source for i, r in kept[3].items())
    # 1: all ids of all documents are packed once.
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    packed = Counter()
    for r in corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect():
        packed[r.doc_id] += r.length
    assert packed == {i: len(plain.encode(r.text, add_special_tokens=False).ids) + 1 for i, r in kept[3].items()}
