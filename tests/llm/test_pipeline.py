"""The pipeline, each stage held against a plain version of it on what its predecessor kept."""

import public_tokenizers
import test_minhash
import test_packing
import test_suffixes
from conftest import SMALL

import __spark_entry__ as contract
import corpus_pipeline
from dealgrove.llm import quality, toxicity
from dealgrove.llm.base import stored


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SMALL), name)
        kept.append(docs)
    assert all(d.columns == columns for d in kept[:-1])
    ids = [{r[0] for r in d.select("doc_id").collect()} for d in kept]
    assert all(a >= b for a, b in zip(ids, ids[1:], strict=False))
    first = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    assert ids[0] == {r[0] for r in toxicity.judge(first, labels).where("predicted = 0").select("doc_id").collect()}
    assert ids[1] == {r[0] for r in quality.judge(kept[0]).where("kept").select("doc_id").collect()}
    pairs = [tuple(r) for r in kept[1].select("doc_id", "text").collect()]
    assert ids[2] == set(test_minhash.classes(pairs))
    before = {r.doc_id: r.text for r in kept[2].collect()}
    removed = {i: n for i, _, n, _, _ in test_suffixes.brute(list(before.items()))}
    after = {r.doc_id: r for r in kept[3].collect()}
    assert set(after) == set(before)
    assert all(len(before[i].encode()) - len(after[i].text.encode()) in range(n, n + 8) and (n == 0 or after[i].n_chars == len(after[i].text)) for i, n in removed.items())
    test_packing.check(kept[4], [(i, r.text) for i, r in after.items()])


def test_run_is_registered(spark):
    assert contract.queries()["pipeline"] is corpus_pipeline.run
    rows = corpus_pipeline.run(spark, SMALL)
    assert rows.count() > 0 and public_tokenizers.path("") and set(rows.columns) >= {"doc_id", "sequence_id", "offset"}
