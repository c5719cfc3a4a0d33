"""The stages on a small table, each against its operator's own verdicts."""

from __future__ import annotations

import collections

import corpus_pipeline
from parlance.llm import cotraining, cube_mixing, hyperminhash, quality_rules
from parlance.llm.common import Stash

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    stash = Stash(spark)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    names = docs.columns
    kept = lambda df: sorted(r["doc_id"] for r in df.where("kept").collect())
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    steps = [f for _, f in corpus_pipeline.STAGES]

    first = stash.put(steps[0](spark, docs, DATA), "a")
    assert first.columns == names and ids(first) == kept(quality_rules.apply(docs, quality_rules.fit(docs, labels)))
    second = stash.put(steps[1](spark, first, DATA), "b")
    assert second.columns == names and ids(second) == kept(cotraining.apply(first, cotraining.fit(first, labels)))
    good = {r["doc_id"] for r in labels.where("quality = 1").collect()}
    assert len(good & set(ids(second))) >= 0.9 * len(good & set(ids(first)))
    third = stash.put(steps[2](spark, second, DATA), "c")
    assert third.columns == names and ids(third) == kept(hyperminhash.deduplicated(second, 80))
    fourth = stash.put(steps[3](spark, third, DATA), "d")
    often = {r["doc_id"]: r["copies"] for r in cube_mixing.copies(cube_mixing.sized(third), Stash(spark)).collect()}
    assert fourth.columns == names and collections.Counter(ids(fourth)) == collections.Counter({i: n for i, n in often.items() if n})
    last = steps[4](spark, fourth, DATA).collect()
    assert collections.Counter(r["doc_id"] for r in last if r["start"] == 0) == collections.Counter(ids(fourth))
