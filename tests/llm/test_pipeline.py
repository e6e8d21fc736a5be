"""The pipeline's stages, each against plain Python on its own input."""

import os

import pytest

import corpus_pipeline as pipeline
from tests.llm.test_jaccard import brute as components
from tests.llm.test_sharding_lines import brute as lines
from tessera.llm import decontaminate
from tessera.llm.common import stored, table

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


def test_stages(spark):
    docs = table(spark, DATA, "documents")
    columns, kept = docs.columns, {}
    labels = {r["doc_id"]: r["toxic"] for r in table(spark, DATA, "labels").collect()}
    for name, stage in pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = stored(stage(spark, docs, DATA), name)
        after = {r["doc_id"]: r["text"] for r in docs.collect()} if name != "packing" else None
        kept[name] = before, after
        if name != "packing":
            assert docs.columns == columns
    before, after = kept["toxicity"]
    gone = set(before) - set(after)
    assert gone and sum(labels.get(i, 1) == 0 for i in gone) <= 0.02 * len(before)
    before, after = kept["line_dedup"]
    import hashlib

    want = {i: h for i, _, _, h in lines(list(before.items()))}
    assert {i: hashlib.sha256(t.encode()).hexdigest() for i, t in after.items()} == want
    before, after = kept["near_copies"]
    assert set(after) == {i for i, _, c in components(list(before.items())) if i == c}
    before, after = kept["decontamination"]
    items = [decontaminate.normal(r["text"]) for r in table(spark, DATA, "benchmark").collect()]
    leaked = {i for i, t in before.items() if any(decontaminate.myers(x, decontaminate.normal(t))[0] <= decontaminate.budget(len(x)) for x in items)}
    assert set(after) == set(before) - leaked and leaked
    rows = docs.collect()
    assert {r["doc_id"] for r in rows} == set(after) and all(r["offset"] + r["length"] <= 1024 for r in rows)


def test_registered():
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if n.startswith("op") or n == "pipeline"]
    assert sorted(n.split("_")[0] for n in names) == sorted([*(f"op{i}" for i in range(1, 11)), "pipeline"])
    assert set(entry.oracle_sql()) <= set(entry.queries())
