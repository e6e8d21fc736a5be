"""The registered queries on the smallest tables: columns, folds, thresholds and digests as their contracts say."""

import hashlib
import os
import zlib

import pytest

from tessera.llm import queries
from tests.llm.test_leaks_repeats import brute as repeats

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


def rows(spark, name):
    return queries.queries()[name](spark, DATA).collect()


def test_op1(spark, texts):
    got = rows(spark, "op1_mpeg_audio")
    assert {r["doc_id"] for r in got} == set(texts)
    for r in got:
        raw = texts[r["doc_id"]].encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r["media_bytes"] > len(payload) and len(r["media_sha256"]) == 64 and r["seek_offsets"] == sorted(r["seek_offsets"]) and r["duration_num"] > 0 and r["duration_den"] > 0
    same = {}
    for r in got:
        assert same.setdefault(texts[r["doc_id"]], r["feature"]) == r["feature"]


def test_op2(spark, texts):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    slow, ids = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), {}
    got = rows(spark, "op2_packing")
    packs = {}
    for r in got:
        i = r["doc_id"]
        ids.setdefault(i, slow.encode(texts[i], add_special_tokens=False).ids + [0])
        piece = ids[i][r["start"] : r["start"] + r["length"]]
        assert len(piece) == r["length"] and zlib.crc32(np.array(piece, "<u4").tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[i])
        packs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(ids) == set(texts) and sum(r["length"] for r in got) == sum(map(len, ids.values()))
    for pieces in packs.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    assert sum(map(len, ids.values())) / (1024 * len(packs)) > 0.97


@pytest.mark.parametrize(("name", "threshold"), [("op5_quality_rules", 0.3), ("op10_toxicity", 0.5)])
def test_scores(spark, texts, name, threshold):
    got = rows(spark, name)
    assert {r["doc_id"] for r in got} == set(texts) and set(got[0].asDict()) == {"doc_id", "held_out", "score", "predicted"}
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= threshold)


def test_op9(spark, texts):
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows(spark, "op9_suffix_dedup")}
    assert got == dict(zip(texts, repeats(list(texts.values())), strict=True)) and "kept" not in queries.queries()["op9_suffix_dedup"](spark, DATA).columns


def test_without_the_modules_they_need(monkeypatch):
    import builtins
    import sys

    import __spark_entry__ as entry

    def missing(name, *a, _real=builtins.__import__, **k):
        if name == "tiktoken":
            raise ImportError(name)
        return _real(name, *a, **k)

    every = set(entry.queries())
    for name in [n for n in sys.modules if n.startswith("tessera.llm") or n == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setattr(sys.modules["tessera"], "llm", None)
    monkeypatch.delattr(sys.modules["tessera"], "llm")
    monkeypatch.setattr(builtins, "__import__", missing)
    left = set(entry.queries())
    assert left == {n for n in every if not n.startswith("op") and n != "pipeline"} and len(left) > 50
