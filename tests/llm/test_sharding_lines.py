import hashlib
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import linededup, sharding


def jump(key: int, n: int) -> int:
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * sharding.MULTIPLIER + 1) & ((1 << 64) - 1)
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_walk_is_the_published_hash(spark):
    keys = [*range(400), -1, -5, 2**63 - 1, -(2**63), 123456789012345]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 2, 8, 100):
        got = {r["k"]: (r["shard"], r["grown_shard"]) for r in sharding.assign_shards(df, "k", n).collect()}
        assert got == {k: (jump(k, n), jump(k, n + 1)) for k in keys}
        assert all(a == b or b == n for a, b in got.values())


def test_slots_are_gapless_and_edge_cases(spark, docs_of):
    df = docs_of([None, "", "a", "a", "b"], [None, 3, 3, 7, None])
    rows = sharding.assign_shards(df, "doc_id", 2, ["text"], buckets=3).collect()
    assert len(rows) == 5 and rows[0].asDict().keys() >= {"slot", "extra", "shard"}
    for shard, n in Counter(r["shard"] for r in rows).items():
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(n))
    assert len({r["shard"] for r in rows if r["doc_id"] is None}) == 1
    assert sharding.assign_shards(df.limit(0), "doc_id", 2).count() == 0
    assert sharding.assign_shards(spark.createDataFrame([("a",), ("b",)], "k string"), "k", 3).count() == 2


def brute(docs, least=10):
    space, lower = " \t\n\x0b\x0c\r", str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    key = lambda x: x.strip(space).translate(lower)
    rank = lambda i: (i is None, i or 0)
    first = {}
    for i, t in docs:
        for x in (t or "").split("\n"):
            k = key(x)
            first[k] = min(first.get(k, i), i, key=rank)
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < least or first[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def run(df, least=10):
    out = linededup.dedup_lines(df, min_chars=least)
    return sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in out.collect()), key=str)


def test_lines_against_brute_force(docs_of):
    line = "A common line of some length"
    texts = [line, f"x\n {line.upper()} \ny\n{line}", None, "", "\n\n", f"{line}\r\n{line}", "é" * 9, "É" * 10 + "\nz", "É" * 10, "é" * 10, "dup dup dup\n" * 3, "dup dup dup", line + "\n" * 4 + line, "q" * 200_000 + "\nend of this text"]
    df = docs_of(texts * 2, [*range(len(texts)), *range(len(texts))])
    assert run(df) == brute([(r["doc_id"], r["text"]) for r in df.collect()])
    same_id = docs_of([line, "other words here\n" + line, line, line], [5, 5, None, None])
    assert run(same_id) == brute([(r["doc_id"], r["text"]) for r in same_id.collect()])
    assert linededup.dedup_lines(df.limit(0)).count() == 0
    assert set(linededup.dedup_lines(df).columns) >= {"slot", "extra", "n_lines"}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text("aB \n\té", max_size=30), min_size=1, max_size=8))
def test_lines_property(docs_of, texts):
    assert run(docs_of(texts), 2) == brute(list(enumerate(texts)), 2)


def test_clashing_columns_stay(docs_of):
    df = docs_of(["a common line here\nb", "a common line here"]).withColumns({c: F.lit(c) for c in ("__id", "__digest", "__own", "__key", "__walk", "__start", "__rank", "__bucket", "__n", "lost", "pos", "key", "line")})
    out = linededup.dedup_lines(df)
    assert set(df.columns) <= set(out.columns) and {(r["__id"], r["__own"], r["n_dropped"]) for r in out.collect()} == {("__id", "__own", 0), ("__id", "__own", 1)}
    shards = sharding.assign_shards(df, "doc_id", 3)
    assert set(df.columns) <= set(shards.columns) and {(r["__start"], r["__bucket"]) for r in shards.collect()} == {("__start", "__bucket")}


def test_bitmap_runs(spark, docs_of):
    df = docs_of(["a line to drop\nb line to drop\nkeep", "a line to drop\nb line to drop\nnew text here\na line to drop"])
    r = linededup.keep_bitmaps(df).filter(F.col("__id") == 1).first()
    assert r["n_dropped"] == 3 and [tuple(x) for x in r["drop_runs"]] == [(0, 1), (3, 3)]
