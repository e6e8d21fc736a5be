import itertools
import math

from pyspark.sql import functions as F

from tessera.functions.vectors import cosine
from tessera.operators import evaluation, filters, fusion, retrieval


def test_filters(spark):
    df = spark.createDataFrame([("demo", "ts"), ("demo", "cs"), ("x", "ts")], "repo string, language string")
    n = lambda w: filters.matching(df, w).count()
    assert n(None) == 3 and n({}) == 3 and n({"repo": "demo"}) == 2 and n({"language": ["ts", "cs"]}) == 3 and n({"repo": "demo", "language": None}) == 2 and n({"language": []}) == 0


def test_bm25_formula(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, None), (4, "c")], "id int, text string")
    got = {r["id"]: r["score"] for r in retrieval.bm25(df, ["a", "b"], "id", "text").collect()}
    avg = 6 / 4
    idf = lambda d: math.log(1 + (4 - d + 0.5) / (d + 0.5))
    part = lambda tf, dl: tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg))
    assert math.isclose(got[1], round(idf(1) * part(2, 3) + idf(2) * part(1, 3), 6)) and math.isclose(got[2], round(idf(2) * part(1, 2), 6)) and set(got) == {1, 2}


def lists(spark, rows):
    return spark.createDataFrame(rows, "chunk_id string, list_no int, rank int, content string")


def test_rrf_scores_and_payload(spark):
    rows = [("a", 0, 1, "first"), ("b", 0, 2, "b"), ("b", 1, 1, "other"), (None, 1, 2, "lost"), ("c", 1, 3, "c"), ("c", 1, 4, "c")]
    got = {r["chunk_id"]: r for r in fusion.rrf_merge(lists(spark, rows), "chunk_id").collect()}
    assert math.isclose(got["b"]["score"], 1 / 62 + 1 / 61, abs_tol=1e-9) and got["b"]["content"] == "b" and got["b"]["score"] > got["a"]["score"]
    assert math.isclose(got["c"]["score"], 1 / 63 + 1 / 64, abs_tol=1e-9) and len(got) == 3


def test_rrf_scores_do_not_hang_on_list_order(spark):
    rows = [("a", 0, 1, ""), ("b", 0, 2, ""), ("b", 1, 1, ""), ("c", 2, 1, "")]
    seen = set()
    for p in itertools.permutations(range(3)):
        merged = fusion.rrf_merge(lists(spark, [(k, p[n], r, c) for k, n, r, c in rows]), "chunk_id")
        seen.add(tuple(sorted((r["chunk_id"], r["score"]) for r in merged.collect())))
    assert len(seen) == 1


def test_descriptions_stand_for_code(spark):
    hits = spark.createDataFrame(
        [("code_ts", "c1", None, 2.0), ("code_ts", "c2", None, 1.0), ("code_ts_desc", "d0", None, 9.0), ("code_ts_desc", "d1", "c2", 3.0), ("docs", "p", None, 1.0)],
        "collection string, chunk_id string, linked_chunk_id string, score double")
    got = {r["chunk_id"]: r for r in fusion.merge_collections(hits, ["code_ts", "code_ts_desc", "docs"]).collect()}
    assert set(got) == {"c1", "c2", "p"} and math.isclose(got["c2"]["score"], 1 / 62 + 1 / 61, abs_tol=1e-9)
    assert got["p"]["matched_via"] == "docs" and got["c2"]["matched_via"] == "code"


def test_cosine_and_knn(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 0.0])], "id int, v array<float>")
    got = {r["id"]: r["score"] for r in retrieval.knn(df, df.filter("id = 0"), "id", "v").collect()}
    assert got[0] == 1.0 and got[1] == 0.707107 and got[2] is None
    assert df.select(cosine(F.col("v"), F.col("v")).alias("s")).first()["s"] == 1.0


def test_rerank(spark):
    hits = spark.createDataFrame([("a", "get user", 1.0), ("b", None, 2.0), ("c", "user user login", 0.5)], "chunk_id string, content string, score double")
    assert [r["chunk_id"] for r in retrieval.rerank_overlap(hits, "user login", "content", "chunk_id", 2).collect()] == ["c", "a"]
    def broken(query, texts):
        raise RuntimeError

    order = lambda score: [r["chunk_id"] for r in retrieval.rerank_with(hits, score, "user", "content", "chunk_id", 2).collect()]
    assert order(broken) == order(lambda query, texts: [None] * len(texts)) == ["b", "a"] and order(lambda query, texts: [t.count(query) for t in texts]) == ["c", "a"]


def test_evaluation(spark):
    ranked = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3), ("z", "x", 1)], "query string, item string, rank int")
    good = spark.createDataFrame([("q", "b"), ("q", "c")], "query string, item string")
    assert {r["query"]: r["precision"] for r in evaluation.precision_at(ranked, good, 2).collect()} == {"q": 0.5, "z": 0.0}
    assert {r["query"]: r["rr"] for r in evaluation.reciprocal_rank(ranked, good).collect()} == {"q": 0.5, "z": 0.0}


def test_postings_move_once(spark, tmp_path):
    """Terms are counted within a text's row, so only the layout by term is a shuffle; rows of one key are still one text's."""
    from collections import Counter

    texts = {1: "b a b ÜBER a_1 b", 2: "", 3: None, 4: "x" * 10 + " 7 7"}
    df = spark.createDataFrame(list(texts.items()), "id long, text string")
    counted = retrieval.counted_terms(df, "id", "text")
    assert "Exchange" not in counted._jdf.queryExecution().executedPlan().toString()
    want = {(i, w, n, len(t.split())) for i, t in texts.items() if t for w, n in Counter(t.lower().split()).items()}
    assert {(r["id"], r["term"], r["tf"], r["dl"]) for r in counted.collect()} == want
    for rows, n, total in ((df, 4, 9), (df.unionAll(df), 8, 18), (df.limit(0), 0, 0)):
        path = str(tmp_path / str(n))
        retrieval.write_postings(rows, path, "id", "text")
        terms, corpus = retrieval.read_postings(spark, path)
        assert tuple(corpus.first()[c] for c in ("n", "total_dl")) == (n, total)
        assert {(r["id"], r["term"], r["tf"], r["dl"]) for r in terms.collect()} == {(i, w, k * n // 4, d) for i, w, k, d in want if n}


def test_postings_lie_in_lists(spark, tmp_path):
    """A common term moves and lies as a list for each batch of texts, not as a row for each text; what is read is the same."""
    from tessera.sources.store import Tables

    texts = [(i, " ".join(["thing"] * (i % 3 + 1) + ["the", f"w{i % 7}", "Über"])) for i in range(300)] + [(None, "the the"), (900, None), (901, "")]
    df = spark.createDataFrame(texts, "id long, text string").coalesce(2)
    path = str(tmp_path / "lists")
    retrieval.write_postings(df, path, "id", "text")
    rows, corpus = retrieval.read_postings(spark, path)
    kept = sorted(retrieval.counted_terms(df, "id", "text").collect(), key=str)
    assert sorted((r for r in rows.select("term", "id", "dl", "tf").collect()), key=str) == kept and len(kept) == 1201
    assert tuple(corpus.first()[c] for c in ("n", "total_dl")) == (303, sum(r["tf"] for r in kept))
    assert Tables(spark, path)["terms"].count() <= 2 * 10
    some, _ = retrieval.read_postings(spark, path, ["thing"])
    assert "isin" not in (p := some.filter(F.col("term").isin("thing", "x"))._jdf.queryExecution().optimizedPlan().toString()) and p.index("Generate") < p.index("Filter")


def test_some_terms_do_not_pay_for_all(spark, tmp_path):
    """A query of few terms finds them in one pass: no other term is written or moves, and what is read is what the postings of all terms give."""
    from tessera.plans import tables
    from tessera.workspace import children

    texts = [(i, " ".join(["thing"] * (i % 3) + ["THE", f"w{i % 7}", "Über"]), "x") for i in range(300)] + [(None, "the the", ""), (900, None, ""), (901, "", ""), (7, "thing w0", ""), (7, "w1 the", "")]
    spark.createDataFrame(texts, "doc_id long, text string, lang string").coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    terms = ["thing", "the", "über", "nowhere"]
    kept = lambda rows: sorted((r for r in rows.filter(F.col("term").isin(*terms)).select("term", "doc_id", "dl", "tf").collect()), key=str)
    stats = lambda corpus: tuple(corpus.first()[c] for c in ("n", "total_dl"))
    before = tables._MADE.copy()
    rows, corpus = tables.document_postings(spark, str(tmp_path), terms)
    (path,) = (p for k, p in tables._MADE.items() if k not in before)
    assert "terms" not in children(spark, path) and {t for r in spark.read.parquet(path).collect() for t in r["terms"]} == set(terms[:3])
    some, counted = kept(rows), stats(corpus)
    every, whole = tables.document_postings(spark, str(tmp_path))
    assert some == kept(every) and len(some) == 201 + 302 + 300 and counted == stats(whole) == (305, sum(r["tf"] for r in every.collect()))
    again, _ = tables.document_postings(spark, str(tmp_path), terms)
    assert kept(again) == some and len(tables._MADE) == len(before) + 2


def test_lists_hold_narrow_numbers(spark, tmp_path):
    """Frequencies move and lie as int, are read as bigint, and the tokens in all are what they add up to."""
    from tessera.sources.store import Tables

    df = spark.createDataFrame([(1, "a b a"), (2, None), (3, "a " * 70_000)], "id long, text string")
    path = str(tmp_path / "narrow")
    retrieval.write_postings(df, path, "id", "text")
    rows, corpus = retrieval.read_postings(spark, path)
    assert Tables(spark, path)["terms"].schema["tf"].dataType.simpleString() == "array<int>" and dict(rows.dtypes)["tf"] == "bigint" == dict(corpus.dtypes)["total_dl"]
    assert {(r["term"], r["id"], r["dl"], r["tf"]) for r in rows.collect()} == {("a", 1, 3, 2), ("b", 1, 3, 1), ("a", 3, 70_000, 70_000)} and corpus.first()["total_dl"] == 70_003
