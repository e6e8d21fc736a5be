from datetime import datetime

from pathlib import Path

from pyspark.sql import functions as F

from tessera.operators import changes, cochange, graph, pack, resolve, state
from tessera.sources import gitlog
from tessera.streaming import jobs


def test_paths_and_neighbours(spark):
    edges = spark.createDataFrame([("a", "b", 0.9), ("b", "c", 0.5), ("a", "c", None), ("c", "a", 1.0)], "src string, dst string, confidence double")
    seeds = spark.createDataFrame([("c",)], "seed string")
    got = {(r["node"], r["hops"], r["confidence"]) for r in graph.neighbours(seeds, edges, 2).collect()}
    assert got == {("b", 1, 0.5), ("a", 1, 0.5), ("a", 2, 0.45)}
    assert graph.paths(seeds, edges, 9).agg(F.max("hops")).first()[0] <= 4
    assert len(graph.neighbours(seeds, edges, 2, limit=1).collect()) == 1


def test_edges_merge_and_delete(spark):
    w = spark.createDataFrame([("a", "CALLS", "b", 0.5, 1), ("a", "CALLS", "b", 0.9, 2), ("a", "CALLS", "z", 0.5, 1)], "src string, rel_type string, dst string, confidence double, n int")
    e = graph.merge_edges(w, ["n"])
    assert {(r["dst"], r["confidence"]) for r in e.collect()} == {("b", 0.9), ("z", 0.5)}
    nodes = spark.createDataFrame([("a",), ("b",)], "node string")
    assert [r["node"] for r in graph.placeholders(e, nodes, "node").collect()] == ["z"]
    left, kept = graph.without_nodes(nodes, e, spark.createDataFrame([("b",)], "node string"), "node")
    assert [r["node"] for r in left.collect()] == ["a"] and [r["dst"] for r in kept.collect()] == ["z"]


def test_co_change(spark):
    rows = [(c, f, datetime(2024, 1, c)) for c in (1, 2, 3) for f in ("a.ts", "b.ts")] + [(4, "a.ts", datetime(2024, 1, 4)), (4, "c.ts", datetime(2024, 1, 4))] + [(5, f"f{i}", datetime(2024, 1, 5)) for i in range(40)]
    df = spark.createDataFrame(rows + rows[:2], "commit int, file string, date timestamp")
    got = cochange.co_change_pairs(df, 3).collect()
    assert [(r["file_a"], r["file_b"], r["count"], r["last_seen"]) for r in got] == [("a.ts", "b.ts", 3, datetime(2024, 1, 3))]
    assert cochange.co_change_pairs(df, 1).count() == 2
    seeds = spark.createDataFrame([("b.ts",)], "seed string")
    assert [(r["other"], r["count"]) for r in graph.co_changed(cochange.co_change_pairs(df, 1), seeds).collect()] == [("a.ts", 3)]


def test_log_and_diff(spark):
    s = gitlog.SEPARATOR
    lines = [f"h1{s}Ann{s}2024-05-01T10:00:00+02:00{s}fix 'it'{s}more", "", "a.ts", "b.cs", f"bad{s}x", "c.ts", f"h2{s}Bo{s}2024-04-01T00:00:00Z{s}old", "d.ts"]
    df = spark.createDataFrame([("r", i, x) for i, x in enumerate(lines)], "log string, line_no long, line string")
    got = {r["hash"]: r for r in gitlog.parse_log(df).collect()}
    assert got["h1"]["files"] == ["a.ts", "b.cs", "c.ts"] and got["h2"]["files"] == ["d.ts"] and got["h1"]["date"] == datetime(2024, 5, 1, 8)
    diff = spark.createDataFrame([(x,) for x in ("M\ta.ts", "A\tb.cs", "D\tc.js", "R090\told.ts\tnew.ts", "R100\told.ts\tnew.md", "C100\tx.ts\ty.ts", "M\tread.md", "T\td.ts")], "line string")
    assert {(r["status"], r["path"], r["old_path"]) for r in gitlog.decode_changes(diff).collect()} == {
        ("modified", "a.ts", None), ("added", "b.cs", None), ("deleted", "c.js", None), ("renamed", "new.ts", "old.ts"), ("deleted", "old.ts", None), ("added", "y.ts", None), ("modified", "d.ts", None)}


def test_affected_names_and_referencers(spark):
    ch = spark.createDataFrame([("modified", "a", None), ("deleted", "b", None), ("renamed", "d", "c")], "status string, path string, old_path string")
    names = lambda rows: spark.createDataFrame(rows, "file_path string, name string")
    got = changes.affected_names(ch, names([("a", "x"), ("a", "y"), ("b", "gone"), ("c", "c1")]), names([("a", "y"), ("a", "z"), ("d", "d1")]))
    assert {r["name"] for r in got.collect()} == {"x", "z", "gone", "c1", "d1"}
    mentions = spark.createDataFrame([("m", "gone"), ("a", "x"), ("n", "other")], "file_path string, token string")
    assert [r["file_path"] for r in changes.referencers(mentions, got, spark.createDataFrame([("a",)], "file_path string")).collect()] == ["m"]
    assert {r["path"] for r in changes.changed_paths(ch).collect()} == {"a", "b", "c", "d"}


def test_upsert_and_patch(spark):
    old = spark.createDataFrame([(1, "a", "k"), (2, "b", "k")], "id int, v string, w string")
    new = spark.createDataFrame([(2, "B", "n")], "id int, v string, w string")
    assert {tuple(r) for r in changes.upsert(old, new, ["id"]).collect()} == {(1, "a", "k"), (2, "B", "n")}
    assert {tuple(r) for r in changes.patch(old, spark.createDataFrame([(1, "Z")], "id int, v string"), ["id"]).collect()} == {(1, "Z", "k"), (2, "b", "k")}


def test_jobs_batch_and_stream_agree(spark, tmp_path):
    log = ["enqueue", "claim", "fail", "claim", "fail", "claim", "fail", "claim", "enqueue", "claim", "done", "fail"]
    for n in range(1, len(log) + 1):
        status, attempts = None, 0
        for k in log[:n]:
            status, attempts = jobs.next_state(status, attempts, k)
        df = spark.createDataFrame([("c", i, k) for i, k in enumerate(log[:n])], "id string, n int, kind string")
        r = state.fold_jobs(df, "id", ["n"], "kind").first()
        assert (r["status"], r["attempts"]) == (status, attempts)
    assert (status, attempts) == ("done", 1)
    src = str(tmp_path / "src")
    events = spark.createDataFrame([(f"c{i % 7}", i, log[i % len(log)]) for i in range(60)], "id string, n int, kind string")
    events.write.parquet(src)
    stream = spark.readStream.schema(events.schema).parquet(src)
    jobs.run_available(jobs.job_stream(stream, "id", ["n"], "kind"), jobs.upserts(str(tmp_path / "out"), ["id"]), str(tmp_path / "log"))
    got = {tuple(r) for r in jobs.read_latest(spark, str(tmp_path / "out"), ["id"]).select("id", "status", "attempts").collect()}
    assert got == {tuple(r) for r in state.fold_jobs(events, "id", ["n"], "kind").collect()}


def test_state_tables(spark):
    files = spark.createDataFrame([("a", "failed", False, 1), ("b", "indexed", True, 2), ("c", "indexed", False, 3), ("d", "failed", True, 0)], "file_path string, status string, dirty boolean, indexed_at int")
    assert {(r["file_path"], r["reason"]) for r in state.repair_candidates(files, failed=1).collect()} == {("d", "failed"), ("b", "dirty")}
    x = spark.createDataFrame([("a",), ("a",), ("b",)], "k string")
    y = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    assert {tuple(r) for r in state.drift(x, y, "k").collect()} == {("a", 2, 1), ("c", 0, 1)}
    counts = {r["collection"]: r["n"] for r in state.collection_counts(spark.createDataFrame([("docs",)], "collection string")).collect()}
    assert counts["docs"] == 1 and counts["issues"] == 0 and len(counts) == 6
    one = state.sample_files(files, 1.0, 2).collect()
    assert one == state.sample_files(files, 1.0, 2).collect() and len(one) == 2


def test_owner_and_pack(spark):
    files = spark.createDataFrame([("r/a/b/x.cs",), ("r/a/y.cs",), ("s/z.cs",)], "path string")
    owners = spark.createDataFrame([("r/a",), ("r",), ("r/a/b",), ("r/ab",)], "folder string")
    assert {tuple(r) for r in pack.deepest_owner(files, owners, "path", "folder").collect()} == {("r/a/b/x.cs", "r/a/b"), ("r/a/y.cs", "r/a"), ("s/z.cs", None)}
    hit = spark.createDataFrame([("c", None, 0)], "chunk_id string, title string, line_start int")
    assert pack.packed(hit).first()["json"] == '{"chunk_id":"c","line_start":0}'


def test_same_file_resolution(spark):
    entities = spark.createDataFrame([("f", "go", "f::go", 2), ("f", "go", "f::A.go", 5)], "file_path string, name string, qualified_name string, ordinal int")
    rel = spark.createDataFrame(
        [("f", "go", None, 0.5, "heuristic"), ("f", "no", None, 0.5, "heuristic"), ("f", "go", "ext::go", 1.0, "semantic")], "file_path string, to_name string, to_qn string, confidence double, resolution_type string")
    got = {(r["to_name"], r["to_qn"], r["confidence"], r["resolution_type"]) for r in resolve.same_file(rel, entities).collect()}
    assert got == {("go", "f::go", 0.9, "same-file"), ("no", None, 0.5, "heuristic"), ("go", "ext::go", 1.0, "semantic")}


def test_passages_meet_texts_on_their_rarest_run(spark):
    docs = spark.createDataFrame([(1, "abc déf xyz"), (2, None), (3, ""), (4, "xyzabc" * 500), (5, "d")], "seed long, text string")
    passages = {10: "déf", 11: "f x", 12: "d", 13: "", 14: None, 15: "zab", 16: "xyzabcx", 17: "nowhere", 18: "é", 19: "bc"}
    issues = spark.createDataFrame(list(passages.items()), "issue_id long, passage string")
    found = graph.containing(docs, issues)
    got = {(r["seed"], r["issue_id"]) for r in found.collect()}
    texts = {r["seed"]: r["text"] for r in docs.collect()}
    assert got == {(s, i) for s, t in texts.items() if t is not None for i, p in passages.items() if p is not None and p in t}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert graph.containing(docs.limit(0), issues).count() == graph.containing(docs, issues.limit(0)).count() == 0


def test_a_full_seed_leaves_the_search(spark):
    """Around a hub the first level fills the limit: the later ones, which grow with its square, are not listed."""
    hub = [(f"n{i}", "hub", 0.5) for i in range(60)] + [(f"m{i}", f"n{j}", 0.5) for i in range(60) for j in range(60)] + [("a", "lone", 0.5), ("b", "a", 0.5), ("c", "b", 0.5)]
    edges = spark.createDataFrame(hub, "src string, dst string, confidence double")
    seeds = spark.createDataFrame([("hub",), ("lone",)], "seed string")
    got = sorted((r["seed"], r["node"], r["hops"]) for r in graph.neighbours(seeds, edges, 4).collect())
    brute = graph.first_of_each(graph.paths(seeds, edges, 2).filter("node != seed").distinct(), "seed", [F.col("hops"), F.col("confidence").desc(), F.col("node")], 25)
    assert [x for x in got if x[0] == "hub"] == sorted((r["seed"], r["node"], r["hops"]) for r in brute.collect() if r["seed"] == "hub") and len(got) == 28
    assert [x for x in got if x[0] == "lone"] == [("lone", "a", 1), ("lone", "b", 2), ("lone", "c", 3)]
    levels = sorted(Path(spark.conf.get("spark.checkpoint.dir")).glob("level-*"), key=lambda p: p.stat().st_mtime_ns)[-2:]
    assert [spark.read.parquet(str(p)).filter("seed = 'hub'").count() for p in levels] == [0, 0]


def test_paths_are_counted_without_a_row_each(spark):
    """As many, and as good, as the listed paths, with loops and ways back; and far more of them than could be listed."""
    ends = [(a, b) for a in range(5) for b in range(5) if (a + 2 * b) % 4] + [(2, 2), (3, 0), (0, 3)]
    edges = spark.createDataFrame([(a, b, None if a == b else round(0.5 + 0.07 * a + 0.03 * b, 2)) for a, b in sorted(set(ends))], "src long, dst long, confidence double")
    seeds = spark.createDataFrame([(0,), (2,), (2,), (9,)], "seed long")
    for towards in (True, False):
        for hops in (1, 2, 3, 4):
            listed = graph.paths(seeds, edges, hops, towards).groupBy("seed", "node", "hops").agg(F.count("*").alias("paths"), F.max("confidence").alias("best"))
            assert sorted(map(tuple, graph.path_counts(seeds, edges, hops, towards).collect())) == sorted(map(tuple, listed.collect())), (towards, hops)
    n = 300
    full = spark.range(n * n).select(F.floor(F.col("id") / n).alias("src"), (F.col("id") % n).alias("dst"), F.lit(0.5).alias("confidence")).filter("src != dst")
    got = graph.path_counts(spark.createDataFrame([(0,)], "seed long"), full, 3).filter("hops = 3").agg(F.sum("paths")).first()[0]
    assert got == (n - 1) ** 3 - (n - 1)  # all walks but those that take an edge, its reverse and the edge again


def test_passages_are_found_in_one_walk_without_moving_texts(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "abc déf 😀xyz"), (2, None), (3, ""), (4, "xyzabc" * 50), (4, "d"), (None, "bc")], "seed long, text string")
    passages = [(1 << 60 | 1, "bc"), (11, "bc"), (12, ""), (13, None), (14, "😀x"), (15, "bcx"), (16, "c"), (17, "é")]
    issues = spark.createDataFrame(passages, "issue_id long, passage string")
    want = {(r["seed"], i) for r in docs.collect() for i, p in passages if r["text"] is not None and p is not None and p in r["text"]}
    for most in (1_000_000, 2):
        monkeypatch.setattr(graph._blocks, "__defaults__", (most,))
        found = graph.containing(docs, issues)
        got = [(r["seed"], r["issue_id"]) for r in found.collect()]
        assert len(got) == len(set(got)) and set(got) == want
    plan = graph.related_issues(found)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_parts_of_the_history_follow_its_table(spark, monkeypatch):
    """Tasks get more with more lines, not larger; commits are shuffled once and pairs once."""
    from tessera.plans import catalogue, tables

    data = "/root/testdata/sf0.001"
    lines = spark.read.parquet(f"{data}/lineitem.parquet").count()
    assert tables.history_parts(spark, data) == int(spark.conf.get("spark.sql.shuffle.partitions")) and tables.history_parts(spark, data, 500) == -(-lines // 500)
    plain = sorted(map(tuple, catalogue.queries()["q18_co_change_last_seen"](spark, data).collect()))
    monkeypatch.setattr(tables.history_parts, "__defaults__", (500,))
    many = catalogue.queries()["q18_co_change_last_seen"](spark, data)
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == plan.count("REPARTITION_BY_NUM") == 3
    assert sorted(map(tuple, many.collect())) == plain
