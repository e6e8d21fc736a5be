import subprocess
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import filters, state
from tessera.sources import files, gitlog
from tessera.streaming import jobs


def git(repo, *args):
    subprocess.run(["git", "-C", str(repo), "-c", "user.name=t", "-c", "user.email=t@t", *args], check=True, capture_output=True)


def test_scans(spark, tmp_path):
    for name, text in (("a.ts", "let a"), ("deep/b.cs", "class B"), ("node_modules/x.ts", "no"), ("c.mts", "let c"), ("read.md", "# T\nbody"), ("page.html", "<p>hi</p>"), ("note.py", "no")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    found = {r["file_path"].rsplit("/", 1)[-1]: r for r in files.scan_repo(spark, str(tmp_path)).collect()}
    assert set(found) == {"a.ts", "b.cs", "c.mts"} and found["b.cs"]["language"] == "csharp" and len(found["a.ts"]["content_hash"]) == 64
    docs = files.scan_docs(spark, str(tmp_path), html=True)
    assert {r["text"] for r in docs.collect()} == {"# T\nbody", "hi"}


def test_log_and_diff_of_a_repository(spark, tmp_path):
    git(tmp_path, "init", "-q")
    (tmp_path / "a.ts").write_text("let a = 1\n" * 9)
    (tmp_path / "b.ts").write_text("b")
    git(tmp_path, "add", "-A")
    git(tmp_path, "commit", "-qm", 'first "one"')
    git(tmp_path, "mv", "a.ts", "c.ts")
    (tmp_path / "b.ts").write_text("bb")
    git(tmp_path, "add", "-A")
    git(tmp_path, "commit", "-qm", "second")
    log = {r["message"]: r for r in gitlog.commit_log(spark, str(tmp_path)).collect()}
    assert set(log) == {"second", 'first "one"'} and log['first "one"']["files"] == [f"{tmp_path}/a.ts", f"{tmp_path}/b.ts"] and log["second"]["author"] == "t"
    assert gitlog.commit_log(spark, str(tmp_path), 1, "hdfs://h/x").select("files").first()["files"] == ["hdfs://h/x/b.ts", "hdfs://h/x/c.ts"]
    got = {(r["status"], r["path"], r["old_path"]) for r in gitlog.diff_changes(spark, str(tmp_path), "HEAD~1", "HEAD", "/r").collect()}
    assert got == {("renamed", "/r/c.ts", "/r/a.ts"), ("modified", "/r/b.ts", None)}
    with pytest.raises(subprocess.CalledProcessError):
        gitlog.commit_log(spark, str(tmp_path / "none"))


def test_a_log_is_read_by_many_tasks(spark, tmp_path):
    n = 20_000
    with open(tmp_path / "log.txt", "w") as f:
        for i in range(n):
            f.write(f"\x1e{i:040x}\x1fA {i % 7}\x1f2024-01-01T00:00:{i % 60:02d}+00:00\x1fmessage {i}\n\nsrc/{i % 50}.ts\nlib/./a/../{i % 9}.ts\n\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256k")
    try:
        log = gitlog.read_log(spark, str(tmp_path / "log.txt"), "/r")
        assert log.rdd.getNumPartitions() > 4
        assert "Window" not in log._jdf.queryExecution().executedPlan().toString()
        rows = log.agg(F.count("*"), F.countDistinct("hash"), F.sum(F.size("files"))).first()
        assert tuple(rows) == (n, n, 2 * n)
        row = log.filter("message = 'message 11'").first()
        assert row["files"] == ["/r/src/11.ts", "/r/lib/2.ts"] and row["author"] == "A 4" and row["date"].second == 11
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_paths_have_one_spelling(spark):
    rows = [("file:///a//b/./c.ts", "/a/b/c.ts"), ("file:/a/b.ts", "/a/b.ts"), ("hdfs://h:1/a/../b.ts", "hdfs://h:1/b.ts"), ("a/b/c/../../../x", "/r/x"), ("../up.ts", "/up.ts"), ("/abs/x", "/abs/x"), ("", "/r")]
    df = spark.createDataFrame([(a,) for a, _ in rows], "p string")
    assert [r["q"] for r in df.select(tx.normal_path(F.col("p"), "/r").alias("q")).collect()] == [b for _, b in rows]
    assert df.limit(1).select(tx.normal_path(F.lit("a/b/c/../../../x")).alias("q")).first()["q"] == "x"


def test_windows_close_with_the_watermark(spark, tmp_path):
    at = datetime(2024, 1, 1)
    rows = [(at + timedelta(minutes=m), k) for m, k in ((1, "x"), (2, "x"), (11, "y"), (65, "x"))]
    src = str(tmp_path / "src")
    spark.createDataFrame(rows, "ts timestamp_ntz, kind string").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("ts timestamp_ntz, kind string").parquet(src)
    out = str(tmp_path / "out")
    counts = jobs.windowed_counts(stream, "ts", "kind", "10 minutes", "5 minutes").select(F.col("window.start").alias("start"), "kind", "n")
    jobs.run_available(counts, lambda df, i: df.write.mode("append").parquet(out), str(tmp_path / "log"), mode="append")
    assert {(r["start"].minute, r["kind"], r["n"]) for r in spark.read.parquet(out).collect()} == {(0, "x", 2), (10, "y", 1)}


def test_predicates(spark):
    df = spark.createDataFrame([("function", "x"), ("module", ""), ("class", ""), ("method", None)], "symbol_type string, content string")
    assert filters.embeddable(df).count() == 1
    calls = spark.createDataFrame([(True, "System.IO"), (True, "Our.Core"), (False, None)], "meta boolean, ns string")
    assert calls.filter(filters.internal_call(F.col("meta"), F.col("ns"), ["Our."])).count() == 2


def test_job_claims_and_leases(spark):
    now = datetime(2024, 1, 1, 12)
    df = spark.createDataFrame(
        [("a", "pending", 0, now, None), ("b", "pending", 1, now - timedelta(hours=1), None), ("c", "processing", 1, now, now - timedelta(hours=2)), ("d", "processing", 1, now, now)],
        "chunk_id string, status string, attempts int, enqueued_at timestamp, claimed_at timestamp")
    assert [(r["chunk_id"], r["status"], r["attempts"]) for r in state.claim(df, 1).collect()] == [("b", "processing", 2)]
    got = {r["chunk_id"]: r["status"] for r in state.released(df, F.lit(now), 3600).collect()}
    assert got == {"a": "pending", "b": "pending", "c": "pending", "d": "processing"}
    table = spark.createDataFrame([("f", "indexed", ["1"], True), ("g", "indexed", ["2"], True)], "file_path string, status string, chunk_ids array<string>, dirty boolean")
    gone = {r["file_path"]: (r["status"], r["chunk_ids"], r["dirty"]) for r in state.soft_deleted(table, spark.createDataFrame([("f",)], "file_path string")).collect()}
    assert gone == {"f": ("deleted", [], False), "g": ("indexed", ["2"], True)}
