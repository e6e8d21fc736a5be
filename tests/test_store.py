import re

import pytest

from tessera.operators import state
from tessera.sources import store


def test_points(spark, tmp_path):
    path = str(tmp_path / "points")
    make = lambda rows: spark.createDataFrame(rows, "collection string, chunk_id string, file_path string, content string")
    with pytest.raises(ValueError, match="nowhere"):
        store.upsert_points(make([("docs", "1", "a", "x"), ("nowhere", "9", "c", "z")]), path)
    assert store.read_points(spark, path) is None
    store.upsert_points(make([("docs", "1", "a", "x"), ("docs", "2", "b", "y"), ("code_ts", "1", "c", "z")]), path)
    store.upsert_points(make([("docs", "2", "b", "Y"), ("docs", "3", "a", "w")]), path)
    rows = lambda: {(r["collection"], r["chunk_id"], r["content"]) for r in store.read_points(spark, path).collect()}
    assert rows() == {("docs", "1", "x"), ("docs", "2", "Y"), ("docs", "3", "w"), ("code_ts", "1", "z")}
    store.patch_points(spark.createDataFrame([("docs", "1", "patched")], "collection string, chunk_id string, content string"), path)
    assert ("docs", "1", "patched") in rows() and len(rows()) == 4
    assert store.point(spark, path, "docs", "3").first()["content"] == "w" and store.point(spark, path, "docs", "7").first() is None
    store.delete_points(spark.createDataFrame([("c",), ("b",)], "file_path string"), path)
    assert {r[:2] for r in rows()} == {("docs", "1"), ("docs", "3")}


def test_equal_keys_of_a_batch_are_one_point(spark, tmp_path):
    path = str(tmp_path / "points")
    rows = [("docs", "1", "a", "x"), ("docs", "1", "a", "y"), ("docs", "1", "a", "y"), ("docs", "2", "a", "z")]
    seen = []
    for order in (rows, rows[::-1]):
        store.upsert_points(spark.createDataFrame(order, "collection string, chunk_id string, file_path string, content string"), path)
        got = {r["chunk_id"]: r["content"] for r in store.read_points(spark, path).collect()}
        assert store.read_points(spark, path).count() == 2 and got["2"] == "z"
        seen.append(got)
    assert seen[0] == seen[1]  # the same one whatever the order


def rows_of(tables, name):
    return sorted((r["file_path"], r["n"]) for r in tables[name].collect())


def stamps(tmp_path, name):
    return {p.relative_to(tmp_path): p.stat().st_mtime_ns for p in (tmp_path / name).rglob("*.parquet")}


def test_a_change_touches_its_folders_only(spark, tmp_path):
    tables = store.Tables(spark, str(tmp_path), rows=10)
    make = lambda rows: spark.createDataFrame(rows, "file_path string, n int")
    tables.put("t", make([(f"f{i}", i) for i in range(200)]))
    assert tables.about("t")["folders"] == 32
    before = stamps(tmp_path, "t")
    tables.change("t", make([("f7", 70), ("f7", 71)]), make([("f7", 0)]), ["file_path"])
    after = stamps(tmp_path, "t")
    fresh = [p for p in after if p not in before]
    assert len({p.parent for p in fresh}) == 1 and len([p for p in before if p not in after]) == 1
    assert rows_of(tables, "t") == sorted([(f"f{i}", i) for i in range(200) if i != 7] + [("f7", 70), ("f7", 71)])
    bytes_one = sum((tmp_path / p).stat().st_size for p in fresh)
    # ten times the rows: the table is laid out anew, and one file's change writes no more than before
    tables.put("t", make([(f"f{i}", i) for i in range(2000)]))
    before = stamps(tmp_path, "t")
    tables.change("t", make([("f7", 70), ("f7", 71)]), make([("f7", 0)]), ["file_path"])
    assert sum((tmp_path / p).stat().st_size for p in stamps(tmp_path, "t") if p not in before) < 2 * bytes_one


def test_the_last_row_goes_and_comes_back(spark, tmp_path):
    tables = store.Tables(spark, str(tmp_path))
    make = lambda rows, kind="file_path string, n int": spark.createDataFrame(rows, kind)
    assert tables.change("t", None, make([("a", 1)]), ["file_path"]) is None and "t" not in tables
    tables.change("t", make([("a", 1)]), make([("a", 1)]), ["file_path"])
    assert tables.change("t", None, make([("a", 0), ("b", 0)]), ["file_path"]).count() == 0 and tables["t"].columns == ["file_path", "n"]
    assert tables.change("t", make([("c", 2, "x")], "file_path string, n int, more string"), make([("c", 0)]), ["file_path"]).collect() == [("c", 2, "x")]
    assert tables.change("t", make([("d", 3)]), make([("d", 0)]), ["file_path"]).count() == 2
    assert tables.change("t", make([]), make([]), ["file_path"]).count() == 2
    tables.put("e", make([]))
    assert tables["e"].count() == 0 and tables.get("e", ["a"]).count() == 0


def test_a_grown_table_is_laid_out_anew(spark, tmp_path):
    tables = store.Tables(spark, str(tmp_path), rows=20, least_bytes=1)
    make = lambda at: spark.createDataFrame([(f"f{i}", i) for i in at], "file_path string, n int")
    tables.put("t", make(range(5)))
    assert tables.about("t")["folders"] == 1
    for k in range(8):
        tables.change("t", make(range(50 * k, 50 * k + 50)), make(range(50 * k, 50 * k + 50)), ["file_path"])
    assert tables.about("t")["folders"] >= 8 and rows_of(tables, "t") == sorted((f"f{i}", i) for i in range(400))
    assert tables.get("t", ["f3"]).filter("file_path = 'f3'").count() == 1
    plan = tables.get("t", ["f3"])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ = \d+", plan)


def test_a_lost_writer_leaves_the_old_layout(spark, tmp_path):
    tables = store.Tables(spark, str(tmp_path))
    make = lambda n: spark.createDataFrame([(f"f{i}", i) for i in range(n)], "file_path string, n int")
    tables.put("t", make(3))
    half = tmp_path / "t" / "rows-00000002" / "bucket=0"
    half.mkdir(parents=True)
    (half / "part-0.parquet").write_bytes(b"half of it")
    (tmp_path / "t" / "about-00000002.half").write_bytes(b"{")
    assert tables["t"].count() == 3 and "t" in tables and "u" not in tables
    for n in (5, 6, 7):
        tables.put("t", make(n))
    assert tables["t"].count() == 7 and len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("rows-")]) == 2
    with pytest.raises(KeyError):
        tables["u"]


def test_index_tables_are_appended_to(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "APPENDS", 3)
    tables = store.Tables(spark, str(tmp_path))
    make = lambda k: spark.createDataFrame([(f"t{i}", k) for i in range(3)], "term string, stamp int")
    assert [tables.append("p", make(k), "term") for k in range(4)] == [False, False, False, True]
    assert tables["p"].count() == 12
    tables.put("p", tables["p"].filter("stamp = 3"), "term")
    assert tables["p"].count() == 3 and not tables.append("p", make(4), "term")


def test_intents_and_file_index(spark):
    log = spark.createDataFrame([("o1", 1, "intent"), ("o1", 2, "done"), ("o2", 1, "intent"), ("o3", 1, "intent"), ("o3", 3, "failed")], "operation_id string, at int, state string")
    assert [r["operation_id"] for r in state.open_intents(log).collect()] == ["o2"]
    got = state.stamped(spark.createDataFrame([("a", "h9")], "file_path string, content_hash string")).first()
    assert (got["file_path"], got["content_hash"], got["dirty"]) == ("a", "h9", False) and got["indexed_at"] is not None
