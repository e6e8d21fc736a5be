import json
import re
import subprocess
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessera.api import Engine
from tessera.operators import changes, evaluation
from tessera.sources import code, gitlog, store
from tessera.sources.files import scan_repo
from tessera.streaming import jobs

SOURCES = [
    ("lib/tide/Gauge.ts", "export class Gauge {\n  /** Reads it. */\n  readLevel(p: string): boolean { return p.length > 3; }\n}\nexport class DeepGauge extends Gauge {\n  readLevel(p: string) { return steady(p); }\n}\nfunction steady(p: string) { return p.length > 9; }\n"),
    ("lib/port/Harbour.ts", "import { mooringFee } from '../fees/mooring';\nexport class Harbour {\n  admitShip(a: number) { return mooringFee(a); }\n}\n"),
    ("lib/fees/mooring.ts", "export const mooringFee = (a: number): boolean => a < 100;\nconst most = 5;\n"),
    ("lib/port/main.ts", "import { mooringFee } from '../fees/mooring';\nif (mooringFee(3)) { start(); }\n"),
    ("lib/bad.py", "x = 1"),
]


def files(spark, rows=SOURCES):
    return spark.createDataFrame(rows, "file_path string, content string")


def test_scanner(spark):
    parsed = code.parse_sources(files(spark)).cache()
    names = {r["qualified_name"]: r for r in code.entities_of(parsed).collect()}
    assert names["lib/tide/Gauge.ts"]["symbol_type"] == "module" and names["lib/tide/Gauge.ts::Gauge.readLevel"]["line_start"] == 3
    assert names["lib/tide/Gauge.ts::Gauge.readLevel"]["docstring"] == "/** Reads it. */" and names["lib/fees/mooring.ts::mooringFee"]["symbol_type"] == "function"
    assert "lib/fees/mooring.ts::most" not in names
    rel = {(r["from_qn"], r["rel_type"], r["to_name"], r["confidence"]) for r in code.relations_of(parsed).collect()}
    assert ("lib/tide/Gauge.ts::DeepGauge", "EXTENDS", "Gauge", 0.7) in rel and ("lib/port/Harbour.ts", "IMPORTS", "../fees/mooring", 0.8) in rel
    assert ("lib/port/Harbour.ts::Harbour.admitShip", "CALLS", "mooringFee", 0.9) in rel
    assert [r["file_path"] for r in parsed.filter("error is not null").collect()] == ["lib/bad.py"]


def test_scanner_below_the_top_level():
    source = r"""
namespace Tides {
  export function helper(a: number) { return compute(a); }
  export class Log { total(x: number) { return /[{]/.test(x) ? sum(x) : `a ${ x > 1 ? `{ ${ x }` : "}" } {`; } post() { send(); } }
}
if (DEBUG) {
  function inBlock() { ping(); }
  const arrow = async (q: string) => { pong(q); };
}
for (const x of xs) { function looped() {} }
let plain: number
function afterRegex() { const r = /["'`]{/g; function nested() {} return r; }
const ratio = a / b / c, other = 3;
describe("x", () => { function within() { deep(); } });
export const last = (z) => z / 2;
"""
    found = code.parse_file("a.ts", source)
    names = [e["qualified_name"].removeprefix("a.ts::") for e in found["entities"]]
    assert names == ["a.ts", "helper", "Log", "Log.total", "Log.post", "inBlock", "arrow", "looped", "afterRegex", "within", "last"]
    calls = {(r["from_qn"].removeprefix("a.ts::"), r["to_name"]) for r in found["relations"]}
    assert {("helper", "compute"), ("Log.total", "sum"), ("Log.post", "send"), ("inBlock", "ping"), ("arrow", "pong"), ("within", "deep")} <= calls
    assert [e["line_start"] for e in found["entities"]][-3:] == [12, 14, 15]
    for broken in ("class A { f() { `", "const x = /", "function", "}}}((", "const a = b\n`${`"):
        assert code.parse_file("b.js", broken)["error"] is None


def test_scanner_generics_and_optional_members():
    source = """
export const wrap = async <T>(x: T): Promise<T> => { return hold(x); };
const keyed = <K extends string, V = Map<K, Array<number>>>(k: K, v: V) => store(k, v);
class Tide<T extends Base<T>> extends Sea<T> {
  level?(): void;
  reset!: () => void;
  /** Reads. */
  read<U>(u: U): U { return probe(u); }
  async each?<U extends { a: number }>(f: (u: U) => void) { visit(f); }
}
const smaller = a < b, other = (c > d);
"""
    found = code.parse_file("a.ts", source)
    names = {e["qualified_name"].removeprefix("a.ts::"): e for e in found["entities"]}
    assert {"wrap", "keyed", "Tide", "Tide.level", "Tide.read", "Tide.each"} <= set(names) and "smaller" not in names and "other" not in names
    assert names["Tide.read"]["docstring"] == "/** Reads. */" and names["Tide.read"]["line_start"] == 8
    calls = {(r["from_qn"].removeprefix("a.ts::"), r["to_name"]) for r in found["relations"]}
    assert {("wrap", "hold"), ("keyed", "store"), ("Tide.read", "probe"), ("Tide.each", "visit"), ("Tide", "Sea")} <= calls


def test_scanner_takes_time_in_proportion():
    part = "/** Doc. */\nexport function f%d(a: number) {\n  // more\n  return g%d(a) + h(a);\n}\nclass C%d { m() { k(); } }\n"
    seconds = []
    for n in (2000, 8000):
        text = "".join(part % (i, i, i) for i in range(n))
        began = time.process_time()
        assert len(code.parse_file("a.ts", text)["entities"]) == 3 * n + 1
        seconds.append(time.process_time() - began)
    assert seconds[1] < 8 * seconds[0]  # four times the text


def test_csharp(spark):
    result = {
        "entities": [
            {"qualified_name": "N::A", "name": "A", "type": "class", "file_path": "a.cs", "line_start": 1, "line_end": 9, "content": "class A"},
            {"qualified_name": "N::A.Go", "name": "Go", "type": "method", "class_name": "A", "file_path": "a.cs", "line_start": 2, "line_end": 3, "content": "Go"},
            {"qualified_name": "N::E", "name": "E", "type": "enum", "file_path": "a.cs"}],
        "relations": [{"from": "N::A.Go", "to": "N::A", "type": "CALLS", "confidence": 1.0}, {"from": "N::X", "to": "N.B", "type": "CALLS"}]}
    exported = spark.createDataFrame([(json.dumps(result),)], "json string")
    e, r = code.csharp_results(exported)
    assert {(x["qualified_name"], x["symbol_type"], x["parent_class"]) for x in e.collect()} == {("a.cs", "module", None), ("N::A", "class", None), ("N::A.Go", "method", "A")}
    assert [(x["file_path"], x["to_qn"], x["resolution_type"]) for x in r.collect()] == [("a.cs", "N::A", "semantic")]
    engine = Engine(spark)
    told = engine.index_csharp(exported, files(spark, [("a.cs", "class A"), ("b.cs", "class B")]))
    assert {(r["outcome"], r["file_path"]) for r in told.collect()} == {("indexed", "a.cs"), ("failed", "b.cs")}
    assert [(r["node"], r["confidence"]) for r in engine.callers("N::A").collect()] == [("N::A.Go", 1.0)]
    assert {r["collection"]: r["n"] for r in engine.stats().collect()}["code_cs"] == 2


@pytest.fixture(scope="module")
def engine(spark):
    made = Engine(spark)
    told = {(r["outcome"], r["file_path"]) for r in made.index_files(files(spark)).collect()}
    assert told == {("indexed", p) for p, _ in SOURCES[:4]} | {("failed", "lib/bad.py")}
    docs = [("docs/fees.md", "# Mooring fee\nThe mooring fee is asked before a ship enters.\n"), ("docs/han.md", "# Hạn mức\nHạn mức tín dụng của khách hàng, credit-limit.\n"), ("docs/old.pdf", "%PDF")]
    assert {(r["outcome"], r["file_path"]) for r in made.index_docs(spark.createDataFrame(docs, "file_path string, text string")).collect()} == {("indexed", "docs/fees.md"), ("indexed", "docs/han.md"), ("failed", "docs/old.pdf")}
    return made


def test_indexing_is_one_unit(spark, engine):
    edges = {(r["src"], r["rel_type"], r["dst"]) for r in engine.tables["edges"].collect()}
    assert ("lib/tide/Gauge.ts", "DEFINES", "lib/tide/Gauge.ts::Gauge.readLevel") in edges and ("lib/port/Harbour.ts", "IMPORTS", "lib/fees/mooring.ts") in edges
    real = {r["qualified_name"] for r in engine.tables["entities"].collect()}
    assert all(src in real for src, _, _ in edges)
    index = {r["file_path"]: r for r in engine.tables["file_index"].collect()}
    assert index["lib/bad.py"]["status"] == "failed" and "unsupported" in index["lib/bad.py"]["error"] and index["lib/tide/Gauge.ts"]["status"] == "indexed"
    assert len(index["lib/tide/Gauge.ts"]["chunk_ids"]) == 5 and len(index["lib/tide/Gauge.ts"]["node_ids"]) == 6 and index["lib/tide/Gauge.ts"]["indexed_at"]
    states = {(r["file_path"], r["state"]) for r in engine.tables["intents"].collect()}
    assert {("lib/bad.py", "intent"), ("lib/bad.py", "failed"), ("lib/tide/Gauge.ts", "done"), ("docs/han.md", "done"), ("docs/old.pdf", "failed")} <= states
    assert engine.tables["jobs"].filter("status = 'pending' and attempts = 0").count() == store.read_points(spark, engine.points, ("code_ts",)).count() == 8
    assert engine.tables["doc_index"].count() == 2 and engine.tables["documents"].filter("is_latest").count() == 2
    counts = lambda: {n: engine.tables[n].count() for n in ("entities", "relations", "edges", "jobs", "file_index", "lengths")} | {"postings": engine._live_postings(engine.tables["postings"]).count()}
    before = counts()
    engine.index_files(files(spark, SOURCES[:2] + SOURCES[:2]))
    assert counts() == before  # once more, and twice in a batch, leaves the same
    assert engine.tables["jobs"].groupBy("chunk_id").count().filter("count > 1").count() == 0
    assert {r["outcome"]: r["n"] for r in Engine.summary(engine._outcomes(("indexed", files(spark)))).collect()} == {"indexed": 5}


def test_search(spark, engine):
    found = engine.callers("lib/fees/mooring.ts::mooringFee").collect()
    assert [(r["node"], r["hops"], r["confidence"]) for r in found] == [("lib/port/Harbour.ts::Harbour.admitShip", 1, 0.7)]
    assert engine.lookup_symbol("Harbour").first()["qualified_name"] == "lib/port/Harbour.ts::Harbour"
    packed = lambda *a, **k: [json.loads(r["json"]) for r in engine.search(*a, **k).collect()]
    hits = packed("mooring fee ship", top_k=3)
    assert hits[0]["chunk_id"] and len(hits) == 3 and "graph_context" in hits[0] and any(h.get("matched_via") == "docs" and h["source_type"] == "doc" for h in hits)
    assert all(h["language"] == "typescript" and h["source_type"] == "code" for h in packed("check", collections=["code_ts"], where={"language": "typescript"}))
    assert len(packed("read level", rerank=True, top_k=2, expand_graph=False)) == 2
    for query in ("mức", "HẠN MỨC", "credit-limit"):
        assert packed(query, collections=["docs"], top_k=1)[0]["file_path"] == "docs/han.md"
    assert packed("") == packed(" -- ") == packed("mooring", collections=["nope"]) == packed("mooring", collections=["issues"]) == []
    whole = json.loads(engine.search_response('mooring "fee"', top_k=2))
    assert whole["query"] == 'mooring "fee"' and len(whole["results"]) == 2 and whole["results"][0]["score"] >= whole["results"][1]["score"]
    assert {r["collection"]: r["n"] for r in engine.stats().collect()}["docs"] == 2 and engine.health()["status"] == "ok"


def test_embedders_by_collection(spark):
    one, other = (lambda tokens, v=v: F.array(*map(F.lit, v)).cast("array<float>") for v in ([1.0, 0.0], [0.0, 1.0]))
    engine = Engine(spark, embed=one, embed_text=other)
    engine.index_files(files(spark, SOURCES[:1]))
    engine.index_docs(spark.createDataFrame([("a.md", "some words")], "file_path string, text string"))
    rows = {r["collection"]: r["dense"] for r in store.read_points(spark, engine.points).collect()}
    assert rows["code_ts"] == [1.0, 0.0] and rows["docs"] == [0.0, 1.0]
    assert len(engine.search("words", collections=["docs", "code_ts"]).collect()) == 6


def test_descriptions(spark):
    engine = Engine(spark)
    engine.index_files(files(spark, SOURCES[:3]))
    ids = {r["qualified_name"].split("::")[1]: r["chunk_id"] for r in engine.tables["jobs"].collect()}
    store.delete_points(spark.createDataFrame([("lib/fees/mooring.ts",)], "file_path string"), engine.points)  # its job's chunk is lost
    answer = lambda p: F.when(F.contains(p, F.lit("Tên: Harbour\n")), F.lit(' "- Lets ships in." ')).when(F.contains(p, F.lit("Loại: method")), F.lit("'' "))
    told = {r["chunk_id"]: r["outcome"] for r in engine.describe(answer).collect()}
    assert told[ids["Harbour"]] == "done" and told[ids["mooringFee"]] == "vanished" and told[ids["Harbour.admitShip"]] == "pending"
    for _ in range(2):
        told = {r["chunk_id"]: (r["outcome"], r["error"]) for r in engine.describe(answer).collect()}
    assert told[ids["Harbour.admitShip"]] == ("failed", "empty description") and engine.describe(answer).count() == 0
    point = store.point(spark, engine.points, "code_ts", ids["Harbour"]).first()
    desc = store.point(spark, engine.points, "code_ts_desc", point["description_chunk_id"]).first()
    assert point["description_status"] == "ready" and desc["content"] == "Lets ships in." and desc["linked_chunk_id"] == ids["Harbour"] and desc["source_type"] == "code_description"
    assert engine.tables["entities"].filter("synthetic_description_vi = 'Lets ships in.'").count() == 1
    hit = json.loads(engine.search("ships", collections=["code_ts_desc"], expand_graph=False).first()["json"])
    assert hit["qualified_name"].endswith("::Harbour") and hit["matched_via"] == "description"
    engine.index_files(files(spark, SOURCES[1:2]))
    assert store.read_points(spark, engine.points, ("code_ts_desc",)).count() == 0 and engine._live_postings(engine.tables["postings"]).filter("collection = 'code_ts_desc'").count() == 0


def test_changes_relink_and_streams(spark, tmp_path):
    engine = Engine(spark)
    engine.index_files(files(spark, SOURCES[:4]))
    changed = lambda *rows: spark.createDataFrame(list(rows), "status string, path string, old_path string")
    told = engine.apply_changes(changed(("deleted", "lib/fees/mooring.ts", None)), files(spark, []))
    # the second one names it outside of any symbol
    assert {(r["outcome"], r["file_path"]) for r in told.collect()} == {("deleted", "lib/fees/mooring.ts"), ("relinked", "lib/port/Harbour.ts"), ("relinked", "lib/port/main.ts")}
    assert engine.callers("lib/fees/mooring.ts::mooringFee").count() == 0 and engine.callees("lib/port/Harbour.ts::Harbour.admitShip").count() == 0
    assert engine.tables["file_index"].filter("status = 'deleted'").first()["file_path"] == "lib/fees/mooring.ts"
    # the function comes back elsewhere: edges of files that did not change find it
    rows = [("added", "lib/money/fee.ts", None, "export function mooringFee(a: number) { return a; }", 1), ("modified", "lib/bad.py", None, "x", 1)]
    spark.createDataFrame(rows, "status string, path string, old_path string, content string, at int").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("status string, path string, old_path string, content string, at int").parquet(str(tmp_path / "in"))
    jobs.apply_stream(stream, engine.apply_changes, str(tmp_path / "log"))
    assert [(r["node"], r["confidence"]) for r in engine.callers("lib/money/fee.ts::mooringFee").collect()] == [("lib/port/Harbour.ts::Harbour.admitShip", 0.5)]
    assert engine.tables["file_index"].filter("status = 'failed'").first()["file_path"] == "lib/bad.py"
    told = engine.rename_file("lib/money/fee.ts", "lib/fees/mooring.ts", SOURCES[2][1])
    assert ("relinked", "lib/port/Harbour.ts") in {(r["outcome"], r["file_path"]) for r in told.collect()}
    assert [(r["node"], r["confidence"]) for r in engine.callers("lib/fees/mooring.ts::mooringFee").collect()] == [("lib/port/Harbour.ts::Harbour.admitShip", 0.7)]


def test_history_and_repair(spark):
    engine = Engine(spark)
    engine.index_files(files(spark))
    paths = ["lib/tide/Gauge.ts", "lib/port/Harbour.ts", "gone/away.ts"]
    commits = lambda at: spark.createDataFrame([(f"h{i}", "An", f"2024-01-0{i + 1}", f"m{i}", paths) for i in at], "hash string, author string, date string, message string, files array<string>").withColumn("date", F.to_timestamp("date"))
    engine.index_history(commits([0, 1]))
    assert engine.co_changed(paths[0]).count() == 0 and [r["count"] for r in engine.co_changed(paths[0], 1).collect()] == [2]
    engine.index_history(commits([1, 2, 3]))  # one of them once more
    assert [(r["other"], r["count"]) for r in engine.co_changed(paths[0]).collect()] == [(paths[1], 4)] and engine.tables["touches"].count() == 8
    wide = [(f"w{i}", [*paths, *(f"x{j}.ts" for j in range(40))]) for i in range(3)]
    engine.index_history(spark.createDataFrame(wide, "hash string, files array<string>"))  # mass commits touch, and pair nothing
    assert [(r["other"], r["count"]) for r in engine.co_changed(paths[0]).collect()] == [(paths[1], 4)] and engine.tables["touches"].count() == 14
    assert [(r["hash"], r["author"], r["message"]) for r in engine.recent_commits(paths[0], 2).collect()] == [("h3", "An", "m3"), ("h2", "An", "m2")]
    hit = json.loads(engine.search("steady level", collections=["code_ts"], top_k=1).first()["json"])
    assert hit["file_path"] == paths[0] and {"hash": "h3", "author": "An", "message": "m3"}.items() <= max(hit["graph_context"]["recent_commits"], key=lambda c: c["hash"] if c["hash"][0] == "h" else "").items()
    some = engine.tables["jobs"].first()["chunk_id"]
    engine.index_issues(spark.createDataFrame([(some, "I-1"), (some, "I-1"), ("none", "I-2")], "chunk_id string, issue_id string"))
    engine.index_issues(spark.createDataFrame([(some, "I-1", "Title", "open")], "chunk_id string, issue_id string, title string, status string"))
    assert [(r["issue_id"], r["title"], r["status"], r["source_reliability"]) for r in engine.tables["issues"].collect()] == [("I-1", "Title", "open", None)]
    store.delete_points(spark.createDataFrame([(paths[0],)], "file_path string"), engine.points)  # silent drift
    engine.tables.put("file_index", changes.patch(engine.tables["file_index"], spark.createDataFrame([(paths[1], True)], "file_path string, dirty boolean"), ["file_path"]))
    assert [r["file_path"] for r in engine.drift().collect()] == [paths[0]]
    told = [(r["outcome"], r["file_path"], r["error"] is None) for r in engine.repair(fraction=1.0).collect()]
    assert sorted(told) == [("dirty_processed", paths[1], True), ("failed_retried", "lib/bad.py", False), ("sample_marked_dirty", paths[0], True)]
    told = {r["outcome"]: r["file_path"] for r in engine.repair(fraction=1.0).collect()}
    assert told["dirty_processed"] == paths[0] and "sample_marked_dirty" not in told and engine.drift().count() == 0
    assert engine.tables["file_index"].filter("dirty").count() == 0


def test_index_repo(spark, tmp_path):
    for name, text in (("src/a.ts", "export function alpha() {}"), ("node_modules/b.ts", "function beta() {}"), ("read.md", "# Title\nwords\n")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    engine = Engine(spark)
    told = {(r["outcome"], r["file_path"].rsplit("/", 1)[1]) for r in engine.index_repo(str(tmp_path)).collect()}
    assert {r["file_path"] for r in engine.tables["entities"].collect()} == {f"{tmp_path}/src/a.ts"}
    assert told == {("indexed", "a.ts"), ("indexed", "read.md")} and engine.lookup_symbol("alpha").count() == 1


def test_a_repository_from_its_first_commit_to_a_search(spark, tmp_path):
    """Scan, log and diff of one repository name its files alike."""
    repo = tmp_path / "repo"
    (repo / "src").mkdir(parents=True)

    def git(*args):
        subprocess.run(["git", "-C", str(repo), "-c", "user.name=Bo", "-c", "user.email=b@b", *args], check=True, capture_output=True)

    git("init", "-q")
    for i in range(4):
        (repo / "src/tide.ts").write_text(f"export function highTide(a: number) {{ return a + {i}; }}\n")
        (repo / "src/port.ts").write_text(f"import {{ highTide }} from './tide';\nexport function enter() {{ return highTide({i}); }}\n")
        git("add", "-A")
        git("commit", "-qm", f"step {i}")
    engine = Engine(spark)
    engine.index_repo(str(repo))
    engine.index_history(gitlog.commit_log(spark, str(repo)))
    tide, port = f"{repo}/src/tide.ts", f"{repo}/src/port.ts"
    assert [(r["other"], r["count"]) for r in engine.co_changed(tide).collect()] == [(port, 4)]
    assert {r["message"] for r in engine.recent_commits(port).collect()} == {f"step {i}" for i in range(4)} and engine.recent_commits(port).first()["author"] == "Bo"
    git("mv", "src/tide.ts", "src/moon.ts")
    (repo / "src/moon.ts").write_text("export function highTide(a: number) { return a + 3; }\n")
    git("add", "-A")
    git("commit", "-qm", "step 4")
    changed = gitlog.diff_changes(spark, str(repo), "HEAD~1", "HEAD")
    told = {(r["outcome"], r["file_path"]) for r in engine.apply_changes(changed, scan_repo(spark, str(repo))).collect()}
    assert told == {("deleted", tide), ("indexed", f"{repo}/src/moon.ts"), ("relinked", port)}
    assert [r["node"] for r in engine.callers(f"{repo}/src/moon.ts::highTide").collect()] == [f"{port}::enter"]
    assert engine.co_changed(port).count() == 0
    engine.index_history(gitlog.commit_log(spark, str(repo)))
    assert engine.recent_commits(f"{repo}/src/moon.ts").first()["message"] == "step 4"


def test_nothing_is_there_yet_or_any_more(spark):
    engine = Engine(spark)
    empty = lambda: [engine.callers("x"), engine.callees("x"), engine.lookup_symbol("x"), engine.co_changed("x"), engine.recent_commits("x"), engine.search("x"), engine.drift(), engine.repair(), engine.describe(lambda p: p), engine.recover()]
    assert [df.count() for df in empty()] == [0] * 10 and engine.stats().filter("n > 0").count() == 0 and engine.health()["status"] == "degraded"
    engine.delete_files(spark.createDataFrame([("no.ts",)], "file_path string"))
    engine.index_history(spark.createDataFrame([("h", ["no.ts"])], "hash string, files array<string>"))
    one = files(spark, SOURCES[:1])
    engine.index_files(one)
    engine.delete_files(one)
    assert engine.tables["file_index"].first()["status"] == "deleted" and engine.tables["edges"].count() == engine.tables["jobs"].count() == 0
    assert [df.count() for df in empty()] == [0] * 10
    assert engine.index_files(one).first()["outcome"] == "indexed" and engine.lookup_symbol("Gauge").count() == 1
    assert json.loads(engine.search("steady", top_k=1).first()["json"])["symbol_name"]


def test_a_reranker_that_fails_keeps_the_order(spark, engine):
    ids = lambda **k: [r["chunk_id"] for r in engine.search("mooring fee ship", top_k=3, expand_graph=False, **k).collect()]

    def broken(query, texts):
        raise RuntimeError("no model")

    kept = [r["score"] for r in engine.search("mooring fee ship", top_k=3, expand_graph=False, rerank=broken).collect()]
    assert kept == sorted(kept, reverse=True) and len(kept) == 3 and ids(rerank=broken)[0] == ids()[0]
    longest = engine.search("mooring fee ship", top_k=2, expand_graph=False, rerank=lambda query, texts: [len(t) for t in texts]).collect()
    found = [len(json.loads(r["json"])["content"]) for r in longest]
    assert found == sorted(found, reverse=True)


def test_evaluation_by_history(spark, engine):
    at = lambda i: f"2024-01-{i:02d}"
    rows = [
        ("h1", at(1), "fix: mooringFee asked twice", ["lib/fees/mooring.ts"]), ("h2", at(2), "Bug(port): admitShip of Harbour", ["lib/port/Harbour.ts", "read.me"]), ("h3", at(3), "feat: read level", ["lib/tide/Gauge.ts"]),
        ("h4", at(4), "fix: wide", [f"x{i}.ts" for i in range(31)]), ("h5", at(5), "fix: words only", ["a.md"]), ("h6", at(6), "fix: qqq zzz", ["lib/none.ts"])]
    history = spark.createDataFrame(rows, "hash string, date string, message string, files array<string>")
    golden = {(r["query"], r["text"], r["item"]) for r in evaluation.golden_set(history).collect()}
    assert golden == {("h1", "mooringFee asked twice", "lib/fees/mooring.ts"), ("h2", "admitShip of Harbour", "lib/port/Harbour.ts"), ("h6", "qqq zzz", "lib/none.ts")}
    assert {r["query"] for r in evaluation.golden_set(history, 1).collect()} == {"h6"}
    many = engine.search_many(spark.createDataFrame([("a", "mooringFee"), ("b", "admitShip"), ("c", "")], "query string, text string"), 3).collect()
    assert {r["query"] for r in many} == {"a", "b"} and next(r["file_path"] for r in many if (r["query"], r["rank"]) == ("b", 1)) == "lib/port/Harbour.ts"
    told = engine.evaluate(history, k=1).first()
    assert told["queries"] == 3 and told["precision"] == 0.666667 and told["mrr"] == 0.666667


def test_searches_by_lists_of_vectors(spark):
    """One list is all vectors: the same hits as by all points, before and after a change that the lists don't know."""
    engine = Engine(spark)
    docs = lambda *rows: spark.createDataFrame(rows, "file_path string, text string")
    engine.index_docs(docs(("docs/a.md", "# Fees\nmooring fee of a ship\n"), ("docs/b.md", "# Levels\na steady level\n")))
    queries = spark.createDataFrame([("a", "mooring fee"), ("c", "--")], "query string, text string")

    def hits(exact):
        found = engine.search("mooring fee", ["docs"], expand_graph=False, exact=exact).collect()
        return [(r["chunk_id"], r["score"]) for r in found], sorted(map(tuple, engine.search_many(queries, 3, ("docs",), exact=exact).collect()))

    engine.index_vectors(lists=1)
    assert hits(True) == hits(False) and len(hits(False)[0]) == 2
    engine.index_docs(docs(("docs/b.md", "# Moorings\nwhat a mooring costs\n")))
    assert hits(True) == hits(False) and len(hits(False)[0]) == 2


def test_lost_writers_and_workers(spark):
    engine = Engine(spark)
    engine.index_files(files(spark, SOURCES[:1]))
    # a writer that was lost after its intent, once with its sources written and once without
    source = spark.createDataFrame([(*SOURCES[1], "s")], "file_path string, content string, stamp string")
    with_lost = spark.createDataFrame([(SOURCES[1][0],), ("away.ts",)], "file_path string")
    engine._log(with_lost, "op", "MODIFIED", "intent")
    engine.tables.change("sources", source, source, ["file_path"])
    assert {(r["outcome"], r["file_path"], r["error"]) for r in engine.recover().collect()} == {("recovered", SOURCES[1][0], None), ("failed", "away.ts", "interrupted")}
    assert engine.lookup_symbol("Harbour").count() == 1 and engine.recover().count() == 0
    # a worker that was lost with its claims
    jobs_ = engine.tables["jobs"].withColumns({"status": F.lit("processing"), "attempts": F.lit(1).cast("long"), "claimed_at": F.current_timestamp() - F.expr("INTERVAL 1 HOUR")})
    engine.tables.put("jobs", jobs_)
    answer = lambda p: F.lit("Does it.")
    assert engine.describe(answer, lease_seconds=7200).count() == 0
    told = engine.describe(answer).collect()
    assert {r["outcome"] for r in told} == {"done"} and engine.tables["jobs"].filter("status = 'done' and attempts = 2").count() == len(told) == 7


def test_a_unit_leaves_nothing_aside(spark, tmp_path):
    spark_dir = spark.conf.get("spark.checkpoint.dir", None)
    engine = Engine(spark, str(tmp_path / "kb"))
    held = lambda: {p.name for p in Path(spark.conf.get("spark.checkpoint.dir")).glob("aside-*")} if spark.conf.get("spark.checkpoint.dir", None) else set()
    before = held()
    engine.index_files(files(spark))
    engine.apply_changes(spark.createDataFrame([("deleted", SOURCES[0][0], None)], "status string, path string, old_path string"), files(spark, []))
    assert held() == before and spark_dir in (None, spark.conf.get("spark.checkpoint.dir"))


def test_a_change_reads_the_folders_of_its_names(spark, monkeypatch):
    monkeypatch.setattr(store, "ROWS", 4)
    engine = Engine(spark)
    engine.tables.rows = 4
    engine.index_files(files(spark, SOURCES[:4]))
    assert engine.tables.about("identifiers")["folders"] > 4
    names = spark.createDataFrame([("mooringFee",)], "name string")
    rows = engine.tables.get("identifiers", names)
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ = \d+", rows._jdf.queryExecution().executedPlan().toString())
    assert {r["file_path"] for r in rows.filter("token = 'mooringFee'").collect()} == {p for p, t in SOURCES[:4] if "mooringFee" in t}
