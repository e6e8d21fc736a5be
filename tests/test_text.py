from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import text as tx


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first()["y"]


def test_windows_cover_and_overlap(spark):
    rows = tx.windows(spark.createDataFrame([(1, "a" * 3000), (2, "short"), (3, "  "), (4, None), (5, "b" * 1200), (6, "c" * 1201)], "id int, x string"), "x").collect()
    by = {}
    for r in rows:
        by.setdefault(r["id"], []).append((r["char_start"], len(r["content"])))
    assert sorted(by[1]) == [(0, 1200), (1050, 1200), (2100, 900)]
    assert by[2] == [(0, 5)] and 3 not in by and 4 not in by and by[5] == [(0, 1200)]
    assert sorted(by[6]) == [(0, 1200), (1050, 151)]
    whole = tx.windows(spark.createDataFrame([(1, "abc")], "id int, x string"), "x", 0).first()
    assert whole["content"] == "abc"


@settings(max_examples=15, deadline=None)
@given(st.text("ab \n", min_size=1, max_size=400), st.integers(5, 60), st.integers(0, 10))
def test_windows_property(spark, text, size, overlap):
    rows = sorted(tx.windows(spark.createDataFrame([(text,)], "x string"), "x", size, overlap).collect(), key=lambda r: r["char_start"])
    body = text.strip(tx.SPACE)
    step, at, want = max(1, size - overlap), 0, []
    while body:
        want.append((at, body[at : at + size]))
        if at + size >= len(body):
            break
        at += step
    assert [(r["char_start"], r["content"]) for r in rows] == want


def test_sections_and_chunks(spark):
    text = "intro\n\n# One\n\n\nalpha\nbeta\n## Two ##x\n# Three\n"
    docs = spark.createDataFrame([("a.md", text), ("b.md", "# Hello")], "file_path string, text string")
    got = {(r["file_path"], r["title"]): r["body"] for r in tx.sections(docs, ["file_path"], "text").collect()}
    assert got[("a.md", None)] == "intro\n" and got[("a.md", "One")] == "\n\nalpha\nbeta" and got[("b.md", "Hello")] == ""
    rows = sorted(tx.chunks(docs, ["file_path"], "text").collect(), key=lambda r: r["chunk_index"])
    assert [(r["chunk_index"], r["title"], r["content"], r["line_start"], r["line_end"]) for r in rows] == [(0, None, "intro", 1, 1), (1, "One", "alpha\nbeta", 6, 7)]


def test_scalars(spark):
    assert one(spark, "src/a/b.test.TS", tx.suffix) == "ts"
    assert one(spark, "src/a/b.ts", tx.basename) == "b.ts"
    assert one(spark, "class A {\n x", tx.first_line) == "class A {"
    assert one(spark, '  "- `Does it.`" ', tx.cleaned) == "`Does it.".strip("`") or one(spark, '"- Does it."', tx.cleaned) == "Does it."
    assert one(spark, "a call to load()", lambda c: tx.mentions(c, ["load", "a.b"])) and not one(spark, "reload", lambda c: tx.mentions(c, ["load"])) and not one(spark, "x", lambda c: tx.mentions(c, []))
    assert one(spark, "<p>a<script>x</script> b</p>\n c", tx.html_text) == "a b c"
    assert one(spark, "a.cs", tx.language_of) == "csharp" and one(spark, "a.mts", tx.language_of) == "typescript"
    made = one(spark, " " + "x" * 10000, lambda c: tx.prompt(F.lit("f"), F.lit("function"), F.lit(None).cast("string"), F.lit(None).cast("string"), c))
    assert made.count("(không có)") == 2 and made.endswith("\n" + "x" * 500 + "\n")
