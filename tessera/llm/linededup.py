"""Exact line deduplication across documents, in DataFrame functions only.

Lines become 128-bit hashes of their keys with (document, position). The hashes are range-partitioned
and sorted by document and position within, and one streaming pass keeps the first document of each.
A line that many documents share must not end in one task, so there are two such passes: the first
by (hash, one of many parts of the documents), the second over the first document of every part.
What comes back per document is its dropped lines as runs: a run-length compressed keep bitmap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import ASCII_SPACE, ascii_lower, free_name, let

#: The least parts that a line's documents are dealt to; with more shuffle partitions, as many as these.
LEAST_SALTS = 64


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(ASCII_SPACE)))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """Per document that loses lines: __id, __digest, n_dropped and drop_runs, array<struct<first, last>>.

    A line goes if its key has min_chars code points or more and a smaller document id holds it too.
    Null ids come after all others and count as one document. Rows with the same id are one document,
    each judged by its own lines; __digest tells such rows' texts apart.
    """
    salts = max(LEAST_SALTS, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    lines = docs.select(
        F.col(id_col).alias("__id"), F.xxhash64(text_col).alias("__digest"), F.posexplode(_lines(F.col(text_col))).alias("pos", "line")
    ).select("__id", "__digest", "pos", line_key(F.col("line")).alias("key"))
    hashed = lines.filter(F.char_length("key") >= min_chars).select(
        "__id", "__digest", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"),
        F.pmod(F.xxhash64("__id"), F.lit(salts)).cast("int").alias("part"))

    def later(rows: DataFrame, *by: str) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(F.col("__id").asc_nulls_last(), "__digest", "pos")
        first = F.first(F.struct("__id")).over(order)["__id"]
        return rows.repartitionByRange(*by).withColumn("later", ~F.col("__id").eqNullSafe(first))

    parts = later(hashed, "h1", "h2", "part")
    firsts = later(parts.filter(~F.col("later")).drop("later", "part"), "h1", "h2")
    dropped = parts.filter("later").select("__id", "__digest", "pos").unionAll(firsts.filter("later").select("__id", "__digest", "pos"))
    lost = dropped.groupBy("__id", "__digest").agg(F.sort_array(F.collect_set("pos")).alias("lost"))
    at = lambda i: F.get(F.col("lost"), i)
    heads = F.filter("lost", lambda x, i: (i == 0) | (at(i - 1) != x - 1))
    tails = F.filter("lost", lambda x, i: (i == F.size("lost") - 1) | (at(i + 1) != x + 1))
    runs = F.zip_with(heads, tails, lambda a, b: F.struct(a.alias("first"), b.alias("last")))
    return lost.select("__id", "__digest", F.size("lost").cast("long").alias("n_dropped"), runs.alias("drop_runs"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with text_col holding the kept lines, and n_lines, n_dropped, drop_runs.

    A null text is one empty line and becomes ''. Columns of those names in docs are replaced.
    """
    plain = docs.drop("n_lines", "n_dropped", "drop_runs")
    own, their_id, theirs = (free_name(plain, c) for c in ("__own", "__id", "__digest"))
    bitmaps = bitmaps.withColumnsRenamed({"__id": their_id, "__digest": theirs})
    met = plain.withColumn(own, F.xxhash64(text_col)).join(bitmaps, F.col(id_col).eqNullSafe(F.col(their_id)) & (F.col(own) == F.col(theirs)), "left")

    def keep(both: Column) -> Column:
        lines, runs = both["lines"], both["runs"]
        start = lambda k: F.when(k == 0, 0).otherwise(F.get(runs, k - 1)["last"] + 1)
        stop = lambda k: F.when(k == F.size(runs), F.size(lines)).otherwise(F.get(runs, k)["first"])
        pieces = F.transform(F.sequence(F.lit(0), F.size(runs)), lambda k: F.slice(lines, start(k) + 1, stop(k) - start(k)))
        return F.array_join(F.flatten(pieces), "\n")

    text = F.coalesce(F.col(text_col), F.lit(""))
    kept = F.when(F.col("drop_runs").isNull(), text).otherwise(let(F.struct(_lines(F.col(text_col)).alias("lines"), F.col("drop_runs").alias("runs")), keep))
    return met.select(
        *(kept.alias(c) if c == text_col else F.col(c) for c in plain.columns),
        F.size(_lines(F.col(text_col))).cast("long").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0).cast("long")).alias("n_dropped"), "drop_runs",
    )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """docs without the lines that a document of smaller id holds; an empty table stays empty."""
    return apply_bitmaps(docs, keep_bitmaps(docs, id_col, text_col, min_chars), id_col, text_col)
