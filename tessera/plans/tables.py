"""The engine's tables, derived from the driver's parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import html_text, windows
from tessera.operators import retrieval, vector_index
from tessera.operators.graph import merge_edges
from tessera.workspace import exists, scratch, stamp

# How event types stand for change codes and job events.
CHANGE_OF = {"click": "M", "signup": "A", "error": "D", "purchase": "R"}
JOB_OF = {"signup": "enqueue", "click": "claim", "error": "fail", "purchase": "done"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_MADE: dict[tuple, str] = {}


def _made(spark: SparkSession, sf_dir: str, source: str, name: str) -> tuple[tuple, str | None]:
    """What made_once knows something by, and its path if it is there."""
    key = spark.sparkContext.applicationId, sf_dir, name, stamp(spark, f"{sf_dir}/{source}.parquet")
    return key, _MADE[key] if key in _MADE and exists(spark, _MADE[key]) else None


def made_once(spark: SparkSession, sf_dir: str, source: str, name: str, write) -> str:
    """The path of something derived from a table, written by write(path) when first asked for in a session and again once the table's file has changed."""
    key, path = _made(spark, sf_dir, source, name)
    if path is None:
        path = scratch(spark, name.split(":")[0])
        write(path)
        _MADE[key] = path
    return path


def _postings(spark: SparkSession, sf_dir: str, source: str, name: str, rows: DataFrame, key: str, terms: list[str] | None) -> tuple[DataFrame, DataFrame]:
    """Postings of all terms or of some, and the corpus statistics. Some terms alone do not pay for postings of all: until a query needs those, one pass over the texts finds them."""
    if terms is None or _made(spark, sf_dir, source, name)[1]:
        return retrieval.read_postings(spark, made_once(spark, sf_dir, source, name, lambda path: retrieval.write_postings(rows, path, key, "text")), terms)
    asked = made_once(spark, sf_dir, source, f"{name}-asked:{sorted(set(terms))}", lambda path: retrieval.write_asked(rows, path, key, "text", terms))
    return retrieval.read_asked(rows, asked, key)


def document_postings(spark: SparkSession, sf_dir: str, terms: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _postings(spark, sf_dir, "documents", "doc-postings", docs, "doc_id", terms)


def turn_postings(spark: SparkSession, sf_dir: str, terms: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("turn_id"), "text")
    return _postings(spark, sf_dir, "conversations", "turn-postings", turns, "turn_id", terms)


def vector_index_path(spark: SparkSession, sf_dir: str) -> str:
    rows = table(spark, sf_dir, "embeddings")
    return made_once(spark, sf_dir, "embeddings", "vector-index", lambda path: vector_index.write_index(rows, path, "vec_id", "embedding"))


def mapped(column, values: dict):
    out = F.lit(None).cast("string")
    for k, v in values.items():
        out = F.when(column == k, v).otherwise(out)
    return out


#: Lines that a task takes of the history: its parts follow the table, so a task's memory does not.
LINES_EACH = 500_000


def history_parts(spark: SparkSession, sf_dir: str, lines_each: int = LINES_EACH) -> int:
    lines = table(spark, sf_dir, "lineitem").count()  # from the file's footer
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-lines // lines_each))


def commit_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both tables dealt by commit to history_parts: distinct, join and what is grouped by commit later need no other shuffle."""
    parts = history_parts(spark, sf_dir)
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("commit"), F.col("l_suppkey").alias("file")).repartition(parts, "commit").distinct()
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("commit"), F.col("o_orderdate").alias("date"), F.col("o_custkey").alias("author"), F.col("o_orderpriority").alias("message"))
    return lines.join(orders.repartition(parts, "commit"), "commit")


def edge_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 997).alias("dst"), F.lit("CALLS").alias("rel_type"), F.round(1 - F.col("l_discount"), 2).alias("confidence"),
        "l_orderkey", "l_linenumber", "l_extendedprice")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merged edges, written once: a path search then starts from few rows instead of merging all writes."""
    merge = lambda path: merge_edges(edge_writes(spark, sf_dir), ["l_orderkey", "l_linenumber", "l_extendedprice"]).write.parquet(path)
    return spark.read.parquet(made_once(spark, sf_dir, "lineitem", "edges", merge))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"), F.col("s_name").alias("name"))


def doc_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")


def page_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", html_text(F.col("html")).alias("text"))
    return windows(pages, "text")


def change_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name-status lines: a user's events as changes of the user's file, purchases as renames to a new one."""
    code = mapped(F.col("event_type"), CHANGE_OF)
    old = F.concat(F.lit("src/u"), F.col("user_id"), F.lit(".ts"))
    new = F.concat(F.lit("src/e"), F.col("event_id"), F.when(F.col("value") < 50, ".ts").otherwise(".md"))
    line = F.when(code == "R", F.concat_ws("\t", F.lit("R100"), old, new)).otherwise(F.concat_ws("\t", code, old))
    return table(spark, sf_dir, "events").filter(code.isNotNull()).select(line.alias("line"))


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = mapped(F.col("event_type"), JOB_OF)
    return table(spark, sf_dir, "events").select("user_id", "ts", "event_id", kind.alias("kind")).filter("kind is not null")
