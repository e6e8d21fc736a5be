"""Retrieval quality over ranked lists and relevance judgements."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.filters import indexed_source
from tessera.schema import MAX_COMMIT_FILES


#: How messages of commits that mend something begin.
MENDING = r"(?i)^\s*(fix|bug)(\([^)]*\))?!?\s*:"


def golden_set(commits: DataFrame, most: int = 50, max_files: int = MAX_COMMIT_FILES) -> DataFrame:
    """(query, text, item) from history (hash, date, message, files): the message of a mending commit is a query, the files it changed are what a search should find.

    The latest `most` of them, mass commits and those without a source file aside.
    """
    files = F.filter("files", indexed_source)
    good = commits.filter(F.col("message").rlike(MENDING)).select("hash", "date", "message", files.alias("files")).filter((F.size("files") > 0) & (F.size("files") <= max_files))
    chosen = good.orderBy(F.col("date").desc(), "hash").limit(most)
    text = F.trim(F.regexp_replace("message", MENDING, ""))
    return chosen.select(F.col("hash").alias("query"), text.alias("text"), F.explode(F.array_distinct("files")).alias("item"))


def precision_at(ranked: DataFrame, relevant: DataFrame, k: int, query: str = "query", item: str = "item") -> DataFrame:
    """(query, precision): relevant rows among each query's first k, over k."""
    hits = relevant.select(query, item).distinct().withColumn("__hit", F.lit(1))
    return ranked.filter(F.col("rank") <= k).join(hits, [query, item], "left").groupBy(query).agg(F.round(F.sum(F.coalesce("__hit", F.lit(0))) / k, 6).alias("precision"))


def mean(scores: DataFrame, column: str, name: str) -> DataFrame:
    """One row: the mean of a score over its queries, null without any."""
    return scores.agg(F.round(F.avg(column), 6).alias(name))


def reciprocal_rank(ranked: DataFrame, relevant: DataFrame, query: str = "query", item: str = "item") -> DataFrame:
    """(query, rr): one over the rank of the first relevant row, 0 without one."""
    hits = relevant.select(query, item).distinct().withColumn("__hit", F.lit(True))
    first = F.min(F.when(F.col("__hit"), F.col("rank")))
    return ranked.join(hits, [query, item], "left").groupBy(query).agg(F.round(F.coalesce(1 / first, F.lit(0.0)), 6).alias("rr"))
