"""Co-change mining over (commit, file, date)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.schema import MAX_COMMIT_FILES, MIN_COUNT


def co_change_pairs(commit_files: DataFrame, min_count: int = MIN_COUNT, max_files: int | None = MAX_COMMIT_FILES, parts: int | None = None) -> DataFrame:
    """(file_a, file_b, count, last_seen) of files committed together, file_a < file_b.

    Commits of more than max_files files are mass edits: they are left out before pairs are made, which
    also bounds the pairs of a commit. Files become a sorted array per commit, so pairs need no join.
    parts: the tasks that pairs are dealt to before they are counted, for histories whose pairs are mostly different.
    """
    commits = commit_files.groupBy("commit").agg(F.sort_array(F.collect_set("file")).alias("files"), F.max("date").alias("date"))
    if max_files is not None:
        commits = commits.filter(F.size("files") <= max_files)
    firsts = commits.select("date", "files", F.posexplode("files").alias("i", "file_a"))
    pairs = firsts.select("date", "file_a", F.explode(F.slice("files", F.col("i") + 2, F.size("files"))).alias("file_b"))
    pairs = pairs if parts is None else pairs.repartition(parts, "file_a", "file_b")
    return pairs.groupBy("file_a", "file_b").agg(F.count("*").alias("count"), F.max("date").alias("last_seen")).filter(F.col("count") >= min_count)
