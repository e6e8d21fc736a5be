"""Version-control logs and diffs, parsed as DataFrames of lines."""

from __future__ import annotations

import os
import subprocess

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import normal_path
from tessera.operators.filters import indexed_source
from tessera.workspace import scratch, write_stream

SEPARATOR = "\x1f"
#: What a commit begins with in logs that are written to be read in parallel.
RECORD = "\x1e"
# Fixed value: a commit's fields, as results name them.
LOG_FORMAT = "%H%x1f%an%x1f%aI%x1f%s"
_CHUNK = 1 << 20


def git_output(spark: SparkSession, repo: str, *arguments: str) -> str:
    """The path of a git command's output, streamed to a file in the shared folder."""
    path = f"{scratch(spark, 'git')}/out.txt"
    with subprocess.Popen(["git", "-C", repo, "-c", "core.quotepath=off", *arguments], stdout=subprocess.PIPE) as process:
        write_stream(spark, path, iter(lambda: process.stdout.read(_CHUNK), b""))
    if process.returncode:
        raise subprocess.CalledProcessError(process.returncode, process.args)
    return path


def commit_log(spark: SparkSession, repo: str, lookback: int | None = 500, root: str | None = None) -> DataFrame:
    """The commits of a repository, the last `lookback` or all. Files are named as under root: where the repository was scanned, its own folder if not given."""
    some = [] if lookback is None else [f"-{lookback}"]
    path = git_output(spark, repo, "log", f"--format=%x1e{LOG_FORMAT}", "--name-only", *some)
    return read_log(spark, path, root or os.path.abspath(repo))


def read_log(spark: SparkSession, path: str, root: str | None = None) -> DataFrame:
    """(hash, author, date, message, files) from log files whose commits begin with RECORD.

    The files are split at that character, so a log of any length is read by all tasks, and a commit needs
    nothing but its own record.
    """
    lines = F.split("value", "\n")
    head = F.split(F.get(lines, F.lit(0)), SEPARATOR, 4)
    files = F.filter(F.transform(F.slice(lines, 2, F.size(lines)), lambda x: F.trim(x)), lambda x: x != "")
    records = spark.read.option("lineSep", RECORD).text(path).select(head.alias("head"), files.alias("files")).filter(F.size("head") == 4)
    at = lambda i: F.get(F.col("head"), F.lit(i))
    return records.select(at(0).alias("hash"), at(1).alias("author"), F.to_timestamp(at(2)).alias("date"), at(3).alias("message"), F.transform("files", lambda x: normal_path(x, root)).alias("files"))


def parse_log(lines: DataFrame) -> DataFrame:
    """Lines (log, line_no, line) as commits (hash, author, date, message, files), a log's headers opening groups.

    A header has four fields; one with fewer opens nothing, its files stay with the commit before.
    """
    fields = F.split("line", SEPARATOR, 4)
    header = F.contains(F.col("line"), F.lit(SEPARATOR)) & (F.size(fields) == 4)
    marked = lines.withColumn("header", header).withColumn("fields", fields)
    grouped = marked.withColumn("commit_no", F.sum(F.col("header").cast("int")).over(Window.partitionBy("log").orderBy("line_no"))).filter("commit_no > 0")
    is_file = ~F.col("header") & (F.trim("line") != "") & ~F.contains(F.col("line"), F.lit(SEPARATOR))
    files = F.transform(F.sort_array(F.collect_list(F.when(is_file, F.struct("line_no", F.trim("line").alias("file"))))), lambda x: x["file"])
    head = F.max(F.when(F.col("header"), F.col("fields"))).alias("head")
    at = lambda i: F.get(F.col("head"), F.lit(i))
    return grouped.groupBy("log", "commit_no").agg(head, files.alias("files")).select(
        "log", "commit_no", at(0).alias("hash"), at(1).alias("author"), F.to_timestamp(at(2)).alias("date"), at(3).alias("message"), "files")


def diff_changes(spark: SparkSession, repo: str, old: str, new: str, root: str | None = None) -> DataFrame:
    """Changes between two commits; paths as in commit_log."""
    lines = spark.read.text(git_output(spark, repo, "diff", "--name-status", "-M", old, new)).withColumnRenamed("value", "line")
    under = root or os.path.abspath(repo)
    return decode_changes(lines).withColumns({c: normal_path(F.col(c), under) for c in ("path", "old_path")})


def decode_changes(lines: DataFrame) -> DataFrame:
    """Name-status lines as (status, path, old_path): M and T modified, A and copies added, D deleted, R renamed.

    Each side of a rename is kept only if it is a source file: with one such side it is an addition or a deletion.
    """
    parts = F.split("line", "\t")
    code, first, second = F.substring(parts[0], 1, 1), F.get(parts, F.lit(1)), F.get(parts, F.lit(2))
    decoded = lines.select(code.alias("code"), first.alias("first"), second.alias("second")).withColumns({
        "old_ok": indexed_source(F.col("first")), "new_ok": F.coalesce(indexed_source(F.col("second")), F.lit(False))})
    status = (
        F.when(F.col("code").isin("M", "T") & F.col("old_ok"), "modified").when((F.col("code") == "A") & F.col("old_ok"), "added").when((F.col("code") == "D") & F.col("old_ok"), "deleted")
        .when((F.col("code") == "C") & F.col("new_ok"), "added").when((F.col("code") == "R") & F.col("old_ok") & F.col("new_ok"), "renamed")
        .when((F.col("code") == "R") & F.col("new_ok"), "added").when((F.col("code") == "R") & F.col("old_ok"), "deleted")
    )
    path = F.when(F.col("code").isin("R", "C") & F.col("new_ok"), F.col("second")).otherwise(F.col("first"))
    return decoded.withColumn("status", status).filter("status is not null").select("status", path.alias("path"), F.when(F.col("status") == "renamed", F.col("first")).alias("old_path"))
