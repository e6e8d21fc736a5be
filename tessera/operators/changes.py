"""Incremental change application: name deltas, referencers, changed paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of one side only; an error for unlike columns."""
    if sorted(a.columns) != sorted(b.columns):
        raise ValueError(f"unlike columns: {a.columns}, {b.columns}")
    return a.exceptAll(b.select(a.columns)).unionByName(b.select(a.columns).exceptAll(a)).distinct()


def changed_paths(changes: DataFrame) -> DataFrame:
    """All paths that changes touch, both sides of renames."""
    return changes.select(F.explode(F.array_compact(F.array("path", "old_path"))).alias("path")).distinct()


def affected_names(changes: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Names (name) to relink: a deletion's old ones, a rename's old and new ones, else those on one side only."""
    old = before.withColumnRenamed("file_path", "path").filter("name != ''").distinct()
    new = after.withColumnRenamed("file_path", "path").filter("name != ''").distinct()
    gone = changes.filter("status = 'deleted'").join(old, "path").select("name")
    left = changes.filter("status = 'renamed'").join(old, F.col("old_path") == old["path"]).select("name")
    came = changes.filter("status = 'renamed'").join(new, "path").select("name")
    edited = changes.filter("status in ('added', 'modified')").select("path").distinct()
    x, y = old.join(edited, "path", "left_semi"), new.join(edited, "path", "left_semi")
    delta = x.subtract(y).unionByName(y.subtract(x)).select("name")
    return gone.unionByName(left).unionByName(came).unionByName(delta).distinct()


def referencers(mentions: DataFrame, names: DataFrame, processed: DataFrame) -> DataFrame:
    """Files (file_path) whose tokens (file_path, token) hold an affected name, without those processed already."""
    return mentions.join(names.select(F.col("name").alias("token")), "token", "left_semi").select("file_path").distinct().join(processed, "file_path", "left_anti")


def mentions(sources: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(file_path, token, kept columns) of the identifiers in whole source files (file_path, content), wherever they stand."""
    words = F.regexp_extract_all(F.col("content"), F.lit(r"[\p{L}_$][\p{L}\p{M}\p{N}_$]*"), F.lit(0))
    return sources.select("file_path", *keep, F.explode(F.array_distinct(words)).alias("token"))


def latest(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """The last row of each key: upserts where later rows win."""
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*[o.desc() for o in order]))
    return rows.withColumn("__place", place).filter("__place = 1").drop("__place")


def upsert(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """table with rows in place of those of equal key."""
    return table.join(rows.select(*key), key, "left_anti").unionByName(rows, allowMissingColumns=True)


def patch(table: DataFrame, values: DataFrame, key: list[str]) -> DataFrame:
    """table with the columns of values, where those are not null, merged in."""
    new = [c for c in values.columns if c not in key]
    met = table.join(values.select(*key, *[F.col(c).alias(f"__{c}") for c in new]), key, "left")
    return met.select(*[F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) if c in new else F.col(c) for c in table.columns], *[F.col(f"__{c}").alias(c) for c in new if c not in table.columns])
