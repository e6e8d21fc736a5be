"""Payload filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import all_of
from tessera.schema import EMBEDDABLE, SKIPPED_FOLDERS, SOURCE_SUFFIXES


def matching(df: DataFrame, wanted: dict | None) -> DataFrame:
    """Rows that meet all entries: a scalar by equality, a list, tuple or set by membership; None is no condition."""
    tests = [F.col(k).isin(*v) if isinstance(v, list | tuple | set) else F.col(k) == v for k, v in (wanted or {}).items() if v is not None]
    return df.filter(all_of(tests)) if tests else df


def embeddable(entities: DataFrame) -> DataFrame:
    return entities.filter(F.col("symbol_type").isin(*EMBEDDABLE) & (F.length("content") > 0))


def indexed_source(path):
    return path.rlike(r"\.(" + "|".join(SOURCE_SUFFIXES) + ")$")


def outside_skipped(path):
    return all_of([~path.contains(s) for s in SKIPPED_FOLDERS])


def internal_call(is_metadata, namespace, prefixes: list[str]):
    """False for calls into metadata outside the internal namespaces."""
    inside = F.lit(False)
    for p in prefixes:
        inside = inside | namespace.startswith(p)
    return ~is_metadata | inside
