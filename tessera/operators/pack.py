"""Packing of hits, and ownership by the deepest containing folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.schema import HIT_FIELDS


def packed(hits: DataFrame) -> DataFrame:
    """Each hit as JSON of the known fields, without those that are null, and its graph_context where there is one."""
    names = [c for c in (*HIT_FIELDS, "graph_context") if c in hits.columns]
    return hits.withColumn("json", F.to_json(F.struct(*names)))


def envelope(packed_hits: DataFrame, query: str | None, order: list) -> DataFrame:
    """One row (response): {"query": ..., "results": [...]} of a search's packed hits, a few rows, in the given order."""
    place = F.row_number().over(Window.orderBy(*order))
    rows = packed_hits.select(place.alias("place"), "json").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "json"))), lambda x: x["json"]), ",").alias("all"))
    return rows.select(F.concat(F.lit('{"query":'), F.coalesce(F.substring(F.to_json(F.array(F.lit(query))), F.lit(2), F.length(F.to_json(F.array(F.lit(query)))) - 2), F.lit("null")), F.lit(',"results":['), "all", F.lit("]}")).alias("response"))


def deepest_owner(files: DataFrame, owners: DataFrame, path: str, folder: str) -> DataFrame:
    """files with the deepest of the owners' folders that contains each; of equal ones the last by name; none: null.

    Every ancestor folder of a file is a key, so containment is an equi-join and not a comparison of all pairs.
    """
    parts = F.split(F.col(path), "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    keyed = files.select(path).distinct().select(path, F.explode(above).alias("__up"))
    found = keyed.join(owners.select(F.regexp_replace(F.col(folder), "/+$", "").alias("__up"), F.col(folder).alias("owner")), "__up")
    best = found.groupBy(path).agg(F.max_by("owner", F.struct(F.length("__up"), "owner")).alias("owner"))
    return files.join(best, path, "left")
