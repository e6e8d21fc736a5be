"""Nearest neighbours by cosine from an inverted file.

Centroids are fitted on a bounded sample, every vector lies in the folder of its nearest centroid, and a
search reads the folders of the centroids next to its vector and takes exact cosines there. How many lists
a search reads is measured when the index is written: the sample's own neighbours are found by brute force,
and as many lists are probed as hold the wanted share of them. A sample is thinner than all rows, its
neighbours lie further apart, so the figure is on the safe side. On vectors without clusters it is most of
the lists.

Vectors that are null, or zero, lie in list -1: they have no neighbours and are nobody's. A list may be empty.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.functions.vectors import cosine
from tessera.workspace import read_text, write_text

#: Vectors that centroids are fitted on, rows and questions of a block, and how many of them one multiplication takes.
SAMPLE, BLOCK, SLICE = 20_000, 8192, 512
MOST_LISTS = 4096
ROUNDS = 10


def _units(vectors) -> np.ndarray:
    rows = np.array([np.asarray(v, np.float64) for v in vectors]).reshape(len(vectors), -1)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def fit(units: np.ndarray, lists: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of length one by Lloyd's rounds; those that no vector is next to are left out."""
    centroids = units[np.linspace(0, len(units) - 1, lists).astype(np.int64)]
    for _ in range(rounds):
        own = (units @ centroids.T).argmax(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, units)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = (sums / np.where(size == 0, 1, size))[size[:, 0] > 0]
    return centroids


def needed_probes(units: np.ndarray, centroids: np.ndarray, recall: float, k: int, queries: int = 500) -> int:
    """The lists that hold `recall` of the k nearest of some of the vectors among all of them."""
    asked = units[np.linspace(0, len(units) - 1, min(queries, len(units))).astype(np.int64)]
    near = np.argpartition(-(asked @ units.T), min(k, len(units) - 1), axis=1)[:, : k + 1]
    own = (units @ centroids.T).argmax(1)
    place = np.argsort(np.argsort(-(asked @ centroids.T), axis=1), axis=1)  # of each list in a query's order
    at = np.sort(np.take_along_axis(place, own[near], 1).ravel())
    return int(at[min(len(at) - 1, int(np.ceil(recall * len(at))))]) + 1


def _parts(batch: pd.DataFrame, size: int = SLICE) -> Iterator[pd.DataFrame]:
    """A batch by `size` rows, so that what is computed for each row and list stays small."""
    return (batch.iloc[i : i + size] for i in range(0, len(batch), size))


def _assigned(centroids: np.ndarray, key: str, vector: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in _parts(batch):
                yield pd.DataFrame({key: part[key], vector: part[vector], "list_no": (_units(part[vector]) @ centroids.T).argmax(1)})

    return run


def _length(vector: str):
    return F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))


def write_index(points: DataFrame, path: str, key: str, vector: str, lists: int | None = None, sample: int = SAMPLE, recall: float = 0.95, k: int = 20) -> None:
    """Every row's key and vector in the folder of its list; centroids and the measured probes beside them. lists: the root of the number of vectors, MOST_LISTS at most, if not given."""
    rows = points.select(key, vector)
    able = rows.filter(_length(vector) > 0)
    n = able.count()
    some = able.orderBy(F.xxhash64(key), key).limit(sample).collect()  # a bounded sample
    units = _units([r[vector] for r in some]) if some else np.zeros((0, 1))
    centroids = fit(units, min(MOST_LISTS, len(units), lists or max(1, int(n**0.5)))) if len(units) else np.zeros((0, 1))
    probes = needed_probes(units, centroids, recall, k) if len(units) else 0
    placed = able.mapInPandas(_assigned(centroids, key, vector), f"{key} {points.schema[key].dataType.simpleString()}, {vector} {points.schema[vector].dataType.simpleString()}, list_no int")
    rest = rows.filter(F.coalesce(_length(vector), F.lit(0.0)) <= 0).withColumn("list_no", F.lit(-1))
    placed.unionByName(rest).hint("rebalance", "list_no").write.partitionBy("list_no").parquet(f"{path}/vectors")
    write_text(points.sparkSession, f"{path}/about.json", json.dumps({"centroids": centroids.tolist(), "probes": probes, "key": key, "vector": vector, "schema": placed.schema.jsonValue()}))


def _about(spark: SparkSession, path: str) -> tuple[dict, np.ndarray, DataFrame]:
    about = json.loads(read_text(spark, f"{path}/about.json"))
    return about, np.array(about["centroids"]), spark.read.schema(StructType.fromJson(about["schema"])).parquet(f"{path}/vectors")


def _near_lists(units: np.ndarray, centroids: np.ndarray, probes: int) -> np.ndarray:
    return np.argsort(-(units @ centroids.T), axis=1, kind="stable")[:, :probes]


def nearest_to(spark: SparkSession, path: str, vector: list[float], k: int, probes: int | None = -1, among: DataFrame | None = None) -> DataFrame:
    """(key, score) of the k nearest to one vector. probes: -1 as measured, None for all lists, which is exact. among: the keys that count, all if not given."""
    about, centroids, rows = _about(spark, path)
    if not len(centroids) or not np.any(vector):
        return rows.select(about["key"], F.lit(0.0).alias("score")).limit(0)
    wanted = len(centroids) if probes is None else about["probes"] if probes < 0 else probes
    at = [int(x) for x in _near_lists(_units([vector]), centroids, wanted)[0]]
    asked = F.array(*map(F.lit, map(float, vector)))
    held = rows.filter(F.col("list_no").isin(*at))
    held = held if among is None else held.join(among.select(about["key"]), about["key"], "left_semi")
    found = held.select(about["key"], cosine(F.col(about["vector"]), asked).alias("score"))
    return found.orderBy(F.col("score").desc(), about["key"]).limit(k)


def _asking(centroids: np.ndarray, probes: int):
    """Beside each question the numbers of its lists; they become rows outside Python."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in _parts(batch):
                yield pd.DataFrame({"query": part["query"], "vector": part["vector"], "lists": list(_near_lists(_units(part["vector"]), centroids, probes).astype(np.int32))})

    return run


def _best_of_blocks(k: int, key: str):
    """Of a block of rows and a block of questions, k rows for each question."""

    def run(held: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(held) or not len(asked):
            return pd.DataFrame({"query": asked["query"][:0], key: held[key][:0], "score": np.zeros(0)})
        held = held.sort_values(key, kind="stable")
        units, keys, out = _units(held["vector"]).T, held[key].to_numpy(), []
        for part in _parts(asked, SLICE):
            score = np.round(_units(part["vector"]) @ units, 6)
            least = -np.partition(-score, min(k, len(keys)) - 1, axis=1)[:, min(k, len(keys)) - 1]
            at, row = np.nonzero(score >= least[:, None])  # ties of the last place too
            order = np.lexsort((row, -score[at, row], at))
            at, row = at[order], row[order]
            first = np.arange(len(at)) - np.searchsorted(at, at) < k
            out.append(pd.DataFrame({"query": part["query"].to_numpy()[at[first]], key: keys[row[first]], "score": score[at[first], row[first]]}))
        return pd.concat(out)

    return run


def nearest(spark: SparkSession, path: str, queries: DataFrame, k: int, probes: int | None = -1, block: int = BLOCK, among: DataFrame | None = None) -> DataFrame:
    """(query, key, score, rank) of the k nearest to each of many queries (query, vector), themselves among them if they are rows.

    A list's rows and its questions are dealt to blocks of a bounded size, which meet in pairs. A pair is a
    group of its own: one matrix product serves it, no list is one task's, and a task's Python holds one
    pair at a time, whatever the table's size. A search of all lists takes them as one. among: as in nearest_to.
    """
    about, centroids, rows = _about(spark, path)
    key, vector = about["key"], about["vector"]
    rows = rows.filter("list_no >= 0")
    rows = rows if among is None else rows.join(among.select(key), key, "left_semi")
    kinds = {"query": queries.schema["query"].dataType.simpleString(), "vector": queries.schema["vector"].dataType.simpleString()}
    wanted = len(centroids) if probes is None else about["probes"] if probes < 0 else probes
    able = queries.filter(_length("vector") > 0)
    if wanted >= len(centroids):
        rows, asked = rows.withColumn("list_no", F.lit(0)), able.select("query", "vector", F.lit(0).alias("list_no"))
    else:
        near = able.mapInPandas(_asking(centroids, max(1, wanted)), f"query {kinds['query']}, vector {kinds['vector']}, lists array<int>")
        asked = near.select("query", "vector", F.explode("lists").alias("list_no"))
    counted = lambda df, name: df.groupBy("list_no").agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    sizes = F.broadcast(counted(rows, "blocks").join(counted(asked, "turns"), "list_no"))  # a row for each list
    of = lambda by, n: F.pmod(F.xxhash64(by), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    held = rows.select(F.col(key), F.col(vector).alias("vector"), "list_no").join(sizes, "list_no").withColumn("block", of(key, "blocks")).withColumn("turn", each("turns")).drop("blocks", "turns")
    asks = asked.join(sizes, "list_no").withColumn("turn", of("query", "turns")).withColumn("block", each("blocks")).drop("blocks", "turns")
    pair = ["list_no", "block", "turn"]
    found = held.groupBy(*pair).cogroup(asks.groupBy(*pair)).applyInPandas(_best_of_blocks(k, key), f"query {kinds['query']}, {key} {dict(rows.dtypes)[key]}, score double")
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), key)
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
