"""Reciprocal rank fusion of ranked lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.schema import RRF_K


def rrf_merge(lists: DataFrame, key: str, rrf_k: int = RRF_K, rank_base: int = 1) -> DataFrame:
    """One row per key of lists (key, list_no, rank, payload...): score, and the payload of its first list and rank.

    A key that occurs twice in a list counts twice. Rows without a key are dropped here, after ranking,
    so they have used up their rank.
    """
    payload = [c for c in lists.columns if c not in (key, "list_no", "rank")]
    first = F.min_by(F.struct("list_no", "rank", *payload), F.struct("list_no", "rank")).alias("first")
    merged = lists.filter(F.col(key).isNotNull()).groupBy(key).agg(F.round(F.sum(1 / (F.lit(rrf_k) + F.col("rank") - 1 + rank_base)), 9).alias("score"), first)
    return merged.select(key, "score", "first.*")


def matched_via(collection, existing=None):
    found = F.when(collection.endswith("_desc"), "description").when(collection.startswith("code_"), "code").otherwise(collection)
    return found if existing is None else F.coalesce(existing, found)


def merge_collections(hits: DataFrame, order: list[str], rrf_k: int = RRF_K, depth: int | None = None) -> DataFrame:
    """Hits (collection, chunk_id, linked_chunk_id, score) of several collections as one list.

    A description stands for the code chunk it links to; without a link it is dropped before ranking and
    uses up no rank. depth: the ranks of a collection that count; each task then keeps no more before the
    lists meet.
    """
    described = F.col("collection").endswith("_desc")
    target = F.when(described, F.col("linked_chunk_id")).otherwise(F.col("chunk_id"))
    own = hits.withColumn("own_id", F.col("chunk_id")).withColumn("chunk_id", target).filter(~described | F.col("chunk_id").isNotNull())
    rank = F.row_number().over(Window.partitionBy("collection").orderBy(F.col("score").desc(), "own_id"))
    number = F.array_position(F.array(*map(F.lit, order)), F.col("collection"))
    ranked = own.withColumn("rank", rank)
    own = ranked if depth is None else ranked.filter(F.col("rank") <= depth)
    lists = own.select("chunk_id", number.alias("list_no"), "rank", F.col("collection").alias("matched_collection"), matched_via(F.col("collection")).alias("matched_via"))
    return rrf_merge(lists, "chunk_id", rrf_k)
