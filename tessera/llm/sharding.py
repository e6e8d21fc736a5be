"""Sharding by jump consistent hashing, in column expressions only.

A key walks through shard counts: a 64-bit linear congruential generator seeded with the key gives
the next count at which the key would move. The last stop below n is its shard, so from n to n + 1
shards a key either stays or moves to the new shard; there is no ring table to store or to look up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import free_name

# The generator's multiplier, as 32-bit halves.
MULTIPLIER = 2862933555777941757
_HIGH, _LOW = MULTIPLIER >> 32, MULTIPLIER & 0xFFFFFFFF
_M32 = 0xFFFFFFFF
#: Jumps tried for every row; the few keys that need more go on in a second, conditional loop.
FIRST_JUMPS = 48


def _long(value: int) -> Column:
    return F.lit(value).cast("long")


def _next(hi: Column, lo: Column) -> tuple[Column, Column]:
    """key * MULTIPLIER + 1 mod 2**64 on 32-bit halves; no product leaves 63 bits, so ANSI mode is fine."""
    c1, c0 = _long(_LOW >> 16), _long(_LOW & 0xFFFF)
    m16 = _long(0xFFFF)
    low = lo * c0 + F.shiftleft((lo * c1).bitwiseAND(m16), 16) + _long(1)
    high = hi * c0 + F.shiftleft((hi * c1).bitwiseAND(m16), 16)
    high = high.bitwiseAND(_long(_M32)) + (lo * _long(_HIGH)).bitwiseAND(_long(_M32))
    high = high + F.shiftright(lo * c1, 16) + F.shiftright(low, 32)
    return high.bitwiseAND(_long(_M32)), low.bitwiseAND(_long(_M32))


def _jump(state: Column, limit: int) -> Column:
    hi, lo = _next(state["hi"], state["lo"])
    stop = F.floor((state["j"] + 1) * (F.lit(2147483648.0) / (F.shiftright(hi, 1) + 1))).cast("long")
    moved = F.struct(hi.alias("hi"), lo.alias("lo"), state["j"].alias("at"), state["at"].alias("before"), stop.alias("j"))
    return F.when(state["j"] >= limit, state).otherwise(moved)


def jump_walk(key: Column, n_shards: int) -> Column:
    """Struct whose `at` is the shard among n_shards + 1, and `before` the stop ahead of it."""
    limit = n_shards + 1
    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("hi"), key.bitwiseAND(_long(_M32)).alias("lo"),
        _long(-1).alias("at"), _long(-1).alias("before"), _long(0).alias("j"),
    )
    first = min(limit, FIRST_JUMPS)
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(first)), start, lambda s, _: _jump(s, limit))
    if limit > first:
        more = lambda s: F.aggregate(F.sequence(F.lit(1), F.lit(limit - first)), s, lambda t, _: _jump(t, limit))
        walk = F.transform(F.array(walk), lambda s: F.when(s["j"] >= limit, s).otherwise(more(s)))[0]
    return walk


def stable_key(df: DataFrame, key: str) -> Column:
    """Integers as they are, other types by their 64-bit hash; null is key 0."""
    integer = isinstance(df.schema[key].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    return F.coalesce(F.col(key).cast("long") if integer else F.when(F.col(key).isNotNull(), F.xxhash64(key)), _long(0))


def assign_shards(df: DataFrame, key: str, n_shards: int, tie_break: list[str] = (), buckets: int = 1021) -> DataFrame:
    """df with shard, grown_shard (with one shard more) and slot (gapless from 0 in its shard).

    Slots follow (key mod buckets, key, tie_break). They are ranked in two levels: rows within
    (shard, bucket), and the counts of the buckets before it, so that no shard is ever one task.
    Null keys count as 0, equal keys share a shard, repeated rows get slots of their own, an empty
    table stays empty; columns of df named shard, grown_shard or slot are replaced.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    plain = df.drop("shard", "grown_shard", "slot")
    own_key, own_walk, bucket, count, start, rank = (free_name(plain, c) for c in ("__key", "__walk", "__bucket", "__n", "__start", "__rank"))
    walk = F.transform(F.array(jump_walk(F.col(own_key), n_shards)), lambda s: F.struct(
        F.when(s["at"] < n_shards, s["at"]).otherwise(s["before"]).cast("int").alias("shard"),
        s["at"].cast("int").alias("grown_shard")))[0]
    placed = (
        plain.withColumn(own_key, stable_key(plain, key)).withColumn(own_walk, walk)
        .withColumns({"shard": F.col(f"{own_walk}.shard"), "grown_shard": F.col(f"{own_walk}.grown_shard"), bucket: F.pmod(own_key, F.lit(buckets))})
        .drop(own_walk)
    )
    ahead = Window.partitionBy("shard").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("shard", bucket).agg(F.count("*").alias(count))
        .select("shard", bucket, F.coalesce(F.sum(count).over(ahead), _long(0)).alias(start))
    )
    within = Window.partitionBy("shard", bucket).orderBy(own_key, *tie_break)
    ranked = placed.withColumn(rank, F.row_number().over(within) - 1)
    return (
        ranked.join(starts, ["shard", bucket])
        .select(*(F.col(c) for c in plain.columns), "shard", "grown_shard", (F.col(start) + F.col(rank)).alias("slot"))
    )
