"""Tables of a bounded size, summed over all tasks and sent to every worker: counts, and filters of hashes.

A filter's size follows its number of hashes up to FILTER_BITS. Past that it lets more through, nothing
less: what it passes is joined exactly afterwards.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame

from tessera.llm.texthash import mix

PARTS = 64
#: The most bits of a filter, as a power of 2: 32 MB.
FILTER_BITS = 28
SCHEMA = "part int, counts binary"


def packed(table: np.ndarray) -> Iterator[tuple[int, bytes]]:
    for part, some in enumerate(np.split(table, PARTS)):
        yield part, zstandard.compress(some.tobytes(), 1)


def unpacked(shared: Broadcast, kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(zstandard.decompress(x), kind) for x in shared.value])


def gathered(parts: DataFrame, combine: Callable[[pd.DataFrame], pd.DataFrame], empty: int) -> Broadcast:
    """Rows (part, counts) combined by part and broadcast; empty: bytes of the table where there are no rows."""
    rows = parts.groupBy("part").applyInPandas(combine, SCHEMA).collect()
    ordered = [bytes(r["counts"]) for r in sorted(rows, key=lambda r: r["part"])] or [zstandard.compress(bytes(empty))]
    return parts.sparkSession.sparkContext.broadcast(ordered)


def add_counts(rows: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(zstandard.decompress(x), np.uint32).astype(np.uint64) for x in rows["counts"])
    return pd.DataFrame({"part": [rows["part"].iloc[0]], "counts": [zstandard.compress(np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes(), 1)]})


def _bits_of(hashes: np.ndarray, size: int) -> np.ndarray:
    """Each hash's two bits in a filter of so many bytes."""
    x, down = hashes.view(np.uint64), np.uint64(64 - (size * 8).bit_length() + 1)
    return np.stack([mix(x + np.uint64(i)) >> down for i in (1, 2)]).astype(np.int64)


def _mark(size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = np.zeros(size, np.uint8)
        for batch in batches:
            at = np.unique(_bits_of(batch["hash"].to_numpy(np.int64), size))
            heads = np.flatnonzero(np.diff(at >> 3, prepend=-1))
            if len(heads):
                table[at[heads] >> 3] |= np.bitwise_or.reduceat((1 << (at & 7)).astype(np.uint8), heads)
        yield pd.DataFrame(list(packed(table)), columns=["part", "counts"])

    return run


def _either(rows: pd.DataFrame) -> pd.DataFrame:
    joined = np.bitwise_or.reduce([np.frombuffer(zstandard.decompress(x), np.uint8) for x in rows["counts"]])
    return pd.DataFrame({"part": [rows["part"].iloc[0]], "counts": [zstandard.compress(joined.tobytes(), 1)]})


def hash_filter(hashes: DataFrame) -> Broadcast:
    """A filter of the 64-bit hashes in the one column of a table: some 16 bits for each, 2^FILTER_BITS at most."""
    hashes = hashes.toDF("hash").dropna()
    size = 1 << min(FILTER_BITS, max(16, (16 * hashes.count()).bit_length())) >> 3
    return gathered(hashes.mapInPandas(_mark(size), SCHEMA), _either, size)


def filter_bits(shared: Broadcast) -> np.ndarray:
    return unpacked(shared, np.uint8)


def passing(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes a filter may hold."""
    at = _bits_of(hashes, len(bits))
    return ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(0)
