"""Packing of tokenised documents: shortest-pack-first over the histogram of piece lengths.

A document is cut into pieces of at most the sequence length. Only the histogram of piece lengths, a
row for each possible length, goes to the driver. There the lengths are placed longest first: all
pieces of a length join the open patterns with the most room left (the shortest packs), a pattern's
count splitting where it has more packs than pieces; where none has room, new packs are opened and
filled with as many pieces as they take. The patterns then say, for every length, which
ranks go where, and each piece finds its pack by its rank among the pieces of its length.
"""

from __future__ import annotations

import json
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm.common import stored

SEQUENCE = 1024
#: Pieces that one group of ranks holds on average, at most.
GROUP_ROWS = 50_000


@cache
def _encoders(path: str) -> tuple[Tokenizer, tiktoken.Encoding, list[str]]:
    """The tokenizer of a byte-level BPE file, the same vocabulary for tiktoken, and the texts of special tokens."""
    spec = json.loads(open(path, encoding="utf-8").read())
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte_of = {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(x for x in range(256) if x not in plain)}
    special = [t["content"] for t in spec["added_tokens"]]
    ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    fast = tiktoken.Encoding("same", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return Tokenizer.from_file(path), fast, special


def token_ids(text: str, path: str) -> bytes:
    """The tokenizer's ids of a text as little-endian 32-bit bytes.

    tiktoken merges by the same ranks several times faster; texts that hold a special token's text are
    left to the tokenizer itself.
    """
    slow, fast, special = _encoders(path)
    if any(s in text for s in special):
        return np.array(slow.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    return np.array(fast.encode_ordinary(text), "<u4").tobytes()


def _pieces(path: str, length: int, with_ids: bool):
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if with_ids else [])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held: list = []
            for i, text in zip(batch["id"], batch["text"], strict=True):
                data = (token_ids(text, path) if isinstance(text, str) else b"") + bytes(4)
                n = len(data) // 4
                for at in range(0, n, length):
                    piece = data[4 * at : 4 * (at + length)]
                    held.append((i, at, len(piece) // 4, zlib.crc32(piece), n, *([np.frombuffer(piece, "<u4").astype(np.int64)] if with_ids else [])))
                if len(held) >= 5000:
                    yield pd.DataFrame(held, columns=names)
                    held = []
            if held:
                yield pd.DataFrame(held, columns=names)

    return run


def patterns(histogram: dict[int, int], length: int = SEQUENCE) -> list[tuple[int, list[int]]]:
    """(how many packs, the lengths in each, longest first); every piece of the histogram is in one."""
    room: dict[int, list[tuple[int, list[int]]]] = defaultdict(list)
    for size in range(length, 0, -1):
        left = histogram.get(size, 0)
        space = length
        while left:
            while space >= size and not room[space]:
                space -= 1
            if space < size:  # no pack is open with this much room: new ones are filled one after the other
                each = length // size
                full, rest = divmod(left, each)
                if full:
                    room[length - size * each].append((full, [size] * each))
                if rest:
                    room[length - size * rest].append((1, [size] * rest))
                break
            packs, inside = room[space].pop()
            taken = min(packs, left)
            if packs > taken:
                room[space].append((packs - taken, inside))
            room[space - size].append((taken, [*inside, size]))
            left -= taken
    return [p for at in sorted(room) for p in room[at]]


def slots(found: list[tuple[int, list[int]]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, ranks, first sequence, offset): a piece of that length and rank is at that offset of its pack."""
    used: dict[int, int] = defaultdict(int)
    out, sequence = [], 0
    for packs, inside in found:
        offset = 0
        for size in inside:
            out.append((size, used[size], packs, sequence, offset))
            used[size] += packs
            offset += size
        sequence += packs
    return out


def pack(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", length: int = SEQUENCE, with_ids: bool = False) -> DataFrame:
    """A row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if wanted, ids.

    A document's ids are those of its text (null: none) and then id 0, so each has a piece. Pieces of one
    pack lie gapless from offset 0. Rows with null or equal ids are documents of their own.
    """
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<long>" * with_ids
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    pieces = stored(rows.mapInPandas(_pieces(path, length, with_ids), schema), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    parts = max(16, sum(histogram.values()) // GROUP_ROWS)
    table = slots(patterns(histogram, length))
    places = pieces.sparkSession.createDataFrame(table or [(0, 0, 0, 0, 0)], "length long, first long, ranks long, sequence long, offset long")

    parted = pieces.withColumn("part", F.pmod(F.xxhash64("id", "start", "ids_crc32"), F.lit(parts)))
    ahead = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parted.groupBy("length", "part").agg(F.count("*").alias("n")).select("length", "part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "part").orderBy("id", "start", "ids_crc32")
    ranked = parted.withColumn("rank", F.row_number().over(within) - 1).join(starts, ["length", "part"]).withColumn("rank", F.col("before") + F.col("rank"))
    # some thousand rows: the patterns of a histogram of `length` rows, whatever the corpus
    placed = ranked.join(F.broadcast(places), "length").filter("rank >= first AND rank < first + ranks")
    return placed.select(
        F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", (F.col("sequence") + F.col("rank") - F.col("first")).alias("sequence_id"), "offset", *(["ids"] if with_ids else []))
