"""SimHash near copies: fingerprints of word shingles, linked at small Hamming distances by BK-trees.

1. A text's fingerprint has the bits that over half of its shingles' hashes have. Equal fingerprints are one
   node from here on, so that copies cost nothing more.
2. A BK-tree keys a node's children by their Hamming distance to it. The top of one tree, a few levels
   grown from a bounded sample, is sent to all tasks. It deals every fingerprint to the subtree that it
   belongs to, and as a question to the subtrees behind edges within the radius of its own distance.
3. Subtrees are kept as shards of at most SHARD fingerprints. A shard's members and the questions that may
   meet them come together; of a shard with many questions each of several tasks gets the whole shard and
   a part of the questions. There the rest of the tree is grown and searched, all questions level by level.
   Fingerprints with an even and with an odd number of set bits have trees of their own: distances within
   one are even, so a search has half of the edges to follow.
4. A task reports what hangs together, not all pairs: one link for each fingerprint that has any.
5. Links become components by label propagation.

A pair is asked for once, from the side whose own subtree comes first; questions of one subtree meet each
other in it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded_sample, discard, spread_join, stored
from tessera.llm.jaccard import components

RADIUS = 2
#: Fingerprints from which the top of the tree is grown, and the fingerprints of a shard and questions of a task at most.
SAMPLE, SHARD, ASKED = 4096, 32_768, 131_072
BITS = 64
_PIECE = 1 << 20
_GAP = re.compile(rb"[ \t\n\x0b\x0c\r]")
_FRONTIER = 1 << 21


def _pieces(text: str) -> Iterator[bytes]:
    """A text's bytes, A-Z lower-cased, cut in white space."""
    data = text.encode("utf-8", "surrogatepass").lower()  # bytes: A-Z alone
    at = 0
    while len(data) - at > _PIECE:
        gap = _GAP.search(data, at + _PIECE)
        cut = gap.start() if gap else len(data)
        yield data[at:cut]
        at = cut
    yield data[at:]


def fingerprint(text: str | None, k: int = 3, seed: int = 42) -> int:
    """The unsigned fingerprint; zero without words."""
    ones, total, carried = np.zeros(BITS, np.int64), 0, []
    short = True
    for piece in _pieces(text or ""):
        words = carried + piece.split()  # bytes: at the six ASCII white-space characters
        if len(words) < k:
            carried = words
            continue
        joined, short = b" ".join(words), False
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        spans = zip([0, *ends[: len(words) - k].tolist()], (ends[k - 1 :] - 1).tolist(), strict=True)
        hashes = np.array([xxhash.xxh64_intdigest(joined[a:b], seed) for a, b in spans], np.uint64)
        ones += _ones(hashes)
        total += len(hashes)
        carried = words[len(words) - k + 1 :]
    if short and carried:
        return xxhash.xxh64_intdigest(b" ".join(carried), seed)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


def _ones(hashes: np.ndarray) -> np.ndarray:
    """For each bit how many of the hashes have it: blocks of 255 are summed in bytes."""
    found = np.zeros(BITS, np.int64)
    bits = np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, BITS)
    for at in range(0, len(bits), 255 * 64):
        found += np.add.reduce(bits[at : at + 255 * 64], axis=0, dtype=np.int32)
    return found


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3) -> DataFrame:
    """(id, fp): the fingerprint of each row as a signed long."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "fp": np.array([fingerprint(t, k) for t in batch["text"]], np.uint64).view(np.int64)})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"id {kind}, fp long")


class BkTree:
    """A BK-tree, grown level by level, over fingerprints (unsigned) whose numbers of set bits are all even or all odd.

    Their distances are even, and so are the edges. value: each node's fingerprint, parents before children. edge[node, d]: the child at distance d, or -1.
    With `levels` growing stops there, and edge holds -2 - n wherever subtree n would go on.
    """

    def __init__(self, values: np.ndarray, levels: int | None = None):
        nodes, edges = [], []
        members = np.unique(values)
        cell, count, depth = np.zeros(len(members), np.int64), 0, 0
        while len(members) and (levels is None or depth < levels):
            heads = np.flatnonzero(np.diff(cell, prepend=-1))
            own = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(cell))))
            nodes.append(members[heads])
            edge = np.full((len(heads), BITS + 1), -1, np.int32)
            rest = np.ones(len(members), bool)
            rest[heads] = False
            at = np.bitwise_count(members[rest] ^ members[heads][own[rest]])
            key = own[rest] * (BITS + 1) + at
            order = np.argsort(key, kind="stable")
            found, cell = np.unique(key[order], return_inverse=True)
            count += len(heads)
            edge.ravel()[found] = count + np.arange(len(found))
            edges.append(edge)
            members, depth = members[rest][order], depth + 1
        self.value = np.concatenate(nodes) if nodes else np.empty(0, np.uint64)
        self.edge = np.concatenate(edges) if edges else np.empty((0, BITS + 1), np.int32)
        if levels is not None:  # every edge without a node is a subtree, whether the sample has members for it or not
            ends = ((self.edge < 0) | (self.edge >= len(self.value))) & (np.arange(BITS + 1) % 2 == 0)
            self.n_subtrees = int(ends.sum())
            self.edge[ends] = -2 - np.arange(self.n_subtrees, dtype=np.int32)

    def _descend(self, asked: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(question, node, their distance, what its edges within the radius lead to) of every node that a search meets."""
        waiting = [(np.arange(len(asked)), np.zeros(len(asked), np.int64))] if len(self.value) and len(asked) else []
        while waiting:
            q, node = waiting.pop()
            if len(q) > _FRONTIER:
                waiting += [(q[: len(q) // 2], node[: len(q) // 2]), (q[len(q) // 2 :], node[len(q) // 2 :])]
                continue
            d = np.bitwise_count(asked[q] ^ self.value[node]).astype(np.int64)
            qs, to = [], []
            for off in range(-radius, radius + 1):
                ok = (d + off >= 0) & (d + off <= BITS) & ((d + off) % 2 == 0)
                qs.append(q[ok])
                to.append(self.edge[node[ok], d[ok] + off])
            qs, to = np.concatenate(qs), np.concatenate(to).astype(np.int64)
            yield (q, node, d), qs[to < -1], -2 - to[to < -1]
            if (to >= 0).any():
                waiting.append((qs[to >= 0], to[to >= 0]))

    def search(self, asked: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Index arrays of questions and of nodes within the radius, some at a time."""
        for (q, node, d), _, _ in self._descend(asked, radius):
            near = d <= radius
            if near.any():
                yield q[near], node[near]

    def subtrees(self, values: np.ndarray, radius: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Of a tree that stops: index arrays of values and of the subtrees they may be in, given the radius. A node of the top counts as the subtree behind its edge 0."""
        qs, to = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for _, q, leaf in self._descend(values, radius):
            qs.append(q)
            to.append(leaf)
        return np.concatenate(qs), np.concatenate(to)


def _hang_together(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merges labels (each at most its own index) along links a-b."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(label[label], label):
            label[:] = label[label]


def _odd(values: np.ndarray) -> np.ndarray:
    return np.bitwise_count(values) % 2 == 1


def _subtrees(tops: tuple[BkTree, BkTree], values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index arrays of values and of the subtrees, of both trees, that may hold what is within the radius."""
    (q0, to0), (q1, to1) = (t.subtrees(values, radius) for t in tops)
    return np.concatenate([q0, q1]), np.concatenate([to0, to1 + tops[0].n_subtrees])


def _dealt(shared, radius: int):
    """Each fingerprint as a member of its own subtree, and as a question to later ones within the radius."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tops = shared.value
        for batch in batches:
            values = batch["fp"].to_numpy(np.int64).view(np.uint64)
            home = np.empty(len(values), np.int64)
            for is_odd in (False, True):
                own = np.flatnonzero(_odd(values) == is_odd)
                q, at = tops[is_odd].subtrees(values[own])
                home[own[q]] = at + is_odd * tops[0].n_subtrees
            q, to = _subtrees(tops, values, radius)
            later = to > home[q]
            q, to = np.concatenate([np.arange(len(values)), q[later]]), np.concatenate([home, to[later]])
            yield pd.DataFrame({"subtree": to, "fp": values[q].view(np.int64), "member": np.arange(len(q)) < len(values)})

    return run


def _shard_links(radius: int):
    """A shard: its tree searched for its own members and for the questions, and a link for each that hangs together with another."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        values, member = rows["fp"].to_numpy(np.int64).view(np.uint64), rows["member"].to_numpy(bool)
        tree = BkTree(values[member])
        every = np.unique(values)
        label, place = np.arange(len(every)), np.searchsorted(every, tree.value)
        asked = np.unique(values[rows["asks"].to_numpy(bool)])
        at = np.searchsorted(every, asked)
        for q, node in tree.search(asked, radius):
            _hang_together(label, at[q], place[node])
        linked = label != np.arange(len(every))
        return pd.DataFrame({"a": every[label[linked]].view(np.int64), "b": every[linked].view(np.int64)})

    return run


def links(found: DataFrame, radius: int = RADIUS, sample: int = SAMPLE, shard: int = SHARD, asked: int = ASKED) -> DataFrame:
    """(a, b) of different fingerprints (fp), stored: links whose components are those of all pairs within the radius.

    The sample decides where the top of the tree parts, so the cost and never the result. Its levels grow
    with the logarithm of the number of fingerprints.
    """
    spark, n = found.sparkSession, found.count()
    levels = 1
    while n > 64 * shard * 8 ** (levels - 1):
        levels += 1
    grown = bounded_sample(found, F.xxhash64("fp"), sample, n).collect()
    values = np.array([r["fp"] for r in grown], np.int64).view(np.uint64)
    # a sample without even or odd ones leaves their tree with a root that is no fingerprint
    even, odd = (BkTree(values[_odd(values) == is_odd] if (_odd(values) == is_odd).any() else np.array([is_odd], np.uint64), levels + 1) for is_odd in (False, True))
    rows = stored(found.mapInPandas(_dealt(spark.sparkContext.broadcast((even, odd)), radius), "subtree int, fp long, member boolean"), "questions")
    sizes = rows.groupBy("subtree").agg(F.sum(F.col("member").cast("long")).alias("members"), F.count("*").alias("questions"))
    # one row for each subtree below the top, whose nodes are a sample of a fixed size
    parts = sizes.select("subtree", F.ceil(F.col("members") / shard).cast("int").alias("shards"), F.ceil(F.col("questions") / asked).cast("int").alias("tasks")).filter("shards > 0")
    placed = rows.join(F.broadcast(parts), "subtree")
    shards, tasks = F.sequence(F.lit(0), F.col("shards") - 1), F.sequence(F.lit(0), F.col("tasks") - 1)
    own_shard, own_task = F.pmod(F.xxhash64("fp"), F.col("shards")).cast("int"), F.pmod(F.xxhash64("fp", F.lit(1)), F.col("tasks")).cast("int")
    everywhere = placed.select("subtree", "fp", "member", own_shard.alias("home"), own_task.alias("turn"), F.explode(shards).alias("shard"), "tasks")
    to_tasks = F.when(F.col("member") & (F.col("home") == F.col("shard")), F.sequence(F.lit(0), F.col("tasks") - 1)).otherwise(F.array("turn"))
    dealt = everywhere.select("subtree", "shard", "fp", "turn", (F.col("member") & (F.col("home") == F.col("shard"))).alias("member"), F.explode(to_tasks).alias("task"))
    cells = dealt.select("subtree", "shard", "task", "fp", "member", (F.col("turn") == F.col("task")).alias("asks"))
    made = stored(cells.groupBy("subtree", "shard", "task").applyInPandas(_shard_links(radius), "a long, b long"), "links")
    discard(rows)
    return made


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, k: int = 3) -> DataFrame:
    """Per row of docs: id, fingerprint (16 hex digits) and component_id, the smallest id reachable by links.

    Fingerprints link at `radius` differing bits or less. Texts without words (null, empty or blank) have
    fingerprint zero and link like any other. Rows with a null id take part; a component's id is its least id
    that is not null. Repeated rows stay.
    """
    rows = stored(fingerprints(docs, id_col, text_col, k), "fingerprints")
    found = stored(rows.select("fp").distinct(), "different")
    linked = links(found, radius)
    labels = components(linked)
    placed = stored(spread_join(rows.withColumnRenamed("fp", "node"), labels, "node", "left").select("id", "node", F.coalesce("label", "node").alias("label")), "placed")
    discard(rows, found, linked)
    least = placed.groupBy("label").agg(F.min("id").alias("least"))
    return spread_join(placed, least, "label", "left").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("node"), 16, "0")).alias("fingerprint"), F.coalesce("least", "id").alias("component_id"))
