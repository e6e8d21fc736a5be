"""N-gram Jaccard join: a blocked sparse product of document by shingle incidence, kept to what can reach the bound.

1. Every text becomes its set of 5-word shingle hashes; equal sets are one node from here on.
2. A fixed-size count sketch orders shingles, rarest first. Two sets of Jaccard t or more share a
   shingle among the first n - ceil(t n) + 1 of each, so only those cells of the incidence matrix
   enter the product. The order may be any: the sketch decides cost, never the result.
3. The cells are dealt to blocks of the shingle space. A block finds its columns with two nodes or more
   and accumulates overlap counts of every node with a few pivots of its columns, not of all pairs. A
   column that by the sketch has more than SPLIT cells is dealt to several blocks.
4. Each node's best partners are checked exactly on whole sets, and linked nodes are merged. Columns
   that still hold different components get another pivot and are checked again, as long as a quarter
   of what a round checks is linked. Then the pairs of different components that are left in a column are checked, in bands
   of size and in parts, under the size and place bounds; what lies in one component needs no further
   link. So no link between components is lost.

Keys that hold many rows (a hub's links, exact copies, a column of very many nodes) are dealt to several
tasks by spread_join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import dealt, discard, free_name, spread_join, stored
from tessera.llm.sketch import add_counts, filter_bits, gathered, hash_filter, packed, passing, unpacked
from tessera.llm.texthash import mix, shingle_sets

#: Counters of the order sketch, a fixed 16 MB, sent to every worker whatever the input's size.
SKETCH_BITS = 22
PIVOTS = 3
#: Cells of a column that one block takes, by the sketch.
SPLIT = 1 << 19
#: Rows of a column that one task compares with the others, once no pivot links them.
REST_ROWS = 1024


def _node(s: np.ndarray) -> np.ndarray:
    """A set's own hash, as an array of one."""
    return mix(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(s)))


def _profile(k: int):
    """Rows of documents (their set's size and node), then the partition's share of the sketch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sketch = np.zeros(1 << SKETCH_BITS, np.uint32)
        for batch in batches:
            sizes, nodes, held, waiting = [], [], [], 0
            for s in shingle_sets(batch["text"], k):
                sizes.append(len(s))
                nodes.append(_node(s)[0])
                held.append(s)
                waiting += len(s)
                if waiting > 1 << 20:
                    _count(sketch, held)
                    held, waiting = [], 0
            _count(sketch, held)
            yield pd.DataFrame({"id": batch["id"], "digest": batch["digest"], "n": sizes, "node": np.array(nodes, np.uint64).view(np.int64), "part": -1, "counts": None})
        for part, counts in packed(sketch):
            yield pd.DataFrame({"id": [None], "digest": [None], "n": [0], "node": [0], "part": [part], "counts": [counts]})

    return run


def _count(sketch: np.ndarray, sets: list[np.ndarray]) -> None:
    if sets:
        at, n = np.unique((np.concatenate(sets) & np.uint64(len(sketch) - 1)).astype(np.int64), return_counts=True)
        sketch[at] += n.astype(np.uint32)


def _prefixes(sketch, percent: int, k: int, block_bits: int):
    """Per batch and block the cells that the size bound leaves: shingle, node, its place in the node's order, the node's size.

    Blocks from 2^block_bits on are parts of columns that are split.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, seen = unpacked(sketch, np.uint32), set()
        for batch in batches:
            cells, nodes, places, sizes, often = [], [], [], [], []
            for s in shingle_sets(batch["text"], k):
                n = len(s)
                node = _node(s) if n else None
                if not n or node[0] in seen:
                    continue
                seen.add(node[0])
                length = n - (percent * n + 99) // 100 + 1
                times = counts[(s & np.uint64(len(counts) - 1)).astype(np.int64)]
                order = np.lexsort((s, times))[:length]
                cells.append(s[order])
                nodes.append(np.repeat(node, length))
                places.append(np.arange(length, dtype=np.uint32))
                sizes.append(np.full(length, n, np.uint32))
                often.append(times[order])
            if cells:
                cells, nodes, places, sizes, often = map(np.concatenate, (cells, nodes, places, sizes, often))
                block = (cells >> np.uint64(64 - block_bits)).astype(np.int64)
                parts = -(-often.astype(np.int64) // SPLIT)
                split = parts > 1
                block[split] = (1 << block_bits) + (mix(cells[split] + mix(nodes[split]) % parts[split].astype(np.uint64)) >> np.uint64(64 - block_bits)).astype(np.int64)
                order = np.lexsort((cells, block))
                cuts = np.flatnonzero(np.diff(block[order])) + 1
                rows = zip(*(np.split(x[order], cuts) for x in (block, cells, nodes, places, sizes)), strict=True)
                yield pd.DataFrame([(b[0], *(x.tobytes() for x in row)) for b, *row in rows], columns=["block", "cells", "nodes", "places", "sizes"])

    return run


def _partnered(cells: np.ndarray, sizes: np.ndarray, most: np.ndarray, percent: int) -> np.ndarray:
    """Which cells of sorted columns may have a partner there: another node whose size is within `most`, and one within whose `most` this size is."""
    if not len(cells):
        return np.zeros(0, bool)
    heads = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1])))
    lengths = np.diff(np.append(heads, len(cells)))
    column = np.repeat(np.arange(len(lengths)), lengths)
    two = lengths > 1
    second = np.minimum(heads + 1, len(cells) - 1)

    def least_other(values: np.ndarray) -> np.ndarray:
        order = np.lexsort((values, column))
        least = np.repeat(order[heads], lengths)
        return np.where(least == np.arange(len(cells)), np.repeat(values[order[second]], lengths), values[least])

    return np.repeat(two, lengths) & (percent * least_other(sizes) <= most) & (percent * sizes <= -least_other(-most))


def _product(percent: int, block_bits: int):
    """One block: its shared columns as (shingle, node, place, n), and overlap counts of nodes with their columns' pivots.

    What two nodes share from a common shingle on is at most what is left of either after its place; a
    linked pair passes that bound in the first column it shares. The first pivot of a column is the
    node that meets it earliest, for its size: the least changed of a group of near copies. A part of a
    split column keeps its cells without a partner, as that may be in another part.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        kinds = {"cells": np.uint64, "nodes": np.uint64, "places": np.uint32, "sizes": np.uint32}
        cells, nodes, places, sizes = (np.concatenate([np.frombuffer(x, t) for x in rows[c]]) for c, t in kinds.items())
        order = np.lexsort((nodes, cells))
        cells, nodes, places, sizes = cells[order], nodes[order], places[order].astype(np.int64), sizes[order].astype(np.int64)
        new = np.ones(len(cells), bool)
        new[1:] = (cells[1:] != cells[:-1]) | (nodes[1:] != nodes[:-1])
        cells, nodes, places, sizes = cells[new], nodes[new], places[new], sizes[new]
        for _ in range(3 if rows["block"].iloc[0] < 1 << block_bits else 0):  # a node that goes may leave another one without a partner
            kept = _partnered(cells, sizes, (100 + percent) * (sizes - places) - percent * sizes, percent)
            cells, nodes, places, sizes = cells[kept], nodes[kept], places[kept], sizes[kept]
        heads = np.flatnonzero(np.concatenate((np.ones(min(1, len(cells)), bool), cells[1:] != cells[:-1])))
        lengths = np.diff(np.append(heads, len(cells)))
        out = [pd.DataFrame({"kind": -1, "a": cells.view(np.int64), "b": nodes.view(np.int64), "place": places, "n": sizes})]
        column = np.repeat(np.arange(len(lengths)), lengths)
        for seed in range(PIVOTS if len(nodes) else 0):
            order = np.lexsort((nodes, mix(nodes + np.uint64(seed)) if seed else places / sizes, column))
            pivot = np.repeat(order[heads], lengths)
            left = np.minimum(sizes - places, sizes[pivot] - places[pivot])
            fits = (nodes[pivot] != nodes) & ((100 + percent) * left >= percent * (sizes + sizes[pivot]))
            found, n = np.unique(np.stack([nodes[pivot[fits]], nodes[fits]], 1), axis=0, return_counts=True)
            out.append(pd.DataFrame({"kind": seed, "a": found[:, 0].copy().view(np.int64), "b": found[:, 1].copy().view(np.int64), "place": 0, "n": n}))
        return pd.concat(out)

    return run


def _sets(wanted, k: int):
    """Nodes' whole sets, of the texts whose digest the filter lets through; some others come along."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits, seen = filter_bits(wanted), set()
        for batch in batches:
            hit = passing(bits, batch["digest"].to_numpy(np.int64))
            held: list = []
            for s in shingle_sets(batch["text"][hit], k):
                node = _node(s).view(np.int64)[0]
                if len(s) and node not in seen:
                    seen.add(node)
                    held.append((node, len(s), s.view(np.int64)))
                if len(held) == 500:
                    yield pd.DataFrame(held, columns=["node", "n", "shingles"])
                    held = []
            if held:
                yield pd.DataFrame(held, columns=["node", "n", "shingles"])

    return run


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose sets reach the bound, stored.

    A set that many pairs share as their `a` is copied to some tasks, not to each pair; `b` may repeat too.
    """
    salted, copies = dealt(pairs, "a")
    right = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("sb"))
    left = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("sa"))
    both = salted.join(right, "b").join(copies(left), ["a", "__salt"])
    common = F.size(F.array_intersect("sa", "sb"))
    return stored(both.withColumn("common", common).filter(100 * F.col("common") >= percent * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b"), "links")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node reachable. Each round takes the least label around and then the label's label."""
    ends = stored(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "ends")
    labels = stored(ends.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")), "labels")
    salted, copies = dealt(ends, "b")
    while True:
        around = salted.join(copies(labels.withColumnRenamed("node", "b")), ["b", "__salt"]).groupBy("a").agg(F.min("label").alias("near"))
        nearer = stored(labels.join(around, labels["node"] == around["a"]).select("node", F.col("label").alias("was"), F.least("label", "near").alias("label")), "labels")
        discard(labels)
        if not nearer.filter("was != label").limit(1).count():
            discard(ends)
            return nearer.select("node", "label")
        above = nearer.select(F.col("node").alias("label"), F.col("label").alias("above"))
        labels = stored(spread_join(nearer, above, "label").select("node", F.col("above").alias("label")), "labels")
        discard(nearer)


def _best(overlaps: DataFrame) -> DataFrame:
    """Of the pivots a that each node b shares cells with, the one it shares most with, stored: each b once."""
    summed = overlaps.groupBy("a", "b").agg(F.sum("n").alias("n"))
    return stored(summed.groupBy("b").agg(F.max_by("a", F.struct("n", "a")).alias("a")).select("a", "b"), "pairs")


def _either_way(pairs: DataFrame) -> DataFrame:
    return pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _open(columns: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows, with their label, of the columns that hold two labels or more, stored."""
    salted, copies = dealt(columns.select("shingle", "node", "place", "n"), "shingle")
    named = salted.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = named.groupBy("shingle").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo != hi").select("shingle")
    return stored(named.join(copies(mixed), ["shingle", "__salt"]).select("shingle", "node", "place", "n", "label"), "open")


def _stars(rows: DataFrame, seed: int, reach: str) -> DataFrame:
    """(a, b, n) for each node b of an open column and the column's pivot a of another component; the first pivot is as in a block, later ones are any."""
    order = F.struct(F.col("place") / F.col("n") if seed == 0 else F.lit(0), F.xxhash64(F.lit(seed), "node"))
    pivots = rows.groupBy("shingle").agg(F.min_by(F.struct("node", "label", "place", "n"), order).alias("p"))
    salted, copies = dealt(rows, "shingle")
    met = salted.alias("x").join(copies(pivots).alias("y"), ["shingle", "__salt"]).filter("x.label != p.label AND " + reach % tuple("xxppxp"))
    return met.groupBy(F.col("p.node").alias("a"), F.col("node").alias("b")).agg(F.count("*").alias("n"))


def _rest(rows: DataFrame, reach: str, percent: int) -> DataFrame:
    """The pairs (a, b) of different components that share an open column and may reach the bound.

    Their sizes are in one band or in neighbouring ones; a column's rows are dealt to parts of REST_ROWS.
    """
    step = float(np.log(max(1.01, 100.001 / percent)))
    banded = rows.withColumn("band", F.floor(F.ln("n") / step))
    salted, copies = dealt(banded, "shingle", REST_ROWS)
    wider = copies(banded.select("shingle", "node", "place", "n", "label", F.col("band").alias("own"), F.explode(F.array("band", F.col("band") - 1)).alias("band")))
    x, y = salted.alias("x"), wider.alias("y")
    once = "(y.own = x.band - 1 OR y.own = x.band + 1 OR x.node < y.node)"
    met = x.join(y, ["shingle", "band", "__salt"]).filter(f"x.label != y.label AND {once} AND " + reach % tuple("xxyyxy"))
    return met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def _placed(docs: DataFrame, id_col: str, text_col: str, percent: int, k: int, block_bits: int | None = None) -> DataFrame:
    """Per row of docs: id, digest of the text, n of shingles and label of the component, null without words. Stored."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("digest"), F.col(text_col).alias("text"))
    first = stored(rows.mapInPandas(_profile(k), f"id {kind}, digest long, n long, node long, part int, counts binary"), "profile")
    nodes = first.filter("part < 0").select("id", "digest", "n", "node")
    sketch = gathered(first.filter("part >= 0").select("part", "counts"), add_counts, 4 << SKETCH_BITS)
    if block_bits is None:  # some 4 blocks for each partition of the input, 64 at least
        block_bits = max(6, (4 * rows.rdd.getNumPartitions() - 1).bit_length())
    cells = rows.select("text").mapInPandas(_prefixes(sketch, percent, k, block_bits), "block long, cells binary, nodes binary, places binary, sizes binary")
    product = stored(cells.groupBy("block").applyInPandas(_product(percent, block_bits), "kind int, a long, b long, place long, n long"), "product")
    sized = product.filter("kind < 0").select(F.col("a").alias("shingle"), F.col("b").alias("node"), "place", "n")

    shared = stored(nodes.groupBy("node").agg(F.min("digest").alias("digest")).join(sized.select("node").distinct(), "node"), "shared")
    wanted = hash_filter(shared.select("digest"))
    made = rows.select("digest", "text").mapInPandas(_sets(wanted, k), "node long, n long, shingles array<long>")
    sets = stored(made.join(shared.select("node"), "node", "left_semi").dropDuplicates(["node"]), "sets")

    checked = _best(product.filter("kind >= 0").select("a", "b", "n"))
    linked = verified(checked, sets, percent)
    labels = components(linked)
    reach = f"least(%s.n - %s.place, %s.n - %s.place) * {100 + percent} >= {percent} * (%s.n + %s.n)"
    discard(shared)
    seed, rows = 0, _open(sized, labels)
    discard(product)
    if rows.limit(1).count():  # from here on only the sets of open columns matter
        still = stored(sets.join(rows.select("node").distinct(), "node", "left_semi"), "sets")
        discard(sets)
        sets = still
    while rows.limit(1).count():
        pairs = stored(_best(_stars(rows, seed, reach)).join(_either_way(checked), ["a", "b"], "left_anti"), "pairs")
        links = verified(pairs, sets, percent)
        checked, linked = checked.unionByName(pairs), linked.unionByName(links)
        found, looked = links.count(), pairs.count()
        labels = components(linked) if found else labels
        if 4 * found < looked or not looked:
            rows = _open(rows, labels) if found else rows
            links = verified(stored(_rest(rows, reach, percent).join(_either_way(checked), ["a", "b"], "left_anti"), "pairs"), sets, percent)
            labels = components(linked.unionByName(links)) if links.limit(1).count() else labels
            break
        before, rows, seed = rows, _open(rows, labels), seed + 1
        discard(before)
    discard(sets)
    met = spread_join(nodes, labels, "node", "left")
    return stored(met.select("id", "digest", "n", F.when(F.col("n") > 0, F.coalesce("label", "node")).alias("label")), "placed")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, k: int = 5, block_bits: int | None = None) -> DataFrame:
    """Per row of docs: id, n_shingles and component_id, the smallest id reachable by links.

    Two rows link when 100 * intersection >= percent * union of their shingle sets. A row without words
    (null, empty or blank text) has an empty set and links with nothing: it is its own component. Rows
    with a null id take part; a component's id is its least id that is not null. Repeated rows stay.
    """
    placed = _placed(docs, id_col, text_col, percent, k, block_bits).select("id", "n", "label")
    least = placed.filter("label is not null").groupBy("label").agg(F.min("id").alias("least"))
    return spread_join(placed, least, "label", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("least", "id").alias("component_id"))


def one_per_component(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, k: int = 5) -> DataFrame:
    """docs cut to one row of each component, one of the smallest id that is not null; rows without words all stay.

    The row is named by its id and its text's digest, as ids may be null or repeated; of rows alike in both one stays.
    """
    texts = _placed(docs, id_col, text_col, percent, k).groupBy("id", "digest").agg(F.max("label").alias("label"), F.count("*").alias("times"))
    worded = texts.filter("label is not null").groupBy("label").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "digest", "times")).alias("x"))
    every = texts.filter("label is null").select("id", "digest", F.lit(1).cast("long").alias("times"))
    own_id, own_digest, own_times, row = (free_name(docs, f"__{x}") for x in ("id", "digest", "times", "row"))
    kept = stored(worded.select("x.id", "x.digest", "x.times").unionByName(every).toDF(own_id, own_digest, own_times), "kept")
    same = F.col(id_col).eqNullSafe(F.col(own_id)) & (F.xxhash64(text_col) == F.col(own_digest))
    once = docs.join(kept.filter(F.col(own_times) == 1), same, "left_semi")
    if not kept.filter(F.col(own_times) > 1).limit(1).count():
        return once
    several = docs.join(kept.filter(F.col(own_times) > 1), same, "left_semi")
    plain = [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    first = several.groupBy(F.col(id_col).alias(own_id), F.xxhash64(text_col).alias(own_digest)).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*plain)).alias(row))
    return once.unionByName(first.select(f"{row}.*"))
