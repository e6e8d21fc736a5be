"""Benchmark decontamination by pigeonhole edit matching.

Texts are compared lower-cased with every run of other characters than letters and digits as one space.
An item of length n may differ by budget(n) edits. Cut into budget + 1 pieces, at least one of them is
untouched wherever the item occurs within that budget, so exact hits of pieces (found by one
Aho-Corasick automaton over a block of items) mark every possible place. Myers' bit-parallel algorithm
then gives the least edit distance there.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Edits allowed per character of an item.
RATE = 0.0625
#: Characters of items searched for at a time: the automaton's bound. More items go through in blocks.
BLOCK_CHARS = 4_000_000
_OTHER = regex.compile(r"[^\p{L}\p{N}]+")


def normal(text: str | None) -> str:
    return _OTHER.sub(" ", text.lower()).strip() if isinstance(text, str) else ""


def budget(length: int, rate: float = RATE) -> int:
    return int(length * rate)


def pieces(item: str, rate: float = RATE) -> list[tuple[int, str]]:
    """(offset, piece) of budget + 1 near-equal pieces."""
    n = min(budget(len(item), rate) + 1, len(item))
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(pattern: str, text: str) -> tuple[int, int]:
    """The least edit distance of the pattern to any substring of text, and where the first best one ends."""
    m = len(pattern)
    at: dict[str, int] = {}
    for i, c in enumerate(pattern):
        at[c] = at.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(text):
        eq = at.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


def _automaton(items: list[tuple[object, str]], rate: float) -> tuple[object, list]:
    found: dict[str, list[tuple[int, int]]] = {}
    for k, (_, item) in enumerate(items):
        for offset, piece in pieces(item, rate):
            found.setdefault(piece, []).append((k, offset))
    a = ahocorasick.Automaton()
    for piece, where in found.items():
        a.add_word(piece, (len(piece), where))
    a.make_automaton()
    return a, items


def matches(text: str, automaton, items: list, rate: float) -> Iterator[tuple[int, int, int]]:
    """(item, edits, end) of every item that the normalised text holds within its budget."""
    places: dict[int, list[int]] = {}
    for end, (size, where) in automaton.iter(text):
        for k, offset in where:
            places.setdefault(k, []).append(end + 1 - size - offset)
    for k, starts in places.items():
        item = items[k][1]
        most = budget(len(item), rate)
        best = None
        windows: list[list[int]] = []
        for s in sorted(set(starts)):  # starts within twice the budget share a window
            lo, hi = max(0, s - most), s + len(item) + most
            if windows and lo <= windows[-1][0] + 2 * most + len(item):
                windows[-1][1] = max(windows[-1][1], hi)
            else:
                windows.append([lo, hi])
        for lo, hi in windows:
            edits, end = myers(item, text[lo:hi])
            if edits <= most and (best is None or edits < best[0]):
                best = (edits, lo + end)
        if best:
            yield k, *best


def _search(block: list[tuple[object, str]], rate: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton, items = _automaton(block, rate)
        for batch in batches:
            out = []
            for i, text in zip(batch["id"], batch["text"], strict=True):
                out += [(i, items[k][0], len(items[k][1]), edits, end) for k, edits, end in matches(normal(text), automaton, items, rate)]
            yield pd.DataFrame(out, columns=["id", "item", "item_chars", "edits", "end"])

    return run


def _blocks(items: DataFrame, item_id: str, item_text: str) -> Iterator[list[tuple[object, str]]]:
    block, held = [], 0
    for r in items.select(F.col(item_id).alias("item"), F.col(item_text).alias("text")).dropna(subset=["text"]).orderBy("item", "text").toLocalIterator():
        if item := normal(r["text"]):
            block.append((r["item"], item))
            held += len(item)
        if held >= BLOCK_CHARS:
            yield block
            block, held = [], 0
    if block:
        yield block


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", rate: float = RATE) -> DataFrame:
    """A row per document and item that it holds within the budget: ids, item_chars, edits, end.

    `end` is where the best match ends in the normalised document. An item of less than 1 / rate characters
    may not differ at all and is found wherever its characters stand in a row, within words too: an item
    "a" is in nearly every text. Items of use are longer. Null, empty and letterless texts and
    items match nothing; equal items match alike; repeated rows are reported as often as they occur.
    Items go through in blocks of BLOCK_CHARS, one pass over docs each, so none is too many.
    """
    kind, of_item = docs.schema[id_col].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {kind}, item {of_item}, item_chars long, edits long, end long"
    found = None
    for block in _blocks(items, item_id, item_text):
        some = rows.mapInPandas(_search(block, rate), schema)
        found = some if found is None else found.unionAll(some)
    if found is None:
        found = docs.sparkSession.createDataFrame([], schema)
    return found.select(F.col("id").alias(id_col), F.col("item").alias(item_id), "item_chars", "edits", "end")


def _any_match(block: list[tuple[object, str]], rate: float):
    made: list = []

    def leaked(texts: pd.Series) -> pd.Series:
        if not made:
            made.append(_automaton(block, rate))
        return pd.Series([any(True for _ in matches(normal(t), *made[0], rate)) for t in texts], dtype=bool)

    return F.pandas_udf(leaked, "boolean")


def drop_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", rate: float = RATE) -> DataFrame:
    """docs without those that hold an item within the budget; each row is judged by its own text alone."""
    for block in _blocks(items, item_id, item_text):
        docs = docs.filter(~_any_match(block, rate)(text_col))
    return docs
