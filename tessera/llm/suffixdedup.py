"""Long repeated substrings by a logarithmic family of sparse suffix arrays.

Matches are of LENGTH bytes or more, so not every suffix needs an entry. Of the WINDOW grams that start
in a LENGTH-byte string, the one of least hash (the leftmost of equals) is its anchor; equal strings
have equal anchors at equal places, and only suffixes at anchors, some 1.3 % of all, are entries. A
match holds the GRAM bytes behind its anchor whole, so these bytes, an entry's head, are stored with it.

A batch's suffix array lists its heads in byte order, each once, cut into blocks of that order. The head
has one entry's place, and the hash of the context (all bytes that strings with this anchor can reach)
if all its entries agree in that, 0 if not. `SuffixFamily.add` makes the array of a new batch and
merge-scans it with every level's: neighbours in the joint order that share a whole head meet. Levels of
equal size then merge, so an entry is rewritten a logarithmic number of times. Arrays are tables bucketed
by block, so scans and merges shuffle nothing.

Where heads meet and the contexts agree, both are repeated all over. Where they don't, a match ends
inside the context: `marks` reads just these contexts again, sorts them as suffixes (and, reversed, as
prefixes) in full and takes from the longest common prefixes of neighbours which strings occur twice.
Heads of more than MANY contexts (a passage that a third of all documents quote) are compared by string
hash over all tasks instead, so no task holds them all: strings meet by what STEP neighbouring ones have
in common. Everything works on bytes, within documents only; a text is taken CHUNK bytes at a time.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, shared_dir, stored
from tessera.llm.sketch import filter_bits, hash_filter, passing
from tessera.llm.texthash import _power_tables, mix

LENGTH, GRAM = 200, 50
WINDOW = LENGTH - GRAM + 1
#: Bytes before and after an anchor that its strings can reach.
LEFT, RIGHT = WINDOW - 1, LENGTH
#: Contexts of one head that are sorted in one task; neighbouring strings that are compared in one task.
MANY, STEP = 256, 16
#: Bytes whose anchors are sought at a time.
CHUNK = 1 << 18
#: Texts, and heads of each, whose order balances the blocks; they decide nothing else.
SAMPLE_DOCS, SAMPLE_HEADS = 4000, 16
#: Blocks in a bucket, and the most buckets of an array.
SPREAD, MOST_BUCKETS = 4, 50_000
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25))
_LOW = np.uint64((1 << 22) - 1)


def _sums(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums from which the hash of bytes x to y is (s[y] - s[x]) * down[x]."""
    up, down = _power_tables(len(a) + 1)
    s = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(_BYTES[a] * up[: len(a)], out=s[1:])
    return s, down


def _segments(docs: list[bytes]) -> Iterator[list[tuple[int, bytes, int, int, int, int]]]:
    """Groups of (document, bytes, their place in it, first and last + 1 string start, its length) of about CHUNK bytes."""
    group, size = [], 0
    for i, d in enumerate(docs):
        n = len(d)
        for first in range(0, max(0, n - LENGTH + 1), CHUNK):
            last = min(n - LENGTH + 1, first + CHUNK)
            lo, hi = max(0, first - LEFT), min(n, last + LENGTH + RIGHT)
            if group and size + hi - lo > CHUNK:
                yield group
                group, size = [], 0
            group.append((i, d if hi - lo == n else d[lo:hi], lo, first, last, n))
            size += hi - lo
    if group:
        yield group


def entries(docs: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """(document, position, gram hash, context hash, bytes of context before, bytes after, head) of anchors, in arrays."""
    for group in _segments(docs):
        data = np.frombuffer(b"".join(g[1] for g in group), np.uint8)
        s, down = _sums(data)
        grams = mix((s[GRAM:] - s[:-GRAM]) * down[: len(data) - GRAM + 1])
        least = (mix(grams) & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
        reach, span = least, 1
        while 2 * span <= WINDOW:
            reach, span = np.minimum(reach[:-span], reach[span:]), 2 * span
        if span < WINDOW:
            reach = np.minimum(reach[: len(least) - WINDOW + 1], reach[WINDOW - span :][: len(least) - WINDOW + 1])
        at = np.cumsum([0] + [len(g[1]) for g in group])
        place, first, last, n = (np.array([g[k] for g in group]) for k in (2, 3, 4, 5))
        starts = np.arange(len(reach))
        which = np.searchsorted(at, starts, side="right") - 1
        inside = starts - at[which] + place[which]
        chosen = (reach[(inside >= first[which]) & (inside < last[which])] & _LOW).astype(np.int64)
        chosen = np.unique(chosen[np.flatnonzero(np.diff(chosen, prepend=-1))])
        which = np.searchsorted(at, chosen, side="right") - 1
        p = chosen - at[which] + place[which]
        left, right = np.minimum(LEFT, p), np.minimum(RIGHT, n[which] - p)
        context = mix((s[chosen + right] - s[chosen - left]) * down[chosen - left] + (left * 1024 + right).astype(np.uint64))
        heads = np.lib.stride_tricks.sliding_window_view(data, GRAM)[chosen]
        yield np.array([g[0] for g in group])[which], p, grams[chosen], np.maximum(context, 1), left, right, np.ascontiguousarray(heads).view(f"S{GRAM}").ravel()


def _bytes(text) -> bytes:
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""


def _all_entries(texts) -> tuple[np.ndarray, ...] | None:
    found = list(entries([_bytes(t) for t in texts]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else None


def _press(a: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(a).tobytes(), 1)


def _loaded(rows: pd.DataFrame, kinds: dict) -> tuple[np.ndarray, ...]:
    unpress = zstandard.ZstdDecompressor().decompress
    return tuple(np.concatenate([np.frombuffer(unpress(x), t) for x in rows[c]] or [np.zeros(0, t)]) for c, t in kinds.items())


_KINDS = {"heads": f"S{GRAM}", "contexts": np.uint64, "keys": np.int64, "places": np.int64}
_FOUND = {"marked": np.int64, "wanted": np.int64}
_ARRAY = "batch int, block int, " + ", ".join(f"{c} binary" for c in (*_KINDS, *_FOUND))


def _runs(key: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Rows (key, first, last), those of a key joined where they meet."""
    o = np.lexsort((last, first, key))
    key, first, last = key[o], first[o], last[o]
    if not len(o):
        return np.zeros((0, 3), np.int64)
    heads = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    shift = np.repeat(np.arange(len(heads)) << 40, np.diff(np.append(heads, len(o))))  # keeps keys apart; a text has less than 2^31 bytes
    reach = np.maximum.accumulate(last + shift)
    new = np.concatenate(([True], (first + shift)[1:] > reach[:-1]))
    new[heads] = True
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(o)) - 1
    return np.stack([key[starts], first[starts], (reach - shift)[ends]], 1)


def _around(key: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Marks over whole contexts; an end past the text's is cut later."""
    return _runs(key, np.maximum(0, p - LEFT), p + RIGHT)


def _spans(a: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"key": a[:, 0], "first": a[:, 1], "last": a[:, 2]})


def _gram_hashes(heads: np.ndarray) -> np.ndarray:
    """The hash that entries() gives these grams."""
    up, _ = _power_tables(GRAM)
    table = np.ascontiguousarray(heads, f"S{GRAM}").view(np.uint8).reshape(-1, GRAM)
    return mix((_BYTES[table] * up[:GRAM]).sum(1, dtype=np.uint64)).view(np.int64)


def _heads_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for text in batch["text"]:
            found = _all_entries([text])
            if found:
                yield pd.DataFrame({"head": [bytes(h).ljust(GRAM, b"\0") for h in found[6][:: max(1, -(-len(found[6]) // SAMPLE_HEADS))]]})


def _index(bounds):
    """Per batch number and block: the heads of some texts, each once, and marks of contexts that repeat among these texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = _all_entries(rows["text"])
            if not found:
                continue
            doc, p, gram, context, *_, heads = found
            key, number = rows["key"].to_numpy(np.int64)[doc], rows["batch"].to_numpy(np.int64)[doc]
            o = np.lexsort((context, gram, number))
            key, p, gram, context, number, heads = (x[o] for x in (key, p, gram, context, number, heads))
            first = np.concatenate(([True], (gram[1:] != gram[:-1]) | (number[1:] != number[:-1])))
            kind = first | np.concatenate(([True], context[1:] != context[:-1]))
            of, both = np.cumsum(first) - 1, np.cumsum(kind) - 1
            context = np.where(np.bincount(of, kind)[of] > 1, np.uint64(0), context)[first]
            twice = np.bincount(both)[both] > 1
            marks = _around(key[twice], p[twice])
            block = np.searchsorted(bounds.value, heads[first], side="right")
            o = np.lexsort((block, number[first]))
            number, block, columns = number[first][o], block[o], [x[first][o] if x is not context else context[o] for x in (heads, context, key, p.astype(np.int64))]
            cuts = np.flatnonzero((block[1:] != block[:-1]) | (number[1:] != number[:-1])) + 1
            out = []
            for i, part in enumerate(zip(*(np.split(x, cuts) for x in (number, block, *columns)), strict=True)):
                out.append((part[0][0], part[1][0], *map(_press, part[2:]), _press(marks if i == 0 else marks[:0]), _press(marks[:0])))
            yield pd.DataFrame(out, columns=["batch", "block", *_KINDS, *_FOUND])

    return run


def _folded(heads: np.ndarray, contexts: np.ndarray, keys: np.ndarray, places: np.ndarray) -> tuple[list, np.ndarray, np.ndarray]:
    """Entries in suffix order with each head once; marks of heads that met in agreement, and which heads of the order met otherwise."""
    o = np.argsort(heads, kind="stable")
    heads, contexts, keys, places = heads[o], contexts[o], keys[o], places[o]
    first = np.concatenate((np.ones(min(1, len(o)), bool), heads[1:] != heads[:-1]))
    of, at = np.cumsum(first) - 1, np.flatnonzero(first)
    size = np.diff(np.append(at, len(o)))
    agree = (np.minimum.reduceat(contexts, at) == np.maximum.reduceat(contexts, at)) & (contexts[at] > 0) if len(at) else np.zeros(0, bool)
    met = (agree & (size > 1))[of]
    return [heads[first], np.where(agree, contexts[first], np.uint64(0)), keys[first], places[first]], _around(keys[met], places[met]), ~agree


def _array(rows: pd.DataFrame) -> pd.DataFrame:
    """One block of a batch's suffix array, with what repeats in the batch."""
    columns, marks, apart = _folded(*_loaded(rows, _KINDS))
    marks = np.concatenate([_loaded(rows, {"marked": np.int64})[0].reshape(-1, 3), marks])
    return pd.DataFrame([(rows["batch"].iloc[0], rows["block"].iloc[0], *map(_press, columns), _press(_runs(*marks.T)), _press(_gram_hashes(columns[0][apart])))], columns=["batch", "block", *_KINDS, *_FOUND])


def _scan(new: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
    """Merge-scan of one block of a new array with a level's: marks where contexts agree, the grams of other meetings."""
    heads, contexts, keys, places = _loaded(new, _KINDS)
    others, known, theirs, there = _loaded(old, _KINDS)
    at = np.minimum(np.searchsorted(others, heads), max(0, len(others) - 1))
    met = np.flatnonzero(others[at] == heads) if len(others) and len(heads) else np.zeros(0, np.int64)
    at = at[met]
    agree = (contexts[met] == known[at]) & (known[at] > 0)
    marks = _around(np.concatenate([keys[met[agree]], theirs[at[agree]]]), np.concatenate([places[met[agree]], there[at[agree]]]))
    return pd.DataFrame([(_press(marks), _press(_gram_hashes(heads[met[~agree]])))] if len(met) else [], columns=list(_FOUND))


def _merge(new: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
    rows = pd.concat([new, old])
    columns, *_ = _folded(*_loaded(rows, _KINDS))
    return pd.DataFrame([(rows["block"].iloc[0], *map(_press, columns))], columns=["block", *_KINDS])


def _unpacked(column: str):
    """The rows of packed marks, or of packed gram hashes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(len(batch)):
                (a,) = _loaded(batch.iloc[i : i + 1], {column: np.int64})
                for at in range(0, len(a), 300_000):
                    some = a[at : at + 300_000]
                    yield _spans(some.reshape(-1, 3)) if column == "marked" else pd.DataFrame({"gram": some})

    return run


def _contexts(wanted):
    """The contexts of wanted grams, one of each kind in a batch; and marks of those that repeat within the batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = filter_bits(wanted)
        for batch in batches:
            keys = batch["key"].to_numpy(np.int64)
            docs = [_bytes(t) for t in batch["text"]]
            found = []
            for *e, _ in entries(docs):
                hit = passing(bits, e[2].view(np.int64))
                found.append([x[hit] for x in e])
            if not found:
                continue
            doc, p, gram, context, left, right = (np.concatenate(c) for c in zip(*found, strict=True))
            o = np.lexsort((context, gram))
            new = np.ones(len(o), bool)
            new[1:] = (gram[o][1:] != gram[o][:-1]) | (context[o][1:] != context[o][:-1])
            of = np.cumsum(new) - 1
            twice = o[np.bincount(of, minlength=1)[of] > 1] if len(o) else o
            yield _spans(_around(keys[doc[twice]], p[twice])).assign(gram=None, p=None, before=None, bytes=None)
            for rows in np.array_split(o[new], len(o) // 20_000 + 1):
                body = [docs[d][a:b] for d, a, b in zip(doc[rows], p[rows] - left[rows], p[rows] + right[rows], strict=True)]
                yield pd.DataFrame({"gram": gram[rows].view(np.int64), "key": keys[doc[rows]], "p": p[rows], "before": left[rows], "bytes": body, "first": None, "last": None})

    return run


_CONTEXTS = "gram long, key long, p long, before int, bytes binary, first long, last long"


def _laid_out(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts in a table with the anchors at column LEFT, and their first and last + 1 columns."""
    table = np.zeros((len(rows), LEFT + RIGHT), np.uint8)
    lo = LEFT - rows["before"].to_numpy(np.int64)
    hi = lo + np.array([len(b) for b in rows["bytes"]], np.int64)
    for i, b in enumerate(rows["bytes"]):
        table[i, lo[i] : hi[i]] = np.frombuffer(b, np.uint8)
    return table, lo, hi


def _ordered(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in byte order, and the common prefix of each with the one before it (0 for the first)."""
    o = np.argsort(np.ascontiguousarray(table).view(f"S{table.shape[1]}").ravel(), kind="stable")
    same = table[o[1:]] == table[o[:-1]]
    return o, np.concatenate(([0], np.where(same.all(1), table.shape[1], same.argmin(1))))


def _matches(rows: pd.DataFrame) -> np.ndarray:
    """Marks of the strings that occur around two anchors, at the same offset, read from the common prefixes of sorted neighbours.

    Two contexts share the string that starts d before their anchors if they share d bytes before them and
    LENGTH - d from them on. Those that share n bytes from the anchor on are a run of the suffix order
    without a common prefix below n, and in the same way, reversed, for the bytes before.
    """
    table, lo, hi = _laid_out(rows)
    after, common = _ordered(table[:, LEFT:])
    before, shared = _ordered(table[:, LEFT - 1 :: -1])
    key, p, n = rows["key"].to_numpy(np.int64), rows["p"].to_numpy(np.int64), len(rows)
    right, left = np.empty(n, np.int64), np.empty(n, np.int64)
    keys, starts = [], []
    for d in range(WINDOW):
        right[after], left[before] = np.cumsum(common < LENGTH - d), np.cumsum(shared < d)
        whole = np.flatnonzero((lo <= LEFT - d) & (hi >= LEFT - d + LENGTH))
        _, back, times = np.unique(right[whole] * (n + 1) + left[whole], return_inverse=True, return_counts=True)
        twice = whole[times[back] > 1]
        keys.append(key[twice])
        starts.append(p[twice] - d)
    start = np.concatenate(starts)
    return _runs(np.concatenate(keys), start, start + LENGTH)


def _compare(rows: pd.DataFrame) -> pd.DataFrame:
    """One block of grams, whole grams and some MANY contexts at a time."""
    rows = rows.sort_values("gram", kind="stable")
    grams = rows["gram"].to_numpy()
    heads = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1])))
    out, at = [], 0
    while at < len(rows):
        k = np.searchsorted(heads, at + MANY, side="left")
        to = heads[k] if k < len(heads) else len(rows)
        out.append(_matches(rows.iloc[at:to]))
        at = to
    return _spans(np.concatenate(out))


def _strings(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every LENGTH-byte string (row, offset) around the anchors, which of them exist, and hashes (row, offset // STEP) of what neighbours share."""
    table, lo, hi = _laid_out(rows)
    up, down = _power_tables(LEFT + RIGHT + 1)
    s = np.zeros((len(rows), LEFT + RIGHT + 1), np.uint64)
    np.cumsum(_BYTES[table] * up[: LEFT + RIGHT], axis=1, out=s[:, 1:])
    gram = mix(rows["gram"].to_numpy(np.int64).view(np.uint64))[:, None]

    def hashed(x: np.ndarray, length: int) -> np.ndarray:
        return mix((mix((s[:, x + length] - s[:, x]) * down[x]) + mix(np.arange(1, len(x) + 1, dtype=np.uint64))) ^ gram)

    x = LEFT - np.arange(WINDOW)
    return hashed(x, LENGTH), (x >= lo[:, None]) & (x + LENGTH <= hi[:, None]), hashed(x[::STEP], LENGTH - STEP + 1)


def _spread(blocks: int):
    """For grams of very many contexts: string hashes by block, one of each kind in a batch, and marks of those met twice."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 2048):
                some = batch.iloc[at : at + 2048]
                hashes, there, shared = _strings(some)
                i, o = np.nonzero(there)
                key, start = some["key"].to_numpy(np.int64)[i], some["p"].to_numpy(np.int64)[i] - o
                h, first, back, n = np.unique(hashes[i, o], return_index=True, return_inverse=True, return_counts=True)
                twice = n[back] > 1
                yield _spans(_runs(key[twice], start[twice], start[twice] + LENGTH)).assign(block=-1, hashes=None, keys=None, starts=None)
                block = (shared[i[first], o[first] // STEP] % np.uint64(blocks)).astype(np.int64)
                order = np.argsort(block, kind="stable")
                cuts = np.flatnonzero(np.diff(block[order])) + 1
                parts = zip(*(np.split(x[order], cuts) for x in (block, h, key[first], start[first])), strict=True)
                yield pd.DataFrame([(None, None, None, b[0], *map(_press, x)) for b, *x in parts if len(b)], columns=["key", "first", "last", "block", "hashes", "keys", "starts"])

    return run


def _meet(rows: pd.DataFrame) -> pd.DataFrame:
    h, key, start = _loaded(rows, {"hashes": np.uint64, "keys": np.int64, "starts": np.int64})
    _, back, n = np.unique(h, return_inverse=True, return_counts=True)
    twice = n[back] > 1
    return _spans(_runs(key[twice], start[twice], start[twice] + LENGTH))


_MARKS = "key long, first long, last long"


class SuffixFamily:
    """Documents indexed batch by batch. levels: (batches in it, its array), each a table in the shared folder."""

    def __init__(self, id_col: str = "doc_id", text_col: str = "text"):
        self.id_col, self.text_col = id_col, text_col
        self.levels: list[tuple[int, DataFrame]] = []
        self.found: list[DataFrame] = []
        self.batches: list[DataFrame] = []
        #: All tables written, for close().
        self.held: list[DataFrame] = []
        self.buckets = 0

    def _rows(self, docs: DataFrame) -> DataFrame:
        return docs.select(F.xxhash64(self.id_col, self.text_col).alias("key"), F.col(self.text_col).alias("text"))

    def fit(self, docs: DataFrame) -> None:
        """Sets the blocks of the suffix order, as many as docs has partitions for; a bounded sample balances them."""
        spark, rows = docs.sparkSession, self._rows(docs)
        self.buckets = min(MOST_BUCKETS, max(4, rows.rdd.getNumPartitions()))
        share = min(1.0, SAMPLE_DOCS / max(1, docs.count()))
        heads = np.sort(np.array([bytes(r["head"]) for r in rows.sample(share, seed=7).mapInPandas(_heads_of, "head binary").collect()] or [b""], f"S{GRAM}"))
        self.bounds = spark.sparkContext.broadcast(heads[np.linspace(0, len(heads) - 1, SPREAD * self.buckets + 1).astype(int)[1:-1]])

    def _table(self, rows: DataFrame, *parts: str) -> DataFrame:
        """rows, clustered by block, as a table whose buckets are the tasks of later scans."""
        spark, name = rows.sparkSession, f"array_{uuid.uuid4().hex}"
        writer = rows.write.partitionBy(*parts) if parts else rows.write
        path = f"{shared_dir(spark)}/{name}"
        writer.bucketBy(self.buckets, "block").saveAsTable(name, format="parquet", path=path)
        made = spark.table(name)
        made.stored_at, made.stored_as = path, name
        self.held.append(made)
        return made

    def _stored(self, rows: DataFrame, name: str) -> DataFrame:
        made = stored(rows, name)
        self.held.append(made)
        return made

    def close(self) -> None:
        """Removes all tables and files of the family. What marks() gave has to be written elsewhere before."""
        discard(*self.held)
        self.held, self.levels, self.found, self.batches = [], [], [], []

    def index(self, docs: DataFrame, batches: int = 1) -> list[DataFrame]:
        """The suffix arrays of docs dealt to so many batches, made in one pass; what repeats within a batch is noted."""
        if not self.buckets:
            self.fit(docs)
        rows = self._rows(docs).withColumn("batch", F.pmod(F.shiftright("key", 8), F.lit(batches)).cast("int"))
        made = rows.mapInPandas(_index(self.bounds), _ARRAY).repartition(self.buckets, "block").groupBy("batch", "block").applyInPandas(_array, _ARRAY)
        arrays = self._table(made, "batch")
        self.found.append(arrays.select(*_FOUND))
        self.batches.append(docs)
        return [arrays.filter(f"batch = {b}").select("block", *_KINDS) for b in range(batches)]

    def enter(self, array: DataFrame, last: bool = False) -> None:
        """Merge-scans a batch's array with every level's, then makes it one and merges levels of equal size (the last batch: neither)."""
        for _, level in self.levels:
            met = array.groupBy("block").cogroup(level.groupBy("block")).applyInPandas(_scan, "marked binary, wanted binary")
            self.found.append(self._stored(met, "scan"))
        if last:
            return
        self.levels.append((1, array))
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (n, newer), (_, older) = self.levels.pop(), self.levels.pop()
            merged = self._table(newer.groupBy("block").cogroup(older.groupBy("block")).applyInPandas(_merge, "block int, " + ", ".join(f"{c} binary" for c in _KINDS)))
            discard(newer, older)
            self.levels.append((2 * n, merged))

    def add(self, docs: DataFrame) -> None:
        """Indexes a new batch and scans it with itself and every level."""
        self.enter(self.index(docs)[0])

    def marks(self) -> DataFrame:
        """(key, first, last): all repeated bytes of all batches so far, as spans that may overlap."""
        found, docs = self.found[0], self._rows(self.batches[0])
        for f in self.found[1:]:
            found = found.unionByName(f)
        for d in self.batches[1:]:
            docs = docs.unionByName(self._rows(d))
        wanted = hash_filter(self._stored(found.select("wanted").mapInPandas(_unpacked("wanted"), "gram long"), "wanted"))
        near = self._stored(docs.mapInPandas(_contexts(wanted), _CONTEXTS), "contexts")
        contexts = near.filter("gram is not null").select("gram", "key", "p", "before", "bytes")
        # each takes MANY contexts, so they are few beside the contexts, but grow with them: no broadcast is forced
        hot = self._stored(contexts.groupBy("gram").count().filter(f"count > {MANY}").select("gram"), "hot")
        few = contexts.join(hot, "gram", "left_anti").withColumn("block", F.pmod(F.xxhash64("gram"), F.lit(SPREAD * self.buckets)))
        many = contexts.join(hot, "gram", "left_semi")
        spread = self._stored(many.mapInPandas(_spread(SPREAD * self.buckets), f"{_MARKS}, block long, hashes binary, keys binary, starts binary"), "spread")
        names = ["key", "first", "last"]
        parts = [
            found.select("marked").mapInPandas(_unpacked("marked"), _MARKS), near.filter("gram is null").select(names), self._stored(few.groupBy("block").applyInPandas(_compare, _MARKS), "matches"),
            spread.filter("block < 0").select(names), self._stored(spread.filter("block >= 0").groupBy("block").applyInPandas(_meet, _MARKS), "matches"),
        ]
        whole = parts[0]
        for p in parts[1:]:
            whole = whole.unionByName(p)
        return whole


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield _without(batch["id"], batch["text"], batch["spans"])


def _without(ids, texts, every_spans) -> pd.DataFrame:
    out = []
    for i, text, spans in zip(ids, texts, every_spans, strict=True):
        data = _bytes(text)
        joined: list[list[int]] = []
        for s in sorted((s["first"], min(s["last"], len(data))) for s in (spans if spans is not None else ())):
            if joined and s[0] <= joined[-1][1]:
                joined[-1][1] = max(joined[-1][1], s[1])
            else:
                joined.append([*s])
        kept, at = [], 0
        for a, b in joined:
            kept.append(data[at:a])
            at = b
        kept.append(data[at:])
        whole = b"".join(kept)
        out.append((i, len(data), len(data) - len(whole), len(joined), hashlib.sha256(whole).hexdigest(), whole))
    return pd.DataFrame(out, columns=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def _let_through(keys, marked: bool):
    """Rows that may have marks, or the results of those that surely have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = filter_bits(keys)
        for batch in batches:
            hit = passing(bits, batch["key"].to_numpy(np.int64))
            rest = batch[~hit]
            yield batch[hit] if marked else _without(rest["id"], rest["text"], [None] * len(rest))

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = 5) -> DataFrame:
    """A row per row of docs: id, n_bytes, n_removed, n_spans, kept_sha256 and kept, the bytes that are left.

    Every byte goes that a LENGTH-byte string covers which also starts elsewhere, in the same document
    or another; a cut may end inside a character, so `kept` is binary. Null and empty texts have no
    bytes; rows with equal id and text are documents of their own and repeat each other. Other columns
    are not looked at. batches: how many batches the family takes docs in; 5 make levels of 2 and of 4.
    """
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    family = SuffixFamily("id", "text")
    arrays = family.index(plain, batches)
    for array in arrays:
        family.enter(array, last=array is arrays[-1])
    spans = stored(family.marks().groupBy("key").agg(F.collect_list(F.struct("first", "last")).alias("spans")), "spans")
    family.close()
    keys = hash_filter(spans.select("key"))  # only texts that may have marks are shuffled to them
    keyed, kind = plain.withColumn("key", F.xxhash64("id", "text")), docs.schema[id_col].dataType.simpleString()
    made = f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    met = keyed.mapInPandas(_let_through(keys, True), f"id {kind}, text string, key long").join(spans, "key", "left")
    cut = met.select("id", "text", "spans").mapInPandas(_cut, made).unionByName(keyed.mapInPandas(_let_through(keys, False), made))
    return cut.withColumnRenamed("id", id_col)
