"""Alignment of two tokenizers over the same texts, by merging their token ends in lockstep.

1. A text becomes two sequences of tokens over the same bytes: those of a byte-level BPE (A), and those of
   a piece model (B). Texts whose tokens don't give the text back have none.
2. Many texts are merged at once. One state vector holds, for each text of a batch, where it stands in A
   and in B. A step emits a link for every text, between the two tokens it stands at, and moves the pointer
   of the token that ends first; where both end together it emits a cut and moves both. Texts that are
   done leave the vector. Long texts are taken as several lanes, from one common end to another.
3. Links are counted by text, and by task for the whole corpus; the tasks' counts are summed. Each text's
   links then meet the corpus counts: sent to all tasks where they are few enough, which their number
   says, else by a join.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import public_tokenizers
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import dealt, discard, stored

#: Bytes of text that are merged at once, and tokens of a lane.
MERGED, LANE = 1 << 21, 512
#: Pairs of ids whose counts are sent to all tasks: 20 bytes each.
SENT = 1 << 21
#: Pairs that a task counts before it hands them on.
_TALLY = 1 << 21
_B_BITS = 32


class Vocabulary:
    """Bytes and lengths of a tokenizer's ids, and its ids of texts."""

    def __init__(self, tokens: list[bytes], encode):
        self.tokens, self.encode = tokens, encode
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        digits = [str(i).encode() for i in range(len(tokens))]
        self.width = max(map(len, digits), default=1)
        self.digits = np.zeros((len(tokens), self.width + 1), np.uint8)
        for i, d in enumerate(digits):
            self.digits[i, : len(d)] = np.frombuffer(d, np.uint8)
        self.n_digits = np.array([len(d) for d in digits], np.int64)


@cache
def byte_vocabulary(path: str) -> Vocabulary:
    """Of a file of byte-level BPE ranks. Special tokens' strings are plain text, a space goes before the text."""
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        tokens[i] = token
    return Vocabulary(tokens, lambda texts: [own.encode_ordinary(" " + t) for t in texts])


@cache
def piece_vocabulary(path: str) -> Vocabulary:
    """Of a piece model, which puts a space before the text itself; U+2581 is a space and <0xHH> a byte."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    tokens = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        tokens.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode())
    return Vocabulary(tokens, lambda texts: model.encode(texts, num_threads=1))


def _lanes(ends_a: np.ndarray, ends_b: np.ndarray, lane: int) -> list[tuple[int, int]]:
    """(first A token, first B token) of each lane of a text: lanes begin behind common ends, `lane` A tokens apart or more."""
    starts, wish = [(0, 0)], np.arange(lane, len(ends_a), lane)
    if len(wish):
        b = np.searchsorted(ends_b, ends_a)
        common = np.flatnonzero(ends_b[np.minimum(b, len(ends_b) - 1)] == ends_a)
        cut = np.unique(common[np.searchsorted(common, wish - 1)])  # the last end is common
        starts += [(int(i) + 1, int(b[i]) + 1) for i in cut if i + 1 < len(ends_a)]
    return starts


def merged(ends_a: list[np.ndarray], ends_b: list[np.ndarray], lane: int = LANE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links and cuts of texts whose tokens of both kinds end at these offsets: link_a, link_b, cut_a, cut_b.

    Links are pairs of places in all texts' A tokens and B tokens, one behind the other; cut_a and cut_b say
    of each token whether it ends a group. The order of links is that of the steps.
    """
    base_a = np.cumsum([0, *map(len, ends_a)])
    base_b = np.cumsum([0, *map(len, ends_b)])
    all_a, all_b = (np.concatenate([np.empty(0, np.int64), *x]) for x in (ends_a, ends_b))
    at_a, at_b, stop_a = [], [], []
    for t, (ea, eb) in enumerate(zip(ends_a, ends_b, strict=True)):
        if len(ea):
            starts = _lanes(ea, eb, lane)
            at_a += [base_a[t] + a for a, _ in starts]
            at_b += [base_b[t] + b for _, b in starts]
            stop_a += [base_a[t] + a for a, _ in starts[1:]] + [base_a[t + 1]]
    a, b, stop = (np.array(x, np.int64) for x in (at_a, at_b, stop_a))
    cut_a, cut_b = np.zeros(len(all_a), bool), np.zeros(len(all_b), bool)
    links_a, links_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    while len(a):
        links_a.append(a)
        links_b.append(b)
        end_a, end_b = all_a[a], all_b[b]
        together = end_a == end_b
        cut_a[a[together]] = True
        cut_b[b[together]] = True
        a, b = a + (end_a <= end_b), b + (end_b <= end_a)
        going = a < stop
        if not going.all():
            a, b, stop = a[going], b[going], stop[going]
    return np.concatenate(links_a), np.concatenate(links_b), cut_a, cut_b


def _group_texts(ids_a, ids_b, cut_a, cut_b, docs_a, docs_b, va: Vocabulary, vb: Vocabulary) -> list[bytes]:
    """Each text's groups as a1,a2|b1;a3|b2,b3. docs_a, docs_b: how many tokens each text has."""
    group_a, group_b = (np.cumsum(c) - c for c in (cut_a, cut_b))
    n_groups = int(cut_a.sum())
    before_a = np.concatenate([[0], np.cumsum(np.bincount(group_a, minlength=n_groups))])
    before_b = np.concatenate([[0], np.cumsum(np.bincount(group_b, minlength=n_groups))])
    place_a = np.arange(len(ids_a)) + before_b[group_a]
    place_b = np.arange(len(ids_b)) + before_a[group_b + 1]
    width = max(va.width, vb.width) + 1
    out = np.zeros((len(ids_a) + len(ids_b), width), np.uint8)
    length = np.empty(len(out), np.int64)
    for ids, place, cut, v, last in ((ids_a, place_a, cut_a, va, ord("|")), (ids_b, place_b, cut_b, vb, ord(";"))):
        rows = np.zeros((len(ids), width), np.uint8)
        rows[:, : v.width + 1] = v.digits[ids]
        rows[np.arange(len(ids)), v.n_digits[ids]] = np.where(cut, last, ord(","))
        out[place], length[place] = rows, v.n_digits[ids] + 1
    flat = out.ravel()
    joined = flat[flat != 0].tobytes()
    ends = np.concatenate([[0], np.cumsum(length)])[np.cumsum([0, *(x + y for x, y in zip(docs_a, docs_b, strict=True))])]
    return [joined[x : max(x, y - 1)] for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def _tokens(texts: list[str], va: Vocabulary, vb: Vocabulary) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids of both kinds; none where they don't give the text back."""
    none = np.empty(0, np.int64)
    asked = [t for t in texts if t]
    found = iter(zip(asked, va.encode(asked), vb.encode(asked), strict=True))
    for t in texts:
        if not t:
            yield none, none
            continue
        _, a, b = next(found)
        whole = b" " + t.encode("utf-8", "surrogatepass")
        same = b"".join(map(va.tokens.__getitem__, a)) == whole == b"".join(map(vb.tokens.__getitem__, b))
        yield (np.array(a, np.int64), np.array(b, np.int64)) if same else (none, none)


def _chunks(texts: list[str], most: int) -> Iterator[slice]:
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size > most:
            yield slice(at, i + 1)
            at, size = i + 1, 0
    if at < len(texts):
        yield slice(at, len(texts))


def aligned(texts: list[str | None], va: Vocabulary, vb: Vocabulary, lane: int = LANE) -> tuple[pd.DataFrame, list[np.ndarray], list[np.ndarray]]:
    """Per text n_a, n_b, n_groups, n_links and groups_sha256, and its distinct pairs of ids (A's in the upper half) with how many links have them."""
    ids = list(_tokens(texts, va, vb))
    n_a, n_b = [len(a) for a, _ in ids], [len(b) for _, b in ids]
    ends = [(np.cumsum(va.lengths[a]), np.cumsum(vb.lengths[b])) for a, b in ids]
    link_a, link_b, cut_a, cut_b = merged([a for a, _ in ends], [b for _, b in ends], lane)
    ids_a, ids_b = (np.concatenate([np.empty(0, np.int64), *(x[i] for x in ids)]) for i in (0, 1))
    doc_a = np.repeat(np.arange(len(ids)), n_a)
    groups = np.bincount(doc_a[cut_a], minlength=len(ids))
    doc = doc_a[link_a]
    code = (ids_a[link_a] << _B_BITS) | ids_b[link_b]
    order = np.lexsort((code, doc))
    doc, code = doc[order], code[order]
    heads = np.flatnonzero((np.diff(doc, prepend=-1) != 0) | (np.diff(code, prepend=-1) != 0))
    times = np.diff(np.append(heads, len(doc)))
    cuts = np.searchsorted(doc[heads], np.arange(1, len(ids)))
    texts_of = _group_texts(ids_a, ids_b, cut_a, cut_b, n_a, n_b, va, vb)
    digests = [hashlib.sha256(x).hexdigest() if n else "" for x, n in zip(texts_of, n_a, strict=True)]
    frame = pd.DataFrame({"n_a": n_a, "n_b": n_b, "n_groups": groups, "n_links": np.bincount(doc, minlength=len(ids)), "groups_sha256": digests})
    return frame, np.split(code[heads], cuts), np.split(times, cuts)


def _summed(codes: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    codes, times = np.concatenate(codes), np.concatenate(times)
    found, at = np.unique(codes, return_inverse=True)
    return found, np.bincount(at, times, len(found)).astype(np.int64)


def _packed(code: np.ndarray, times: np.ndarray) -> tuple[bytes, bytes]:
    """A text's pairs: ids of 16 bits where they fit, counts beside them."""
    a, b = code >> _B_BITS, code & ((1 << _B_BITS) - 1)
    kind = "<u2" if not len(code) or max(int(a.max()), int(b.max())) < 1 << 16 else "<u4"
    return np.stack([a, b]).astype(kind).tobytes(), times.astype("<u4").tobytes()


def _unpacked(pairs: bytes, times: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = np.frombuffer(times, "<u4").astype(np.int64)
    a, b = np.frombuffer(pairs, "<u2" if len(pairs) == 4 * len(n) else "<u4").astype(np.int64).reshape(2, -1)
    return (a << _B_BITS) | b, n


def _align(path_a: str, path_b: str):
    names = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def tally(found: np.ndarray, n: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"code": found, "n": n})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        va, vb, part, row = byte_vocabulary(path_a), piece_vocabulary(path_b), TaskContext.get().partitionId(), 0
        total: tuple = ([], [])
        for batch in batches:
            texts = [t if isinstance(t, str) else None for t in batch["text"]]
            for some in _chunks(texts, MERGED):
                frame, codes, times = aligned(texts[some], va, vb)
                frame.insert(0, "id", batch["id"].iloc[some].to_numpy())
                frame["row"] = (part << 33) + row + np.arange(len(frame))
                row += len(frame)
                packed = [_packed(c, t) for c, t in zip(codes, times, strict=True)]
                frame["pairs"], frame["times"] = [p for p, _ in packed], [t for _, t in packed]
                yield frame
                total[0].extend(codes)
                total[1].extend(times)
                if sum(map(len, total[0])) > _TALLY:
                    found, n = _summed(*total)
                    if 2 * len(found) > _TALLY:
                        yield tally(found, n)
                        total = ([], [])
                    else:
                        total = ([found], [n])
        if total[0]:
            yield tally(*_summed(*total))

    def filled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in run(batches):
            every = ["id", *names, "row", "pairs", "times", "code", "n"]
            yield frame.assign(**{c: pd.Series([None] * len(frame), dtype=object) for c in every if c not in frame})[every]

    return filled


def _weighed(shared):
    """Per text its links whose pair is its B id's most frequent, and the sum of its links' counts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes, n, best = (np.frombuffer(x, t) for x, t in zip(shared.value, (np.int64, np.int64, bool), strict=True))
        for batch in batches:
            n_best, sums = [], []
            for pairs, times in zip(batch["pairs"], batch["times"], strict=True):
                code, links = _unpacked(pairs, times)
                at = np.searchsorted(codes, code)
                n_best.append(int(links[best[at]].sum()))
                sums.append(int((links * n[at]).sum()))
            yield batch.drop(columns=["pairs", "times"]).assign(n_best=n_best, count_sum=sums)

    return run


def _exploded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for row, pairs, times in zip(batch["row"], batch["pairs"], batch["times"], strict=True):
            code, links = _unpacked(pairs, times)
            yield pd.DataFrame({"row": row, "code": code, "links": links})


def align(docs: DataFrame, byte_ranks: str | None = None, piece_model: str | None = None, id_col: str = "doc_id", text_col: str = "text", sent: int = SENT) -> DataFrame:
    """Per row of docs: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Null and empty texts and those that the tokens don't give back have zeros and ''. Rows with null or equal
    ids are documents of their own. sent: pairs of ids, at most, whose counts go to all tasks.
    """
    path_a, path_b = byte_ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), piece_model or public_tokenizers.path("piece_bpe_32k.model")
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, row long, pairs binary, times binary, code long, n long"
    made = stored(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(_align(path_a, path_b), schema), "aligned")
    texts = made.filter("row IS NOT NULL").drop("code", "n")
    pairs = stored(made.filter("row IS NULL").groupBy("code").agg(F.sum("n").alias("n")), "pairs")
    b = F.col("code").bitwiseAND(F.lit((1 << _B_BITS) - 1))
    most = pairs.groupBy(b.alias("b")).agg(F.max("n").alias("most"))
    counts = stored(pairs.withColumn("b", b).join(most, "b").select("code", "n", (F.col("n") == F.col("most")).alias("best")), "counts")
    columns = [F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    if counts.count() <= sent:
        table = counts.orderBy("code").toPandas()
        shared = spark.sparkContext.broadcast(tuple(table[c].to_numpy(t).tobytes() for c, t in (("code", np.int64), ("n", np.int64), ("best", bool))))
        weighed = texts.mapInPandas(_weighed(shared), f"id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, row long, n_best long, count_sum long")
        return weighed.select(*columns)
    links = stored(texts.select("row", "pairs", "times").mapInPandas(_exploded, "row long, code long, links long"), "links")
    salted, copies = dealt(links, "code")
    met = salted.join(copies(counts), ["code", "__salt"])
    weight = met.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("n_best"), F.sum(F.col("links") * F.col("n")).alias("count_sum"))
    weighed = texts.drop("pairs", "times").join(weight, "row", "left").fillna(0, ["n_best", "count_sum"])
    discard(pairs)
    return weighed.select(*columns)
