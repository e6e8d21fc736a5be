"""Toxicity by a factorization machine over hashed terms.

A document is the set of its hashed terms: its words, and the beginnings of words, which catch insults
that grammar lengthens. The machine learns a weight and a short vector for every hashed term that a few
labelled training rows hold, so that pairs of terms (an insult beside a mention of a group) score beyond
the sum of their weights. It is fitted on all of these rows: in each round tasks learn from blocks of
their rows, starting at the machine so far, and a term moves by the mean of the blocks' moves, each
weighted by the block's rows that hold the term. So what moves a rare term are the rows that hold it. A
term's own association with the label, counted over all labelled rows, sets the pace at which it learns.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, free_name, stored
from tessera.llm.sketch import PARTS, SCHEMA, add_counts, filter_bits, gathered, hash_filter, packed, passing, unpacked
from tessera.llm.texthash import buckets


@dataclass(frozen=True)
class Settings:
    hash_bits: int = 20
    #: The least labelled rows that hold a term; every such term has a weight and factors.
    least_rows: int = 5
    factors: int = 4
    #: Bytes of the word beginnings that are terms too.
    prefixes: tuple[int, ...] = (4, 5, 6, 7, 8)
    #: Rows that a task learns from at a time, and the rounds that the epochs are dealt to.
    block_rows: int = 4096
    rounds: int = 5
    epochs: int = 40
    batch: int = 256
    rate: float = 0.03
    #: What chi-square has to reach beside the most that chance gives, for half the pace.
    doubt: float = 4.0
    #: The factors of a term without association of its own still learn, at this share of the rate.
    least_pace: float = 0.004
    decay: float = 3e-4


def in_training(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 != 0


#: Moves are summed as whole numbers of this unit, so their order changes nothing.
_UNIT = 2.0**-14


def _held_by(settings: Settings):
    """The partition's share of how many rows, and how many ones among them, hold each term."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, ones = np.zeros((2, 1 << settings.hash_bits), np.uint32)
        for batch in batches:
            for y, t in zip(batch["y"], _terms(batch), strict=True):
                held[t] += np.uint32(1)
                if y:
                    ones[t] += np.uint32(1)
        yield pd.DataFrame(list(packed(np.stack([held, ones], 1))), columns=["part", "counts"])

    return run


def _hashed(wanted, settings: Settings):
    """Rows that the filter lets through, with their sorted hashed terms in place of the text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = filter_bits(wanted)
        for batch in batches:
            some = batch[passing(bits, batch["at"].to_numpy(np.int64))]
            terms = [zstandard.compress(np.diff(t, prepend=np.int32(0)).tobytes(), 1) for t in buckets(some["text"], settings.hash_bits, settings.prefixes)]
            yield pd.DataFrame({"id": some["id"], "at": some["at"], "terms": terms})

    return run


def _terms(rows: pd.DataFrame) -> Iterator[np.ndarray]:
    unpress = zstandard.ZstdDecompressor().decompress
    for t in rows["terms"]:
        yield np.cumsum(np.frombuffer(unpress(t), np.int32))


def labelled_terms(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, settings: Settings) -> DataFrame:
    """(at, y, terms) of training rows, stored. A filter lets through the texts whose id may have a label; only their terms are shuffled."""
    kind = docs.schema[id_col].dataType.simpleString()
    marks = labels.filter(F.col(id_col).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(id_col).alias("id")).agg((F.max(label) > 0).cast("int").alias("y"))
    texts = docs.filter(in_training(id_col)).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(id_col).alias("at"))
    near = texts.mapInPandas(_hashed(hash_filter(marks.select(F.xxhash64(F.col("id").cast(kind)))), settings), f"id {kind}, at long, terms binary")
    return stored(near.join(marks.hint("merge"), "id").select("at", "y", "terms"), "labelled")


class Rows:
    """Rows of 0 and 1 by the columns that hold a 1."""

    def __init__(self, columns: np.ndarray, lengths: np.ndarray, width: int):
        self.columns, self.lengths, self.width = columns, lengths, width
        self.heads = np.cumsum(lengths) - lengths

    def __getitem__(self, k: np.ndarray) -> Rows:
        n = self.lengths[k]
        at = np.repeat(self.heads[k] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return Rows(self.columns[at], n, self.width)


class Batch:
    """Some rows laid out for steps of learning: by row for the margins, by column for the gradients.

    Columns that the same rows of the batch hold (a word and its beginnings, all that one row alone holds) are one
    group: rows meet groups, and a group's part of a gradient is found once for its columns. A machine's own part
    is a table of the columns that the batch touches, each its weight and then its factors.
    """

    def __init__(self, rows: Rows, y: np.ndarray, weight: np.ndarray):
        self.n, self.y, self.weight = len(rows.lengths), y, weight
        low = np.argsort((rows.columns & 0xFFFF).astype(np.uint16), kind="stable")  # 16 bits at a time, which numpy sorts in linear time
        order = low[np.argsort((rows.columns >> 16).astype(np.uint16)[low], kind="stable")]
        row, by = np.repeat(np.arange(self.n, dtype=np.int32), rows.lengths)[order], rows.columns[order]
        starts = np.flatnonzero(np.diff(by, prepend=-1))
        size = np.diff(starts, append=len(by))
        self.touched = by[starts]
        self.alike, first = _alike(row, starts, size, np.random.default_rng(11).integers(0, 1 << 63, self.n, np.uint64))
        self.columns = np.flatnonzero(first)  # where each group's columns begin among alike
        self.of = np.empty(len(starts), np.int32)
        self.of[self.alike] = np.cumsum(first) - 1
        head, held = starts[self.alike[self.columns]], size[self.alike[self.columns]]
        self.starts = np.cumsum(held) - held
        self.row = row[np.repeat(head - self.starts, held) + np.arange(held.sum())]
        turned = np.argsort(self.row.astype(np.min_scalar_type(self.n)), kind="stable")
        self.group = np.repeat(np.arange(len(held), dtype=np.int32), held)[turned]
        lengths = np.bincount(self.row, minlength=self.n)
        self.full = np.flatnonzero(lengths)
        self.heads = (np.cumsum(lengths) - lengths)[self.full]

    def margin(self, bias: float, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Margins, and the sums of weights and factors, by row."""
        sums, squares = np.zeros((self.n, own.shape[1]), own.dtype), np.zeros(self.n, own.dtype)
        if len(self.full):
            own = own.take(self.alike, axis=0)
            grouped = np.add.reduceat(own, self.columns, axis=0), np.add.reduceat(own**2 @ _factors_of(own), self.columns)
            sums[self.full], squares[self.full] = (np.add.reduceat(x.take(self.group, axis=0), self.heads, axis=0) for x in grouped)
        return bias + sums[:, 0] + 0.5 * ((sums[:, 1:] ** 2).sum(1) - squares), sums

    def gradient(self, bias: float, own: np.ndarray) -> tuple[float, np.ndarray]:
        """Of the mean weighted log loss: for the bias, and for the touched columns."""
        margin, sums = self.margin(bias, own)
        g = (self.weight * (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - self.y) / self.n).astype(own.dtype)
        if not len(self.touched):
            return float(g.sum()), np.zeros_like(own)
        sums[:, 0] = 1
        grouped = np.add.reduceat((sums * g[:, None]).take(self.row, axis=0), self.starts, axis=0)
        grads = grouped.take(self.of, axis=0)
        grads -= own * (grouped[:, :1] * _factors_of(own)).take(self.of, axis=0)
        return float(g.sum()), grads


def _factors_of(own: np.ndarray) -> np.ndarray:
    """1 for each factor, 0 for the weight: whole rows times this are faster than parts of rows."""
    return (np.arange(own.shape[1]) > 0).astype(own.dtype)


def _alike(row: np.ndarray, starts: np.ndarray, size: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Columns in an order that brings those with the same rows together, and which of them begin a group.

    row: the sorted rows of column after column, each from its start on; marks: a random number for each row. Sums of
    marks bring columns together; whether two neighbours have the same rows is seen from the rows themselves.
    """
    if not len(starts):
        return starts, np.zeros(0, bool)
    named = np.add.reduceat(marks[row], starts)
    alike = np.argsort(named, kind="stable")
    first = np.ones(len(starts), bool)
    one, two = alike[:-1], alike[1:]
    near = np.flatnonzero((named[one] == named[two]) & (size[one] == size[two]))
    held = size[one[near]]
    heads = np.cumsum(held) - held
    place = np.arange(held.sum())
    differ = row[np.repeat(starts[one[near]] - heads, held) + place] != row[np.repeat(starts[two[near]] - heads, held) + place]
    if len(near):
        first[near + 1] = np.logical_or.reduceat(differ, heads)
    return alike, first


def fit_machine(x: Rows | np.ndarray, y: np.ndarray, s: Settings, start: tuple | None = None, share: float | None = None, epochs: int | None = None, pace: np.ndarray | None = None) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, weights and factors by Adam on the log loss of x (0/1), both labels weighing the same in all.

    A step moves the columns that its batch of rows holds. start: the machine to go on from; share: that of
    the ones among all labels, if y is a part of them; pace: each column's share of the rate.
    """
    rng = np.random.default_rng(7)
    if not isinstance(x, Rows):
        x = Rows(np.nonzero(x)[1], np.count_nonzero(x, axis=1), x.shape[1])
    bias, weights, factors = start or (0.0, np.zeros(x.width), rng.normal(0, 0.01, (x.width, s.factors)))
    p = np.concatenate([np.asarray(weights)[:, None], np.asarray(factors)], 1).astype(np.float32)
    m, u, b = np.zeros_like(p), np.zeros_like(p), [float(bias), 0.0, 0.0]
    whole = lambda table: table.view(f"V{4 * p.shape[1]}")[:, 0]  # rows as single values, which numpy puts in place faster
    share = np.clip(share if share is not None else y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share))
    pace = np.ones(x.width) if pace is None else pace
    rates = np.repeat((s.rate / 5 * np.maximum(pace, s.least_pace)).astype(np.float32)[:, None], p.shape[1], 1)
    rates[:, 0] = s.rate * pace
    order = rng.permutation(len(y))
    dealt = [Batch(x[k], y[k], weight[k]) for k in (order[at : at + s.batch] for at in range(0, len(y), s.batch))]
    step = 0
    for _ in range(epochs or s.epochs):
        for i in rng.permutation(len(dealt)):
            t = dealt[i].touched
            own = p.take(t, axis=0)
            of_bias, grads = dealt[i].gradient(b[0], own)
            step += 1
            grads += np.float32(s.decay) * own
            m1, u1 = m.take(t, axis=0), u.take(t, axis=0)
            m1 += np.float32(0.1) * (grads - m1)
            u1 += np.float32(0.001) * (grads * grads - u1)
            np.put(whole(m), t, whole(m1))
            np.put(whole(u), t, whole(u1))
            m1 *= rates.take(t, axis=0) / np.float32(1 - 0.9**step)
            np.sqrt(u1 / np.float32(1 - 0.999**step), out=u1)
            np.put(whole(p), t, whole(own - m1 / (u1 + np.float32(1e-8))))
            b[1], b[2] = 0.9 * b[1] + 0.1 * of_bias, 0.999 * b[2] + 0.001 * of_bias**2
            b[0] -= s.rate * (b[1] / (1 - 0.9**step)) / (np.sqrt(b[2] / (1 - 0.999**step)) + 1e-8)
    return b[0], p[:, 0].astype(float), p[:, 1:].astype(float)


@dataclass(frozen=True)
class Machine:
    settings: Settings
    slot: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray
    #: Where the training rows have only one label or none: the score of every text.
    always: float | None = None

    def score(self, texts) -> list[float]:
        if self.always is not None:
            return [self.always] * len(texts)
        out = []
        for k in buckets(texts, self.settings.hash_bits, self.settings.prefixes, self.slot):
            f = self.factors[k]
            margin = self.bias + self.weights[k].sum() + 0.5 * ((f.sum(0) ** 2).sum() - (f * f).sum())
            out.append(float(1 / (1 + np.exp(-np.clip(margin, -30, 30)))))
        return out


def train(docs: DataFrame, labels: DataFrame, label: str, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> Machine:
    """Learns from the rows of docs that labels has a label for and that in_training() admits.

    Rows with a null id or label are no training rows. All others count and teach; the driver gets sums by term.
    Where none of them has label 1 (no labels at all, for one) every text scores 0; where all have, 1.
    """
    known = labelled_terms(docs, labels, label, id_col, text_col, settings)
    n, pos = known.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if pos in (0, n):
        nothing = np.zeros(0, np.float32)
        return Machine(settings, nothing, 0.0, nothing, nothing, 1.0 if pos else 0.0)
    share = pos / n
    counts = unpacked(gathered(known.select("y", "terms").mapInPandas(_held_by(settings), SCHEMA), add_counts, 8 << settings.hash_bits), np.uint32).reshape(-1, 2)
    chosen = np.flatnonzero(counts[:, 0] >= settings.least_rows)
    slot = np.full(1 << settings.hash_bits, -1, np.int32)
    slot[chosen] = np.arange(len(chosen))
    size = -(-(len(chosen) + 1) // PARTS) * PARTS  # the last slot is the bias's
    bias, weights, factors = 0.0, np.zeros(size), np.random.default_rng(7).normal(0, 0.01, (size, settings.factors))
    pace = np.zeros(size)
    pace[: len(chosen)] = _pace(*counts[chosen].T.astype(float), share, settings.doubt)
    for _ in range(settings.rounds):
        shared = docs.sparkSession.sparkContext.broadcast((slot, bias, weights.astype(np.float32), factors.astype(np.float32), pace.astype(np.float32)))  # of a size that settings bound
        taught = known.mapInPandas(_taught(shared, settings, share), SCHEMA)
        moved = unpacked(gathered(taught, _add_moves, 8 * size * (settings.factors + 2)), np.int64).reshape(size, -1)
        mean = moved[:, 1:] * _UNIT / np.maximum(moved[:, :1], 1)
        bias, weights, factors = bias + float(mean[-1, 0]), weights + mean[:, 0], factors + mean[:, 1:]
        shared.destroy()
    discard(known)
    return Machine(settings, slot, bias, weights.astype(np.float32), factors.astype(np.float32))


def _pace(held: np.ndarray, pos: np.ndarray, share: float, doubt: float) -> np.ndarray:
    """How fast terms learn, 0 to 1, by what chi-square says of them beside the most that chance gives so many terms. No term's pace depends on another one's."""
    expected = held * share
    strength = (pos - expected) ** 2 / np.maximum(expected * (1 - share), 1e-9)
    return strength**2 / (strength**2 + (doubt * np.log(len(held) + 2)) ** 2)


def _taught(shared, settings: Settings, share: float):
    """Per slot, over the partition's blocks: the rows that hold it, and the sums over these of how its weight and factors moved."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slot, bias, weights, factors, pace = shared.value
        moved = np.zeros((len(weights), 2 + settings.factors), np.int64)

        def learn(rows: list) -> None:
            rows = sorted(rows, key=lambda r: (r[0], r[1], len(r[2]), r[2][:1].tolist()))
            lengths = np.array([len(t) for _, _, t in rows])
            cells = np.concatenate([t for _, _, t in rows])
            times = np.bincount(cells, minlength=len(weights))
            found = np.flatnonzero(times)
            times[found], held = np.arange(len(found)), times[found]
            columns = times[cells]
            was = weights[found].astype(float), factors[found].astype(float)
            b, w, v = fit_machine(Rows(columns, lengths, len(found)), np.array([y for _, y, _ in rows], float), settings, (bias, *was), share, -(-settings.epochs // settings.rounds), pace[found])
            moves = np.concatenate([(w - was[0])[:, None], v - was[1]], 1) * held[:, None]
            moved[found, 0] += held
            moved[found, 1:] += np.rint(moves / _UNIT).astype(np.int64)
            moved[-1, :2] += len(rows), round((b - bias) * len(rows) / _UNIT)

        rows: list = []
        for batch in batches:
            for at, y, t in zip(batch["at"], batch["y"], _terms(batch), strict=True):
                t = slot[t]
                rows.append((at, y, t[t >= 0]))
                if len(rows) == settings.block_rows:
                    learn(rows)
                    rows = []
        if rows:
            learn(rows)
        yield pd.DataFrame(list(packed(moved)), columns=["part", "counts"])

    return run


def _add_moves(rows: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(zstandard.decompress(x), np.int64) for x in rows["counts"])
    return pd.DataFrame({"part": [rows["part"].iloc[0]], "counts": [zstandard.compress(total.tobytes(), 1)]})


def score(docs: DataFrame, machine: Machine, text_col: str = "text") -> DataFrame:
    """docs with `score` from 0 to 1; null and empty texts get the bias alone. An old `score` is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # of a size that settings fix

    @F.pandas_udf("double")
    def of_text(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(texts))

    return docs.withColumn("score", of_text(text_col))


def compared(docs: DataFrame, labels: DataFrame, label: str, choices: list[Settings], id_col: str = "doc_id", text_col: str = "text") -> list[dict]:
    """For each of some settings: the rows it was judged on, wrong decisions at 0.5, and mean log loss.

    Only training rows are read: each of the remainders 1 to 4 of their ids' hash is left out of the fit in turn and
    scored. So a choice among settings learns nothing from the held-out rows. Rows with a null id or label don't count.
    """
    ids = F.crc32(F.col(id_col).cast("string").cast("binary")) % 5
    marks = labels.filter(F.col(id_col).isNotNull() & F.col(label).isNotNull()).groupBy(id_col).agg((F.max(label) > 0).cast("double").alias("__y"))
    out = []
    for settings in choices:
        rows, wrong, loss = 0, 0, 0.0
        for fold in range(1, 5):
            asked = docs.filter(ids == fold).select(id_col, text_col).join(marks, id_col)
            y, p = F.col("__y"), F.least(F.greatest("score", F.lit(1e-9)), F.lit(1 - 1e-9))
            sums = score(asked, train(docs.filter(ids != fold), labels, label, id_col, text_col, settings), text_col).agg(
                F.count("*"), F.coalesce(F.sum(((F.col("score") >= 0.5) != (y > 0)).cast("long")), F.lit(0)), F.coalesce(F.sum(-F.log(F.when(y > 0, p).otherwise(1 - p))), F.lit(0.0))).first()
            rows, wrong, loss = rows + sums[0], wrong + sums[1], loss + sums[2]
        out.append({"settings": settings, "rows": rows, "wrong": wrong, "log_loss": loss / rows if rows else None})
    return out


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs whose score stays below the threshold; nulls in any column are no reason to go. Without a toxic training row all stay."""
    own = free_name(docs, "score")
    scored = score(docs.withColumnRenamed("score", own), train(docs, labels, "toxic", id_col, text_col), text_col)
    return scored.filter(F.col("score") < threshold).drop("score").withColumnRenamed(own, "score").select(docs.columns)
