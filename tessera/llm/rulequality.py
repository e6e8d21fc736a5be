"""Quality by a sparse rule ensemble that scores as one Spark column expression.

Statistics of a text are column expressions. Shallow boosted trees over a bounded sample of labelled
rows propose their paths as conjunctive rules; a lasso logistic fit gives most of them the weight 0;
the others become sums of weighted comparisons that Spark evaluates over all rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded_sample, let
from tessera.llm.toxicity import in_training


@dataclass(frozen=True)
class Settings:
    #: Bound on the labelled rows that trees and weights are fitted on, the first by hash of their id.
    fit_rows: int = 20_000
    trees: int = 40
    depth: int = 3
    bins: int = 32
    shrink: float = 0.2
    least_rows: int = 10
    penalty: float = 5e-4
    rounds: int = 400


def statistics(text: Column) -> dict[str, Column]:
    """The statistics of a text; null counts as empty, and shares of nothing are 0."""
    text = F.coalesce(text, F.lit(""))
    chars = F.char_length(text).cast("double")
    words = F.split(F.btrim(text), r"\s+")
    n = F.size(words).cast("double")
    lines = F.split(text, "\n")
    counted = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("double")
    share = lambda values: let(values, lambda v: F.size(F.array_distinct(v)) / F.size(v))
    return {
        "words": n,
        "word_chars": chars / n,
        "capital_words": counted(r"\p{Lu}{2,}") / n,
        "symbol_runs": counted(r"[^\p{L}\p{N}\s]+") / n,
        "odd_symbols": counted(r"[#$%&*|<>=@^~\\{}]") / n,
        "exclamations": counted("!") / n,
        "digit_runs": counted(r"\p{N}+") / n,
        "sentence_ends": counted(r"[.!?](?:\s|$)") / n,
        "repeated_words": counted(r"(?<!\S)(\S+)(?= \1(?!\S))") / n,
        "distinct_words": share(words),
        "distinct_lines": share(lines),
        "line_words": n / F.size(lines),
        "wide_chars": (F.octet_length(text) - chars) / F.greatest(chars, F.lit(1.0)),
    }


NAMES = [
    "words", "word_chars", "capital_words", "symbol_runs", "odd_symbols", "exclamations", "digit_runs", "sentence_ends",
    "repeated_words", "distinct_words", "distinct_lines", "line_words", "wide_chars",
]

#: A rule: comparisons (statistic, above, threshold) that all hold.
Rule = tuple[tuple[int, bool, float], ...]


def _tree(codes: np.ndarray, edges: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, s: Settings) -> tuple[list[Rule], np.ndarray]:
    """One tree's paths, inner ones too, and its output for every row of codes."""
    out = np.zeros(len(codes))
    rules: list[Rule] = []

    def grow(rows: np.ndarray, every: np.ndarray, path: Rule) -> None:
        if path:
            rules.append(path)
        best = (1e-6, None, None)
        if len(path) < s.depth and len(rows) >= 2 * s.least_rows:
            total_g, total_h = grad[rows].sum(), hess[rows].sum()
            for f in range(codes.shape[1]):
                if not len(edges[f]):
                    continue
                g = np.cumsum(np.bincount(codes[rows, f], grad[rows], len(edges[f]) + 1))[:-1]
                h = np.cumsum(np.bincount(codes[rows, f], hess[rows], len(edges[f]) + 1))[:-1]
                n = np.cumsum(np.bincount(codes[rows, f], minlength=len(edges[f]) + 1))[:-1]
                gain = g**2 / (h + 1) + (total_g - g) ** 2 / (total_h - h + 1) - total_g**2 / (total_h + 1)
                gain[(n < s.least_rows) | (len(rows) - n < s.least_rows)] = -1
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], f, k)
        _, f, k = best
        if f is None:
            out[every] = -grad[rows].sum() / (hess[rows].sum() + 1)
            return
        cut = float(edges[f][k])
        for above in (False, True):
            grow(rows[(codes[rows, f] > k) == above], every[(codes[every, f] > k) == above], (*path, (f, above, cut)))

    grow(rows, np.arange(len(codes)), ())
    return rules, out


def propose(x: np.ndarray, y: np.ndarray, s: Settings) -> list[Rule]:
    """The distinct paths of boosted trees."""
    rng = np.random.default_rng(5)
    edges = [np.unique(np.quantile(column, np.linspace(0, 1, s.bins + 1)[1:-1])) for column in x.T]
    codes = np.stack([np.searchsorted(e, column, side="left") for e, column in zip(edges, x.T, strict=True)], 1)
    margin, found = np.zeros(len(y)), {}
    for _ in range(s.trees):
        p = 1 / (1 + np.exp(-margin))
        rows = np.flatnonzero(rng.random(len(y)) < 0.5)
        rules, out = _tree(codes, edges, p - y, p * (1 - p), rows, s)
        margin += s.shrink * out
        for r in rules:
            found.setdefault(tuple(sorted(r)), r)
    return list(found.values())


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    return np.logical_and.reduce([(x[:, f] > cut) == above for f, above, cut in rule])


def lasso(r: np.ndarray, y: np.ndarray, s: Settings) -> tuple[float, np.ndarray]:
    """Bias and weights by accelerated proximal gradient steps on the mean log loss + penalty * |weights|."""
    r = r.astype(np.float64)
    n = max(1, len(y))
    v = np.ones(r.shape[1] + 1)
    for _ in range(20):  # the curvature's bound, by power iteration
        u = r.T @ (r @ v[1:] + v[0])
        v = np.concatenate([[(r @ v[1:] + v[0]).sum()], u])
        norm = np.linalg.norm(v) or 1.0
        v /= norm
    step = 4 * n / norm
    w = np.zeros(r.shape[1] + 1)
    ahead, t = w.copy(), 1.0
    for _ in range(s.rounds):
        d = 1 / (1 + np.exp(-np.clip(r @ ahead[1:] + ahead[0], -30, 30))) - y
        new = ahead - step * np.concatenate([[d.sum()], r.T @ d]) / n
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * s.penalty, 0)
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = new + (t - 1) / after * (new - w), new, after
    return float(w[0]), w[1:]


@dataclass(frozen=True)
class Ensemble:
    bias: float
    rules: list[tuple[float, Rule]]

    def column(self, prefix: str = "__s_") -> Column:
        """The score of a row that has the statistics as columns of their names behind the prefix."""
        margin = F.lit(self.bias)
        for weight, rule in self.rules:
            tests = [F.col(prefix + NAMES[f]) > cut if above else F.col(prefix + NAMES[f]) <= cut for f, above, cut in rule]
            test = tests[0]
            for more in tests[1:]:
                test = test & more
            margin = margin + F.when(test, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-margin))


def _measured(docs: DataFrame, text_col: str, prefix: str = "__s_") -> DataFrame:
    return docs.withColumns({prefix + name: value for name, value in statistics(F.col(text_col)).items()})


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> Ensemble:
    """Learns from the rows of docs that labels has a label for and that in_training() admits; none: a score of 0.5."""
    marks = labels.filter(F.col(id_col).isNotNull() & F.col(label).isNotNull()).groupBy(id_col).agg((F.max(label) > 0).cast("double").alias("__y"))
    plain = docs.filter(in_training(id_col)).select(id_col, text_col)
    about = plain.select(id_col).join(marks.select(id_col), id_col).count()
    measured = _measured(plain, text_col).drop(text_col)
    sample = bounded_sample(measured.join(marks, id_col), F.xxhash64(id_col), settings.fit_rows, about)
    rows = sample.select("__y", *(f"__s_{n}" for n in NAMES)).collect()
    table = np.array([list(r) for r in rows], float).reshape(-1, len(NAMES) + 1)
    x, y = table[:, 1:], table[:, 0]
    if not len(y):
        return Ensemble(0.0, [])
    rules = propose(x, y, settings)
    if not rules:
        return Ensemble(float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))), [])
    bias, weights = lasso(np.stack([holds(r, x) for r in rules], 1), y, settings)
    return Ensemble(bias, [(float(w), r) for w, r in zip(weights, rules, strict=True) if w])


def score(docs: DataFrame, ensemble: Ensemble, text_col: str = "text") -> DataFrame:
    """docs with `score` from 0 to 1; null and empty texts get one too. An old `score` is replaced."""
    prefix = "__s_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    return _measured(docs, text_col, prefix).withColumn("score", ensemble.column(prefix)).drop(*(prefix + n for n in NAMES))
