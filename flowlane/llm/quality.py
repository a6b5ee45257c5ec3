"""Quality score by a generalised additive model with pairwise interactions.

Every feature of a text is cut into bins. Boosting goes through the features in
turn, again and again: each turn fits a tree of depth two to what is still
unexplained, on one feature alone, and adds it to that feature's table. Then pairs
of features whose bins explain the most of the remainder get two-way tables the same
way. What is left is one number per bin, so a score is a sum of looked-up numbers,
whatever the number of rounds.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlane.llm.common import free_name, hash_sample, held_out, ship

FIT_ROWS = 20_000   # bound of the labelled rows the tables are fitted on
BINS = 32
ROUNDS = 60         # times boosting goes through all features
PAIRS = 6
RATE = 0.15

FEATURES = ["log_chars", "log_words", "upper", "digits", "signs", "marks", "bars", "spaces", "word_length", "kinds",
            "top_word", "repeats", "lines", "line_kinds", "stops", "symbol_words"]

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in "!?"]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".,;:"]] = True
_SIGN = np.zeros(256, bool)
_SIGN[[ord(c) for c in "#$%&*@^~=<>{}[]\\/_+`"]] = True


def features(text: str | None) -> list[float]:
    """Shape and variety of a whole text, as in ``FEATURES``. A null text is empty."""
    raw = (text or "").encode("utf-8", "replace")
    signs = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = max(1, len(raw))
    words = raw.split()
    m = max(1, len(words))
    seen = Counter(words)
    lines = [x for x in raw.split(b"\n") if x]
    letters = max(1, n - int(signs[:65].sum()))
    repeats = sum(map(bytes.__eq__, words[1:], words[:-1])) if len(words) > 1 else 0
    return [np.log1p(len(raw)), np.log1p(len(words)), signs[_UPPER].sum() / letters, signs[_DIGIT].sum() / n,
            signs[_SIGN].sum() / n, signs[_MARK].sum() / m, signs[ord("|")] / m, (signs[32] + signs[10]) / n,
            (len(raw) - m) / m, len(seen) / m ** 0.9, max(seen.values(), default=0) / m, repeats / m,
            len(lines) / m, len(set(lines)) / max(1, len(lines)), signs[_STOP].sum() / m, signs[_SIGN].sum() / m]


def _cuts(column: np.ndarray) -> np.ndarray:
    return np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1]))


def _tree(grad: np.ndarray, hess: np.ndarray, leaf: float = 5.0, ridge: float = 1.0) -> np.ndarray:
    """The value of each bin under a tree of depth two over ordered bins, given the
    sums of gradients and curvatures per bin."""

    def split(a: int, b: int) -> int | None:
        g, h = np.cumsum(grad[a:b])[:-1], np.cumsum(hess[a:b])[:-1]
        if not len(g):
            return None
        g_all, h_all = grad[a:b].sum(), hess[a:b].sum()
        gain = g * g / (h + ridge) + (g_all - g) ** 2 / (h_all - h + ridge) - g_all ** 2 / (h_all + ridge)
        gain[(h < leaf * 1e-2) | (h_all - h < leaf * 1e-2)] = 0
        best = int(gain.argmax())
        return a + best + 1 if gain[best] > 1e-9 else None

    parts = [(0, len(grad))]
    for _ in range(2):
        at = [(a, split(a, b), b) for a, b in parts]
        parts = [p for a, s, b in at for p in ([(a, b)] if s is None else [(a, s), (s, b)])]
    out = np.empty(len(grad))
    for a, b in parts:
        out[a:b] = grad[a:b].sum() / (hess[a:b].sum() + ridge)
    return out


class AdditiveModel:
    """Bin edges, one table per feature, and tables of feature pairs."""

    def __init__(self, cuts: list[np.ndarray], base: float):
        self.cuts, self.base = cuts, base
        self.tables = [np.zeros(len(c) + 1) for c in cuts]
        self.pairs: list[tuple[int, int, np.ndarray]] = []

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, k], side="right") for k, c in enumerate(self.cuts)], axis=1)

    def raw(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.base)
        for k, t in enumerate(self.tables):
            out += t[bins[:, k]]
        for a, b, t in self.pairs:
            out += t[bins[:, a], bins[:, b]]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(self.bins(x)), -30, 30)))


def fit_tables(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """Cyclic boosting of the single tables, then of the chosen pairs'."""
    share = min(max(y.mean() if len(y) else 0.5, 1e-3), 1 - 1e-3)
    model = AdditiveModel([_cuts(x[:, k]) if len(x) else np.empty(0) for k in range(x.shape[1])],
                          float(np.log(share / (1 - share))))
    if not 0 < y.sum() < len(y):
        return model
    bins = model.bins(x)
    raw = model.raw(bins)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-raw))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for k, t in enumerate(model.tables):
            g, h = slopes()
            step = RATE * _tree(np.bincount(bins[:, k], g, len(t)), np.bincount(bins[:, k], h, len(t)))
            t += step
            raw += step[bins[:, k]]
    g, h = slopes()

    def cell(a: int, b: int) -> np.ndarray:
        return bins[:, a] * len(model.tables[b]) + bins[:, b]

    def gain(a: int, b: int) -> float:
        n = len(model.tables[a]) * len(model.tables[b])
        return float((np.bincount(cell(a, b), g, n) ** 2 / (np.bincount(cell(a, b), h, n) + 5)).sum())

    chosen = sorted(combinations(range(x.shape[1]), 2), key=lambda p: -gain(*p))[:PAIRS]
    model.pairs = [(a, b, np.zeros((len(model.tables[a]), len(model.tables[b])))) for a, b in chosen]
    for _ in range(ROUNDS // 4):
        for a, b, t in model.pairs:
            g, h = slopes()
            sums_g = np.bincount(cell(a, b), g, t.size).reshape(t.shape)
            sums_h = np.bincount(cell(a, b), h, t.size).reshape(t.shape)
            # depth two over a pair: one cut on each feature
            rows, cols = _tree(sums_g.sum(1), sums_h.sum(1)), _tree(sums_g.sum(0), sums_h.sum(0))
            step = np.zeros(t.shape)
            row_part, col_part = np.cumsum(np.diff(rows, prepend=rows[:1]) != 0), np.cumsum(
                np.diff(cols, prepend=cols[:1]) != 0)
            for r in np.unique(row_part):
                for c in np.unique(col_part):
                    box = np.ix_(row_part == r, col_part == c)
                    step[box] = RATE * sums_g[box].sum() / (sums_h[box].sum() + 1)
            t += step
            raw += step[bins[:, a], bins[:, b]]
    return model


def _matrix(texts: list[str | None]) -> np.ndarray:
    return np.array([features(t) for t in texts], float).reshape(len(texts), len(FEATURES))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> AdditiveModel:
    """Fit on at most ``FIT_ROWS`` labelled ids: of those that ``labels`` (doc_id, quality)
    marks and that are not held out, the ones with the smallest hashes. That table has a
    fixed size, so it goes to the texts, not the texts to it. Without rows of both labels
    every text gets the same score."""
    ship(docs.sparkSession)
    marks = hash_sample(labels.where("quality in (0, 1) and doc_id is not null").where(~held_out())
                        .groupBy("doc_id").agg(F.max("quality").alias("quality")),
                        F.xxhash64("doc_id"), FIT_ROWS, "doc_id")
    rows = (docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
            .join(F.broadcast(marks), "doc_id"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(c) for c in x.T]],
                                             names=["doc_id", "quality", *FEATURES])

    measured = rows.select(F.col("doc_id").cast("long"), F.col("quality").cast("int"), "text").mapInArrow(
        measure, "doc_id long, quality int, " + ", ".join(f"{f} double" for f in FEATURES))
    got = measured.orderBy(F.xxhash64("doc_id"), "doc_id", *FEATURES).limit(FIT_ROWS).toPandas()
    return fit_tables(got[FEATURES].to_numpy(float), got["quality"].to_numpy(float))


def scored(model: AdditiveModel, text: Column) -> Column:
    """The model's score of a text column, 0 to 1."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.scores(_matrix(texts.tolist())))

    return score(text)


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.3,
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    A null text is scored as an empty one. Rows with a null id are scored and count as
    held out; repeated rows are scored each. Other columns are not read; an empty table
    gives no rows.
    """
    model = fit(docs, labels, id_col, text_col)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return (rows.withColumn("score", scored(model, F.col("text")))
            .select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3,
              id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, with all their columns,
    whatever these are called. Rows with a null id and repeated rows are each judged by
    their text; a null text counts as empty. An empty table gives no rows."""
    model = fit(docs, labels, id_col, text_col)
    mark = free_name(docs, "quality")
    return (docs.withColumn(mark, scored(model, F.col(f"`{text_col}`").cast("string")))
            .where(F.col(mark) >= threshold).drop(mark))
