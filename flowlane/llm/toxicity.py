"""Toxicity by class-conditional Kneser-Ney models.

Two models of letters within words are kept, one of toxic and one of ordinary
documents. A letter's probability after the four before it is the class's own
discounted count; what the discount frees goes to shorter contexts, whose
continuation counts (in how many different places a letter group occurs) both
classes share. So an expression that is rare in a class is judged by what all
documents show, and only what a class has really been seen to do tells them apart.

A word's evidence is its toxic less its ordinary log-likelihood. A document's
evidence is that of its strongest words and the difference of its two
length-normalised log-likelihoods (per letter); a logistic curve fitted on labelled rows that gave no counts turns it
into a score.

Counts come from all labelled rows, gathered as partial counts per task and summed
by Spark. Each group's counts are kept under its 64-bit hash, so the model grows with
the number n of different groups, and two of them share counts with a probability of
n^2 / 2^65. Tasks write it in pieces, by ranges of the hash, to the shared folder; the
pieces become files of the job, which the tasks that score memory-map. A worker keeps
the evidence of the words it has met, a bounded number of them, from batch to batch.
"""

from __future__ import annotations

import math
import os
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlane.llm.common import free_name, give_back, hash_sample, held_out, place, ship, work_folder, written

ORDER = 5            # letters in a group: four of context and one
DISCOUNT = 0.75
LETTERS = 256        # assumed size of the alphabet for the uniform end of the chain
TOP = 3              # strongest words that count one by one
TOXIC_WEIGHT = 2.0   # of a toxic row against an ordinary one in the fit of the curve
PIECE_ROWS = 1 << 17  # about the rows of the counts in one file
CACHED = 200_000     # words whose evidence a worker keeps
COUNTED = 60_000     # different words whose groups are counted at a time
LOT = 500_000        # characters of the texts that are scored at a time
SLICE = 100_000      # letter groups that are looked at at a time
CALIBRATION_ROWS = 20_000  # bound of the labelled rows the logistic curve is fitted on, half of them for each class

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def split_words(text: str | None) -> list[str]:
    """Lower-case words, cut at white space and stripped of signs at their ends."""
    return [w for w in (x.strip(SIGNS) for x in (text or "").lower().split()) if w]


SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»“”„‘’¿¡…–—"


def letters(words: list[str], some: int = SLICE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All positions of all words, a slice of them at a time, as rows of ORDER code
    points (1 before a word, 2 after it), and the word each row belongs to."""
    n = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer("".join(words).encode("utf-32-le", "replace"), np.uint32)
    width = n + ORDER           # ORDER - 1 starts, the letters, one end
    ends = np.cumsum(width)
    line = np.ones(int(width.sum()), np.uint32)
    line[ends - 1] = 2
    line[np.arange(len(flat)) + np.repeat(ORDER * np.arange(len(words)) + ORDER - 1, n)] = flat
    # a group starts wherever ORDER places of the same word follow
    word = np.repeat(np.arange(len(words)), n + 1)
    for k in range(0, len(word), some):
        w = word[k:k + some]
        start = np.arange(k, k + len(w)) + (ORDER - 1) * w
        yield line[start[:, None] + np.arange(ORDER)], w


def keys(groups: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row's code points."""
    h = np.full(len(groups), groups.shape[1], np.uint64)
    for c in range(groups.shape[1]):
        h = (h ^ groups[:, c].astype(np.uint64)) * MULTIPLIER
        h ^= h >> np.uint64(29)
    return h


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(group, ordinary, toxic): how often letter groups occur in the task's rows, to be
    added up."""

    def flush(seen: list[Counter]) -> Iterator[pa.RecordBatch]:
        for label, words in enumerate(seen):
            times = np.fromiter(words.values(), np.int64, len(words))
            for groups, word in letters(list(words)):
                _, first, kind = np.unique(keys(groups), return_index=True, return_inverse=True)
                sums = np.bincount(kind, weights=times[word]).astype(np.int64)
                cells = pa.FixedSizeBinaryArray.from_buffers(
                    pa.binary(4 * ORDER), len(first), [None, pa.py_buffer(np.ascontiguousarray(groups[first]).tobytes())])
                counts = [pa.array(sums if c == label else np.zeros_like(sums)) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([cells.cast(pa.binary()), *counts], names=["group", "ordinary", "toxic"])

    seen = [Counter(), Counter()]
    for b in batches:
        for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            seen[label].update(split_words(text))
            if len(seen[0]) + len(seen[1]) > COUNTED or len(text or "") > LOT:
                yield from flush(seen)
                seen = [Counter(), Counter()]
    yield from flush(seen)
    del seen
    give_back()


class Model:
    """Counts by 64-bit hash of the group, in a file: for each table its sorted hashes
    and its columns. ``own`` by class, and by class of its contexts their sum and
    ``kinds`` (different letters after them); ``shared[k]`` and its contexts for the
    orders below."""

    TABLES = {"own": ("own0", "own1"), "own_context": ("context0_own", "context1_own", "kinds0_own", "kinds1_own")} | {
        n: c for k in range(1, ORDER) for n, c in ((f"shared{k}", (f"shared{k}",)), (f"context{k}", (f"context{k}", f"kinds{k}")))}

    def __init__(self, paths: list[str | None]):
        """``paths``: a power of two of files, by ascending range of the hash; None: an
        empty range."""
        self.bits = (len(paths) - 1).bit_length()
        self.keys: dict[str, list] = {n: [] for n in self.TABLES}
        self.tables: dict[str, list] = {c: [] for columns in self.TABLES.values() for c in columns}
        for path in paths:
            whole = np.memmap(path, np.int64, "r") if path else np.zeros(len(self.TABLES), np.int64)
            sizes = whole[:len(self.TABLES)]
            at = len(sizes)
            for (name, columns), n in zip(self.TABLES.items(), sizes.tolist(), strict=True):
                self.keys[name].append(np.asarray(whole[at:at + n]))
                for c in columns:
                    at += n
                    self.tables[c].append(np.asarray(whole[at:at + n]).view(np.float64))
                at += n
        self.words: dict[str, int] = {}      # words met, and at their places
        self.sums, self.sizes = np.zeros(0), np.zeros(0)

    @classmethod
    def write(cls, counts: DataFrame) -> list[str | None]:
        """Write rows (part, key, v0 to v3) as files below the shared folder, one for
        each range of hashes; their paths, in order, None where there are no rows."""
        pieces = 1 << max(0, math.ceil(math.log2(max(1, counts.count()) / PIECE_ROWS)))
        folder = work_folder(counts.sparkSession, "letters")

        def save(key: tuple, t: pa.Table) -> pa.Table:
            part, hashes = t["part"].to_numpy(), t["key"].to_numpy()
            order = np.lexsort((hashes, part))
            cuts = np.searchsorted(part[order], np.arange(len(cls.TABLES) + 1))
            arrays = [np.diff(cuts).astype(np.int64)]
            for i, columns in enumerate(cls.TABLES.values()):
                here = order[cuts[i]:cuts[i + 1]]
                arrays += [hashes[here]] + [t[f"v{c}"].to_numpy()[here].view(np.int64) for c in range(len(columns))]
            store, path = place(folder)
            store.create_dir(path)
            name = f"letters-{uuid.uuid4().hex}.bin"  # an attempt that is repeated writes another file
            with store.open_output_stream(f"{path}/{name}") as f:
                for a in arrays:
                    f.write(np.ascontiguousarray(a).tobytes())
            return pa.table({"piece": pa.array([key[0].as_py()], pa.int64()), "path": [f"{folder}/{name}"]})

        shift = 64 - pieces.bit_length() + 1
        piece = (F.shiftright("key", shift) + pieces // 2) if pieces > 1 else F.lit(0).cast("long")
        got = counts.withColumn("piece", piece).groupBy("piece").applyInArrow(save, "piece long, path string").collect()
        paths = {r.piece: r.path for r in got}
        return [paths.get(i) for i in range(pieces)]

    def find(self, name: str, groups: np.ndarray) -> list[np.ndarray]:
        """The columns of table ``name`` at each row's group, 0 where it was never seen."""
        h = keys(groups).view(np.int64)
        piece = (h >> (64 - self.bits)) + (1 << self.bits >> 1) if self.bits else np.zeros(len(h), np.int64)
        out = [np.zeros(len(h)) for _ in self.TABLES[name]]
        order = np.argsort(piece, kind="stable")
        cuts = np.searchsorted(piece[order], np.arange(len(self.keys[name]) + 1))
        for p, have in enumerate(self.keys[name]):
            here = order[cuts[p]:cuts[p + 1]]
            if len(have) and len(here):
                at = np.minimum(np.searchsorted(have, h[here]), len(have) - 1)
                seen = have[at] == h[here]
                for o, c in zip(out, self.TABLES[name], strict=True):
                    o[here[seen]] = self.tables[c][p][at[seen]]
        return out

    def logs(self, groups: np.ndarray) -> np.ndarray:
        """Toxic less ordinary log-probability of each row's last letter."""
        low = np.full(len(groups), 1.0 / LETTERS)
        for k in range(1, ORDER):
            n, = self.find(f"shared{k}", groups[:, ORDER - k:])
            total, kinds = self.find(f"context{k}", groups[:, ORDER - k:-1])
            some = np.maximum(total, 1)
            p = np.maximum(n - DISCOUNT, 0) / some + DISCOUNT * kinds / some * low
            low = np.where(total > 0, p, low)
        own, context = self.find("own", groups), self.find("own_context", groups[:, :-1])
        out = []
        for label in (0, 1):
            total, kinds = context[label], context[2 + label]
            some = np.maximum(total, 1)
            p = (np.maximum(own[label] - DISCOUNT, 0) + DISCOUNT * kinds * low) / some
            out.append(np.log(np.maximum(np.where(total > 0, p, low), 1e-30)))
        return out[1] - out[0]

    def at(self, words: list[str]) -> np.ndarray:
        """The places of words in ``sums`` (a word's evidence) and ``sizes`` (its
        letters and end)."""
        new = [w for w in dict.fromkeys(words) if w not in self.words]
        if len(self.words) + len(new) > CACHED:
            new = list(dict.fromkeys(words))
            self.words, self.sums, self.sizes = {}, np.zeros(0), np.zeros(0)
        if new:
            sums = np.zeros(len(new))
            for groups, word in letters(new):
                first = int(word[0])
                part = np.bincount(word - first, self.logs(groups))
                sums[first:first + len(part)] += part
            self.words |= zip(new, range(len(self.words), len(self.words) + len(new)))
            self.sums = np.concatenate([self.sums, sums])
            self.sizes = np.concatenate([self.sizes, np.fromiter((len(w) + 1 for w in new), float, len(new))])
        return np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))

    def evidence(self, texts: Iterable[str | None]) -> np.ndarray:
        """For each text: its TOP strongest words' evidence, strongest first, and the
        difference of the log-likelihoods per letter. A text without words has zeros; one
        with fewer than TOP has its weakest word's, or 0 if that is more, in place of the
        rest."""
        out = []
        lot: list[list[str]] = []
        size = 0
        for t in texts:
            lot.append(split_words(t))
            size += len(t or "")
            if size > LOT:
                out.append(self._evidence(lot))
                lot, size = [], 0
        return np.concatenate([*out, self._evidence(lot)])

    def _evidence(self, split: list[list[str]]) -> np.ndarray:
        at = self.at([w for s in split for w in s])
        sums, sizes = self.sums[at], self.sizes[at]
        ends = np.cumsum([0, *map(len, split)])
        out = np.zeros((len(split), TOP + 1))
        for i, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
            if a < b:
                e = sums[a:b]
                e = np.sort(e if b - a <= TOP else np.partition(e, b - a - TOP)[b - a - TOP:])[::-1]
                out[i, :len(e)] = e
                out[i, len(e):TOP] = min(0.0, e[-1])
                out[i, TOP] = sums[a:b].sum() / sizes[a:b].sum()
        return out


def fit_counts(labelled: DataFrame) -> tuple[str | None, ...]:
    """The model of rows (text, toxic): every row is counted. The names of its files
    among the job's files, None for an empty range."""
    groups = written(labelled.select(F.col("text").cast("string"), F.col("toxic").cast("int")).mapInArrow(
        _count, "group binary, ordinary long, toxic long").groupBy("group").agg(
            F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic")), "groups")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The hashes of each group and of its context, for the whole and for the shared
        orders below."""
        for b in batches:
            g = np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint32).reshape(-1, ORDER)
            columns = [pa.array(keys(g).view(np.int64)), pa.array(keys(g[:, :-1]).view(np.int64)), b.column(1), b.column(2)]
            for k in range(1, ORDER):
                columns += [pa.array(keys(g[:, ORDER - k:]).view(np.int64)), pa.array(keys(g[:, ORDER - k:-1]).view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["g", "c", "ordinary", "toxic"] + [f"{x}{k}" for k in range(1, ORDER) for x in ("g", "c")]
    h = written(groups.mapInArrow(hashed, ", ".join(f"{n} long" for n in names)), "hashed")
    tables: dict[str, DataFrame] = {
        "own": h.groupBy(F.col("g").alias("key")).agg(F.sum("ordinary"), F.sum("toxic")),
        "own_context": h.groupBy(F.col("c").alias("key")).agg(
            F.sum("ordinary"), F.sum("toxic"), F.count_if(F.col("ordinary") > 0), F.count_if(F.col("toxic") > 0))}
    kinds = h
    for k in range(ORDER - 1, 0, -1):
        # continuation count of a group: different letters seen before it, that is different groups longer by one
        below = [f"{x}{i}" for i in range(1, k + 1) for x in ("g", "c")]
        kinds = written(kinds.groupBy(*below).agg(F.count(F.lit(1)).alias("n")), "continuations")
        tables[f"shared{k}"] = kinds.select(F.col(f"g{k}").alias("key"), "n")
        tables[f"context{k}"] = kinds.groupBy(F.col(f"c{k}").alias("key")).agg(F.sum("n"), F.count(F.lit(1)))
    counts = None
    for i, name in enumerate(Model.TABLES):
        key, *columns = tables[name].columns
        filled = [F.col(f"`{c}`").cast("double") for c in columns] + [F.lit(0.0)] * (4 - len(columns))
        rows = tables[name].select(F.lit(i).alias("part"), key, *[c.alias(f"v{j}") for j, c in enumerate(filled)])
        counts = rows if counts is None else counts.union(rows)
    paths = Model.write(written(counts, "counts"))
    for path in filter(None, paths):
        labelled.sparkSession.sparkContext.addFile(path)
    return tuple(path and os.path.basename(path) for path in paths)


_OPEN: dict[tuple[str | None, ...], Model] = {}


def _opened(names: tuple[str | None, ...]) -> Model:
    """The model of these files; a worker keeps the last one only, with its words."""
    if names not in _OPEN:
        _OPEN.clear()
        _OPEN[names] = Model([n and SparkFiles.get(n) for n in names])
    return _OPEN[names]


def fit_curve(x: np.ndarray, y: np.ndarray, times: np.ndarray | float = 1.0, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic curve (the last one is the constant) by Newton steps; each
    row counts ``times``."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    weight = np.where(y == 1, TOXIC_WEIGHT, 1.0) * times
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, x.T @ (weight * (y - p)) - ridge * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


class Scorer:
    """A fitted model, by the names of its files among the job's files, with its curve."""

    def __init__(self, name: tuple[str | None, ...], weights: np.ndarray):
        self.name, self.weights = name, weights

    @property
    def model(self) -> Model:
        return _opened(self.name)

    def column(self, text: Column) -> Column:
        """The score of a text column, 0 to 1."""
        name, weights = self.name, self.weights

        @F.pandas_udf("double")
        def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                x = _opened(name).evidence(texts.tolist())
                yield pd.Series(1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30))))
            give_back()

        return score(text)


def among(ids: DataFrame, bits: int = 1 << 25):
    """A test for a column of ids that every id in ``ids`` (doc_id) passes and, while
    they are fewer than its bits, most others do not: a hashed bitmap of ``bits`` bits,
    whatever the number of ids."""
    place = F.xxhash64("doc_id").bitwiseAND(F.lit(bits - 1))
    got = (ids.select(F.shiftright(place, 6).alias("w"), (place % 64).cast("int").alias("b"))
           .groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("m")).toPandas())
    bitmap = np.zeros(bits // 64, np.uint64)
    bitmap[got["w"].to_numpy(np.int64)] = got["m"].to_numpy(np.int64).view(np.uint64)
    sent = ids.sparkSession.sparkContext.broadcast(bitmap)

    @F.pandas_udf("boolean")
    def passes(at: pd.Series) -> pd.Series:
        at = at.to_numpy(np.int64)
        return pd.Series(sent.value[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1) != 0)

    return passes(place)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Scorer:
    """Fit on the rows of ``docs`` that ``labels`` (doc_id, toxic) marks and that are
    not held out. Four fifths of them give the counts, of the rest at most
    ``CALIBRATION_ROWS`` the curve, drawn by class. A class of two ids or more is in both
    parts. Where the rest lacks a class, the two length-normalised likelihoods are
    compared as they are. Without rows of both classes every text scores 0.
    """
    ship(docs.sparkSession)
    marks = (labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    marks = marks.where(~held_out())
    # only texts that may be labelled are shuffled to their labels, at any size alike
    rows = (docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
            .where("doc_id is not null").where(among(marks)).join(marks.hint("merge"), "doc_id"))
    rows = rows.withColumn("h", F.xxhash64(F.col("doc_id"), F.lit(5)))
    rows = written(rows.withColumn("fold", F.pmod("h", F.lit(5))), "labelled")
    at = F.struct("h", "doc_id")
    parts = {r.toxic: r for r in rows.groupBy("toxic").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("fold") == 0).alias("n0"),
        F.min(at).alias("low"), F.max(at).alias("high")).collect()}
    rest = F.col("fold") == 0
    for toxic, r in parts.items():
        if r.n0 in (0, r.n):  # a class all on one side: its first id alone calibrates, if there is another one
            first = (F.col("h") == r.low.h) & (F.col("doc_id") == r.low.doc_id) if r.low != r.high else F.lit(False)
            rest = F.when(F.col("toxic") == toxic, first).otherwise(rest)
    name = fit_counts(rows.where(~rest))
    sample, sizes = None, {}
    for toxic in sorted(parts):
        some = rows.where(rest & (F.col("toxic") == toxic))
        sizes[toxic] = some.count()
        some = hash_sample(some, F.xxhash64("doc_id", F.lit(1)), CALIBRATION_ROWS // 2, "doc_id").select("text", "toxic")
        sample = some if sample is None else sample.union(some)
    if len(parts) < 2:
        return Scorer(name, np.array([0.0] * (TOP + 1) + [-30.0]))
    sample = sample.repartition(16)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _opened(name).evidence(b.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([*[pa.array(c) for c in x.T], b.column(1)], names=[*columns, "toxic"])

    columns = [f"x{i}" for i in range(TOP + 1)]
    got = sample.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(
        measure, ", ".join(f"{c} double" for c in columns) + ", toxic int").toPandas()
    y = got["toxic"].to_numpy(float)
    if not (0 < y.sum() < len(y)):
        # toxic where it is the likelier one; a text without evidence is ordinary
        return Scorer(name, np.array([0.0] * TOP + [1.0, -1e-9]))
    # a class of which not all rows were drawn keeps its share
    times = np.where(y == 1, sizes[1] / y.sum(), sizes[0] / (1 - y).sum())
    return Scorer(name, fit_curve(got[columns].to_numpy(), y, times * len(y) / times.sum()))


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.5,
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    The score is a curve over the evidence of the text's ``TOP`` strongest words, one by
    one, and over the difference of its two log-likelihoods per letter, in which all of
    its words count. A null, empty or word-less text is scored as having no evidence. Rows with a null
    id are scored and count as held out; repeated rows are scored each and, where
    labelled, counted each. Other columns are not read; an empty table gives no rows.
    """
    scorer = fit(docs, labels, id_col, text_col)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return (rows.withColumn("score", scorer.column(F.col("text")))
            .select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")))


def keep_ordinary(docs: DataFrame, labels: DataFrame, threshold: float = 0.5,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns,
    whatever these are called. Rows with a null id and repeated rows are each judged by
    their text; a null or empty text has no evidence. An empty table gives no rows."""
    scorer = fit(docs, labels, id_col, text_col)
    mark = free_name(docs, "toxicity")
    return (docs.withColumn(mark, scorer.column(F.col(f"`{text_col}`").cast("string")))
            .where(F.col(mark) < threshold).drop(mark))
