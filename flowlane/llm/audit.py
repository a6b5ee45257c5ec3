"""Filter interaction audit by truth-table survival words.

A document fails some of up to five filters. Its survival word has one bit for each
subset of the filters: bit S is set where the document passes every filter of S. The
positional popcounts of the words, taken with carry-save adders, are the survivors of
every subset; per part and label they give every figure of every order of the filters,
since what an order keeps after some steps is what survives the subset applied so far.
The words are counted where they are made: a task hands on 32 sums for each part of a
batch, whatever the number of documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from flowlane.llm.common import ship, written

FILTERS = "ABCDE"
SHORT, LONG = 50, 65     # words of a text, different words in a hundred
CAPITALS = 5             # in a hundred characters
SIGNS = b"#$%&*|"
UPPER = bytes(range(ord("A"), ord("Z") + 1))


def text_fails(text: bytes, characters: int) -> int:
    """Bits of the filters A to D that a text fails: under 50 words; fewer than 65
    different words in a hundred; more than 5 capitals A-Z in a hundred characters; any
    of ``#$%&*|``. ``bytes.split`` cuts at exactly 0x20 and 0x09 to 0x0D."""
    words = text.split()
    capitals = len(text) - len(text.translate(None, UPPER))
    return ((len(words) < SHORT) | (100 * len(set(words)) < LONG * len(words)) << 1
            | (100 * capitals > CAPITALS * characters) << 2 | (len(text.translate(None, SIGNS)) < len(text)) << 3)


@F.pandas_udf(IntegerType())
def _fails(text: pd.Series, characters: pd.Series) -> pd.Series:
    return pd.Series([text_fails(t, n) for t, n in zip(text, characters.tolist(), strict=True)], dtype="int32")


def marks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          part_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: doc_id, part, fails (bit i: fails filter i of
    ``FILTERS``), good, toxic.

    A null text counts as empty, a null part as the empty string. Filter E fails a row
    whose text some smaller id has, anywhere in the table; texts are told apart by their
    SHA-256. Rows of the same id do not fail each other, and a null id is neither
    smaller than another nor has smaller ones. good and toxic: some row of ``labels``
    (doc_id, quality, toxic) with that id has a 1 there; without one both are false.
    Other columns are not read; an empty table gives no rows.
    """
    ship(docs.sparkSession)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"),
                       F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    # texts stay where they are read: only digests and bits go on
    rows = written(rows.select("doc_id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"),
                               _fails(F.col("text").cast("binary"), F.length("text")).alias("fails")), "marked")
    known = rows.where("doc_id is not null")
    # each text's smallest id: joined by text and id, so copies of a text do not meet
    first = known.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marked = labels.where("doc_id is not null and (quality = 1 or toxic = 1)").groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    copy = F.when(F.col("first"), F.lit(0)).otherwise(F.lit(1 << 4))
    known = (known.join(first, ["digest", "doc_id"], "left").join(marked, "doc_id", "left")
             .select("doc_id", "part", F.col("fails").bitwiseOR(copy).alias("fails"),
                     *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]))
    # null ids have no label and no copies, and would all meet in one task of a join
    return known.union(rows.where("doc_id is null").select(
        "doc_id", "part", "fails", F.lit(False).alias("good"), F.lit(False).alias("toxic")))


def survival_words(filters: int) -> np.ndarray:
    """The survival word of each combination of failed filters."""
    subsets = np.arange(1 << filters, dtype=np.uint64)
    passes = (subsets[:, None] & subsets[None, :]) == 0
    return (passes.astype(np.uint64) << subsets[None, :]).sum(1).astype(np.uint32)


def positional_popcount(words: np.ndarray, width: int = 32) -> np.ndarray:
    """How many words have each bit set. Three words of one weight become their sum and,
    of twice the weight, their carry until two are left at each weight."""
    counts, places, weight = np.zeros(width, np.int64), np.arange(width, dtype=np.uint32), 1
    while len(words):
        carries = []
        while len(words) > 2:
            third = len(words) // 3
            a, b, c = words[:third], words[third:2 * third], words[2 * third:3 * third]
            odd = a ^ b
            carries.append((a & b) | (odd & c))
            words = np.concatenate([odd ^ c, words[3 * third:]])
        counts += weight * ((words[:, None] >> places) & np.uint32(1)).sum(0, dtype=np.int64)
        words = np.concatenate(carries) if carries else words[:0]
        weight *= 2
    return counts


def survivors(marked: DataFrame, filters: int = len(FILTERS)) -> DataFrame:
    """Rows (part, survive, good, toxic) of ``marks``' rows, each of the three an array
    with the number of survivors of every subset of the filters."""
    table, width = survival_words(filters), 1 << filters

    def tally(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            parts = b.column(0).dictionary_encode()
            code = parts.indices.to_numpy()
            order = np.argsort(code, kind="stable")
            words = table[b.column(1).to_numpy()[order]]
            classes = [np.where(np.asarray(b.column(c))[order], words, np.uint32(0)) for c in (2, 3)]
            cuts = np.searchsorted(code[order], np.arange(len(parts.dictionary) + 1))
            counts = np.array([[positional_popcount(w[i:j], width) for i, j in zip(cuts, cuts[1:])]
                               for w in (words, *classes)]).reshape(3, -1)
            yield pa.RecordBatch.from_arrays(
                [parts.dictionary.take(pa.array(np.repeat(np.arange(len(cuts) - 1), width))),
                 pa.array(np.tile(np.arange(width, dtype=np.int32), len(cuts) - 1)), *map(pa.array, counts)],
                names=["part", "subset", "survive", "good", "toxic"])

    sums = (marked.select("part", "fails", "good", "toxic")
            .mapInArrow(tally, "part string, subset int, survive long, good long, toxic long")
            .groupBy("part", "subset").agg(*[F.sum(c).alias(c) for c in ("survive", "good", "toxic")]))
    # 2 to the number of filters rows for each part
    by_subset = F.sort_array(F.collect_list(F.struct("subset", "survive", "good", "toxic")))
    return sums.groupBy("part").agg(by_subset.alias("s")).select(
        "part", *[F.col(f"s.{c}").alias(c) for c in ("survive", "good", "toxic")])


def _literal(values: list[int]) -> Column:
    return F.lit([int(v) for v in values])


def interactions(counted: DataFrame, letters: str = FILTERS) -> DataFrame:
    """Every order of the filters step by step, from the rows of ``survivors``: part,
    filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    shapley; one row per part, order and step, zeros included."""
    n, whole = len(letters), (1 << len(letters)) - 1
    orders = list(permutations(range(n)))
    before = [sum(1 << f for f in o[:i]) for o in orders for i in range(n)]
    bit = [1 << o[i] for o in orders for i in range(n)]
    # a subset survives, as a filter's predecessors, in this many of all orders
    times = [math.factorial(s.bit_count()) * math.factorial(max(0, n - 1 - s.bit_count())) for s in range(whole + 1)]
    weights = [times[s] if not s >> f & 1 else -times[s ^ (1 << f)] for f in range(n) for s in range(whole + 1)]
    size = whole + 1

    def at(values: str | Column, place: Column) -> Column:
        return F.get(values, place)

    rows = counted.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(len(orders) * n - 1)))).withColumns({
        "before": at(_literal(before), F.col("row")), "bit": at(_literal(bit), F.col("row")),
        "filter_order": at(F.lit(["".join(letters[f] for f in o) for o in orders]), F.floor(F.col("row") / n).cast("int"))})
    after = F.col("before").bitwiseOR(F.col("bit"))
    rows = rows.withColumns({
        "kept": at("survive", after), "removed": at("survive", F.col("before")) - at("survive", after),
        "fails": at("survive", F.lit(0)) - at("survive", F.col("bit")),
        "unique_fails": at("survive", F.lit(whole).bitwiseXOR(F.col("bit"))) - at("survive", F.lit(whole)),
        "good_lost": at("good", F.col("before")) - at("good", after),
        "toxic_lost": at("toxic", F.col("before")) - at("toxic", after)})
    own = F.slice(_literal(weights), F.log2("bit").cast("int") * size + 1, F.lit(size))
    shapley = F.aggregate(F.zip_with("survive", own, lambda x, w: x * w), F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select(
        "part", "filter_order", (F.col("row") % n + 1).cast("int").alias("step"), "kept", "removed",
        (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost",
        shapley.alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          part_col: str = "source") -> DataFrame:
    """``interactions`` of the filters A to E over all of ``docs``; edge cases as in
    ``marks``. An empty table has no parts and gives no rows."""
    return interactions(survivors(marks(docs, labels, id_col, text_col, part_col)))
