"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints are 64-bit majorities over the XXH64 hashes of a text's word
shingles. Equal fingerprints are one class from the start (their rows are
counted into one before anything is shuffled), so the search works on distinct
fingerprints only.

Two fingerprints within ``max_bits`` agree on all but ``max_bits`` of
``max_bits + 2`` bit blocks, hence on some pair of blocks. Each pair of blocks
spreads the fingerprints over tasks by those bits; within a task the
fingerprints that share them are sorted by Gray rank, neighbours in that order
are grouped, and each group stores the bits its members share (a mask and a
pattern). Upper nodes hold the bits shared by whole runs of groups; a query
walks down, adds up the differences on shared bits, and leaves a subtree as
soon as they exceed ``max_bits``.

A pair of blocks that very many fingerprints share is dealt out once more by a
third block of the other bits (all agreeing choices), so that no task gets more
than the fingerprints that differ in the few bits left.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlane.llm.common import components, forest, free_name, ship, written


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The fingerprint as an unsigned integer; zero for a text without words.

    A-Z are lower-cased; words are runs without ASCII white space. A text of
    fewer than ``shingle`` words has one shingle, all its words.
    """
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    starts, ends = starts[:n].tolist(), ends[len(words) - n:].tolist()
    digest = xxhash.xxh64_digest
    ones = np.zeros(64, np.int64)
    for k in range(0, n, 65536):
        raw = b"".join([digest(line[s:e], seed) for s, e in zip(starts[k:k + 65536], ends[k:k + 65536], strict=True)])
        ones += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def with_fingerprint(docs: DataFrame, name: str = "fingerprint_bits", text_col: str = "text",
                     shingle: int = 3) -> DataFrame:
    """``docs`` plus the fingerprint as a signed long in column ``name``."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))

    return docs.withColumn(name, of(F.col(f"`{text_col}`").cast("string")))


def gray_rank(values: np.ndarray) -> np.ndarray:
    """Position of each value in the reflected Gray sequence."""
    v = values.copy()
    for s in (1, 2, 4, 8, 16, 32):
        v ^= v >> np.uint64(s)
    return v


class GrayIndex:
    """Levels of (pattern, mask) over runs of ``fan`` nodes in Gray order.

    ``mask`` has the bits that all members below share and no node above holds;
    ``pattern`` has their values.
    """

    def __init__(self, values: np.ndarray, fan: int = 8):
        self.values = values[np.argsort(gray_rank(values), kind="stable")]
        self.fan = fan
        ones, zeros = self.values, ~self.values  # bits set, bits clear in all members
        self.levels = [(ones, ones | zeros)]
        while len(ones) > 1:
            cuts = np.arange(0, len(ones), fan)
            ones, zeros = np.bitwise_and.reduceat(ones, cuts), np.bitwise_and.reduceat(zeros, cuts)
            self.levels.append((ones, ones | zeros))
        # factor out of each node what its parent holds already
        for k in range(len(self.levels) - 1):
            ones, mask = self.levels[k]
            above = np.repeat(self.levels[k + 1][1], fan)[:len(mask)]
            self.levels[k] = (ones, mask & ~above)

    def pairs(self, most: int, block: int = 2048) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions (i, j), i < j, of values that differ in ``most`` bits or fewer."""
        for first in range(0, len(self.values), block):
            q = np.arange(first, min(first + block, len(self.values)))
            node, seen = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64)
            for k in range(len(self.levels) - 1, -1, -1):
                pattern, mask = self.levels[k]
                if k < len(self.levels) - 1:
                    q, seen = np.repeat(q, self.fan), np.repeat(seen, self.fan)
                    node = (node[:, None] * self.fan + np.arange(self.fan)).ravel()
                    here = node < len(mask)
                    q, seen, node = q[here], seen[here], node[here]
                seen = seen + np.bitwise_count((self.values[q] ^ pattern[node]) & mask[node])
                # later positions only: the last member of a node is after the query
                near = (seen <= most) & ((node + 1) * self.fan ** k > q)
                q, seen, node = q[near], seen[near], node[near]
            later = node > q
            yield q[later], node[later]


def _blocks(count: int, bits: list[int]) -> list[list[int]]:
    cuts = np.linspace(0, len(bits), count + 1).astype(int)
    return [bits[a:b] for a, b in pairwise(cuts)]


def _keys(max_bits: int) -> list[tuple[int, list[int], list[int]]]:
    """(mask, bit numbers held, bit numbers left) of each pair of blocks."""
    blocks = _blocks(max_bits + 2, list(range(64)))
    out = []
    for two in combinations(blocks, 2):
        held = sorted(b for block in two for b in block)
        out.append((sum(1 << b for b in held), held, [b for b in range(64) if b not in held]))
    return out


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def linked(fingerprints: DataFrame, max_bits: int = 2, bucket: int = 4096) -> DataFrame:
    """Spanning links (a, b) of distinct fingerprints (column ``fp``, long) within
    ``max_bits`` bits: enough to join every class, at most one per fingerprint and
    key."""
    keys = _keys(max_bits)
    f = fingerprints.select("fp")
    spread = f.select("fp", F.posexplode(F.array(*[
        F.col("fp").bitwiseAND(F.lit(_signed(m))) for m, _, _ in keys])).alias("k", "v"))
    big = (spread.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket)
           .select("k", "v", F.lit(True).alias("big")))
    dealt = spread.join(big, ["k", "v"], "left")
    third = F.coalesce(*[F.when(F.col("k") == i, F.array(*[
        F.col("fp").bitwiseAND(F.lit(_signed(sum(1 << b for b in block)))) for block in _blocks(max_bits + 1, rest)]))
        for i, (_, _, rest) in enumerate(keys)])
    alone = F.array(F.lit(0).cast("long"))
    dealt = dealt.select("fp", "k", "v", F.posexplode(F.when(F.col("big"), third).otherwise(alone)).alias("t", "w"))

    def search(table: pa.Table) -> pa.Table:
        index = GrayIndex(np.unique(table.column("fp").to_numpy().view(np.uint64)))
        root = forest(len(index.values), index.pairs(max_bits))
        far = np.flatnonzero(root != np.arange(len(root)))
        return pa.table({"a": index.values[far].view(np.int64), "b": index.values[root[far]].view(np.int64)})

    # keys without a partner need no task of their own
    lone = dealt.groupBy("k", "v", "t", "w").agg(F.count(F.lit(1)).alias("n"), F.collect_list("fp").alias("fps"))
    packed = lone.where("n > 1").select("fps")

    def search_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [search(pa.table({"fp": s.values})) for s in b.column(0)]
            yield from pa.concat_tables(found).combine_chunks().to_batches()

    return packed.mapInArrow(search_all, "a long, b long")


def classes(prints: DataFrame, max_bits: int = 2) -> DataFrame:
    """(fp, least, root, component_id) for rows (doc_id, fp): the fingerprint's own
    smallest doc_id, its component's smallest fingerprint, and the smallest doc_id
    that can be reached over links of ``max_bits`` bits or fewer."""
    reps = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    roots = components(linked(reps, max_bits)).withColumnRenamed("node", "fp")
    both = reps.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = both.groupBy("root").agg(F.min("least").alias("component_id"))
    return both.join(least, "root").select("fp", "least", "root", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 2,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits) and
    component_id, the smallest doc_id reachable over links.

    A null or word-less text has fingerprint zero and links as any other. Rows
    with a null id take part and get the component's smallest known id (null if
    it has none); repeated rows give repeated result rows. An empty table gives
    an empty result; other columns are not read.
    """
    ship(docs.sparkSession)
    prints = written(with_fingerprint(
        docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")), "fp", "text", shingle)
        .select("doc_id", "fp"), "prints")
    return (prints.join(classes(prints, max_bits).select("fp", "component_id"), "fp")
            .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))


def row_hash(columns: list[str]) -> Column:
    """A long that tells rows of one class and id apart, most likely."""
    return F.xxhash64(*[F.col(f"`{c}`") for c in columns])


def keep_one(docs: DataFrame, shingle: int = 3, max_bits: int = 2,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class: that of the smallest id (nulls last,
    then the smallest row hash); of rows equal in fingerprint, id and hash one stays.
    Rows of different classes never stand for each other, whatever their hashes.
    A null or word-less text has fingerprint zero; all columns stay, whatever they are
    called; an empty table gives no rows."""
    ship(docs.sparkSession)
    names = docs.columns
    mark, key = free_name(docs, "fp"), free_name(docs, "row_hash")
    held = with_fingerprint(docs, mark, text_col, shingle).withColumn(key, row_hash(names))
    prints = written(held.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(mark).alias("fp"),
                                 F.col(key).alias("row")), "prints")
    # of each class, the fingerprint that holds the smallest id (any if no id is known)
    best = (classes(prints, max_bits).where(F.col("least").eqNullSafe(F.col("component_id")))
            .groupBy("root", "component_id").agg(F.min("fp").alias("fp")).select("fp", "component_id"))
    chosen = (prints.join(best, "fp").where(F.col("doc_id").eqNullSafe(F.col("component_id")))
              .groupBy("fp", "doc_id").agg(F.min("row").alias("row"))
              .select(F.col("row").alias("its_row"), F.col("fp").alias("its_fp"), F.col("doc_id").alias("its_id")))
    out = held.join(chosen, (held[key] == chosen["its_row"]) & (held[mark] == chosen["its_fp"])
                    & held[f"`{id_col}`"].cast("long").eqNullSafe(chosen["its_id"]), "left_semi")
    return out.dropDuplicates([mark, key]).select(*[F.col(f"`{c}`") for c in names])
