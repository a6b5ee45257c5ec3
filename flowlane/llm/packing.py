"""Packing of token sequences by minimum bin slack.

Documents are cut into full windows plus a remainder shorter than a window. The
remainders waiting in a pool are packed window by window: the longest one is
taken as seed, then a bitset subset-sum programme over the multiset of remaining
lengths finds the fill closest to the window's capacity, and backtracking tells
how many of each length it takes. If no subset fills the window, the slack is
filled with a piece cut from a waiting remainder.

Each scan task packs its own documents while it reads them, so no text and no
ids are shuffled; only the remainders it is left with (less than one window per
task) go to a second round in which ``fan_in`` tasks' leftovers are packed
together. What is left there is cut into sequences of power-of-two lengths, which
need no padding.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlane.llm.common import give_back, written
from flowlane.llm.words import encoder

SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, `offset` long")
REMEMBERED = 100_000  # chunks and pieces whose ids a worker keeps, twice each


def best_fill(lengths: list[int], counts: dict[int, int], capacity: int) -> list[tuple[int, int]]:
    """(length, count) pairs of a sub-multiset whose sum is the largest that is
    not above ``capacity``.

    ``lengths`` are the distinct lengths, ascending. Bit s of a bitset says that
    sum s can be reached; a length with count c is added as 1, 2, 4 ... copies, so
    it costs log c shifts. Stops as soon as the capacity itself is reached.
    """
    mask = (1 << (capacity + 1)) - 1
    reach, steps = 1, []
    for length in reversed(lengths[:bisect_left(lengths, capacity + 1)]):
        left, copies = min(counts[length], capacity // length), 1
        while left > 0:
            take = min(copies, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left -= take
            copies *= 2
        if reach >> capacity:
            break
    at = reach.bit_length() - 1
    chosen: dict[int, int] = {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            chosen[length] = chosen.get(length, 0) + take
            at -= length * take
    return sorted(chosen.items(), reverse=True)


class Pool:
    """Waiting remainders: (doc_id, start, doc_tokens, ids) by their length."""

    def __init__(self, window: int):
        self.window, self.by, self.lengths, self.counts = window, {}, [], {}
        self.tokens = self.items = 0

    def add(self, item: tuple) -> None:
        n = len(item[3]) // 4
        if not self.counts.get(n):
            insort(self.lengths, n)
        self.counts[n] = self.counts.get(n, 0) + 1
        self.by.setdefault(n, []).append(item)
        self.tokens += n
        self.items += 1

    def take(self, n: int) -> tuple:
        self.counts[n] -= 1
        if not self.counts[n]:
            del self.lengths[bisect_left(self.lengths, n)]
        self.tokens -= n
        self.items -= 1
        return self.by[n].pop()

    def cut(self, n: int) -> tuple:
        """A piece of ``n`` tokens off the longest remainder; the rest goes back."""
        doc, start, total, ids = self.take(self.lengths[-1])
        if len(ids) > 4 * n:
            self.add((doc, start + n, total, ids[4 * n:]))
        return doc, start, total, ids[:4 * n]

    def fill(self) -> list[tuple]:
        """The pieces of one full window; the pool holds at least a window."""
        seed = self.lengths[-1]
        out = [self.take(seed)]
        chosen = best_fill(self.lengths, self.counts, self.window - seed)
        for n, k in chosen:
            out += [self.take(n) for _ in range(k)]
        slack = self.window - seed - sum(n * k for n, k in chosen)
        while slack:
            out.append(self.cut(min(slack, self.lengths[-1])))
            slack -= len(out[-1][3]) // 4
        return out


def _rows(pieces: list[tuple], sequence: int) -> Iterator[tuple]:
    at = 0
    for doc, start, total, ids in pieces:
        yield doc, start, len(ids) // 4, zlib.crc32(ids), total, sequence, at
        at += len(ids) // 4


def pack(docs: Iterable[tuple], window: int, pool_items: int, first: int) -> Iterator[tuple]:
    """Rows of full windows from (doc_id, ids) pairs; the remaining pool is the
    generator's return value. ``first`` is the first sequence id."""
    pool, sequence = Pool(window), first
    for doc, ids in docs:
        total = len(ids) // 4
        whole = total // window * window
        for s in range(0, whole, window):
            yield from _rows([(doc, s, total, ids[4 * s:4 * (s + window)])], sequence)
            sequence += 1
        if whole < total:
            pool.add((doc, whole, total, ids[4 * whole:]))
        if pool.items >= pool_items:
            # half is packed, the rest stays as choice for the windows to come
            while pool.items > pool_items // 2 and pool.tokens >= window:
                yield from _rows(pool.fill(), sequence)
                sequence += 1
    while pool.tokens >= window:
        yield from _rows(pool.fill(), sequence)
        sequence += 1
    return pool, sequence


def tail(pool: Pool, sequence: int) -> Iterator[tuple]:
    """Sequences of power-of-two lengths that hold what is left of a pool."""
    while pool.tokens:
        room, pieces = 1 << (pool.tokens.bit_length() - 1), []
        while room:
            pieces.append(pool.cut(min(room, pool.lengths[-1])))
            room -= len(pieces[-1][3]) // 4
        yield from _rows(pieces, sequence)
        sequence += 1


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int | None = 2, window: int = 4096,
                   pool_items: int = 1024, fan_in: int = 64,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack the tokens of ``docs`` into sequences of at most ``window`` tokens.

    ``vocabulary`` is the tokenizer file; ``end_id`` is put after each document.
    Returns one row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset. Every sequence is full but for at most a dozen of
    power-of-two lengths per ``fan_in`` scan tasks.

    A null text counts as empty (one token, ``end_id``; no row at all if ``end_id``
    is None). A null id stays null. Rows that repeat an id are packed each for
    itself. A text of any length is cut into windows. An empty table gives no
    rows; columns other than the two named are not read.
    """
    after = b"" if end_id is None else end_id.to_bytes(4, "little")

    def first_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, REMEMBERED)
        context = TaskContext.get()
        part = context.partitionId() if context else 0

        def pairs():
            for b in batches:
                for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    yield doc, enc.ids(text or "") + after

        # sequence ids of a task start at its partition number times 2^40
        rows, run = [], pack(pairs(), window, pool_items, part << 40)
        while True:
            try:
                rows.append((*next(run), None, part))
            except StopIteration as end:
                pool = end.value[0]
                break
            if len(rows) >= 20_000:
                yield _batch(rows)
                rows = []
        left = [i for n in pool.lengths for i in pool.by[n]]
        if left:
            rows.append((*[None] * 7, [dict(zip(LEFT, i, strict=True)) for i in left], part))
        if rows:
            yield _batch(rows)
        del rows, run, pool, left
        give_back()

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    one = written(source.mapInArrow(
        first_round, SCHEMA + ", left array<struct<doc_id:long,start:long,doc_tokens:long,ids:binary>>, part long"),
        "packed")

    def second_round(key: tuple, table: pa.Table) -> pa.Table:
        pool, sequence, rows = Pool(window), (1 << 62) + (key[0].as_py() << 24), []
        tasks = sorted(zip(table.column("part").to_pylist(), table.column("left").to_pylist(), strict=True),
                       key=lambda x: x[0])
        for _, left in tasks:
            for i in left:
                pool.add(tuple(i[k] for k in LEFT))
        while pool.tokens >= window:
            rows += _rows(pool.fill(), sequence)
            sequence += 1
        rows += tail(pool, sequence)
        return pa.Table.from_batches([_batch([(*r, None, None) for r in rows])]).select(list(range(7)))

    two = (one.where("left is not null").select("left", "part")
           .groupBy((F.col("part") / fan_in).cast("long").alias("lot")).applyInArrow(second_round, SCHEMA))
    return one.where("left is null").select("doc_id", "start", "length", "ids_crc32", "doc_tokens",
                                            "sequence_id", "offset").union(two)


LEFT = ("doc_id", "start", "doc_tokens", "ids")
_LEFT = pa.list_(pa.struct([("doc_id", pa.int64()), ("start", pa.int64()), ("doc_tokens", pa.int64()),
                            ("ids", pa.binary())]))
_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "left", "part"]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 9
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=_LEFT if n == "left" else pa.int64()) for n, c in zip(_NAMES, columns, strict=True)],
        names=_NAMES)
