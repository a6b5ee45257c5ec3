"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

The corpus's frequent chunks (a word with the white space before it) are counted
over all documents, merged once, and compiled into an automaton in which words
share prefixes and suffixes. Each arc carries the number of words that sort
before it, so the sum along a path is the word's number, which selects its ids.
The automaton is one file of plain arrays; every executor gets it with the job's
files, and its Python workers memory-map it. A batch's distinct chunks walk it
together, one byte a step. Chunks it does not hold are merged exactly, so ids
never depend on what the lexicon holds. Texts outside the plain characters go to
the tokenizer library whole (see ``words``).
"""

from __future__ import annotations

import os
import tempfile
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlane.llm.words import Encoder, Vocabulary, encoder

#: Longest chunk, in characters, that may be in the lexicon.
LONGEST = 48
#: Pieces merged last that a worker remembers; frequent chunks are in the lexicon.
MEMO = 100_000


def compile_words(words: list[bytes]) -> dict[str, np.ndarray]:
    """The minimal automaton of ``words`` (sorted, distinct) as flat arrays.

    ``key`` (state * 256 + byte, ascending), ``target`` and ``out`` describe the
    arcs, ``final`` the states; state 0 is the start.
    """
    arcs: list[dict[int, int]] = [{}]   # state under construction or registered
    final = [False]
    register: dict[tuple, int] = {}
    path = [0]                          # states of the last word, from the start

    def close(depth: int, last: bytes) -> None:
        for d in range(len(path) - 1, depth, -1):
            s = path[d]
            mark = (final[s], tuple(arcs[s].items()))
            arcs[path[d - 1]][last[d - 1]] = register.setdefault(mark, s)
        del path[depth + 1:]

    last = b""
    for w in words:
        same = len(os.path.commonprefix([w, last]))
        close(same, last)
        for b in w[same:]:
            arcs.append({})
            final.append(False)
            arcs[path[-1]][b] = len(arcs) - 1
            path.append(len(arcs) - 1)
        final[path[-1]] = True
        last = w
    close(0, last)

    count: dict[int, int] = {}

    def size(start: int) -> int:
        stack = [start]
        while stack:
            s = stack[-1]
            todo = [t for t in arcs[s].values() if t not in count]
            if todo:
                stack += todo
            else:
                count[s] = final[s] + sum(count[t] for t in arcs[s].values())
                stack.pop()
        return count[start]

    size(0)
    number, order = {0: 0}, [0]
    for s in order:
        for t in arcs[s].values():
            if t not in number:
                number[t] = len(number)
                order.append(t)
    key, target, out = [], [], []
    for s in order:
        before = int(final[s])
        for b, t in sorted(arcs[s].items()):
            key.append(number[s] * 256 + b)
            target.append(number[t])
            out.append(before)
            before += count[t]
    return {"key": np.array(key, np.int64), "target": np.array(target, np.int64),
            "out": np.array(out, np.int64), "final": np.array([final[s] for s in order], np.int64)}


class Lexicon:
    """A memory-mapped automaton file with the ids of its words."""

    PARTS = ("key", "target", "out", "final", "cut")

    def __init__(self, path: str):
        head = np.fromfile(path, np.int64, len(self.PARTS) + 1)
        whole = np.memmap(path, np.uint8, "r")
        at = head.nbytes
        for name, n in zip(self.PARTS, head, strict=False):
            setattr(self, name, whole[at:at + 8 * n].view(np.int64))
            at += 8 * int(n)
        self.ids = whole[at:at + int(head[-1])].data

    @classmethod
    def write(cls, path: str, words: list[str], ids: list[bytes]) -> None:
        pairs = sorted(zip([w.encode() for w in words], ids, strict=True))
        parts = compile_words([w for w, _ in pairs])
        parts["cut"] = np.cumsum([0, *[len(i) for _, i in pairs]]).astype(np.int64)
        with open(path, "wb") as f:
            np.array([*[len(parts[p]) for p in cls.PARTS], parts["cut"][-1]], np.int64).tofile(f)
            for p in cls.PARTS:
                parts[p].tofile(f)
            f.write(b"".join(i for _, i in pairs))

    def look_up(self, words: list[bytes]) -> np.ndarray:
        """Each word's number, or -1."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        text = np.frombuffer(b"".join(words), np.uint8)
        starts = np.cumsum(lengths) - lengths
        state, number = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        if not len(self.key):
            return np.where((lengths == 0) & bool(len(self.final) and self.final[0]), 0, -1)
        going, step = np.flatnonzero(lengths > 0), 0
        lost = np.zeros(len(words), bool)
        while len(going):
            want = state[going] * 256 + text[starts[going] + step]
            at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
            here = self.key[at] == want
            lost[going[~here]] = True
            going, at = going[here], at[here]
            state[going] = self.target[at]
            number[going] += self.out[at]
            step += 1
            going = going[lengths[going] > step]
        return np.where(lost | (self.final[state] == 0), -1, number)

    def ids_of(self, numbers: np.ndarray) -> list[bytes]:
        lo, hi = self.cut[numbers].tolist(), self.cut[numbers + 1].tolist()
        return [bytes(self.ids[a:b]) for a, b in zip(lo, hi, strict=True)]


def frequent_chunks(docs: DataFrame, vocabulary: str, size: int = 65_536, share: float = 2e-6,
                    held: int = 400_000, text_col: str = "text") -> list[str]:
    """The ``size`` most frequent chunks of all documents, most frequent first.

    Each task counts its own documents and reports chunks that make up at least
    ``share`` of what it saw (any chunk with that share of the corpus has it in
    some task). A task that holds more than ``held`` distinct chunks forgets those
    seen once. This only decides what the lexicon speeds up.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = encoder(vocabulary, MEMO).vocabulary
        seen: Counter = Counter()
        total = 0
        for b in batches:
            for text in b.column(0).to_pylist():
                if text and v.plain(text):
                    chunks = v.cut(text)
                    total += len(chunks)
                    seen.update(chunks)
                    if len(seen) > held:
                        seen = Counter({c: n for c, n in seen.items() if n > 1})
        least = max(2, share * total)
        top = [(c, n) for c, n in seen.items() if n >= least and len(c) <= LONGEST]
        if top:
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in top], pa.string()),
                                              pa.array([n for _, n in top], pa.int64())], names=["chunk", "n"])

    counts = docs.select(F.col(text_col).cast("string")).mapInArrow(count, "chunk string, n long")
    top = counts.groupBy("chunk").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "chunk").limit(size)
    return [r.chunk for r in top.collect()]


def build_lexicon(docs: DataFrame, vocabulary: str, size: int = 65_536, text_col: str = "text") -> str:
    """Compile the corpus's frequent chunks and hand the file to every executor;
    returns its name among the job's files. Its size is bounded by ``size``
    chunks of at most ``LONGEST`` characters."""
    words = frequent_chunks(docs, vocabulary, size, text_col=text_col)
    enc = Encoder(vocabulary)
    with tempfile.NamedTemporaryFile(prefix="lexicon-", suffix=".bin", delete=False) as f:
        path = f.name
    Lexicon.write(path, words, [enc.chunks[w] for w in words])
    docs.sparkSession.sparkContext.addFile(path)
    return os.path.basename(path)


_OPEN: dict[str, Lexicon] = {}


def _opened(name: str) -> Lexicon:
    if name not in _OPEN:
        _OPEN[name] = Lexicon(SparkFiles.get(name))
    return _OPEN[name]


def encode_texts(texts: list[str], lexicon: Lexicon, enc: Encoder, chars: int = 2_000_000) -> Iterator[bytes]:
    """Little-endian 32-bit ids of each text, the lexicon asked once for the
    distinct chunks of about ``chars`` characters."""
    v = enc.vocabulary
    at = 0
    while at < len(texts):
        lot, size = [], 0
        while at < len(texts) and (not lot or size < chars):
            t = texts[at]
            lot.append(v.cut(t) if v.plain(t) else t)
            size += len(t)
            at += 1
        words = list({c for x in lot if type(x) is list for c in x})
        numbers = lexicon.look_up([w.encode() for w in words])
        known = np.flatnonzero(numbers >= 0)
        ids = dict(zip([words[i] for i in known.tolist()], lexicon.ids_of(numbers[known]), strict=True))
        for i in np.flatnonzero(numbers < 0).tolist():
            ids[words[i]] = b"".join([enc.pieces[p] for p in v.cut_pieces(words[i])])
        for x in lot:
            yield b"".join([ids[c] for c in x]) if type(x) is list else v.library_bytes(x)


def encode(docs: DataFrame, vocabulary: str, lexicon_size: int = 65_536, decode: bool = False,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``ids`` (binary: little-endian unsigned 32-bit integers) of each
    row's whole text, as the tokenizer library gives them without added special
    tokens, truncation or padding; with ``decode`` also ``text``, decoded from the
    ids in the same Python worker.

    A null text counts as empty (no ids). Null ids stay null, repeated rows give
    repeated rows, other columns are not read, an empty table gives no rows.
    """
    name = build_lexicon(docs, vocabulary, lexicon_size, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, enc = _opened(name), encoder(vocabulary, MEMO)
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                ids = list(encode_texts([t or "" for t in part.column(1).to_pylist()], lexicon, enc))
                columns = [part.column(0), pa.array(ids, pa.binary())]
                if decode:
                    d = _decoder(vocabulary)
                    columns.append(pa.array([d.text(i) for i in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "text"][:len(columns)])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")
                       ).mapInArrow(run, "doc_id long, ids binary" + (", text string" if decode else ""))


class Decoder:
    """Bytes of ids, looked up in one flat table for many ids at once."""

    def __init__(self, vocabulary: Vocabulary):
        table = [vocabulary.bytes_of.get(i, b"") for i in range(max(vocabulary.bytes_of) + 1)]
        self.lengths = np.array([len(t) for t in table], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(table), np.uint8)

    def text(self, ids: bytes, step: int = 1 << 18) -> str:
        out = []
        every = np.frombuffer(ids, "<u4")
        for k in range(0, len(every), step):
            i = every[k:k + step]
            n = self.lengths[i]
            ends = np.cumsum(n)
            at = np.repeat(self.starts[i] - (ends - n), n)
            out.append(self.flat[at + np.arange(len(at))].tobytes())
        return b"".join(out).decode("utf-8", "replace")


_DECODERS: dict[str, Decoder] = {}


def _decoder(vocabulary: str) -> Decoder:
    if vocabulary not in _DECODERS:
        _DECODERS[vocabulary] = Decoder(encoder(vocabulary, MEMO).vocabulary)
    return _DECODERS[vocabulary]


def decoded(ids: Column, vocabulary: str) -> Column:
    """The text that a binary column of ids stands for, special tokens included."""

    @F.pandas_udf("string")
    def run(column):
        d = _decoder(vocabulary)
        return column.map(lambda x: None if x is None else d.text(bytes(x)))

    return run(ids)

