"""Exact, fast id lookup for the two public BPE vocabularies.

A text is cut at white space into chunks; neither vocabulary's pre-tokenizer
lets a token cross such a cut, so the ids of a text are the ids of its chunks
in a row, and a chunk seen before costs one dictionary look-up. A chunk not
seen before is cut by the pre-tokenizer's pattern and each piece is merged
exactly by its ranks. Texts with characters outside ``SAFE`` (where two regex
libraries may classify differently) or with a special token's string in them go
to the tokenizer library itself, whole.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array

import numpy as np
import regex
import tiktoken

#: Characters whose class (letter, number, white space, other), case mapping and
#: normal form are the same in every library used here.
SAFE = re.compile("[\t\n\r\x20-\x7e¡-¬®-ɏ‐-‧‰-⁞₠-₿]*")

# The pre-tokenizers' patterns.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_letters() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the other
    ones, in order, for the characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Ids of one vocabulary file; ``cut`` yields the chunks of a text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t["content"] for t in spec["added_tokens"]]
        suffix = spec["model"].get("end_of_word_suffix") or ""
        letters = byte_letters()
        vocab = {t: i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.mark = b""
        ranks: dict[bytes, int] = {}
        if suffix:
            # A word's last letter carries the suffix. No UTF-8 text holds byte
            # 0xFF, so it stands for the suffix, and the merges that attach it
            # (ids 256 to 511) come before all others.
            self.mark = b"\xff"
        for t, i in vocab.items():
            end = bool(suffix) and t.endswith(suffix)
            core = t[:-len(suffix)] if end else t
            ranks[bytes(letters[c] for c in core) + (self.mark if end else b"")] = i
        self.word_ends = bool(suffix)
        self.bytes_of = {i: b for b, i in ranks.items()} | {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        self.pieces = regex.compile(WORD_PATTERN if suffix else BYTE_PATTERN)
        self.merge = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks,
                                       special_tokens={})._core_bpe.encode_single_piece
        self.cut = str.split if suffix else re.compile(r"\s*\S+|\s+").findall

    def plain(self, text: str) -> bool:
        return SAFE.fullmatch(text) is not None and not any(s in text for s in self.special)

    def cut_pieces(self, chunk: str) -> list[str]:
        """The pre-tokenizer's pieces of one chunk of a plain text."""
        if self.word_ends:
            chunk = chunk.lower()
        if chunk.isalpha():
            return [chunk]
        if chunk[-1] in ".," and chunk[:-1].isalpha():
            return [chunk[:-1], chunk[-1]]
        return self.pieces.findall(chunk)

    def piece_bytes(self, piece: str) -> bytes:
        """Ids of one piece, merged exactly, as little-endian 32-bit integers."""
        return array("I", self.merge(piece.encode() + self.mark)).tobytes()

    def chunk_bytes(self, chunk: str) -> bytes:
        return b"".join([self.piece_bytes(p) for p in self.cut_pieces(chunk)])

    def library_bytes(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


class Memo(dict):
    """Key -> bytes, computed by ``make`` on first use. Holds two generations of
    at most ``limit`` keys each: the older one is dropped when the younger is
    full, so memory is bounded whatever the text and frequent keys stay."""

    def __init__(self, make, limit: int = 400_000, longest: int = 64):
        super().__init__()
        self.make, self.limit, self.longest, self.old = make, limit, longest, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class Encoder:
    """Ids of whole texts through memos of chunks and of pieces."""

    def __init__(self, path: str, limit: int = 400_000):
        self.vocabulary = v = Vocabulary(path)
        self.pieces = Memo(v.piece_bytes, limit)
        self.chunks = Memo(self._chunk, limit)

    def _chunk(self, chunk: str) -> bytes:
        ids = [self.pieces[p] for p in self.vocabulary.cut_pieces(chunk)]
        return ids[0] if len(ids) == 1 else b"".join(ids)

    def ids(self, text: str) -> bytes:
        v, chunks = self.vocabulary, self.chunks
        if not v.plain(text):
            return v.library_bytes(text)
        return b"".join([chunks[c] for c in v.cut(text)])


assert sys.byteorder == "little" and array("I").itemsize == 4
_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str, limit: int = 400_000) -> Encoder:
    """One encoder per Python worker and vocabulary file, kept between tasks."""
    if (path, limit) not in _ENCODERS:
        _ENCODERS[path, limit] = Encoder(path, limit)
    return _ENCODERS[path, limit]
