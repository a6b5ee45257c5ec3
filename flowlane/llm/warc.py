"""WARC archives with a two-level capture index.

Writing: each task writes its pages as gzip members, one record each, to archive
files of bounded size in a shared folder, and reports one index line per record.
Equal payloads are stored once: the others become revisit records that name it.

Indexing: the lines are sorted by reversed-host URL key over range partitions.
Each partition is one index shard: blocks of ``LINES`` lines, compressed, and
beside it a directory with the first key and the place of each block.

Reading: a look-up binary-searches the shards' first keys, then the shard's
directory, range-reads and expands one block, finds its lines, and range-reads
the records, adjoining ones in one read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import groupby
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlane.llm.common import work_folder, written

LINES = 3000                # index lines per compressed block
ARCHIVE_BYTES = 64 << 20    # an archive file is closed beyond this
LEAST_SHARED = 100          # payloads of fewer bytes are always stored
GZIP = 16 + zlib.MAX_WBITS
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"  # the table has no capture times

LINE = "key string, page_id long, file string, `offset` long, length long"
LINE_TYPES = [("key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()),
              ("length", pa.int64())]


def url_key(url: str | None) -> str:
    """Host labels reversed, then path and query: com,example,www)/path?query.

    A null URL has the empty key; one that cannot be parsed is its own key. Blanks
    and control characters, which the index uses itself, are percent-encoded."""
    url = re.sub(r"[\x00-\x20\x7f\x85\u2028\u2029]", lambda m: quote(m[0]), url or "")
    try:
        u = urlsplit(url)
        host, port = u.hostname, u.port
    except ValueError:
        return url
    if not host:
        return url
    return (",".join(reversed(host.split("."))) + (f":{port}" if port not in (None, 80, 443) else "") + ")"
            + (u.path or "/") + (f"?{u.query}" if u.query else ""))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record, not compressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Date: {DATE}",
            f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
            f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~._-')}",
            f"WARC-Payload-Digest: sha256:{digest}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
        block = http
    else:
        block = http + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Fields of one expanded record; a response's bytes and digest are taken from
    its payload, a revisit's from its headers."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    page = fields["WARC-Record-ID"][len("<urn:page:"):-1]
    out = {"page_id": int(page) if page else None, "record_type": fields["WARC-Type"], "refers_to": None}
    if out["record_type"] == "revisit":
        out["refers_to"] = int(fields["WARC-Refers-To"][len("<urn:page:"):-1])
        out["payload"] = None
        out["payload_bytes"] = int(http.rpartition(b"Content-Length: ")[2])
        out["payload_digest"] = fields["WARC-Payload-Digest"].partition(":")[2]
    else:
        out |= {"payload": payload, "payload_bytes": len(payload), "payload_digest": hashlib.sha256(payload).hexdigest()}
    return out


def _place(folder: str) -> tuple[fs.FileSystem, str]:
    if folder.startswith("file:/") and not folder.startswith("file://"):
        folder = "file://" + folder[len("file:"):]
    return fs.FileSystem.from_uri(folder)


def _batch(rows: list[tuple], types: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), types, strict=True)],
                                      names=[n for n, _ in types])


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives into ``folder``; returns the
    index lines. Of rows whose payloads of at least ``LEAST_SHARED`` bytes are equal,
    those with the smallest id are stored, the others refer to it. Null html is an
    empty payload; rows without id are stored unless a row with an id has their
    payload."""
    held = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    held = held.withColumn("digest", F.sha2("payload", 256))
    shared = F.when(F.octet_length("payload") >= LEAST_SHARED, F.col("digest"))
    first = (held.select(shared.alias("same"), "page_id").where("same is not null").groupBy("same")
             .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    ready = (held.withColumn("same", shared).join(first, "same", "left")
             .select("page_id", "url", "payload", "digest",
                     F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")).alias("refers_to")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _place(folder)
        name, out, rows, at = "", None, [], 0
        for b in batches:
            for page, url, payload, digest, refers in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if out is None:
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{path}/{name}", compression=None)
                z = zlib.compressobj(3, zlib.DEFLATED, GZIP)
                member = z.compress(record(page, url, payload, digest, refers)) + z.flush()
                out.write(member)
                rows.append((url_key(url), page, name, at, len(member)))
                at += len(member)
                if at >= ARCHIVE_BYTES:
                    out.close()
                    yield _batch(rows, LINE_TYPES)
                    out, rows = None, []
        if out is not None:
            out.close()
            yield _batch(rows, LINE_TYPES)

    return written(ready.mapInArrow(run, LINE), "captures")


def index(lines: DataFrame, folder: str) -> list[tuple[str, str]]:
    """Write the index shards; returns (first line's sort key, shard name) in order.
    One entry per range partition, whatever the number of captures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _place(folder)
        name, first, at, block, places = uuid.uuid4().hex, None, 0, [], []

        def rows():
            for b in batches:
                yield from zip(*[c.to_pylist() for c in b.columns], strict=True)

        out = None
        for _, lot in groupby(enumerate(rows()), lambda x: x[0] // LINES):
            block = [r for _, r in lot]
            if out is None:
                first = _sort_key(*block[0][:2])
                out = store.open_output_stream(f"{path}/{name}.idx", compression=None)
            text = "".join("\t".join(["" if v is None else str(v) for v in r]) + "\n" for r in block)
            packed = zlib.compress(text.encode(), 3)
            out.write(packed)
            places.append(f"{_sort_key(*block[0][:2])}\t{at}\t{len(packed)}\n")
            at += len(packed)
        if out is not None:
            out.close()
            with store.open_output_stream(f"{path}/{name}.dir", compression=None) as f:
                f.write("".join(places).encode())
            yield _batch([(first, name)], [("first", pa.string()), ("shard", pa.string())])

    order = [F.col("key"), F.col("page_id")]
    shards = (lines.repartitionByRange(*order).sortWithinPartitions(*order)
              .mapInArrow(run, "first string, shard string"))
    return sorted((r.first, r.shard) for r in written(shards, "shards").collect())


def _sort_key(key: str, page_id: int | None) -> str:
    """Orders like (key, page_id nulls first): the sign and 19 digits of the id follow."""
    return f"{key} {'' if page_id is None else f'{page_id + (1 << 63):020d}'}"


class Index:
    """Look-ups in a written index; keeps the block and directory read last."""

    def __init__(self, folder: str, shards: list[tuple[str, str]]):
        self.store, self.path = _place(folder)
        self.firsts, self.names = [f for f, _ in shards], [n for _, n in shards]
        self.shard = self.block = None

    def _open(self, shard: int) -> None:
        if self.shard != shard:
            with self.store.open_input_stream(f"{self.path}/{self.names[shard]}.dir", compression=None) as f:
                places = [x.rsplit("\t", 2) for x in f.read().decode().split("\n")[:-1]]
            self.keys = [p[0] for p in places]
            self.spans = [(int(p[1]), int(p[2])) for p in places]
            self.shard, self.block = shard, None

    def _lines(self, shard: int, block: int) -> tuple[list[str], list[list[str]]]:
        self._open(shard)
        if self.block != block:
            at, n = self.spans[block]
            with self.store.open_input_file(f"{self.path}/{self.names[shard]}.idx") as f:
                raw = zlib.decompress(f.read_at(n, at))
            self.lines = [x.split("\t") for x in raw.decode().split("\n")[:-1]]
            self.line_keys = [_sort_key(x[0], int(x[1]) if x[1] else None) for x in self.lines]
            self.block = block
        return self.line_keys, self.lines

    def find(self, key: str, page_id: int | None) -> Iterator[tuple[str, int, int]]:
        """(file, offset, length) of every capture of a key and id."""
        want = _sort_key(key, page_id)
        # captures of one key and id may run over blocks and shards: start at the
        # last one that begins below it and go on while keys are not above it
        shard = max(0, bisect_left(self.firsts, want) - 1)
        while shard < len(self.names) and self.firsts[shard] <= want:
            self._open(shard)
            block = max(0, bisect_left(self.keys, want) - 1)
            while block < len(self.keys) and self.keys[block] <= want:
                keys, lines = self._lines(shard, block)
                for x in lines[bisect_left(keys, want):bisect_right(keys, want)]:
                    yield x[2], int(x[3]), int(x[4])
                block += 1
            shard += 1


def read_ranges(store: fs.FileSystem, path: str, places: list[tuple[str, int, int]],
                gap: int = 1 << 16, most: int = 8 << 20) -> Iterator[bytes]:
    """Expanded records at ``places``; records closer than ``gap`` are read at once,
    up to about ``most`` bytes."""
    for name, lot in groupby(sorted(places), key=lambda p: p[0]):
        with store.open_input_file(f"{path}/{name}") as f:
            lot = list(lot)
            k = 0
            while k < len(lot):
                first, e = lot[k][1], k
                while e + 1 < len(lot) and lot[e + 1][1] - lot[e][1] - lot[e][2] <= gap and (
                        lot[e][1] + lot[e][2] - first <= most):
                    e += 1
                raw = f.read_at(lot[e][1] + lot[e][2] - first, first)
                for _, at, n in lot[k:e + 1]:
                    yield zlib.decompress(raw[at - first:at - first + n], GZIP)
                k = e + 1


RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
RECORD_TYPES = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]


def look_up(wanted: DataFrame, folder: str, shards: list[tuple[str, str]], payload: bool = False) -> DataFrame:
    """The records of each distinct (page_id, url) of ``wanted``, read through the
    index; with ``payload`` also the stored bytes. Wanted rows are dealt out by
    ranges of the key, so a task's look-ups fall into neighbouring blocks."""

    @F.pandas_udf("string")
    def key_of(urls):
        return urls.map(url_key, na_action=None)

    keys = wanted.select(key_of(F.col("url").cast("string")).alias("key"), F.col("page_id").cast("long").alias("page_id"))
    keys = keys.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id")
    types = RECORD_TYPES if payload else RECORD_TYPES[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, last = Index(folder, shards), None
        for b in batches:
            for k in range(0, b.num_rows, 2048):
                part, places = b.slice(k, 2048), []
                for key, page in zip(*[c.to_pylist() for c in part.columns], strict=True):
                    if (key, page) != last:
                        places += found.find(key, page)
                        last = (key, page)
                rows = []
                for raw in read_ranges(found.store, found.path, places):
                    r = parse(raw)
                    rows.append(tuple(r[n] for n, _ in types))
                    if payload and len(rows) >= 256:
                        yield _batch(rows, types)
                        rows = []
                if rows:
                    yield _batch(rows, types)

    return keys.mapInArrow(run, RECORD + (", payload binary" if payload else ""))


def archive_round_trip(pages: DataFrame, payload: bool = False) -> DataFrame:
    """Write ``pages`` as archives with an index, then read every capture back.

    One row per row of ``pages``: page_id, payload_bytes, payload_digest (of the
    full payload), record_type, refers_to. Null html is an empty payload; a null URL
    has the empty key; rows with a null id come back with a null id; rows that repeat
    an id and payload are all responses if theirs is the smallest id with that
    payload. Other columns are not read. An empty table gives no rows.
    """
    folder = work_folder(pages.sparkSession, "archive")
    store, path = _place(folder)
    store.create_dir(path)
    lines = write(pages, folder)
    shards = index(lines, folder)
    return look_up(pages, folder, shards, payload)
