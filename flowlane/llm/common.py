"""Shared pieces of the training-data operators: the working folder, written
intermediate tables, and connected components over an edge table."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import zipfile
from collections.abc import Iterable
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlane.session import ensure_checkpoint_dir


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one that ``spark.checkpoint.dir`` names
    (a folder of our own only where that is unset, as in tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it again.

    Unlike a cached table it survives the loss of any executor.
    """
    spark = df.sparkSession
    path = work_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def place(folder: str) -> tuple[fs.FileSystem, str]:
    """The store of a folder, and the folder's path there."""
    if folder.startswith("file:/") and not folder.startswith("file://"):
        folder = "file://" + folder[len("file:"):]
    return fs.FileSystem.from_uri(folder)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have (names are compared without case)."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def ship(spark: SparkSession) -> None:
    """Hand this package to the executors' Python workers (as ``--py-files`` would),
    once a session, for sessions whose workers do not have it installed."""
    sc = spark.sparkContext
    if getattr(sc, "_flowlane_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    with tempfile.NamedTemporaryFile(prefix="flowlane-", suffix=".zip", delete=False) as f:
        with zipfile.ZipFile(f, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent).as_posix())
    sc.addPyFile(f.name)
    sc._flowlane_shipped = True


def give_back() -> None:
    """Return the memory that a worker has freed to the system, at the end of a task:
    Spark keeps idle workers, and what their allocators hold is missing in later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
    if trim:
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hash_sample(df: DataFrame, key: Column, k: int, *ties: str) -> DataFrame:
    """At most ``k`` rows of ``df``: those with the smallest hashes ``key`` (a long), ties
    by the columns named. Rows that cannot be among them are left out by their hash
    beforehand, so a task passes on its share of the sample, not ``k`` rows."""
    n = df.count()
    unit = F.shiftrightunsigned(key, 11).cast("double") * F.lit(2.0 ** -53)
    return df.where(unit < min(1.0, (1.5 * k + 100) / max(n, 1))).orderBy(unit, *ties).limit(k)


def held_out(doc_id="doc_id"):
    """True for the fold no label may be learnt from: crc32(text of id) mod 5 = 0.

    A null id counts as held out, so nothing is learnt from it.
    """
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (a, b): rows (node, root), root being the
    smallest node reachable. Nodes without an edge do not appear.

    Alternating large-star and small-star steps written as aggregate + join, so
    a node with very many edges is pre-aggregated and its join side can be split
    by AQE; no neighbour list is ever collected. Every round is written to the
    shared folder. Ends when a round changes nothing; raises if ``max_rounds``
    (far beyond the logarithmic need) do not suffice.
    """
    e = edges.select("a", "b").where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = written(e, "edges")
    before = _digest(e)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # large star: every larger neighbour of a moves to a's smallest neighbour
        e = (both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
             .where("a <> b").distinct())
        # small star: every smaller neighbour, and a itself, moves to the smallest
        low = e.groupBy("a").agg(F.min("b").alias("m"))
        e = written(
            e.join(low, "a").select(F.explode(F.array(
                F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                F.struct(F.col("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b").where("a <> b").distinct(), "edges")
        now = _digest(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    stars = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.union(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _digest(e: DataFrame) -> tuple:
    r = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
    return r[0], r[1]


def forest(n: int, pairs: Iterable[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Root position of each of ``n`` positions under the links of ``pairs``."""
    root = np.arange(n)
    for i, j in pairs:
        while len(i):
            a, b = root[i], root[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(up := root[root], root):
                root = up
    return root
