"""Row and time windows.

Strategies for the row windows (lag / rolling / trend):

* ``plain``   — on request: ``Window.partitionBy(location).orderBy(timestamp, id)``:
  one Exchange + one Sort, and every lag / rolling statistic sharing the
  spec collapses into the same Window node. One location is one task.
* ``chunked`` — the default, skew-safe: the rows of a key that holds more than
  ``chunk_rows`` are cut into chunks at order statistics of (timestamp, id), which
  are found on those narrow columns alone (``key_cuts``). Every row compares itself
  with the cuts of its key, and the ``lookback`` rows before a cut are copied into
  the next chunk as a halo; the window runs per (location, chunk) and halo rows are
  dropped. No task sees more than ``chunk_rows + lookback`` rows, whatever the key
  skew, and full-width rows move once: one Exchange, one Sort. Results are
  identical to ``plain``.

``partition_by=None`` reproduces the reference's whole-frame row order
(ordered by timestamp, id) and is always chunked.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window, WindowSpec

from ..schema import ROW_ID, TARGET
from .numbering import global_row_number

DEFAULT_LAGS = [1, 2, 3, 6, 12, 24]
DEFAULT_WINDOWS = [3, 6, 12, 24]
DEFAULT_COLUMNS = ["traffic_volume", "avg_speed"]
CHUNK_ROWS = 1_000_000
MAX_CUTS = 100_000  # chunks of all large keys together: they are broadcast

# spec → {name: column} built against that spec
Builder = Callable[[WindowSpec], list[tuple[str, Column]]]


def _apply_windows(df: DataFrame, stages: list[Builder], partition_by: str | None,
                   order: list[str], lookback: int, strategy: str = "chunked",
                   chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Row windows by one plan: ``chunked`` bounds every task whatever a key holds.
    A caller who knows that no key is large may ask for ``plain``, one window group
    per key (no numbering pass); results are the same."""
    if strategy not in ("plain", "chunked"):
        raise ValueError(strategy)
    if strategy == "plain" and partition_by is not None:
        spec = Window.partitionBy(partition_by).orderBy(*order)
        out = df
        for st in stages:
            out = out.withColumns(dict(st(spec)))
        return out

    key = F.col(partition_by) if partition_by else F.lit(0)
    cuts = key_cuts(df, key, order, lookback, chunk_rows)
    parts = [partition_by] if partition_by else []
    if cuts is None:
        x, spec = df, Window.partitionBy(*(parts or [key])).orderBy(*order)
    else:
        at = F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(_columns(order))])
        meets = (key.eqNullSafe(F.col("_ck")) & (F.col("_from").isNull() | (at >= F.col("_from")))
                 & (F.col("_end").isNull() | (at < F.col("_end"))))
        x = (df.join(F.broadcast(cuts), meets, "left")
             .select(*[df[c] for c in df.columns], F.coalesce("_cut", F.lit(0)).alias("_chunk"),
                     F.coalesce(at < F.col("_start"), F.lit(False)).alias("_halo")))
        spec = Window.partitionBy(*parts, "_chunk").orderBy(*order)
    for st in stages:
        x = x.withColumns(dict(st(spec)))
    return x if cuts is None else x.filter(~F.col("_halo")).drop("_chunk", "_halo")


def _columns(order: list[str | Column]) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


def key_cuts(df: DataFrame, key: Column, order: list[str | Column], lookback: int, chunk_rows: int) -> DataFrame | None:
    """The chunks of every key with more than ``chunk_rows`` rows: (_ck, _cut, _from,
    _start, _end), the order keys that its halo and it begin at and that the next one
    begins at (null: open). None if no key has that many. ``order`` ends with an id.

    Only the key and order columns are read, and only those of large keys are sorted
    and numbered. There are at most as many large keys as the rows hold chunks; beyond
    ``MAX_CUTS`` of these the chunks get longer."""
    chunk_rows = max(int(chunk_rows), int(lookback), 1)
    names = [f"_o{i}" for i in range(len(order))]
    narrow = df.select(key.alias("_k"), *[o.alias(n) for n, o in zip(names, _columns(order), strict=True)])
    large = narrow.groupBy("_k").count().where(F.col("count") > chunk_rows)
    rows = large.toArrow().to_pylist()
    if not rows:
        return None
    chunk_rows = max(chunk_rows, sum(r["count"] for r in rows) // MAX_CUTS)
    spark = df.sparkSession
    keys = spark.createDataFrame([(r["_k"],) for r in rows], large.select(F.col("_k").alias("_large")).schema)
    numbered = global_row_number(narrow.join(F.broadcast(keys), F.col("_k").eqNullSafe(F.col("_large")), "left_semi"),
                                 ["_k", *names], "_rn")
    first = numbered.groupBy(F.col("_k").alias("_large")).agg(F.min("_rn").alias("_rn0"))
    place = F.col("_rn") - F.col("_rn0")
    marks = (numbered.join(F.broadcast(first), F.col("_k").eqNullSafe(F.col("_large")))
             .select("_k", (place / chunk_rows).cast("long").alias("c"), (place % chunk_rows).alias("m"), F.struct(*names).alias("at"))
             .where((F.col("m") == 0) | (F.col("m") == chunk_rows - lookback)))
    at = {(r["_k"], r["c"], r["m"]): r["at"] for r in marks.collect()}  # two a chunk at most
    last = {}
    for k, c, _ in at:
        last[k] = max(c, last.get(k, 0))
    halo = chunk_rows - lookback
    made = [(k, c, at.get((k, c - 1, halo)), at[k, c, 0] if c else None, at.get((k, c + 1, 0))) for k, n in last.items() for c in range(n + 1)]
    key_type, order_type = marks.schema["_k"].dataType, marks.schema["at"].dataType
    return spark.createDataFrame(made, T.StructType([
        T.StructField("_ck", key_type), T.StructField("_cut", T.LongType()), *[
            T.StructField(n, order_type) for n in ("_from", "_start", "_end")]]))


# --- W1 ------------------------------------------------------------------------

def lag_stage(columns: list[str], lags: list[int]) -> Builder:
    def build(spec):
        return [(f"{c}_lag_{k}h", F.lag(c, k).over(spec)) for c in columns for k in lags]
    return build


def lag_features(df: DataFrame, columns: list[str] | None = None, lags: list[int] | None = None,
                 partition_by: str | None = "location", order: list[str] | None = None,
                 **kw) -> DataFrame:
    """``{col}_lag_{k}h`` = value k rows earlier (row based, as named
    by the reference; see ``rolling_time`` for clock-true windows)."""
    columns = [c for c in (columns or DEFAULT_COLUMNS) if c in df.columns]
    lags = lags or DEFAULT_LAGS
    order = order or ["timestamp", ROW_ID]
    return _apply_windows(df, [lag_stage(columns, lags)], partition_by, order, max(lags), **kw)


# --- W2 ------------------------------------------------------------------------

def _rolling_cols(columns, windows, spec):
    out = []
    for c in columns:
        for k in windows:
            w = spec.rowsBetween(-(k - 1), 0)
            out += [
                (f"{c}_rolling_mean_{k}h", F.avg(c).over(w)),
                (f"{c}_rolling_std_{k}h", F.coalesce(F.stddev_samp(c).over(w), F.lit(0.0))),
                (f"{c}_rolling_max_{k}h", F.max(c).over(w)),
                (f"{c}_rolling_min_{k}h", F.min(c).over(w)),
            ]
    return out


def rolling_features(df: DataFrame, columns: list[str] | None = None,
                     windows: list[int] | None = None, partition_by: str | None = "location",
                     order: list[str] | None = None, **kw) -> DataFrame:
    """Trailing k rows incl. current (min 1 row): mean, sample std
    (0 when undefined), max, min → ``{col}_rolling_{stat}_{k}h``."""
    columns = [c for c in (columns or DEFAULT_COLUMNS) if c in df.columns]
    windows = windows or DEFAULT_WINDOWS
    order = order or ["timestamp", ROW_ID]
    return _apply_windows(df, [rolling_stage(columns, windows)], partition_by,
                          order, max(windows) - 1, **kw)


def rolling_stage(columns: list[str], windows: list[int]) -> Builder:
    return lambda spec: _rolling_cols(columns, windows, spec)


# --- W3 ------------------------------------------------------------------------

def trend_stages(window: int = 6, value: str = TARGET) -> list[Builder]:
    def smooth(spec):
        return [("_s", F.avg(value).over(spec.rowsBetween(-(window - 1), 0)))]

    def diff(spec):
        return [("_d", F.col("_s") - F.lag("_s", 1).over(spec))]

    def trend(spec):
        d = F.col("_d")
        return [("congestion_trend", F.when(d > 0.1, 1).when(d < -0.1, -1).otherwise(0)),
                ("congestion_acceleration", F.coalesce(d - F.lag(d, 1).over(spec), F.lit(0.0)))]
    return [smooth, diff, trend]


def congestion_trend(df: DataFrame, window: int = 6, value: str = TARGET,
                     partition_by: str | None = "location", order: list[str] | None = None,
                     **kw) -> DataFrame:
    """s = rolling mean (``window`` rows, min 1); d = s - previous s;
    trend = 1 if d > .1, -1 if d < -.1, else 0; acceleration = d - previous
    d (null → 0)."""
    order = order or ["timestamp", ROW_ID]
    out = _apply_windows(df, trend_stages(window, value), partition_by, order, window + 1, **kw)
    return out.drop("_s", "_d")


def fused_windows(df: DataFrame, stages: list[Builder], lookback: int,
                  partition_by: str | None = "location", order: list[str] | None = None,
                  **kw) -> DataFrame:
    """Run several window stages over ONE partitioning / ordering (one skew
    check, one numbering, one Exchange + Sort)."""
    return _apply_windows(df, stages, partition_by, order or ["timestamp", ROW_ID], lookback, **kw)


# --- W2t: clock-true rolling ---------------------------------------------------

def epoch_micros(ts: str | Column) -> Column:
    """Microseconds since 1970-01-01 of a wall-clock timestamp (no time zone
    involved, so the result does not depend on the session zone)."""
    t = F.col(ts) if isinstance(ts, str) else ts
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", epoch, t.cast("timestamp_ntz"))


HOUR_US = 3600 * 1_000_000
MAX_BLOCK_ROWS = 1_000_000
HOUR_FACTORS = [2] * 10 + [3] * 2 + [5] * 8  # of an hour in microseconds


def time_block_us(df: DataFrame, partition_by: str, ts: str = "timestamp",
                  max_block_rows: int = MAX_BLOCK_ROWS) -> int:
    """Block width for ``rolling_time``: one hour, divided until the densest
    (key, hour) is expected to fit ``max_block_rows`` per block (down to single
    instants). One aggregate; the width always divides an hour, so every window
    of whole hours spans a whole number of blocks."""
    e = epoch_micros(ts)
    hour = (e - F.pmod(e, F.lit(HOUR_US))) / F.lit(HOUR_US)
    densest = df.groupBy(F.col(partition_by), hour.alias("_h")).count().agg(F.max("count")).first()[0]
    parts = 1
    for f in HOUR_FACTORS:
        if (densest or 0) <= max_block_rows * parts:
            break
        parts *= f
    return HOUR_US // parts


def rolling_time(df: DataFrame, columns: list[str] | None = None, hours: list[int] | None = None,
                 partition_by: str = "location", ts: str = "timestamp",
                 block_us: int | None = None, max_block_rows: int = MAX_BLOCK_ROWS) -> DataFrame:
    """W2t: mean / max / min / count over the last k hours by clock,
    ``(ts - k h, ts]`` per ``partition_by`` (peers at ``ts`` included).

    Exact block decomposition instead of a sliding RANGE frame (which Spark
    re-aggregates over the whole frame for every row, and which needs all of
    a key's rows of the last k hours in one task). Time is cut into blocks of
    ``block_us`` (dividing an hour). For a row at t in block b the window is

    * tail: rows of block b up to t — a running aggregate over the block;
    * full: blocks b-k/B+1 … b-1 — a per-(key, block) pre-aggregate (one row
      per block, not per event) summed over a block-range window;
    * head: rows of block b-k/B later than t - k h — every row is also copied
      into block b+k/B with its time shifted by +k h, so the head is a
      reverse running aggregate over those copies in the same partition.

    Each (key, block) window partition holds one block of rows plus one copy
    per window length, so task size is bounded by the block width, which
    ``time_block_us`` fits to the densest key; all frames are running
    frames (O(1) per row).
    """
    columns = [c for c in (columns or DEFAULT_COLUMNS) if c in df.columns]
    hours = sorted({int(k) for k in (hours or [3, 24])})
    if hours[0] < 1:
        raise ValueError("window lengths are whole hours ≥ 1")
    if block_us is None:
        block_us = time_block_us(df, partition_by, ts, max_block_rows)
    if HOUR_US % block_us:
        raise ValueError("block width must divide one hour")
    nblk = {k: k * HOUR_US // block_us for k in hours}
    e = epoch_micros(ts)
    base = df.select("*", F.col(partition_by).alias("_k"), e.alias("_e"),
                     ((e - F.pmod(e, F.lit(block_us))) / F.lit(block_us)).cast("long").alias("_b"))
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    payload = ", ".join(f"`{c}`" for c in df.columns)

    # own row + one shifted copy per window length, in one codegen'd stack
    def row(kind, blk, s, p, own, k=None):
        vals = []
        for c in columns:
            vals.append(f"`{c}`" if own else f"CAST(NULL AS {types[c]})")
            vals += [f"`{c}`" if kk == k else f"CAST(NULL AS {types[c]})" for kk in hours]
        return ", ".join([str(kind), blk, s, p] + vals)

    stacked = [row(0, "_b", "_e", "_p", True)]
    stacked += [row(1, f"_b + {nblk[k]}", f"_e + {k * HOUR_US}", "IF(FALSE, _p, NULL)", False, k)
                for k in hours]
    names = ["_kind", "_pb", "_s", "_p"]
    for c in columns:
        names += [f"_o_{c}"] + [f"_c_{c}_{k}" for k in hours]
    x = (base.select("_k", "_b", "_e", F.expr(f"struct({payload}) AS _p"), *[f"`{c}`" for c in columns])
         .select("_k", F.expr(f"stack({len(stacked)}, {', '.join(stacked)}) AS ({', '.join(names)})")))

    part = Window.partitionBy("_k", "_pb")
    tail = part.orderBy("_s").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    # descending time, own rows (kind 0) before copies at the same instant:
    # a copy at shifted time t is an original at t - k h, outside (t - k h, t]
    head = part.orderBy(F.col("_s").desc(), "_kind").rowsBetween(Window.unboundedPreceding,
                                                                 Window.currentRow)
    agg = {}
    for c in columns:
        o = F.col(f"_o_{c}")
        agg.update({f"_ts_{c}": F.sum(o).over(tail), f"_tn_{c}": F.count(o).over(tail),
                    f"_tx_{c}": F.max(o).over(tail), f"_tm_{c}": F.min(o).over(tail)})
        for k in hours:
            h = F.col(f"_c_{c}_{k}")
            agg.update({f"_hs_{c}_{k}": F.sum(h).over(head), f"_hn_{c}_{k}": F.count(h).over(head),
                        f"_hx_{c}_{k}": F.max(h).over(head), f"_hm_{c}_{k}": F.min(h).over(head)})
    rows = x.withColumns(agg).filter(F.col("_kind") == 0)

    # full blocks: one row per (key, block), windowed over block numbers
    blocks = base.groupBy("_k", "_b").agg(*[a for c in columns for a in (
        F.sum(c).alias(f"_bs_{c}"), F.count(c).alias(f"_bn_{c}"),
        F.max(c).alias(f"_bx_{c}"), F.min(c).alias(f"_bm_{c}"))])
    full = {}
    for k in hours:
        if nblk[k] < 2:
            continue
        bw = Window.partitionBy("_k").orderBy("_b").rangeBetween(-(nblk[k] - 1), -1)
        for c in columns:
            full.update({f"_fs_{c}_{k}": F.sum(f"_bs_{c}").over(bw),
                         f"_fn_{c}_{k}": F.sum(f"_bn_{c}").over(bw),
                         f"_fx_{c}_{k}": F.max(f"_bx_{c}").over(bw),
                         f"_fm_{c}_{k}": F.min(f"_bm_{c}").over(bw)})
    if full:
        sums = blocks.select(F.col("_k").alias("_bk"), F.col("_b").alias("_bb"),
                             *[v.alias(n) for n, v in full.items()])
        # rows without a key are a key of their own; rows without a time are in no block
        rows = rows.join(sums, F.col("_k").eqNullSafe(F.col("_bk")) & (F.col("_pb") == F.col("_bb")), "left")

    def part_of(name):
        return F.col(name) if name in full else F.lit(None)

    out = {}
    for c in columns:
        for k in hours:
            tot = (F.coalesce(F.col(f"_ts_{c}"), F.lit(0)) + F.coalesce(F.col(f"_hs_{c}_{k}"), F.lit(0))
                   + F.coalesce(part_of(f"_fs_{c}_{k}"), F.lit(0)))
            n = F.col(f"_tn_{c}") + F.col(f"_hn_{c}_{k}") + F.coalesce(part_of(f"_fn_{c}_{k}"), F.lit(0))
            out[f"{c}_time_mean_{k}h"] = F.when(n > 0, tot.cast("double") / n)
            out[f"{c}_time_max_{k}h"] = F.greatest(F.col(f"_tx_{c}"), F.col(f"_hx_{c}_{k}"),
                                                   part_of(f"_fx_{c}_{k}").cast(types[c]))
            out[f"{c}_time_min_{k}h"] = F.least(F.col(f"_tm_{c}"), F.col(f"_hm_{c}_{k}"),
                                                part_of(f"_fm_{c}_{k}").cast(types[c]))
            out[f"{c}_time_count_{k}h"] = n.cast("long")
    return rows.select("_p.*", *[v.alias(n) for n, v in out.items()])


# --- W4 ------------------------------------------------------------------------

def bin_of_rank(r: int, n: int, q: int) -> int:
    """W4 formula for one rank (1-based) — used to size strata on the driver
    without another pass over the data."""
    if n <= 1:
        return 0
    return max(0, ((r - 1) * q + n - 2) // (n - 1) - 1)


def bin_sizes(n: int, q: int) -> dict[int, int]:
    """Rows per W4 bin for n ranked rows, in closed form (O(q) work)."""
    if n <= 0:
        return {}
    sizes: dict[int, int] = {}
    # bin b holds ranks r with ceil((r-1)q/(n-1)) - 1 == b; walk bin edges
    edges = [0] + [((b + 1) * (n - 1)) // q + 1 for b in range(q)]
    prev = 0
    for b in range(q):
        last = min(n, edges[b + 1])
        while last < n and bin_of_rank(last + 1, n, q) <= b:
            last += 1
        while last > prev and bin_of_rank(last, n, q) > b:
            last -= 1
        if last > prev:
            sizes[bin_of_rank(prev + 1, n, q)] = sizes.get(bin_of_rank(prev + 1, n, q), 0) + last - prev
        prev = last
    if prev < n:
        sizes[q - 1] = sizes.get(q - 1, 0) + n - prev
    return sizes


def bin_boundaries(df: DataFrame, col: str, id_col: str, q: int) -> tuple[list[int], list, int]:
    """W4 boundaries: the present bin ids, and for every bin but the last the
    (value, id) of its last row in (value, id) order, plus the number of rows. Found by
    exact distributed selection: the value is an order statistic of ``col``; when
    it repeats, the id is an order statistic of the id among the rows
    holding that value. Rows with a null ``col`` take no part."""
    from .quantiles import select_ranks, sketch_aggs
    v = F.col(col).cast("double")
    i = F.col(id_col).cast("long")  # ids beyond 2^53 do not fit a double
    values = df.select(v.alias("_v"))
    row = values.agg(*sketch_aggs(values, ["_v"])).first().asDict()
    n = row["n__v"]
    sizes = bin_sizes(n, q)
    present = sorted(sizes)
    last_rank, cum = [], 0
    for b in present[:-1]:
        cum += sizes[b]
        last_rank.append(cum)  # 1-based rank of the last row of bin b
    if not last_rank:
        return present, [], n
    vals = select_ranks(values, [("_v", r - 1) for r in last_rank], bounds=row)
    bvals = [vals[("_v", r - 1)] for r in last_rank]
    # a boundary inside a run of equal values needs the id of its row; one at
    # the end of the run (or on a unique value) does not
    need = [j for j, (r, (_bv, below, n_eq)) in enumerate(zip(last_rank, bvals))
            if n_eq is None or r - 1 - below != n_eq - 1]
    bids: dict[int, int | None] = {j: None for j in range(len(bvals))}
    if need:
        ties = df.select(*[F.when(v == F.lit(bvals[j][0]), i).alias(f"_i{j}") for j in need])
        reqs = {j: (f"_i{j}", last_rank[j] - 1 - bvals[j][1]) for j in need}
        ids = select_ranks(ties, list(reqs.values()))
        for j, req in reqs.items():
            bids[j] = int(ids[req][0])
    return present, [(bvals[j][0], bids[j]) for j in range(len(bvals))], n


def bin_expr(value: Column, row_id: Column, present: list[int], bounds: list) -> Column:
    """Bin of a row = the number of boundaries its (value, id) lies after,
    mapped onto the present bin ids (a narrow, literal-only expression)."""
    if not bounds:
        return F.when(value.isNotNull(), F.lit(present[0]))
    passed = None
    for bv, bid in bounds:
        after = value > F.lit(bv)
        if bid is not None:  # boundary inside a run of equal values: split it by id
            after = after | ((value == F.lit(bv)) & (row_id > F.lit(bid)))
        term = F.when(after, F.lit(1)).otherwise(F.lit(0))
        passed = term if passed is None else passed + term
    if present == list(range(len(present))):
        mapped = passed
    else:
        mapped = F.element_at(F.create_map(*[x for k, b in enumerate(present)
                                             for x in (F.lit(k), F.lit(b))]), passed)
    return F.when(value.isNotNull(), mapped).cast("int")


def quantile_bins(df: DataFrame, col: str = TARGET, q: int = 10, out: str = "bin",
                  id_col: str = ROW_ID) -> DataFrame:
    """Equal-count bins of the first-occurrence rank of ``col``
    (rank ties broken by row id): bin = max(0, ceil((r-1)·q/(n-1)) - 1),
    in exact integer arithmetic; n = 1 gives bin 0. Not ``ntile``.

    No sort and no shuffle of the rows: bins are contiguous in (value, id)
    order, so only the ≤ q-1 boundary rows are located (``bin_boundaries``,
    column-pruned selection passes) and each row compares itself with them
    in a narrow projection."""
    v = F.col(col)
    present, bounds, n = bin_boundaries(df, col, id_col, q)
    if n <= 1:
        return df.withColumn(out, F.when(v.isNotNull(), F.lit(0)))
    return df.withColumn(out, bin_expr(v.cast("double"), F.col(id_col), present, bounds))
