"""Problem 2: implausible readings, judged against the normal behaviour of their own source.

Three tests, each on a reading's fields on its own:

* impossible: bounds on a single row, a filter in the JVM;
* stuck: runs of zero Haar details, that is a value kept over ``STUCK`` or more readings in order of time;
* spikes: a stationary Haar transform of ``LEVELS`` levels per source. The detail of level j at a reading is the mean of the
  2^(j-1) readings from it on less the mean of as many before it. A segment of 1 to ``WIDTH`` readings is a spike if at one level the
  details where it begins and where it ends have opposite signs and both exceed ``FAR`` robust standard deviations of the source's
  details of that level, and ``LOCAL_FAR`` of those of the readings around it. A lasting change of level has no second detail,
  and a lively period has large ones all around. An exact check follows, on the shape alone: each reading of the segment lies
  beyond the readings before and after, and beyond the median of those around it, by half of the smaller detail or more, so that
  what lies between two spikes is none.

A robust standard deviation is the median of the absolute details that aren't zero, over 0.6745, after setting aside the largest
ones that a single spike can make (``ASIDE``), so that a spike among few readings doesn't judge itself.

Re-sent copies are merged first (partial aggregation before the shuffle). The order-dependent tests run in blocks of equal size with
a halo, so one source may hold any share of the rows. What a block decides depends on the ``REACH`` rows around a reading only,
and the source's scales are merged from all blocks' histograms, so no result depends on where a block ends.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.plans import small_side, written
from tickloom.operators.ordered_blocks import BLOCK_ROWS, ordered_blocks
from tickloom.operators.regular_grid import timeframe_seconds
from tickloom.operators.timestamps import instants

FIELDS = ("high", "low", "close")
STUCK = 10
WIDTH = 3
#: Nulls in a row that a stuck stretch passes over.
BRIDGE = 3
LEVELS = 3
#: Details beyond so many robust standard deviations, of the source and of the ``REACH`` rows to either side, make a spike.
FAR, LOCAL_FAR = 22.0, 9.0
#: The most details of each level, from 1 on, that one spike makes large.
ASIDE = (2, 6, 10)
#: Rows that a segment with the readings it is compared with may span, and rows to either side that count as around it.
REACH = 20
#: Rows after a coarsely written reading among which a finer copy of it is looked for.
COPY_ROWS = 64
#: Rows copied from either neighbour block; no test looks further.
HALO = 3 * REACH + 2 * COPY_ROWS
#: Histogram bins of details to a factor of 2; within a bin the scale is interpolated.
BINS = 4
NORMAL = 0.6745

_OUT = "source bigint, field int, kind string, level int, reading bigint, at bigint, copies bigint, row_id bigint, size double, bridge double, bin int, n bigint"
_KINDS = {"source": "int64", "field": "int32", "kind": "str", "level": "int32", "reading": "int64", "at": "int64", "copies": "int64", "row_id": "int64", "size": "float64", "bridge": "float64", "bin": "int32", "n": "int64"}
_ZERO = -(2**30)


def impossible(high: Column, low: Column, close: Column) -> Column:
    """True where a value isn't above zero, high is below low, or close lies outside low to high. Nulls don't count."""
    tests = [high <= 0, low <= 0, close <= 0, high < low, close < low, close > high]
    return reduce(or_, (F.coalesce(t, F.lit(False)) for t in tests))


def stuck_mask(source: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Readings in a stretch of ``STUCK`` or more of one source that keeps one value; up to ``BRIDGE`` nulls in a row are passed over."""
    out = np.zeros(len(values), bool)
    known = np.flatnonzero(~np.isnan(values))
    if len(known) < 2:
        return out
    v, s = values[known], source[known]
    detail = np.diff(v) / 2
    joined = (detail == 0) & (s[1:] == s[:-1]) & (np.diff(known) <= BRIDGE + 1)
    edges = np.flatnonzero(np.concatenate(([True], ~joined, [True])))
    for a, b in zip(edges[:-1], edges[1:] - 1, strict=True):
        if known[b] - known[a] + 1 >= STUCK:
            out[known[a] : known[b] + 1] = True
    return out


def details(source: np.ndarray, row: np.ndarray, v: np.ndarray, level: int) -> np.ndarray:
    """The stationary Haar details of a level: entry t is the mean of readings t to t + h - 1 less that of t - h to t - 1, with
    h = 2^(level - 1); NaN where they are of several sources or span more than ``REACH`` rows."""
    n, h = len(v), 2 ** (level - 1)
    out = np.full(n, np.nan)
    if n < 2 * h:
        return out
    sums = np.add.reduce([v[k : n - h + 1 + k] for k in range(h)]) / h
    t = np.arange(h, n - h + 1)
    near = (source[t - h] == source[t + h - 1]) & (row[t + h - 1] - row[t - h] <= REACH)
    out[t] = np.where(near, sums[t] - sums[t - h], np.nan)
    return out


def local_scale(row: np.ndarray, detail: np.ndarray) -> np.ndarray:
    """For each detail of level 1 the robust standard deviation of those within ``REACH`` rows of it; NaN if there are none but a spike's."""
    n = len(detail)
    sizes = np.abs(detail)
    sizes[~(sizes > 0)] = np.inf
    padded = np.concatenate((np.full(REACH, np.inf), sizes, np.full(REACH, np.inf))).astype(np.float32)
    rows = np.concatenate((np.full(REACH, -(2**40)), row, np.full(REACH, 2**40)))
    width = 2 * REACH + 1
    around = np.lib.stride_tricks.sliding_window_view(padded, width)
    far = np.abs(np.lib.stride_tricks.sliding_window_view(rows, width) - row[:, None]) > REACH
    around = np.where(far, np.inf, around)
    around.sort(axis=1)
    rank = (np.isfinite(around).sum(axis=1) - ASIDE[0] + 1) // 2
    out = around[np.arange(n), np.maximum(rank, 1) - 1] / NORMAL
    return np.where(rank >= 1, out, np.nan)


def usual_level(source: np.ndarray, row: np.ndarray, v: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
    """The median of a source's readings within ``REACH`` rows of each segment, the segment's own left out."""
    at = first[:, None] + np.arange(-REACH, REACH + width)
    inside = (at >= 0) & (at < len(v)) & ((at < first[:, None]) | (at >= first[:, None] + width))
    at = np.clip(at, 0, max(0, len(v) - 1))
    inside &= (source[at] == source[first][:, None]) & (np.abs(row[at] - row[first][:, None]) <= REACH)
    around = np.sort(np.where(inside, v[at], np.inf), axis=1)
    n, rows = inside.sum(axis=1), np.arange(len(first))
    return (around[rows, np.maximum(n - 1, 0) // 2] + around[rows, n // 2]) / 2


def proposals(source: np.ndarray, row: np.ndarray, v: np.ndarray, level: int, detail: np.ndarray, local: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each reading the largest smaller detail of the segments at whose ends the details of ``level`` have opposite signs and
    exceed ``LOCAL_FAR`` of the local scale, and that pass the check of the shape; 0 if there is none. And the move from the
    reading before that segment to the one after it."""
    n, best, bridge = len(v), np.zeros(len(v)), np.full(len(v), np.nan)
    for width in range(1, WIDTH + 1):
        m = n - width - 1
        if m < 1:
            break
        t = np.arange(1, m + 1)  # the segment's first reading
        enter, leave = detail[t], detail[t + width]
        sign = np.sign(enter)
        size = np.minimum(np.abs(enter), np.abs(leave))
        with np.errstate(invalid="ignore"):
            good = (sign * np.sign(leave) < 0) & (source[t - 1] == source[t + width]) & (row[t + width] - row[t - 1] <= REACH)
            good &= ~(size <= LOCAL_FAR * np.fmax(local[t], local[t + width]))
        t = t[good]
        size, sign = size[good], sign[good]
        least = np.minimum.reduce([np.minimum(sign * (v[t + k] - v[t - 1]), sign * (v[t + k] - v[t + width])) for k in range(width)])
        held = least * 2 >= size
        t, size, sign = t[held], size[held], sign[held]
        level_around = usual_level(source, row, v, t, width)
        held = np.minimum.reduce([sign * (v[t + k] - level_around) for k in range(width)]) * 2 > size
        t, size = t[held], size[held]
        for k in range(width):
            more = size > best[t + k]
            best[t[more] + k] = size[more]
            bridge[t[more] + k] = np.abs(v[t[more] + width] - v[t[more] - 1])
    return best, bridge


def _without_coarse_copies(frame: pd.DataFrame) -> pd.DataFrame:
    """``frame``, in order, without readings of which a finer written copy follows; these count in its ``copies``."""
    source, reading, at, unit, row = (frame[c].to_numpy() for c in ("source", "reading", "at", "unit", "_at"))
    order = np.lexsort((-unit, at, reading, source))
    a, b = order[:-1], order[1:]
    same = (source[a] == source[b]) & (reading[a] == reading[b]) & (at[b] < at[a] + unit[a]) & (unit[b] < unit[a])
    same &= np.abs(row[b] - row[a]) <= COPY_ROWS
    if not same.any():
        return frame
    copies = frame["copies"].to_numpy().copy()
    for i in np.flatnonzero(same):  # in order, so that a copy's copies are passed on
        copies[order[i + 1]] += copies[order[i]]
    keep = np.ones(len(frame), bool)
    keep[a[same]] = False
    return frame.assign(copies=copies)[keep]


def _block(frame: pd.DataFrame, block_rows: int) -> pd.DataFrame:
    """Rows of kind stuck, spike (``size`` is the detail to be held against the source's scale) and scale (``n`` details in a bin)."""
    frame = _without_coarse_copies(frame.sort_values("_at", kind="stable"))
    at, block = frame["_at"].to_numpy(), int(frame["_block"].iloc[0])
    own = at // block_rows == block
    source = frame["source"].to_numpy()
    names = {c: frame[c].to_numpy() for c in ("reading", "at", "copies", "row_id")}
    out = []

    def give(rows: int, **columns: object) -> None:
        if rows:
            base = {"source": 0, "field": 0, "kind": "", "level": 1, "reading": 0, "at": 0, "copies": 0, "row_id": 0, "size": 0.0, "bridge": 0.0, "bin": 0, "n": 0}
            out.append(pd.DataFrame(base | columns, index=range(rows)))

    for f, name in enumerate(FIELDS):
        whole = frame[name].to_numpy(float)
        i = np.flatnonzero(stuck_mask(source, whole) & own)
        give(len(i), source=source[i], field=f, kind="stuck", **{c: x[i] for c, x in names.items()})
        known = np.flatnonzero(~np.isnan(whole))
        v, s, mine = whole[known], source[known], own[known]
        if len(v) < 2:
            continue
        local = None
        for level in range(1, LEVELS + 1):
            detail = details(s, known, v, level)
            local = local_scale(known, detail) if local is None else local
            t = np.flatnonzero(mine & ~np.isnan(detail))
            moved = np.abs(detail[t])
            bins = np.where(moved > 0, np.floor(np.log2(np.maximum(moved, 1e-300)) * BINS), _ZERO).astype(np.int64)
            sources, which = np.unique(s[t], return_inverse=True)
            cells, counts = np.unique(which * 2**33 + (bins - _ZERO), return_counts=True)
            give(len(cells), source=sources[cells >> 33] if len(cells) else 0, field=f, kind="scale", level=level, bin=(cells & (2**33 - 1)) + _ZERO, n=counts)
            sizes, bridge = proposals(s, known, v, level, detail, local)
            i = np.flatnonzero((sizes > 0) & mine)
            give(len(i), source=s[i], field=f, kind="spike", level=level, size=sizes[i], bridge=bridge[i], **{c: x[known[i]] for c, x in names.items()})
    return pd.concat(out, ignore_index=True).astype(_KINDS) if out else pd.DataFrame({c: pd.Series(dtype=t) for c, t in _KINDS.items()})


def _scales(parts: DataFrame) -> DataFrame:
    """(source, field, level, scale, zeros) from the merged histograms; a scale is null where no detail but a spike's own isn't zero."""
    bins = parts.where(F.col("kind") == "scale").groupBy("source", "field", "level", "bin").agg(F.sum("n").alias("n"))
    moved = F.col("bin") > _ZERO
    held = bins.groupBy("source", "field", "level").agg(
        F.array_sort(F.collect_list(F.when(moved, F.struct("bin", "n")))).alias("bins"),  # bounded by the range of a double
        F.coalesce(F.sum(F.when(moved, F.col("n"))), F.lit(0)).alias("total"),
        F.coalesce(F.sum(F.when(~moved, F.col("n"))), F.lit(0)).alias("zeros"),
    )
    held = held.withColumn("rank", F.expr("(total - element_at(array({}), level) + 1) div 2".format(", ".join(map(str, ASIDE)))))
    found = F.expr("aggregate(bins, named_struct('left', rank, 'at', cast(null as double)), (a, x) -> if(a.left <= 0, a, named_struct('left', a.left - x.n, 'at', x.bin + least(1D, a.left / x.n))), a -> a.at)")
    return held.select("source", "field", "level", "zeros", F.when(F.col("rank") >= 1, F.pow(F.lit(2.0), found / BINS) / NORMAL).alias("scale"))


def implausible(readings: DataFrame, runs: DataFrame, label: str = "implausible", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(row_id, reason, field) of every reading of ``readings`` that is impossible, stuck or a spike; copies are flagged alike.

    ``readings`` has run_id, row_id, source_line, date, time, loaded_at and the prices. Copies are readings of a run with the same values
    whose instants agree to the coarser of their written precisions. Readings whose text names no instant take the nearer one of a
    repeated local time, else the middle of the period before they were loaded; without that either, or without a run, only the bounds
    are tested. A null value is no reading of its field; segments and their neighbours span ``REACH`` rows at most. A source of
    three readings is judged by the move from the first to the last; of one that moves nowhere but in the spike, the spike counts
    if ``STUCK`` readings or more keep their value. Runs jobs while the plan is made: the rows in order and the blocks' outcome are written."""
    xxhash = F.xxhash64("run_id", *FIELDS, "open", "volume")
    own = [F.col("run_id").cast("bigint").alias("source"), xxhash.alias("reading"), *(F.col(c).cast("double").alias(c) for c in FIELDS)]
    keep = ["row_id", "run_id", "source_line", "loaded_at", "open", *FIELDS, "volume"]

    def timed(rows: DataFrame) -> DataFrame:
        rows = instants(rows, runs, "all_categories", keep, ["timeframe"], candidates=True)
        loaded, period = F.unix_micros("loaded_at"), F.coalesce(timeframe_seconds(F.col("timeframe")), F.lit(60)) * 1000000
        near = F.expr("element_at(array_sort(transform(utc_candidates, u -> struct(abs(unix_micros(loaded_at) - u) as away, u as us))), 1).us")
        before = F.floor(loaded / period) * period - F.floor(period / 2)
        rows = rows.withColumn("at", F.coalesce("utc_us", F.when(F.size("utc_candidates") > 1, near), before).cast("bigint"))
        return rows.select("row_id", "source_line", *own, "at", F.coalesce("unit_us", F.lit(1).cast("bigint")).alias("unit"))

    placed = timed(readings).where(F.col("source").isNotNull() & F.col("at").isNotNull())
    # Copies of one instant and precision collapse here, before the shuffle.
    merged = placed.groupBy("source", "reading", "at", "unit").agg(
        F.min("source_line").alias("line"), F.min("row_id").alias("row_id"), F.count("*").alias("copies"), *(F.first(c).alias(c) for c in FIELDS)
    )
    blocks = ordered_blocks(merged, ["source", "at", "line", "reading"], f"{label}-order", HALO, block_rows)
    columns = blocks.select("_block", "_at", "source", "reading", "at", "unit", "copies", "row_id", *FIELDS)
    parts = written(columns.groupBy("_block").applyInPandas(lambda pdf: _block(pdf, block_rows), _OUT), f"{label}-parts")
    spikes = parts.where(F.col("kind") == "spike").join(_scales(parts), ["source", "field", "level"])
    alone = (F.col("bridge") > 0) & (F.col("size") > F.col("bridge") * FAR / NORMAL) | (F.col("bridge") == 0) & (F.col("zeros") >= STUCK)
    spikes = spikes.where(F.when(F.col("scale").isNotNull(), F.col("size") > F.col("scale") * FAR).otherwise((F.col("level") == 1) & alone))
    field = F.element_at(F.array(*(F.lit(f) for f in FIELDS)), F.col("field") + 1)
    what = ["source", "reading", "at", "copies", "row_id", F.col("kind").alias("reason"), field.alias("field")]
    cases = written(parts.where(F.col("kind") == "stuck").select(*what).unionByName(spikes.select(*what).distinct()), f"{label}-cases")

    # A reading without copies is its row; only rows with the values of the others are looked up and placed again.
    several = cases.where(F.col("copies") > 1).drop("row_id", "copies")
    keys = several.select("reading").distinct()
    again = readings.withColumn("_reading", xxhash).join(small_side(keys.withColumnRenamed("reading", "_reading"), cases), "_reading", "left_semi").drop("_reading")
    again = timed(again).withColumnRenamed("at", "_from")
    copies = again.join(small_side(several, cases), ["source", "reading"]).where((F.col("_from") <= F.col("at")) & (F.col("at") < F.col("_from") + F.col("unit")))
    found = cases.where(F.col("copies") == 1).select("row_id", "reason", "field").unionByName(copies.select("row_id", "reason", "field"))
    bounds = readings.where(impossible(*(F.col(c) for c in FIELDS)))
    return bounds.select("row_id", F.lit("impossible").alias("reason"), F.lit(None).cast("string").alias("field")).unionByName(found)
