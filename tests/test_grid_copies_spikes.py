"""Regular grids, differences between copies and implausible readings against brute force on small fixtures."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import asof, copies, ordered_blocks, regular_grid, spikes

READINGS = "run bigint, us bigint, period bigint, value double"


def grid_by_hand(rows, fill):
    out = {}
    for run in {r[0] for r in rows if r[0] is not None}:
        own = sorted((r[1] // (r[2] * 1_000_000), r[1], r[3], r[2]) for r in rows if r[0] == run and r[1] is not None and r[2])
        slots = {s: (v, p) for s, _, v, p in own}
        keys = sorted(slots)
        for a, b in zip(keys, [*keys[1:], None], strict=False):
            v, p = slots[a]
            out[run, a * p] = ("observed", v)
            for s in range(a + 1, b if b is not None else a + 1):
                near = b - a - 1 <= fill
                w = slots[b][0]
                out[run, s * p] = ("filled", v + (w - v) * (s - a) / (b - a)) if near else ("missing", None)
    return out


def test_grid(spark):
    rng = random.Random(5)
    rows = [(run, rng.choice([-1, 1]) * rng.randrange(40_000) * 7_000_001, 60, float(rng.randrange(100))) for run in (1, 2) for _ in range(150)]
    rows += [(3, 5_000_000, 3600, 1.0), (4, None, 60, 1.0), (None, 1, 60, 1.0), (5, 1, None, 2.0), *rows[:5]]
    frame = spark.createDataFrame(rows, READINGS).withColumn("status", F.lit("clash"))
    made = regular_grid.regular_grid(frame, "run", "us", "period", ["value"], fill_up_to=3).collect()
    got = {(r["run"], r["slot_start_s"]): (r["status"], r["value"]) for r in made}
    wanted = grid_by_hand(rows, 3)
    assert len(made) == len(wanted) and got.keys() == wanted.keys()
    for k, (status, value) in wanted.items():
        assert got[k][0] == status and got[k][1] == (pytest.approx(value) if value is not None else None)


def test_grid_bounds_and_empty(spark):
    frame = spark.createDataFrame([(1, 600_000_000, 60, 1.0), (1, 1_200_000_000, 60, None)], READINGS)
    made = regular_grid.regular_grid(frame, "run", "us", "period", [], start_s=480, end_s=1320)
    got = {r["slot_start_s"]: r["status"] for r in made.collect()}
    assert sorted(got) == list(range(480, 1321, 60)) and {k for k, v in got.items() if v == "observed"} == {600, 1200}
    assert regular_grid.regular_grid(frame.limit(0), "run", "us", "period", ["value"]).collect() == []


def test_long_gap_is_spread(spark):
    frame = spark.createDataFrame([(1, 0, 1, 1.0), (1, 50_000_000_000, 1, 1.0)], READINGS)
    assert regular_grid.regular_grid(frame, "run", "us", "period").groupBy("status").count().orderBy("status").collect() == [("missing", 49_999), ("observed", 2)]


def test_timeframe_seconds(spark):
    rows = spark.createDataFrame([(t,) for t in ("M1", "m15", "H4", "D1", "W1", "M0", "", None)], "t string")
    assert [r[0] for r in rows.select(regular_grid.timeframe_seconds(F.col("t"))).collect()] == [60, 900, 14_400, 86_400, None, None, None, None]


def test_nearest(spark):
    rng = random.Random(3)
    points = sorted(rng.sample(range(-(10**9), 10**9), 300))
    asks = [x for x in rng.sample(range(-(10**9), 10**9), 200) if x not in points]
    rows = [(p, p) for p in points] + [(a, None) for a in asks]
    frame = spark.createDataFrame(rows, "n bigint, v bigint")
    for after in (True, False):
        made = {r["n"]: r["out"] for r in asof.nearest(frame, [], "n", "v", "out", after).collect()}
        for n, _ in rows:
            beyond = [p for p in points if (p > n if after else p < n)]
            assert made[n] == (None if not beyond else min(beyond) if after else max(beyond))


def differences_by_hand(a, b, fields):
    first = lambda rows: {k: v for k, v in reversed([((r[0], r[1]), r[2:]) for r in rows])}
    x, y, out = first(a), first(b), set()
    for k in x.keys() | y.keys():
        if k not in y:
            out.add((*k, "missing_in_candidate"))
        elif k not in x:
            out.add((*k, "missing_in_reference"))
        else:
            out |= {(*k, f) for f, p, q in zip(fields, x[k], y[k], strict=True) if p != q}
    return out


def test_differences(spark):
    rng = random.Random(9)
    make = lambda: [(rng.choice([None, 1, 2, 3]), rng.choice([None, "a", "b", *map(str, range(40))]), *(rng.choice([None, "1", "2", "x" * 50_000]) for _ in range(2))) for _ in range(120)]
    unique = lambda rows: list({r[:2]: r for r in rows}.values())
    a, b = unique(make()), unique(make())
    schema = "k bigint, d string, f string, g string"
    left, right = spark.createDataFrame(a + a[:20], schema).withColumn("_bucket", F.lit(1)), spark.createDataFrame(b + b[:9], schema)
    for buckets in (1, 7):
        made = copies.differences(left, right, ["k", "d"], ["f", "g"], buckets)
        rows = [(r["k"], r["d"], r["difference"]) for r in made.collect()]
        assert len(rows) == len(set(rows)) and set(rows) == differences_by_hand(a, b, ["f", "g"])
    none = left.limit(0)
    assert copies.differences(none, none, ["k", "d"], ["f"]).collect() == []
    assert {r["difference"] for r in copies.differences(left, none, ["k", "d"], ["f"]).collect()} == {"missing_in_candidate"}


def test_normal_forms(spark):
    numbers = {"1.50": "1.5", " +01,234.000 ": "1234", "-0.0": "0", ".5": "0.5", "1e2": "100", "abc": "abc", "": None, "  ": None, "9" * 60: "9" * 60, "-007": "-7"}
    rows = spark.createDataFrame([(k,) for k in numbers], "t string")
    assert [r[0] for r in rows.select(copies.number_text(F.col("t"))).collect()] == list(numbers.values())
    days = {"2020-09-09": "2020.09.09", "20200909": "2020.09.09", " 2020/09/09 ": "2020.09.09", "2020.09-09": None, "2020.02.30": None, "x": None}
    rows = spark.createDataFrame([(k,) for k in days], "t string")
    assert [r[0] for r in rows.select(copies.day_text(F.col("t"))).collect()] == list(days.values())


def test_numbered_and_blocks(spark):
    frame = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    rows = ordered_blocks.numbered(frame, ["k"], "test").collect()
    assert all(r["k"] == r["_at"] for r in rows) and len(rows) == 1000
    blocks = ordered_blocks.ordered_blocks(frame, ["k"], "test", halo=3, block_rows=100).groupBy("_block").agg(F.min("_at"), F.max("_at"), F.count("*")).orderBy("_block").collect()
    assert [tuple(r) for r in blocks] == [(b, max(0, b * 100 - 3), min(999, b * 100 + 102), min(999, b * 100 + 102) - max(0, b * 100 - 3) + 1) for b in range(10)] + [(10, 997, 999, 3)]  # the halo of a block that doesn't exist


def test_stuck_mask():
    one = np.zeros(40, np.int64)
    v = np.arange(40, dtype=float)
    v[5:15] = 7
    v[20:29] = 9
    assert list(np.flatnonzero(spikes.stuck_mask(one, v))) == list(range(5, 15))
    v[8] = np.nan
    assert list(np.flatnonzero(spikes.stuck_mask(one, v))) == list(range(5, 15))
    split = np.array([0] * 10 + [1] * 30)
    assert not spikes.stuck_mask(split, v).any()


def proposed(v, source=None, level=1):
    v, source, row = np.asarray(v, float), np.zeros(len(v), np.int64) if source is None else source, np.arange(len(v))
    first = spikes.details(source, row, v, 1)
    return list(np.flatnonzero(spikes.proposals(source, row, v, level, spikes.details(source, row, v, level), spikes.local_scale(row, first))[0]))


def test_details_against_the_definition():
    rng = np.random.default_rng(3)
    v, source, row = rng.normal(size=60), np.repeat([1, 2], 30), np.arange(60)
    for level in (1, 2, 3):
        h, got = 2 ** (level - 1), spikes.details(source, row, v, level)
        for t in range(60):
            inside = h <= t <= 60 - h and source[t - h] == source[t + h - 1]
            assert np.isnan(got[t]) if not inside else got[t] == pytest.approx(v[t : t + h].mean() - v[t - h : t].mean())


def test_proposals():
    flat = np.arange(12) % 2 * 0.1
    v = flat.copy()
    v[4:6] += 9
    assert proposed(v) == [4, 5] and proposed(v, level=2) == [4, 5]
    v[4:8] = flat[4:8] + 9
    assert proposed(v) == []  # four readings are a level of their own
    assert proposed(np.where(np.arange(12) < 6, 0, 9) + flat) == []
    assert proposed([0, 0.1, 0, 0.1, 4, 9, 4, 0, 0.1, 0, 0.1, 0], level=2) == [4, 5, 6]  # a slope either side
    assert proposed(flat + np.where(np.arange(12) == 5, 9, 0), np.repeat([1, 2], 6)) == []  # at the end of a source


RAW = "row_id bigint, run_id bigint, source_line bigint, date string, time string, loaded_at timestamp, open decimal(20,8), high decimal(20,8), low decimal(20,8), close decimal(20,8), volume decimal(20,8)"
RUNS = "run_id bigint, layout string, timeframe string, date_format string, time_format string, timestamp_format string, tz_offset string"


def readings(run, n, seed):
    rng = random.Random(seed)
    rows, price = [], 100.0
    for i in range(n):
        o = price
        price += rng.uniform(-0.1, 0.1)
        c = price
        rows.append([run * 10_000 + i, run, i, f"2025.01.{1 + i // 1440:02d}", f"{i // 60 % 24:02d}:{i % 60:02d}", None, o, max(o, c) + rng.uniform(0, 0.05), min(o, c) - rng.uniform(0, 0.05), c, float(i)])
    return rows


def test_implausible(spark):
    from decimal import Decimal

    a, b = readings(1, 600, 1), readings(2, 300, 2)
    a[100][7] += 20  # a spike of one reading
    for i in (200, 201, 202):
        a[i][8] -= 15  # of three
    for i in range(300, 600):
        for f in (6, 7, 8, 9):
            a[i][f] += 50  # a lasting change of level
    for i in range(400, 412):
        a[i][9] = a[399][9]  # stuck for 13 readings
        a[i][8], a[i][7] = min(a[i][8], a[i][9]), max(a[i][7], a[i][9])
    b[10][7] = 0.0
    b[11][9] = None
    b[12][7], b[12][8] = b[12][8], b[12][7]
    twin = list(a[100])
    twin[0], twin[2], twin[4] = 77_777, 5000, a[100][4] + ":00"
    lone = [[99_999, None, 1, None, None, None, 1.0, -1.0, None, None, None], [99_998, 3, 1, "x", None, None, 1.0, 1.0, 1.0, 1.0, None]]
    rows = [[*r[:6], *(None if v is None else Decimal(f"{v:.8f}") for v in r[6:])] for r in (*a, *b, twin, *lone)]
    frame = spark.createDataFrame([tuple(r) for r in rows], RAW).withColumn("reading", F.lit("clash")).withColumn("source", F.lit("clash"))
    runs = spark.createDataFrame([(r, "all_categories", "M1", None, None, None, "Z") for r in (1, 2, 3)], RUNS)
    made = spikes.implausible(frame, runs)
    by = {}
    for r in made.collect():
        by.setdefault(r["reason"], set()).add(r["row_id"])
    assert by["spike"] == {10_100, 77_777, 10_200, 10_201, 10_202, 20_010}
    assert by["stuck"] == set(range(10_399, 10_412))
    assert by["impossible"] == {20_010, 20_012, 99_999}
    assert spikes.implausible(frame.limit(0), runs).collect() == []


def frame_of(spark, rows):
    from decimal import Decimal

    return spark.createDataFrame([tuple(None if v is None else Decimal(f"{v:.8f}") if i > 5 else v for i, v in enumerate(r)) for r in rows], RAW)


def test_many_spikes(spark):
    """Of sizes that differ by far, every 6, 8, 15 or 25 readings; and one each in runs of 3 to 12 readings."""
    rows, wanted, lengths = [], set(), {}
    for run, every in enumerate((6, 8, 15, 25), 1):
        own = readings(run, 200, run)
        for k, i in enumerate(range(5, 195, every)):
            own[i][7] += 10 + 40 * k
            wanted.add(own[i][0])
        rows += own
    for n in range(3, 13):
        own = readings(10 + n, n, n)
        own[n // 2][9] += 50
        own[n // 2][7] += 50
        wanted.add(own[n // 2][0])
        lengths[10 + n] = n
        rows += own
    runs = spark.createDataFrame([(r, "all_categories", "M1", None, None, None, "Z") for r in (1, 2, 3, 4, *lengths)], RUNS)
    made = spikes.implausible(frame_of(spark, rows), runs).where("reason = 'spike'").collect()
    assert {r["row_id"] for r in made} == wanted


def test_other_runs_and_blocks_change_nothing(spark):
    rows = readings(5, 300, 7)
    for i in (1, 20, 60, 64, 120, 200, 298):
        rows[i][7] += 8
    for i in range(100, 112):
        rows[i][8] = rows[99][8] - 1
    others = readings(1, 111, 1) + readings(7, 53, 2) + readings(3, 9, 3)
    runs = spark.createDataFrame([(r, "all_categories", "M1", None, None, None, "Z") for r in (1, 3, 5, 7)], RUNS)
    found = []
    for extra, size in (([], 32768), (others, 32768), (others, 250), ([], 250)):
        made = spikes.implausible(frame_of(spark, rows + extra), runs, block_rows=size).collect()
        found.append(sorted((r["row_id"], r["reason"], str(r["field"])) for r in made if 50_000 <= r["row_id"] < 60_000))
    assert found[0] == found[1] == found[2] == found[3] and {r for r, k, _ in found[0] if k == "spike"} == {50_000 + i for i in (1, 20, 60, 64, 120, 200, 298)}


def test_no_spikes(spark):
    """A lively period, a lasting change of level and a value that moves by one step are no cases."""
    rng, rows = random.Random(4), readings(1, 300, 4)
    for i in range(100, 160):
        for f in (6, 7, 8, 9):
            rows[i][f] += rng.uniform(-0.5, 0.5)
        rows[i][7], rows[i][8] = max(rows[i][6:10]), min(rows[i][6:10])
    for r in rows[200:]:
        for f in (6, 7, 8, 9):
            r[f] += 40
    steps = readings(2, 9, 5)
    for i, r in enumerate(steps):
        r[6] = r[7] = r[8] = r[9] = 100.01 if i == 4 else 100.0
    runs = spark.createDataFrame([(r, "all_categories", "M1", None, None, None, "Z") for r in (1, 2)], RUNS)
    assert spikes.implausible(frame_of(spark, rows + steps), runs).where("reason = 'spike'").collect() == []


def test_copies_by_instant(spark):
    """Equal readings of one minute are readings of their own if their seconds differ; a text cut to the minute is a copy."""
    rows = readings(1, 40, 9)
    for k in range(9):
        rows.append([10_500 + k, *rows[20][1:4], f"00:20:{5 * k + 5:02d}", *rows[20][5:]])
    rows[20][4] = "00:20:01"
    cut = [10_600, *rows[20][1:4], "00:20", *rows[20][5:]]
    runs = spark.createDataFrame([(1, "all_categories", "M1", None, None, None, "Z")], RUNS)
    made = spikes.implausible(frame_of(spark, [*rows, cut]), runs).where("reason = 'stuck'").collect()
    assert {r["row_id"] for r in made} == {10_020, 10_600, *range(10_500, 10_509)}
    copies = [[10_700 + k, *rows[30][1:3], *rows[30][3:]] for k in range(12)]
    assert spikes.implausible(frame_of(spark, [*rows[:40], *copies]), runs).collect() == []
