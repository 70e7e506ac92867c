"""Problem 4: irregular readings onto a regular grid per source, with missing periods filled or marked.

Readings are pre-aggregated to one row per source and period. ``lead`` pairs consecutive periods; only the periods between two
of them are exploded, never the whole grid, and they are interpolated or marked inline by the length of the gap. No window holds
more than ``FANOUT`` rows whatever one source's share of the data: the period number is cut into digits to the base ``FANOUT``
and each level pairs the rows of one node with the first row of the next node taken from the level above.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.plans import written

FANOUT = 4096
#: Longest run of periods made by one row before the rest is spread over further rows.
CHUNK = 8192
OBSERVED, FILLED, MISSING = "observed", "filled", "missing"
#: Seconds of the timeframes in use.
TIMEFRAMES = {"M1": 60, "M5": 300, "M15": 900, "M30": 1800, "H1": 3600, "H4": 14400, "D1": 86400}


def timeframe_seconds(text: Column) -> Column:
    """Seconds of a timeframe such as M15, H4 or D1, or null."""
    t = F.upper(F.trim(text))
    unit = F.when(t.startswith("M"), 60).when(t.startswith("H"), 3600).when(t.startswith("D"), 86400)
    return F.when(t.rlike(r"^[MHD][1-9]\d{0,5}$"), unit.cast("bigint") * F.substring(t, 2, 6).cast("bigint"))


def next_in_order(df: DataFrame, keys: list[str], number: str, row: str, out: str, levels: int = 2) -> DataFrame:
    """Adds ``out``: the struct ``row`` of the next larger ``number`` of the same keys, or null.

    ``row`` must be a struct that begins with the number; (keys, number) must be unique. The top level's windows hold one row per
    ``FANOUT ** levels`` numbers in use."""
    node = [f"_node{i}" for i in range(1, levels + 1)]
    for i, name in enumerate(node, 1):
        df = df.withColumn(name, F.expr(f"floor({number} / {FANOUT}L)") if i == 1 else F.expr(f"floor({node[i - 2]} / {FANOUT}L)"))

    def lead(frame: DataFrame, by: list[str], order: str) -> DataFrame:
        return frame.withColumn("_next", F.lead("_row").over(Window.partitionBy(*by).orderBy(order)))

    above = df.select(*keys, *node, F.col(row).alias("_row"))
    heads = []
    for i in range(levels):
        above = above.groupBy(*keys, *node[i:]).agg(F.min("_row").alias("_row"))
        heads.append(above)
    done = lead(heads[-1], keys, node[-1]).select(*keys, node[-1], F.col("_next").alias("_after"))
    for i in range(levels - 2, -1, -1):
        level = lead(heads[i], [*keys, node[i + 1]], node[i]).join(done, [*keys, node[i + 1]], "left")
        done = level.select(*keys, node[i], F.coalesce("_next", "_after").alias("_after"))
    return lead(df.withColumn("_row", F.col(row)), [*keys, node[0]], number).join(done, [*keys, node[0]], "left").withColumn(out, F.coalesce("_next", "_after")).drop("_next", "_after", "_row", *node)


def spread(df: DataFrame, first: Column, count: Column, out: str) -> DataFrame:
    """Explodes the numbers ``first`` to ``first + count - 1`` into ``out``, ``CHUNK`` at most by one generated row."""
    df = df.withColumn("_first", first).withColumn("_end", F.col("_first") + count - 1)
    df = df.where(F.col("_end") >= F.col("_first")).withColumn("_from", F.explode(F.sequence("_first", "_end", F.lit(CHUNK).cast("bigint"))))
    return df.withColumn(out, F.explode(F.sequence("_from", F.least("_end", F.col("_from") + CHUNK - 1)))).drop("_first", "_end", "_from")


def regular_grid(readings: DataFrame, source: str, instant_us: str, period_s: str, values: list[str] | None = None, fill_up_to: int = 3, start_s: int | None = None, end_s: int | None = None) -> DataFrame:
    """One row per source and period from its first reading to its last: (source, period_s, slot_start_s, status, n_readings, values).

    Periods are aligned to 1970-01-01 UTC. ``status`` is ``observed``; ``filled`` where at most ``fill_up_to`` periods in a row are
    missing and each of ``values`` (numbers; the last reading of its period by instant) is interpolated between its neighbours, null
    if a neighbour is null; or ``missing`` with null values. ``start_s`` and ``end_s`` extend every source's grid to these instants
    with ``missing`` rows. Rows with a null source, instant or period are no readings; repeated rows count in ``n_readings`` only."""
    values = values or []
    rows = readings.where(F.col(source).isNotNull() & F.col(instant_us).isNotNull() & (F.col(period_s) > 0))
    rows = rows.select("*", F.col(instant_us).alias("_us"), (F.col(period_s).cast("bigint")).alias("_period"))
    slot = F.expr("_us div (_period * 1000000) - if(pmod(_us, _period * 1000000) <> 0 and _us < 0, 1, 0)")
    rows = rows.select(F.col(source).alias("_source"), "_period", slot.alias("_slot"), "_us", *(F.col(v).cast("double").alias(f"_v{i}") for i, v in enumerate(values)))
    last = [F.max_by(F.struct(*(f"_v{i}" for i in range(len(values)))), F.struct("_us", *(f"_v{i}" for i in range(len(values))))).alias("_values")] if values else []
    slots = rows.groupBy("_source", "_period", "_slot").agg(F.count("*").alias("_n"), *last)
    # Every level of the pairing reads the slots; written once, the readings are parsed and shuffled once.
    slots = written(slots, "grid-slots")
    slots = slots.withColumn("_here", F.struct("_slot", *(["_values"] if values else [])))
    slots = next_in_order(slots, ["_source", "_period"], "_slot", "_here", "_there")
    gap = F.coalesce(F.col("_there._slot") - F.col("_slot") - 1, F.lit(0).cast("bigint"))
    slots = slots.withColumn("_gap", gap)

    def shown(frame: DataFrame, status: Column, n: Column, value) -> DataFrame:
        return frame.select(F.col("_source").alias(source), F.col("_period").alias(period_s), (F.col("_at") * F.col("_period")).alias("slot_start_s"), status.alias("status"), n.cast("bigint").alias("n_readings"), *(value(i).alias(v) for i, v in enumerate(values)))

    observed = shown(slots.withColumn("_at", F.col("_slot")), F.lit(OBSERVED), F.col("_n"), lambda i: F.col(f"_values._v{i}"))
    between = spread(slots.where(F.col("_gap") > 0), F.col("_slot") + 1, F.col("_gap"), "_at")
    near = F.col("_gap") <= fill_up_to
    share = (F.col("_at") - F.col("_slot")) / (F.col("_gap") + 1)

    def interpolated(i: int) -> Column:
        a, b = F.col(f"_values._v{i}"), F.col(f"_there._values._v{i}")
        return F.when(near, a + (b - a) * share)

    out = observed.unionByName(shown(between, F.when(near, FILLED).otherwise(MISSING), F.lit(0), interpolated))
    if start_s is not None or end_s is not None:
        ends = slots.groupBy("_source", "_period").agg(F.min("_slot").alias("_lo"), F.max("_slot").alias("_hi"))
        null = lambda i: F.lit(None).cast("double")
        if start_s is not None:
            lo = F.floor(F.lit(start_s) / F.col("_period")).cast("bigint")
            out = out.unionByName(shown(spread(ends, lo, F.col("_lo") - lo, "_at"), F.lit(MISSING), F.lit(0), null))
        if end_s is not None:
            hi = F.floor(F.lit(end_s) / F.col("_period")).cast("bigint")
            out = out.unionByName(shown(spread(ends, F.col("_hi") + 1, hi - F.col("_hi"), "_at"), F.lit(MISSING), F.lit(0), null))
    return out
