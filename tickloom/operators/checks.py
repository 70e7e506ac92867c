"""The six quality checks over candles, as transformations of DataFrames.

A candle has ts (timestamp), open, high, low, close, volume (decimal(20,8)) and source_line (bigint). ``by`` names further key columns
where a table holds several datasets; every check then judges each dataset by itself. Grids are never built for occupied stretches:
consecutive occupied slots are paired and only what lies between them is generated.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.plans import written
from tickloom.operators.asof import nearest
from tickloom.operators.calendars import Calendar
from tickloom.operators.regular_grid import spread

#: Microseconds of the smallest timeframe.
MINUTE = 60_000_000
FIELDS = ("open", "high", "low", "close", "volume")
#: Violation codes in the order in which they are listed.
VIOLATIONS = (
    ("HIGH_BELOW_OPEN", lambda c: c["high"] < c["open"]),
    ("HIGH_BELOW_CLOSE", lambda c: c["high"] < c["close"]),
    ("HIGH_BELOW_LOW", lambda c: c["high"] < c["low"]),
    ("LOW_ABOVE_OPEN", lambda c: c["low"] > c["open"]),
    ("LOW_ABOVE_CLOSE", lambda c: c["low"] > c["close"]),
    ("NON_POSITIVE_OPEN", lambda c: c["open"] <= 0),
    ("NON_POSITIVE_HIGH", lambda c: c["high"] <= 0),
    ("NON_POSITIVE_LOW", lambda c: c["low"] <= 0),
    ("NON_POSITIVE_CLOSE", lambda c: c["close"] <= 0),
    ("NEGATIVE_VOLUME", lambda c: c["volume"] < 0),
)


def micros(ts: str = "ts") -> Column:
    return F.unix_micros(F.col(ts))


def is_open(calendar: Calendar, ts: str = "ts") -> Column:
    return calendar(micros(ts))


def closed_records(candles: DataFrame, calendar: Calendar) -> DataFrame:
    """The candles outside every open session, copies included."""
    return candles.where(~is_open(calendar))


def invalid_ohlc(candles: DataFrame) -> DataFrame:
    """The candles that break a price or volume rule, with ``violations``, the ordered codes. A null value breaks none."""
    c = {f: F.col(f) for f in FIELDS}
    found = F.array_compact(F.array(*(F.when(test(c), code) for code, test in VIOLATIONS)))
    return candles.withColumn("violations", found).where(F.size("violations") > 0)


def violation_rows(candles: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row per violation, with its order within the record."""
    return invalid_ohlc(candles).select(*by, "source_line", "ts", F.posexplode("violations").alias("child_order", "violation"))


def duplicate_groups(candles: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Timestamps of several records: how many are too many, exact or conflicting, and the fields that differ, in ordinal order.

    Aggregates only minima and maxima, so a group of any size costs one row per map task; the group's rows are ``duplicate_rows``."""
    spans = [x for f in FIELDS for x in (F.min(f).alias(f"_min_{f}"), F.max(f).alias(f"_max_{f}"))]
    groups = candles.groupBy(*by, "ts").agg(F.count("*").alias("n"), F.min("source_line").alias("first_line"), F.max("source_line").alias("last_line"), *spans).where(F.col("n") > 1)
    differ = F.array_compact(F.array(*(F.when(F.col(f"_min_{f}") != F.col(f"_max_{f}"), f.capitalize()) for f in sorted(FIELDS))))
    kind = F.when(F.size("differing_fields") == 0, "Exact").otherwise("Conflicting")
    return groups.withColumn("differing_fields", differ).select(*by, "ts", (F.col("n") - 1).alias("count_contribution"), kind.alias("classification"), "differing_fields", "first_line", "last_line")


def duplicate_rows(candles: DataFrame, groups: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The records of the groups, one row each."""
    return candles.join(groups.select(*by, "ts", "first_line"), [*by, "ts"])


def open_instants(candles: DataFrame, calendar: Calendar, by: tuple[str, ...] = ()) -> DataFrame:
    """Distinct open instants, in microseconds, as ``t``."""
    return candles.where(is_open(calendar)).select(*by, micros().alias("t")).distinct()


def interval_counts(candles: DataFrame, calendar: Calendar, by: tuple[str, ...] = ()) -> DataFrame:
    """(delta_us, n): how often each distance between consecutive distinct open instants occurs."""
    times = nearest(open_instants(candles, calendar, by), list(by), "t", "t", "_next", levels=2, unit=MINUTE)
    return times.where(F.col("_next").isNotNull()).groupBy(*by, (F.col("_next") - F.col("t")).alias("delta_us")).agg(F.count("*").alias("n"))


def timeframe_text(seconds: Column) -> Column:
    """D for whole days, else H for whole hours, else M; null unless whole minutes."""
    minute, hour, day = 60, 3600, 86_400
    text = lambda unit, size: F.concat(F.lit(unit), (seconds / size).cast("bigint").cast("string"))
    return F.when(seconds % minute != 0, None).when(seconds % day == 0, text("D", day)).when(seconds % hour == 0, text("H", hour)).otherwise(text("M", minute))


def detected_timeframe(counts: DataFrame) -> DataFrame:
    """One row: the modal interval as ``timeframe`` and ``step_us``, both null for a tie, for no interval or for part of a minute."""
    best = counts.orderBy(F.desc("n"), "delta_us").limit(2)
    top = best.agg(F.max_by("delta_us", F.struct("n", -F.col("delta_us"))).alias("d"), F.max("n").alias("most"), F.sum("n").alias("both"), F.count("*").alias("rows"))
    clear = (F.col("rows") == 1) | (F.col("both") < 2 * F.col("most"))
    step = F.when(clear & (F.col("d") % 60_000_000 == 0), F.col("d"))
    return top.select(timeframe_text((step / 1_000_000).cast("bigint")).alias("timeframe"), step.alias("step_us"))


@dataclass
class Sequence:
    """Results of the sequence checks: gaps, missing candles (each with its gap) and the open slots expected per dataset."""

    gaps: DataFrame
    missing: DataFrame
    expected: DataFrame


def _bounded(df: DataFrame, bounds: DataFrame, by: tuple[str, ...]) -> DataFrame:
    # Without keys there is one row of bounds.
    return df.join(bounds, list(by)) if by else df.join(F.broadcast(bounds))


def sequence_checks(candles: DataFrame, calendar: Calendar, step_s: int, malformed: DataFrame | None = None, by: tuple[str, ...] = ()) -> Sequence:
    """Missing candles and time gaps of each dataset over the grid from its first open instant to its last.

    A malformed row with a ``ts`` and a ``source_line`` occupies its slot and may be an anchor, but doesn't bound the grid. A closed
    slot ends a gap. Datasets with fewer than two open instants have no row in any result. Lines: the highest of the preceding
    instant, the lowest of the following one."""
    step = step_s * 1_000_000
    points = open_instants(candles, calendar, by)
    bounds = points.groupBy(*by).agg(F.min("t").alias("lo"), F.max("t").alias("hi")).where(F.col("lo") < F.col("hi"))
    rows = candles.select(*by, micros().alias("t"), "source_line")
    if malformed is not None:
        rows = rows.unionByName(malformed.where(F.col("ts").isNotNull()).select(*by, micros().alias("t"), "source_line"))
    lines = rows.groupBy(*by, "t").agg(F.min("source_line").alias("low_line"), F.max("source_line").alias("high_line"))
    slots = _bounded(lines, bounds, by).where((F.col("t") >= F.col("lo")) & (F.col("t") <= F.col("hi")) & (F.pmod(F.col("t") - F.col("lo"), F.lit(step)) == 0) & calendar(F.col("t")))
    slots = written(slots.withColumn("slot", ((F.col("t") - F.col("lo")) / step).cast("bigint")), "sequence-slots")
    slots = nearest(slots, list(by), "slot", "slot", "_next", levels=2)
    end = F.floor((F.col("hi") - F.col("lo")) / F.lit(step)).cast("bigint")
    slots = slots.withColumn("_next", F.coalesce("_next", end + 1))

    between = spread(slots.where(F.col("_next") - F.col("slot") > 1), F.col("slot") + 1, F.col("_next") - F.col("slot") - 1, "s")
    at = lambda shift: calendar(F.col("lo") + (F.col("s") + shift) * step)
    between = between.where(at(0)).withColumn("starts", (F.col("s") == F.col("slot") + 1) | ~at(-1)).withColumn("ends", (F.col("s") + 1 == F.col("_next")) | ~at(1))
    edges = between.where(F.col("starts") | F.col("ends"))
    # One window per pair of occupied slots, over the edges of its runs only.
    follow = F.lead("s").over(Window.partitionBy(*by, "slot").orderBy("s"))
    runs = edges.withColumn("e", F.when(F.col("ends"), F.col("s")).otherwise(follow)).where("starts")
    runs = runs.select(*by, F.col("t").alias("previous_t"), F.col("high_line").alias("previous_line"), "lo", F.col("s").alias("first_slot"), F.col("e").alias("last_slot"))
    runs = runs.withColumn("first_t", F.col("lo") + F.col("first_slot") * step).withColumn("last_t", F.col("lo") + F.col("last_slot") * step)

    asks = runs.select(*by, F.col("last_t").alias("t"), F.lit(None).cast("bigint").alias("v"), F.struct("previous_t", "previous_line", "lo", "first_slot", "last_slot", "first_t", "last_t").alias("run"))
    answers = points.select(*by, "t", F.col("t").alias("v"), F.lit(None).cast(asks.schema["run"].dataType).alias("run"))
    gaps = nearest(asks.unionByName(answers), list(by), "t", "v", "next_t", levels=2, unit=step).where(F.col("run").isNotNull()).select(*by, "run.*", "next_t")
    following = lines.select(*by, F.col("t").alias("next_t"), F.col("low_line").alias("next_line"))
    gaps = gaps.join(following, [*by, "next_t"], "left")
    count = F.col("last_slot") - F.col("first_slot") + 1
    gaps = gaps.select(
        *by,
        F.timestamp_micros("first_t").alias("first_missing"),
        F.timestamp_micros("last_t").alias("last_missing"),
        count.alias("missing_count"),
        (count * step_s).alias("elapsed_seconds"),
        F.timestamp_micros("previous_t").alias("previous_observed"),
        F.timestamp_micros("next_t").alias("next_observed"),
        F.col("previous_line"),
        F.col("next_line"),
    )
    gaps = written(gaps, "sequence-gaps")
    missing = spread(gaps, F.lit(0).cast("bigint"), F.col("missing_count"), "child_order").withColumn("ts", F.timestamp_micros(micros("first_missing") + F.col("child_order") * step))
    seen = slots.groupBy(*by).agg(F.count("*").alias("_seen"))
    lost = gaps.groupBy(*by).agg(F.sum("missing_count").alias("_lost"))
    both = seen.join(lost, list(by), "left") if by else seen.join(F.broadcast(lost))
    expected = both.select(*by, (F.col("_seen") + F.coalesce("_lost", F.lit(0))).alias("expected_candles"))
    return Sequence(gaps, missing, expected if by else expected.where(F.col("expected_candles") > 0))


def pairwise_gaps(candles: DataFrame, step_s: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Gaps without a calendar: consecutive instants more than a step apart, with the whole time between them and the steps it misses."""
    step = step_s * 1_000_000
    points = candles.select(*by, micros().alias("t")).where(F.col("t").isNotNull()).distinct()
    pairs = nearest(points, list(by), "t", "t", "next_t", levels=2, unit=MINUTE).where(F.col("next_t") - F.col("t") > step)
    missing = F.floor((F.col("next_t") - F.col("t")) / F.lit(step)).cast("bigint") - 1
    return pairs.select(*by, F.timestamp_micros("t").alias("previous"), F.timestamp_micros("next_t").alias("next"), ((F.col("next_t") - F.col("t")) / 1_000_000).cast("bigint").alias("elapsed_seconds"), missing.alias("missing_count"))


def pairwise_missing(gaps: DataFrame, step_s: int, by: tuple[str, ...] = ()) -> DataFrame:
    """The missing instants of ``pairwise_gaps``, numbered from 1 within each gap."""
    rows = spread(gaps, F.lit(1).cast("bigint"), F.col("missing_count"), "child_order")
    return rows.select(*by, "previous", "child_order", F.timestamp_micros(micros("previous") + F.col("child_order") * (step_s * 1_000_000)).alias("ts"))
