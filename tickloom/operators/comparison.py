"""Comparison of a candidate dataset with a benchmark: alignment by instant, tolerances field by field, agreement.

Both sides are co-partitioned once by (keys, ts) in a full outer join; alignment, field decisions and discrepancies are
projections of that join.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, replace
from decimal import Decimal
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fields in canonical order, default tolerances, decisions and the limits of their types.
FIELDS = ("Open", "High", "Low", "Close", "Volume")
PRICE_ABSOLUTE, PRICE_RELATIVE = Decimal("0.0001"), Decimal("0.0001")
VOLUME_ABSOLUTE, VOLUME_RELATIVE = Decimal("0"), Decimal("0.05")
ABSOLUTE, RELATIVE, MATERIAL = "AcceptedByAbsolute", "AcceptedByRelative", "MaterialDifference"
MATCHED, MISSING, EXTRA = "matched", "missing_from_candidate", "extra_in_candidate"
TOLERANCE = "decimal(12,8)"


@dataclass(frozen=True)
class Tolerance:
    field: str
    enabled: bool = True
    absolute: Decimal | None = None
    relative: Decimal | None = None


def read_overrides(text: str) -> list[Tolerance]:
    """Overrides from JSON: a list of {field, enabled, absolute, relative}; unknown keys, repeated fields and negatives are refused."""
    out: list[Tolerance] = []
    data = json.loads(text, parse_float=Decimal, parse_int=Decimal)
    for item in data["fields"] if isinstance(data, dict) else data:
        if not isinstance(item, dict) or set(item) - {"field", "enabled", "absolute", "relative"}:
            raise ValueError("a tolerance has field, enabled, absolute and relative only")
        name = {f.lower(): f for f in FIELDS}.get(str(item.get("field", "")).lower())
        if name is None or any(t.field == name for t in out):
            raise ValueError(f"unknown or repeated field {item.get('field')!r}")
        for k in ("absolute", "relative"):
            if item.get(k) is not None and (not isinstance(item[k], Decimal) or item[k] < 0):
                raise ValueError(f"{k} must be a number of zero or more")
        if not isinstance(item.get("enabled", True), bool):
            raise ValueError("enabled must be true or false")
        out.append(Tolerance(name, item.get("enabled", True), item.get("absolute"), item.get("relative")))
    return out


def resolve(overrides: list[Tolerance] | None = None, step: Decimal | None = None) -> list[Tolerance]:
    """A tolerance for each field: the override's, else the price step (if known) or the defaults."""
    given = {t.field: t for t in overrides or []}
    out = []
    for f in FIELDS:
        t = given.get(f, Tolerance(f))
        absolute = VOLUME_ABSOLUTE if f == "Volume" else PRICE_ABSOLUTE if step is None else step
        relative = VOLUME_RELATIVE if f == "Volume" else PRICE_RELATIVE
        out.append(replace(t, absolute=absolute if t.absolute is None else t.absolute, relative=relative if t.relative is None else t.relative))
    return out


def scale_of(text: Column) -> Column:
    """Digits after the point of a number's text."""
    return F.length(F.split_part(text, F.lit("."), F.lit(2)))


def fractional_step(candles: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row: ``scale``, the most digits after the point of any price text, and ``step``, 10 to its negative (1 for whole prices).

    Prices are the columns open_text to close_text, or decimals, of which trailing zeros don't count."""
    names = [f.lower() for f in FIELDS[:4]]
    given = f"{names[0]}_text" in candles.columns
    scales = [scale_of(F.col(f"{n}_text")) if given else scale_of(F.regexp_replace(F.col(n).cast("string"), r"\.?0+$", "")) for n in names]
    most = candles.groupBy(*by).agg(F.coalesce(F.max(F.greatest(*scales)), F.lit(0)).alias("scale"))
    return most.withColumn("step", F.pow(F.lit(10.0), -F.col("scale")).cast("decimal(20,8)"))


def repeated_instants(candles: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Instants with several records, which a comparison refuses."""
    return candles.groupBy(*by, "ts").agg(F.count("*").alias("n")).where(F.col("n") > 1)


def aligned(benchmark: DataFrame, candidate: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(keys, ts, status, b, c): the benchmark's and the candidate's record at each instant, as structs or null."""
    names = [*(f.lower() for f in FIELDS), "source_line"]
    side = lambda df, n: df.select(*by, "ts", F.struct(*names).alias(n))
    both = side(benchmark, "b").join(side(candidate, "c"), [*by, "ts"], "full_outer")
    status = F.when(F.col("b").isNull(), EXTRA).when(F.col("c").isNull(), MISSING).otherwise(MATCHED)
    return both.withColumn("status", status)


def coverage(pairs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Matched, missing and extra instants, and the span of the matched ones."""
    is_ = lambda s: F.count(F.when(F.col("status") == s, 1))
    at = F.when(F.col("status") == MATCHED, F.col("ts"))
    return pairs.groupBy(*by).agg(is_(MATCHED).alias("matched"), is_(MISSING).alias("missing"), is_(EXTRA).alias("extra"), F.min(at).alias("overlap_start"), F.max(at).alias("overlap_end"))


def field_decisions(pairs: DataFrame, tolerances: list[Tolerance], by: tuple[str, ...] = ()) -> DataFrame:
    """One row per matched instant and enabled field with values, differences, tolerances and decision; bounds are inclusive."""
    cells = []
    for t in tolerances:
        if t.enabled:
            f = t.field.lower()
            cells.append(F.struct(F.lit(t.field).alias("field"), F.col(f"b.{f}").alias("benchmark_value"), F.col(f"c.{f}").alias("candidate_value"), F.lit(str(t.absolute)).cast(TOLERANCE).alias("absolute"), F.lit(str(t.relative)).cast(TOLERANCE).alias("relative")))
    rows = pairs.where(F.col("status") == MATCHED).select(*by, "ts", F.col("c.source_line").alias("candidate_line"), F.explode(F.array(*cells) if cells else F.expr("cast(array() as array<struct<field:string,benchmark_value:decimal(20,8),candidate_value:decimal(20,8),absolute:decimal(12,8),relative:decimal(12,8)>>)")).alias("x"))
    rows = rows.select(*by, "ts", "candidate_line", "x.*")
    b, c = F.col("benchmark_value"), F.col("candidate_value")
    rows = rows.withColumn("difference", F.abs(b - c)).withColumn("directional_difference", c - b)
    decision = F.when(F.col("difference") <= F.col("absolute"), ABSOLUTE).when((b != 0) & (F.col("difference") <= F.col("relative") * F.abs(b)), RELATIVE).otherwise(MATERIAL)
    return rows.withColumn("decision", decision)


def discrepancies(decisions: DataFrame) -> DataFrame:
    """The material differences; report them by instant, field and difference descending."""
    return decisions.where(F.col("decision") == MATERIAL)


def tolerated(decisions: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Per field: compared, accepted by each tolerance (equal values count as neither) and material."""
    differs = F.col("difference") != 0
    n = lambda d: F.count(F.when((F.col("decision") == d) & differs, 1))
    return decisions.groupBy(*by, "field").agg(F.count("*").alias("total_compared"), n(ABSOLUTE).alias("accepted_by_absolute"), n(RELATIVE).alias("accepted_by_relative"), n(MATERIAL).alias("material"))


def agreement(pairs: DataFrame, decisions: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(matched, material_instants): what the agreement score is made of."""
    differ = discrepancies(decisions).groupBy(*by).agg(F.countDistinct("ts").alias("material_instants"))
    matched = pairs.groupBy(*by).agg(F.count(F.when(F.col("status") == MATCHED, 1)).alias("matched"))
    if by:
        return matched.join(differ, list(by), "left").withColumn("material_instants", F.coalesce("material_instants", F.lit(0)))
    return matched.join(F.broadcast(differ))  # one row each


def agreement_score(matched: int, material: int) -> Fraction | None:
    return Fraction(100 * (matched - material), matched) if matched else None
