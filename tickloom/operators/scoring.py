"""Exact scores of 0 to 100: rational numbers on the driver for the six metrics of a report, integer arithmetic in Spark for tables."""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metric names in canonical order, and the population by which each is divided.
METRICS = ("MissingCandles", "DuplicateRecords", "InvalidOhlc", "ClosedMarketRecords", "TimeGaps", "MalformedRows")
POPULATIONS = {
    "MissingCandles": "expected_candles",
    "TimeGaps": "expected_candles",
    "DuplicateRecords": "accepted_rows",
    "InvalidOhlc": "accepted_rows",
    "ClosedMarketRecords": "accepted_rows",
    "MalformedRows": "examined_rows",
}
SCORED, NOT_APPLICABLE, NOT_SCORED = "Scored", "NotApplicable", "NotScored"
WEIGHT_DIGITS = 6


class ReconciliationError(ValueError):
    """A count exceeds its population, or totals disagree."""


def rounded(value: Fraction, digits: int = 2) -> Fraction:
    """Half away from zero."""
    scaled = abs(value) * 10**digits
    whole = (2 * scaled.numerator + scaled.denominator) // (2 * scaled.denominator)
    return Fraction(whole if value >= 0 else -whole, 10**digits)


def shown(value: Fraction | None, digits: int = 2) -> str | None:
    if value is None:
        return None
    r = rounded(value, digits)
    sign, n = ("-" if r < 0 else ""), abs(r) * 10**digits
    text = str(n.numerator).rjust(digits + 1, "0")
    return f"{sign}{text[:-digits]}.{text[-digits:]}" if digits else sign + text


@dataclass(frozen=True)
class MetricScore:
    metric: str
    state: str
    count: int
    population: int | None
    score: Fraction | None
    weight: Fraction
    share: Fraction | None


@dataclass(frozen=True)
class DatasetScore:
    metrics: tuple[MetricScore, ...]
    average: Fraction | None


def metric_score(count: int, population: int) -> Fraction:
    if count > population:
        raise ReconciliationError(f"{count} findings exceed a population of {population}")
    return Fraction(100 * (population - count), population)


def parse_weights(text: str) -> dict[str, Fraction]:
    """``name=weight`` pairs by commas: all six metrics, each once, plain decimals of zero or more, not all zero."""
    out: dict[str, Fraction] = {}
    names = {m.lower(): m for m in METRICS}
    for part in text.split(","):
        name, sign, value = part.partition("=")
        metric = names.get(name.strip().lower())
        if metric is None or not sign:
            raise ValueError(f"unknown weight {part.strip()!r}")
        if metric in out:
            raise ValueError(f"{metric} is weighted twice")
        value = value.strip()
        if not value.replace(".", "", 1).isascii() or not value.replace(".", "", 1).isdigit():
            raise ValueError(f"{value!r} is no weight")
        out[metric] = Fraction(value if value[-1] != "." else value[:-1])
    if set(out) != set(METRICS):
        raise ValueError("every metric needs a weight")
    if not any(out.values()):
        raise ValueError("at least one weight must be above zero")
    return out


def _truncated(weight: Fraction) -> Fraction:
    return Fraction(weight.numerator * 10**WEIGHT_DIGITS // weight.denominator, 10**WEIGHT_DIGITS)


def dataset_score(counts: dict[str, int], populations: dict[str, int | None], weights: dict[str, Fraction] | None = None) -> DatasetScore:
    """Scores and their weighted mean over the scored metrics; a null population is not applicable, one of zero is not scored.

    Weights count to six decimals in the mean; each metric's normalised share, of 1, is of the scored weights."""
    weights = weights or {m: Fraction(1) for m in METRICS}
    scores: dict[str, tuple[str, Fraction | None]] = {}
    for m in METRICS:
        n = populations[POPULATIONS[m]]
        scores[m] = (NOT_APPLICABLE, None) if n is None else (NOT_SCORED, None) if n == 0 else (SCORED, metric_score(counts[m], n))
    used = {m: _truncated(weights[m]) for m in METRICS if scores[m][0] == SCORED}
    total = sum(used.values())
    average = sum(scores[m][1] * w for m, w in used.items()) / total if total else None
    rows = tuple(MetricScore(m, scores[m][0], counts[m], populations[POPULATIONS[m]], scores[m][1], weights[m], used[m] / total if total and m in used else None) for m in METRICS)
    return DatasetScore(rows, average)


def score_column(count: Column, population: Column) -> Column:
    """100 * (population - count) / population to two decimals, half up, by integers only; null for a population of zero or null."""
    n, p = count.cast("decimal(38,0)"), population.cast("decimal(38,0)")
    cents = F.floor((20_000 * (p - n) + p) / F.nullif(2 * p, F.lit(0).cast("decimal(38,0)")))
    return (cents.cast("decimal(20,2)") / 100).cast("decimal(10,2)")
