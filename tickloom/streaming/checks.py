"""The checks that need no other row, over a stream of candles: invalid values and closed-market records as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators import checks
from tickloom.operators.calendars import Calendar


def row_findings(candles: DataFrame, calendar: Calendar) -> DataFrame:
    """(source_line, ts, category, codes) for each record that breaks a rule of its own; works on batches and streams alike."""
    c = {f: F.col(f) for f in checks.FIELDS}
    codes = F.array_compact(F.array(*(F.when(test(c), code) for code, test in checks.VIOLATIONS), F.when(~checks.is_open(calendar), "CLOSED_MARKET")))
    return candles.select("source_line", "ts", codes.alias("codes")).where(F.size("codes") > 0)


def duplicates(candles: DataFrame, late: str = "1 hour") -> DataFrame:
    """Counts per instant within the watermark, for instants with several records."""
    return candles.withWatermark("ts", late).groupBy("ts").agg(F.count("*").alias("n")).where(F.col("n") > 1)
