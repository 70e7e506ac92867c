"""Queries pN_ of the general problems over the driver's tables; each runs its operator over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.plans import table
from tickloom.operators import copies, malformed, regular_grid, spikes, timestamps
from tickloom.plans.problem_sql import ORACLE as ORACLE


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    lines = malformed.parsed_lines(table(spark, folder, "all_categories_raw"), table(spark, folder, "stored_csv"))
    return malformed.failures(lines).select("record_id", "reason_code")


def p1_candles(spark: SparkSession, folder: str) -> DataFrame:
    lines = malformed.parsed_lines(table(spark, folder, "all_categories_raw"), table(spark, folder, "stored_csv"))
    return malformed.candles(lines, malformed.failures(lines))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return p2_reasons(spark, folder).select("row_id").distinct()


def p2_reasons(spark: SparkSession, folder: str) -> DataFrame:
    return spikes.implausible(table(spark, folder, "all_categories"), table(spark, folder, "stored_csv"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    runs = table(spark, folder, "stored_csv")
    parts = [timestamps.instants(table(spark, folder, t), runs, t, ["row_id"]).where(F.col("utc_us").isNotNull()).select(F.lit(t).alias("layout"), "row_id", "utc_us") for t in ("all_categories", "combined_timestamp")]
    return parts[0].unionByName(parts[1])


def _grid(spark: SparkSession, folder: str, values: list[str]) -> DataFrame:
    timed = timestamps.instants(table(spark, folder, "all_categories"), table(spark, folder, "stored_csv"), "all_categories", ["run_id", *values], ["timeframe"])
    timed = timed.withColumn("period_s", regular_grid.timeframe_seconds(F.col("timeframe")))
    return regular_grid.regular_grid(timed, "run_id", "utc_us", "period_s", values)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return _grid(spark, folder, []).where(F.col("status") != regular_grid.OBSERVED).select("run_id", "slot_start_s")


def p4_grid(spark: SparkSession, folder: str) -> DataFrame:
    return _grid(spark, folder, ["close", "volume"])


def _side(spark: SparkSession, folder: str, name: str) -> DataFrame:
    rows = table(spark, folder, name)
    numbers = [copies.number_text(F.col(f"c{i}")).alias(f"c{i}") for i in range(2, 7)]
    return rows.select("series_id", "source_line", copies.day_text(F.col("c0")).alias("c0"), *numbers).where(F.col("c0").isNotNull())


def p5_cells(spark: SparkSession, folder: str) -> DataFrame:
    left, right = (_side(spark, folder, t) for t in ("audusd_d1_reference", "audusd_d1_candidate_coverage_gaps"))
    return copies.differences(left, right, ["series_id", "c0"], [f"c{i}" for i in range(2, 7)])


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return p5_cells(spark, folder).select("series_id", "c0", "difference")


QUERIES = {f.__name__: f for f in (p1_found, p1_candles, p2_found, p2_reasons, p3_found, p4_found, p4_grid, p5_found, p5_cells)}
