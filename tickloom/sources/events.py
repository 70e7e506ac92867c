"""Candles made from the driver's ``events`` table, so that every check has something to find."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def candles(events: DataFrame) -> DataFrame:
    """ts (UTC instant of the minute), source_line and prices from an event's id and value."""
    minute = F.date_trunc("minute", F.col("ts").cast("timestamp_ntz"))
    us = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', _minute)")
    v = F.col("value").cast("decimal(20,8)")
    out = events.withColumn("_minute", minute).select(
        F.timestamp_micros(us).alias("ts"),
        v.alias("open"),
        (v + F.col("event_id") % 5 - 1).cast("decimal(20,8)").alias("high"),
        (v - F.col("event_id") % 7 + 1).cast("decimal(20,8)").alias("low"),
        v.alias("close"),
        (F.col("event_id") % 97 - 1).cast("decimal(20,8)").alias("volume"),
        (F.col("event_id") + 1).alias("source_line"),
    )
    return out


def benchmark(rows: DataFrame) -> DataFrame:
    """The record of the lowest line at each instant."""
    names = ["open", "high", "low", "close", "volume"]
    first = rows.groupBy("ts").agg(F.min(F.struct("source_line", *names)).alias("r"))
    return first.select("ts", *(F.col(f"r.{n}").alias(n) for n in names), "r.source_line")


def candidate(reference: DataFrame) -> DataFrame:
    """A copy of the benchmark with rows lost, opens shifted and ten instants a year later added."""
    event = F.col("source_line") - 1
    shift = F.when(event % 17 == 0, F.lit("1")).when(event % 11 == 0, F.lit("0.00005")).when(event % 7 == 0, F.lit("0.02")).otherwise(F.lit("0")).cast("decimal(20,8)")
    kept = reference.where(event % 13 != 0).withColumn("open", (F.col("open") + shift).cast("decimal(20,8)"))
    later = reference.orderBy("ts").limit(10).withColumn("ts", F.timestamp_micros(F.unix_micros("ts") + 365 * 86_400 * 1_000_000))
    return kept.unionByName(later)


def texts(events: DataFrame) -> DataFrame:
    """The same records as text, some of them broken: date, time, five numbers and the line."""
    e = F.col("event_id")
    value = F.concat(F.floor(e / 3).cast("string"), F.lit("."), (e % 100).cast("string"))
    minute = F.col("ts").cast("timestamp_ntz")
    number = F.when(e % 41 == 0, "abc").when(e % 43 == 0, "1e3").when(e % 47 == 0, "1,234.5").when(e % 53 == 0, "").when(e % 59 == 0, " +7.25 ").when(e % 61 == 0, "5-").otherwise(value)
    date = F.when(e % 67 == 0, "2024.02.30").when(e % 71 == 0, "2024-01-05").otherwise(F.date_format(minute, "yyyy.MM.dd"))
    time = F.when(e % 73 == 0, "24:00").otherwise(F.date_format(minute, "HH:mm"))
    return events.select((e + 1).alias("source_line"), date.alias("date"), time.alias("time"), number.alias("open"), value.alias("high"), value.alias("low"), value.alias("close"), (e % 97).cast("string").alias("volume"))
