"""Queries that read candle files: the events written as delimited text into the shared folder and scanned from there."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.plans import shared_folder, table
from tickloom.operators import calendars, findings
from tickloom.sources import csv_scan, events
from tickloom.sources.csv_scan import CsvOptions, Prepared

STEP_S = 60
#: The columns of the file in its own order and writing.
HEADER = ["Volume", "Close", "TIME", "high", "Open", "low", "DATE"]


def _written_text(rows: DataFrame, header: str, line: str, text: Column, label: str, files: int = 1, part: Column | None = None) -> str:
    """The folder of the text files, each with its header; rows go to the file ``part``, in order of ``line``."""
    spark = rows.sparkSession
    at = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    own = rows.select((F.lit(0) if part is None else part).cast("int").alias("f"), F.col(line).alias("n"), text.alias("value"))
    heads = spark.range(files).select(F.col("id").cast("int").alias("f"), F.lit(-1).cast("bigint").alias("n"), F.lit(header).alias("value"))
    # A file is one task's work by nature; the scan that follows reads it in ranges.
    for f in range(files):
        own.unionByName(heads).where(F.col("f") == f).repartition(1).sortWithinPartitions("n").select("value").write.mode("append").text(f"{at}/{f}")
    return at


def _prepared(spark: SparkSession, folder: str) -> Prepared:
    rows = events.texts(table(spark, folder, "events"))
    at = _written_text(rows, ";".join(HEADER), "source_line", F.concat_ws(";", *(F.col(h.lower()) for h in HEADER)), "candles-file")
    return csv_scan.scan(spark, at, CsvOptions(has_header=True))


def _seconds(column: str) -> Column:
    return F.floor(F.unix_micros(column) / 1_000_000).cast("bigint")


def file_accepted(spark: SparkSession, folder: str) -> DataFrame:
    """Delimiter found from the header, columns by name, default formats and offset, numbers in all notations."""
    return _prepared(spark, folder).candles.select("source_line", _seconds("ts").alias("ts_s"), *csv_scan.PRICES)


def file_malformed(spark: SparkSession, folder: str) -> DataFrame:
    rows = _prepared(spark, folder).malformed
    return rows.select("source_line", _seconds("ts").alias("ts_s"), F.when(F.col("reason").contains("timestamp"), "timestamp").otherwise("open").alias("field"))


def file_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and coverage of the file as one row."""
    p = _prepared(spark, folder)
    row = (p.identity.byte_size, p.identity.sha256, p.examined, p.accepted, p.rejected, p.delimiter)
    out = spark.createDataFrame([row], "byte_size bigint, sha256 string, examined bigint, accepted bigint, rejected bigint, delimiter string")
    return out.join(F.broadcast(p.candles.agg(F.min(_seconds("ts")).alias("first_s"), F.max(_seconds("ts")).alias("last_s"))))  # one row each


def _catalog(spark: SparkSession, folder: str) -> findings.Catalog:
    p = _prepared(spark, folder)
    return findings.catalog(p.candles, calendars.forex, STEP_S, p.malformed)


def file_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """Gaps of a file whose malformed rows hold their slots and are anchors."""
    return _catalog(spark, folder).sequence.gaps.select(
        _seconds("first_missing").alias("first_s"), _seconds("last_missing").alias("last_s"), "missing_count", _seconds("previous_observed").alias("previous_s"),
        _seconds("next_observed").alias("next_s"), "previous_line", "next_line",
    )


def file_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Findings and contributions of all six categories, malformed rows among them."""
    return findings.summary(_catalog(spark, folder).findings).select("category", F.col("entries").cast("bigint").alias("entries"), F.col("count").cast("bigint").alias("contributions"))


def file_collisions(spark: SparkSession, folder: str) -> DataFrame:
    """References over two files, whose line numbers coincide, so that the later finding gets a suffix."""
    rows = events.texts(table(spark, folder, "events"))
    at = _written_text(rows, ";".join(HEADER), "source_line", F.concat_ws(";", *(F.col(h.lower()) for h in HEADER)), "candles-files", 2, F.col("source_line") % 2)
    p = csv_scan.scan(spark, at, CsvOptions(has_header=True))
    found = findings.catalog(p.candles, calendars.forex, STEP_S, p.malformed).findings
    return found.where(F.col("category").isin("InvalidOhlc", "ClosedMarketRecord", "MalformedRow")).select("category", "reference", _seconds("ts").alias("ts_s"), "first_line")


def file_combined(spark: SparkSession, folder: str) -> DataFrame:
    """A combined timestamp column in the first of three formats that fits, behind its own name, with an offset of the file."""
    rows = events.texts(table(spark, folder, "events"))
    e = F.col("source_line") - 1
    day, time = F.regexp_replace("date", r"\.", "-"), F.concat(F.col("time"), F.lit(":05"))
    stamp = F.when(e % 5 == 0, F.concat(day, F.lit(" "), time)).when(e % 5 == 1, F.concat(day, F.lit("T"), time, F.lit("Z"))).when(e % 5 == 2, F.concat(day, F.lit("T"), time, F.lit(".2500000+05:30")))
    stamp = stamp.when(e % 5 == 3, F.concat(day, F.lit("T"), time, F.lit(".2500000Z"))).otherwise(F.concat(day, F.lit(" "), F.col("time")))
    text = F.concat_ws("\t", F.col("open"), F.col("high"), stamp, F.col("low"), F.col("close"), F.col("volume"))
    at = _written_text(rows, "open\thigh\tStamp\tlow\tclose\tvolume", "source_line", text, "stamps-file")
    p = csv_scan.scan(spark, at, CsvOptions(has_header=True, timestamp_column="stamp", tz_offset="-03:30"))
    return p.candles.select("source_line", F.unix_micros("ts").alias("ts_us"), "open")


QUERIES = {f.__name__: f for f in (file_accepted, file_malformed, file_coverage, file_gaps, file_summary, file_collisions, file_combined)}

_X = r"""x AS (SELECT event_id + 1 AS line, CASE WHEN event_id % 41 = 0 THEN 'abc' WHEN event_id % 43 = 0 THEN '1e3' WHEN event_id % 47 = 0 THEN '1,234.5' WHEN event_id % 53 = 0 THEN '' WHEN event_id % 59 = 0 THEN ' +7.25 ' WHEN event_id % 61 = 0 THEN '5-' ELSE (event_id // 3) || '.' || (event_id % 100) END AS open,
 (event_id // 3) || '.' || (event_id % 100) AS high, CAST(event_id % 97 AS VARCHAR) AS volume, CASE WHEN event_id % 67 = 0 THEN '2024.02.30' WHEN event_id % 71 = 0 THEN '2024-01-05' ELSE strftime(ts, '%Y.%m.%d') END AS date, CASE WHEN event_id % 73 = 0 THEN '24:00' ELSE strftime(ts, '%H:%M') END AS time FROM events),
 n AS (SELECT *, row_number() OVER (ORDER BY line) + 1 AS fl, row_number() OVER (PARTITION BY line % 2 ORDER BY line) + 1 AS fl2,
  CASE WHEN regexp_full_match(open, '\s*([+-]\s*)?([0-9][0-9,]*(\.[0-9]*)?|\.[0-9]+)\s*') OR regexp_full_match(open, '\s*([0-9][0-9,]*(\.[0-9]*)?|\.[0-9]+)\s*[+-]\s*')
  THEN CASE WHEN contains(open, '-') THEN -1 ELSE 1 END * CAST(regexp_replace(open, '[^0-9.]', '', 'g') AS DECIMAL(20,8)) END AS o, CAST(high AS DECIMAL(20,8)) AS h FROM x),
 f AS (SELECT *, try_strptime(date || ' ' || time, '%Y.%m.%d %H:%M') - INTERVAL 2 HOUR AS ts FROM n),
 c AS (SELECT ts, fl AS line, fl2, o AS open, h AS high, h AS low, h AS close, CAST(volume AS DECIMAL(20,8)) AS volume FROM f WHERE ts IS NOT NULL AND o IS NOT NULL),
 bad AS (SELECT ts, fl AS line, fl2 FROM f WHERE ts IS NULL OR o IS NULL)"""
_OPEN = "NOT (isodow({0}) = 6 OR (isodow({0}) = 7 AND hour({0}) < 22) OR (isodow({0}) = 5 AND hour({0}) >= 22))"
_BAD = "(high < open OR high < close OR high < low OR low > open OR low > close OR open <= 0 OR high <= 0 OR low <= 0 OR close <= 0 OR volume < 0)"
_GAPS = f"""{_X}, lines AS (SELECT ts, min(line) AS low_line, max(line) AS high_line FROM (SELECT ts, line FROM c UNION ALL SELECT ts, line FROM bad WHERE ts IS NOT NULL) GROUP BY ts),
 points AS (SELECT DISTINCT ts FROM c WHERE {_OPEN.format('ts')}), bounds AS (SELECT min(ts) AS lo, max(ts) AS hi FROM points),
 grid AS (SELECT unnest(generate_series(lo, hi, INTERVAL 1 MINUTE)) AS ts FROM bounds),
 slot AS (SELECT g.ts, {_OPEN.format('g.ts')} AS opened, l.ts IS NOT NULL AS taken, p.ts AS point FROM grid g LEFT JOIN lines l ON g.ts = l.ts LEFT JOIN points p ON g.ts = p.ts),
 mark AS (SELECT ts, opened AND NOT taken AS lost, max(CASE WHEN opened AND taken THEN ts END) OVER (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev,
  min(point) OVER (ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next FROM slot),
 starts AS (SELECT *, sum(CASE WHEN lost AND NOT was THEN 1 ELSE 0 END) OVER (ORDER BY ts) AS id FROM (SELECT *, coalesce(lag(lost) OVER (ORDER BY ts), FALSE) AS was FROM mark)),
 gap AS (SELECT id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n, min(prev) AS prev, max(next) AS next FROM starts WHERE lost GROUP BY id)"""
_S = "CAST(epoch({0}) AS BIGINT)"
_LINE = "volume || ';' || high || ';' || time || ';' || high || ';' || open || ';' || high || ';' || date"

ORACLE = {
    "file_accepted": f"WITH {_X} SELECT line AS source_line, {_S.format('ts')} AS ts_s, open, high, low, close, volume FROM c",
    "file_malformed": f"WITH {_X} SELECT line AS source_line, {_S.format('ts')} AS ts_s, CASE WHEN ts IS NULL THEN 'timestamp' ELSE 'open' END AS field FROM bad",
    "file_coverage": f"""WITH {_X}, whole AS (SELECT '{';'.join(HEADER)}' || chr(10) || string_agg({_LINE} || chr(10), '' ORDER BY line) AS t, count(*) AS n FROM x)
 SELECT CAST(length(t) AS BIGINT) AS byte_size, sha256(t) AS sha256, n AS examined, (SELECT count(*) FROM c) AS accepted, (SELECT count(*) FROM bad) AS rejected, ';' AS delimiter,
 (SELECT min({_S.format('ts')}) FROM c) AS first_s, (SELECT max({_S.format('ts')}) FROM c) AS last_s FROM whole""",
    "file_gaps": f"""WITH {_GAPS} SELECT {_S.format('first_ts')} AS first_s, {_S.format('last_ts')} AS last_s, n AS missing_count, {_S.format('prev')} AS previous_s, {_S.format('next')} AS next_s, a.high_line AS previous_line, b.low_line AS next_line
 FROM gap JOIN lines a ON a.ts = prev JOIN lines b ON b.ts = next""",
    "file_summary": f"""WITH {_GAPS} SELECT 'MissingCandle' AS category, count(*) AS entries, count(*) AS contributions FROM starts WHERE lost
 UNION ALL SELECT 'DuplicateRecord', count(*), CAST(coalesce(sum(k - 1), 0) AS BIGINT) FROM (SELECT count(*) AS k FROM c GROUP BY ts) WHERE k > 1
 UNION ALL SELECT 'InvalidOhlc', count(*), count(*) FROM c WHERE {_BAD} UNION ALL SELECT 'ClosedMarketRecord', count(*), count(*) FROM c WHERE NOT {_OPEN.format('ts')}
 UNION ALL SELECT 'TimeGap', count(*), count(*) FROM gap UNION ALL SELECT 'MalformedRow', count(*), count(*) FROM bad""",
    "file_collisions": f"""WITH {_X}, every AS (SELECT 'InvalidOhlc' AS category, 'invalid-ohlc:line-' || fl2 AS r, ts, fl2 FROM c WHERE {_BAD} UNION ALL SELECT 'ClosedMarketRecord', 'closed-market-record:line-' || fl2, ts, fl2 FROM c WHERE NOT {_OPEN.format('ts')}
 UNION ALL SELECT 'MalformedRow', 'malformed-row:line-' || fl2, ts, fl2 FROM bad), k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY ts NULLS LAST, fl2) AS i FROM every)
 SELECT category, r || CASE WHEN i > 1 THEN ':' || i ELSE '' END AS reference, {_S.format('ts')} AS ts_s, fl2 AS first_line FROM k""",
    "file_combined": f"""WITH {_X}, t AS (SELECT fl, o, (line - 1) % 5 AS k, try_strptime(replace(date, '.', '-') || ' ' || time, '%Y-%m-%d %H:%M') AS u FROM n)
 SELECT fl AS source_line, epoch_us(u) + 5000000 + CASE WHEN k IN (0, 1) THEN 12600000000 WHEN k = 2 THEN 250000 - 19800000000 ELSE 250000 END AS ts_us, o AS open FROM t WHERE u IS NOT NULL AND o IS NOT NULL AND k < 4""",
}
