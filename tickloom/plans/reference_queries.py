"""Queries of the quality checks over the events adapter, with their DuckDB equivalents."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.plans import table
from tickloom.operators import calendars, checks, comparison, findings, scoring
from tickloom.sources import csv_scan, events

STEP_S = 60
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

_CANDLES = """c AS (SELECT date_trunc('minute', ts) AS ts, event_id + 1 AS line, CAST(value AS DECIMAL(20,8)) AS open,
 CAST(value AS DECIMAL(20,8)) + event_id % 5 - 1 AS high, CAST(value AS DECIMAL(20,8)) - event_id % 7 + 1 AS low,
 CAST(value AS DECIMAL(20,8)) AS close, event_id % 97 - 1 AS volume FROM events)"""
_FOREX = "NOT (isodow({0}) = 6 OR (isodow({0}) = 7 AND hour({0}) < 22) OR (isodow({0}) = 5 AND hour({0}) >= 22))"
_CRYPTO = "({0} IS NOT NULL)"
_NY = "timezone('America/New_York', timezone('UTC', {0}))"
_EQUITIES = f"(isodow({_NY}) <= 5 AND CAST({_NY} AS TIME) >= TIME '09:30:00' AND CAST({_NY} AS TIME) < TIME '16:00:00')"


def _sequence(is_open: str) -> str:
    """CTEs: grid slots, and the gaps with what brackets them."""
    return f"""{_CANDLES},
 lines AS (SELECT ts, min(line) AS low_line, max(line) AS high_line FROM c GROUP BY ts),
 bounds AS (SELECT min(ts) AS lo, max(ts) AS hi FROM lines WHERE {is_open.format('ts')}),
 grid AS (SELECT unnest(generate_series(lo, hi, INTERVAL 1 MINUTE)) AS ts FROM bounds),
 slot AS (SELECT g.ts, {is_open.format('g.ts')} AS opened, l.ts IS NOT NULL AS taken FROM grid g LEFT JOIN lines l ON g.ts = l.ts),
 flag AS (SELECT ts, opened, opened AND NOT taken AS lost, CASE WHEN opened AND taken THEN ts END AS seen FROM slot),
 mark AS (SELECT *, lost AND NOT coalesce(lag(lost) OVER (ORDER BY ts), FALSE) AS starts,
  max(seen) OVER (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev,
  min(seen) OVER (ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next FROM flag),
 numbered AS (SELECT *, sum(CAST(starts AS INT)) OVER (ORDER BY ts) AS id FROM mark),
 miss AS (SELECT ts, id, prev, next FROM numbered WHERE lost),
 gap AS (SELECT id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n, min(prev) AS prev, max(next) AS next FROM miss GROUP BY id)"""


_VIOLATIONS = [
    ("HIGH_BELOW_OPEN", "high < open"),
    ("HIGH_BELOW_CLOSE", "high < close"),
    ("HIGH_BELOW_LOW", "high < low"),
    ("LOW_ABOVE_OPEN", "low > open"),
    ("LOW_ABOVE_CLOSE", "low > close"),
    ("NON_POSITIVE_OPEN", "open <= 0"),
    ("NON_POSITIVE_HIGH", "high <= 0"),
    ("NON_POSITIVE_LOW", "low <= 0"),
    ("NON_POSITIVE_CLOSE", "close <= 0"),
    ("NEGATIVE_VOLUME", "volume < 0"),
]
_BAD = " OR ".join(f"({test})" for _, test in _VIOLATIONS)
_KEY = "strftime({0}, '%Y%m%dT%H%M%S') || '0000000Z'"


def _counts(is_open: str) -> str:
    """CTEs ending in ``counts`` (category, n)."""
    return f"""{_sequence(is_open)},
 counts AS (SELECT 'MissingCandle' AS category, count(*) AS n FROM miss
  UNION ALL SELECT 'DuplicateRecord', coalesce(sum(k - 1), 0) FROM (SELECT count(*) AS k FROM c GROUP BY ts)
  UNION ALL SELECT 'InvalidOhlc', count(*) FROM c WHERE {_BAD}
  UNION ALL SELECT 'ClosedMarketRecord', count(*) FROM c WHERE NOT {is_open.format('ts')}
  UNION ALL SELECT 'TimeGap', count(*) FROM gap
  UNION ALL SELECT 'MalformedRow', 0)"""


def _query(sql: str):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


def _candles(spark: SparkSession, folder: str) -> DataFrame:
    return events.candles(table(spark, folder, "events"))


def seconds(ts: str) -> Column:
    return F.floor(F.unix_micros(F.col(ts)) / 1_000_000).cast("bigint")


def scaled(value: Column) -> Column:
    """A decimal as an integer of eight digits after the point."""
    return (value * 100_000_000).cast("bigint")


def _summary(spark: SparkSession, folder: str, calendar: calendars.Calendar) -> DataFrame:
    found = findings.catalog(_candles(spark, folder), calendar, STEP_S)
    return findings.summary(found.findings).select("category", F.col("count").alias("n"))


@_query(f"WITH {_counts(_FOREX)} SELECT category, CAST(n AS BIGINT) AS n FROM counts")
def summary_counts_forex(spark: SparkSession, folder: str) -> DataFrame:
    return _summary(spark, folder, calendars.forex)


@_query(f"WITH {_counts(_CRYPTO)} SELECT category, CAST(n AS BIGINT) AS n FROM counts")
def summary_counts_crypto(spark: SparkSession, folder: str) -> DataFrame:
    return _summary(spark, folder, calendars.crypto)


def _forex_sequence(spark: SparkSession, folder: str) -> checks.Sequence:
    return checks.sequence_checks(_candles(spark, folder), calendars.forex, STEP_S)


@_query(f"WITH {_sequence(_FOREX)} SELECT CAST(epoch(m.ts) AS BIGINT) AS ts_s, CAST(epoch(g.first_ts) AS BIGINT) AS gap_s, CAST(row_number() OVER (PARTITION BY m.id ORDER BY m.ts) - 1 AS BIGINT) AS child_order FROM miss m JOIN gap g USING (id)")
def missing_candles(spark: SparkSession, folder: str) -> DataFrame:
    return _forex_sequence(spark, folder).missing.select(seconds("ts").alias("ts_s"), seconds("first_missing").alias("gap_s"), "child_order")


@_query(f"""WITH {_sequence(_FOREX)} SELECT CAST(epoch(first_ts) AS BIGINT) AS first_s, CAST(epoch(last_ts) AS BIGINT) AS last_s, n AS missing_count, n * 60 AS elapsed_seconds,
 CAST(epoch(prev) AS BIGINT) AS previous_s, CAST(epoch(next) AS BIGINT) AS next_s, p.high_line AS previous_line, f.low_line AS next_line
 FROM gap LEFT JOIN lines p ON p.ts = prev LEFT JOIN lines f ON f.ts = next""")
def time_gaps(spark: SparkSession, folder: str) -> DataFrame:
    gaps = _forex_sequence(spark, folder).gaps
    return gaps.select(seconds("first_missing").alias("first_s"), seconds("last_missing").alias("last_s"), "missing_count", "elapsed_seconds", seconds("previous_observed").alias("previous_s"), seconds("next_observed").alias("next_s"), "previous_line", "next_line")


@_query(f"WITH {_sequence(_FOREX)} SELECT count(*) AS expected_candles FROM slot WHERE opened")
def expected_population(spark: SparkSession, folder: str) -> DataFrame:
    return _forex_sequence(spark, folder).expected


_DIFFER = ", ".join(f"CASE WHEN min({f}) <> max({f}) THEN '{f.capitalize()}' END" for f in ("close", "high", "low", "open", "volume"))


@_query(f"""WITH {_CANDLES}, g AS (SELECT ts, count(*) - 1 AS n, concat_ws(',', {_DIFFER}) AS differing, min(line) AS first_line FROM c GROUP BY ts HAVING count(*) > 1)
 SELECT CAST(epoch(ts) AS BIGINT) AS ts_s, n AS count_contribution, CASE WHEN differing = '' THEN 'Exact' ELSE 'Conflicting' END AS classification, differing AS differing_fields, first_line FROM g""")
def duplicate_groups(spark: SparkSession, folder: str) -> DataFrame:
    groups = checks.duplicate_groups(_candles(spark, folder))
    return groups.select(seconds("ts").alias("ts_s"), "count_contribution", "classification", F.array_join("differing_fields", ",").alias("differing_fields"), "first_line")


_LISTED = " UNION ALL ".join(f"SELECT line, {i} AS k, '{code}' AS violation FROM c WHERE {test}" for i, (code, test) in enumerate(_VIOLATIONS))


@_query(f"WITH {_CANDLES} SELECT line AS source_line, CAST(row_number() OVER (PARTITION BY line ORDER BY k) - 1 AS INT) AS child_order, violation FROM ({_LISTED})")
def invalid_ohlc(spark: SparkSession, folder: str) -> DataFrame:
    return checks.violation_rows(_candles(spark, folder)).select("source_line", "child_order", "violation")


@_query(f"WITH {_CANDLES} SELECT line AS source_line, CAST(epoch(ts) AS BIGINT) AS ts_s FROM c WHERE NOT {_FOREX.format('ts')}")
def closed_market_forex(spark: SparkSession, folder: str) -> DataFrame:
    return checks.closed_records(_candles(spark, folder), calendars.forex).select("source_line", seconds("ts").alias("ts_s"))


@_query(f"WITH {_CANDLES} SELECT line AS source_line, CAST(epoch(ts) AS BIGINT) AS ts_s FROM c WHERE NOT {_EQUITIES.format('ts')}")
def closed_market_equities(spark: SparkSession, folder: str) -> DataFrame:
    return checks.closed_records(_candles(spark, folder), calendars.equities).select("source_line", seconds("ts").alias("ts_s"))


WEEKLY = calendars.WeeklyCalendar("two nights", "Europe/London", (calendars.Session(2, dt.time(22), 3, dt.time(5)), calendars.Session(6, dt.time(20), 0, dt.time(3))))
_LOCAL = "timezone('Europe/London', timezone('UTC', ts))"


@_query(f"""WITH {_CANDLES}, w AS (SELECT DISTINCT ts, CAST((isodow({_LOCAL}) - 1) * 86400 + epoch(CAST({_LOCAL} AS TIME)) AS BIGINT) AS s FROM c)
 SELECT CAST(epoch(ts) AS BIGINT) AS ts_s FROM w WHERE (s >= 2 * 86400 + 22 * 3600 AND s < 3 * 86400 + 5 * 3600) OR s >= 6 * 86400 + 20 * 3600 OR s < 3 * 3600""")
def session_membership_weekly(spark: SparkSession, folder: str) -> DataFrame:
    return _candles(spark, folder).where(checks.is_open(WEEKLY)).select(seconds("ts").alias("ts_s")).distinct()


_DELTAS = f"{_CANDLES}, t AS (SELECT DISTINCT ts FROM c WHERE {_FOREX.format('ts')}), d AS (SELECT epoch(ts) - epoch(lag(ts) OVER (ORDER BY ts)) AS s FROM t), k AS (SELECT CAST(s AS BIGINT) AS delta_s, count(*) AS n FROM d WHERE s IS NOT NULL GROUP BY s)"


@_query(f"WITH {_DELTAS} SELECT delta_s, n FROM k")
def timeframe_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return checks.interval_counts(_candles(spark, folder), calendars.forex).select((F.col("delta_us") / 1_000_000).cast("bigint").alias("delta_s"), "n")


@_query(f"""WITH {_DELTAS}, best AS (SELECT delta_s FROM k WHERE n = (SELECT max(n) FROM k)), one AS (SELECT CASE WHEN count(*) = 1 AND min(delta_s) % 60 = 0 THEN min(delta_s) END AS s FROM best)
 SELECT CASE WHEN s % 86400 = 0 THEN 'D' || s // 86400 WHEN s % 3600 = 0 THEN 'H' || s // 3600 ELSE 'M' || s // 60 END AS timeframe FROM one""")
def timeframe_detected(spark: SparkSession, folder: str) -> DataFrame:
    return checks.detected_timeframe(checks.interval_counts(_candles(spark, folder), calendars.forex)).select("timeframe")


_FINDINGS = f"""{_sequence(_FOREX)}, f AS (
 SELECT 0 AS category_rank, 'missing-candle:' || {_KEY.format('ts')} AS reference, ts, CAST(NULL AS BIGINT) AS first_line FROM miss
 UNION ALL SELECT 1, 'duplicate-record:' || {_KEY.format('ts')} || ':line-' || min(line), ts, min(line) FROM c GROUP BY ts HAVING count(*) > 1
 UNION ALL SELECT 2, 'invalid-ohlc:line-' || line, ts, line FROM c WHERE {_BAD}
 UNION ALL SELECT 3, 'closed-market-record:line-' || line, ts, line FROM c WHERE NOT {_FOREX.format('ts')}
 UNION ALL SELECT 4, 'time-gap:' || {_KEY.format('first_ts')} || ':' || {_KEY.format('last_ts')}, first_ts, NULL FROM gap)"""


@_query(f"WITH {_FINDINGS} SELECT row_number() OVER (ORDER BY category_rank, ts NULLS LAST, first_line NULLS LAST, reference) AS position, category_rank, reference, first_line FROM f")
def findings_canonical(spark: SparkSession, folder: str) -> DataFrame:
    found = findings.catalog(_candles(spark, folder), calendars.forex, STEP_S)
    return findings.positioned(found.findings).select("position", "category_rank", "reference", "first_line")


_PAIR = f"SELECT 'missing-candle:' || {_KEY.format('m.ts')} AS candle, 'time-gap:' || {_KEY.format('g.first_ts')} || ':' || {_KEY.format('g.last_ts')} AS gap_ref FROM miss m JOIN gap g USING (id)"


@_query(f"WITH {_sequence(_FOREX)}, pair AS ({_PAIR}) SELECT candle AS owner, 'PartOfGap' AS kind, gap_ref AS target FROM pair UNION ALL SELECT gap_ref, 'ContainsMissingCandle', candle FROM pair")
def relationship_edges(spark: SparkSession, folder: str) -> DataFrame:
    return findings.edges(_forex_sequence(spark, folder))


@_query(f"WITH {_CANDLES} SELECT count(*) AS accepted, CAST(min(epoch(ts)) AS BIGINT) AS first_s, CAST(max(epoch(ts)) AS BIGINT) AS last_s FROM c")
def coverage_min_max(spark: SparkSession, folder: str) -> DataFrame:
    return _candles(spark, folder).agg(F.count("*").alias("accepted"), F.min(seconds("ts")).alias("first_s"), F.max(seconds("ts")).alias("last_s"))


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    """Counts and populations of the six metrics in one small table."""
    rows = _candles(spark, folder)
    found = findings.catalog(rows, calendars.forex, STEP_S)
    sizes = found.sequence.expected.join(F.broadcast(rows.agg(F.count("*").alias("accepted"))))  # one row each
    metric = F.element_at(F.array(*(F.lit(m) for m in scoring.METRICS)), F.col("position"))
    names = dict(zip(scoring.METRICS, ("MissingCandle", "DuplicateRecord", "InvalidOhlc", "ClosedMarketRecord", "TimeGap", "MalformedRow"), strict=True))
    counts = findings.summary(found.findings)
    position = F.element_at(F.create_map(*(F.lit(x) for i, c in enumerate(names.values(), 1) for x in (c, i))), F.col("category"))
    counts = counts.withColumn("position", position).withColumn("metric", metric)
    timed = F.col("metric").isin("MissingCandles", "TimeGaps")
    return counts.join(F.broadcast(sizes)).select("metric", F.col("count").alias("n"), F.when(timed, F.col("expected_candles")).otherwise(F.col("accepted")).alias("population"))


_SCORED = f"""{_counts(_FOREX)}, p AS (SELECT (SELECT count(*) FROM slot WHERE opened) AS expected, (SELECT count(*) FROM c) AS accepted),
 s AS (SELECT CASE category WHEN 'MissingCandle' THEN 'MissingCandles' WHEN 'DuplicateRecord' THEN 'DuplicateRecords' WHEN 'InvalidOhlc' THEN 'InvalidOhlc' WHEN 'ClosedMarketRecord' THEN 'ClosedMarketRecords' WHEN 'TimeGap' THEN 'TimeGaps' ELSE 'MalformedRows' END AS metric,
  CAST(n AS BIGINT) AS n, CASE WHEN category IN ('MissingCandle', 'TimeGap') THEN expected ELSE accepted END AS population FROM counts, p)"""


@_query(f"WITH {_SCORED} SELECT metric, n, population, CAST((20000 * (population - n) + population) // (2 * population) AS BIGINT) AS score_cents FROM s")
def metric_scores(spark: SparkSession, folder: str) -> DataFrame:
    score = (scoring.score_column(F.col("n"), F.col("population")) * 100).cast("bigint")
    return _scored(spark, folder).select("metric", "n", "population", score.alias("score_cents"))


@_query(f"""WITH {_SCORED}, e AS (SELECT CAST(sum(CASE WHEN metric IN ('MissingCandles', 'TimeGaps') THEN population - n END) AS HUGEINT) AS a, CAST(any_value(population) FILTER (metric = 'TimeGaps') AS HUGEINT) AS pa,
  CAST(sum(CASE WHEN metric NOT IN ('MissingCandles', 'TimeGaps') THEN population - n END) AS HUGEINT) AS b, CAST(any_value(population) FILTER (metric = 'InvalidOhlc') AS HUGEINT) AS pb FROM s)
 SELECT CAST((20000 * (a * pb + b * pa) + 6 * pa * pb) // (12 * pa * pb) AS BIGINT) AS average_cents FROM e""")
def dataset_average(spark: SparkSession, folder: str) -> DataFrame:
    rows = {r["metric"]: r for r in _scored(spark, folder).collect()}  # six rows
    sizes = {"expected_candles": rows["TimeGaps"]["population"], "accepted_rows": rows["InvalidOhlc"]["population"], "examined_rows": rows["MalformedRows"]["population"]}
    score = scoring.dataset_score({m: rows[m]["n"] for m in scoring.METRICS}, sizes)
    return spark.createDataFrame([(int(scoring.rounded(score.average) * 100),)], "average_cents bigint")


_COMPARED = f"""{_CANDLES}, b AS (SELECT ts, arg_min(open, line) AS open, arg_min(high, line) AS high, arg_min(low, line) AS low, arg_min(close, line) AS close, arg_min(volume, line) AS volume, min(line) AS line FROM c GROUP BY ts),
 k AS (SELECT * REPLACE (open + CASE WHEN (line - 1) % 17 = 0 THEN 1 WHEN (line - 1) % 11 = 0 THEN CAST(0.00005 AS DECIMAL(20,8)) WHEN (line - 1) % 7 = 0 THEN 0.02 ELSE 0 END AS open) FROM b WHERE (line - 1) % 13 <> 0
  UNION ALL SELECT * REPLACE (ts + INTERVAL 365 DAY AS ts) FROM (SELECT * FROM b ORDER BY ts LIMIT 10)),
 a AS (SELECT coalesce(b.ts, k.ts) AS ts, CASE WHEN b.ts IS NULL THEN 'extra_in_candidate' WHEN k.ts IS NULL THEN 'missing_from_candidate' ELSE 'matched' END AS status, b.open AS bo, b.high AS bh, b.low AS bl, b.close AS bc, b.volume AS bv,
  k.open AS ko, k.high AS kh, k.low AS kl, k.close AS kc, k.volume AS kv, k.line AS line FROM b FULL OUTER JOIN k ON b.ts = k.ts),
 v AS (SELECT ts, line, 'Open' AS field, bo AS x, ko AS y, 0.01 AS abs_t, 0.0001 AS rel_t FROM a WHERE status = 'matched' UNION ALL SELECT ts, line, 'High', bh, kh, 0.01, 0.0001 FROM a WHERE status = 'matched'
  UNION ALL SELECT ts, line, 'Low', bl, kl, 0.01, 0.0001 FROM a WHERE status = 'matched' UNION ALL SELECT ts, line, 'Close', bc, kc, 0.01, 0.0001 FROM a WHERE status = 'matched' UNION ALL SELECT ts, line, 'Volume', bv, kv, 0, 0.05 FROM a WHERE status = 'matched'),
 q AS (SELECT *, abs(x - y) AS diff, CASE WHEN abs(x - y) <= abs_t THEN 'AcceptedByAbsolute' WHEN x <> 0 AND abs(x - y) <= CAST(rel_t AS DECIMAL(12,8)) * abs(CAST(x AS DECIMAL(20,8))) THEN 'AcceptedByRelative' ELSE 'MaterialDifference' END AS decision FROM v)"""


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    reference = events.benchmark(_candles(spark, folder))
    return comparison.aligned(reference, events.candidate(reference))


def _decisions(pairs: DataFrame) -> DataFrame:
    step = comparison.Decimal("0.01")
    return comparison.field_decisions(pairs, comparison.resolve(None, step))


@_query(f"WITH {_COMPARED} SELECT CAST(epoch(ts) AS BIGINT) AS ts_s, status FROM a")
def compare_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return _pairs(spark, folder).select(seconds("ts").alias("ts_s"), "status")


@_query(f"""WITH {_COMPARED} SELECT count(*) FILTER (status = 'matched') AS matched, count(*) FILTER (status = 'missing_from_candidate') AS missing, count(*) FILTER (status = 'extra_in_candidate') AS extra,
 CAST(min(epoch(ts)) FILTER (status = 'matched') AS BIGINT) AS overlap_start_s, CAST(max(epoch(ts)) FILTER (status = 'matched') AS BIGINT) AS overlap_end_s FROM a""")
def compare_coverage(spark: SparkSession, folder: str) -> DataFrame:
    return comparison.coverage(_pairs(spark, folder)).select("matched", "missing", "extra", seconds("overlap_start").alias("overlap_start_s"), seconds("overlap_end").alias("overlap_end_s"))


@_query(f"WITH {_COMPARED} SELECT CAST(epoch(ts) AS BIGINT) AS ts_s, field, CAST(diff * 100000000 AS BIGINT) AS difference_e8, CAST((y - x) * 100000000 AS BIGINT) AS directional_e8, line AS candidate_line FROM q WHERE decision = 'MaterialDifference'")
def compare_discrepancies(spark: SparkSession, folder: str) -> DataFrame:
    rows = comparison.discrepancies(_decisions(_pairs(spark, folder)))
    return rows.select(seconds("ts").alias("ts_s"), "field", scaled(F.col("difference")).alias("difference_e8"), scaled(F.col("directional_difference")).alias("directional_e8"), "candidate_line")


@_query(f"""WITH {_COMPARED} SELECT field, count(*) AS total_compared, count(*) FILTER (decision = 'AcceptedByAbsolute' AND diff <> 0) AS accepted_by_absolute,
 count(*) FILTER (decision = 'AcceptedByRelative') AS accepted_by_relative, count(*) FILTER (decision = 'MaterialDifference') AS material FROM q GROUP BY field""")
def compare_tolerated(spark: SparkSession, folder: str) -> DataFrame:
    return comparison.tolerated(_decisions(_pairs(spark, folder)))


@_query(f"""WITH {_COMPARED}, n AS (SELECT (SELECT count(*) FROM a WHERE status = 'matched') AS matched, (SELECT count(DISTINCT ts) FROM q WHERE decision = 'MaterialDifference') AS material_instants)
 SELECT matched, material_instants, CAST((20000 * (matched - material_instants) + matched) // (2 * matched) AS BIGINT) AS agreement_cents FROM n""")
def compare_agreement(spark: SparkSession, folder: str) -> DataFrame:
    pairs = _pairs(spark, folder)
    row = comparison.agreement(pairs, _decisions(pairs))
    return row.select("matched", "material_instants", (scoring.score_column(F.col("material_instants"), F.col("matched")) * 100).cast("bigint").alias("agreement_cents"))


_TEXT = """x AS (SELECT event_id + 1 AS line, CASE WHEN event_id % 41 = 0 THEN 'abc' WHEN event_id % 43 = 0 THEN '1e3' WHEN event_id % 47 = 0 THEN '1,234.5' WHEN event_id % 53 = 0 THEN '' WHEN event_id % 59 = 0 THEN ' +7.25 ' WHEN event_id % 61 = 0 THEN '5-' ELSE (event_id // 3) || '.' || (event_id % 100) END AS open,
 (event_id // 3) || '.' || (event_id % 100) AS high, CASE WHEN event_id % 67 = 0 THEN '2024.02.30' WHEN event_id % 71 = 0 THEN '2024-01-05' ELSE strftime(ts, '%Y.%m.%d') END AS date, CASE WHEN event_id % 73 = 0 THEN '24:00' ELSE strftime(ts, '%H:%M') END AS time FROM events)"""


_PARSED = f"""{_TEXT}, t AS (SELECT *, try_strptime(date || ' ' || time, '%Y.%m.%d %H:%M') AS ts,
  CASE WHEN regexp_full_match(open, '\\s*([+-]\\s*)?([0-9][0-9,]*(\\.[0-9]*)?|\\.[0-9]+)\\s*') OR regexp_full_match(open, '\\s*([0-9][0-9,]*(\\.[0-9]*)?|\\.[0-9]+)\\s*[+-]\\s*') THEN 1 END AS number FROM x)"""


def _parsed(spark: SparkSession, folder: str) -> DataFrame:
    """The records as lines of a file without a header, through the scan's own parse."""
    names = ["date", "time", *csv_scan.PRICES]
    lines = events.texts(table(spark, folder, "events")).select("source_line", F.concat_ws(";", *names).alias("text"))
    return csv_scan.parsed(lines, csv_scan.resolve_layout(names, csv_scan.CsvOptions()), ";", csv_scan.CsvOptions(tz_offset="+00:00"))


@_query(f"WITH {_PARSED} SELECT CAST(max(greatest(len(split_part(regexp_replace(open, '[^0-9.]', '', 'g'), '.', 2)), len(split_part(high, '.', 2)))) AS INT) AS scale FROM t WHERE ts IS NOT NULL AND number = 1")
def fractional_step(spark: SparkSession, folder: str) -> DataFrame:
    return comparison.fractional_step(_parsed(spark, folder).where(F.col("reason").isNull())).select("scale")


@_query(f"WITH {_PARSED} SELECT line AS source_line, CASE WHEN ts IS NULL THEN 'timestamp' ELSE 'open' END AS field FROM t WHERE ts IS NULL OR number IS NULL")
def malformed_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = _parsed(spark, folder).where(F.col("reason").isNotNull())
    return rows.select("source_line", F.when(F.col("reason").contains("timestamp"), "timestamp").otherwise("open").alias("field"))



@_query(f"""WITH {_CANDLES}, t AS (SELECT ts, lead(ts) OVER (ORDER BY ts) AS next FROM (SELECT DISTINCT ts FROM c))
 SELECT CAST(epoch(ts) AS BIGINT) AS previous_s, CAST(epoch(next) - epoch(ts) AS BIGINT) AS elapsed_seconds, CAST(epoch(next) - epoch(ts) AS BIGINT) // 300 - 1 AS missing_count FROM t WHERE epoch(next) - epoch(ts) > 300""")
def pairwise_gaps(spark: SparkSession, folder: str) -> DataFrame:
    return checks.pairwise_gaps(_candles(spark, folder), 300).select(seconds("previous").alias("previous_s"), "elapsed_seconds", "missing_count")


_DIFFERENT = " + ".join(f"CAST(min({f}) <> max({f}) AS INT)" for f in ("open", "high", "low", "close", "volume"))


@_query(f"""WITH {_CANDLES}, g AS (SELECT ts, count(*) AS n, {_DIFFERENT} AS fields, min(line) AS first_line FROM c GROUP BY ts HAVING count(*) > 1)
 SELECT 'duplicate-record:' || {_KEY.format('ts')} || ':line-' || first_line AS reference, line AS source_line, CAST(row_number() OVER (PARTITION BY ts ORDER BY line) - 1 + fields AS BIGINT) AS child_order FROM c JOIN g USING (ts)""")
def duplicate_evidence(spark: SparkSession, folder: str) -> DataFrame:
    rows = _candles(spark, folder)
    found = findings.catalog(rows, calendars.forex, STEP_S)
    records = findings.evidence(found, rows, "forex", "M1").where(F.col("kind") == "DuplicateRow")
    return records.select("reference", F.get_json_object("payload", "$.sourceLine").cast("bigint").alias("source_line"), "child_order")
