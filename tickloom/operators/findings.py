"""Findings with stable references and one canonical order, their evidence rows, and the graph of gaps and missing candles."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.plans import written
from tickloom.operators import checks
from tickloom.operators.calendars import Calendar
from tickloom.operators.ordered_blocks import numbered

#: Category, name, title, explanation, evidence kind, suggested action; in canonical order.
CATEGORIES = [
    ("MissingCandle", "Missing candle", "An expected candle is absent from the dataset.", "MissingCandle", "Verify the source feed for the expected timestamp."),
    ("DuplicateRecord", None, "Multiple rows share the same timestamp.", "DuplicateRecord", "Keep one canonical row and remove the rest."),
    ("InvalidOhlc", "Invalid OHLC values", "The row violates established OHLC/volume invariants.", "InvalidOhlc", "Correct or remove the row."),
    ("ClosedMarketRecord", "Closed-market record", "The row's timestamp falls outside the market calendar's open sessions.", "ClosedMarketRecord", "Remove the row or verify the calendar."),
    ("TimeGap", "Time gap", "A contiguous run of expected candles is absent.", "TimeGap", "Investigate data discontinuities around the gap."),
    ("MalformedRow", "Malformed row", "The row could not be parsed as a valid record.", "MalformedRow", "Fix the row or remove it from the source."),
]
NAMES = [c[0] for c in CATEGORIES]
EXACT_TITLE, CONFLICTING_TITLE = "Exact duplicate record", "Conflicting duplicate records"
SKIPPED = ("DuplicateRecords", "InvalidOhlc", "ClosedMarketRecords")
COLUMNS = ["category", "category_rank", "reference", "title", "explanation", "count_contribution", "ts", "first_line", "evidence_kind", "suggested_action"]


def utc_key(ts: str) -> Column:
    """``yyyyMMddTHHmmssfffffffZ``, UTC with seven digits of fraction."""
    us = F.unix_micros(F.col(ts))
    second = F.floor(us / F.lit(1_000_000).cast("decimal(20,0)")).cast("bigint")
    day = F.date_format(F.date_from_unix_date(F.floor(second / 86_400).cast("int")), "yyyyMMdd")
    rest = F.pmod(second, F.lit(86_400))
    two = lambda c: F.lpad(c.cast("int").cast("string"), 2, "0")
    micro = F.lpad(F.pmod(us, F.lit(1_000_000)).cast("string"), 6, "0")
    return F.concat(day, F.lit("T"), two(F.floor(rest / 3600)), two(F.floor(rest / 60) % 60), two(rest % 60), micro, F.lit("0Z"))


def _finding(df: DataFrame, by: tuple[str, ...], name: str, reference: Column, ts: str, line: Column, count: Column | None = None, title: Column | None = None) -> DataFrame:
    rank = NAMES.index(name)
    _, text, explanation, kind, action = CATEGORIES[rank]
    return df.select(
        *by,
        F.lit(name).alias("category"),
        F.lit(rank).alias("category_rank"),
        reference.alias("reference"),
        (F.lit(text) if title is None else title).alias("title"),
        F.lit(explanation).alias("explanation"),
        (F.lit(1) if count is None else count).cast("bigint").alias("count_contribution"),
        F.col(ts).alias("ts"),
        line.cast("bigint").alias("first_line"),
        F.lit(kind).alias("evidence_kind"),
        F.lit(action).alias("suggested_action"),
    )


@dataclass
class Catalog:
    """Findings and what belongs to them; every part is a DataFrame."""

    findings: DataFrame
    edges: DataFrame
    sequence: checks.Sequence
    duplicates: DataFrame
    violations: DataFrame
    closed: DataFrame
    malformed: DataFrame | None


def physical(name: str, line: str) -> Column:
    return F.concat(F.lit({"InvalidOhlc": "invalid-ohlc", "ClosedMarketRecord": "closed-market-record", "MalformedRow": "malformed-row"}[name] + ":line-"), F.col(line).cast("string"))


def gap_reference() -> Column:
    return F.concat(F.lit("time-gap:"), utc_key("first_missing"), F.lit(":"), utc_key("last_missing"))


def missing_reference(ts: str = "ts") -> Column:
    return F.concat(F.lit("missing-candle:"), utc_key(ts))


def distinguished(findings: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """A reference that is taken already gets ``:2``, ``:3`` and so on in order of instant and line; those of missing candles don't."""
    w = Window.partitionBy(*by, "reference").orderBy(F.col("ts").asc_nulls_last(), F.col("first_line").asc_nulls_last())
    n = F.row_number().over(w)
    suffix = F.when((n > 1) & (F.col("category") != "MissingCandle"), F.concat(F.lit(":"), n.cast("string"))).otherwise("")
    return findings.withColumn("_suffix", suffix).withColumn("reference", F.concat("reference", "_suffix")).drop("_suffix")


def catalog(candles: DataFrame, calendar: Calendar, step_s: int, malformed: DataFrame | None = None, by: tuple[str, ...] = ()) -> Catalog:
    """All findings of the six checks. ``malformed`` has ts (or null), source_line, reason and raw_text."""
    seq = checks.sequence_checks(candles, calendar, step_s, malformed, by)
    groups = checks.duplicate_groups(candles, by)
    bad = checks.invalid_ohlc(candles)
    closed = checks.closed_records(candles, calendar)
    null = F.lit(None)
    title = F.when(F.col("classification") == "Exact", EXACT_TITLE).otherwise(CONFLICTING_TITLE)
    duplicate = F.concat(F.lit("duplicate-record:"), utc_key("ts"), F.lit(":line-"), F.col("first_line").cast("string"))
    parts = [
        _finding(seq.missing, by, "MissingCandle", missing_reference(), "ts", null),
        _finding(groups, by, "DuplicateRecord", duplicate, "ts", F.col("first_line"), F.col("count_contribution"), title),
        _finding(bad, by, "InvalidOhlc", physical("InvalidOhlc", "source_line"), "ts", F.col("source_line")),
        _finding(closed, by, "ClosedMarketRecord", physical("ClosedMarketRecord", "source_line"), "ts", F.col("source_line")),
        _finding(seq.gaps, by, "TimeGap", gap_reference(), "first_missing", null),
    ]
    if malformed is not None:
        parts.append(_finding(malformed, by, "MalformedRow", physical("MalformedRow", "source_line"), "ts", F.col("source_line")))
    # Summary, evidence, edges and reports all read the findings: made once.
    findings = written(distinguished(reduce(DataFrame.unionByName, parts), by), "findings-table")
    return Catalog(findings, edges(seq, by), seq, groups, bad, closed, malformed)


def edges(seq: checks.Sequence, by: tuple[str, ...] = ()) -> DataFrame:
    """(owner, kind, target): each missing candle is part of its gap, and the gap contains it."""
    pair = seq.missing.select(*by, missing_reference().alias("candle"), gap_reference().alias("gap"))
    part = pair.select(*by, F.col("candle").alias("owner"), F.lit("PartOfGap").alias("kind"), F.col("gap").alias("target"))
    contains = pair.select(*by, F.col("gap").alias("owner"), F.lit("ContainsMissingCandle").alias("kind"), F.col("candle").alias("target"))
    return part.unionByName(contains)


def dangling(found: Catalog, by: tuple[str, ...] = ()) -> DataFrame:
    """Edges whose target is no finding; none in a sound catalog."""
    known = found.findings.select(*by, F.col("reference").alias("target"))
    return found.edges.join(known, [*by, "target"], "left_anti")


def canonical_order(by: tuple[str, ...] = ()) -> list[Column]:
    """Category, instant, first line, reference; what doesn't apply comes last."""
    return [*map(F.col, by), F.col("category_rank").asc(), F.col("ts").asc_nulls_last(), F.col("first_line").asc_nulls_last(), F.col("reference").asc()]


def positioned(findings: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Findings with ``position`` from 1 in canonical order, over all datasets: a range sort, no single window."""
    keyed = findings.withColumn("_no_ts", F.col("ts").isNull()).withColumn("_no_line", F.col("first_line").isNull())
    order = [*by, "category_rank", "_no_ts", "ts", "_no_line", "first_line", "reference"]
    return numbered(keyed, order, "findings").withColumn("position", F.col("_at") + 1).drop("_at", "_no_ts", "_no_line")


def summary(findings: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row per category, those without findings too: findings and the sum of their contributions."""
    spark = findings.sparkSession
    names = spark.createDataFrame(list(enumerate(NAMES)), "category_rank int, category string")
    counts = findings.groupBy(*by, "category").agg(F.count("*").alias("entries"), F.sum("count_contribution").alias("count"))
    if by:
        names = findings.select(*by).distinct().withColumn("_c", F.explode(F.array(*(F.struct(F.lit(i).alias("category_rank"), F.lit(n).alias("category")) for i, n in enumerate(NAMES))))).select(*by, "_c.*")
    out = names.join(counts, [*by, "category"], "left")
    return out.select(*by, "category", "category_rank", F.coalesce("entries", F.lit(0)).alias("entries"), F.coalesce("count", F.lit(0)).alias("count"))


def utc_text(column: str, millis: bool = False) -> Column:
    """``yyyy-MM-ddTHH:mm:ssZ``, or with three digits of fraction, whatever the session's time zone; null for null."""
    us = F.unix_micros(F.col(column))
    second = F.expr(f"unix_micros({column}) div 1000000 - if(pmod(unix_micros({column}), 1000000) <> 0 and unix_micros({column}) < 0, 1, 0)")
    day = F.date_format(F.date_from_unix_date(F.floor(second / 86_400).cast("int")), "yyyy-MM-dd")
    rest = F.pmod(second, F.lit(86_400))
    two = lambda c: F.lpad(c.cast("int").cast("string"), 2, "0")
    fraction = [F.lit("."), F.lpad(F.floor(F.pmod(us, F.lit(1_000_000)) / 1000).cast("int").cast("string"), 3, "0")] if millis else []
    return F.concat(day, F.lit("T"), two(F.floor(rest / 3600)), F.lit(":"), two(F.floor(rest / 60) % 60), F.lit(":"), two(rest % 60), *fraction, F.lit("Z"))


#: By kind of record the list of the contract's evidence that it belongs to; other kinds are the evidence's own fields.
LISTS = {"TimeGapMissingReference": "missingCandleReferences", "DuplicateDifferingField": "differingFields", "DuplicateRow": "rows", "InvalidOhlcViolation": "violations", "MalformedFieldError": "fieldErrors", "MalformedSkippedCheck": "checksNotApplied"}
#: The lists of each category's evidence, in order, which are there if empty too.
LISTS_OF = {"TimeGap": ["missingCandleReferences"], "DuplicateRecord": ["differingFields", "rows"], "InvalidOhlc": ["violations"], "MalformedRow": ["fieldErrors", "checksNotApplied"]}


def evidence(found: Catalog, candles: DataFrame, profile: str, timeframe: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(reference, kind, child_order, payload): every evidence record, one row each, its payload as the contract's JSON without what doesn't apply.

    Records whose references needed a suffix are joined by line or instant through the findings, so they carry the same suffix."""
    text = lambda *columns: F.to_json(F.struct(*columns))
    out = []

    def give(df: DataFrame, reference: Column, kind: str, order: Column, payload: Column) -> None:
        out.append(df.select(*by, reference.alias("reference"), F.lit(kind).alias("kind"), order.cast("bigint").alias("child_order"), payload.alias("payload")))

    gaps, missing = found.sequence.gaps, found.sequence.missing
    brackets = [
        utc_text("previous_observed").alias("previousObservedTimestampUtc"), utc_text("next_observed").alias("nextObservedTimestampUtc"),
        F.col("previous_line").alias("previousObservedSourceLine"), F.col("next_line").alias("nextObservedSourceLine"),
    ]
    frame = F.lit(timeframe).alias("expectedTimeframe")
    give(missing, missing_reference(), "MissingCandle", F.lit(-1), text(utc_text("ts").alias("expectedTimestampUtc"), frame, gap_reference().alias("timeGapReference"), *brackets))
    span = [utc_text("first_missing").alias("firstMissingTimestampUtc"), utc_text("last_missing").alias("lastMissingTimestampUtc")]
    give(gaps, gap_reference(), "TimeGap", F.lit(-1), text(*span, frame, F.col("missing_count").alias("missingCandleCount"), F.col("elapsed_seconds").alias("elapsedSeconds"), *brackets))
    give(missing, gap_reference(), "TimeGapMissingReference", F.col("child_order"), F.concat(F.lit('"'), missing_reference(), F.lit('"')))
    named = found.findings.select(*by, "category", "reference", F.col("ts").alias("_ts"), F.col("first_line").alias("_line"))

    def of(df: DataFrame, name: str, line: str) -> DataFrame:
        own = named.where(F.col("category") == name).dropDuplicates([*by, "_line", "_ts", "reference"])
        same = F.col(line).eqNullSafe(F.col("_line")) & F.col("ts").eqNullSafe(F.col("_ts"))
        for k in by:
            same = same & df[k].eqNullSafe(own[k])
        return df.join(own.drop(*by) if not by else own, same).drop(*(own[k] for k in by))

    code = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    groups = of(found.duplicates, "DuplicateRecord", "first_line")
    give(groups, F.col("reference"), "DuplicateRecord", F.lit(-1), text(utc_text("ts").alias("sharedTimestampUtc"), F.col("classification")))
    give(groups.select("*", F.posexplode("differing_fields").alias("_i", "field")), F.col("reference"), "DuplicateDifferingField", F.col("_i"), code(F.col("field")))
    # Rows follow the fields in order of line. They are numbered by a range sort over all groups less the group's first number, as a
    # window over one group would sort it in one task.
    keys = groups.select(*by, "ts", "reference", F.size("differing_fields").alias("_fields"))
    rows = numbered(candles.join(keys, [*by, "ts"]), [*by, "reference", "source_line"], "duplicate-rows")
    first = rows.groupBy(*by, "reference").agg(F.min("_at").alias("_first"))
    values = [F.col(c) for c in checks.FIELDS]
    order = F.col("_at") - F.col("_first") + F.col("_fields")
    give(rows.join(first, [*by, "reference"]), F.col("reference"), "DuplicateRow", order, text(F.col("source_line").alias("sourceLine"), *values))
    bad = of(found.violations, "InvalidOhlc", "source_line")
    give(bad, F.col("reference"), "InvalidOhlc", F.lit(-1), text(F.struct(*values).alias("observed")))
    give(bad.select("*", F.posexplode("violations").alias("_i", "violation")), F.col("reference"), "InvalidOhlcViolation", F.col("_i"), code(F.col("violation")))
    shut = of(found.closed, "ClosedMarketRecord", "source_line")
    give(shut, F.col("reference"), "ClosedMarketRecord", F.lit(-1), text(F.lit(profile).alias("marketProfile"), F.lit(profile.capitalize()).alias("calendarName"), F.lit("RecurringClosedRule").alias("closedRule")))
    if found.malformed is not None:
        lost = of(found.malformed, "MalformedRow", "source_line")
        give(lost, F.col("reference"), "MalformedRow", F.lit(-1), text(utc_text("ts").alias("parsedTimestampUtc"), F.col("ts").isNotNull().alias("expectedSlotReserved")))
        give(lost, F.col("reference"), "MalformedFieldError", F.lit(0), text(F.lit("row").alias("field"), F.col("raw_text").alias("originalValue"), F.lit("INVALID_VALUE").alias("reasonCode"), F.col("reason")))
        skipped = F.array(*(F.lit(s) for s in SKIPPED))
        give(lost.select("*", F.posexplode(skipped).alias("_i", "check")), F.col("reference"), "MalformedSkippedCheck", F.col("_i"), code(F.col("check")))
    return reduce(DataFrame.unionByName, out)
