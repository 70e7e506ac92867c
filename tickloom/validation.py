"""One validation run: scan, checks, reconciliation and scores of a candle file, as a report whose large parts are DataFrames."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from fractions import Fraction
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators import calendars, checks, findings, scoring
from tickloom.sources.csv_scan import CsvOptions, Prepared, ScanError, scan

#: Fatal codes with their class and stage.
FATAL = {
    "INVALID_ARGUMENT": ("Configuration", "ArgumentValidation"),
    "SOURCE_UNAVAILABLE": ("Operational", "SourceIdentity"),
    "SOURCE_CHANGED": ("Operational", "Ingestion"),
    "INVALID_ENCODING": ("Dataset", "Ingestion"),
    "INVALID_CSV": ("Dataset", "Ingestion"),
    "INVALID_STRUCTURE": ("Dataset", "Ingestion"),
    "AMBIGUOUS_DELIMITER": ("Configuration", "Ingestion"),
    "AMBIGUOUS_TIMEFRAME": ("Configuration", "TimeframeResolution"),
    "INVALID_CALENDAR": ("Configuration", "ArgumentValidation"),
    "VALIDATION_INCOMPLETE": ("Operational", "Validation"),
    "REPORT_RECONCILIATION_FAILED": ("Operational", "Reconciliation"),
    "REPORT_RENDER_FAILED": ("Operational", "ReportRendering"),
    "REPORT_COMMIT_FAILED": ("Operational", "ReportCommit"),
}
COMPLETED, NOT_APPLICABLE, NOT_COMPLETED = "Completed", "NotApplicable", "NotCompleted"
NO_SEQUENCE = "Fewer than two open-market timestamps bound an expected sequence."


class Fatal(Exception):
    """A run that ends without a report."""

    def __init__(self, code: str, reason: str, guidance: str = "Check the input and the options."):
        super().__init__(reason)
        self.code, self.reason, self.guidance = code, reason, guidance
        self.failure_class, self.stage = FATAL[code]


@dataclass(frozen=True)
class Timeframe:
    unit: str
    size: int

    @property
    def seconds(self) -> int:
        return self.size * {"M": 60, "H": 3600, "D": 86_400}[self.unit]

    def __str__(self) -> str:
        return f"{self.unit}{self.size}"

    @staticmethod
    def parse(text: str) -> Timeframe:
        m = re.fullmatch(r"\s*([MHDmhd])([0-9]{1,6})\s*", text)
        if m is None or int(m[2]) == 0:
            raise Fatal("INVALID_ARGUMENT", f"{text!r} is no timeframe")
        return Timeframe(m[1].upper(), int(m[2]))


@dataclass
class Report:
    prepared: Prepared
    timeframe: Timeframe
    profile: str
    calendar: calendars.Calendar
    checks: dict[str, tuple[str, str | None]]
    entries: dict[str, int]
    counts: dict[str, int]
    expected: int | None
    catalog: findings.Catalog
    score: scoring.DatasetScore | None = None
    weights: dict[str, Fraction] | None = field(default=None)
    #: Sums of the findings' contributions, and whether the coverage adds up; counted apart from ``counts``.
    contributions: dict[str, int] = field(default_factory=dict)
    coverage_reconciled: bool = False

    @property
    def clean(self) -> bool:
        return not any(self.counts.values())

    def evidence(self) -> DataFrame:
        return findings.evidence(self.catalog, self.prepared.candles, self.profile, str(self.timeframe))


def resolve_timeframe(candles: DataFrame, calendar: calendars.Calendar, given: str | None) -> Timeframe:
    if given:
        return Timeframe.parse(given)
    found = checks.detected_timeframe(checks.interval_counts(candles, calendar)).first()["timeframe"]
    if found is None:
        raise Fatal("AMBIGUOUS_TIMEFRAME", "The timeframe can't be told from the data.", "Name the timeframe.")
    return Timeframe.parse(found)


def validate(spark: SparkSession, path: str, options: CsvOptions, profile: str = "forex", custom: calendars.WeeklyCalendar | None = None, timeframe: str | None = None, score: bool = False, weights: dict[str, Fraction] | None = None) -> Report:
    """Runs every check. Fatal conditions raise ``Fatal``; a file without rows needs a timeframe."""
    try:
        calendar = calendars.calendar_for(profile, custom)
    except ValueError as e:
        raise Fatal("INVALID_ARGUMENT", str(e)) from e
    try:
        prepared = scan(spark, path, options)
    except ScanError as e:
        raise Fatal(e.code, e.reason) from e
    frame = resolve_timeframe(prepared.candles, calendar, timeframe)
    found = findings.catalog(prepared.candles, calendar, frame.seconds, prepared.malformed)
    rows = findings.summary(found.findings).collect()  # six rows
    contributions, entries = {r["category"]: r["count"] for r in rows}, {r["category"]: r["entries"] for r in rows}
    counts = checks_counts(found, prepared)
    expected = next((r["expected_candles"] for r in found.sequence.expected.collect()), None)  # one row
    sequence = (COMPLETED, None) if expected else (NOT_APPLICABLE, NO_SEQUENCE)
    states = {m: sequence if m in ("MissingCandles", "TimeGaps") else (COMPLETED, None) for m in scoring.METRICS}
    report = Report(prepared, frame, profile, calendar, states, entries, counts, expected, found, contributions=contributions)
    reconcile(report)
    verify_edges(report)
    if score:
        by_metric = dict(zip(scoring.METRICS, (counts[c] for c in findings.NAMES), strict=True))
        sizes = {"expected_candles": expected, "accepted_rows": prepared.accepted, "examined_rows": prepared.examined}
        try:
            report.score = scoring.dataset_score(by_metric, sizes, weights)
        except scoring.ReconciliationError as e:
            raise Fatal("REPORT_RECONCILIATION_FAILED", str(e)) from e
        report.weights = weights
    return report


def checks_counts(found: findings.Catalog, prepared: Prepared) -> dict[str, int]:
    """The six counts by the checks' own tables, not by the findings made of them."""
    n = F.count("*").alias("n")
    own = {"MissingCandle": found.sequence.gaps.agg(F.coalesce(F.sum("missing_count"), F.lit(0)).alias("n")), "DuplicateRecord": found.duplicates.agg(F.coalesce(F.sum("count_contribution"), F.lit(0)).alias("n")), "InvalidOhlc": found.violations.agg(n), "ClosedMarketRecord": found.closed.agg(n), "TimeGap": found.sequence.gaps.agg(n)}
    rows = reduce(DataFrame.unionByName, (df.select(F.lit(k).alias("category"), "n") for k, df in own.items())).collect()  # five rows
    return {r["category"]: r["n"] for r in rows} | {"MalformedRow": prepared.rejected}


def reconcile(report: Report) -> None:
    """The accepted and the rejected rows, each counted, are those examined; the findings' contributions are the checks' counts; entries
    are as many as contributions but for duplicates."""
    p = report.prepared
    report.coverage_reconciled = p.examined == p.accepted + p.rejected
    if not report.coverage_reconciled:
        raise Fatal("REPORT_RECONCILIATION_FAILED", "Accepted and malformed rows don't add up.")
    for c in findings.NAMES:
        if report.contributions[c] != report.counts[c] or c != "DuplicateRecord" and report.entries[c] != report.counts[c]:
            raise Fatal("REPORT_RECONCILIATION_FAILED", f"Counts and findings of {c} disagree.")


def verify_edges(report: Report) -> None:
    if findings.dangling(report.catalog).limit(1).count():
        raise Fatal("VALIDATION_INCOMPLETE", "A relationship names no finding.")
