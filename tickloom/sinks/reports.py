"""Reports as text and JSON. Findings are streamed to the destination in canonical order; only totals are held on the driver."""

from __future__ import annotations

import datetime as dt
import json
import os
import tempfile
from collections.abc import Iterable, Iterator
from contextlib import contextmanager, suppress
from dataclasses import dataclass
from decimal import Context, Decimal
from fractions import Fraction
from functools import reduce
from typing import TextIO

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tickloom.functions.plans import scope
from tickloom.operators import comparison, findings, scoring
from tickloom.validation import COMPLETED, Fatal, Report

#: Labels of the six counts, in canonical order.
LABELS = ("Missing candles", "Duplicate records", "Invalid OHLC", "Closed-market records", "Time gaps", "Malformed rows")
_KEYS = ("missingCandles", "duplicateRecords", "invalidOhlc", "closedMarketRecords", "timeGaps", "malformedRows")
KINDS = {"expected_candles": "expected candles", "accepted_rows": "accepted rows", "examined_rows": "examined rows"}


def utc(value: dt.datetime | None, millis: bool = False) -> str | None:
    if value is None:
        return None
    value = value.replace(tzinfo=dt.timezone.utc) if value.tzinfo is None else value.astimezone(dt.timezone.utc)
    return value.strftime("%Y-%m-%dT%H:%M:%S") + (f".{value.microsecond // 1000:03d}Z" if millis else "Z")


def quoted(text: str | None) -> str:
    """Source text in quotes with control characters, quotes and backslashes escaped."""
    return "n/a" if text is None else json.dumps(text, ensure_ascii=False)


def _counts(report: Report) -> list[int]:
    return [report.counts[c] for c in findings.NAMES]


_instant = findings.utc_text


def _ordered(report: Report) -> DataFrame:
    return report.catalog.findings.orderBy(*findings.canonical_order())


@dataclass
class Entry:
    """A finding, and what belongs to it as iterators to be used up in this order."""

    finding: Row
    lines: Iterator[int]
    evidence: Iterator[tuple[str, str]]
    links: Iterator[tuple[str, str]]


def entries(report: Report) -> Iterator[Entry]:
    """Every finding in canonical order with its lines, evidence and relationships, merged from one sorted stream of small rows.

    Each row is one finding, line, evidence record or edge, so neither a task nor the driver holds all that belongs to a finding."""
    spark = report.catalog.findings.sparkSession
    with scope() as tables:
        stream = _stream(report).toLocalIterator()
    try:
        yield from _merged(stream)
    finally:
        tables.remove(spark)


def _stream(report: Report) -> DataFrame:
    """(position, part, item, kind, text, head), sorted; ``head`` in the finding's own row only."""
    places = findings.positioned(report.catalog.findings)
    head = F.struct("reference", "category", "title", "explanation", "count_contribution", "evidence_kind", "suggested_action", _instant("ts").alias("at"), "first_line")
    keys = places.select("reference", "position")
    rows = [places.select("position", F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("item"), F.lit("").alias("kind"), F.lit("").alias("text"), head.alias("head"))]
    none = F.lit(None).cast(rows[0].schema["head"].dataType).alias("head")

    def give(df: DataFrame, part: Column, item: Column, kind: Column, text: Column) -> None:
        rows.append(df.select("position", part.alias("part"), item.cast("bigint").alias("item"), kind.alias("kind"), text.alias("text"), none))

    records = report.evidence().join(keys, "reference")
    double = records.where(F.col("kind") == "DuplicateRow")
    give(double, F.lit(1), F.col("child_order"), F.lit("line"), F.get_json_object("payload", "$.sourceLine"))
    give(places.where((F.col("category") != "DuplicateRecord") & F.col("first_line").isNotNull()), F.lit(1), F.col("first_line"), F.lit("line"), F.col("first_line").cast("string"))
    later = F.col("kind").isin("DuplicateRow", "MalformedSkippedCheck")
    give(records, F.when(F.col("child_order") < 0, 2).when(later, 4).otherwise(3), F.col("child_order"), F.col("kind"), F.col("payload"))
    edges = report.catalog.edges.select(F.col("owner").alias("reference"), F.col("kind").alias("link"), "target").distinct().join(keys, "reference")
    give(edges, F.lit(5), F.lit(0), F.col("link"), F.col("target"))
    return reduce(DataFrame.unionByName, rows).orderBy("position", "part", "item", "kind", "text")


def _merged(stream: Iterator[Row]) -> Iterator[Entry]:
    ahead = next(stream, None)

    def parts(position: int, first: int, last: int) -> Iterator[Row]:
        nonlocal ahead
        while ahead is not None and ahead["position"] == position and first <= ahead["part"] <= last:
            row, ahead = ahead, next(stream, None)
            yield row

    while ahead is not None:
        row, ahead = ahead, next(stream, None)
        at = row["position"]
        yield Entry(row["head"], (int(r["text"]) for r in parts(at, 1, 1)), ((r["kind"], r["text"]) for r in parts(at, 2, 4)), ((r["kind"], r["text"]) for r in parts(at, 5, 5)))
        for _ in parts(at, 1, 5):  # what wasn't used
            pass


def text_v1(report: Report, verbose: bool = False) -> Iterator[str]:
    """Six counts, and the findings if asked for and there are any."""
    for label, n in zip(LABELS, _counts(report), strict=True):
        yield f"{label}: {n}"
    if verbose and not report.clean:
        yield ""
        yield "Findings:"
        for r in _ordered(report).select("category", _instant("ts").alias("at"), "first_line", "explanation").toLocalIterator():
            yield f"{r['category']}: timestamp={r['at'] or 'n/a'}; line={r['first_line'] if r['first_line'] is not None else 'n/a'}; {r['explanation']}"


def json_v1(report: Report) -> Iterator[str]:
    p = report.prepared
    span = None if p.first_ts is None else {"from": utc(p.first_ts, True), "to": utc(p.last_ts, True)}
    head = {"sourceFile": p.identity.file_name, "detectedTimeframe": str(report.timeframe), "totalRecords": p.accepted, "dateRange": span, "summary": dict(zip(_KEYS, _counts(report), strict=True)), "isClean": report.clean}
    yield json.dumps(head)[:-1] + ', "findings": ['
    rows = _ordered(report).select("category", _instant("ts", millis=True).alias("at"), "first_line", "explanation").toLocalIterator()
    for i, r in enumerate(rows):
        yield ("," if i else "") + json.dumps({"category": r["category"], "timestamp": r["at"], "line": r["first_line"], "message": r["explanation"]})
    yield "]}"


def context(report: Report) -> dict:
    p = report.prepared
    o = p.options
    stamp = {"mode": "Combined", "timestampFormat": o.timestamp_format or "auto", "timestampColumn": p.layout.column or "Timestamp"} if p.layout.combined else {"mode": "SeparateDateTime", "dateFormat": o.date_format or "yyyy.MM.dd", "timeFormat": o.time_format or "HH:mm or HH:mm:ss"}
    span = None if p.first_ts is None else {"from": utc(p.first_ts), "to": utc(p.last_ts)}
    return {"timeframe": str(report.timeframe), "calendar": {"profile": report.profile, "name": report.profile.capitalize()}, "timestamp": stamp | {"sourceOffset": o.tz_offset}, "delimiter": p.delimiter, "hasHeader": o.has_header, "dateRange": span}


class Raw(float):
    """A number that JSON shows as it is written here, such as 0.50."""

    def __new__(cls, text: str):
        made = super().__new__(cls, text)
        made.text = text
        return made

    def __repr__(self) -> str:
        return self.text


def _raw(value: Fraction | None, digits: int = 2) -> Raw | None:
    return None if value is None else Raw(scoring.shown(value, digits))


def _given(**fields: object) -> dict:
    """What applies."""
    return {k: v for k, v in fields.items() if v is not None}


def _excluded(m: scoring.MetricScore) -> str | None:
    return None if m.state == scoring.SCORED else "no expected sequence" if m.population is None else "the population is zero"


def _score_json(report: Report) -> dict:
    """The names of the contract's scoring section."""
    score, names = report.score, dict(zip(scoring.METRICS, findings.NAMES, strict=True))
    kinds = {"expected_candles": "ExpectedCandles", "accepted_rows": "AcceptedRows", "examined_rows": "ExaminedRows"}
    metrics, weights, out = [], [], []
    for m in score.metrics:
        weight, share, why = Raw(weight_text(m.weight)), _raw(m.share), _excluded(m)
        base = {"category": names[m.metric], "state": m.state, "count": m.count, "populationKind": kinds[scoring.POPULATIONS[m.metric]]}
        metrics.append(base | _given(population=m.population, score=_raw(m.score), reason=why, weight=weight, normalisedShare=share))
        weights.append({"category": names[m.metric], "weight": weight} | _given(normalisedShare=share))
        if why:
            out.append({"category": names[m.metric], "state": m.state, "reason": why})
    covered = [names[m.metric] for m in score.metrics if m.state == scoring.SCORED]
    missing = None if score.average is not None else "no scored metric has a weight"
    dataset = {"available": score.average is not None} | _given(average=_raw(score.average)) | {"metricsCovered": len(covered), "coveredCategories": covered, "excludedMetrics": out} | _given(unavailableReason=missing)
    return {
        "scale": {"minimum": 0, "maximum": 100, "higherIsBetter": True, "decimalPlaces": 2},
        "metrics": metrics,
        "weighting": {"source": "Explicit" if report.weights else "Default", "weights": weights},
        "dataset": dataset,
    }


def json_v2(report: Report, compared: Comparison | None = None) -> Iterator[str]:
    """The full report, each finding with its evidence and relationships, written as the rows come."""
    p = report.prepared
    head = {
        "contractVersion": 2,
        "status": "CompletedClean" if report.clean else "CompletedWithFindings",
        "findingSetComplete": True,
        "source": {"fileName": p.identity.file_name, "byteSize": p.identity.byte_size, "sha256": p.identity.sha256},
        "context": context(report),
        "coverage": {"physicalRowsExamined": p.examined, "acceptedRows": p.accepted, "malformedRows": p.rejected},
        "checks": [{"check": c, "status": s} | ({} if s == COMPLETED else {"reason": why}) for c, (s, why) in report.checks.items()],
        "summary": dict(zip(_KEYS, _counts(report), strict=True)),
        "reconciliation": {"coverageReconciled": report.coverage_reconciled, "categories": [{"category": c, "summaryCount": report.counts[c], "entryCount": report.entries[c], "contributionSum": report.contributions[c]} for c in findings.NAMES]},
    }
    yield json.dumps(head)[:-1] + ', "findings": ['
    text = lambda x: json.dumps(x, ensure_ascii=False)
    for i, e in enumerate(entries(report)):
        f = e.finding
        fixed = {"reference": f["reference"], "category": f["category"], "title": f["title"], "explanation": f["explanation"], "countContribution": f["count_contribution"]}
        yield ("," if i else "") + text(fixed)[:-1] + ', "location": {"sourceLines": ['
        for n, line in enumerate(e.lines):
            yield f"{',' if n else ''}{line}"
        yield "]" + ("" if f["at"] is None else f', "timestampUtc": "{f["at"]}"') + '}, "evidence": {"kind": ' + text(f["evidence_kind"])
        left, current, n = list(findings.LISTS_OF.get(f["category"], ())), None, 0
        for kind, payload in e.evidence:
            name = findings.LISTS.get(kind)
            if name is None:  # the evidence's own fields
                yield "" if payload == "{}" else ", " + payload[1:-1]
                continue
            while current != name:
                yield ("]" if current else "") + f', "{left[0]}": ['
                current, n = left.pop(0), 0
            yield ("," if n else "") + payload
            n += 1
        while left:
            yield ("]" if current else "") + f', "{left[0]}": ['
            current = left.pop(0)
        yield ("]" if current else "") + '}, "relationships": ['
        for n, (kind, target) in enumerate(e.links):
            yield ("," if n else "") + text({"kind": kind, "targetReference": target})
        yield '], "suggestedAction": ' + text(f["suggested_action"]) + "}"
    yield "]"
    if report.score:
        yield ', "scoring": ' + json.dumps(_score_json(report))
    if compared:
        yield ', "benchmarkComparison": '
        yield from comparison_json(compared)
    yield "}"


def weight_text(weight: Fraction) -> str:
    """The shortest decimal form."""
    text = scoring.shown(weight, scoring.WEIGHT_DIGITS)
    return text.rstrip("0").rstrip(".")


def scoring_section(score: scoring.DatasetScore) -> Iterator[str]:
    yield "Scoring:"
    out = []
    for label, m in zip(LABELS, score.metrics, strict=True):
        if m.state == scoring.SCORED:
            share = "" if m.share is None else f"; share={scoring.shown(m.share)}"
            yield f"- {label}: {scoring.shown(m.score)} (count={m.count}; population={m.population} {KINDS[scoring.POPULATIONS[m.metric]]}; weight={weight_text(m.weight)}{share})"
        else:
            out.append(label)
            yield f"- {label}: {'not applicable' if m.state == scoring.NOT_APPLICABLE else 'not scored'} (reason: {'no expected sequence' if m.population is None else 'the population is zero'})"
    if score.average is None:
        yield "Dataset average: not available (reason: no scored metric has a weight)"
    else:
        rest = f"; excluded: {', '.join(out)}" if out else ""
        yield f"Dataset average: {scoring.shown(score.average)} (covers {len(LABELS) - len(out)} of 6 metrics{rest})"


def verbose_text(report: Report) -> Iterator[str]:
    """Counts, scores, status, source, context, coverage, checks, reconciliation, then every finding with its evidence."""
    p = report.prepared
    yield from text_v1(report)
    yield ""
    if report.score:
        yield from scoring_section(report.score)
        yield ""
    yield f"Status: {'CompletedClean' if report.clean else 'CompletedWithFindings'}"
    yield f"Source: {quoted(p.identity.file_name)} ({p.identity.byte_size} bytes, sha256={p.identity.sha256})"
    yield f"Context: {json.dumps(context(report))}"
    yield f"Coverage: examined={p.examined}; accepted={p.accepted}; malformed={p.rejected}"
    for check, (state, why) in report.checks.items():
        yield f"Check {check}: {state}" + (f" (reason: {why})" if why else "")
    for c in findings.NAMES:
        yield f"Reconciliation {c}: summary={report.counts[c]}; entries={report.entries[c]}; contributions={report.contributions[c]}"
    for e in entries(report):
        f = e.finding
        yield ""
        yield f"[{f['reference']}] {f['category']}: {f['title']}"
        yield f"  {f['explanation']} count={f['count_contribution']}; timestamp={f['at'] or 'n/a'}"
        n = 0
        for n, line in enumerate(e.lines, 1):  # one line of text each, as there may be any number
            yield f"  sourceLine={line}"
        if not n:
            yield "  sourceLine=n/a"
        for kind, payload in e.evidence:
            yield f"  evidence: {evidence_line(kind, json.loads(payload))}"
        for kind, target in e.links:
            yield f"  relationship: kind={kind}; target={target}"
        yield f"  Action: {f['suggested_action']}"


#: The label before a record, and the fields of each kind in order, those in quotes marked.
_LABELS = {"TimeGapMissingReference": "missingCandleReference", "DuplicateDifferingField": "differingField", "InvalidOhlcViolation": "violation", "MalformedSkippedCheck": "checkNotApplied"}
_BRACKETS = ["previousObservedTimestampUtc", "nextObservedTimestampUtc", "previousObservedSourceLine", "nextObservedSourceLine"]
_PRICES = ["open", "high", "low", "close", "volume"]
_RECORDS = {
    "MissingCandle": ("", ["expectedTimestampUtc", "expectedTimeframe", "timeGapReference", *_BRACKETS]),
    "TimeGap": ("", ["firstMissingTimestampUtc", "lastMissingTimestampUtc", "expectedTimeframe", "missingCandleCount", "elapsedSeconds", *_BRACKETS]),
    "DuplicateRecord": ("", ["sharedTimestampUtc", "classification"]),
    "DuplicateRow": ("row: ", ["sourceLine", "originalTimestampText*", *_PRICES]),
    "InvalidOhlc": ("observed: ", _PRICES),
    "ClosedMarketRecord": ("", ["marketProfile*", "calendarName*", "calendarTimeZone*", "closedRule*", "closedFromUtc", "nextOpenUtc"]),
    "MalformedRow": ("", ["parsedTimestampUtc", "originalTimestampText*", "expectedSlotReserved"]),
    "MalformedFieldError": ("fieldError: ", ["field*", "originalValue*", "reasonCode", "reason*"]),
}


def evidence_line(kind: str, payload: object) -> str:
    """One evidence record as text; what doesn't apply is n/a."""
    if kind in _LABELS:
        return f"{_LABELS[kind]}={quoted(payload) if kind == 'DuplicateDifferingField' else payload}"
    label, names = _RECORDS[kind]
    fields = payload.get("observed", payload)

    def shown(name: str) -> str:
        value = fields.get(name.rstrip("*"))
        return "n/a" if value is None else quoted(value) if name.endswith("*") else str(value).lower() if isinstance(value, bool) else str(value)

    return label + "; ".join(f"{n.rstrip('*')}={shown(n)}" for n in names)


def fatal_json(error: Fatal, source: dict | None = None) -> str:
    body = {"contractVersion": 2, "status": "Fatal", "findingSetComplete": False, "code": error.code, "failureClass": error.failure_class, "stage": error.stage, "reason": error.reason, "guidance": error.guidance}
    if source:
        body["source"] = source
    body["checks"] = [{"check": m, "status": "NotCompleted", "reason": error.reason} for m in scoring.METRICS]
    return json.dumps(body)


class Comparison:
    """A finished comparison: small totals, and the discrepancies as a DataFrame."""

    def __init__(self, snapshot, benchmark: DataFrame, candidate: Report, instrument: str, overrides: list[comparison.Tolerance] | None = None):
        if snapshot.timeframe != str(candidate.timeframe):
            raise Fatal("INVALID_ARGUMENT", f"The benchmark's timeframe is {snapshot.timeframe}, the candidate's {candidate.timeframe}.")
        if snapshot.instrument.lower() != instrument.lower():
            raise Fatal("INVALID_ARGUMENT", f"The benchmark's instrument is {snapshot.instrument}, the candidate's {instrument}.")
        rows = candidate.prepared.candles
        for side, name in ((benchmark, "benchmark"), (rows, "candidate")):
            if comparison.repeated_instants(side).limit(1).count():
                raise Fatal("INVALID_STRUCTURE", f"The {name} has several records at one timestamp.")
        self.snapshot, self.candidate, self.instrument = snapshot, candidate, instrument
        step = comparison.fractional_step(benchmark).first()["step"] if benchmark.limit(1).count() else None
        self.tolerances = comparison.resolve(overrides, step)
        self.pairs = comparison.aligned(benchmark, rows)
        decisions = comparison.field_decisions(self.pairs, self.tolerances)
        self.coverage = comparison.coverage(self.pairs).first().asDict()  # one row
        self.tolerated = {r["field"]: r.asDict() for r in comparison.tolerated(decisions).collect()}  # five rows
        self.discrepancies = comparison.discrepancies(decisions).orderBy("ts", "field", F.desc("difference"))
        made_of = comparison.agreement(self.pairs, decisions).first()  # one row
        self.matched, self.material_instants = made_of["matched"], made_of["material_instants"]
        self.score = comparison.agreement_score(self.matched, self.material_instants)
        self.warnings = self._warnings()

    def _warnings(self) -> list[str]:
        s, p = self.snapshot, self.candidate.prepared
        pairs = [("calendar", s.profile, self.candidate.profile), ("source offset", s.options["tz_offset"], p.options.tz_offset), ("header", s.options["has_header"], p.options.has_header), ("timestamp format", s.options["timestamp_format"], p.options.timestamp_format)]
        mode = lambda o: "separate date and time" if not (o["timestamp_format"] or o["timestamp_column"]) else "combined"
        pairs.append(("timestamp mode", mode(s.options), mode(vars(p.options))))
        span = lambda side: self.pairs.where(F.col(side).isNotNull()).agg(F.min("ts").alias("a"), F.max("ts").alias("z")).first()
        ranges = [f"{utc(r['a'])} to {utc(r['z'])}" if r["a"] else "none" for r in (span("b"), span("c"))]
        pairs.append(("date range", *ranges))
        return [f"The {what} differs: {a} and {b}." for what, a, b in pairs if a != b]


def _share(part: int, whole: int) -> str | None:
    """A quotient as decimal text of up to 28 digits, or null."""
    return format(Context(prec=28).divide(Decimal(part), Decimal(whole)), "f") if whole else None


def _records(c: Comparison, status: str, side: str, key: str) -> Iterator[dict]:
    rows = c.pairs.where(F.col("status") == status).select("ts", _instant("ts").alias("at"), F.col(f"{side}.source_line").alias("line")).orderBy("ts")
    return ({"timestampUtc": r["at"]} | _given(**{key: r["line"]}) for r in rows.toLocalIterator())


def comparison_json(c: Comparison) -> Iterator[str]:
    """The comparison's section, written as the rows come. Its names."""
    k, p = c.coverage, c.candidate.prepared
    bench, cand = k["matched"] + k["missing"], k["matched"] + k["extra"]
    span = None if k["overlap_start"] is None else {"start": utc(k["overlap_start"]), "end": utc(k["overlap_end"])}
    tolerances = {t.field: t for t in c.tolerances}
    head = {
        "contractVersion": 1,
        "benchmark": {"name": c.snapshot.name, "instrument": c.snapshot.instrument, "source": c.snapshot.source},
        "candidateIdentity": {"instrument": c.instrument, "source": {"fileName": p.identity.file_name, "byteSize": p.identity.byte_size, "sha256": p.identity.sha256}, "context": context(c.candidate)},
        "configuration": {"tolerances": [{"field": t.field, "enabled": t.enabled, "absolute": f"{t.absolute:f}", "relative": f"{t.relative:f}"} for t in c.tolerances]},
        "comparisonCoverage": {
            "benchmarkRecordCount": bench, "candidateRecordCount": cand, "matchedCount": k["matched"], "missingFromCandidateCount": k["missing"], "extraInCandidateCount": k["extra"],
            "matchedBenchmarkRate": _share(k["matched"], bench), "missingBenchmarkRate": _share(k["missing"], bench), "matchedCandidateRate": _share(k["matched"], cand), "extraCandidateRate": _share(k["extra"], cand),
        } | _given(overlappingRange=span),
    }
    yield json.dumps(head)[:-1]
    missing, extra = (comparison.MISSING, "b", "benchmarkSourceLine"), (comparison.EXTRA, "c", "candidateSourceLine")
    for name, (status, side, key), bare in (("missingFromCandidateTimestamps", missing, True), ("extraInCandidateTimestamps", extra, True), ("missingFromCandidateRecords", missing, False), ("extraInCandidateRecords", extra, False)):
        yield f', "{name}": ['
        for i, r in enumerate(_records(c, status, side, key)):
            yield ("," if i else "") + json.dumps(r["timestampUtc"] if bare else r)
        yield "]"
    yield ', "contextWarnings": ' + json.dumps(c.warnings) + ', "materialDiscrepancies": ['
    for i, r in enumerate(c.discrepancies.toLocalIterator()):
        t = tolerances[r["field"]]
        row = {"timestampUtc": utc(r["ts"]), "field": r["field"], "benchmarkValue": f"{r['benchmark_value']:f}", "candidateValue": f"{r['candidate_value']:f}", "difference": f"{r['difference']:f}", "directionalDifference": f"{r['directional_difference']:f}", "resolvedAbsoluteTolerance": f"{t.absolute:f}", "resolvedRelativeTolerance": f"{t.relative:f}", "toleranceDecision": r["decision"]}
        yield ("," if i else "") + json.dumps(row | _given(candidateSourceLine=r["candidate_line"]))
    summary = []
    for f in comparison.FIELDS:
        if t := c.tolerated.get(f):
            accepted, total = t["accepted_by_absolute"] + t["accepted_by_relative"], t["total_compared"]
            summary.append({"field": f, "totalCompared": total, "acceptedCount": accepted, "acceptedByAbsoluteCount": t["accepted_by_absolute"], "acceptedByRelativeCount": t["accepted_by_relative"], "materialCount": t["material"], "toleratedRate": _share(accepted, total), "materialRate": _share(t["material"], total)})
    exact = None if c.score is None else {"exact": f"{c.score.numerator}/{c.score.denominator}", "rounded": scoring.shown(c.score)}
    agreement = {"score": exact, "formula": AGREEMENT_FORMULA, "matchedPopulation": c.matched, "materialDiscrepancyTimestamps": c.material_instants} | _given(unavailableReason=None if c.matched else "No overlapping timestamps.")
    yield '], "toleratedSummary": ' + json.dumps(summary) + ', "agreementScore": ' + json.dumps(agreement)
    yield ', "candidateScore": ' + json.dumps(_score_json(c.candidate) if c.candidate.score else None) + "}"


#: Fixed value: how the agreement is computed.
AGREEMENT_FORMULA = "100 × (matchedPopulation - materialDiscrepancyTimestamps) / matchedPopulation"


def rate(part: int, whole: int) -> str:
    return f"{scoring.shown(Fraction(100 * part, whole))}%" if whole else "n/a"


def comparison_text(c: Comparison) -> Iterator[str]:
    k = c.coverage
    bench, cand = k["matched"] + k["missing"], k["matched"] + k["extra"]
    yield "=== BENCHMARK COMPARISON ==="
    yield ""
    yield f"Benchmark: {c.snapshot.name}"
    yield f"  Instrument: {c.snapshot.instrument}"
    yield f"  Source: {c.snapshot.source['file_name']} ({c.snapshot.source['byte_size']:,} bytes, sha256={c.snapshot.source['sha256'][:16]}...)"
    yield f"  Dataset Average: {c.snapshot.average['rounded']}"
    yield ""
    yield f"Candidate: {c.candidate.prepared.identity.file_name}"
    yield f"  Instrument: {c.instrument}"
    yield ""
    yield "Coverage:"
    yield f"  Benchmark records: {bench:,}"
    yield f"  Candidate records: {cand:,}"
    yield f"  Matched timestamps: {k['matched']:,}"
    yield f"  Missing from candidate: {k['missing']:,}"
    yield f"  Extra in candidate: {k['extra']:,}"
    yield f"  Coverage rate: {rate(k['matched'], bench)} of benchmark timestamps matched"
    yield f"  Candidate coverage: {rate(k['matched'], cand)} of candidate timestamps matched"
    yield ""
    for status, title, side in ((comparison.MISSING, "Missing Candidate Records:", "b"), (comparison.EXTRA, "Extra Candidate Records:", "c")):
        rows = c.pairs.where(F.col("status") == status).select(_instant("ts").alias("at"), F.col(f"{side}.source_line").alias("line")).orderBy("at")
        for i, r in enumerate(rows.toLocalIterator()):
            if not i:
                yield title
            yield f"  {r['at']} ({'benchmark' if side == 'b' else 'candidate'} line {r['line']})"
    for i, w in enumerate(c.warnings):
        if not i:
            yield "Warnings:"
        yield f"  - {w}"
    if not c.matched:
        yield "Comparison: UNAVAILABLE — no overlapping timestamps between benchmark and candidate."
        yield "A benchmark-agreement score cannot be computed."
    else:
        n = sum(t["material"] for t in c.tolerated.values())
        yield f"Material Discrepancies ({n} found):"
        for i, r in enumerate(c.discrepancies.toLocalIterator(), 1):
            yield f"  {i}. {utc(r['ts'])} {r['field']}: benchmark={r['benchmark_value']:f}; candidate={r['candidate_value']:f}; difference={r['difference']:f}; line={r['candidate_line']}"
    yield "Tolerated Differences:"
    for f in comparison.FIELDS:
        if t := c.tolerated.get(f):
            accepted = t["accepted_by_absolute"] + t["accepted_by_relative"]
            yield f"  {f}: {accepted:,} tolerated ({rate(accepted, t['total_compared'])}); {t['material']:,} material ({rate(t['material'], t['total_compared'])}); denominator={t['total_compared']:,}"
    yield f"Matched: {k['matched']:,} | Missing: {k['missing']:,} | Extra: {k['extra']:,}"
    if c.score is None:
        yield "Benchmark-Agreement Score: UNAVAILABLE"
        yield "  Reason: No overlapping timestamps."
    else:
        yield f"Benchmark-Agreement Score: {scoring.shown(c.score)} ({c.material_instants}/{c.matched:,} timestamps with material discrepancies)"


@contextmanager
def staged(destination: str, source: str | None = None) -> Iterator[TextIO]:
    """A file that appears at ``destination`` only when all of it is written; it may not be the source."""
    if source and os.path.realpath(destination) == os.path.realpath(source):
        raise Fatal("INVALID_ARGUMENT", "The report would overwrite the source.")
    folder = os.path.dirname(os.path.abspath(destination))
    try:
        handle, name = tempfile.mkstemp(dir=folder, suffix=".part")
    except OSError as e:
        raise Fatal("REPORT_COMMIT_FAILED", "The report's folder can't be written.") from e
    try:
        with os.fdopen(handle, "w", encoding="utf-8", newline="\n") as f:
            yield f
        os.replace(name, destination)
    except BaseException:
        with suppress(OSError):
            os.unlink(name)
        raise


def write_lines(lines: Iterable[str], out: TextIO, newline: str = "\n") -> None:
    for line in lines:
        out.write(line + newline)
