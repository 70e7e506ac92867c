"""Files, checks, scores, reports, benchmarks, the command line and the run API on small files with known results."""

from __future__ import annotations

import datetime as dt
import io
import json
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tickloom import cli, service
from tickloom.functions.numbers import parse_decimal
from tickloom.operators import calendars, checks, comparison, findings, scoring
from tickloom.sinks import reports
from tickloom.sources import benchmark_store, calendar_json, csv_scan
from tickloom.sources.csv_scan import CsvOptions, ScanError
from tickloom.validation import Fatal, Timeframe, validate, verify_edges

def candle_lines(start: str, hours: list[int], base: float = 80.0, every: int = 1) -> list[str]:
    """One line of text an hour given, of prices that rise by a tenth an hour; the day begins at midnight in the file's zone."""
    day = dt.datetime.fromisoformat(start)
    out = []
    for h in hours:
        at, low = day + dt.timedelta(hours=h * every), base + h / 10
        out.append(f"{at:%Y.%m.%d},{at:%H:%M},{low + 0.3:.2f},{low + 0.8:.2f},{low:.2f},{low + 0.5:.2f},{500 + h}")
    return out


def text_of(lines: list[str]) -> str:
    return "\n".join(lines) + "\n"


def with_field(line: str, at: int, value: str) -> str:
    fields = line.split(",")
    fields[at] = value
    return ",".join(fields)


# A Wednesday of six hours; the same with a doubled, a broken and two absent hours; and one with an unreadable line.
CLEAN = text_of(candle_lines("2027-03-10", list(range(6))))
_SIX = candle_lines("2027-03-10", [0, 0, 2, 3, 5, 6])
_SIX[1] = with_field(_SIX[1], 6, "7")  # the first hour twice, of another volume
_SIX[3] = with_field(_SIX[3], 4, "99.00")  # a low above everything
DEFECTS = text_of(_SIX)
_SEVEN = candle_lines("2027-03-10", [1, 2, 2, 3, 6])
_SEVEN[3] = with_field(_SEVEN[3], 3, "1.00")  # a high below everything
SCORED = text_of([*_SEVEN, "2027.03.10,when,is,it,no,number,here"])
CALENDAR = '{"version":1,"name":"Wednesday","timeZone":"UTC","sessions":[{"openDay":"Wednesday","openTime":"09:00","closeDay":"Wednesday","closeTime":"17:00"}]}'


@pytest.fixture
def write(tmp_path):
    def make(text: str, name: str = "prices.csv") -> str:
        (tmp_path / name).write_text(text, encoding="utf-8")
        return str(tmp_path / name)

    return make


def six(report) -> list[int]:
    return [report.counts[c] for c in findings.NAMES]


def test_known_counts(spark, write):
    assert six(validate(spark, write(CLEAN), CsvOptions())) == [0] * 6
    report = validate(spark, write(DEFECTS), CsvOptions(), timeframe="H1")
    assert six(report) == [2, 1, 1, 0, 2, 0]
    verify_edges(report)
    lines = list(reports.text_v1(report))
    assert lines == ["Missing candles: 2", "Duplicate records: 1", "Invalid OHLC: 1", "Closed-market records: 0", "Time gaps: 2", "Malformed rows: 0"]
    head = "Timestamp;Open;High;Low;Close;Volume\n2026-01-01 00:00:00;1.1;1.2;1.0;1.1;10\n2026-01-01T01:00:00Z;1.1;1.2;1.0;1.1;10\n"
    assert six(validate(spark, write(head), CsvOptions(has_header=True))) == [0] * 6


def test_score(spark, write):
    report = validate(spark, write(SCORED), CsvOptions(tz_offset="+00:00"), timeframe="H1", score=True)
    assert six(report) == [2, 1, 1, 0, 1, 1]
    assert [scoring.shown(m.score) for m in report.score.metrics] == ["66.67", "80.00", "80.00", "100.00", "83.33", "83.33"]
    assert scoring.shown(report.score.average) == "82.22" and {scoring.shown(m.share) for m in report.score.metrics} == {"0.17"}
    one = validate(spark, write(SCORED.split("\n")[0] + "\n"), CsvOptions(tz_offset="+00:00"), timeframe="H1", score=True)
    assert scoring.shown(one.score.average) == "100.00" and [m.state for m in one.score.metrics].count(scoring.SCORED) == 4
    section = list(reports.scoring_section(one.score))
    assert section[-1].startswith("Dataset average: 100.00 (covers 4 of 6 metrics; excluded: Missing candles, Time gaps)")


def test_malformed_row_holds_its_slot(spark, write):
    text = "2026.01.05,00:00,1,2,0.5,1,1\n2026.01.05,01:00,x,2,0.5,1,1\n2026.01.05,03:00,1,2,0.5,1,1\n"
    report = validate(spark, write(text), CsvOptions(tz_offset="+00:00"), timeframe="H1")
    assert six(report) == [1, 0, 0, 0, 1, 1]
    gap = report.catalog.sequence.gaps.first()
    assert gap["previous_line"] == 2 and gap["next_line"] == 3 and gap["missing_count"] == 1 and gap["elapsed_seconds"] == 3600


def test_closed_time_splits_a_gap(spark, write):
    # Friday 21:00 to Monday 00:00 UTC; closed from Friday 22:00 to Sunday 22:00.
    text = "2026.01.09,19:00,1,2,0.5,1,1\n2026.01.12,00:00,1,2,0.5,1,1\n"
    report = validate(spark, write(text), CsvOptions(tz_offset="+00:00"), timeframe="H1")
    assert six(report) == [4, 0, 0, 0, 2, 0] and report.expected == 6


def test_reports_agree(spark, write):
    report = validate(spark, write(DEFECTS), CsvOptions(), timeframe="H1", score=True)
    data = json.loads("".join(reports.json_v2(report)))
    assert data["summary"] == {"missingCandles": 2, "duplicateRecords": 1, "invalidOhlc": 1, "closedMarketRecords": 0, "timeGaps": 2, "malformedRows": 0}
    assert [f["category"] for f in data["findings"]] == ["MissingCandle", "MissingCandle", "DuplicateRecord", "InvalidOhlc", "TimeGap", "TimeGap"]
    known = {f["reference"] for f in data["findings"]}
    assert all(r["targetReference"] in known for f in data["findings"] for r in f["relationships"])
    double = data["findings"][2]
    assert double["location"]["sourceLines"] == [1, 2] and double["reference"] == "duplicate-record:20270309T2200000000000Z:line-1"
    assert double["evidence"]["differingFields"] == ["Volume"] and [r["volume"] for r in double["evidence"]["rows"]] == [500, 7]
    assert set(double["evidence"]) == {"kind", "sharedTimestampUtc", "classification", "differingFields", "rows"}
    missing, broken, gap = data["findings"][0]["evidence"], data["findings"][3]["evidence"], data["findings"][4]["evidence"]
    assert missing["expectedTimestampUtc"] == "2027-03-09T23:00:00Z" and (missing["previousObservedSourceLine"], missing["nextObservedSourceLine"]) == (2, 3)
    assert broken["violations"] == ["HIGH_BELOW_LOW", "LOW_ABOVE_OPEN", "LOW_ABOVE_CLOSE"] and broken["observed"]["low"] == 99
    assert gap["missingCandleReferences"] == ["missing-candle:20270309T2300000000000Z"] and gap["elapsedSeconds"] == 3600
    score = data["scoring"]
    assert score["dataset"]["average"] == float(scoring.shown(report.score.average)) and score["metrics"][0]["normalisedShare"] == 0.17
    assert score["weighting"]["source"] == "Default" and score["scale"]["maximum"] == 100
    assert all(c["summaryCount"] == c["contributionSum"] for c in data["reconciliation"]["categories"]) and data["reconciliation"]["coverageReconciled"]
    first = json.loads("".join(reports.json_v1(report)))
    assert first["totalRecords"] == 6 and len(first["findings"]) == 6 and first["dateRange"]["from"] == "2027-03-09T22:00:00.000Z"
    lines = list(reports.verbose_text(report))
    assert sum(line.startswith("[") for line in lines) == 6
    assert "  evidence: row: sourceLine=2; originalTimestampText=n/a; open=80.30000000; high=80.80000000; low=80.00000000; close=80.50000000; volume=7.00000000" in lines or any(x.startswith("  evidence: row: sourceLine=2; originalTimestampText=n/a; open=80.3") for x in lines)


def test_fractions_and_zones(spark, write):
    text = "Timestamp,Open,High,Low,Close,Volume\n2027-03-10T09:00:00.2500000Z,1,2,0.5,1,-1\n"
    spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
    try:
        report = validate(spark, write(text), CsvOptions(has_header=True), timeframe="H1")
        assert json.loads("".join(reports.json_v1(report)))["findings"][0]["timestamp"] == "2027-03-10T09:00:00.250Z"
        made = json.loads("".join(reports.json_v2(report)))["findings"][0]
        assert made["location"] == {"sourceLines": [2], "timestampUtc": "2027-03-10T09:00:00Z"}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_large_reports_are_streamed(spark, write):
    """A gap of 20,000 candles and a group of 3,000 records: what is read at once stays small rows."""
    lines = candle_lines("2027-03-08", [0, 20_001]) + candle_lines("2027-03-08", [20_002]) * 3_000
    report = validate(spark, write(text_of(lines)), CsvOptions(), "crypto", timeframe="H1")
    assert six(report)[:2] == [20_000, 2_999]
    seen, largest, missing, rows = 0, 0, 0, 0
    for part in reports.json_v2(report):
        seen, largest = seen + 1, max(largest, len(part))
        missing += part.lstrip(",").startswith('"missing-candle:')
        rows += '"sourceLine":' in part
    assert seen > 60_000 and largest < 5_000 and missing == 20_000 and rows == 3_000


def test_records_over_lines_and_broken_files(spark, write, tmp_path):
    text = 'Date,Time,Open,High,Low,Close,Volume,Note\n2027.03.10,01:00,1,2,0.5,1,1,"two\nlines"\n2027.03.10,02:00,1,2,0.5,1,1,x\n'
    made = csv_scan.scan(spark, write(text), CsvOptions(has_header=True))
    assert [r["source_line"] for r in made.candles.orderBy("ts").collect()] == [2, 4]
    for size in (7, 30, 64):
        got = [(r["source_line"], r["text"]) for r in csv_scan.numbered_lines(spark, write(text), size).orderBy("source_line").collect()]
        assert [n for n, _ in got] == [1, 2, 4] and got[1][1].endswith('"two\nlines"')
    for broken, code in ((text + '2027.03.10,03:00,1,2,0.5,1,1,"open\n', "INVALID_CSV"), (text + '2027.03.10,03:00,1,2,0.5,1,1,a"b"\n', "INVALID_CSV")):
        with pytest.raises(ScanError) as e:
            csv_scan.scan(spark, write(broken), CsvOptions(has_header=True))
        assert e.value.code == code
    (tmp_path / "latin.csv").write_bytes("2027.03.10,01:00,1,2,0.5,1,1,é\n".encode("latin-1"))
    with pytest.raises(ScanError) as e:
        csv_scan.scan(spark, str(tmp_path / "latin.csv"), CsvOptions())
    assert e.value.code == "INVALID_ENCODING"


def test_folder(spark, tmp_path):
    (tmp_path / "many").mkdir()
    for i, hours in enumerate(([0, 1], [2, 3, 3])):
        (tmp_path / "many" / f"{i}.csv").write_text(text_of(candle_lines("2027-03-10", hours)))
    report = validate(spark, str(tmp_path / "many"), CsvOptions(), timeframe="H1")
    assert report.prepared.accepted == 5 and six(report) == [0, 1, 0, 0, 0, 0] and report.prepared.identity.file_name == "many"


def test_order_of_input_does_not_matter(spark):
    rows = [(dt.datetime(2026, 1, 5, h), 1.0 + h, 2.0 + h, 0.5, 1.5, 1.0, i) for i, h in enumerate((3, 1, 1, 9, 5))]
    schema = "ts timestamp, open double, high double, low double, close double, volume double, source_line bigint"
    made = []
    for order in (rows, rows[::-1]):
        frame = spark.createDataFrame(order, schema).repartition(3)
        frame = frame.select("ts", *(F.col(f).cast("decimal(20,8)").alias(f) for f in checks.FIELDS), "source_line")
        found = findings.catalog(frame, calendars.crypto, 3600)
        made.append([tuple(r) for r in findings.positioned(found.findings).orderBy("position").collect()])
    assert made[0] == made[1] and len(made[0]) == 9  # five missing, one duplicate, three gaps


def test_two_datasets_at_once(spark):
    rows = [(k, dt.datetime(2026, 1, 5, h), 1.0, 2.0, 0.5, 1.5, 1.0, h) for k, hours in (("a", (0, 3)), ("b", (0, 1)), ("c", (7,)), (None, (1, 1))) for h in hours]
    frame = spark.createDataFrame(rows, "k string, ts timestamp, open double, high double, low double, close double, volume double, source_line bigint")
    frame = frame.select("k", "ts", *(F.col(f).cast("decimal(20,8)").alias(f) for f in checks.FIELDS), "source_line")
    seq = checks.sequence_checks(frame, calendars.crypto, 3600, by=("k",))
    assert [(r["k"], r["missing_count"]) for r in seq.gaps.collect()] == [("a", 2)]
    assert {r["k"]: r["expected_candles"] for r in seq.expected.collect()} == {"a": 4, "b": 2}
    assert checks.duplicate_groups(frame, ("k",)).count() == 1


def test_empty_file_and_header_only(spark, write):
    report = validate(spark, write("Date,Time,Open,High,Low,Close,Volume\n"), CsvOptions(has_header=True), timeframe="D1")
    assert six(report) == [0] * 6 and report.expected is None
    with pytest.raises(Fatal, match="timeframe"):
        validate(spark, write("Date,Time,Open,High,Low,Close,Volume\n"), CsvOptions(has_header=True))


def test_fatal_structures(spark, write, tmp_path):
    for text, options in (("2026.01.01,00:00,1,2\n", CsvOptions()), ("Timestamp,Open,High,Low,Volume\n", CsvOptions(has_header=True)), ("a;b,c\n", CsvOptions())):
        with pytest.raises(Fatal) as e:
            validate(spark, write(text), options, timeframe="H1")
        assert e.value.code == "INVALID_STRUCTURE"
    with pytest.raises(Fatal) as e:
        validate(spark, str(tmp_path / "none.csv"), CsvOptions())
    assert e.value.code == "SOURCE_UNAVAILABLE" and json.loads(reports.fatal_json(e.value))["failureClass"] == "Operational"
    for bad in ({"date_format": "x"}, {"tz_offset": "+15:00"}, {"timestamp_column": "T"}):
        with pytest.raises(ScanError):
            CsvOptions(**bad)


@pytest.mark.parametrize("size", [3, 7, 64, 10_000])
def test_line_numbers_across_ranges(spark, write, size):
    text = "".join(f"line {i}{'x' * (i % 5)}\n" for i in range(1, 60)) + "\n\r\nlast"
    got = {r["source_line"]: r["text"] for r in csv_scan.numbered_lines(spark, write(text), size).collect()}
    assert got == {i: t.removesuffix("\r") for i, t in enumerate(text.split("\n"), 1)}


def test_delimiters():
    assert csv_scan.detect_delimiter('"a,b";c;d') == ";" and csv_scan.detect_delimiter(" ") == ","
    assert csv_scan.parse_delimiter("Tab") == "\t" and csv_scan.parse_delimiter("|") == "|"
    for bad in ("a;b,c", "abc"):
        with pytest.raises(ScanError):
            csv_scan.detect_delimiter(bad)
    assert csv_scan.split_line('a,"b ""c"", d",', ",") == ["a", 'b "c", d', ""]


def test_numbers(spark):
    cases = {"1,234.5": "1234.50000000", " -7 ": "-7.00000000", "7-": "-7.00000000", "1e3": None, "": None, "1.123456789": None, "9" * 30: None, "+.5": "0.50000000"}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select(parse_decimal(F.col("t")).alias("n")).collect()
    assert [None if r["n"] is None else f"{r['n']:f}" for r in rows] == list(cases.values())


def test_calendars(spark):
    stamps = {"2026-03-06 14:29": 0, "2026-03-06 14:30": 1, "2026-03-06 20:59": 1, "2026-03-06 21:00": 0, "2026-03-09 13:29": 0, "2026-03-09 13:30": 1, "2026-03-09 19:59": 1, "2026-03-09 20:00": 0}
    rows = spark.createDataFrame([(dt.datetime.fromisoformat(t),) for t in stamps], "ts timestamp")
    assert [int(r[0]) for r in rows.select(checks.is_open(calendars.equities)).collect()] == list(stamps.values())
    custom = calendar_json.read_calendar(CALENDAR)
    rows = spark.createDataFrame([(dt.datetime(2026, 2, 4, h),) for h in (8, 9, 10, 17)], "ts timestamp")
    assert [r[0] for r in rows.select(checks.is_open(custom)).collect()] == [False, True, True, False]
    good = json.loads(CALENDAR)
    for change in ({"version": 2}, {"extra": 1}, {"sessions": []}, {"name": ""}, {"timeZone": "Mars"}, {"sessions": good["sessions"] * 2}):
        with pytest.raises(calendar_json.CalendarError):
            calendar_json.read_calendar(json.dumps(good | change))
    skipped = dict(good["sessions"][0], openDay="Sunday", openTime="02:30", closeDay="Sunday", closeTime="12:00")
    with pytest.raises(calendar_json.CalendarError, match="skipped or repeated"):
        calendar_json.read_calendar(json.dumps(good | {"timeZone": "America/New_York", "sessions": [skipped]}))
    for profile, given in (("custom", None), ("forex", custom), ("moon", None)):
        with pytest.raises(ValueError):
            calendars.calendar_for(profile, given)


def test_timeframes(spark):
    assert Timeframe.parse("m15").seconds == 900 and str(Timeframe.parse(" D1 ")) == "D1"
    for bad in ("W1", "H0", "15"):
        with pytest.raises(Fatal):
            Timeframe.parse(bad)
    counts = spark.createDataFrame([(60_000_000, 3), (120_000_000, 3)], "delta_us bigint, n bigint")
    assert checks.detected_timeframe(counts).first()["timeframe"] is None
    for us, text in ((5_400_000_000, "M90"), (86_400_000_000, "D1"), (7_200_000_000, "H2"), (30_000_000, None)):
        counts = spark.createDataFrame([(us, 3), (1, 1)], "delta_us bigint, n bigint")
        assert checks.detected_timeframe(counts).first()["timeframe"] == text
    assert checks.detected_timeframe(counts.limit(0)).first()["timeframe"] is None


def test_scores_and_weights():
    assert scoring.shown(Fraction(1, 3)) == "0.33" and scoring.shown(Fraction(-83335, 1000)) == "-83.34" and scoring.shown(Fraction(83335, 1000)) == "83.34"
    names = scoring.METRICS
    weights = scoring.parse_weights(",".join(f"{n}={i}.5" for i, n in enumerate(names)))
    assert weights["MalformedRows"] == Fraction(11, 2) and reports.weight_text(weights["MalformedRows"]) == "5.5"
    for bad in ("MissingCandles=1", ",".join(f"{n}=0" for n in names), ",".join(f"{n}=-1" for n in names), ",".join(f"{n}=1e1" for n in names)):
        with pytest.raises(ValueError):
            scoring.parse_weights(bad)
    with pytest.raises(scoring.ReconciliationError):
        scoring.metric_score(3, 2)
    none = scoring.dataset_score(dict.fromkeys(names, 0), {"expected_candles": None, "accepted_rows": 0, "examined_rows": 0})
    assert none.average is None and {m.state for m in none.metrics} == {scoring.NOT_APPLICABLE, scoring.NOT_SCORED}


@pytest.mark.parametrize(
    ("b", "c", "absolute", "relative", "decision"),
    [
        ("2.5", "2.50012", "0.00012", "0", 0), ("2.5", "2.50013", "0.00012", "0", 2), ("0", "0.003", "0.002", "0.9", 2), ("7", "7", "0", "0", 0),
        ("640", "656", "0", "0.025", 1), ("640", "656.00001", "0", "0.025", 2), ("-3.2", "-3.19", "0.01", "0", 0), ("-3.2", "-3.55", "0", "0.11", 1), ("-3.2", "-3.56", "0", "0.11", 2),
    ],
)
def test_tolerances(spark, b, c, absolute, relative, decision):
    schema = "ts timestamp, open string, high string, low string, close string, volume string, source_line bigint"
    side = lambda v: spark.createDataFrame([(dt.datetime(2026, 1, 1), v, v, v, v, v, 1)], schema).select("ts", *(F.col(f).cast("decimal(20,8)").alias(f) for f in checks.FIELDS), "source_line")
    overrides = comparison.read_overrides(json.dumps([{"field": f, "absolute": float(absolute), "relative": float(relative), "enabled": f == "Open"} for f in comparison.FIELDS]))
    rows = comparison.field_decisions(comparison.aligned(side(b), side(c)), comparison.resolve(overrides)).collect()
    assert [r["decision"] for r in rows] == [(comparison.ABSOLUTE, comparison.RELATIVE, comparison.MATERIAL)[decision]]


def test_benchmarks_and_command_line(spark, write, tmp_path, capsys):
    lines = CLEAN.splitlines()
    lines[2] = with_field(lines[2], 2, "80.55")
    base, other = write(CLEAN, "base.csv"), write(text_of(lines[:-1]), "other.csv")
    folder = str(tmp_path / "marks")
    common = ["--score", "--instrument", "AAA", "--benchmark-dir", folder, "--timeframe", "H1"]
    assert cli.run(spark, [base, "--benchmark", "My Mark!", *common]) == 0
    assert benchmark_store.BenchmarkStore(spark, folder).names() == ["my-mark"]
    assert cli.run(spark, [base, "--benchmark", "my mark", *common]) == 2
    capsys.readouterr()
    assert cli.run(spark, [base, "--compare", "my-mark", *common]) == 0
    assert "Benchmark-Agreement Score: 100.00 (0/6" in capsys.readouterr().out
    report = str(tmp_path / "report.json")
    assert cli.run(spark, [other, "--compare", "my-mark", *common, "--format", "json", "--report-version", "2", "--output", report]) == 0
    made = json.loads(open(report, encoding="utf-8").read())["benchmarkComparison"]
    cover = made["comparisonCoverage"]
    assert (cover["matchedCount"], cover["missingFromCandidateCount"], cover["matchedCandidateRate"]) == (5, 1, "1") and cover["missingBenchmarkRate"].startswith("0.1666666")
    assert made["missingFromCandidateRecords"] == [{"timestampUtc": made["missingFromCandidateTimestamps"][0], "benchmarkSourceLine": 6}] and made["extraInCandidateRecords"] == []
    assert [(d["field"], d["candidateSourceLine"]) for d in made["materialDiscrepancies"]] == [("Open", 3)]
    assert made["agreementScore"]["score"] == {"exact": "80/1", "rounded": "80.00"} and any("date range" in w for w in made["contextWarnings"])
    assert cli.run(spark, [base, "--compare", "my-mark", "--score", "--instrument", "BBB", "--benchmark-dir", folder, "--timeframe", "H1"]) == 2
    (tmp_path / "marks" / "my-mark" / "source.csv").write_text("x")
    assert cli.run(spark, [base, "--compare", "my-mark", *common]) == 2
    assert cli.run(spark, ["--benchmark-delete", "my-mark", "--benchmark-dir", folder, "--yes"]) == 0
    assert cli.run(spark, ["--benchmark-delete", "my-mark", "--benchmark-dir", folder, "--yes"]) == 2
    assert cli.run(spark, [write(DEFECTS), "--timeframe", "H1"]) == 1
    capsys.readouterr()
    for bad in (["--report-version", "2"], ["--score-weights", "x"], ["--benchmark", "a"], ["--tolerances", "[]"], ["--market", "moon"]):
        assert cli.run(spark, [base, *bad]) == 2
    assert json.loads(next(x for x in capsys.readouterr().out.splitlines() if x.startswith("{")))["code"] == "INVALID_ARGUMENT"
    assert cli.run(spark, [base, "--output", base]) == 2 and open(base, encoding="utf-8").read() == CLEAN


def test_run_api(spark, tmp_path):
    api = service.ValidationService(spark, str(tmp_path / "runs"))
    options = service.RunOptions(timeframe="H1")
    run, joined = api.submit("a.csv", io.BytesIO(DEFECTS.encode()), options=options)
    assert not joined and api.status(run) == service.WITH_FINDINGS
    assert api.submit("b.csv", io.BytesIO(DEFECTS.encode()), options=options) == (run, True)
    assert list(api.export(run, service.CONCISE))[3] == "Closed market records: 0"
    assert json.loads("".join(api.export(run, service.JSON_V2)))["summary"]["timeGaps"] == 2
    with pytest.raises(Fatal):
        api.export(run, "JsonV1")
    failed, _ = api.submit("c.csv", io.BytesIO(b"x\n"), options=options)
    assert api.status(failed) == service.FAILED and api.status("none") is None
    api.retry(failed)
    assert api.status(failed) == service.FAILED
    with pytest.raises(ValueError):
        api.retry(run)
    waiting: list[str] = []
    first = service.ValidationService(spark, str(tmp_path / "later"), waiting.append)
    kept, _ = first.submit("d.csv", io.BytesIO(CLEAN.encode()), options=options)
    second = service.ValidationService(spark, str(tmp_path / "later"))  # as after a restart
    second.execute(kept)
    assert waiting == [kept] and second.status(kept) == service.CLEAN
    for operation, o in ((service.VALIDATE, {"instrument": "a"}), (service.COMPARE, {"score": True}), (service.ESTABLISH, {}), (service.VALIDATE, {"score_weights": "x"}), (service.VALIDATE, {"timeframe": "h1"}), (service.VALIDATE, {"calendar": "x"}), (service.VALIDATE, {"tolerances": "[]"}), ("other", {})):
        with pytest.raises(Fatal):
            api.submit("d.csv", io.BytesIO(b""), operation, service.RunOptions(**o))
    service.discard(api)


def test_streamed_checks(spark, tmp_path):
    from tickloom.streaming.checks import row_findings

    rows = [(dt.datetime(2026, 1, 10), 1.0, 2.0, 0.5, 1.5, 1.0, 1), (dt.datetime(2026, 1, 5), 1.0, 0.9, 0.5, 0.8, -1.0, 2), (dt.datetime(2026, 1, 5), 1.0, 2.0, 0.5, 1.5, 1.0, 3)]
    frame = spark.createDataFrame(rows, "ts timestamp, open double, high double, low double, close double, volume double, source_line bigint")
    frame.write.parquet(str(tmp_path / "in"))
    query = row_findings(spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in")), calendars.forex).writeStream.format("memory").queryName("found").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {r["source_line"]: r["codes"] for r in spark.table("found").collect()} == {1: ["CLOSED_MARKET"], 2: ["HIGH_BELOW_OPEN", "NEGATIVE_VOLUME"]}
