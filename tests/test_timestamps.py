"""Instants against a brute-force reader built on the standard library."""

from __future__ import annotations

import datetime as dt
import re
import zoneinfo

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tickloom.functions import netformat, zones
from tickloom.operators.timestamps import instants

UTC = dt.timezone.utc
EPOCH = dt.datetime(1970, 1, 1, tzinfo=UTC)
RUNS = "run_id bigint, layout string, timeframe string, date_format string, time_format string, timestamp_format string, tz_offset string"
DATES = {"yyyy.MM.dd": "%Y.%m.%d", "dd.MM.yyyy": "%d.%m.%Y", "MM/dd/yyyy": "%m/%d/%Y", "dd/MM/yyyy": "%d/%m/%Y", "yyyy-MM-dd": "%Y-%m-%d", "yyyyMMdd": "%Y%m%d"}
ANYWHERE = ["%Y.%m.%d", "%Y-%m-%d", "%Y/%m/%d", "%d %b %Y", "%d-%b-%Y", "%Y%m%d"]


def setting(text):
    """A fixed offset, a zone, or None."""
    text = (text or "").strip() or "+02:00"
    if text in ("Z", "UTC", "GMT"):
        return dt.timedelta(0)
    m = re.fullmatch(r"(?:UTC)?([+-]?)(\d{1,2})(?::?(\d{2}))?(?::(\d{2}))?", text)
    if m and (m[1] or ":" in text):
        span = dt.timedelta(hours=int(m[2]), minutes=int(m[3] or 0), seconds=int(m[4] or 0))
        return (-span if m[1] == "-" else span) if span <= dt.timedelta(hours=14) and int(m[3] or 0) < 60 else None
    try:
        return zoneinfo.ZoneInfo(text)
    except (zoneinfo.ZoneInfoNotFoundError, ValueError):
        return None


def to_utc(local: dt.datetime, where, name=""):
    if where is None:
        return None
    if isinstance(where, dt.timedelta):
        return local.replace(tzinfo=UTC) - where
    hits = set()
    for fold in (0, 1):
        at = local.replace(tzinfo=where, fold=fold).astimezone(UTC)
        if at.astimezone(where).replace(tzinfo=None) == local:
            hits.add((at, at.astimezone(where).tzname()))
    named = {h for h in hits if h[1] == name.upper()}
    hits = named if len(hits) > 1 and named else hits
    return next(iter(hits))[0] if len(hits) == 1 else None


def clock(text, date: dt.date, where):
    m = re.fullmatch(r"(\d\d):(\d\d)(?::(\d\d)(?:\.(\d{1,9}))?)?\s*([AaPp][Mm])?\s*(Z|z|UTC|[+-]\d\d:?\d\d|[A-Za-z]{2,5})?", text)
    if not m or int(m[1]) > (12 if m[5] else 23) or (m[5] and m[1] == "00") or int(m[2]) > 59 or int(m[3] or 0) > 59:
        return None
    hour = int(m[1]) % 12 + 12 * (m[5].upper() == "PM") if m[5] else int(m[1])
    local = dt.datetime(date.year, date.month, date.day, hour, int(m[2]), int(m[3] or 0), int((m[4] or "0").ljust(6, "0")[:6]))
    zone = m[6] or ""
    if zone.upper() in ("Z", "UTC") or zone[:1] in ("+", "-"):
        return to_utc(local, setting(zone.upper()))
    return to_utc(local, where, zone)


def day(text, formats):
    for f in formats:
        try:
            d = dt.datetime.strptime(text, f)
        except ValueError:
            continue
        if re.sub(r"[A-Za-z]+", "", d.strftime(f)) == re.sub(r"[A-Za-z]+", "", text):
            return d.date()
    return None


def micros(at):
    return None if at is None else (at - EPOCH) // dt.timedelta(microseconds=1)


def test_separate_columns(spark):
    folder = "/root/testdata/sf0.01"
    runs = {r["run_id"]: r for r in pq.read_table(f"{folder}/stored_csv.parquet").to_pylist()}
    wanted = {}
    for r in pq.read_table(f"{folder}/all_categories.parquet", columns=["row_id", "run_id", "date", "time"]).to_pylist():
        run = runs[r["run_id"]]
        d = day((r["date"] or "").strip(), [DATES[run["date_format"] or "yyyy.MM.dd"], *ANYWHERE])
        wanted[r["row_id"]] = micros(clock((r["time"] or "").strip(), d, setting(run["tz_offset"]))) if d else None
    made = instants(spark.read.parquet(f"{folder}/all_categories.parquet"), spark.read.parquet(f"{folder}/stored_csv.parquet"), "all_categories", ["row_id"])
    got = {r["row_id"]: r["utc_us"] for r in made.collect()}
    assert {k: (wanted[k], got[k]) for k in wanted if wanted[k] != got[k]} == {}


def test_combined_column(spark):
    folder = "/root/testdata/sf0.01"
    runs = {r["run_id"]: r for r in pq.read_table(f"{folder}/stored_csv.parquet").to_pylist()}
    wanted = {}
    for r in pq.read_table(f"{folder}/combined_timestamp.parquet", columns=["row_id", "run_id", "timestamp"]).to_pylist():
        run, text = runs[r["run_id"]], (r["timestamp"] or "").strip()
        own = (run["timestamp_format"] or "").replace("T", " ").split(" ")[0]
        at = None
        if re.fullmatch(r"\d{10}|\d{13}|\d{16}", text):
            at = EPOCH + dt.timedelta(microseconds=int(text) * 10 ** (16 - len(text)))
        elif re.fullmatch(r"\d{14}", text):
            at = clock(f"{text[8:10]}:{text[10:12]}:{text[12:]}", day(text[:8], ["%Y%m%d"]), setting(run["tz_offset"]))
        elif m := re.fullmatch(r"(\d\d \w{3} \d{4}|[^ Tt]+)[ Tt](.+)", text):
            d = day(m[1], [*([DATES[own]] if own in DATES else []), *ANYWHERE])
            at = clock(m[2], d, setting(run["tz_offset"])) if d else None
        wanted[r["row_id"]] = micros(at)
    made = instants(spark.read.parquet(f"{folder}/combined_timestamp.parquet"), spark.read.parquet(f"{folder}/stored_csv.parquet"), "combined_timestamp", ["row_id"])
    got = {r["row_id"]: r["utc_us"] for r in made.collect()}
    assert {k: (wanted[k], got[k]) for k in wanted if wanted[k] != got[k]} == {}


def utc(text):
    return micros(dt.datetime.fromisoformat(text).replace(tzinfo=UTC))


CASES = [
    ("2025-03-30 02:30:00", "Europe/Berlin", None),
    ("2025-10-26 02:30:00", "Europe/Berlin", None),
    ("2025-10-26 02:30:00 CEST", "Europe/Berlin", "2025-10-26 00:30:00"),
    ("2025-10-26 02:30:00 CET", "Europe/Berlin", "2025-10-26 01:30:00"),
    ("2025-07-01 12:00:00", "Europe/Berlin", "2025-07-01 10:00:00"),
    ("2450-07-01 12:00:00", "Europe/Berlin", "2450-07-01 10:00:00"),
    ("2025-07-01 12:00:00", None, "2025-07-01 10:00:00"),
    ("2025-07-01 12:00:00", "UTC+3", "2025-07-01 09:00:00"),
    ("2025-07-01 12:00:00", "-03:30:00", "2025-07-01 15:30:00"),
    ("2025-07-01 12:00:00", "99:00:00", None),
    ("2025-07-01 12:00:00", "broker time", None),
    ("2025-07-01 12:00:00Z", "broker time", "2025-07-01 12:00:00"),
    ("1751371200123", "?", "2025-07-01 12:00:00.123"),
    ("1969-12-31 23:59:59.999+0000", None, "1969-12-31 23:59:59.999"),
    ("2025-02-29 00:00:00", "Z", None),
    ("2024-02-29T24:00:00", "Z", None),
    ("x" * 100_000, "Z", None),
    ("", "Z", None),
    (None, "Z", None),
]


def test_cases(spark):
    runs = spark.createDataFrame([(i, "combined_timestamp", "H1", None, None, None, zone) for i, (_, zone, _) in enumerate(CASES)], RUNS)
    rows = spark.createDataFrame([(i, i, text) for i, (text, _, _) in enumerate(CASES)], "row_id bigint, run_id bigint, timestamp string")
    made = {r["row_id"]: r["utc_us"] for r in instants(rows, runs, "combined_timestamp", ["row_id"]).collect()}
    assert made == {i: wanted and utc(wanted) for i, (_, _, wanted) in enumerate(CASES)}


def test_clashing_columns_unlisted_runs_and_empty_tables(spark):
    runs = spark.createDataFrame([(1, "all_categories", "H1", None, None, None, None)] * 2 + [(None, "all_categories", "H1", None, None, None, None)], RUNS)
    rows = spark.createDataFrame([(1, "2025.01.02", "03:04", "x"), (2, "2025.01.02", "03:04", "x"), (None, "2025.01.02", "03:04Z", "x"), (1, "2025.01.02", "03:04", "x")], "run_id bigint, date string, time string, zone string")
    rows = rows.withColumn("date_regex", F.lit("y")).withColumn("utc", F.lit(1))
    made = instants(rows, runs, "all_categories").orderBy("run_id", "utc_us").collect()
    assert [(r["run_id"], r["utc_us"]) for r in made] == [(None, utc("2025-01-02 03:04:00")), (1, utc("2025-01-02 01:04:00")), (1, utc("2025-01-02 01:04:00")), (2, None)]
    assert made[0]["date_regex"] == "y"
    assert instants(rows.limit(0), runs.limit(0), "all_categories").collect() == []


def test_translation():
    regex, canonical = netformat.translate("d MMM yyyy h:mm tt", zone_suffix=False)
    assert re.fullmatch(regex.strip("^$"), "2 Jan 2025 3:04 PM") and canonical == "$3|$2|$1|$4|$5|||$6|"
    assert re.fullmatch(netformat.translate("O")[0].strip("^$"), "2025-01-02T03:04:05.1234567+02:00")
    assert re.fullmatch(netformat.translate("yyyy'T'\\dMM")[0].strip("^$"), "2025Td01")


def test_spans_cover_all_local_times():
    spans = zones.spans_of("America/New_York")
    assert len(spans) > 800 and spans[0][0] < -(2**60) and spans[-1][1] > 2**60
    assert zones.spans_of("nowhere") == [] and zones.spans_of("../x") == []
    at = int((dt.datetime(2025, 11, 2, 1, 30) - dt.datetime(1970, 1, 1)).total_seconds())
    assert sorted(s[3] for s in spans if s[0] <= at < s[1]) == ["EDT", "EST"]
