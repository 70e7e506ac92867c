"""Malformed lines against a brute-force parser that walks each line character by character."""

from __future__ import annotations

import datetime as dt
import re

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tickloom.operators import malformed

RAW = "record_id bigint, run_id bigint, source_line bigint, raw_text string"
RUNS = "run_id bigint, has_header boolean, delimiter string, date_format string, time_format string"
STRPTIME = {"yyyy.MM.dd": "%Y.%m.%d", "dd.MM.yyyy": "%d.%m.%Y", "MM/dd/yyyy": "%m/%d/%Y", "dd/MM/yyyy": "%d/%m/%Y", "yyyy-MM-dd": "%Y-%m-%d", "yyyyMMdd": "%Y%m%d"}


def fields_of(line: str, delimiter: str):
    """Fields, or None for broken quoting."""
    out, i = [], 0
    while True:
        while i < len(line) and line[i] in " \t" and line[i] != delimiter:
            i += 1
        if line[i : i + 1] == '"':
            j, text = i + 1, ""
            while True:
                if j >= len(line):
                    return None
                if line[j] == '"':
                    if line[j + 1 : j + 2] != '"':
                        break
                    j += 1
                text += line[j]
                j += 1
            j += 1
            while j < len(line) and line[j] in " \t" and line[j] != delimiter:
                j += 1
            if j < len(line) and line[j] != delimiter:
                return None
            out.append(text.strip(" \t"))
        else:
            j = line.find(delimiter, i)
            j = len(line) if j < 0 else j
            if '"' in line[i:j]:
                return None
            out.append(line[i:j].strip(" \t"))
        if j >= len(line):
            return out
        i = j + 1


def code_of(row: dict, date_format, time_format):
    try:
        pattern = STRPTIME[date_format or "yyyy.MM.dd"]
        good = row["date"].isascii() and dt.datetime.strptime(row["date"], pattern).strftime(pattern) == row["date"]
    except ValueError:
        good = False
    shapes = {"HH:mm": [r"\d\d:\d\d"], "HH:mm:ss": [r"\d\d:\d\d:\d\d"], None: [r"\d\d:\d\d(:\d\d)?"]}[time_format]
    clock = [int(x) for x in row["time"].split(":")] if any(re.fullmatch(s, row["time"], re.ASCII) for s in shapes) else [99]
    if not good or clock[0] > 23 or any(x > 59 for x in clock[1:]):
        return "INVALID_TIMESTAMP"
    if any(not re.fullmatch(r"[+-]?(\d[\d,]*(\.\d*)?|\.\d+)", row[k], re.ASCII) for k in ("open", "high", "low", "close", "volume")):
        return "INVALID_DECIMAL"
    return None


def brute_force(raw: list[dict], runs: dict[int, dict]) -> dict[int, str]:
    names = {"comma": ",", "semicolon": ";", "tab": "\t"}
    layouts: dict[int, tuple] = {}
    out = {}
    for r in sorted(raw, key=lambda r: (r["run_id"], r["source_line"])):
        line, run = r["raw_text"], runs[r["run_id"]]
        if line is None or not line.strip(" \r\n"):
            continue
        line = line.removeprefix("﻿").removesuffix("\r")
        if r["run_id"] not in layouts:
            bare = re.sub('"[^"]*"', "", line)
            delimiter = names.get(run["delimiter"], run["delimiter"]) or max(",;\t", key=bare.count)
            header = [c.strip().lower() for c in fields_of(line, delimiter)] if run["has_header"] else "date time open high low close volume".split()
            layouts[r["run_id"]] = (delimiter, header)
        if run["has_header"] and r["source_line"] == 1:
            continue
        delimiter, header = layouts[r["run_id"]]
        cells = fields_of(line, delimiter)
        if cells is None:
            code = "INVALID_VALUE"
        elif len(cells) != len(header):
            code = "MISSING_COLUMN" if len(cells) < len(header) else "INVALID_VALUE"
        else:
            code = code_of(dict(zip(header, cells, strict=True)), run["date_format"], run["time_format"])
        if code:
            out[r["record_id"]] = code
    return out


def test_whole_table(spark):
    folder = "/root/testdata/sf0.01"
    raw = pq.read_table(f"{folder}/all_categories_raw.parquet").to_pylist()
    runs = {r["run_id"]: r for r in pq.read_table(f"{folder}/stored_csv.parquet").to_pylist()}
    lines = malformed.parsed_lines(spark.read.parquet(f"{folder}/all_categories_raw.parquet"), spark.read.parquet(f"{folder}/stored_csv.parquet"))
    errors = malformed.failures(lines)
    made = {r["record_id"]: r["reason_code"] for r in errors.collect()}
    assert made == brute_force(raw, runs)
    clean = malformed.candles(lines, errors)
    assert clean.count() == lines.count() - len(made)
    assert clean.where("date is null or second_of_day is null or open is null or volume is null").count() == 0


def found(spark, rows, runs=((1, False, ",", None, None),), extra=False):
    raw = spark.createDataFrame(rows, RAW)
    if extra:
        raw = raw.withColumn("delimiter", F.lit("x")).withColumn("fields", F.lit("x")).withColumn("date", F.lit(1))
    return {r["record_id"]: (r["reason_code"], r["field"]) for r in malformed.failures(malformed.parsed_lines(raw, spark.createDataFrame(list(runs), RUNS))).collect()}


def test_edge_cases(spark):
    good = "2025.01.02,03:04,1,2,0.5,1.5,10"
    rows = [
        (1, 1, 1, good),
        (2, 1, 2, good + ",extra"),
        (3, 1, 3, good[:-3]),
        (4, 1, 4, '"2025.01.02",03:04,"1,000.5",2, "0.5" ,1.5,10\r'),
        (5, 1, 5, '2025.01.02,03:04,1,2,0.5,1.5,"10'),
        (6, 1, 6, "2025.02.30,03:04,1,2,0.5,1.5,10"),
        (7, 1, 7, "2025.01.02,03:04,1e3,2,0.5,1.5,10"),
        (8, 1, 8, None),
        (9, 1, 9, "  "),
        (10, 1, 10, "2025.01.02,03:04,1,2,0.5,1.5," + "9" * 200_000),
        (11, 1, 11, '"' * 100_001 + ",x"),
        (None, 1, 12, "x"),
        (13, None, 1, good),
        (14, 9, 1, good),
        (15, 1, None, "2025.01.02,25:04,1,2,0.5,1.5,10"),
        (15, 1, None, "2025.01.02,25:04,1,2,0.5,1.5,10"),
    ]
    made = found(spark, rows, extra=True)
    assert made == {2: ("INVALID_VALUE", None), 3: ("MISSING_COLUMN", None), 5: ("INVALID_VALUE", None), 6: ("INVALID_TIMESTAMP", "date"), 7: ("INVALID_DECIMAL", "open"), 11: ("INVALID_VALUE", None), None: ("MISSING_COLUMN", None), 15: ("INVALID_TIMESTAMP", "time")}


def test_header_order_and_comment(spark):
    runs = [(1, True, None, "dd/MM/yyyy", "HH:mm:ss"), (2, True, "semicolon", None, None)]
    rows = [
        (1, 1, 1, "﻿CLOSE\tComment\tDate\tTime\tOpen\tHigh\tLow\tVolume"),
        (2, 1, 2, '1.5\t"a; ""b"""\t02/01/2025\t03:04:05\t1\t2\t0.5\t7'),
        (3, 1, 3, "1.5\t\t02/13/2025\t03:04:05\t1\t2\t0.5\t7"),
        (4, 2, 1, "date;time;open;high;low;close;volume"),
        (5, 2, 2, "2025.01.02;03:04:05;+1;-2;.5;1.;1,234"),
        (6, 2, 3, "2025.01.02;03:04:05;+-1;-2;.5;1.;1,234"),
    ]
    assert found(spark, rows, runs) == {3: ("INVALID_TIMESTAMP", "date"), 6: ("INVALID_DECIMAL", "open")}


def test_empty_tables(spark):
    assert found(spark, []) == {}
    empty = spark.createDataFrame([], RAW)
    lines = malformed.parsed_lines(empty, spark.createDataFrame([], RUNS))
    assert malformed.candles(lines, malformed.failures(lines)).collect() == []
