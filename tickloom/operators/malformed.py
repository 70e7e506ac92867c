"""Problem 1: lines that fail to parse, with the reason, while the valid lines come out typed.

Each line is cut into cells under its run's settings, the cells are exploded into line, column and value, a rule table of a few
rows is joined by column, the failed checks are aggregated per line, and the clean lines are what an anti-join leaves. Only
failing cells reach a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions import netformat
from tickloom.functions.plans import settled, small_side
from tickloom.operators.timestamps import DEFAULT_DATE

#: The columns of a file without a header, and the reason codes.
COLUMNS = ["date", "time", "open", "high", "low", "close", "volume"]
INVALID_VALUE, MISSING_COLUMN, INVALID_TIMESTAMP, INVALID_DECIMAL = "INVALID_VALUE", "MISSING_COLUMN", "INVALID_TIMESTAMP", "INVALID_DECIMAL"
#: Fixed values: (column, kind of check, code, rank). "*quoting" and "*fewer", "*more" are checks of the whole line.
RULES = [
    ("*quoting", "fails", INVALID_VALUE, 1),
    ("*fewer", "fails", MISSING_COLUMN, 2),
    ("*more", "fails", INVALID_VALUE, 3),
    ("date", "date", INVALID_TIMESTAMP, 4),
    ("time", "time", INVALID_TIMESTAMP, 4),
    *((c, "decimal", INVALID_DECIMAL, 5) for c in COLUMNS[2:]),
]
#: English names of delimiters; a run without one takes the one its first line uses most, in this order.
DELIMITERS = {"comma": ",", "semicolon": ";", "tab": "\t"}
_PLACES = list(dict.fromkeys(c for c, *_ in RULES))
_CUT = "￿"  # a noncharacter, which no text contains
_BLANKS = " \t"
DECIMAL = r"^[+-]?(?:[0-9][0-9,]*(?:\.[0-9]*)?|\.[0-9]+)$"
TIME_EITHER = (r"^(\d{2}):(\d{2})(?::(\d{2}))?$", "|||$1|$2|$3|||")


def _unmarked(text: Column) -> Column:
    """Without a leading byte order mark and a final carriage return."""
    text = F.when(text.startswith("﻿"), F.substring(text, 2, 2**31 - 1)).otherwise(text)
    return F.when(text.endswith("\r"), F.substr(text, F.lit(1), F.length(text) - 1)).otherwise(text)


def cells(text: Column, delimiter: Column) -> Column:
    """The fields of a line, quotes kept. Text between an odd and an even quote is inside a field."""
    plain = F.split(F.replace(text, delimiter, F.lit(_CUT)), _CUT, -1)
    parts = F.split(text, '"', -1)
    marked = F.array_join(F.transform(parts, lambda x, i: F.when(i % 2 == 0, F.replace(x, delimiter, F.lit(_CUT))).otherwise(x)), '"')
    return F.when(text.contains('"'), F.split(marked, _CUT, -1)).otherwise(plain)


def _content(cell: Column) -> Column:
    """A field's text without blanks around it and without its quotes; null for broken quoting."""
    t = F.btrim(cell, F.lit(_BLANKS))
    inner = F.substr(t, F.lit(2), F.greatest(F.length(t) - 2, F.lit(0)))
    whole = t.startswith('"') & t.endswith('"') & (F.length(t) >= 2) & ~F.replace(inner, F.lit('""'), F.lit("")).contains('"')
    return F.when(~t.contains('"'), t).when(whole, F.btrim(F.replace(inner, F.lit('""'), F.lit('"')), F.lit(_BLANKS)))


def run_layouts(raw: DataFrame, runs: DataFrame) -> DataFrame:
    """One row per run of ``raw``: delimiter, columns in the file's order, and translated date and time formats."""
    text = F.col("raw_text")
    first = raw.where(F.trim(text) != "").groupBy("run_id").agg(F.min(F.struct("source_line", "raw_text")).alias("f"))
    one = runs.groupBy("run_id").agg(F.min(F.struct("has_header", "delimiter", "date_format", "time_format")).alias("s")).select("run_id", "s.*")
    out = first.join(one, "run_id", "left").select("run_id", F.col("f.source_line").alias("first_line"), _unmarked(F.col("f.raw_text")).alias("head"), F.coalesce("has_header", F.lit(False)).alias("has_header"), "delimiter", "date_format", "time_format")
    outside = F.regexp_replace("head", '"[^"]*"', "")
    counts = [F.length(outside) - F.length(F.replace(outside, F.lit(d), F.lit(""))) for d in DELIMITERS.values()]
    most = F.greatest(*counts)
    used = F.when(counts[0] == most, ",").when(counts[1] == most, ";").otherwise("\t")
    name = F.lower(F.trim("delimiter"))
    given = F.col("delimiter")
    for word, sign in DELIMITERS.items():
        given = F.when(name == word, sign).otherwise(given)
    out = out.withColumn("delimiter", F.coalesce(F.when(given != "", given), used))
    header = F.transform(cells(F.col("head"), F.col("delimiter")), lambda c: F.lower(F.coalesce(_content(c), c)))
    out = out.withColumn("has_header", F.col("has_header") & (F.col("first_line") == 1))
    out = out.withColumn("columns", F.when(F.col("has_header"), header).otherwise(F.array(*(F.lit(c) for c in COLUMNS))))
    blank = lambda c: F.when(F.trim(F.col(c)) != "", F.trim(F.col(c)))
    out = out.withColumn("date_format", F.coalesce(blank("date_format"), F.lit(DEFAULT_DATE))).withColumn("time_format", blank("time_format"))
    every = runs.select(F.explode(F.array(F.coalesce(blank("date_format"), F.lit(DEFAULT_DATE)), blank("time_format"))).alias("p")).unionByName(runs.sparkSession.range(1).select(F.lit(DEFAULT_DATE).alias("p")))
    known = netformat.patterns(every, "p", False)
    for c in ("date", "time"):
        out = out.join(known.select(F.col("pattern").alias(f"{c}_format"), F.col("regex").alias(f"{c}_regex"), F.col("canonical").alias(f"{c}_canonical")), f"{c}_format", "left")
    return out.select("run_id", "has_header", "delimiter", "columns", "date_regex", "date_canonical", F.coalesce("time_regex", F.lit(TIME_EITHER[0])).alias("time_regex"), F.coalesce("time_canonical", F.lit(TIME_EITHER[1])).alias("time_canonical"))


def _canonical(text: Column, regex: Column, replacement: Column) -> Column:
    return F.when(~text.contains("|") & F.regexp_like(text, regex), F.split(F.regexp_replace(text, regex, replacement), r"\|", -1))


def _day(text: Column, regex: Column, replacement: Column) -> Column:
    return _day_of(_canonical(text, regex, replacement))


def _day_of(p: Column) -> Column:
    y, m, d = (F.get(p, F.lit(i)) for i in range(3))
    named = F.instr(F.lit("janfebmaraprmayjunjulaugsepoctnovdec"), F.lower(F.substring(m, 1, 3)))
    month = F.when(F.length(m) <= 2, F.lpad(m, 2, "0")).when(named % 3 == 1, F.lpad(((named + 2) / 3).cast("int").cast("string"), 2, "0"))
    return F.when(y != "0000", F.concat(y, F.lit("-"), month, F.lit("-"), F.lpad(d, 2, "0")).try_cast("date"))


def _second(text: Column, regex: Column, replacement: Column) -> Column:
    """Second of the day, or null."""
    return _second_of(_canonical(text, regex, replacement))


def _second_of(p: Column) -> Column:
    h, m, s, half = (F.get(p, F.lit(i)) for i in (3, 4, 5, 7))
    number = lambda c: F.coalesce(c.try_cast("int"), F.lit(0))
    hour = F.when(half == "", F.when(number(h) < 24, number(h))).when((number(h) >= 1) & (number(h) <= 12), number(h) % 12 + F.when(F.upper(half) == "PM", 12).otherwise(0))
    return F.when((number(m) < 60) & (number(s) < 60), hour * 3600 + number(m) * 60 + number(s))


def parsed_lines(raw: DataFrame, runs: DataFrame) -> DataFrame:
    """The record lines of ``raw`` (header, null and blank lines are none) with their run's layout and ``fields``.

    ``line_key`` names a line by all it has, so that a null or repeated record_id does no harm: equal lines get equal verdicts."""
    layouts = small_side(run_layouts(raw, runs).withColumnRenamed("run_id", "_run"), runs)
    lines = raw.select("record_id", "run_id", "source_line", "raw_text").join(layouts, F.col("run_id") == F.col("_run"), "left").drop("_run")
    lines = lines.withColumn("delimiter", F.coalesce("delimiter", F.lit(","))).withColumn("columns", F.coalesce("columns", F.array(*(F.lit(c) for c in COLUMNS))))
    lines = lines.withColumn("has_header", F.coalesce("has_header", F.lit(False))).withColumn("date_regex", F.coalesce("date_regex", F.lit(netformat.translate(DEFAULT_DATE, False)[0])))
    lines = lines.withColumn("date_canonical", F.coalesce("date_canonical", F.lit(netformat.translate(DEFAULT_DATE, False)[1])))
    lines = lines.withColumn("time_regex", F.coalesce("time_regex", F.lit(TIME_EITHER[0]))).withColumn("time_canonical", F.coalesce("time_canonical", F.lit(TIME_EITHER[1])))
    lines = lines.withColumn("_text", _unmarked(F.col("raw_text")))
    blank = F.btrim("_text", F.when(F.col("delimiter") == "\t", F.lit(" \r\n")).otherwise(F.lit(" \t\r\n"))) == ""
    lines = lines.where(F.col("raw_text").isNotNull() & ~blank & ~(F.col("has_header") & (F.coalesce("source_line", F.lit(0)) == 1)))
    lines = lines.withColumn("fields", F.transform(cells(F.col("_text"), F.col("delimiter")), _content))
    return lines.withColumn("line_key", F.xxhash64("record_id", "run_id", "source_line", "raw_text")).drop("_text")


def failures(lines: DataFrame, values: bool = False) -> DataFrame:
    """(record_id, line_key, reason_code, field, value, failed): the first failing check of each line that fails, and how many fail.

    ``value``, the text that failed, is filled with ``values`` only; it makes the aggregate sort.

    A line's own checks come as cells too. Checks go by rank: quoting, fewer fields, more fields, date and time, numbers."""
    n, wanted = F.size("fields"), F.size("columns")
    broken = F.exists("fields", lambda c: c.isNull())
    line_cell = lambda name, failed: F.when(failed, F.struct(F.lit(name).alias("column"), F.lit(None).cast("string").alias("value")))
    checks = F.array_compact(F.array(line_cell("*quoting", broken), line_cell("*fewer", ~broken & (n < wanted)), line_cell("*more", ~broken & (n > wanted))))
    whole = F.transform(F.arrays_zip(F.col("columns").alias("column"), F.col("fields").alias("value")), lambda x: F.struct(x["column"].alias("column"), x["value"].alias("value")))
    exploded = lines.select("record_id", "line_key", "date_regex", "date_canonical", "time_regex", "time_canonical", F.explode(F.when(F.size(checks) > 0, checks).otherwise(whole)).alias("cell"))
    rules = F.broadcast(lines.sparkSession.createDataFrame(RULES, "column string, kind string, code string, rank int"))  # a dozen rows
    cell = exploded.select("record_id", "line_key", "cell.column", "cell.value", *(F.col(c) for c in ("date_regex", "date_canonical", "time_regex", "time_canonical"))).join(rules, "column")
    # One pattern a cell, and one pass: a cell that its pattern doesn't match keeps no bar.
    is_date, is_time = F.col("kind") == "date", F.col("kind") == "time"
    pattern = F.when(is_date, F.col("date_regex")).when(is_time, F.col("time_regex"))
    order = F.when(is_date, F.col("date_canonical")).otherwise(F.col("time_canonical"))
    stamp = F.when((is_date | is_time) & ~F.col("value").contains("|"), F.regexp_replace(F.col("value"), pattern, order))
    cell = cell.withColumn("_p", F.split(stamp, r"\|", -1))
    exists = F.when(is_date, _day_of(F.col("_p")).isNotNull()).otherwise(_second_of(F.col("_p")).isNotNull())
    number = F.coalesce(F.col("value").rlike(DECIMAL), F.lit(False))
    failed = F.when(F.col("kind") == "fails", F.lit(True)).when(F.col("kind") == "decimal", ~number).otherwise(~(F.coalesce(F.size("_p") == 9, F.lit(False)) & exists))
    # A rank and a place as one number, so that the aggregate needs no sort; the code and the column are looked up by them.
    wrong = settled(cell.withColumn("_failed", failed), "_failed").where("_failed")
    keyed = wrong.select("record_id", "line_key", (F.col("rank") * 16 + F.array_position(F.array(*(F.lit(c) for c in _PLACES)), F.col("column"))).cast("int").alias("first"), "value")
    errors = keyed.groupBy("record_id", "line_key").agg(F.min("first").alias("first"), F.count("*").alias("failed"), F.min_by("value", "first").alias("value")) if values else keyed.groupBy("record_id", "line_key").agg(F.min("first").alias("first"), F.count("*").alias("failed"), F.lit(None).cast("string").alias("value"))
    ranks = {rank: code for _, _, code, rank in RULES}
    code = F.element_at(F.array(*(F.lit(ranks[i]) for i in range(1, len(ranks) + 1))), F.floor(F.col("first") / 16).cast("int"))
    column = F.element_at(F.array(*(F.lit(c) for c in _PLACES)), F.col("first") % 16)
    return errors.select("record_id", "line_key", code.alias("reason_code"), F.when(~column.startswith("*"), column).alias("field"), "value", "failed")


def candles(lines: DataFrame, errors: DataFrame) -> DataFrame:
    """The lines without a failure, typed: record_id, run_id, source_line, date, second of the day, prices and volume.

    Prices are decimal(20,8); digits beyond the eighth are rounded half up, and a number too large for that type is null."""
    bad = errors.select(F.col("record_id").alias("_id"), F.col("line_key").alias("_key"))
    clean = lines.join(bad, F.col("record_id").eqNullSafe(F.col("_id")) & (F.col("line_key") == F.col("_key")), "left_anti")
    value = lambda c: F.get("fields", (F.array_position("columns", F.lit(c)) - 1).cast("int"))
    numbers = [F.replace(value(c), F.lit(","), F.lit("")).try_cast("decimal(20,8)").alias(c) for c in COLUMNS[2:]]
    day = _day(value("date"), F.col("date_regex"), F.col("date_canonical")).alias("date")
    second = _second(value("time"), F.col("time_regex"), F.col("time_canonical")).alias("second_of_day")
    return clean.select("record_id", "run_id", "source_line", day, second, *numbers)
