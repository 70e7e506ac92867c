"""Problem 3: timestamps in mixed formats, precisions and zones as one UTC instant.

Texts are brought to one canonical form by a regular expression (the run's own format first, then unambiguous notations), checked
against the calendar, and turned into local microseconds. Local times meet the offset intervals of the run's zone in an as-of join
on (zone, local year): two matching intervals mean a repeated local time, none a skipped one, one gives the offset. A zone
abbreviation picks among two. Everything runs row by row in the JVM; the joined settings and intervals are small by construction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions import netformat, zones
from tickloom.functions.plans import settled, small_side

#: Fixed values: .NET patterns of a run without its own.
DEFAULT_DATE = "yyyy.MM.dd"
#: Month names by which texts are read, three letters each.
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"

#: Notations read besides the run's own format, as one alternation each, so that a text costs one more pass.
_DATE = (
    r"^(?:(\d{4})([-./])(\d{2})\2(\d{2})|(\d{2})([- ])([A-Za-z]{3,9})\6(\d{4})|(\d{4})(\d{2})(\d{2}))$",
    "$1$8$9|$3$7$10|$4$5$11||||||",
)
_CLOCK = r"(\d{2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?(?:\s*([AaPp][Mm]))?(?:\s*(" + netformat.ZONE + r"))?$"
_TIME = ("^" + _CLOCK, "|$1|$2|$3|$4|$5|$6")
_BOTH = (
    r"^(?:(\d{4})([-./])(\d{2})\2(\d{2})|(\d{2})([- ])([A-Za-z]{3,9})\6(\d{4}))[Tt ]\s*" + _CLOCK,
    "$1$8|$3$7|$4$5|$9|$10|$11|$12|$13|$14",
)
_BLANKS = " \t\r\n\u00a0"


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(_BLANKS))


def run_settings(runs: DataFrame) -> DataFrame:
    """One row per run: translated formats, timeframe and the zone setting as a fixed offset or a zone id.

    A ``run_id`` listed several times is taken once, with the setting that is least in order of its columns; null run ids are dropped."""
    one = runs.where(F.col("run_id").isNotNull()).groupBy("run_id").agg(
        F.min(F.struct("layout", "timeframe", "date_format", "time_format", "timestamp_format", "tz_offset")).alias("s")
    )
    one = one.select("run_id", "s.*")
    blank = lambda c: F.when(F.trim(F.col(c)) != "", F.trim(F.col(c)))
    one = one.select(
        "run_id", "timeframe", F.coalesce(blank("date_format"), F.lit(DEFAULT_DATE)).alias("date_format"), blank("timestamp_format").alias("timestamp_format"), blank("tz_offset").alias("tz_offset")
    )
    one = settled(zones.setting_offset(one, "tz_offset", "offset_s"), "offset_s")
    one = one.withColumn("zone", F.when(F.col("offset_s").isNull(), F.col("tz_offset")))
    dates = netformat.patterns(runs.select(F.coalesce(blank("date_format"), F.lit(DEFAULT_DATE)).alias("p")), "p", False)
    stamps = netformat.patterns(runs.select(blank("timestamp_format").alias("p")), "p", True)
    one = one.join(dates.select(F.col("pattern").alias("date_format"), F.col("regex").alias("date_regex"), F.col("canonical").alias("date_canonical")), "date_format", "left")
    return one.join(stamps.select(F.col("pattern").alias("timestamp_format"), F.col("regex").alias("stamp_regex"), F.col("canonical").alias("stamp_canonical")), "timestamp_format", "left").drop("date_format", "timestamp_format")


def with_parts(df: DataFrame, parts: str) -> DataFrame:
    """Adds the typed parts of a canonical form, split in the array ``parts``, as columns of their own; each is used several times, so
    Catalyst keeps them in a projection of their own and no generated method grows with their number of uses."""
    y, month, d, h, mi, s, f, t, z = (F.get(F.col(parts), F.lit(i)) for i in range(9))
    named = F.instr(F.lit(MONTHS), F.lower(F.substring(month, 1, 3)))
    y = F.when(F.size(parts) == 9, y)  # else a text that no notation matched
    df = df.withColumns({"_year_text": y, "_month": month, "_named": named, "_day": d, "_raw": h.try_cast("int"), "_minute": mi.try_cast("int"), "_second": F.when(s == "", 0).otherwise(s.try_cast("int")), "_seconds": s, "_fraction": f, "_half": F.upper(t), "_zone_text": F.upper(z)})
    m = F.when(F.length("_month") <= 2, F.col("_month")).when(F.col("_named") % 3 == 1, F.expr("cast((_named + 2) div 3 as string)"))
    raw, half = F.col("_raw"), F.col("_half")
    hour = F.when(half == "", F.when(raw < 24, raw)).when((raw >= 1) & (raw <= 12), raw % 12 + F.when(half == "PM", 12).otherwise(0))
    day = F.when(F.col("_year_text") != "0000", F.concat_ws("-", "_year_text", m, "_day").try_cast("date"))
    micros = F.when(F.col("_fraction") == "", 0).otherwise(F.rpad("_fraction", 6, "0").substr(1, 6).try_cast("int"))
    total = (F.unix_date(day).cast("bigint") * 86400 + hour * 3600 + F.col("_minute") * 60 + F.col("_second")) * 1000000 + micros
    unit = F.when(F.col("_seconds") == "", 60000000).otherwise(F.pow(F.lit(10), 6 - F.least(F.length("_fraction"), F.lit(6)))).cast("bigint")
    df = df.withColumns({"_us": F.when((F.col("_minute") < 60) & (F.col("_second") < 60), total), "_unit": unit})
    return df.drop("_year_text", "_month", "_named", "_day", "_raw", "_minute", "_second", "_seconds", "_fraction", "_half")


def local_times(df: DataFrame, layout: str, date: str = "date", time: str = "time", timestamp: str = "timestamp") -> DataFrame:
    """Adds ``_us`` (microseconds of the local clock, null if the date or time doesn't exist), ``_zone_text``, ``_unit`` (the written
    precision in microseconds) and ``_epoch_us`` to rows joined with their run's settings."""
    if layout == "combined_timestamp":
        text = stripped(F.col(timestamp))
        df = df.withColumn("_canonical", netformat.canonical(text, [(F.col("stamp_regex"), F.col("stamp_canonical")), _BOTH]))
        df = with_parts(df.withColumn("_parts", F.split("_canonical", r"\|", -1)), "_parts")
        n = F.length("_canonical")
        scale = F.when(n == 10, 1000000).when(n == 13, 1000).when(n == 16, 1).cast("bigint")
        df = df.withColumn("_scale", F.when(F.col("_canonical").rlike(r"^\d+$"), scale)).withColumn("_epoch_us", F.col("_canonical").try_cast("bigint") * F.col("_scale"))
        return df.withColumn("_unit", F.coalesce("_unit", "_scale")).drop("_canonical", "_parts", "_scale")
    day = netformat.canonical(stripped(F.col(date)), [(F.col("date_regex"), F.col("date_canonical")), _DATE])
    clock = netformat.canonical(stripped(F.col(time)), [_TIME])
    df = df.withColumn("_parts", F.split(F.concat(F.substring_index(day, "|", 3), clock), r"\|", -1))
    return with_parts(df, "_parts").withColumn("_epoch_us", F.lit(None).cast("bigint")).drop("_parts")


def instants(df: DataFrame, runs: DataFrame, layout: str, keep: list[str] | None = None, settings: list[str] | None = None, candidates: bool = False) -> DataFrame:
    """Rows of ``df`` with ``utc_us``, microseconds since 1970-01-01 UTC cut to the written precision, or null.

    ``layout`` is ``all_categories`` (columns date and time) or ``combined_timestamp`` (column timestamp). ``keep`` names the
    columns of ``df`` to return (all by default), ``settings`` further columns of the run to add. ``utc_us`` is null for null or
    unreadable texts, dates and times that don't exist, local times that a clock change skips, or repeats without the text telling
    which is meant, and local times without a usable zone (a run that isn't listed has none). An offset, Z or UTC in the text goes
    before the run's zone; an abbreviation means the run's zone. With ``candidates`` a column ``utc_candidates`` has both instants
    of a repeated time, and ``unit_us`` the written precision in microseconds (60,000,000 for minutes). Repeated rows stay; other columns of ``df`` named like the run's settings don't clash."""
    keep = keep if keep is not None else df.columns
    listed, runs = runs, run_settings(runs)
    fixed = {c: f"_run_{c}" for c in runs.columns if c != "run_id"}
    hidden = small_side(runs.select("run_id", *(F.col(a).alias(b) for a, b in fixed.items())), listed)
    texts = ("timestamp",) if layout == "combined_timestamp" else ("date", "time")
    src = df.select(*(F.col(c).alias(f"_keep_{c}") for c in keep), F.col("run_id").alias("_run_id"), *(F.col(c).alias(f"_t_{c}") for c in texts))
    src = src.join(hidden.withColumnRenamed("run_id", "_run_id"), "_run_id", "left")
    none = {"date_regex": "(?!)", "date_canonical": "", "stamp_regex": "(?!)", "stamp_canonical": ""}  # matches no text
    src = src.withColumns({c: F.coalesce(f"_run_{c}", F.lit(x)) for c, x in none.items()})
    src = local_times(src, layout, "_t_date", "_t_time", "_t_timestamp")

    src = src.withColumn("_sec", F.expr("_us div 1000000 - if(pmod(_us, 1000000) <> 0 and _us < 0, 1, 0)"))
    src = src.withColumn("_real_year", F.year(F.date_from_unix_date(F.expr("cast(floor(_sec / 86400) as int)"))))
    listed_year = F.when(F.col("_real_year") > zones.LAST_YEAR, zones.LAST_YEAR + 1 - zones.CYCLE + F.pmod(F.col("_real_year") - zones.LAST_YEAR - 1, F.lit(zones.CYCLE)))
    src = src.withColumn("_year", listed_year.otherwise(F.greatest(F.lit(zones.FIRST_YEAR), F.col("_real_year"))))

    # Bounded by the zone database, whatever the data: some 600 ids of 500 years.
    spans = F.broadcast(zones.zone_intervals(runs).select(F.col("zone").alias("_run_zone"), F.col("year").alias("_year"), F.col("spans").alias("_spans")))
    src = src.join(spans, ["_run_zone", "_year"], "left")
    cycles = F.when(F.col("_real_year") > zones.LAST_YEAR, F.expr(f"(_real_year - _year) div {zones.CYCLE}")).otherwise(0)
    src = src.withColumn("_sec", F.col("_sec") - cycles.cast("bigint") * zones.CYCLE_S)
    src = src.withColumn("_hits", F.expr("filter(_spans, s -> s.lo <= _sec and _sec < s.hi)"))
    src = src.withColumn("_named", F.expr("filter(_hits, s -> s.abbr = _zone_text)"))
    src = zones.with_offset(src, "_zone_text", "_explicit")
    src = src.withColumn("_explicit", F.when(F.col("_zone_text") != "GMT", F.col("_explicit")))  # the run's own zone, as other abbreviations
    src = src.withColumn("_wrong", F.coalesce(F.col("_zone_text").rlike(r"\d") & F.col("_explicit").isNull(), F.lit(False)))
    pick = F.when(F.size("_hits") == 1, F.expr("_hits[0].offset_s")).when((F.size("_hits") > 1) & (F.size("_named") == 1), F.expr("_named[0].offset_s"))
    offset = F.coalesce(F.col("_explicit"), F.when(~F.col("_wrong"), F.coalesce(F.col("_run_offset_s"), pick)))
    utc = F.coalesce(F.col("_epoch_us"), F.col("_us") - offset.cast("bigint") * 1000000)
    out = [*(F.col(f"_keep_{c}").alias(c) for c in keep), *(F.col(f"_run_{c}").alias(c) for c in settings or []), utc.alias("utc_us")]
    if candidates:
        out += [F.expr("transform(_hits, s -> _us - cast(s.offset_s as bigint) * 1000000)").alias("utc_candidates"), F.col("_unit").alias("unit_us")]
    return settled(src.select(*out), "utc_us")
