"""Zone settings, and the local-time intervals over which a zone keeps one offset."""

from __future__ import annotations

import datetime as dt
import zoneinfo
from collections.abc import Iterator
from itertools import islice, takewhile

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Years for which intervals are listed. Later years repeat after 400 years (a Gregorian cycle has a whole number of weeks).
FIRST_YEAR, LAST_YEAR, CYCLE = 1900, 2399, 400
CYCLE_S = 146097 * 86400
MAX_OFFSET_S = 14 * 3600
#: Offsets are compared at this distance; the shortest known return to an earlier offset lasts weeks.
STEP_S = 7 * 86400
#: Fixed value: the offset of a run without a setting.
DEFAULT_OFFSET = "+02:00"
_EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)

INTERVALS = "zone string, year int, spans array<struct<lo:bigint,hi:bigint,offset_s:int,abbr:string>>"

_SIGNED = r"^(?:UTC|GMT)?\s*([+-])?(\d{1,2})(?::?(\d{2}))?(?::(\d{2}))?$"


def with_offset(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds ``out``, the offset in seconds that a text such as ``+05:30``, ``-0330``, ``-08:00:00``, ``UTC+3`` or ``Z`` fixes, or null.

    A text without a sign is read only as H:mm:ss or HH:mm, ahead of UTC. Minutes or seconds over 59 and offsets beyond 14 hours are
    unusable (null), as is any other text; zone ids are also null here. The text is matched once."""
    t = F.upper(F.trim(F.col(text)))
    df = df.withColumn("_offset_parts", F.split(F.regexp_replace(t, _SIGNED, "$1|$2|$3|$4"), r"\|", -1))
    p = F.col("_offset_parts")
    numbers = {f"_offset_{i}": F.when(F.get(p, F.lit(i)) == "", 0).otherwise(F.get(p, F.lit(i)).try_cast("int")) for i in (1, 2, 3)}
    df = df.withColumns({"_offset_sign": F.get(p, F.lit(0)), **numbers})
    hours, minutes, rest = (F.col(c) for c in numbers)
    size = hours * 3600 + minutes * 60 + rest
    # Only a text that the expression matched has all four parts.
    usable = (minutes < 60) & (rest < 60) & (size <= MAX_OFFSET_S) & ((F.col("_offset_sign") != "") | t.rlike(r"^\d{1,2}:\d{2}"))
    seconds = F.when(t.isin("Z", "UTC", "GMT"), 0).when(usable, F.when(F.col("_offset_sign") == "-", -size).otherwise(size))
    return df.withColumn(out, seconds).drop("_offset_parts", "_offset_sign", *numbers)


def setting_offset(df: DataFrame, text: str, out: str) -> DataFrame:
    """``with_offset`` of a run's setting, of which null and blank ones take the default."""
    given = F.coalesce(F.when(F.trim(F.col(text)) != "", F.col(text)), F.lit(DEFAULT_OFFSET))
    return with_offset(df.withColumn("_setting", given), "_setting", out).drop("_setting")


def _offset(zone: zoneinfo.ZoneInfo, second: int) -> tuple[int, str]:
    at = (_EPOCH + dt.timedelta(seconds=second)).astimezone(zone)
    return int(at.utcoffset().total_seconds()), at.tzname() or ""


def spans_of(name: str) -> list[tuple[int, int, int, str]]:
    """(local start, local end, offset, abbreviation) of every interval of a zone, in seconds, half open; [] for no zone."""
    try:
        zone = zoneinfo.ZoneInfo(name)
    except (zoneinfo.ZoneInfoNotFoundError, ValueError, OSError):
        return []
    start = int((dt.datetime(FIRST_YEAR, 1, 1, tzinfo=dt.timezone.utc) - _EPOCH).total_seconds())
    end = int((dt.datetime(LAST_YEAR, 12, 31, tzinfo=dt.timezone.utc) - _EPOCH).total_seconds())
    out, began, now, at = [], -(2**61), _offset(zone, start), start
    while at < end:
        step = min(at + STEP_S, end)
        if (then := _offset(zone, step)) != now:
            lo, hi = at, step
            while hi - lo > 1:
                mid = (lo + hi) // 2
                lo, hi = (mid, hi) if _offset(zone, mid) == now else (lo, mid)
            out.append((began + now[0] if out else began, hi + now[0], *now))
            began, now, step = hi, _offset(zone, hi), hi
        at = step
    out.append((began + now[0] if out else began, 2**61, *now))
    return out


def _year_start(year: int) -> int:
    return (dt.date(year, 1, 1) - dt.date(1970, 1, 1)).days * 86400


def _expand(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for name in frame["zone"]:
            spans, first = spans_of(name), 0
            for year in range(FIRST_YEAR, LAST_YEAR + 1) if spans else ():
                lo = -(2**61) if year == FIRST_YEAR else _year_start(year)
                hi = 2**61 if year == LAST_YEAR else _year_start(year + 1)
                while spans[first][1] <= lo - 2 * 86400:
                    first += 1
                near = takewhile(lambda s: s[0] < hi + 2 * 86400, islice(spans, max(0, first - 1), None))
                own = [s for s in near if s[0] < hi and s[1] > lo]
                rows.append((name, year, [dict(zip(("lo", "hi", "offset_s", "abbr"), s, strict=True)) for s in own]))
        yield pd.DataFrame(rows, columns=["zone", "year", "spans"])


def zone_intervals(zones: DataFrame) -> DataFrame:
    """The offset intervals of the distinct zone ids in column ``zone``, exploded to the local years they touch.

    The size is bounded by the zone database: at most about 600 ids of 500 years with some three intervals each."""
    ids = zones.select("zone").where(F.col("zone").isNotNull()).distinct()
    return ids.mapInPandas(_expand, INTERVALS)
