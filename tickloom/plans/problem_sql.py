"""DuckDB SQL of the problems' queries, written from the problems' statements and apart from the operators.

Texts are read by one regular expression for each format, zones by converting a candidate instant back to its local time."""

from __future__ import annotations

_FIELDS = [f"c{i}" for i in range(2, 7)]
_BLANKS = "chr(32) || chr(9) || chr(10) || chr(13) || chr(160)"
#: The formats of dates, times and timestamps in use.
_DATES = ["yyyy.MM.dd", "yyyy-MM-dd", "yyyyMMdd", "dd.MM.yyyy", "dd/MM/yyyy", "MM/dd/yyyy"]
_STAMPS = [
    "yyyy-MM-ddTHH:mm:ss", "yyyy-MM-ddTHH:mm:sszzz", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss.fff", "yyyyMMddHHmmss", "yyyy.MM.dd HH:mm",
    "dd.MM.yyyy HH:mm:ss", "dd/MM/yyyy HH:mm:ss", "dd MMM yyyy HH:mm", "MM/dd/yyyy HH:mm", "MM/dd/yyyy hh:mm tt",
]
#: What an abbreviation says in an hour that a zone repeats.
_NAMED = [("Europe/Berlin", "CEST", 7200), ("Europe/Berlin", "CET", 3600), ("Europe/London", "BST", 3600), ("Europe/London", "GMT", 0), ("America/New_York", "EDT", -14400), ("America/New_York", "EST", -18000), ("America/Chicago", "CDT", -18000), ("America/Chicago", "CST", -21600), ("Australia/Sydney", "AEDT", 39600), ("Australia/Sydney", "AEST", 36000)]
_ZONE = r"[Zz]|(?:UTC|GMT)?[+-]\d{2}(?::?\d{2})?(?::\d{2})?|[A-Za-z]{2,5}"
_TIMEFRAME_S = "CASE left({0}, 1) WHEN 'M' THEN 60 WHEN 'H' THEN 3600 ELSE 86400 END * CAST(substr({0}, 2) AS BIGINT)"
_PARTS = {"yyyy": ("y", r"(\d{4})"), "MMM": ("M", r"([A-Za-z]{3})"), "MM": ("M", r"(\d{2})"), "dd": ("d", r"(\d{2})"), "HH": ("H", r"(\d{2})"), "hh": ("H", r"(\d{2})"), "mm": ("m", r"(\d{2})"), "ss": ("s", r"(\d{2})"), "fff": ("f", r"(\d{3})"), "tt": ("t", r"([AaPp][Mm])"), "zzz": ("z", r"([+-]\d{2}:\d{2})")}


def _shape(pattern: str, suffix: bool) -> tuple[str, str]:
    """Regular expression of a format, and the replacement that puts its parts in order between bars."""
    regex, at, i = "", {}, 0
    while i < len(pattern):
        token = next((t for t in sorted(_PARTS, key=len, reverse=True) if pattern.startswith(t, i)), pattern[i])
        if token in _PARTS:
            at[_PARTS[token][0]] = len(at) + 1
            regex += _PARTS[token][1]
        else:
            regex += "[.]" if token == "." else token
        i += len(token)
    if suffix and "z" not in at:
        at["z"] = len(at) + 1
        regex += rf"(?:\s*({_ZONE}))?"
    return f"^{regex}$", "|".join(f"\\{at[p]}" if p in at else "" for p in "yMdHmsftz")


def _by_format(name: str, text: str, patterns: list[str], suffix: bool) -> str:
    out = ""
    for p in patterns:
        regex, order = _shape(p, suffix)
        out += f" WHEN {name} = '{p}' AND regexp_matches({text}, '{regex}') THEN regexp_replace({text}, '{regex}', '{order}')"
    return out


_CLOCK = rf"(\d{{2}}):(\d{{2}})(?::(\d{{2}})(?:[.,](\d{{1,9}}))?)?(?:\s*([AaPp][Mm]))?(?:\s*({_ZONE}))?$"
_YEAR_FIRST = [rf"(\d{{4}}){s}(\d{{2}}){s}(\d{{2}})" for s in ("-", "[.]", "/")]
_MONTH_NAMED = [rf"(\d{{2}}){s}([A-Za-z]{{3,9}}){s}(\d{{4}})" for s in ("-", " ")]


def _notations(text: str, after: str, tail: str) -> str:
    out = ""
    for day, order in [*((x, r"\1|\2|\3") for x in _YEAR_FIRST), *((x, r"\3|\2|\1") for x in _MONTH_NAMED)]:
        out += f" WHEN regexp_matches({text}, '^{day}{after}') THEN regexp_replace({text}, '^{day}{after}', '{order}|{tail}')"
    return out


_DAY = f"""CASE{_by_format('f', 'day', _DATES, False)}{_notations('day', '$', '|||||')}
 WHEN regexp_matches(day, '^\\d{{8}}$') THEN regexp_replace(day, '^(\\d{{4}})(\\d{{2}})(\\d{{2}})$', '\\1|\\2|\\3||||||') END"""
_TIME = f"CASE WHEN regexp_matches(clock, '^{_CLOCK}') THEN regexp_replace(clock, '^{_CLOCK}', '|||\\1|\\2|\\3|\\4|\\5|\\6') END"
_STAMP = f"""CASE{_by_format('f', 'stamp', _STAMPS, True)}{_notations('stamp', '[Tt ]\\s*' + _CLOCK, '\\4|\\5|\\6|\\7|\\8|\\9')} END"""


def _offset(text: str) -> str:
    """Seconds of an offset text, or null."""
    m = rf"regexp_extract({text}, '^(?:UTC|GMT)?\s*([+-]?)(\d{{1,2}})(?::?(\d{{2}}))?(?::(\d{{2}}))?$', ['s', 'h', 'm', 'x'])"
    return f"""(SELECT CASE WHEN {text} IN ('Z', 'UTC', 'GMT') THEN 0 WHEN e.h <> '' AND (e.s <> '' OR regexp_matches({text}, '^\\d{{1,2}}:\\d{{2}}'))
 AND coalesce(TRY_CAST(e.m AS INT), 0) < 60 AND coalesce(TRY_CAST(e.x AS INT), 0) < 60
 AND TRY_CAST(e.h AS INT) * 3600 + coalesce(TRY_CAST(e.m AS INT), 0) * 60 + coalesce(TRY_CAST(e.x AS INT), 0) <= 50400
 THEN CASE WHEN e.s = '-' THEN -1 ELSE 1 END * (TRY_CAST(e.h AS INT) * 3600 + coalesce(TRY_CAST(e.m AS INT), 0) * 60 + coalesce(TRY_CAST(e.x AS INT), 0)) END FROM (SELECT {m} AS e))"""


def _instants(prefix: str, source: str) -> str:
    """CTEs ending in ``{prefix}utc(row_id, run_id, utc_us)`` from ``source(row_id, run_id, us, z, epoch_us)``."""
    p = prefix
    return f""", {p}near AS (SELECT l.row_id, l.run_id, l.us, l.epoch_us, r.offset_s, r.zone, l.z,
  CASE WHEN l.z = 'GMT' OR l.z = '' THEN NULL ELSE {_offset('l.z')} END AS explicit, l.us // 1000000 - CASE WHEN l.us % 1000000 < 0 THEN 1 ELSE 0 END AS sec
  FROM {source} l LEFT JOIN runs r USING (run_id)),
 {p}tried AS (SELECT DISTINCT n.zone, n.sec, u FROM {p}near n, LATERAL (SELECT n.sec - CAST(epoch(timezone(n.zone, to_timestamp(n.sec + d))) - (n.sec + d) AS BIGINT) AS u
  FROM (VALUES (-93600), (0), (93600)) days(d)) WHERE n.zone IS NOT NULL AND n.sec IS NOT NULL),
 {p}hits AS (SELECT zone, sec, count(*) AS n, min(sec - u) AS one, list(sec - u) AS every FROM {p}tried WHERE CAST(epoch(timezone(zone, to_timestamp(u))) AS BIGINT) = sec GROUP BY zone, sec),
 {p}utc AS (SELECT n.row_id, n.run_id, coalesce(n.epoch_us, n.us - 1000000 * coalesce(n.explicit, CASE WHEN NOT regexp_matches(n.z, '\\d') THEN coalesce(n.offset_s,
  CASE WHEN h.n = 1 THEN h.one WHEN h.n > 1 AND list_contains(h.every, a.offset_s) THEN a.offset_s END) END)) AS utc_us
  FROM {p}near n LEFT JOIN {p}hits h ON n.zone = h.zone AND n.sec = h.sec LEFT JOIN named a ON a.zone = n.zone AND a.abbr = n.z)"""


def _local(prefix: str, parts: str) -> str:
    """CTE ``{prefix}local(row_id, run_id, us, z, epoch_us)`` from ``parts(row_id, run_id, p, epoch_us)``, p the nine parts."""
    month = "CASE WHEN regexp_matches(p[2], '^\\d+$') THEN p[2] ELSE CAST(list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'], lower(left(p[2], 3))) AS VARCHAR) END"
    hour = "CASE WHEN p[8] = '' THEN CASE WHEN TRY_CAST(p[4] AS INT) < 24 THEN TRY_CAST(p[4] AS INT) END WHEN TRY_CAST(p[4] AS INT) BETWEEN 1 AND 12 THEN TRY_CAST(p[4] AS INT) % 12 + CASE WHEN upper(p[8]) = 'PM' THEN 12 ELSE 0 END END"
    return f"""{prefix}local AS (SELECT row_id, run_id, epoch_us, upper(coalesce(p[9], '')) AS z, CASE WHEN TRY_CAST(p[5] AS INT) < 60 AND coalesce(TRY_CAST(p[6] AS INT), 0) < 60 THEN
  (CAST(epoch(TRY_CAST(p[1] || '-' || lpad({month}, 2, '0') || '-' || p[3] AS DATE)) AS BIGINT) + ({hour}) * 3600 + TRY_CAST(p[5] AS INT) * 60 + coalesce(TRY_CAST(p[6] AS INT), 0)) * 1000000
  + coalesce(TRY_CAST(left(rpad(p[7], 6, '0'), 6) AS BIGINT), 0) END AS us FROM {parts})"""


_RUNS = f"""runs AS (SELECT run_id, timeframe, coalesce(nullif(trim(date_format), ''), 'yyyy.MM.dd') AS date_format, nullif(trim(timestamp_format), '') AS timestamp_format, offset_s,
  CASE WHEN offset_s IS NULL AND trim(tz_offset) IN (SELECT name FROM pg_timezone_names()) THEN trim(tz_offset) END AS zone
  FROM (SELECT *, {_offset("upper(coalesce(nullif(trim(tz_offset), ''), '+02:00'))")} AS offset_s FROM stored_csv)),
 named(zone, abbr, offset_s) AS (VALUES {', '.join(f"('{z}', '{a}', {o})" for z, a, o in _NAMED)})"""
_ALL = f"""{_RUNS}, a_text AS (SELECT a.row_id, a.run_id, trim(a.date, {_BLANKS}) AS day, trim(a.time, {_BLANKS}) AS clock, coalesce(r.date_format, '') AS f FROM all_categories a LEFT JOIN runs r USING (run_id)),
 a_canonical AS (SELECT row_id, run_id, {_DAY} AS d, {_TIME} AS t FROM a_text),
 a_parts AS (SELECT row_id, run_id, list_concat(string_split(d, '|')[1:3], string_split(t, '|')[4:9]) AS p, CAST(NULL AS BIGINT) AS epoch_us FROM a_canonical WHERE d IS NOT NULL AND t IS NOT NULL),
 {_local('a_', 'a_parts')}{_instants('a_', 'a_local')}"""
_COMBINED = f""", b_text AS (SELECT b.row_id, b.run_id, trim(b.timestamp, {_BLANKS}) AS stamp, coalesce(r.timestamp_format, '') AS f FROM combined_timestamp b LEFT JOIN runs r USING (run_id)),
 b_canonical AS (SELECT row_id, run_id, stamp, {_STAMP} AS c FROM b_text),
 b_parts AS (SELECT row_id, run_id, string_split(c, '|') AS p, CASE WHEN c IS NULL AND regexp_matches(stamp, '^\\d+$') THEN
  CASE length(stamp) WHEN 10 THEN CAST(stamp AS BIGINT) * 1000000 WHEN 13 THEN CAST(stamp AS BIGINT) * 1000 WHEN 16 THEN CAST(stamp AS BIGINT) END END AS epoch_us FROM b_canonical),
 {_local('b_', 'b_parts')}{_instants('b_', 'b_local')}"""

_SLOTS = f"""WITH {_ALL},
 placed AS (SELECT u.row_id, u.run_id, u.utc_us, {_TIMEFRAME_S.format("upper(trim(r.timeframe))")} AS period_s FROM a_utc u JOIN runs r USING (run_id) WHERE u.utc_us IS NOT NULL AND r.timeframe IS NOT NULL),
 slotted AS (SELECT *, CAST(floor(utc_us / 1000000.0 / period_s) AS BIGINT) AS slot FROM placed),
 ends AS (SELECT run_id, period_s, min(slot) AS lo, max(slot) AS hi FROM slotted GROUP BY ALL),
 grid AS (SELECT run_id, period_s, unnest(generate_series(lo, hi)) AS slot FROM ends)"""


def _side_sql(name: str) -> str:
    values = ", ".join(f"TRY_CAST(replace(trim({f}, {_BLANKS}), ',', '') AS DECIMAL(38,12)) AS {f}" for f in _FIELDS)
    day = f"strftime(try_strptime(regexp_replace(trim(c0, {_BLANKS}), '[-./]', '', 'g'), '%Y%m%d'), '%Y.%m.%d')"
    return f"SELECT DISTINCT ON (series_id, c0) * FROM (SELECT series_id, source_line, {day} AS c0, {values} FROM {name}) WHERE c0 IS NOT NULL ORDER BY series_id, c0, source_line"


def _written(value: str) -> str:
    """A number as the comparison shows it: no trailing zeros."""
    return f"regexp_replace(CAST({value} AS VARCHAR), '[.]?0+$', '')"


_SIDES = f"WITH a AS ({_side_sql('audusd_d1_reference')}), b AS ({_side_sql('audusd_d1_candidate_coverage_gaps')})"
_MATCH = "a.series_id IS NOT DISTINCT FROM b.series_id AND a.c0 = b.c0"
_CELLS = f"""{_SIDES}, cells AS (
 SELECT series_id, c0, 'missing_in_candidate' AS difference, CAST(NULL AS VARCHAR) AS left_value, CAST(NULL AS VARCHAR) AS right_value FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE {_MATCH})
 UNION ALL SELECT series_id, c0, 'missing_in_reference', NULL, NULL FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE {_MATCH})
 {' '.join(f"UNION ALL SELECT a.series_id, a.c0, '{f}', {_written(f'a.{f}')}, {_written(f'b.{f}')} FROM a JOIN b ON {_MATCH} WHERE a.{f} IS DISTINCT FROM b.{f}" for f in _FIELDS)})"""

_COLUMNS = "['date', 'time', 'open', 'high', 'low', 'close', 'volume']"
_DECIMAL = r"^[+-]?(?:[0-9][0-9,]*(?:[.][0-9]*)?|[.][0-9]+)$"


def _cells_of(text: str, delimiter: str) -> str:
    """The fields of a line; delimiters between an odd and an even quote stay."""
    return f"string_split(array_to_string(list_transform(string_split({text}, '\"'), lambda x, i: CASE WHEN i % 2 = 1 THEN replace(x, {delimiter}, chr(31)) ELSE x END), '\"'), chr(31))"


def _content(cell: str) -> str:
    """A field without quotes and the blanks around it; null for broken quoting."""
    t = f"trim({cell}, chr(32) || chr(9))"
    inner = f"substr({t}, 2, greatest(length({t}) - 2, 0))"
    return f"""CASE WHEN NOT contains({t}, '"') THEN {t} WHEN {t}[1] = '"' AND {t}[-1] = '"' AND length({t}) >= 2 AND NOT contains(replace({inner}, '""', ''), '"') THEN trim(replace({inner}, '""', '"'), chr(32) || chr(9)) END"""


_RAW_DAY = f"CASE{_by_format('date_format', 'day', _DATES, False)} END"
_RAW_TIMES = {"HH:mm": r"^(\d{2}):(\d{2})()$", "HH:mm:ss": r"^(\d{2}):(\d{2}):(\d{2})$", "": r"^(\d{2}):(\d{2})(?::(\d{2}))?$"}
_RAW_TIME = "CASE" + "".join(f" WHEN time_format = '{f}' THEN regexp_extract(clock, '{r}', ['h', 'm', 's'])" for f, r in _RAW_TIMES.items()) + " END"
_LINES = f"""WITH stripped AS (SELECT *, regexp_replace(ltrim(raw_text, chr(65279)), '\\r$', '') AS text FROM all_categories_raw),
 firsts AS (SELECT run_id, arg_min(text, source_line) AS head, min(source_line) AS first_line FROM stripped WHERE trim(raw_text) <> '' GROUP BY run_id),
 settings AS (SELECT f.run_id, f.head, coalesce(s.has_header, FALSE) AND f.first_line = 1 AS has_header, coalesce(nullif(trim(s.date_format), ''), 'yyyy.MM.dd') AS date_format, coalesce(trim(s.time_format), '') AS time_format,
  CASE lower(trim(s.delimiter)) WHEN 'comma' THEN ',' WHEN 'semicolon' THEN ';' WHEN 'tab' THEN chr(9) ELSE nullif(s.delimiter, '') END AS given, regexp_replace(f.head, '"[^"]*"', '', 'g') AS outside
  FROM firsts f LEFT JOIN stored_csv s USING (run_id)),
 counted AS (SELECT *, length(outside) - length(replace(outside, ',', '')) AS n1, length(outside) - length(replace(outside, ';', '')) AS n2, length(outside) - length(replace(outside, chr(9), '')) AS n3 FROM settings),
 layouts AS (SELECT run_id, has_header, date_format, time_format, head, coalesce(given, CASE WHEN n1 >= n2 AND n1 >= n3 THEN ',' WHEN n2 >= n3 THEN ';' ELSE chr(9) END) AS delimiter FROM counted),
 named AS (SELECT *, CASE WHEN has_header THEN list_transform({_cells_of('head', 'delimiter')}, lambda c: lower({_content('c')})) ELSE {_COLUMNS} END AS columns FROM layouts),
 lines AS (SELECT s.record_id, s.run_id, s.source_line, n.columns, n.date_format, n.time_format, list_transform({_cells_of('s.text', 'n.delimiter')}, lambda c: {_content('c')}) AS fields FROM stripped s JOIN named n USING (run_id)
  WHERE s.raw_text IS NOT NULL AND trim(s.text, CASE WHEN n.delimiter = chr(9) THEN chr(32) || chr(13) || chr(10) ELSE chr(32) || chr(9) || chr(13) || chr(10) END) <> '' AND NOT (n.has_header AND s.source_line = 1)),
 cut AS (SELECT *, fields[list_position(columns, 'date')] AS day, fields[list_position(columns, 'time')] AS clock, {', '.join(f"fields[list_position(columns, '{c}')] AS {c}_text" for c in ("open", "high", "low", "close", "volume"))} FROM lines),
 read AS (SELECT *, string_split({_RAW_DAY}, '|') AS d, {_RAW_TIME} AS t FROM cut),
 typed AS (SELECT *, TRY_CAST(d[1] || '-' || d[2] || '-' || d[3] AS DATE) AS date, CASE WHEN t.h <> '' AND TRY_CAST(t.h AS INT) < 24 AND TRY_CAST(t.m AS INT) < 60 AND coalesce(TRY_CAST(t.s AS INT), 0) < 60 THEN
  TRY_CAST(t.h AS INT) * 3600 + TRY_CAST(t.m AS INT) * 60 + coalesce(TRY_CAST(t.s AS INT), 0) END AS second_of_day FROM read),
 judged AS (SELECT *, CASE WHEN list_contains(list_transform(fields, lambda x: x IS NULL), TRUE) THEN 'INVALID_VALUE' WHEN len(fields) < len(columns) THEN 'MISSING_COLUMN' WHEN len(fields) > len(columns) THEN 'INVALID_VALUE'
  WHEN date IS NULL OR second_of_day IS NULL THEN 'INVALID_TIMESTAMP' WHEN NOT ({' AND '.join(f"coalesce(regexp_matches({c}_text, '{_DECIMAL}'), FALSE)" for c in ("open", "high", "low", "close", "volume"))}) THEN 'INVALID_DECIMAL' END AS reason_code FROM typed)"""

#: p2 (order, robust scales) has no SQL; it is tested against brute force and planted cases.
ORACLE = {
    "p1_found": f"{_LINES} SELECT record_id, reason_code FROM judged WHERE reason_code IS NOT NULL",
    "p1_candles": f"""{_LINES} SELECT record_id, run_id, source_line, date, second_of_day, {', '.join(f"TRY_CAST(replace({c}_text, ',', '') AS DECIMAL(20,8)) AS {c}" for c in ("open", "high", "low", "close", "volume"))}
 FROM judged WHERE reason_code IS NULL""",
    "p3_found": f"""WITH {_ALL}{_COMBINED} SELECT 'all_categories' AS layout, row_id, utc_us FROM a_utc WHERE utc_us IS NOT NULL
 UNION ALL SELECT 'combined_timestamp', row_id, utc_us FROM b_utc WHERE utc_us IS NOT NULL""",
    "p4_found": f"{_SLOTS} SELECT run_id, slot * period_s AS slot_start_s FROM grid g WHERE NOT EXISTS (SELECT 1 FROM slotted s WHERE s.run_id = g.run_id AND s.slot = g.slot)",
    "p4_grid": f"""{_SLOTS}, last AS (SELECT s.run_id, s.slot, count(*) AS n, max({{'us': s.utc_us, 'c': CAST(c.close AS DOUBLE), 'v': CAST(c.volume AS DOUBLE)}}) AS r FROM slotted s JOIN all_categories c USING (row_id) GROUP BY ALL),
 paired AS (SELECT g.run_id, g.period_s, g.slot, l.n, l.r, last_value(CASE WHEN l.n > 0 THEN {{'slot': g.slot, 'r': l.r}} END IGNORE NULLS) OVER before AS b, first_value(CASE WHEN l.n > 0 THEN {{'slot': g.slot, 'r': l.r}} END IGNORE NULLS) OVER behind AS e
  FROM grid g LEFT JOIN last l ON g.run_id = l.run_id AND g.slot = l.slot
  WINDOW before AS (PARTITION BY g.run_id ORDER BY g.slot ROWS UNBOUNDED PRECEDING), behind AS (PARTITION BY g.run_id ORDER BY g.slot ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
 SELECT run_id, period_s, slot * period_s AS slot_start_s, CASE WHEN n > 0 THEN 'observed' WHEN e.slot - b.slot - 1 <= 3 THEN 'filled' ELSE 'missing' END AS status, coalesce(n, 0) AS n_readings,
  CASE WHEN n > 0 THEN r.c WHEN e.slot - b.slot - 1 <= 3 THEN b.r.c + (e.r.c - b.r.c) * ((slot - b.slot) / (e.slot - b.slot)) END AS close,
  CASE WHEN n > 0 THEN r.v WHEN e.slot - b.slot - 1 <= 3 THEN b.r.v + (e.r.v - b.r.v) * ((slot - b.slot) / (e.slot - b.slot)) END AS volume FROM paired""",
    "p5_cells": f"{_CELLS} SELECT * FROM cells",
    "p5_found": f"{_CELLS} SELECT series_id, c0, difference FROM cells",
}
