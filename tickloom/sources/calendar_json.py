"""Market calendars from JSON, version 1: strict about keys, names, days and times."""

from __future__ import annotations

import datetime as dt
import json
import re
from pathlib import Path

from tickloom.operators.calendars import DAYS, Session, WeeklyCalendar

#: The keys of the file and of a session.
KEYS, SESSION_KEYS = {"version", "name", "timeZone", "sessions"}, {"openDay", "openTime", "closeDay", "closeTime"}


class CalendarError(ValueError):
    code = "INVALID_CALENDAR"


def _time(text: object) -> dt.time:
    m = re.fullmatch(r"(\d{2}):(\d{2})(?::(\d{2}))?", str(text))
    try:
        return dt.time(int(m[1]), int(m[2]), int(m[3] or 0))
    except (TypeError, ValueError) as e:
        raise CalendarError(f"{text!r} is no time of day") from e


def _day(text: object) -> int:
    if text not in DAYS:
        raise CalendarError(f"{text!r} is no weekday")
    return DAYS.index(text)


def read_calendar(text: str) -> WeeklyCalendar:
    try:
        data = json.loads(text)
    except json.JSONDecodeError as e:
        raise CalendarError("the calendar is no JSON") from e
    if not isinstance(data, dict) or set(data) != KEYS or data["version"] != 1 or isinstance(data["version"], bool):
        raise CalendarError("a calendar has version 1, name, timeZone and sessions only")
    if not isinstance(data["name"], str) or not isinstance(data["timeZone"], str) or not isinstance(data["sessions"], list):
        raise CalendarError("name and timeZone are texts, sessions is a list")
    sessions = []
    for s in data["sessions"]:
        if not isinstance(s, dict) or set(s) != SESSION_KEYS:
            raise CalendarError("a session has openDay, openTime, closeDay and closeTime only")
        sessions.append(Session(_day(s["openDay"]), _time(s["openTime"]), _day(s["closeDay"]), _time(s["closeTime"])))
    try:
        return WeeklyCalendar(data["name"], data["timeZone"], tuple(sorted(sessions, key=lambda s: s.start)))
    except ValueError as e:
        raise CalendarError(str(e)) from e


def load_calendar(path: str) -> WeeklyCalendar:
    try:
        return read_calendar(Path(path).read_text(encoding="utf-8-sig"))
    except OSError as e:
        raise CalendarError(f"{Path(path).name} can't be read") from e
