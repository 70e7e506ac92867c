"""Market calendars as expressions over UTC microseconds; no time zone of the session plays a part."""

from __future__ import annotations

import datetime as dt
import zoneinfo
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

Calendar = Callable[[Column], Column]
DAY, WEEK = 86_400, 604_800
#: Profile names.
PROFILES = ("forex", "equities", "crypto", "custom")
DAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


def _second(us: Column) -> Column:
    return F.floor(us / F.lit(1_000_000).cast("decimal(20,0)")).cast("bigint")


def _week_second(second: Column) -> Column:
    """Second since Monday 00:00; 1970-01-01 was a Thursday."""
    return F.pmod(second + 3 * DAY, F.lit(WEEK))


def local_second(us: Column, zone: str) -> Column:
    shifted = F.from_utc_timestamp(F.timestamp_micros(us), zone)
    return _second(F.unix_micros(shifted))


def forex(us: Column) -> Column:
    """Open from Sunday 22:00 to Friday 22:00 UTC."""
    w = _week_second(_second(us))
    return (w < 4 * DAY + 22 * 3600) | (w >= 6 * DAY + 22 * 3600)


def crypto(us: Column) -> Column:
    """Always open."""
    return us.isNotNull() | F.lit(True)


def equities(us: Column) -> Column:
    """Open Monday to Friday from 09:30 to 16:00 in New York."""
    w = _week_second(local_second(us, "America/New_York"))
    time = w % DAY
    return (w < 5 * DAY) & (time >= 9 * 3600 + 1800) & (time < 16 * 3600)


@dataclass(frozen=True)
class Session:
    open_day: int
    open_time: dt.time
    close_day: int
    close_time: dt.time

    @property
    def start(self) -> int:
        return self.open_day * DAY + self.open_time.hour * 3600 + self.open_time.minute * 60 + self.open_time.second

    @property
    def length(self) -> int:
        end = self.close_day * DAY + self.close_time.hour * 3600 + self.close_time.minute * 60 + self.close_time.second
        return (end - self.start) % WEEK

    def overlaps(self, other: Session) -> bool:
        """Half open; a session may run over the end of the week."""
        return any(self.start < other.start + other.length + w and other.start + w < self.start + self.length for w in (-WEEK, 0, WEEK))


@dataclass(frozen=True)
class WeeklyCalendar:
    """Recurring local sessions, half open. Called with UTC microseconds it says whether the market is open.

    Boundaries that a clock change skips or repeats in 2000 to 2100 are refused; local week seconds then decide as the sessions
    expanded to UTC would."""

    name: str
    zone: str
    sessions: tuple[Session, ...]

    def __post_init__(self) -> None:
        if not 1 <= len(self.name) <= 100:
            raise ValueError("a calendar's name has 1 to 100 characters")
        if not 1 <= len(self.sessions) <= 14:
            raise ValueError("a calendar has 1 to 14 sessions")
        if any(s.length == 0 for s in self.sessions):
            raise ValueError("a session must last some time")
        if any(a.overlaps(b) for i, a in enumerate(self.sessions) for b in self.sessions[i + 1 :]):
            raise ValueError("sessions overlap")
        self._check_boundaries()

    def _check_boundaries(self) -> None:
        try:
            zone = zoneinfo.ZoneInfo(self.zone)
        except (zoneinfo.ZoneInfoNotFoundError, ValueError) as e:
            raise ValueError(f"unknown time zone {self.zone}") from e
        ends = {(s.open_day, s.open_time) for s in self.sessions} | {(s.close_day, s.close_time) for s in self.sessions}
        day = dt.date(2000, 1, 1)
        while day < dt.date(2101, 1, 1):
            before, after = (dt.datetime.combine(d, dt.time(12), zone).utcoffset() for d in (day - dt.timedelta(1), day))
            if before != after:  # a change within the day before or this one
                for d in (day - dt.timedelta(1), day):
                    for weekday, time in ends:
                        if d.weekday() == weekday:
                            a, b = (dt.datetime.combine(d, time, zone).replace(fold=f).utcoffset() for f in (0, 1))
                            if a != b:
                                raise ValueError(f"{time} on {d} is skipped or repeated in {self.zone}")
            day += dt.timedelta(1)

    def __call__(self, us: Column) -> Column:
        w = _week_second(local_second(us, self.zone))
        return reduce(or_, (F.pmod(w - s.start, F.lit(WEEK)) < s.length for s in self.sessions))


def calendar_for(profile: str, custom: WeeklyCalendar | None = None) -> Calendar:
    """The calendar of a profile. ``custom`` is needed for profile custom, allowed for equities, refused for the others."""
    if profile not in PROFILES:
        raise ValueError(f"unknown market profile {profile}")
    if profile == "custom" and custom is None:
        raise ValueError("profile custom needs a calendar file")
    if custom is not None and profile in ("forex", "crypto"):
        raise ValueError(f"profile {profile} takes no calendar file")
    return custom or {"forex": forex, "equities": equities, "crypto": crypto}[profile]
