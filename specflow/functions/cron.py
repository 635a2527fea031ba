"""Cron expressions expanded to the instants they name inside a date range.

Used to derive window intervals from configuration; nothing is scheduled.
Accepts 5, 6 and 7 fields (seconds first when there are six or more).
"""

from __future__ import annotations

import calendar
from datetime import UTC, date, datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weekday and month names.
WEEKDAYS = ("MON", "TUE", "WED", "THU", "FRI", "SAT", "SUN")
MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")


def _number(token: str, names: tuple[str, ...], base: int) -> int:
    token = token.upper()
    return names.index(token) + base if token in names else int(token)


def _values(spec: str, low: int, high: int, names: tuple[str, ...] = (), base: int = 0) -> set[int]:
    found: set[int] = set()
    for part in spec.split(","):
        body, _, step = part.partition("/")
        every = int(step) if step else 1
        if body in ("*", "?"):
            first, last = low, high
        elif "-" in body:
            a, b = body.split("-", 1)
            first, last = _number(a, names, base), _number(b, names, base)
        else:
            first = _number(body, names, base)
            last = high if step else first
        found.update(range(first, last + 1, every))
    return found


def _fields(expression: str) -> tuple[str, ...]:
    """(second, minute, hour, day of month, month, day of week)."""
    parts = expression.split()
    if len(parts) == 5:
        parts = ["0", *parts]
    if len(parts) == 7:
        # some specs write a weekday in fifth place and a trailing '?'
        if parts[4][:3].upper() in WEEKDAYS:
            parts = [*parts[:4], parts[5], parts[4]]
        else:
            parts = parts[:6]
    if len(parts) != 6:
        raise ValueError(f"cron expression '{expression}' needs 5, 6 or 7 fields")
    if parts[4][:3].upper() in WEEKDAYS:
        parts = [*parts[:4], "*", parts[4]]
    return tuple(parts)


def _weekdays(spec: str) -> set[int]:
    """Monday is 0. Names are safest; digits follow 0 or 7 = Sunday, 1 = Monday."""
    if spec in ("*", "?"):
        return set(range(7))
    raw = _values(spec, 0, 7, tuple(WEEKDAYS), 1)
    return {6 if v in (0, 7) else v - 1 for v in raw}


def _days(spec: str, day: date) -> bool:
    if spec in ("*", "?"):
        return True
    last = calendar.monthrange(day.year, day.month)[1]
    if spec.upper() == "L":
        return day.day == last
    return day.day in _values(spec, 1, 31)


class Schedule:
    """The instants an expression names, day by day in its time zone."""

    #: after so many days the calendar repeats; what has not fired by then never does
    REPEAT = 41 * 366

    def __init__(self, expression: str, timezone: str = "UTC"):
        second, minute, hour, self.dom, month, dow = _fields(expression)
        self.seconds, self.minutes = sorted(_values(second, 0, 59)), sorted(_values(minute, 0, 59))
        self.hours, self.months = sorted(_values(hour, 0, 23)), _values(month, 1, 12, MONTHS, 1)
        self.weekdays = _weekdays(dow)
        self.zone = ZoneInfo(timezone)

    def of_day(self, day: date) -> list[datetime]:
        if day.month not in self.months or day.weekday() not in self.weekdays or not _days(self.dom, day):
            return []
        local = (
            datetime(day.year, day.month, day.day, h, m, s, tzinfo=self.zone)
            for h in self.hours for m in self.minutes for s in self.seconds
        )
        return sorted({t.astimezone(UTC) for t in local})

    def between(self, start: datetime, end: datetime) -> list[datetime]:
        """Instants in [start, end)."""
        day, found = start.astimezone(self.zone).date(), []
        while day <= end.astimezone(self.zone).date():
            found += [t for t in self.of_day(day) if start <= t < end]
            day += timedelta(days=1)
        return found

    def _step(self, at: datetime, days: int):
        day = at.astimezone(self.zone).date()
        for _ in range(self.REPEAT):
            yield self.of_day(day)
            if day in (date.min, date.max):
                return
            day += timedelta(days=days)

    def after(self, at: datetime) -> datetime | None:
        """First instant after ``at``."""
        return next((t for times in self._step(at, 1) for t in times if t > at), None)

    def upto(self, at: datetime) -> datetime | None:
        """Last instant at or before ``at``."""
        return next((t for times in self._step(at, -1) for t in reversed(times) if t <= at), None)


def fire_times(expression: str, start: datetime, end: datetime, timezone: str = "UTC") -> list[datetime]:
    """UTC instants in [start, end) at which the expression fires, in order."""
    return Schedule(expression, timezone).between(start.replace(tzinfo=UTC), end.replace(tzinfo=UTC))


def day_filter(schedule: Schedule, day):
    """Whether the schedule fires on a date column."""
    hit = F.month(day).isin(*sorted(schedule.months)) & F.weekday(day).isin(*sorted(schedule.weekdays))
    if schedule.dom.upper() == "L":
        return hit & (day == F.last_day(day))
    if schedule.dom not in ("*", "?"):
        hit = hit & F.dayofmonth(day).isin(*sorted(_values(schedule.dom, 1, 31)))
    return hit


def instants(schedule: Schedule, days: DataFrame, day: str = "day") -> DataFrame:
    """``days`` with ``at``, each UTC instant the schedule names on a (local) day, once."""
    def every(values) -> Column:
        return F.explode(F.array(*[F.lit(v) for v in values]))

    on = days.filter(day_filter(schedule, F.col(day)))
    times = on.withColumn("_h", every(schedule.hours)).withColumn("_m", every(schedule.minutes)).withColumn("_s", every(schedule.seconds))
    seconds = F.unix_date(day).cast("bigint") * 86_400 + F.col("_h") * 3_600 + F.col("_m") * 60 + F.col("_s")
    at = F.to_utc_timestamp(F.timestamp_seconds(seconds), schedule.zone.key)
    # two local times may be one instant where a clock jumps
    return times.select(*days.columns, at.alias("at")).dropDuplicates([*days.columns, "at"])
