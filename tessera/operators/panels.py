"""Periods as plain values: a kind and a whole number since 1970, and panels of consecutive ones."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column

from tessera.functions import dates

_EPOCH = dt.date(1970, 1, 1)


@dataclass(frozen=True)
class Period:
    kind: str  # day, month, quarter, week
    index: int
    start_on: int = 1

    def _same(self, other: Period) -> None:
        if (self.kind, self.start_on) != (other.kind, other.start_on):
            raise ValueError("periods of different kinds can't be compared")

    def __lt__(self, other: Period) -> bool:
        self._same(other)
        return self.index < other.index

    def __le__(self, other: Period) -> bool:
        self._same(other)
        return self.index <= other.index

    @property
    def first_day(self) -> dt.date:
        if self.kind == "day":
            return _EPOCH + dt.timedelta(self.index)
        if self.kind == "week":
            return _EPOCH + dt.timedelta((self.index - 1) * 7 + (self.start_on + 3) % 7)
        months = self.index * (3 if self.kind == "quarter" else 1)
        return dt.date(1970 + months // 12, months % 12 + 1, 1)

    @property
    def start_timestamp(self) -> dt.datetime:
        return dt.datetime.combine(self.first_day, dt.time())

    @property
    def time_type(self) -> str:
        return f"week_start_on_{dates.WEEKDAYS[self.start_on - 1]}" if self.kind == "week" and self.start_on != 1 else self.kind

    @property
    def code(self) -> str:
        d = self.first_day
        if self.kind == "day":
            return f"D{d:%Y%m%d}"
        if self.kind == "week":
            return f"W{f'({self.start_on})' * (self.start_on != 1)}{d:%Y%m%d}"
        return f"M{d:%Y%m}" if self.kind == "month" else f"Q{d:%Y}{(d.month + 2) // 3:02d}"

    @property
    def label(self) -> str:
        d = self.first_day
        return {"day": f"{d:%Y-%m-%d}", "month": f"{d:%Y-%m}", "quarter": f"{d:%Y}-Q{(d.month + 2) // 3}", "week": f"Week of {d:%Y-%m-%d}"}[self.kind]

    def code_of(self, column: Column | str) -> Column:
        """The code of a timestamp's period of this kind."""
        if self.kind == "week":
            return dates.week_code(column, self.start_on)
        return {"day": dates.day_code, "month": dates.month_code, "quarter": dates.quarter_code}[self.kind](column)


def day(year: int, month: int, day_: int) -> Period:
    return Period("day", (dt.date(year, month, day_) - _EPOCH).days)


def month(year: int, month_: int) -> Period:
    return Period("month", (year - 1970) * 12 + month_ - 1)


def quarter(year: int, quarter_: int) -> Period:
    return Period("quarter", (year - 1970) * 4 + quarter_ - 1)


def week(year: int, month_: int, day_: int, start_on: int = 1) -> Period:
    """The week that holds the day; ``start_on``: its first weekday, Monday is 1."""
    days = (dt.date(year, month_, day_) - _EPOCH).days
    return Period("week", (days - (start_on + 3) % 7) // 7 + 1, start_on)


@dataclass(frozen=True)
class Panel:
    """All periods from ``start`` to ``end``, both included."""

    start: Period
    end: Period

    def __post_init__(self) -> None:
        self.start._same(self.end)

    def periods(self) -> list[Period]:
        return [Period(self.start.kind, i, self.start.start_on) for i in range(self.start.index, self.end.index + 1)]

    def codes(self) -> list[str]:
        return [p.code for p in self.periods()]

    def holds(self, p: Period) -> bool:
        return self.start <= p <= self.end
