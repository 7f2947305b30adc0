"""Date and time functions, and the string codes of periods: pure Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def str_to_timestamp(column: Column | str, fmt: str) -> Column:
    """Strict parsing; what doesn't fit is null. (Months beyond 12 don't roll over.)"""
    return F.try_to_timestamp(_col(column), F.lit(fmt))


def timestamp_to_str(column: Column | str, fmt: str, zone: str | Column | None = None) -> Column:
    """The timestamp as text in a zone, given as a name, an offset, or a column; the session's if null."""
    c, here = _col(column), F.current_timezone()
    zone = F.lit(zone) if zone is None or isinstance(zone, str) else zone
    return F.date_format(F.convert_timezone(here, F.coalesce(zone.cast("string"), here), c.cast("timestamp_ntz")).cast("timestamp"), fmt)


def year(c: Column | str) -> Column:
    return F.year(_col(c))


def month(c: Column | str) -> Column:
    return F.month(_col(c))


def quarter(c: Column | str) -> Column:
    return F.quarter(_col(c))


def day_of_month(c: Column | str) -> Column:
    return F.dayofmonth(_col(c))


def day_of_week(c: Column | str) -> Column:
    """1 is Monday."""
    return F.weekday(_col(c)) + 1


def hour(c: Column | str) -> Column:
    return F.hour(_col(c))


def day70(c: Column | str) -> Column:
    """Days since 1970-01-01."""
    return F.unix_date(_col(c).cast("date"))


def month70(c: Column | str) -> Column:
    """Months since January 1970."""
    return (F.year(_col(c)) - 1970) * 12 + F.month(_col(c)) - 1


def _n(n: int | Column | str) -> Column:
    return F.lit(n) if isinstance(n, int) else _col(n)


def plus_days(c: Column | str, n: int | Column | str) -> Column:
    """A timestamp, the time of day kept."""
    return _col(c).cast("timestamp") + F.make_dt_interval(_n(n))


def plus_weeks(c: Column | str, n: int | Column | str) -> Column:
    return plus_days(c, _n(n) * 7)


def plus_months(c: Column | str, n: int | Column | str) -> Column:
    """A timestamp; the day is at most the month's last."""
    return _col(c).cast("timestamp") + F.make_ym_interval(F.lit(0), _n(n))


def plus_years(c: Column | str, n: int | Column | str) -> Column:
    return plus_months(c, _n(n) * 12)


def day_code(c: Column | str) -> Column:
    return F.concat(F.lit("D"), F.date_format(_col(c), "yyyyMMdd"))


def month_code(c: Column | str) -> Column:
    return F.concat(F.lit("M"), F.date_format(_col(c), "yyyyMM"))


def quarter_code(c: Column | str) -> Column:
    return F.concat(F.lit("Q"), F.format_string("%04d%02d", F.year(_col(c)), F.quarter(_col(c))))


def week_code(c: Column | str, start: int = 1) -> Column:
    """The first day of the week, which begins on weekday ``start`` (1 is Monday)."""
    first = F.date_sub(_col(c).cast("date"), F.pmod(F.weekday(_col(c)) + 1 - start, F.lit(7)).cast("int"))
    return F.concat(F.lit("W" if start == 1 else f"W({start})"), F.date_format(first, "yyyyMMdd"))


_DAY = r"^D\d{8}$"
_MONTH = r"^M\d{6}$"
_QUARTER = r"^Q\d{4}0\d$"
_WEEK = r"^W(\(\d\))?\d{8}$"


def _bad(c: Column) -> Column:
    return F.raise_error(F.concat(F.lit("not a period code: "), F.coalesce(c, F.lit("null"))))


def _week_start(c: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(c, r"^W\((\d)\)", 1), F.lit("")).cast("int"), F.lit(1))


def _by_kind(c: Column, day: Column, month_: Column, quarter_: Column, week: Column) -> Column:
    return F.when(c.rlike(_DAY), day).when(c.rlike(_MONTH), month_).when(c.rlike(_QUARTER), quarter_).when(c.rlike(_WEEK), week)


def code_to_type(column: Column | str) -> Column:
    """day, month, quarter, week or week_start_on_<Day>; other codes and null raise an error."""
    c = _col(column)
    name = F.element_at(F.array(*map(F.lit, WEEKDAYS)), _week_start(c))
    return F.coalesce(_by_kind(c, F.lit("day"), F.lit("month"), F.lit("quarter"), F.when(_week_start(c) == 1, "week").otherwise(F.concat(F.lit("week_start_on_"), name))), _bad(c).cast("string"))


def _first_day(c: Column) -> Column:
    ymd = F.right(c, F.lit(8))
    y, two = F.substring(c, 2, 4).cast("int"), F.substring(c, 6, 2).cast("int")
    date = F.make_date(F.substring(ymd, 1, 4).try_cast("int"), F.substring(ymd, 5, 2).try_cast("int"), F.substring(ymd, 7, 2).try_cast("int"))
    return _by_kind(c, date, F.make_date(y, two, F.lit(1)), F.make_date(y, two * 3 - 2, F.lit(1)), date)


def code_to_timestamp(column: Column | str) -> Column:
    """Midnight of the period's first day."""
    c = _col(column)
    return F.coalesce(_first_day(c).cast("timestamp"), _bad(c).cast("timestamp"))


def week_index(date: Column, start: Column | int = 1) -> Column:
    start = F.lit(start) if isinstance(start, int) else start
    return (F.floor((F.unix_date(date) - (start + 3) % 7) / 7) + 1).cast("int")


def code_to_index(column: Column | str) -> Column:
    """Days, months, quarters or weeks since the one of 1970-01-01."""
    c = _col(column)
    d = _first_day(c)
    index = _by_kind(c, F.unix_date(d), month70(d), (F.year(d) - 1970) * 4 + F.quarter(d) - 1, week_index(d, _week_start(c)))
    return F.coalesce(index, _bad(c).cast("int"))


def code_to_label(column: Column | str) -> Column:
    """``2012-01-23``, ``2012-01``, ``2012-Q1`` or ``Week of 2012-02-27``."""
    c = _col(column)
    d = _first_day(c)
    day = F.date_format(d, "yyyy-MM-dd")
    return F.coalesce(_by_kind(c, day, F.date_format(d, "yyyy-MM"), F.concat(F.date_format(d, "yyyy"), F.lit("-Q"), F.quarter(d)), F.concat(F.lit("Week of "), day)), _bad(c).cast("string"))
