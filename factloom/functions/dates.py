"""Calendar helpers over dates."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def quarter_end(d: Column) -> Column:
    return F.last_day(F.add_months(F.date_trunc("quarter", d).cast("date"), 2))


def month_index(d: Column) -> Column:
    return F.year(d) * 12 + F.month(d) - 1


def quarter_index(d: Column) -> Column:
    return F.year(d) * 4 + F.quarter(d) - 1


def day_number(d: Column) -> Column:
    return F.year(d) * 10_000 + F.month(d) * 100 + F.day(d)


def business_days_between(start: Column, end: Column) -> Column:
    """Weekdays after ``start`` up to ``end``, in closed form: whole weeks, and the days of the part week."""
    upto = lambda d: _weekdays(F.date_diff(d, F.lit("1970-01-05").cast("date")))
    return (upto(F.date_add(end, 1)) - upto(F.date_add(start, 1))).cast("long")


def _weekdays(n: Column) -> Column:
    """Weekdays among the n days from a Monday."""
    return F.floor(n / 7) * 5 + F.least(F.pmod(n, F.lit(7)), F.lit(5))


def congress_of_year(y: Column) -> Column:
    return F.floor((y - 1787) / 2)


def year_fraction(d: Column) -> Column:
    first = F.make_date(F.year(d), F.lit(1), F.lit(1))
    return F.year(d) + F.date_diff(d, first) / F.date_diff(F.make_date(F.year(d) + 1, F.lit(1), F.lit(1)), first)


#: Months of each longer frequency.
MONTHS = {"monthly": 1, "quarterly": 3, "annual": 12}
UNITS = {"daily": "day", "weekly": "week", "monthly": "month", "quarterly": "quarter", "annual": "year"}


def period_start(d: Column, frequency: str) -> Column:
    """First day of the day, ISO week, month, quarter or year."""
    return F.date_trunc(UNITS[frequency], d).cast("date")


def period_end(start: Column, frequency: str) -> Column:
    """Exclusive end of a period that begins at ``start``; longer ones end on the first of a month."""
    if frequency in MONTHS:
        return period_end_day(start, MONTHS[frequency])
    return F.date_add(start, 1 if frequency == "daily" else 7)


def period_end_day(start: Column, months: Column | int = 1) -> Column:
    """First day of the month ``months`` after that of ``start``."""
    return F.add_months(F.date_trunc("month", start).cast("date"), months)


def month_end_after(d: Column, months: Column | int) -> Column:
    """Last day of the month ``months`` after that of ``d``."""
    return F.last_day(F.add_months(F.date_trunc("month", d).cast("date"), months))


def year_available(year: Column, lag_months: Column | int) -> Column:
    """When an annual value is out: the end of the month a lag after December."""
    return month_end_after(F.make_date(year, F.lit(12), F.lit(31)), lag_months)


def same_day_after(d: Column, months: Column | int) -> Column:
    """The same day of a later month, or its last day if that month is shorter."""
    return F.add_months(d, months)


def next_day(d: Column) -> Column:
    return F.date_add(d, 1)


def month_end(d: Column) -> Column:
    return F.last_day(d)


def congress_start_year(congress: Column) -> Column:
    return 1787 + 2 * congress


def congress_period(congress: Column) -> Column:
    """``struct(start, end)``: 3 January to 3 January two years later."""
    day = lambda y: F.make_date(y.cast("int"), F.lit(1), F.lit(3))
    return F.struct(day(congress_start_year(congress)).alias("start"), day(congress_start_year(congress) + 2).alias("end"))


def cycle_of(congress: Column) -> Column:
    """The two-year election cycle that runs with a Congress, named by its even year."""
    return congress_start_year(congress) + 1


def cycle_of_month(year: Column) -> Column:
    """The cycle of a calendar year: an odd year opens it."""
    return year + F.pmod(year, F.lit(2))


def flow_available_at(year: Column, lag_years: int) -> Column:
    """When annual flows are out: 31 January ``lag_years`` later."""
    return F.make_date((year + lag_years).cast("int"), F.lit(1), F.lit(31))


def month_label(index: Column) -> Column:
    """``YYYY-MM`` of a month index."""
    return F.format_string("%04d-%02d", F.floor(index / 12).cast("int"), (F.pmod(index, F.lit(12)) + 1).cast("int"))


def add_business_days(start: Column, count: Column) -> Column:
    """The day ``count`` weekdays after ``start``, in closed form; ``start`` itself for 0."""
    at = F.weekday(start)  # 0 is Monday
    base = F.when(at > 4, F.date_sub(start, (at - 4).cast("int"))).otherwise(start)  # from a weekend count as from its Friday
    place = F.least(at, F.lit(4)) + count
    return F.when(count <= 0, start).otherwise(F.date_add(base, (count + 2 * F.floor(place / 5)).cast("int")))
