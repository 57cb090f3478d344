"""Instants, windows and report periods."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Thresholds, window names and intervals that decide the result.
ACTIVE_BELOW_DAYS = 180
MAINTAINED_BELOW_DAYS = 365
WINDOW_RECENT = "0-6mo"
WINDOW_PREVIOUS = "6-12mo"
WINDOW_OLDER = "12mo+"
WINDOWS = [WINDOW_RECENT, WINDOW_PREVIOUS, WINDOW_OLDER]
MONTHLY = "monthly"
WEEKLY = "weekly"


def as_instant(value: Column | str) -> Column:
    """A timestamp column from a literal such as ``2024-05-01 10:00:00`` or a column."""
    return F.to_timestamp(F.lit(value)) if isinstance(value, str) else value


def rfc3339(instant: Column) -> Column:
    """UTC instant as text; the session time zone must be UTC."""
    return F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def elapsed_days(since: Column, now: Column) -> Column:
    """Whole days of 24 hours between two instants, never below 0 (``datediff`` counts midnights instead)."""
    return F.greatest(F.timestamp_diff("DAY", since, now), F.lit(0)).cast("int")


def activity_class(days: Column) -> Column:
    """Active, maintained or abandoned by age in days."""
    return (
        F.when(days < ACTIVE_BELOW_DAYS, F.lit("active"))
        .when(days < MAINTAINED_BELOW_DAYS, F.lit("maintained"))
        .otherwise(F.lit("abandoned"))
    )


def months_before(instant: Column, months: int) -> Column:
    """Same day of an earlier month, running over into the next month when that day does not exist.

    31 August minus 6 months is 2 or 3 March; ``add_months`` would clamp it to the end of February.
    """
    month_start = F.date_trunc("month", instant)
    return month_start - F.make_ym_interval(F.lit(0), F.lit(months)) + (instant - month_start)


def commit_window(instant: Column, now: Column) -> Column:
    """Age window of a commit; an unknown date is old."""
    return (
        F.when(instant >= months_before(now, 6), F.lit(WINDOW_RECENT))
        .when(instant >= months_before(now, 12), F.lit(WINDOW_PREVIOUS))
        .otherwise(F.lit(WINDOW_OLDER))
    )


def window_order(window: Column) -> Column:
    """1, 2, 3 for the windows in report order."""
    return F.array_position(F.array(*[F.lit(w) for w in WINDOWS]), window)


def _day_end(day: Column) -> Column:
    return F.to_timestamp(F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(" 23:59:59")))


def _first_day(since: Column, interval: str) -> Column:
    """First day named by a period bound, null when the text is not well formed."""
    if interval == MONTHLY:
        well_formed = since.rlike(r"^\d{4}-\d{2}$")
        return F.when(well_formed, F.to_date(F.try_to_timestamp(F.concat(since, F.lit("-01")))))
    well_formed = since.rlike(r"^\d{4}-\d{2}-\d{2}$")
    return F.when(well_formed, F.to_date(F.try_to_timestamp(since)))


def period_days(since: Column, until: Column, interval: str) -> Column:
    """Array of the days that name the periods, both bounds included; null when there can be none."""
    if interval not in (MONTHLY, WEEKLY):
        return F.lit(None).cast("array<date>")
    start, stop = _first_day(since, interval), _first_day(until, interval)
    step = F.expr("interval 1 month") if interval == MONTHLY else F.expr("interval 7 days")
    return F.when(start <= stop, F.sequence(start, stop, step))


def period_end(day: Column, interval: str) -> Column:
    """End of the period named by a day: 23:59:59 of that day, or of the last day of its month."""
    return _day_end(F.last_day(day) if interval == MONTHLY else day)


def period_label(end: Column, interval: str) -> Column:
    """Month, day or full instant, by interval."""
    if interval == MONTHLY:
        return F.date_format(end, "yyyy-MM")
    if interval == WEEKLY:
        return F.date_format(end, "yyyy-MM-dd")
    return rfc3339(end)


def first_period_covering(instant: Column, since: Column, interval: str) -> Column:
    """Number (from 1) of the first period that ends at or after the instant.

    A period ends at 23:59:59 sharp, so an instant within the last second of a day already belongs to
    the next day: shifting by one second less one microsecond moves it there. An unknown instant
    counts as older than everything.
    """
    day = F.to_date(instant + F.expr("interval '0.999999' second"))
    start = _first_day(since, interval)
    if interval == MONTHLY:
        steps = (F.year(day) - F.year(start)) * 12 + F.month(day) - F.month(start)
    else:
        steps = F.ceil(F.date_diff(day, start) / 7).cast("int")
    return F.greatest(F.coalesce(steps, F.lit(0)) + 1, F.lit(1))
