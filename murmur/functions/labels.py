"""Time expressions: post-age labels, label spines, day spines, lookback."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from murmur.params import AGE_LABELS, DATE_LABELS


def hours_before(now: Column, hours: Column) -> Column:
    return now - F.make_dt_interval(F.lit(0), hours.cast("int"))


def wall_seconds(at: Column) -> Column:
    """Seconds from 1970 to a time without time zone, whatever the session's zone."""
    return F.unix_date(F.to_date(at)) * F.lit(86400).cast("bigint") + F.hour(at) * 3600 + F.minute(at) * 60 + F.floor(
        F.second(at)
    )


def age_label(now: Column, hours: Column) -> Column:
    """``1 hour ago``, ``N hours ago`` up to 23, then the day as ``Nov 29``."""
    return (
        F.when(hours == 1, F.lit("1 hour ago"))
        .when(hours.between(2, 23), F.concat(hours.cast("string"), F.lit(" hours ago")))
        .otherwise(F.date_format(hours_before(now, hours), "MMM d"))
    )


def post_time_label(at: Column, now: Column) -> Column:
    """The clock time for today's posts, ``1/5/24`` for earlier ones."""
    return F.when(F.to_date(at) == F.to_date(now), F.date_format(at, "hh:mm a")).otherwise(
        F.date_format(at, "M/d/yy")
    )


def age_label_hours(lookback: Column, labels: int = AGE_LABELS) -> Column:
    """Array of hours behind each label of the hour-based spine.

    Counts up by the hour while under 24, then by the day. Under 24 hours of
    lookback the first day step starts from 23 again, so 23 appears twice.
    """
    hourly = F.greatest(F.lit(24) - lookback, F.lit(0))
    return F.transform(
        F.sequence(F.lit(0), F.lit(labels - 1)),
        lambda i: F.when(i < hourly, lookback + i).otherwise(
            F.greatest(lookback, F.lit(23)) + (i - hourly) * 24
        ),
    )


def post_time_spine(now: Column, lookback: Column, days: int = DATE_LABELS) -> Column:
    """Array of times to look for, newest first.

    Today: every minute back to midnight. An earlier day: one per day.
    """
    start = hours_before(now, lookback)
    minutes = F.hour(start) * 60 + F.minute(start)
    today = F.to_date(start) == F.to_date(now)
    last = F.when(today, minutes).otherwise(F.lit(days - 1))
    step = F.when(today, F.lit(1)).otherwise(F.lit(24 * 60))
    return F.transform(
        F.sequence(F.lit(0), last),
        lambda i: start - F.make_dt_interval(F.lit(0), F.lit(0), i * step),
    )


def days_apart(start: Column, end: Column) -> Column:
    return F.abs(F.datediff(start, end))


def day_spine(start: Column, end: Column) -> Column:
    """Array of days, both ends included."""
    return F.sequence(start, end, F.expr("interval 1 day"))


def extra_lookback_hours(day: Column, day_before_is_holiday: Column) -> Column:
    """Hours to add so that a weekend or holiday before ``day`` is covered."""
    weekday = F.weekday(day)  # Monday is 0
    weekend = F.when(weekday == 0, 48).otherwise(0)
    holiday = F.when(day_before_is_holiday, F.when(weekday == 1, 48).otherwise(24)).otherwise(0)
    return weekend + holiday
