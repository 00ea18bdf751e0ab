"""Exchange sessions, market status and business days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from barline.functions.numeric import col

# Full-day holidays and early closes of the US exchange, 2025-2028.
HOLIDAYS = """2025-01-01 2025-01-20 2025-02-17 2025-04-18 2025-05-26 2025-06-19 2025-07-04 2025-09-01 2025-11-27 2025-12-25
2026-01-01 2026-01-19 2026-02-16 2026-04-03 2026-05-25 2026-06-19 2026-07-03 2026-09-07 2026-11-26 2026-12-25
2027-01-01 2027-01-18 2027-02-15 2027-03-26 2027-05-31 2027-06-18 2027-07-05 2027-09-06 2027-11-25 2027-12-24
2028-01-17 2028-02-21 2028-04-14 2028-05-29 2028-06-19 2028-07-04 2028-09-04 2028-11-23 2028-12-25""".split()
EARLY_CLOSES = "2025-11-28 2025-12-24 2026-11-27 2026-12-24 2027-11-26 2027-12-24 2028-11-24 2028-12-24".split()

#: First and last year of the fixed values.
CALENDAR_YEARS = (2025, 2028)


def exchange_time(utc) -> Column:
    return F.from_utc_timestamp(col(utc), "America/New_York")


def korea_time(utc) -> Column:
    return F.from_utc_timestamp(col(utc), "Asia/Seoul")


def is_trading_day(day: Column) -> Column:
    return (F.weekday(day) < 5) & ~day.cast("string").isin(HOLIDAYS)


def session(utc) -> Column:
    """Session of an instant (UTC): overnight 20-04, pre 04-09:30, regular to 16 (13 on early
    closes), after hours to 20; closed on other days."""
    t = exchange_time(utc)
    day, minute = F.to_date(t), F.hour(t) * 60 + F.minute(t)
    close = F.when(day.cast("string").isin(EARLY_CLOSES), 780).otherwise(960)
    night = F.when(is_trading_day(day) | is_trading_day(F.date_sub(day, 1)), "overnight").otherwise("closed")
    return (F.when(minute < 240, night).when(~is_trading_day(day), "closed").when(minute < 570, "pre_market").when(minute < close, "regular").when(minute < 1200, "after_hours").otherwise("overnight"))


def korea_status(local) -> Column:
    """Market status from local Korean time alone."""
    t = col(local)
    m = F.hour(t) * 60 + F.minute(t)
    return F.when(F.weekday(t) >= 5, "closed").when(m < 540, "before_open").when(m < 930, "open").otherwise("after_close")


def reconcile_status(local, trade_date) -> Column:
    """Status checked against the last trade date: a weekday without today's trades is a holiday or
    stale, one without any date is unknown."""
    t, d = col(local), col(trade_date)
    on = (F.weekday(t) < 5) & (F.hour(t) >= 9)
    return F.when(on & d.isNull(), "unknown").when(on & (d < F.to_date(t)), "holiday_or_stale").otherwise(korea_status(t))


def project_sessions(df: DataFrame, start: str, sessions: str, out: str = "session_date") -> DataFrame:
    """The date ``sessions`` trading days after ``start``, and ``calendar_status``.

    Of any two weeks and more, half the days at least are trading days, so twice the sessions and two weeks are looked
    at. Holidays are known for the calendar's years only; a projection that starts or ends outside them is NULL with the
    status ``outside_calendar``.
    """
    reach = F.date_add(F.col(start), (F.col(sessions) * 2 + 14).cast("int"))
    days = F.filter(F.sequence(F.date_add(F.col(start), 1), reach), lambda d: is_trading_day(d))
    found = F.get(days, (F.col(sessions) - 1).cast("int"))
    first, last = (F.lit(f"{y}-{d}").cast("date") for y, d in ((CALENDAR_YEARS[0], "01-01"), (CALENDAR_YEARS[1], "12-31")))
    inside = (F.col(start) >= first) & (found <= last)
    return df.withColumn(out, F.when(inside, found)).withColumn("calendar_status", F.when(F.col(out).isNotNull(), "known").otherwise("outside_calendar"))
