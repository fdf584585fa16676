"""US stock market calendar as column rules: holidays, early closes, closing time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tapewright.functions.session import DAY_MS, HOUR_MS

# Unscheduled closures since 1994.
SPECIAL_CLOSURES = (
    "1994-04-27", "2001-09-11", "2001-09-12", "2001-09-13", "2001-09-14", "2004-06-11",
    "2007-01-02", "2012-10-29", "2012-10-30", "2018-12-05", "2025-01-09",
)


def _nth_weekday(d: Column, month: int, weekday: int, nth: int) -> Column:
    """True on the nth given weekday (1 = Sunday) of a month."""
    return (F.month(d) == month) & (F.dayofweek(d) == weekday) & (F.ceil(F.dayofmonth(d) / 7) == nth)


def _observed(d: Column, month: int, day: int) -> Column:
    """The date itself on a weekday, Friday before when it is a Saturday, Monday after when a Sunday."""
    on = lambda x: (F.month(x) == month) & (F.dayofmonth(x) == day)
    return (
        on(d)
        | (on(F.date_sub(d, 1)) & (F.dayofweek(d) == 2))
        | (on(F.date_add(d, 1)) & (F.dayofweek(d) == 6))
    )


def _easter(year: Column) -> Column:
    """Gregorian Easter Sunday (anonymous algorithm)."""
    q = lambda a, b: F.floor(a / b)
    a, b, c = year % 19, q(year, 100), year % 100
    h = (19 * a + b - q(b, 4) - q(b - q(b + 8, 25) + 1, 3) + 15) % 30
    ll = (32 + 2 * (b % 4) + 2 * q(c, 4) - h - c % 4) % 7
    m = q(a + 11 * h + 22 * ll, 451)
    n = h + ll - 7 * m + 114
    return F.make_date(year, q(n, 31).cast("int"), (n % 31 + 1).cast("int"))


def is_holiday(d: Column) -> Column:
    new_year = ((F.month(d) == 1) & (F.dayofmonth(d) == 1)) | (
        (F.month(d) == 1) & (F.dayofmonth(d) == 2) & (F.dayofweek(d) == 2)
    )
    memorial = (F.month(d) == 5) & (F.dayofweek(d) == 2) & (F.month(F.date_add(d, 7)) == 6)
    return (
        new_year
        | (_nth_weekday(d, 1, 2, 3) & (F.year(d) >= 1998))
        | _nth_weekday(d, 2, 2, 3)
        | (d == F.date_sub(_easter(F.year(d)), 2))
        | memorial
        | (_observed(d, 6, 19) & (F.year(d) >= 2022))
        | _observed(d, 7, 4)
        | _nth_weekday(d, 9, 2, 1)
        | _nth_weekday(d, 11, 5, 4)
        | _observed(d, 12, 25)
        | d.isin(*[F.lit(x).cast("date") for x in SPECIAL_CLOSURES])
    )


def is_trading_day(d: Column) -> Column:
    return ~F.dayofweek(d).isin(1, 7) & ~is_holiday(d)


def is_early_close(d: Column) -> Column:
    """13:00 close: the day after Thanksgiving, Christmas Eve, and 3 July before a weekday holiday."""
    july3 = (F.month(d) == 7) & (F.dayofmonth(d) == 3) & F.dayofweek(d).between(2, 5)
    xmas_eve = (F.month(d) == 12) & (F.dayofmonth(d) == 24)
    return is_trading_day(d) & (_nth_weekday(F.date_sub(d, 1), 11, 5, 4) | july3 | xmas_eve)


def with_calendar(df: DataFrame, date_col: str) -> DataFrame:
    """Calendar columns for a date column; close_ms is null on non-trading days."""
    d = F.col(date_col)
    trading, early = is_trading_day(d), is_early_close(d)
    return df.withColumns(
        {
            "trading_day": trading,
            "early_close": early,
            "close_ms": F.when(early, F.lit(13 * HOUR_MS)).when(trading, F.lit(16 * HOUR_MS)).cast("long"),
            "day_ms": F.datediff(d, F.lit("1970-01-01").cast("date")).cast("long") * DAY_MS,
        }
    )


def trading_days(spark: SparkSession, first: str, last: str) -> DataFrame:
    """One row per trading day in [first, last]."""
    days = spark.sql(f"SELECT explode(sequence(DATE'{first}', DATE'{last}')) AS date")
    return with_calendar(days, "date").filter("trading_day")


def missing_dates(available: DataFrame, days: DataFrame, date_col: str = "date") -> DataFrame:
    """Calendar days without data and why: 'missing' on trading days, 'non_trading' otherwise."""
    gaps = days.select(date_col).join(available.select(date_col).distinct(), date_col, "left_anti")
    return gaps.select(date_col, F.when(is_trading_day(F.col(date_col)), "missing").otherwise("non_trading").alias("reason"))
