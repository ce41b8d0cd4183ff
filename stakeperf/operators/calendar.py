"""Business-day calendars.

Four forms of "add n business days":

* weekends only -- closed-form Column arithmetic
  (``stakeperf.functions.calendar``), no join at all;
* with holidays -- ``holiday_shifts``: the closed form, and a row for each
  holiday that leads past it; no calendar window, so any date can be shifted;
* with holidays and any n -- ``BusinessDays``: the sorted holidays as a literal
  array, looked up by binary search; no join, no shuffle;
* over a given window of days -- a ``calendar`` table ``(date, is_biz, next_biz, prev_biz)``
  built once for a bounded date window and broadcast.  Its size is the number
  of days in the window, checked before it is built, so the broadcast is
  bounded by configuration, never by the data volume.  A date outside the
  window maps to NULL, which drives the callers' fallbacks.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stakeperf.functions.calendar import is_weekend, next_weekday, prev_weekday

MAX_CALENDAR_DAYS = 200 * 366


def build_calendar(spark: SparkSession, start: date, end: date,
                   holidays: DataFrame | None = None, name: str = "default") -> DataFrame:
    """Calendar rows for every day of [start, end]."""
    days = (end - start).days + 1
    if days <= 0 or days > MAX_CALENDAR_DAYS:
        raise ValueError(f"calendar window of {days} days is out of bounds")
    base = spark.range(1).select(
        F.lit(name).alias("calendar"),
        F.explode(F.sequence(F.lit(start), F.lit(end))).alias("date"))
    if holidays is not None:
        hol = holidays.select(F.col("date").cast("date").alias("date")).distinct().withColumn("_hol", F.lit(True))
        base = base.join(F.broadcast(hol), "date", "left")
    else:
        base = base.withColumn("_hol", F.lit(None).cast("boolean"))
    cal = base.withColumn("is_biz", ~is_weekend("date") & F.col("_hol").isNull()).drop("_hol")
    biz = F.when(F.col("is_biz"), F.col("date"))
    after = Window.partitionBy("calendar").orderBy("date").rowsBetween(1, Window.unboundedFollowing)
    before = Window.partitionBy("calendar").orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    return cal.select("date", "is_biz",
                      F.min(biz).over(after).alias("next_biz"),
                      F.max(biz).over(before).alias("prev_biz"))


def holiday_shifts(holidays: DataFrame) -> DataFrame:
    """(holiday, next_biz, prev_biz) of every holiday that is a weekday.

    A date's next weekday is closed-form; only where that is a holiday does the
    shift go on.  Weekdays are numbered, so holidays on neighbouring weekdays
    form a run (number minus rank), and the shift leads past the run's end.
    The result has a row per holiday, whatever dates it is used for; the one
    window orders the holidays, which are configuration."""
    days = holidays.select(F.col("date").cast("date").alias("holiday")).where(F.col("holiday").isNotNull() & ~is_weekend("holiday")).distinct()
    since = F.datediff("holiday", F.lit(date(1970, 1, 5)))  # a Monday
    number = F.floor(since / 7) * 5 + F.pmod(since, F.lit(7))
    run = number - F.row_number().over(Window.orderBy("holiday"))
    days = days.withColumn("_run", run)
    ends = days.groupBy("_run").agg(next_weekday(F.max("holiday")).alias("next_biz"), prev_weekday(F.min("holiday")).alias("prev_biz"))
    return days.join(ends, "_run").select("holiday", "next_biz", "prev_biz")


_MONDAY = date(1970, 1, 5)


@dataclass(frozen=True)
class BusinessDays:
    """Weekdays without holidays, as a rank and select index.

    Weekdays are numbered from a Monday on.  ``holidays`` holds the numbers of the
    holidays among them, sorted.  A day's rank is the number of weekdays up to it less
    that of holidays up to it; the day of a given rank is found from the ranks at
    which the holidays lie.  Both are counts in a sorted literal array, a binary search
    of log2(holidays) steps a row.  Any date of the range of dates can be shifted."""

    holidays: tuple[int, ...] = ()

    @classmethod
    def of(cls, days: Iterable[date]) -> BusinessDays:
        numbers = set()
        for d in days:
            if d is not None and (since := (d - _MONDAY).days) % 7 < 5:
                numbers.add(since // 7 * 5 + since % 7)
        return cls(tuple(sorted(numbers)))

    @classmethod
    def from_table(cls, holidays: DataFrame) -> BusinessDays:
        """From a table with a ``date`` column.  Holidays are configuration: the dates
        come to the driver, and a table beyond ``MAX_CALENDAR_DAYS`` is refused."""
        rows = holidays.select(F.col("date").cast("date").alias("date")).distinct().limit(MAX_CALENDAR_DAYS + 1).collect()
        if len(rows) > MAX_CALENDAR_DAYS:
            raise ValueError(f"more than {MAX_CALENDAR_DAYS} holidays")
        return cls.of(r["date"] for r in rows)

    @staticmethod
    def _up_to(numbers: list[int], x: Column) -> Column:
        """How many of the sorted numbers are at most ``x``."""
        if not numbers:
            return F.lit(0)
        array = F.array(*[F.lit(k) for k in numbers])
        steps = [1 << k for k in reversed(range(len(numbers).bit_length()))]

        def step(n: Column, s: Column) -> Column:
            return F.when((n + s <= len(numbers)) & (F.get(array, n + s - 1) <= x), n + s).otherwise(n)

        return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), step)

    def shift(self, column: Column | str, n: int) -> Column:
        """The n-th business day after the date, or for negative n before it."""
        if n == 0:
            raise ValueError("a shift by no days is not defined")
        d = F.col(column) if isinstance(column, str) else column
        since = F.datediff(d, F.lit(_MONDAY))
        weeks, day = F.floor(since / 7).cast("int"), F.pmod(since, F.lit(7))
        # the last weekday up to the date, or before it
        last = weeks * 5 + (F.least(day, F.lit(4)) if n > 0 else F.least(day, F.lit(5)) - 1)
        rank = last + 1 - self._up_to(list(self.holidays), last) + (n if n > 0 else n + 1)
        number = rank - 1 + self._up_to([h - i for i, h in enumerate(self.holidays)], rank - 1)
        days = F.floor(number / 5).cast("int") * 7 + F.pmod(number, F.lit(5))
        return F.date_add(F.lit(_MONDAY), days)


def add_bizdays(df: DataFrame, column: str, n: int, out: str, calendar: DataFrame | BusinessDays | None = None) -> DataFrame:
    """``out`` = ``column`` shifted by ``n`` business days; ``calendar``: ``BusinessDays``
    (any n), or for n = +1 or -1 a table from ``holiday_shifts`` or ``build_calendar``."""
    if isinstance(calendar, BusinessDays):
        return df.withColumn(out, calendar.shift(column, n))
    if n not in (1, -1):
        raise ValueError("only one-day shifts are supported")
    if calendar is None:
        shifted = next_weekday(column) if n > 0 else prev_weekday(column)
        return df.withColumn(out, shifted)
    pick = "next_biz" if n > 0 else "prev_biz"
    if "holiday" in calendar.columns:
        near = next_weekday(column) if n > 0 else prev_weekday(column)
        lookup = calendar.select(F.col("holiday").alias("_cal_date"), F.col(pick).alias("_cal_shift"))
        return (df.withColumn("_near", near).join(lookup, F.col("_near") == F.col("_cal_date"), "left")
                .withColumn(out, F.coalesce("_cal_shift", "_near")).drop("_cal_date", "_cal_shift", "_near"))
    lookup = F.broadcast(calendar.select(F.col("date").alias("_cal_date"), F.col(pick).alias("_cal_shift")))
    return (df.join(lookup, F.col(column) == F.col("_cal_date"), "left")
            .withColumn(out, F.col("_cal_shift")).drop("_cal_date", "_cal_shift"))


def shift_dates(dates: DataFrame, column: str = "date", calendar: DataFrame | None = None) -> DataFrame:
    """Add ``is_weekend``, ``next_biz`` and ``prev_biz`` to a frame of dates."""
    out = dates.withColumn("is_weekend", is_weekend(column))
    out = add_bizdays(out, column, 1, "next_biz", calendar)
    return add_bizdays(out, column, -1, "prev_biz", calendar)


def redate(df: DataFrame, column: str, out: str, calendar: DataFrame | None = None) -> DataFrame:
    """The staking re-dating rule: a weekend date first moves to the next
    business day, then every date moves one business day back.  With
    weekends only, Saturday, Sunday and Monday all land on Friday."""
    tmp = add_bizdays(df, column, 1, "_next", calendar)
    tmp = tmp.withColumn("_fwd", F.when(is_weekend(column), F.col("_next")).otherwise(F.col(column)))
    return add_bizdays(tmp, "_fwd", -1, out, calendar).drop("_next", "_fwd")


def weekend_flags(df: DataFrame, keys: list[str], column: str = "date") -> DataFrame:
    """Distinct (keys, date) with a weekend flag."""
    return df.select(*keys, column).distinct().withColumn("is_weekend", is_weekend(column))
