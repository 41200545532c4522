"""Date and time functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def nth_weekday(month_start: Column, weekday: str, n: int) -> Column:
    """The n-th given weekday of the month that begins at month_start."""
    return F.date_add(F.next_day(F.date_sub(month_start, 1), weekday), 7 * (n - 1))


def sampling_days(months: DataFrame, hours: tuple[int, ...]) -> DataFrame:
    """Second Tuesday (weekday) and second Saturday (weekend) of each (year, month), at each hour."""
    base = months.select("year", "month").withColumn("start", F.make_date("year", "month", F.lit(1)))
    days = F.array(
        F.struct(nth_weekday(F.col("start"), "Tue", 2).alias("sample_date"), F.lit("weekday").alias("day_type")),
        F.struct(nth_weekday(F.col("start"), "Sat", 2).alias("sample_date"), F.lit("weekend").alias("day_type")),
    )
    opened = base.select("year", "month", F.inline(days))
    return opened.withColumn("requested_hour", F.explode(F.array(*[F.lit(h) for h in hours]))).withColumn("time_block", time_block(F.col("requested_hour") * 100))


def sampling_design(spark: SparkSession, year: int, months: tuple[int, ...], hours: tuple[int, ...]) -> DataFrame:
    """``sampling_days`` of some months of one year."""
    return sampling_days(spark.createDataFrame([(year, m) for m in months], "year int, month int"), hours)


def minutes_of(hhmm: Column) -> Column:
    return F.floor(hhmm / 100) * 60 + hhmm % 100


def minutes_apart(a: Column, b: Column) -> Column:
    return F.abs(minutes_of(a) - minutes_of(b))


def time_block(hhmm: Column) -> Column:
    return F.when(hhmm < 1000, "am").when(hhmm < 1600, "midday").otherwise("pm")


def service_seconds(text: Column) -> Column:
    """HH:MM:SS with hours that may pass 23, as seconds; null where it is no such text."""
    part = lambda i: F.regexp_extract(F.coalesce(text, F.lit("")), r"^\s*(\d+):(\d{1,2}):(\d{1,2})\s*$", i).try_cast("int")
    return part(1) * 3600 + part(2) * 60 + part(3)


def active_services(calendar: DataFrame, exceptions: DataFrame, day: str) -> DataFrame:
    """service_id active on a date: weekly pattern, plus exceptions of type 1, minus those of type 2 (removal wins)."""
    date = F.lit(day).cast("date")
    names = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
    runs = F.lit(False)
    for i, name in enumerate(names):
        runs = runs | ((F.weekday(date) == i) & (F.col(name) == 1))
    base = calendar.where((F.col("start_date") <= date) & (F.col("end_date") >= date) & runs).select("service_id")
    of_day = exceptions.where(F.col("date") == date)
    added = of_day.where("exception_type = 1").select("service_id")
    return base.union(added).distinct().join(of_day.where("exception_type = 2").select("service_id"), "service_id", "left_anti")


def lenient_timestamp(text: Column) -> Column:
    return F.try_to_timestamp(text)


def archive_timestamp(text: Column) -> Column:
    """YYYYMMDD-HHMM, hyphen optional, as a timestamp."""
    return F.try_to_timestamp(F.regexp_replace(text, "-", ""), F.lit("yyyyMMddHHmm"))


def date_in_name(name: Column) -> Column:
    """A date written YYYYMMDD or YYYY-MM-DD in a file name; null outside plausible ranges."""
    part = lambda i: F.regexp_extract(name, r"((?:19|20)\d{2})[-_]?(0[1-9]|1[0-2])[-_]?([0-3]\d)", i)
    return F.try_to_date(F.concat(part(1), part(2), part(3)), "yyyyMMdd")
