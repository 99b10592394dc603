"""Julian days and date weights as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the Julian day number of 1970-01-01 at noon.
EPOCH = 2440588
# A window from below the first to above the second stands for no window.
NO_START, NO_END = 0.0, 1.0e7


def julian_day(date: Column) -> Column:
    """Julian day number of a date."""
    return F.datediff(date, F.lit("1970-01-01").cast("date")) + EPOCH


def image_jd(date: Column, second_of_day: Column) -> Column:
    """the day number with the share of the day."""
    return julian_day(date) + second_of_day / 86400


def window_jd(date: Column, end: bool = False) -> Column:
    """a window's first or last moment."""
    return julian_day(date) - 0.5 + (0.9999999 if end else 0.0)


def jd_to_date(jd: Column) -> Column:
    """the date of a Julian day."""
    return F.date_add(F.lit("1970-01-01").cast("date"), (F.floor(jd + 0.5) - EPOCH).cast("int"))


def normalise_time(second: Column) -> Column:
    """struct(day_shift, second): seconds of the day with the carry into days."""
    shift = F.floor(second / 86400)
    return F.struct(shift.cast("int").alias("day_shift"), (second - shift * 86400).alias("second"))


def multilook_start(second: Column, skew: Column, prf: Column, looks: Column) -> Column:
    """start time moved by the skew and to the middle of the looks, with carry."""
    return normalise_time(second + skew + 0.5 * (looks - 1) / prf)


def date_weight(jd1: Column, jd2: Column, start: Column, end: Column) -> Column:
    """from 0 to 1, how well the observation jd1..jd2 stands for the window start..end."""
    window, cover = end - start, (end - start) / (jd2 - jd1)
    low = F.when(cover < 1, cover).otherwise(1.0)
    return (
        F.when(F.abs(0.5 * (jd1 + jd2 + 1) - 0.5 * (start + end)) > window, 0.0)
        .when((end > NO_END) & (start <= NO_START), 1.0)
        .when((cover < 0.6) & (window > 12), 0.0)
        .when(cover < 0.49, 0.0)
        .when((jd1 >= start) & (jd2 <= end), 1.0)
        .when((jd1 >= start) & (jd1 <= end) & (jd2 >= end), (end - jd1) / (jd2 - jd1) * low)
        .when((jd1 <= start) & (jd2 >= start) & (jd2 <= end), (jd2 - start) / (jd2 - jd1) * low)
        .when((jd1 <= start) & (jd2 >= start), cover)
        .otherwise(0.0)
    )
