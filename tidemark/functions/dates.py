"""Dates as column expressions: lenient parsing, windows, blocks of time and study periods."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "M/d/yyyy H:mm", "M/d/yyyy", "M/d/yy", "MMddyyyy")


def parse_mixed(text: Column, formats: tuple[str, ...] = FORMATS) -> Column:
    """The first format that fits gives the timestamp; null where none does."""
    return F.coalesce(*[F.try_to_timestamp(F.trim(text), F.lit(f)) for f in formats])


def in_window(at: Column, start: Column | None = None, end: Column | None = None) -> Column:
    """Half-open range test; an end that is None is open."""
    tests = ([at >= start] if start is not None else []) + ([at < end] if end is not None else [])
    return reduce(lambda a, b: a & b, tests, at.isNotNull())


def micros(at: Column) -> Column:
    """Microseconds since 1970 of a timestamp with or without time zone, or a date."""
    return F.unix_micros(at.cast("timestamp"))


def days_between(later: Column, earlier: Column) -> Column:
    """Exact days, fractions included, between two timestamps."""
    return (micros(later) - micros(earlier)) / F.lit(86_400_000_000.0)


def age_at(birth: Column, at: Column) -> Column:
    return F.datediff(at, birth) / F.lit(365.25)


def age_decade(age: Column) -> Column:
    return (F.floor(age / 10) * 10).cast("int")


def time_blocks(df: DataFrame, date: str, index: str, months: int | None = None, weeks: int | None = None) -> DataFrame:
    """Adds block, block_start, block_end: calendar-month or week blocks that count from the index date."""
    if (months is None) == (weeks is None):
        raise ValueError("give months or weeks")
    if weeks:
        block = F.floor(days_between(F.col(date), F.col(index)) / (7.0 * weeks)).cast("int")
        start = F.col(index) + F.make_interval(days=F.col("block") * 7 * weeks)
        end = F.col(index) + F.make_interval(days=(F.col("block") + 1) * 7 * weeks)
    else:
        block = F.floor(F.months_between(date, index) / float(months)).cast("int")
        start, end = F.add_months(index, F.col("block") * months), F.add_months(index, (F.col("block") + 1) * months)
    return df.withColumn("block", block).withColumns({"block_start": start, "block_end": end})


def classify_period(date: Column, index: Column, days: float = 730.0) -> Column:
    """pre_index up to the index, treatment before index + days, outcome from there on."""
    gap = days_between(date, index)
    return F.when(gap <= 0, "pre_index").when(gap < days, "treatment").when(gap >= days, "outcome")


def forced_period(feature: Column, period: Column, forced: dict[str, str]) -> Column:
    """The period of a record, but for features that always belong to one."""
    out = period
    for name, always in forced.items():
        out = F.when(feature == name, always).otherwise(out)
    return out


def repair_mmddyyyy(text: Column) -> Column:
    """Answers such as 13052020 or 0503 2020: eight digits as month, day, year; sentinel U and X become null."""
    digits = F.regexp_replace(text, r"\D", "")
    whole = F.when(F.length(digits) == 8, F.try_to_timestamp(digits, F.lit("MMddyyyy")))
    return F.when(~F.upper(F.trim(text)).isin("U", "X"), whole)
