"""As-of, nearest-date and interval joins: equality on the entity, dates as predicates or orderings of an aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.dates import days_between, micros


def latest_before(facts: DataFrame, index: DataFrame, key: str, date: str, value: str, index_date: str = "index_date", cutoff_days: float = 0, tie: str | None = None, low: float | None = None, high: float | None = None) -> DataFrame:
    """(key, value, date): each entity's latest plausible value up to index + cutoff; entities without one are absent."""
    near = facts.join(index.select(key, index_date), key).where(days_between(F.col(date), F.col(index_date)) <= cutoff_days).where(F.col(value).isNotNull())
    if low is not None:
        near = near.where(F.col(value) >= low)
    if high is not None:
        near = near.where(F.col(value) <= high)
    order = F.struct(date, *([tie] if tie else [value]))
    return near.groupBy(key).agg(F.max_by(value, order).alias(value), F.max(date).alias(date))


def nearest(facts: DataFrame, index: DataFrame, key: str, date: str, value: str, index_date: str = "index_date", max_after: float | None = None, tie: str | None = None) -> DataFrame:
    """(key, value): the non-null value nearest to the index date in absolute time; the earlier date, then ``tie``, breaks ties."""
    near = facts.join(index.select(key, index_date), key).where(F.col(value).isNotNull())
    gap = micros(F.col(date)) - micros(F.col(index_date))
    if max_after is not None:
        near = near.where(gap <= int(max_after * 86_400_000_000))
    return near.groupBy(key).agg(F.min_by(value, F.struct(F.abs(gap), F.col(date), F.col(tie or value))).alias(value))


def within_days(left: DataFrame, right: DataFrame, key: str, left_date: str, right_date: str, before: float, after: float) -> DataFrame:
    """Pairs of an entity's rows with left - before <= right < left + after (in days).

    Time is cut into buckets as wide as the window: a left row looks into the two or three that its window touches, so a
    busy entity's rows meet only those nearby.
    """
    day = 86_400_000_000
    width = max(1, int((before + after) * day))
    at, low, high = micros(F.col(left_date)), int(before * day), int(after * day)
    bucket = lambda x: F.floor(x / F.lit(width)).cast("long")
    near = left.withColumn("_bucket", F.explode(F.sequence(bucket(at - low), bucket(at + high))))
    gap = micros(F.col(right_date)) - at
    return near.join(right.withColumn("_bucket", bucket(micros(F.col(right_date)))), [key, "_bucket"]).where((gap >= -low) & (gap < high)).drop("_bucket")
