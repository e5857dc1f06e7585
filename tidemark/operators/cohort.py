"""Cohort building: index dates, arms, coverage, matched case-control pairs."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.dates import days_between
from tidemark.operators.matching import nearest_pairs
from tidemark.operators.ranks import ranked


def index_dates(facts: DataFrame, key: str, date: str, qualifies: Column) -> DataFrame:
    """(key, index_date): the first qualifying date."""
    return facts.where(qualifies).groupBy(key).agg(F.min(date).alias("index_date"))


def assign_arms(index: DataFrame, exposure: DataFrame, key: str, date: str, days: float) -> DataFrame:
    """(key, index_date, exposed, outside_only): exposed within [index, index + days), or only outside of it."""
    gap = days_between(F.col(date), F.col("index_date"))
    near = index.join(exposure.select(key, date), key, "left").groupBy(key, "index_date").agg(
        F.coalesce(F.bool_or((gap >= 0) & (gap < days)), F.lit(False)).alias("exposed"), (F.count(date) > 0).alias("_any"))
    return near.select(key, "index_date", "exposed", (~F.col("exposed") & F.col("_any")).alias("outside_only"))


def coverage_filter(index: DataFrame, notes: Sequence[DataFrame], key: str, date: str, days: float) -> DataFrame:
    """Entities whose latest note over all tables is later than index + days. Tables are reduced before they are united."""
    latest = None
    for n in notes:
        part = n.groupBy(key).agg(F.max(date).alias("_latest"))
        latest = part if latest is None else latest.unionByName(part)
    latest = latest.groupBy(key).agg(F.max("_latest").alias("_latest"))
    return index.join(latest, key).where(days_between(F.col("_latest"), F.col("index_date")) > days).drop("_latest")


def match_round(people: DataFrame, key: str, arm: str, exact: Sequence[str], number: str | None, caliper: float) -> DataFrame:
    """(case, control) of one round: equal ``exact`` columns, |number| within the caliper, each person at most once.

    Without ``number`` cases and controls of a key are numbered and zipped: any pair will do. With it, most pairs within the caliper
    and then least total distance (:mod:`tidemark.operators.matching`).
    """
    exact = list(exact)
    rows = people.where(" and ".join(f"`{c}` is not null" for c in [*exact, key, arm] + ([number] if number else [])))
    if number is None:
        numbered = ranked(rows.select(*exact, key, arm), [*exact, arm], [key], "_n")
        side = lambda k, name: numbered.where(F.col(arm) == k).select(*exact, "_n", F.col(key).alias(name))
        return side(1, "case").join(side(0, "control"), [*exact, "_n"]).select("case", "control")
    return nearest_pairs(rows, key, arm, exact, number, caliper)


def match(people: DataFrame, key: str, arm: str, features: Sequence[str], number: str | None = None, caliper: float = 5.0, least: int | None = None, folder: str | None = None) -> DataFrame:
    """(case, control, round): rounds from all features down to ``least``, with the number before without it; used people leave.

    Each round is written before the next one reads who is left, so the plan stays short and lost executors
    cost one round.
    """
    from tidemark.sources.tables import written

    left, out = people, None
    for n in range(len(features), (least if least is not None else len(features)) - 1, -1):
        for subset in combinations(features, n):
            for num in ([number, None] if number else [None]):
                pairs = match_round(left, key, arm, subset, num, caliper).withColumn("round", F.lit(f"{n}:{','.join(subset)}{':' + num if num else ''}"))
                pairs = written(pairs, "pairs", folder)
                out = pairs if out is None else out.unionByName(pairs)
                used = pairs.select(F.explode(F.array("case", "control")).alias(key))
                left = left.join(used, key, "left_anti")
    return out


def members(pairs: DataFrame, key: str) -> DataFrame:
    return pairs.select(F.explode(F.array(F.struct(F.col("case").alias(key), F.lit("case").alias("role")), F.struct(F.col("control").alias(key), F.lit("control").alias("role")))).alias("m")).select("m.*")


def followup(df: DataFrame, index: str, last: str, death: str, event: str, origin_days: int = 730) -> DataFrame:
    """Adds start, end, event, years: the clock starts at index + origin and ends at the event, else at death or last activity."""
    start = F.col(index) + F.make_interval(days=F.lit(origin_days))
    censor = F.coalesce(F.least(F.col(death), F.col(last)), F.col(last))
    out = df.withColumns({"start": start, "_hit": F.col(event).isNotNull() & (F.col(event) >= start)})
    end = F.when(F.col("_hit"), F.col(event)).otherwise(censor)
    return out.withColumns({"end": end, "had_event": F.col("_hit").cast("int")}).withColumn("years", days_between(F.col("end"), F.col("start")) / F.lit(365.25)).drop("_hit")


def follow_positive(df: DataFrame, years: str = "years") -> DataFrame:
    return df.where(F.col(years) > 0)


def closest_covariate(records: DataFrame, index: DataFrame, key: str, date: str, option: str, max_after: float = 90) -> DataFrame:
    """(key, option): options are given per (key, date); the nearest date up to index + max_after with a non-null one wins."""
    near = records.where(F.col(option).isNotNull()).join(index.select(key, "index_date"), key)
    gap = days_between(F.col(date), F.col("index_date"))
    return near.where(gap <= max_after).groupBy(key).agg(F.min_by(option, F.struct(F.abs(gap), F.col(date))).alias(option))
