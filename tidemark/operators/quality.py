"""Checks after a run: one row per check with the number of failures, in one pass per table where aggregates allow it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Check:
    """A row-wise condition that must not be false; null counts as a failure unless ``null_ok``."""

    name: str
    condition: Column
    severity: str = "hard"
    null_ok: bool = False


def required(name: str) -> Check:
    return Check(f"required:{name}", F.col(name).isNotNull())


def domain(name: str, values: Sequence, severity: str = "hard") -> Check:
    return Check(f"domain:{name}", F.col(name).isin(*values), severity, True)


def non_negative(name: str) -> Check:
    return Check(f"non_negative:{name}", F.col(name) >= 0, "hard", True)


def expect(df: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """(check, severity, failures), all checks in one scan."""
    aggs = [F.count_if(~F.coalesce(c.condition, F.lit(c.null_ok))).alias(f"c{i}") for i, c in enumerate(checks)]
    row = df.agg(*aggs)
    entries = F.array(*[F.struct(F.lit(c.name).alias("check"), F.lit(c.severity).alias("severity"), F.col(f"c{i}").alias("failures")) for i, c in enumerate(checks)])
    return row.select(F.explode(entries).alias("e")).select("e.*")


def unique(df: DataFrame, keys: Sequence[str], severity: str = "hard") -> DataFrame:
    extra = df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("failures"))
    return extra.select(F.lit("unique:" + ",".join(keys)).alias("check"), F.lit(severity).alias("severity"), "failures")


def reconcile(stored: DataFrame, recomputed: DataFrame, key: str, value: str, eps: float = 1e-9) -> DataFrame:
    """Entities whose stored value is missing, extra or different from a recomputed one."""
    both = stored.select(key, F.col(value).alias("_a")).join(recomputed.select(key, F.col(value).alias("_b")), key, "full")
    bad = F.coalesce(F.abs(F.col("_a") - F.col("_b")) > eps, ~F.col("_a").eqNullSafe(F.col("_b")))
    return both.agg(F.count_if(bad).alias("failures")).select(F.lit(f"reconcile:{value}").alias("check"), F.lit("hard").alias("severity"), "failures")


def null_rows(df: DataFrame, feature: str, by: Sequence[str], examples: int) -> DataFrame:
    """(by, n, examples): rows whose feature is null, counted by group, with how many of them the sample of ``examples`` a group shows."""
    lacking = df.where(F.col(feature).isNull())
    return lacking.groupBy(*by).agg(F.count("*").alias("n")).withColumn("examples", F.least("n", F.lit(examples).cast("long")))


def null_examples(df: DataFrame, feature: str, order: Sequence[str], n: int) -> DataFrame:
    """The first n rows whose feature is null (n is the sample's size); raises where there is none."""
    out = df.where(F.col(feature).isNull()).orderBy(*order).limit(n)
    if not out.take(1):
        raise ValueError(f"no row lacks {feature}")
    return out
