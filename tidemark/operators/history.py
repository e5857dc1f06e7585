"""Run histories: running bests, values carried from them, resampled curves, ranks of methods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _upto(by: Sequence[str], order: Sequence):
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def running_best(df: DataFrame, by: Sequence[str], order: Sequence, value: str) -> DataFrame:
    """Adds ``best``: the largest value so far; zero and null candidates are left out first."""
    return df.where(F.col(value) > 0).withColumn("best", F.max(value).over(_upto(by, order)))


def value_at_best(df: DataFrame, by: Sequence[str], order: Sequence, value: str, paired: str) -> DataFrame:
    """Adds ``best`` and ``at_best``, the paired value of the row that set it; rows without one set no best."""
    both = df.where(F.col(value).isNotNull() & F.col(paired).isNotNull())
    w = Window.partitionBy(*by).orderBy(*order)
    before = F.max(value).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = both.withColumn("_new", F.when(before.isNull() | (F.col(value) > before), F.col(paired)))
    return marked.withColumns({"best": F.max(value).over(_upto(by, order)), "at_best": F.last("_new", True).over(_upto(by, order))}).drop("_new")


def accept_history(df: DataFrame, by: Sequence[str], order: Sequence, value: str, carry: Sequence[str] = ()) -> DataFrame:
    """Adds accepted, best, delta and the carried columns of the last accepted row (``accepted_<name>``)."""
    w = Window.partitionBy(*by).orderBy(*order)
    before = F.max(value).over(w.rowsBetween(Window.unboundedPreceding, -1))
    out = df.withColumn("_before", before).withColumn("accepted", F.col("_before").isNull() | (F.col(value) > F.col("_before")))
    out = out.withColumns({"best": F.greatest("_before", value), "delta": F.col(value) - F.col("_before")}).drop("_before")
    return out.withColumns({f"accepted_{c}": F.last(F.when(F.col("accepted"), F.col(c)), True).over(_upto(by, order)) for c in carry})


def resample(df: DataFrame, by: Sequence[str], order: str, value: str, points: int = 11) -> DataFrame:
    """(by, point, value): each series at evenly spaced places by linear interpolation; one-point series are constant."""
    series = df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("x"), F.col(value).cast("double").alias("y")))).alias("s"))
    rows = series.select(*by, "s", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"))
    at = F.col("point") / F.lit(float(max(points - 1, 1))) * (F.size("s") - 1)
    low = F.floor(at).cast("int")
    y = lambda i: F.get("s", i)["y"]
    return rows.select(*by, "point", (y(low) + (at - low) * (y(F.least(low + 1, F.size("s") - 1)) - y(low))).alias(value))


def mean_curve(resampled: DataFrame, method: str, value: str) -> DataFrame:
    return resampled.groupBy(method, "point").agg(F.avg(value).alias(value))


def rank_methods(df: DataFrame, method: str, value: str) -> DataFrame:
    """Methods by mean value; the ranking orders one row per method."""
    means = df.groupBy(method).agg(F.avg(value).alias("mean"))
    return means.withColumn("rank", F.rank().over(Window.orderBy(F.desc("mean"))))


def score_matrix(df: DataFrame, feature: str, method: str, value: str, methods: Sequence[str]) -> DataFrame:
    """One row for each feature with the mean score of each named method, and the first method of the best score as ``best``."""
    wide = df.groupBy(feature).pivot(method, list(methods)).agg(F.avg(value))
    top = F.greatest(*methods) if len(methods) > 1 else F.col(methods[0])
    return wide.withColumn("best", F.coalesce(*[F.when(F.col(m) == top, F.lit(m)) for m in methods]))


def prompt_lengths(df: DataFrame, by: Sequence[str], prompt: str) -> DataFrame:
    """(by, words, characters): means over the prompts; a null prompt counts for nothing."""
    words = F.size(F.filter(F.split(prompt, r"\s+"), lambda w: w != ""))
    known = df.where(F.col(prompt).isNotNull())
    return known.groupBy(*by).agg(F.avg(words).alias("words"), F.avg(F.length(prompt)).alias("characters"))


def consensus(df: DataFrame, feature: str, method: str, value: str, eps: float = 1e-6) -> DataFrame:
    return df.groupBy(feature).agg(F.avg(value).alias("mean"), (F.max(value) - F.min(value) > eps).alias("disagree"), F.count_distinct(method).alias("methods"))


def weighted_curve(df: DataFrame, by: Sequence[str], value: str, weight: str) -> DataFrame:
    return df.groupBy(*by).agg((F.sum(F.col(value) * F.col(weight)) / F.nullif(F.sum(weight), F.lit(0))).alias(value))


def best_of_wide(df: DataFrame, key: str, prompts: Sequence[str], scores: Sequence[str], fallback: str) -> DataFrame:
    """(key, prompt, score): the prompt with the best numeric score, the first of equals; without any, the fallback column."""
    pairs = F.array(*[F.struct(F.col(s).try_cast("double").alias("score"), F.lit(-i).alias("at"), F.col(p).alias("prompt")) for i, (p, s) in enumerate(zip(prompts, scores))])
    best = F.array_max(F.filter(pairs, lambda x: x["score"].isNotNull() & x["prompt"].isNotNull()))
    return df.select(key, F.coalesce(best["prompt"], F.col(fallback)).alias("prompt"), best["score"].alias("score"))


def wide_to_long(df: DataFrame, keys: Sequence[str], pattern: str, value: str) -> DataFrame:
    """Columns whose name has a number after # become rows ordered by it."""
    import re

    cols = {c: int(m[1]) for c in df.columns if (m := re.search(pattern, c))}
    pairs = F.array(*[F.struct(F.lit(n).alias("number"), F.col(f"`{c}`").cast("string").alias(value)) for c, n in sorted(cols.items(), key=lambda x: x[1])])
    return df.select(*keys, F.explode(pairs).alias("_p")).select(*keys, "_p.*")


def runs_in_all(df: DataFrame, method: str, dataset: str) -> DataFrame:
    """Methods present in every dataset."""
    n = df.select(dataset).distinct().count()
    return df.groupBy(method).agg(F.count_distinct(dataset).alias("_n")).where(F.col("_n") == n).select(method)
