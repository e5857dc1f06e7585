"""Pooling of long feature records into one value per entity, and from long to wide."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.dates import classify_period, forced_period, repair_mmddyyyy


def majority(df: DataFrame, by: Sequence[str], value: str, position: str) -> DataFrame:
    """The most frequent value; of equally frequent ones that seen first. Counted per value before it is ranked."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"), F.min(position).alias("_first"))
    return counts.groupBy(*by).agg(F.min_by(value, F.struct(-F.col("_n"), F.col("_first"))).alias(value))


def any_equal(value: Column, wanted: str = "Yes") -> Column:
    return F.coalesce(F.bool_or(value == wanted), F.lit(False))


def highest_ranked(value: Column, position: Column, ranks: Sequence[str]) -> Column:
    """The value that comes last in ``ranks``; where none is ranked, the first seen."""
    rank = F.array_position(F.array(*map(F.lit, ranks)), value)
    return F.coalesce(F.max_by(value, F.when(rank > 0, rank)), F.min_by(value, position))


def earliest_date(value: Column, default: str = "X") -> Column:
    return F.coalesce(F.date_format(F.min(repair_mmddyyyy(value)), "MMddyyyy"), F.lit(default))


def latest_date(value: Column, default: str = "X") -> Column:
    return F.coalesce(F.date_format(F.max(repair_mmddyyyy(value)), "MMddyyyy"), F.lit(default))


def numeric_max(value: Column, default: str = "F") -> Column:
    return F.coalesce(F.max(value.try_cast("bigint")).cast("string"), F.lit(default))


def distinct_duration(value: Column) -> Column:
    """Sum of distinct positive durations; "0" where some are known but none is positive, "F" where all are unknown."""
    n = value.try_cast("bigint")
    total = F.sum_distinct(F.when(n > 0, n))
    return F.when(F.count(n) == 0, "F").otherwise(F.coalesce(total, F.lit(0)).cast("string"))


def course_count(date: Column, value: Column) -> Column:
    """Distinct days with a Yes."""
    return F.count_distinct(F.when(value == "Yes", F.to_date(date)))


RULES = {
    "any": lambda v, p, _: any_equal(v), "max": lambda v, p, _: numeric_max(v), "ranked": lambda v, p, ranks: highest_ranked(v, p, ranks),
    "earliest": lambda v, p, _: earliest_date(v), "latest": lambda v, p, _: latest_date(v), "duration": lambda v, p, _: distinct_duration(v), "mode": lambda v, p, _: F.mode(v, True),
    "known_mode": lambda v, p, how: known_mode(v, *how), "first_present": lambda v, p, how: first_present(v, *how),
}


def pool(long: DataFrame, by: Sequence[str], feature: str, value: str, position: str, spec: dict[str, tuple[str, Sequence[str]]]) -> DataFrame:
    """Each feature pooled by its rule: spec maps a feature to (rule, ranks). One aggregation by entity and feature, one aggregate for each different rule."""
    kinds: dict[tuple, list[str]] = {}
    for name, (rule, how) in spec.items():
        kinds.setdefault((rule, repr(how)), []).append(name)
    aggs, picked = [], []
    for i, ((rule, _), names) in enumerate(kinds.items()):
        mine = F.col(feature).isin(*names)
        aggs.append(RULES[rule](F.when(mine, F.col(value)), F.when(mine, F.col(position)), spec[names[0]][1]).cast("string").alias(f"_pooled_{i}"))
        picked.append(F.when(mine, F.col(f"_pooled_{i}")))
    return long.where(F.col(feature).isin(*spec)).groupBy(*by, feature).agg(*aggs).select(*by, feature, F.coalesce(*picked).alias(value))


def _grouped(custom: dict[str, Callable[[pd.DataFrame], str | None]], key: str, feature: str, value: str):
    """Rows that come by (key, feature), ``_number`` 1 at the first of each, as one row of the feature's function each."""

    def done(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        starts = np.flatnonzero(rows.column("_number").to_numpy() == 1)
        rows = rows.drop_columns("_number")
        # a null would turn a batch's numbers into floats; then each group is converted on its own
        frame = rows.to_pandas() if all(c.null_count == 0 or pa.types.is_string(c.type) for c in rows.columns) else None
        features, out = rows.column(feature).take(pa.array(starts)).to_pylist(), []
        for name, a, b in zip(features, starts.tolist(), [*starts[1:].tolist(), rows.num_rows]):
            got = custom[name](frame.iloc[a:b] if frame is not None else rows.slice(a, b - a).to_pandas())
            out.append(None if got is None else str(got))
        keys = rows.column(key).take(pa.array(starts)).combine_chunks()
        return pa.RecordBatch.from_arrays([keys, pa.array(features, pa.string()), pa.array(out, pa.string())], [key, feature, value])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # from the first row of a group on
        for batch in batches:
            first = np.flatnonzero(batch.column("_number").to_numpy() == 1)
            if len(first):
                cut = int(first[-1])  # the last group may go on
                if held or cut:
                    yield done([*held, batch.slice(0, cut)])
                held, batch = [], batch.slice(cut)
            if batch.num_rows:
                held.append(batch)
        if held:
            yield done(held)

    return run


def patient_row(long: DataFrame, key: str, feature: str, value: str, position: str, registry: Sequence[dict], own: dict[str, Callable[[pd.DataFrame], str | None]] | None = None) -> DataFrame:
    """One row for each entity with a column for each registered feature, pooled by its rule; ``default`` where an entity has no record of it.

    ``registry`` has rows {feature, rule, how (what the rule needs, if anything), default}. A rule that :data:`RULES` lacks is taken from ``own``: a
    function of the feature's different values with their number ``n`` and first position ``first``, of one entity. A rule that is in neither is an error.
    Entities without a record of any registered feature have a row of defaults; null keys are one entity.
    """
    own = own or {}
    unknown = sorted({r["rule"] for r in registry} - set(RULES) - set(own))
    if unknown:
        raise ValueError(f"unknown pooling rules: {unknown}")
    native = {r["feature"]: (r["rule"], r.get("how", ())) for r in registry if r["rule"] in RULES}
    custom = {r["feature"]: own[r["rule"]] for r in registry if r["rule"] not in RULES}
    parts = []
    if native:
        parts.append(pool(long, [key], feature, value, position, native).select(key, feature, value))
    if custom:
        folded = long.where(F.col(feature).isin(*custom)).groupBy(key, feature, value).agg(F.count("*").alias("n"), F.min(position).alias("first"))
        # groups are streamed, many to a batch of rows: a call of pandas for each would cost more than its work
        numbered = folded.withColumn("_number", F.row_number().over(Window.partitionBy(key, feature).orderBy(F.asc_nulls_last("first"))))
        kinds = dict(long.dtypes)
        parts.append(numbered.mapInArrow(_grouped(custom, key, feature, value), f"`{key}` {kinds[key]}, `{feature}` string, `{value}` string"))
    pooled = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    everyone = long.groupBy(key).agg(F.lit(None).cast("string").alias(feature), F.lit(None).cast("string").alias(value))
    names = [r["feature"] for r in registry]
    wide = pooled.unionByName(everyone).groupBy(key).pivot(feature, names).agg(F.first(value, ignorenulls=True))
    return wide.select(key, *[F.coalesce(n, F.lit(r.get("default"))).alias(n) for n, r in zip(names, registry)])


def to_wide(long: DataFrame, key: str, column: str, value: str, values: Sequence[str]) -> DataFrame:
    """One row per entity; the column names are given, so no job has to find them."""
    return long.groupBy(key).pivot(column, list(values)).agg(F.first(value, ignorenulls=True)).select(key, *sorted(values))


def condition_counts(long: DataFrame, dim: DataFrame, key: str, condition: str) -> DataFrame:
    """Distinct conditions per category; a condition may be in several."""
    return long.join(dim, condition).groupBy(key, "category").agg(F.count_distinct(condition).alias("n"))


def any_of(long: DataFrame, dim: DataFrame, key: str, condition: str) -> DataFrame:
    """(key, applies_to, category, present) for every applicable pair of an entity.

    The pairs of the dimension come to the driver as one literal array, so every entity is exploded and nothing is joined for it.
    """
    known = [(r[0], r[1]) for r in dim.select("applies_to", "category").distinct().orderBy("applies_to", "category").collect()]
    each = F.array(*[F.struct(F.lit(a).alias("applies_to"), F.lit(c).alias("category")) for a, c in known])
    pairs = long.select(key).distinct().select(key, F.inline(each))
    hits = long.join(dim, condition).select(key, "applies_to", "category").distinct().withColumn("_hit", F.lit(True))
    return pairs.join(hits, [key, "applies_to", "category"], "left").select(key, "applies_to", "category", F.coalesce("_hit", F.lit(False)).alias("present"))


def dose_bins(days: Column, cuts: Sequence[int] = (1, 30, 90, 365)) -> Column:
    """None below the first cut, then ranges between cuts, the last one open; Unknown for null."""
    out = F.when(days.isNull(), "Unknown").when(days < cuts[0], "None")
    for a, b in zip(cuts, cuts[1:]):
        out = out.when(days < b, f"{a}-{b - 1}")
    return out.otherwise(f"{cuts[-1]}+")


def known_mode(value: Column, known: Sequence[str], fallbacks: Sequence[str], otherwise: str) -> Column:
    """The most frequent known answer (the first in order of equally frequent ones), else the first fallback that occurs."""
    held = [F.bool_or(value == f) for f in fallbacks]
    out = F.mode(F.when(value.isin(*known), value), True)
    return F.coalesce(out, *[F.when(h, F.lit(f)) for h, f in zip(held, fallbacks)], F.lit(otherwise))


def first_present(value: Column, order: Sequence[str], otherwise: str) -> Column:
    """The first answer of ``order`` that any record gives: the highest letter or the longest range, as the list says."""
    return F.coalesce(*[F.when(F.bool_or(value == v), F.lit(v)) for v in order], F.lit(otherwise))


def modal_attributes(df: DataFrame, key: str, attributes: Sequence[str], numbers: Sequence[str] = ()) -> DataFrame:
    """One row per entity: the most frequent value of each attribute (the smallest of equally frequent ones) and the mean of each number."""
    return df.groupBy(key).agg(*[F.mode(a, True).alias(a) for a in attributes], *[F.avg(F.col(n).try_cast("double")).alias(n) for n in numbers])


def prior_groups(df: DataFrame, key: str, condition: str, groups: dict[str, Sequence[str]], other: str = "other") -> DataFrame:
    """(key, one Yes/No column per named group, and one for conditions in no group)."""
    yes = lambda test: F.when(F.coalesce(F.bool_or(test), F.lit(False)), "Yes").otherwise("No")
    c = F.col(condition)
    listed = [v for values in groups.values() for v in values]
    return df.groupBy(key).agg(*[yes(c.isin(*values)).alias(name) for name, values in groups.items()], yes(~c.isin(*listed)).alias(other))


def condition_counts_with(long: DataFrame, dim: DataFrame, key: str, condition: str, bonus: DataFrame, category: str) -> DataFrame:
    """:func:`condition_counts`, and one more in ``category`` for the entities of ``bonus`` (key)."""
    counted = condition_counts(long, dim, key, condition)
    more = bonus.select(key).distinct().select(key, F.lit(category).alias("category"), F.lit(1).cast("long").alias("n"))
    return counted.unionByName(more).groupBy(key, "category").agg(F.sum("n").alias("n"))


def counts_by_period(long: DataFrame, index: DataFrame, key: str, feature: str, date: str, keyword: str, days: float = 730.0, forced: dict[str, str] | None = None) -> DataFrame:
    """(feature, period, keyword, n, entities): records of each keyword or class in each study period; ``forced`` names features of one period."""
    dated = long.join(index.select(key, "index_date"), key)
    period = forced_period(F.col(feature), classify_period(F.col(date), F.col("index_date"), days), forced or {})
    return dated.groupBy(feature, period.alias("period"), keyword).agg(F.count("*").alias("n"), F.count_distinct(key).alias("entities"))
