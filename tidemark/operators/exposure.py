"""Exposure rows: flags, class counts, durations and dose levels of wide rows, and the models fitted on them."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import stats

#: Durations that count as unknown, bands of total days, dose and course levels in their order.
UNKNOWN_DAYS = ("F", "", "0")
DURATION_BANDS = ((90, "Low (≤90 days)"), (180, "Medium (91–180 days)"), (None, "High (>180 days)"))
DOSE_LEVELS = ("None", "1-29", "30-89", "90-364", "365+", "Unknown")
COURSE_LEVELS = ("None", "1", "2", "3+")


def yes_count(flags: Sequence[str]) -> Column:
    """How many of the columns hold a Yes; nulls count as none."""
    return reduce(lambda a, b: a + b, [F.coalesce((F.col(c) == "Yes").cast("int"), F.lit(0)) for c in flags], F.lit(0))


def any_yes(flags: Sequence[str]) -> Column:
    return F.when(yes_count(flags) > 0, "Yes").otherwise("No")


def class_group(n: Column, most: int = 3) -> Column:
    """None, 1 class, 2 classes, ... and an open last group."""
    out = F.when(n >= most, f"{most}+ classes")
    for k in range(1, most):
        out = out.when(n == k, f"{k} class" + ("es" if k > 1 else ""))
    return out.otherwise("None")


def known_days(columns: Sequence[str]) -> Column:
    """The durations that are known numbers, as an array."""
    return F.array_compact(F.array(*[F.when(~F.trim(F.col(c)).isin(*UNKNOWN_DAYS), F.col(c).try_cast("double")) for c in columns]))


def total_days(columns: Sequence[str], exposed: Column) -> Column:
    """Sum of the known durations of an exposed row; null without one."""
    days = known_days(columns)
    return F.when(exposed & (F.size(days) > 0), F.aggregate(days, F.lit(0.0), lambda s, x: s + x))


def longest_days(columns: Sequence[str], exposed: Column) -> Column:
    """The longest of the known durations of an exposed row; null without one."""
    return F.when(exposed, F.array_max(known_days(columns)))


def duration_band(days: Column) -> Column:
    out = None
    for top, name in DURATION_BANDS:
        test = days.isNotNull() if top is None else days <= top
        out = F.when(test, name) if out is None else out.when(test, name)
    return out


def dose_level(exposed: Column, days: Column) -> Column:
    """None for the unexposed, Unknown for exposed rows without known days, else the range of days."""
    return F.when(~exposed, DOSE_LEVELS[0]).when(days.isNull(), DOSE_LEVELS[5]).when(days <= 29, DOSE_LEVELS[1]).when(days <= 89, DOSE_LEVELS[2]).when(days <= 364, DOSE_LEVELS[3]).otherwise(DOSE_LEVELS[4])


def course_level(exposed: Column, courses: Column) -> Column:
    return F.when(~exposed, COURSE_LEVELS[0]).when(courses == 1, COURSE_LEVELS[1]).when(courses == 2, COURSE_LEVELS[2]).when(courses >= 3, COURSE_LEVELS[3])


def long_exposure_only(df: DataFrame, exposed: Column, days: Column, least: float = 30) -> DataFrame:
    """Sensitivity restriction: the unexposed, and exposed rows of at least so many known days."""
    return df.where(~exposed | F.coalesce(days >= least, F.lit(False)))


def single_class_rows(df: DataFrame, keep: Sequence[str], classes: dict[str, str]) -> DataFrame:
    """Wide to long, (keep..., type): rows that received exactly one of the classes, under that class's name."""
    one = df.where(yes_count(list(classes)) == 1)
    types = F.array_compact(F.array(*[F.when(F.col(c) == "Yes", F.lit(name)) for c, name in classes.items()]))
    return one.select(*keep, F.get(types, F.lit(0)).alias("type"))


def renamed_by_prefix(df: DataFrame, old: str, new: str = "") -> DataFrame:
    """Columns that begin with ``old`` get ``new`` in its place."""
    return df.withColumnsRenamed({c: new + c[len(old) :] for c in df.columns if c.startswith(old)})


def column_families(df: DataFrame, patterns: dict[str, str]) -> dict[str, list[str]]:
    """Names of the columns that each pattern finds, in order."""
    return {name: [c for c in df.columns if re.search(p, c)] for name, p in patterns.items()}


def level_number(value: Column, levels: Sequence[str]) -> Column:
    """Place of a value in a list of levels, from 0; null for other values."""
    at = F.array_position(F.array(*map(F.lit, levels)), value)
    return F.when(at > 0, (at - 1).cast("int"))


def recoded(value: Column, rules: Sequence[tuple[Sequence[str], str]], other: str | None = None, missing: str | None = None) -> Column:
    """The label of the first rule (values, label) that lists the value, letter case aside; ``other`` for values of no rule, ``missing`` for null."""
    body = F.lower(F.trim(value))
    out = F.when(value.isNull(), F.lit(missing))
    for values, label in rules:
        out = out.when(body.isin(*[v.lower() for v in values]), F.lit(label))
    return out.otherwise(F.lit(other))


def recoded_levels(df: DataFrame, spec: dict[str, dict]) -> DataFrame:
    """Covariates recoded and ordered: each column of ``spec`` {rules, levels, other, missing} gets its label and ``<column>_level``, its place in ``levels``.

    A label that is no level has a null place, so a model leaves its row out; :func:`indicators` takes the levels in the same order.
    """
    out = df.withColumns({c: recoded(F.col(c).cast("string"), s["rules"], s.get("other"), s.get("missing")) for c, s in spec.items()})
    return out.withColumns({f"{c}_level": level_number(F.col(c), s["levels"]) for c, s in spec.items()})


def indicators(df: DataFrame, column: str, levels: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """0/1 columns for every level but the first that some row has."""
    held = {r[0] for r in df.select(column).where(F.col(column).isin(*levels)).distinct().collect()}  # at most the levels
    names = {f"{column}={v}": v for v in levels[1:] if v in held}
    return df.withColumns({n: (F.col(column) == v).cast("int") for n, v in names.items()}), list(names)


def level_models(df: DataFrame, column: str, levels: Sequence[str], time: str, event: str, adjust: Sequence[str]) -> list[dict]:
    """Cox models of the levels of an exposure, unadjusted and adjusted for the covariates with two levels or more, fitted together."""
    wide, names = indicators(df, column, levels)
    grid = [{"exposure": column, "model": "unadjusted", "covariates": names}, {"exposure": column, "model": "adjusted", "covariates": [*names, *adjust]}]
    found = stats.ablate(df.sparkSession, wide, grid, time, event)
    return [{k: v for k, v in r.items() if k != "covariates"} for r in found]
