"""Statistics over tables: balance, tests, baseline tables, survival curves, log-rank, false-discovery control; Cox models come from ``cox``.

Spark folds the rows to counts or moments; the driver sees only tables whose size depends on
the number of arms, categories or covariates. P-values come from scalar series and continued fractions.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cox import ablate, cox_by_type, cox_models, coxph, normal_p  # noqa: F401
from .ranks import quantiles, running
from tidemark.sources.tables import written


def gamma_q(a: float, x: float) -> float:
    """Upper regularised incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - total * front)
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def chi2_p(x: float, df: int) -> float:
    return gamma_q(df / 2, x / 2) if df > 0 else 1.0


def beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_i(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / ((1 - (a + b) * x / (a + 1)) or 1e-300)
    h = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or 1e-300)
            c = 1 + num / c or 1e-300
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def t_p(t: float, df: float) -> float:
    return beta_i(df / 2, 0.5, df / (df + t * t))


def smd_numeric(df: DataFrame, arm: str, value: str) -> DataFrame:
    """One row: means, standardised mean difference, Welch's t and its degrees of freedom for arms 1 and 0."""
    pick = lambda k: F.when(F.col(arm) == k, F.col(value))
    s = df.agg(*[f(pick(k)).alias(f"{n}{k}") for k in (1, 0) for n, f in (("n", F.count), ("mean", F.avg), ("var", F.var_samp))])
    gap = F.col("mean1") - F.col("mean0")
    e1, e0 = F.col("var1") / F.col("n1"), F.col("var0") / F.col("n0")
    return s.withColumns({
        "smd": gap / F.nullif(F.sqrt((F.col("var1") + F.col("var0")) / 2), F.lit(0.0)), "t": gap / F.nullif(F.sqrt(e1 + e0), F.lit(0.0)),
        "df": (e1 + e0) ** 2 / F.nullif(e1**2 / (F.col("n1") - 1) + e0**2 / (F.col("n0") - 1), F.lit(0.0)),
    })


def welch(df: DataFrame, arm: str, value: str) -> tuple[float, float, float]:
    """(t, degrees of freedom, p)."""
    r = smd_numeric(df, arm, value).first()
    return r["t"], r["df"], t_p(r["t"], r["df"])


def contingency(df: DataFrame, arm: str, category: str) -> DataFrame:
    return df.groupBy(arm, category).agg(F.count("*").alias("n"))


def chi2(df: DataFrame, arm: str, category: str, yates: bool = True) -> DataFrame:
    """One row: chi2 and df, from the table of counts; Yates' correction for 2 x 2."""
    c = contingency(df.where(F.col(arm).isNotNull() & F.col(category).isNotNull()), arm, category)
    rows, cols = c.groupBy(arm).agg(F.sum("n").alias("_r")), c.groupBy(category).agg(F.sum("n").alias("_c"))
    # one row holds the arms; each category is then laid out over them
    arms = rows.agg(F.collect_list(F.struct(arm, "_r")).alias("_arms"), F.count("*").alias("_nr"), F.sum("_r").alias("_t")).join(cols.agg(F.count("*").alias("_nc")))
    cells = cols.join(F.broadcast(arms)).select(category, "_c", "_nr", "_nc", "_t", F.inline("_arms")).join(c, [arm, category], "left")
    e = F.col("_r") * F.col("_c") / F.col("_t")
    gap = F.abs(F.coalesce("n", F.lit(0)) - e)
    small = (F.col("_nr") == 2) & (F.col("_nc") == 2) & F.lit(yates)
    gap = F.when(small, gap - F.least(F.lit(0.5), gap)).otherwise(gap)
    return cells.agg(F.sum(gap * gap / e).alias("chi2"), F.max((F.col("_nr") - 1) * (F.col("_nc") - 1)).alias("df"))


def smd_category(df: DataFrame, arm: str, category: str) -> float:
    """Multi-category standardised difference: (p1 - p0)' S^-1 (p1 - p0) over all but one category; counts come to the driver."""
    counts = {(r[0], r[1]): r[2] for r in contingency(df, arm, category).collect()}
    cats = sorted({c for _, c in counts}, key=str)[1:]
    p = []
    for k in (1, 0):
        total = sum(n for (a, _), n in counts.items() if a == k)
        p.append(np.array([counts.get((k, c), 0) / max(total, 1) for c in cats]))
    if not cats:
        return 0.0
    s = sum((np.diag(x) - np.outer(x, x)) for x in p) / 2
    d = p[0] - p[1]
    return float(np.sqrt(max(0.0, d @ np.linalg.pinv(s) @ d)))


def balance(df: DataFrame, arm: str, numbers: Sequence[str], categories: Sequence[str], limit: float = 0.1) -> list[dict]:
    """Balance table: variable, smd, p, balanced (|smd| below the limit)."""
    out = []
    for v in numbers:
        r = smd_numeric(df, arm, v).first()
        out.append({"variable": v, "smd": r["smd"], "p": t_p(r["t"], r["df"]) if r["t"] is not None else None})
    for v in categories:
        r = chi2(df, arm, v).first()
        out.append({"variable": v, "smd": smd_category(df, arm, v), "p": chi2_p(r["chi2"], r["df"]) if r["chi2"] is not None else None})
    return [x | {"balanced": x["smd"] is not None and abs(x["smd"]) < limit} for x in out]


def balance_by_round(members: DataFrame, pairs: DataFrame, key: str, arm: str, numbers: Sequence[str], categories: Sequence[str], limit: float = 0.1) -> DataFrame:
    """(round, variable, smd, balanced) of the people that each round of matching paired, all rounds and variables together.

    ``pairs`` has (case, control, round); the difference is absolute, and balanced means below the limit. A round in which a
    variable has no difference to take (one value, one arm) has a null.
    """
    who = pairs.select("round", F.explode(F.array("case", "control")).alias(key))
    people = members.join(who, key).withColumn("_round", F.col("round"))
    named = lambda v: F.concat_ws("\u0001", "_round", F.lit(v))
    long = counts = None
    if numbers:
        each = F.inline(F.array(*[F.struct(named(v).alias("variable"), F.col(v).cast("double").alias("x")) for v in numbers]))
        long = people.select(F.col(arm).cast("string").alias("group"), each).where("x is not null").groupBy("variable", "group", "x").agg(F.count("*").alias("k"))
    if categories:
        each = F.inline(F.array(*[F.struct(named(v).alias("variable"), F.col(v).cast("string").alias("level")) for v in categories]))
        counts = people.select(F.col(arm).cast("string").alias("group"), each).where("level is not null").groupBy("variable", "group", "level").agg(F.count("*").alias("n"))
    if long is None:
        long = counts.select("variable", "group", F.lit(0.0).alias("x"), F.col("n").alias("k")).where("false")
    split = F.split("variable", "\u0001")
    return smd_many(long, counts).select(F.get(split, F.lit(0)).alias("round"), F.get(split, F.lit(1)).alias("variable"), "smd", (F.col("smd") < limit).alias("balanced"))


def kruskal(df: DataFrame, by: str, value: str) -> DataFrame:
    """One row: h (tie-corrected) and df, from average ranks of distinct values."""
    return kruskal_many(_long(df, by, [value])).select("h", "df")


def _long(df: DataFrame, by: str, numbers: Sequence[str]) -> DataFrame:
    """(variable, group, x, k): how often each value of each number occurs in each group; null groups and values leave."""
    each = F.inline(F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias("x")) for v in numbers]))
    return df.where(F.col(by).isNotNull()).select(F.col(by).cast("string").alias("group"), each).where("x is not null").groupBy("variable", "group", "x").agg(F.count("*").alias("k"))


def kruskal_many(counts: DataFrame) -> DataFrame:
    """(variable, h, df) from the counts of :func:`_long`; all variables are ranked together. h is null where all values are equal."""
    values = counts.groupBy("variable", "x").agg(F.sum("k").alias("n"))
    ranks = running(values, ["variable"], ["x"], {"before": ("sum", "n")}).select("variable", "x", "n", (F.col("before") + (F.col("n") + 1) / 2.0).alias("rank"))
    groups = counts.join(ranks.drop("n"), ["variable", "x"]).groupBy("variable", "group").agg(F.sum("k").alias("g"), F.sum(F.col("k") * F.col("rank")).alias("r"))
    ties = ranks.groupBy("variable").agg(F.sum("n").cast("double").alias("n"), F.sum(F.col("n").cast("double") ** 3 - F.col("n")).alias("t"))
    h = groups.groupBy("variable").agg(F.sum(F.col("r") ** 2 / F.col("g")).alias("s"), (F.count("*") - 1).alias("df")).join(ties, "variable")
    n = F.col("n")
    return h.select("variable", ((F.lit(12.0) / (n * (n + 1)) * F.col("s") - 3 * (n + 1)) / F.nullif(1 - F.col("t") / (n**3 - n), F.lit(0.0))).alias("h"), "df")


def moments_table(df: DataFrame, by: str, numbers: Sequence[str]) -> DataFrame:
    """(variable, group, n, mean, sd, median, min, max) of each number by group, and over all rows (group ``overall``)."""
    long = df.select(F.col(by).cast("string").alias("group"), F.inline(F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias("x")) for v in numbers])))
    both = long.select("variable", "x", F.explode(F.array(F.struct("group", F.lit(False).alias("all")), F.struct(F.lit(None).cast("string").alias("group"), F.lit(True).alias("all")))).alias("g"))
    out = both.groupBy("variable", "g").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"), F.median("x").alias("median"), F.min("x").alias("min"), F.max("x").alias("max"))
    return out.select("variable", F.when(F.col("g.all"), "overall").otherwise(F.col("g.group")).alias("group"), "n", "mean", "sd", "median", "min", "max")


def chi2_tail(x: str, df: str) -> Column:
    """p of a chi-square value in a table of a few rows; null for null."""

    @F.pandas_udf("double")
    def tail(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if v is None or math.isnan(v) else chi2_p(v, int(n)) for v, n in zip(a, b)], dtype="float64")

    return tail(x, df)


def chi2_many(counts: DataFrame, yates: bool = True) -> DataFrame:
    """(variable, chi2, df) from (variable, group, level, n), n > 0; empty cells need no row. Yates' correction for two by two."""
    rows, cols = (counts.groupBy("variable", c).agg(F.sum("n").cast("double").alias(f"_{c}")) for c in ("group", "level"))
    both = counts.join(rows, ["variable", "group"]).join(cols, ["variable", "level"])
    s = both.groupBy("variable").agg(F.sum(F.col("n") ** 2 / (F.col("_group") * F.col("_level"))).alias("s"), F.sum("n").cast("double").alias("t"))
    margin = lambda m, c: m.groupBy("variable").agg(F.count("*").alias(f"n_{c}"), F.sum(1 / F.col(f"_{c}")).alias(f"i_{c}"))
    s = s.join(margin(rows, "group"), "variable").join(margin(cols, "level"), "variable")
    plain = F.greatest(F.col("t") * (F.col("s") - 1), F.lit(0.0))
    inverse = F.col("t") * F.col("i_group") * F.col("i_level")  # of the expected counts, summed
    gap = F.sqrt(plain / inverse)  # two by two, all cells are equally far off
    small = F.lit(yates) & (F.col("n_group") == 2) & (F.col("n_level") == 2)
    return s.select("variable", F.when(small, (gap - F.least(F.lit(0.5), gap)) ** 2 * inverse).otherwise(plain).alias("chi2"), ((F.col("n_group") - 1) * (F.col("n_level") - 1)).alias("df"))


def _smd_levels(frame: pd.DataFrame) -> pd.DataFrame:
    """Mean over all pairs of groups of the standardised difference of level shares, of one variable's counts."""
    table = frame.pivot_table(index="group", columns="level", values="n", aggfunc="sum", fill_value=0).sort_index()
    shares = table.to_numpy(float) / table.to_numpy(float).sum(1, keepdims=True)
    found = []
    for i in range(len(shares)):
        for j in range(i):
            a, b = shares[i, 1:], shares[j, 1:]
            spread = sum(np.diag(x) - np.outer(x, x) for x in (a, b)) / 2
            found.append(float(np.sqrt(max(0.0, (a - b) @ np.linalg.pinv(spread) @ (a - b)))) if len(a) else 0.0)
    return pd.DataFrame({"variable": [frame["variable"].iloc[0]], "smd": [float(np.mean(found)) if found else None]})


def smd_many(long: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """(variable, smd): the mean over all pairs of groups of the absolute standardised difference.

    ``long`` has numbers as (variable, group, x, k), ``counts`` categories as (variable, group, level, n); a category's levels by groups
    meet in one task, so name categories of which that table is small.
    """
    n, total = F.sum("k").cast("double"), F.sum(F.col("k") * F.col("x"))
    m = long.groupBy("variable", "group").agg(n.alias("n"), (total / n).alias("mean"))
    spread = long.join(m, ["variable", "group"]).groupBy("variable", "group", "n", "mean").agg((F.sum(F.col("k") * (F.col("x") - F.col("mean")) ** 2) / F.nullif(F.col("n") - 1, F.lit(0.0))).alias("var"))
    other = spread.select("variable", *[F.col(c).alias(f"_{c}") for c in ("group", "mean", "var")])
    pairs = spread.join(other, "variable").where("group > _group")  # groups of a study are few
    out = pairs.groupBy("variable").agg(F.avg(F.abs(F.col("mean") - F.col("_mean")) / F.nullif(F.sqrt((F.col("var") + F.col("_var")) / 2), F.lit(0.0))).alias("smd"))
    if counts is None:
        return out
    return out.unionByName(counts.groupBy("variable").applyInPandas(_smd_levels, "variable string, smd double"))


def baseline_table(df: DataFrame, by: str, numbers: Sequence[str], categories: Sequence[str]) -> DataFrame:
    """(variable, level, group, n, share, median, q1, q3, test, statistic, df, p, smd), for each group and over all (group ``overall``).

    Numbers have exact quartiles (:func:`tidemark.operators.ranks.quantiles`, all numbers at once) and a Kruskal-Wallis test, categories counts with shares
    within the group and a chi-square test; both have the mean standardised difference over pairs of groups. Rows of a null group and null values
    of a number leave, a null level is none. A variable without values has no row.
    """
    nulls = lambda *names: [F.lit(None).cast("double").alias(n) for n in names]
    long = written(_long(df, by, numbers), "values") if numbers else None
    each = F.inline(F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).cast("string").alias("level")) for v in categories])) if categories else None
    counts = written(df.where(F.col(by).isNotNull()).select(F.col(by).cast("string").alias("group"), each).where("level is not null").groupBy("variable", "group", "level").agg(F.count("*").alias("n")), "levels") if categories else None
    parts, tests = [], []
    if numbers:
        marked = long.select("variable", "group", F.lit(False).alias("_all"), "x", "k").unionByName(long.select("variable", F.lit("overall").alias("group"), F.lit(True).alias("_all"), "x", "k"))
        q = quantiles(marked, ["variable", "group", "_all"], "x", [0.25, 0.5, 0.75], "k")
        parts.append(q.select("variable", F.lit(None).cast("string").alias("level"), "group", "n", *nulls("share"), *[F.get("q", F.lit(i)).alias(c) for c, i in (("median", 1), ("q1", 0), ("q3", 2))]))
        tests.append(kruskal_many(long).select("variable", F.lit("kruskal").alias("test"), F.col("h").alias("statistic"), "df"))
    if categories:
        both = counts.withColumn("_all", F.lit(False)).unionByName(counts.groupBy("variable", "level").agg(F.sum("n").alias("n")).withColumns({"group": F.lit("overall"), "_all": F.lit(True)}))
        total = both.groupBy("variable", "group", "_all").agg(F.sum("n").alias("_n"))
        parts.append(both.join(total, ["variable", "group", "_all"]).select("variable", "level", "group", "n", (F.col("n") / F.col("_n")).alias("share"), *nulls("median", "q1", "q3")))
        tests.append(chi2_many(counts).select("variable", F.lit("chi2").alias("test"), F.col("chi2").alias("statistic"), "df"))
    one = lambda xs: xs[0] if len(xs) == 1 else xs[0].unionByName(xs[1])
    empty = long if long is not None else counts.select("variable", "group", F.lit(0.0).alias("x"), F.col("n").alias("k")).where("false")
    tested = one(tests).withColumn("p", chi2_tail("statistic", "df")).join(smd_many(empty, counts), "variable", "left")
    return one(parts).join(tested, "variable", "left")


def km(df: DataFrame, time: str, event: str, by: Sequence[str]) -> DataFrame:
    """Kaplan-Meier: (by, time, at_risk, events, censored, survival), after folding rows to distinct times; a null time is behind all others."""
    keys = list(by)
    t = df.groupBy(*keys, F.col(time).alias("time")).agg(F.count_if(F.col(event) == 1).alias("events"), F.count_if(F.col(event) == 0).alias("censored"))
    w = Window.partitionBy(*keys).orderBy(F.desc("time")).rowsBetween(Window.unboundedPreceding, 0)
    r = t.withColumn("at_risk", F.sum(F.col("events") + F.col("censored")).over(w))
    up = Window.partitionBy(*keys).orderBy(F.asc_nulls_last("time")).rowsBetween(Window.unboundedPreceding, 0)
    left = 1 - F.col("events") / F.col("at_risk")
    s = F.when(F.min(left).over(up) <= 0, 0.0).otherwise(F.exp(F.sum(F.log(F.when(left > 0, left))).over(up)))
    return r.withColumn("survival", s).select(*keys, "time", "at_risk", "events", "censored", "survival")


def logrank(df: DataFrame, time: str, event: str, arm: str) -> DataFrame:
    """One row for two arms (1 and 0): observed and expected events of arm 1, variance, chi2."""
    d = lambda k: F.count_if((F.col(arm) == k) & (F.col(event) == 1)).alias(f"d{k}")
    n = lambda k: F.count_if(F.col(arm) == k).alias(f"n{k}")
    t = df.groupBy(F.col(time).alias("time")).agg(d(1), d(0), n(1), n(0))
    r = running(t, [], ["time"], {"r1": ("sum", "n1"), "r0": ("sum", "n0")}, descending=True).withColumns({"r1": F.col("r1") + F.col("n1"), "r0": F.col("r0") + F.col("n0")})
    at, dead = F.col("r1") + F.col("r0"), F.col("d1") + F.col("d0")
    variance = F.when(at > 1, dead * (F.col("r1") / at) * (F.col("r0") / at) * (at - dead) / (at - 1)).otherwise(0.0)
    s = r.where(dead > 0).agg(F.sum("d1").alias("observed"), F.sum(dead * F.col("r1") / at).alias("expected"), F.sum(variance).alias("variance"))
    return s.withColumn("chi2", (F.col("observed") - F.col("expected")) ** 2 / F.nullif(F.col("variance"), F.lit(0.0)))


def bh(df: DataFrame, p: str, alpha: float = 0.05, by: Sequence[str] = (), tie: str | None = None) -> DataFrame:
    """Benjamini-Hochberg: adds ``q`` and ``significant`` within each family ``by``; null p-values leave. No task sees a whole family."""
    order = [p, *([tie] if tie else [])]
    ranks = running(df.where(F.col(p).isNotNull()), by, order, {"_k": ("sum", F.lit(1).cast("long"))})
    raw = ranks.withColumn("_raw", F.col(p) * F.col("_k_all") / (F.col("_k") + 1))
    later = running(raw, by, ["_k"], {"_later": ("min", "_raw")}, descending=True)
    q = F.least(F.lit(1.0), "_raw", "_later")
    return later.select(*df.columns, q.alias("q"), (q <= alpha).alias("significant"))
