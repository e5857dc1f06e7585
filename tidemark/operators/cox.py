"""Cox proportional hazards for many models at once, by Newton-Raphson with Efron's ties.

Rows of all models are folded to (model, time, covariates) and dealt to ranges of (model, time) once. Each step is one job
for all models that have not finished: the patterns of each time are aggregated, risk sets are summed from the latest time by
ranges, each time's ties are summed by five numbers within its row, and p + p*p sums a model come to the driver, which solves for the next
coefficients. They go back as a small table. So the number of jobs does not depend on the number of models.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .ranks import ranged


def normal_p(z: float) -> float:
    """Two-sided."""
    return math.erfc(abs(z) / math.sqrt(2))


def cox_models(df: DataFrame, by: Sequence[str], time: str, event: str, covariates: Sequence[str], rounds: int = 30, eps: float = 1e-9) -> list[dict]:
    """A model for each value of ``by``: the columns of ``by``, name, n, events, coef, hr, low, high, se, z, p, converged.

    Rows with a null time, event or covariate leave (so name only covariates that the models share; a null group is a group). Covariates of one level within a
    model are left out of it; a model without events or covariates has no entry. Coefficients beyond 25 are taken for separation:
    such a model ends and has not converged. The driver holds p + p*p numbers a model; by and p are what bounds it.
    """
    by, names, p = list(by), list(covariates), len(covariates)
    keys = [f"g{i}" for i in range(len(by))]
    x = [f"x{i}" for i in range(p)]
    if not p:
        return []
    keep = df.select(*[F.col(c).alias(k) for c, k in zip(by, keys)], F.col(time).cast("double").alias("_t"), F.col(event).cast("int").alias("_e"), *[F.col(c).cast("double").alias(v) for c, v in zip(names, x)]).dropna(subset=["_t", "_e", *x])
    folded = keep.groupBy(*keys, "_t", *x).agg(F.count("*").alias("n"), F.sum("_e").alias("d"))
    placed = ranged(folded, keys, ["_t"]).drop("_o0")
    ends = placed.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("d").alias("d"), *[f(v).alias(f"{n}_{v}") for v in x for n, f in (("low", F.min), ("high", F.max))]).collect()  # one row a model
    models = []
    for r in ends:
        used = [i for i, v in enumerate(x) if r[f"low_{v}"] < r[f"high_{v}"]]
        if r["d"] and used:
            models.append({"key": tuple(r[k] for k in keys), "n": r["n"], "events": r["d"], "used": used, "beta": np.zeros(p), "info": np.eye(p), "converged": False, "open": True})
    of = {m["key"]: m for m in models}
    schema = ", ".join([*[f"{k} {t}" for k, t in placed.dtypes if k in keys], "_beta array<double>"])
    for _ in range(rounds):
        now = [m for m in models if m["open"]]
        if not now:
            break
        table = df.sparkSession.createDataFrame([(*m["key"], m["beta"].tolist()) for m in now], schema)
        for row in _step(placed, table, keys, x).collect():  # one row a model
            _newton(of[tuple(row[k] for k in keys)], row, p, eps)
    out = []
    for m in sorted(models, key=lambda m: tuple((k is not None, str(k)) for k in m["key"])):
        used = m["used"]
        se = np.sqrt(np.maximum(np.diag(np.linalg.pinv(m["info"][np.ix_(used, used)])), 0)).tolist()
        for i, e in zip(used, se):
            b = float(m["beta"][i])
            z = b / e if e else 0.0
            out.append(dict(zip(by, m["key"])) | {
                "name": names[i], "n": m["n"], "events": m["events"], "coef": b, "hr": math.exp(min(b, 700)), "low": math.exp(min(b - 1.959964 * e, 700)), "high": math.exp(min(b + 1.959964 * e, 700)),
                "se": e, "z": z, "p": normal_p(z), "converged": m["converged"],
            })
    return out


def _newton(m: dict, row, p: int, eps: float) -> None:
    used, info = m["used"], np.zeros((p, p))
    u = np.array([row[f"u{i}"] for i in range(p)])
    for i in range(p):
        for j in range(i, p):
            info[i, j] = info[j, i] = row[f"h{i}_{j}"]
    step = np.zeros(p)
    step[used] = np.linalg.pinv(info[np.ix_(used, used)]) @ u[used]
    m["info"], m["beta"] = info, m["beta"] + np.clip(step, -5, 5)
    m["converged"] = bool(np.abs(step).max() < eps)
    m["open"] = not m["converged"] and np.abs(m["beta"]).max() <= 25


def _step(placed: DataFrame, table: DataFrame, keys: Sequence[str], x: Sequence[str]) -> DataFrame:
    """Gradient and information of each model at its coefficients."""
    p = len(x)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    renamed = table.select(*[F.col(k).alias(f"_{k}") for k in keys], "_beta")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], F.lit(True))
    rows = placed.join(renamed, same) if keys else placed.crossJoin(renamed)  # one row of coefficients
    risk = F.exp(reduce(lambda a, b: a + b, [F.col(v) * F.get("_beta", F.lit(i)) for i, v in enumerate(x)]))
    terms = {"s": F.lit(1.0)} | {f"s{i}": F.col(v) for i, v in enumerate(x)} | {f"s{i}_{j}": F.col(x[i]) * F.col(x[j]) for i, j in pairs}
    per_time = rows.withColumn("_risk", risk).groupBy(*keys, "_part", "_t").agg(
        F.sum("d").alias("d"), *[F.sum(F.col("d") * F.col(v)).alias(f"o{i}") for i, v in enumerate(x)],
        *[F.sum(F.col("_risk") * F.col("n") * v).alias(f"r{k}") for k, v in terms.items()], *[F.sum(F.col("_risk") * F.col("d") * v).alias(f"e{k}") for k, v in terms.items()],
    )
    atrisk = _suffix_sums(per_time, keys, "_t", [f"r{k}" for k in terms])

    tied = atrisk.where("d > 0").withColumn("_ties", _tie_sums(F.col("rs"), F.col("es"), F.col("d")))
    r, e, t = (lambda k: F.col(f"r{k}")), (lambda k: F.col(f"e{k}")), (lambda k: F.col(f"_ties.{k}"))
    mean = lambda k: r(f"s{k}") * t("a") - e(f"s{k}") * t("b")  # noqa: E731  of the sums over the ties, all are linear in these
    square = lambda i, j: r(f"s{i}") * r(f"s{j}") * t("aa") - (r(f"s{i}") * e(f"s{j}") + e(f"s{i}") * r(f"s{j}")) * t("ab") + e(f"s{i}") * e(f"s{j}") * t("bb")
    return tied.groupBy(*keys).agg(*[F.sum(F.col(f"o{i}") - mean(i)).alias(f"u{i}") for i in range(p)], *[F.sum(mean(f"{i}_{j}") - square(i, j)).alias(f"h{i}_{j}") for i, j in pairs])


#: Ties that are summed at a time.
TIES = 1 << 20


def _tie_sums(risk: Column, tied: Column, deaths: Column) -> Column:
    """Sums over l = 0 ... deaths - 1 of 1/s, f/s, 1/s2, f/s2 and f2/s2 (a, b, aa, ab, bb), where f = l/deaths, s = risk - f * tied and s2 = s * s.

    A time's deaths grow with the rows, so the sums are taken by numpy in stretches.
    """

    @F.pandas_udf("a double, b double, aa double, ab double, bb double")
    def sums(risk: pd.Series, tied: pd.Series, deaths: pd.Series) -> pd.DataFrame:
        r, e, d = risk.to_numpy(float), tied.to_numpy(float), deaths.to_numpy(np.int64)
        out, behind, last = np.zeros((len(d), 5)), np.cumsum(d), int(d.sum())
        for at in range(0, last, TIES):  # stretches of the rows' ties, laid end to end
            to = min(at + TIES, last)
            low, high = int(np.searchsorted(behind, at, side="right")), int(np.searchsorted(behind, to - 1, side="right")) + 1
            begin = np.maximum(behind[low:high] - d[low:high], at)
            row = np.repeat(np.arange(low, high), np.minimum(behind[low:high], to) - begin)
            f = (np.arange(at, to) - (behind - d)[row]) / d[row]
            s = 1 / (r[row] - f * e[row])
            use = np.flatnonzero(d[low:high])
            for k, x in enumerate((s, f * s, s * s, f * s * s, f * f * s * s)):
                out[low + use, k] += np.add.reduceat(x, begin[use] - at)
        return pd.DataFrame(out, columns=["a", "b", "aa", "ab", "bb"])

    return sums(risk, tied, deaths)


def _suffix_sums(rows: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """The columns replaced by their sums over this and all later rows of the group; ``_part`` is a row's range, so no task sees a whole group."""
    own = [f"_{k}" for k in keys]
    sums = rows.groupBy(*[F.col(k).alias(o) for k, o in zip(keys, own)], F.col("_part").alias("_p")).agg(*[F.sum(c).alias(f"_{c}") for c in columns])
    later = Window.partitionBy(*own).orderBy(F.desc("_p")).rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    starts = sums.select(*own, "_p", *[F.coalesce(F.sum(f"_{c}").over(later), F.lit(0.0)).alias(f"_{c}") for c in columns])
    w = Window.partitionBy("_part", *keys).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(o)) for k, o in zip(keys, own)], F.col("_part") == F.col("_p"))
    inner = rows.withColumns({c: F.sum(c).over(w) for c in columns}).join(starts, same)
    return inner.select(*[c for c in rows.columns if c not in columns], *[(F.col(c) + F.col(f"_{c}")).alias(c) for c in columns])


def coxph(df: DataFrame, time: str, event: str, covariates: Sequence[str], rounds: int = 30, eps: float = 1e-9) -> list[dict]:
    """One model of all rows: name, n, events, coef, hr, low, high, se, z, p, converged."""
    return cox_models(df, [], time, event, covariates, rounds, eps)


def q_values(rows: list[dict]) -> list[dict]:
    """Benjamini-Hochberg over the p of a list of results: adds ``q``."""
    out, least = {}, 1.0
    for place, i in reversed(list(enumerate(sorted(range(len(rows)), key=lambda i: rows[i]["p"]), 1))):
        least = min(least, rows[i]["p"] * len(rows) / place)
        out[i] = least
    return [r | {"q": out[i]} for i, r in enumerate(rows)]


def cox_by_type(df: DataFrame, by: str, time: str, event: str, covariates: Sequence[str], target: str, least_events: int = 10) -> list[dict]:
    """The target's coefficient in a model for each stratum with enough events, with q-values over the strata; all strata are fitted together."""
    found = cox_models(df.where(F.col(by).isNotNull()), [by], time, event, covariates)
    return q_values([r for r in found if r["name"] == target and r["events"] >= least_events])


def ablate(spark: SparkSession, df: DataFrame, grid: Sequence[dict], time: str, event: str) -> list[dict]:
    """A model for each configuration {where, covariates}, identical ones once; all are fitted together.

    A covariate that a configuration does not name is 0 in its rows, so it has one level and leaves the model.
    """
    keys = [(config.get("where", "true"), tuple(config["covariates"])) for config in grid]
    kinds = list(dict.fromkeys(keys))
    names = list(dict.fromkeys(c for _, covariates in kinds for c in covariates))
    if not names:
        return []
    rows = None
    for number, (where, covariates) in enumerate(kinds):
        part = df.where(where).dropna(subset=list(covariates)).select(F.lit(number).alias("_model"), time, event, *[(F.col(c).cast("double") if c in covariates else F.lit(0.0)).alias(c) for c in names])
        rows = part if rows is None else rows.unionByName(part)
    found = cox_models(rows, ["_model"], time, event, names)
    of = {k: [{n: v for n, v in r.items() if n != "_model"} for r in found if r["_model"] == i] for i, k in enumerate(kinds)}
    return [dict(config) | r for config, k in zip(grid, keys) for r in of[k]]
