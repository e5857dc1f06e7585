"""Running sums, row numbers and selection by rank over groups of any size.

Rows are dealt to ranges of (group, order), so a group that holds a third of all rows lies in many ranges, and the number of ranges
grows with ``spark.sql.shuffle.partitions``. Each range is folded to one row for each group in it; what lies before a range is a running
fold over these few rows. Only then are rows numbered, each range on its own. The dealt rows are written once, because the
borders of ranges come from a sample that another run would not repeat; so these functions run a job when they are called.

Rows that are equal in group and order stay in one range: name a column that tells rows apart last where very many can be equal.
Null groups are a group; null order values come first (last where descending).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.tables import written

#: Columns of this module's own begin so.
_OWN = "_rank_"
_FOLDS = {"sum": F.sum, "min": F.min, "max": F.max}


def _column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ranged(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], descending: bool = False) -> DataFrame:
    """``df`` dealt to ranges of (by, order) and written: adds ``_part``, which rises with the order within each group, and ``_o0``, ``_o1`` ..., the order's values."""
    keyed = df.withColumns({f"_o{i}": _column(o) for i, o in enumerate(order)})
    ends = _ends(len(order), descending)
    return written(keyed.repartitionByRange(*[F.col(c) for c in by], *ends).withColumn("_part", F.spark_partition_id()), "ranged")


def _ends(n: int, descending: bool) -> list[Column]:
    return [F.desc(f"_o{i}") if descending else F.asc(f"_o{i}") for i in range(n)]


def running(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], folds: dict[str, tuple[str, str | Column]], descending: bool = False) -> DataFrame:
    """Adds a column for each fold: its value over the rows of the group that come earlier, and ``<name>_all`` over the whole group.

    ``folds`` maps a name to ("sum", "min" or "max", value). Of no rows a sum is 0 and a minimum null.
    """
    by, n = list(by), len(order)
    placed = ranged(df.withColumns({f"{_OWN}v_{name}": _column(v) for name, (_, v) in folds.items()}), by, order, descending)
    keys = [f"{_OWN}b{i}" for i in range(len(by))]
    sums = placed.groupBy(*[F.col(c).alias(k) for c, k in zip(by, keys)], F.col("_part").alias(_OWN + "p")).agg(*[_FOLDS[f](f"{_OWN}v_{name}").alias(f"{_OWN}s_{name}") for name, (f, _) in folds.items()])
    group = Window.partitionBy(*keys)  # one row for each range that the group lies in
    before = group.orderBy(_OWN + "p").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*keys, _OWN + "p", *[_FOLDS[f](f"{_OWN}s_{name}").over(w).alias(f"{_OWN}{p}_{name}") for name, (f, _) in folds.items() for w, p in ((before, "f"), (group, "g"))])
    inside = Window.partitionBy("_part", *by).orderBy(*_ends(n, descending)).rowsBetween(Window.unboundedPreceding, -1)
    local = placed.withColumns({f"{_OWN}i_{name}": _FOLDS[f](f"{_OWN}v_{name}").over(inside) for name, (f, _) in folds.items()})
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(k)) for c, k in zip(by, keys)], F.col("_part") == F.col(_OWN + "p"))
    joined = local.join(starts, same)
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = {}
    for name, (f, _) in folds.items():
        first, inner = F.col(f"{_OWN}f_{name}"), F.col(f"{_OWN}i_{name}")
        out[name] = zero(first) + zero(inner) if f == "sum" else F.least(first, inner) if f == "min" else F.greatest(first, inner)
        out[f"{name}_all"] = F.col(f"{_OWN}g_{name}")
    return joined.select(*df.columns, *[c.alias(k) for k, c in out.items()])


def ranked(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], name: str = "n", descending: bool = False) -> DataFrame:
    """Adds ``name``: the row's number in its group, from 1. Rows that are equal in the order are numbered in any order."""
    out = running(df, by, order, {"_before": ("sum", F.lit(1).cast("long"))}, descending)
    return out.select(*df.columns, (F.col("_before") + 1).alias(name))


def quantiles(df: DataFrame, by: Sequence[str], value: str, at: Sequence[float], count: str | None = None) -> DataFrame:
    """(by, n, q: array): exact quantiles of each group, between two values in proportion to the distance of their ranks.

    ``count`` names how often a row counts (default once). Rows are folded to distinct values before they are ranked; a quantile needs the two values
    around one place, which are picked by rank, so no task holds a group's values. Null values leave; a group without
    a value has no row. NaN is above every number.
    """
    by = list(by)
    times = F.lit(1).cast("long") if count is None else F.col(count).cast("long")
    folded = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_x")).agg(F.sum(times).alias("_k"))
    placed = running(folded, by, ["_x"], {"_before": ("sum", "_k")})
    picks = F.array(*[F.struct(F.lit(i).alias("i"), ((F.col("_before_all") - 1) * F.lit(float(q))).alias("at")) for i, q in enumerate(at)])
    asked = placed.select(*by, "_x", "_k", "_before", F.col("_before_all").alias("n"), F.explode(picks).alias("_q"))
    # ranks from 0: this value fills [_before, _before + _k)
    low, high = F.floor("_q.at"), F.ceil("_q.at")
    holds = lambda place: (place >= F.col("_before")) & (place < F.col("_before") + F.col("_k"))
    near = asked.where(holds(low) | holds(high))
    ends = near.groupBy(*by, "n", F.col("_q.i").alias("_i"), F.col("_q.at").alias("_at")).agg(F.max(F.when(holds(low), F.col("_x"))).alias("_low"), F.max(F.when(holds(high), F.col("_x"))).alias("_high"))
    share = F.col("_at") - F.floor("_at")
    one = F.when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise(F.col("_low") * (1 - share) + F.col("_high") * share)
    lists = ends.groupBy(*by, "n").agg(F.array_sort(F.collect_list(F.struct("_i", one.alias("x")))).alias("_l"))  # as many as are asked for
    return lists.select(*by, "n", F.transform("_l", lambda e: e["x"]).alias("q"))
