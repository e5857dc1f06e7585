"""Evaluation: accuracy, errors, multi-label metrics, threshold sweeps and areas under curves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import running

THRESHOLDS = [i / 100 for i in range(1, 100)]


def accuracy(df: DataFrame, gt: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    hit = (F.col(gt) == F.col(pred)).cast("double")
    return df.where(F.col(gt).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.coalesce(hit, F.lit(0.0))).alias("accuracy"))


def accuracy_by_source(df: DataFrame, gt: str, pred: str, synthetic: str) -> DataFrame:
    """Accuracy of all rows, of natural and of synthetic ones in one pass."""
    hit = F.coalesce((F.col(gt) == F.col(pred)).cast("double"), F.lit(0.0))
    return df.agg(F.avg(hit).alias("combined"), F.avg(F.when(~F.col(synthetic), hit)).alias("natural"), F.avg(F.when(F.col(synthetic), hit)).alias("synthetic"))


def percent_error(gt: Column, pred: Column) -> Column:
    """Percent error of whole numbers (decimals are cut off) capped at 100; a truth of 0 allows only 0; text that isn't a number on either side is 100."""
    whole = lambda c: c.try_cast("double").try_cast("bigint").cast("double")
    a, b = whole(gt), whole(pred)
    return F.when(a.isNull() | b.isNull(), 100.0).when(a == 0, F.when(b == 0, 0.0).otherwise(100.0)).otherwise(F.least(F.lit(100.0), F.abs(b - a) / F.abs(F.nullif(a, F.lit(0.0))) * 100))


def numeric_error(df: DataFrame, gt: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    gap = F.abs(F.col(pred).try_cast("double") - F.col(gt).try_cast("double"))  # decimals count here
    return df.groupBy(*by).agg(F.avg(percent_error(F.col(gt), F.col(pred))).alias("percent_error"), F.avg(gap).alias("absolute_error"))


def confusion(df: DataFrame, gt: str, pred: str, errors_only: bool = False) -> DataFrame:
    out = df.groupBy(F.col(gt).alias("gt"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))
    return out.where(~F.col("gt").eqNullSafe(F.col("pred"))) if errors_only else out


def errors(df: DataFrame, gt: str, pred: str, order: Sequence, k: int) -> DataFrame:
    """The first k mismatches (k is the report's length)."""
    return df.where(~F.col(gt).eqNullSafe(F.col(pred))).orderBy(*order).limit(k)


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def multilabel(df: DataFrame, label: str, y: str, yhat: str) -> DataFrame:
    """Per label: tp, fp, fn, precision, recall, f1, jaccard (intersection over union)."""
    t, p = F.col(y) == 1, F.col(yhat) == 1
    c = df.groupBy(label).agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"))
    return c.withColumns({
        "precision": _ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": _ratio(F.col("tp"), F.col("tp") + F.col("fn")),
        "f1": _ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), "jaccard": _ratio(F.col("tp"), F.col("tp") + F.col("fp") + F.col("fn")),
    })


def macro_micro(per_label: DataFrame) -> DataFrame:
    s = lambda c: F.sum(c)
    return per_label.agg(
        F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"), F.avg("jaccard").alias("macro_jaccard"),
        _ratio(s("tp"), s("tp") + s("fp")).alias("micro_precision"), _ratio(s("tp"), s("tp") + s("fn")).alias("micro_recall"),
        _ratio(2 * s("tp"), 2 * s("tp") + s("fp") + s("fn")).alias("micro_f1"), _ratio(s("tp"), s("tp") + s("fp") + s("fn")).alias("micro_jaccard"),
    )


def sweep(df: DataFrame, y: str, score: str, by: Sequence[str] = (), inclusive: bool = False) -> DataFrame:
    """Metrics at 0.01 ... 0.99. Rows are first folded to a histogram of the thresholds they pass, so 99 rows a group are compared."""
    x, hundredth = F.col(score).cast("double"), lambda k: k / F.lit(100.0)
    near = F.least(F.greatest((F.ceil(x * 100) - 1) if not inclusive else F.floor(x * 100), F.lit(0)), F.lit(99))
    # the product is rounded, so the threshold next to it on either side is compared as it is: 0.07 * 100 is above 7
    over = (lambda k: x >= hundredth(k)) if inclusive else (lambda k: x > hundredth(k))
    passed = (near + F.when((near < 99) & over(near + 1), 1).when((near > 0) & ~over(near), -1).otherwise(0)).cast("int")
    bins = df.where(F.col(score).isNotNull()).groupBy(*by, passed.alias("_bin")).agg(F.count_if(F.col(y) == 1).alias("_p"), F.count_if(F.col(y) == 0).alias("_n"))
    totals = bins.groupBy(*by).agg(F.collect_list(F.struct("_bin", "_p", "_n")).alias("_bins"))  # at most 100 entries
    rows = totals.select(*by, "_bins", F.explode(F.sequence(F.lit(1), F.lit(99))).alias("_t"))
    total = lambda field, test: F.aggregate(F.filter("_bins", test), F.lit(0).cast("long"), lambda s, b: s + b[field])
    c = rows.select(*by, (F.col("_t") / F.lit(100.0)).alias("threshold"), total("_p", lambda b: b["_bin"] >= F.col("_t")).alias("tp"), total("_n", lambda b: b["_bin"] >= F.col("_t")).alias("fp"), total("_p", lambda b: b["_bin"] < F.col("_t")).alias("fn"))
    return c.withColumns({"precision": _ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": _ratio(F.col("tp"), F.col("tp") + F.col("fn")), "f1": _ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))})


def best_threshold(swept: DataFrame, by: Sequence[str] = (), metric: str = "f1") -> DataFrame:
    """The threshold of the best metric; the lowest of equals."""
    return swept.groupBy(*by).agg(F.max_by("threshold", F.struct(metric, -F.col("threshold"))).alias("threshold"), F.max(metric).alias(metric))


def precision_at_recall(swept: DataFrame, recall: float, by: Sequence[str] = ()) -> DataFrame:
    return swept.where(F.col("recall") >= recall).groupBy(*by).agg(F.max("precision").alias("precision"))


def recall_at_precision(swept: DataFrame, precision: float, by: Sequence[str] = ()) -> DataFrame:
    return swept.where(F.col("precision") >= precision).groupBy(*by).agg(F.max("recall").alias("recall"))


def auc(df: DataFrame, y: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve by average ranks; scores are folded to distinct values before any ordering.

    Negatives below each score come from a running sum over ranges of scores, so neither all rows nor a label's meet in a task.
    """
    keys = list(by)
    c = df.where(F.col(score).isNotNull()).groupBy(*keys, F.col(score).alias("_s")).agg(F.count_if(F.col(y) == 1).alias("_p"), F.count_if(F.col(y) == 0).alias("_n"))
    below = running_total(c, keys, "_s", "_n")
    area = F.sum(F.col("_p") * (F.col("_before") + F.col("_n") / 2.0))
    return below.groupBy(*keys).agg((area / F.nullif(F.sum("_p") * F.sum("_n"), F.lit(0))).alias("auc"))


def running_total(df: DataFrame, by: Sequence[str], order: str, value: str, descending: bool = False) -> DataFrame:
    """Adds ``_before``: the sum of ``value`` over rows of the group that come earlier (:func:`tidemark.operators.ranks.running`)."""
    return running(df, by, [order], {"_before": ("sum", value)}, descending).drop("_before_all")


def auc_macro_micro(df: DataFrame, label: str, y: str, score: str) -> DataFrame:
    """One row: the mean of the areas of labels that have positives (and negatives), and the area over all rows together."""
    macro = auc(df, y, score, [label]).agg(F.avg("auc").alias("auc_macro"))
    return macro.join(auc(df, y, score).withColumnRenamed("auc", "auc_micro"))  # one row each


def pr_curve(df: DataFrame, y: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, threshold, tp, fp, precision, recall) at every distinct score, predicting rows at or above it."""
    keys = list(by)
    c = df.where(F.col(score).isNotNull()).groupBy(*keys, F.col(score).alias("threshold")).agg(F.count_if(F.col(y) == 1).alias("_p"), F.count_if(F.col(y) == 0).alias("_n"))
    up = running(c, keys, ["threshold"], {"tp": ("sum", "_p"), "fp": ("sum", "_n")}, descending=True)
    tp, fp = F.col("tp") + F.col("_p"), F.col("fp") + F.col("_n")
    return up.select(*keys, "threshold", tp.alias("tp"), fp.alias("fp"), _ratio(tp, tp + fp).alias("precision"), _ratio(tp, F.col("tp_all")).alias("recall"))


def precision_at_recall_by_score(df: DataFrame, y: str, score: str, recall: float, by: Sequence[str] = ()) -> DataFrame:
    """(by, threshold, precision): at the highest score that leaves at least this share of the positives at or above it."""
    return pr_curve(df, y, score, by).where(F.col("recall") >= recall).groupBy(*by).agg(F.max_by("precision", "threshold").alias("precision"), F.max("threshold").alias("threshold"))


def recall_at_precision_by_score(df: DataFrame, y: str, score: str, precision: float, by: Sequence[str] = ()) -> DataFrame:
    """(by, threshold, recall): at the lowest score from which on the precision is at least this; none where no score gives it."""
    return pr_curve(df, y, score, by).where(F.col("precision") >= precision).groupBy(*by).agg(F.min_by("recall", "threshold").alias("recall"), F.min("threshold").alias("threshold"))


def size_summary(df: DataFrame, split: str, feature: str, synthetic: str) -> DataFrame:
    """Rows of each (split, feature), natural and synthetic, with the natural share."""
    s = F.col(synthetic)
    return df.groupBy(split, feature).agg(F.count("*").alias("n"), F.count_if(~s).alias("natural"), F.count_if(s).alias("synthetic"), F.avg((~s).cast("double")).alias("natural_share"))


def positive_scores(df: DataFrame, scores: str, threshold: float, order: Sequence[str], n: int) -> DataFrame:
    """The n rows of highest best score among those where any label's score is above the threshold (n is the selection's size)."""
    best = df.withColumn("best", F.array_max(scores)).where(F.col("best") > threshold)
    return best.orderBy(F.desc("best"), *order).limit(n)


def frequent_categories(df: DataFrame, category: str, top: int, least: int = 2) -> DataFrame:
    """(category, n): the largest categories of at least ``least`` members; if there are none, the largest of all (top is the report's length)."""
    counts = df.where(F.col(category).isNotNull()).groupBy(category).agg(F.count("*").alias("n"))
    most = counts.agg(F.max("n").alias("_most"))  # one row
    fit = counts.join(most).where((F.col("n") >= least) | (F.col("_most") < least)).drop("_most")
    return fit.orderBy(F.desc("n"), category).limit(top)


def any_label(df: DataFrame, doc: str, y: str, score: str) -> DataFrame:
    """One row per document: any true label, the largest score."""
    return df.groupBy(doc).agg(F.max(y).alias(y), F.max(score).alias(score))


def by_length_bin(df: DataFrame, length: str, y: str, yhat: str, bins: int = 10, top: float = 5.0) -> DataFrame:
    """F1 by bins of log10 length."""
    b = F.least(F.floor(F.log10(F.greatest(F.col(length), F.lit(1))) / F.lit(top / bins)), F.lit(bins - 1)).cast("int")
    return multilabel(df.withColumn("length_bin", b), "length_bin", y, yhat)


def labelled_share(swept: DataFrame, total: Column) -> DataFrame:
    return swept.withColumn("share_labelled", (F.col("tp") + F.col("fp")) / total)


def multi_hot(labels: Column, order: Sequence[str]) -> Column:
    return F.transform(F.array(*map(F.lit, order)), lambda x: F.array_contains(labels, x).cast("int"))
