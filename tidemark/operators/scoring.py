"""User-supplied scorers over tables: batches, a memo of answers, staged decisions, a bag-of-words classifier, review lists."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.sources.tables import new_path


def score(df: DataFrame, scorer: Callable[[pd.DataFrame], pd.DataFrame], schema: StructType | str) -> DataFrame:
    """The scorer's columns for each row, batch by batch; it must return as many rows as it got, in order."""
    added = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    full = StructType(df.schema.fields + added.fields)

    def run(batches):
        for pdf in batches:
            got = scorer(pdf).reset_index(drop=True)
            if len(got) != len(pdf) or list(got.columns) != added.names:
                raise ValueError(f"the scorer gave {len(got)} rows of {list(got.columns)} for {len(pdf)} rows of {added.names}")
            yield pd.concat([pdf.reset_index(drop=True), got], axis=1)[full.names]

    return df.mapInPandas(run, full)


def score_with_memo(df: DataFrame, memo: DataFrame | None, keys: Sequence[str], scorer, schema: str) -> tuple[DataFrame, DataFrame]:
    """(scored rows, new memo rows): each distinct question is asked once, and only if the memo lacks it; null questions are questions too.

    Of several answers that the memo holds to one question the least counts.
    """
    added = StructType.fromDDL(schema).names
    asked = df.select(*keys).distinct()
    same = lambda a, b: reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys])
    held = None if memo is None else memo.groupBy(*keys).agg(F.min(F.struct(*added)).alias("_answer")).select(*keys, "_answer.*")
    todo = asked if held is None else asked.join(held, same(asked, held), "left_anti")
    fresh = score(todo, scorer, schema)
    known = (fresh if held is None else held.unionByName(fresh)).select(*keys, *added)
    return df.join(known, same(df, known)).select(df["*"], *[known[c] for c in added]), fresh


def staged(took: Column, explicit_days: Column, pill_days: Column) -> Column:
    """Not taken: 0. Taken: the explicit duration, else the one from pill counts, else F for unknown."""
    return F.when(took == "No", "0").when(took == "Yes", F.coalesce(explicit_days.cast("string"), pill_days.cast("string"), F.lit("F")))


def keyword_scorer(keyword: str, text: str = "text") -> Callable[[pd.DataFrame], pd.DataFrame]:
    """A rule for tests: Yes where the keyword is in the text."""
    return lambda pdf: pd.DataFrame({"prediction": pdf[text].fillna("").str.contains(keyword, case=False, regex=False).map({True: "Yes", False: "No"})})


def train_bow(train: DataFrame, text: str, labels: Sequence[str], vocabulary: int = 1 << 14, tf_idf: bool = True):
    """A pipeline model of word counts (or TF-IDF) and one logistic regression per 0/1 label column.

    The fitted model is written to the shared folder and read again: what is returned holds weights only, not the
    training summaries, which drag the session's plans into every task.
    """
    from pyspark.ml import Pipeline, PipelineModel
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, CountVectorizer, RegexTokenizer

    stages = [RegexTokenizer(inputCol=text, outputCol="_tokens", pattern=r"\W+"), CountVectorizer(inputCol="_tokens", outputCol="_tf", vocabSize=vocabulary)]
    if tf_idf:
        stages.append(IDF(inputCol="_tf", outputCol="_x"))
    x = "_x" if tf_idf else "_tf"
    for label in labels:
        stages.append(LogisticRegression(featuresCol=x, labelCol=label, predictionCol=f"{label}_hat", probabilityCol=f"{label}_prob", rawPredictionCol=f"{label}_raw", maxIter=20, regParam=0.01))
    path = new_path(train.sparkSession, "bow")
    Pipeline(stages=stages).fit(train).write().overwrite().save(path)
    return PipelineModel.load(path)


def bow_scores(model, df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """``df`` with the probability of each label as ``{label}_score``."""
    from pyspark.ml.functions import vector_to_array

    out = model.transform(df)
    return out.select(*df.columns, *[F.get(vector_to_array(f"{label}_prob"), F.lit(1)).alias(f"{label}_score") for label in labels])


def bow_thresholds(model, dev: DataFrame, labels: Sequence[str]) -> DataFrame:
    """(label, threshold, f1): for each label the threshold of the best F1 on development rows."""
    from .evalm import best_threshold, sweep

    scored = bow_scores(model, dev, labels)
    long = scored.select(F.inline(F.array(*[F.struct(F.lit(label).alias("label"), F.col(label).cast("int").alias("y"), F.col(f"{label}_score").alias("score")) for label in labels])))
    return best_threshold(sweep(long, "y", "score", ["label"]), ["label"])


def review_list(df: DataFrame, y: str, score_col: str, threshold: float, kind: str, order: Sequence, n: int) -> DataFrame:
    """The first n false negatives or false positives at a threshold."""
    hit = F.col(score_col) > threshold
    wrong = (F.col(y) == 1) & ~hit if kind == "false_negative" else (F.col(y) == 0) & hit
    return df.where(wrong).orderBy(*order).limit(n)
