"""Annotated documents and ordered sentences: overlaps, neighbours, contexts, sections, early stops."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def span_overlap(tokens: DataFrame, spans: DataFrame, doc: str, keys: Sequence[str], width: int = 4096) -> DataFrame:
    """Tokens (doc, keys, start, end) with the set of types of the spans (doc, type, start, end) they overlap; ends are inclusive.

    Both sides are filed under the stretches of ``width`` positions that they touch, so a long document is no cross product.
    """
    stretches = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor(F.col(b) / width))).alias("_at")
    s = spans.where("start <= end").select(doc, "type", F.col("start").alias("_s"), F.col("end").alias("_e")).select("*", stretches("_s", "_e"))
    t = tokens.where("start <= end").select(doc, *keys, "start", "end", stretches("start", "end"))
    hits = t.join(s, [doc, "_at"]).where("start <= _e and _s <= end").groupBy(doc, *keys).agg(F.array_sort(F.collect_set("type")).alias("types"))
    return tokens.join(hits, [doc, *keys], "left").withColumn("types", F.coalesce("types", F.array().cast("array<string>")))


def expand_context(df: DataFrame, doc: str, order: str, boundary: Column, text: str, target: Column, joiner: str = " ") -> DataFrame:
    """(doc, order, context): for each target row, the text from the nearest boundary row before it to the nearest after it, both included.

    Boundaries number the stretches of a document; a boundary row ends one and begins the next. Targets meet the rows of
    their own stretch (a boundary target: of both), so the join makes what the contexts hold and no more.
    """
    w = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    edge = F.coalesce(boundary, F.lit(False)).cast("int")
    marked = df.withColumn("_edge", edge).withColumn("_k", F.sum("_edge").over(w))
    stretches = F.explode(F.when(F.col("_edge") == 1, F.array(F.col("_k") - 1, "_k")).otherwise(F.array("_k"))).alias("_k")
    wanted = marked.where(target).select(doc, F.col(order).alias("_at"), stretches)
    parts = wanted.join(marked.select(doc, order, text, stretches), [doc, "_k"]).dropDuplicates([doc, "_at", order])
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda r: r[text]), joiner)
    return parts.groupBy(doc, "_at").agg(joined.alias("context")).withColumnRenamed("_at", order)


def neighbours(df: DataFrame, doc: str, order: str, text: str, n: int = 1, start: str = "<s>", end: str = "</s>") -> DataFrame:
    """Adds ``before`` and ``after``: the n texts around each row by position, padded at the ends; and ``position`` in the document."""
    w = Window.partitionBy(doc).orderBy(order)
    before = F.array(*[F.coalesce(F.lag(text, k).over(w), F.lit(start)) for k in range(n, 0, -1)])
    after = F.array(*[F.coalesce(F.lead(text, k).over(w), F.lit(end)) for k in range(1, n + 1)])
    place = (F.row_number().over(w) - 1) / F.count("*").over(Window.partitionBy(doc))
    return df.withColumns({"before": before, "after": after, "position": place})


def section_state(df: DataFrame, doc: str, order: str, on: Column, off: Column) -> DataFrame:
    """Adds ``inside``: true from a row where ``on`` holds to before the next where ``off`` holds."""
    mark = F.when(F.coalesce(on, F.lit(False)), True).when(F.coalesce(off, F.lit(False)), False)
    w = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("inside", F.coalesce(F.last(mark, True).over(w), F.lit(False)))


def short_circuit(df: DataFrame, by: Sequence[str], order: str, conclusive: Column) -> DataFrame:
    """Rows of each group up to and with the first conclusive one; all rows where there is none."""
    first = F.min(F.when(F.coalesce(conclusive, F.lit(False)), F.col(order))).over(Window.partitionBy(*by))
    return df.withColumn("_stop", first).where(F.col("_stop").isNull() | (F.col(order) <= F.col("_stop"))).drop("_stop")


def sentence_at(asked: DataFrame, sentences: DataFrame, doc: str, order: str, text: str, place: str) -> DataFrame:
    """``asked`` with the ``sentence`` at (document, place); rows that name no sentence leave."""
    own = sentences.select(F.col(doc).alias("_doc"), F.col(order).alias("_place"), F.col(text).alias("sentence"))
    return asked.join(own, (asked[doc] == F.col("_doc")) & (asked[place] == F.col("_place"))).drop("_doc", "_place")
