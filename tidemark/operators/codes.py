"""Joins of codes with tables of prefixes, without a non-equi join: keys are exploded and matched by equality."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def like_any(c: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.like(p) for p in patterns], F.lit(False))


def pair_semi(facts: DataFrame, codes: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key columns are in a code list; a left semi join, broadcast when Spark finds it small."""
    return facts.join(codes.select(*on).distinct(), on, "left_semi")


def prefix_join(facts: DataFrame, dim: DataFrame, code: str, prefix: str, policy: str = "longest", order: str | None = None, row: list[str] | None = None) -> DataFrame:
    """Each distinct code matched with one prefix row: the longest, or the first by ``order``; unmatched codes keep nulls.

    Distinct codes are matched once, through every prefix of the code, and joined back to the facts.
    ``row`` names the dimension's columns to bring (all but the prefix if None).
    """
    bring = row or [c for c in dim.columns if c != prefix]
    codes = facts.select(F.col(code).alias("_code")).where("_code is not null").distinct()
    cut = codes.where("length(_code) > 0").selectExpr("_code", "explode(transform(sequence(1, length(_code)), n -> substring(_code, 1, n))) AS _prefix")
    best = F.max_by if policy == "longest" else F.min_by
    by = F.length("_prefix") if policy == "longest" else F.col(order)
    packed = F.struct(F.col("_prefix").alias("matched_prefix"), *bring)
    hits = cut.join(dim.withColumnRenamed(prefix, "_prefix"), "_prefix").groupBy("_code").agg(best(packed, by).alias("_hit")).select("_code", "_hit.*")
    return facts.join(hits, facts[code] == hits["_code"], "left").drop("_code")


def strict_prefix_join(facts: DataFrame, dim: DataFrame, code: str, prefix: str) -> tuple[DataFrame, DataFrame]:
    """(matched, rejects): longest prefix, with the rows whose code has none set apart."""
    out = prefix_join(facts, dim, code, prefix)
    return out.where("matched_prefix is not null"), out.where("matched_prefix is null").select(*facts.columns)


def label_or_code(facts: DataFrame, dim: DataFrame, code: str, prefix: str, label: str, order: str) -> DataFrame:
    """Adds the label of the first matching prefix in table order, else the code itself."""
    return prefix_join(facts, dim, code, prefix, "first", order, [label]).withColumn(label, F.coalesce(label, code)).drop("matched_prefix")


def boundary_match(facts: DataFrame, dim: DataFrame, code: str, code_type: str | None = None) -> DataFrame:
    """Boundary-aware match with ``dim`` (code, ...): exact, then dotted prefixes from long to short, then the part before the first dot.

    200.5 never matches a category 20; 200 does match 200.5. With ``code_type`` both sides must agree on it.
    """
    keys = ["_code"] + (["_type"] if code_type else [])
    codes = facts.select(F.col(code).alias("_code"), *([F.col(code_type).alias("_type")] if code_type else [])).where("_code is not null").distinct()
    dotted = """CASE WHEN instr(_code, '.') > 0
        THEN array_union(array(_code), transform(sequence(length(_code), instr(_code, '.') - 1, -1), n -> rtrim('.', substring(_code, 1, n))))
        ELSE array(_code) END"""
    tried = codes.selectExpr(*keys, f"posexplode(array_distinct({dotted})) AS (_rank, _try)")
    bring = [c for c in dim.columns if c not in ("code", code_type)]
    right = dim.select(F.col("code").alias("_try"), *([F.col(code_type).alias("_type")] if code_type else []), F.struct(F.col("code").alias("matched_code"), *bring).alias("_row"))
    hits = tried.join(right, ["_try"] + (["_type"] if code_type else [])).groupBy(*keys).agg(F.min_by("_row", "_rank").alias("_row")).select(*keys, "_row.*")
    on = (facts[code] == hits["_code"]) & ((facts[code_type] == hits["_type"]) if code_type else F.lit(True))
    return facts.join(hits, on, "left").drop(*keys)


def rows_by_prefix(facts: DataFrame, prefixes: DataFrame, code: str, strict_type: str | None = None) -> DataFrame:
    """Facts whose code starts with any of the prefixes, each once. ``prefixes`` (prefix[, type column])."""
    keys = [code] + ([strict_type] if strict_type else [])
    codes = facts.select(*keys).where(F.col(code).isNotNull() & (F.length(code) > 0)).distinct()
    cut = codes.withColumn("prefix", F.explode(F.expr(f"transform(sequence(1, length(`{code}`)), n -> substring(`{code}`, 1, n))")))
    hit = cut.join(prefixes.distinct(), ["prefix"] + ([strict_type] if strict_type else []), "left_semi").select(*keys).distinct()
    return facts.join(hit, keys, "left_semi")


def code_flags(facts: DataFrame, dim: DataFrame, key: str, code: str, code_type: str, date: str | None = None) -> DataFrame:
    """Long (key, feature, n, n_dates): which features of ``dim`` (feature, code_type, prefix) an entity's codes hit."""
    codes = facts.select(F.col(code).alias("_c"), F.col(code_type).alias("_t")).where("_c is not null and length(_c) > 0").distinct()
    cut = codes.selectExpr("_c", "_t", "explode(transform(sequence(1, length(_c)), n -> substring(_c, 1, n))) AS prefix")
    features = cut.join(dim.select("feature", F.col("code_type").alias("_t"), "prefix"), ["_t", "prefix"]).select("_c", "_t", "feature").distinct()
    hits = facts.join(features, (facts[code] == features["_c"]) & (facts[code_type] == features["_t"]))
    dates = F.count_distinct(F.to_date(date)) if date else F.lit(None).cast("long")
    return hits.groupBy(key, "feature").agg(F.count("*").alias("n"), dates.alias("n_dates"))


def typed_option(facts: DataFrame, key: str, code: str, code_type: str, prefixes: dict[str, list[str]], yes: str = "A", no: str = "B") -> DataFrame:
    """(key, option): ``yes`` where any code of the entity starts with a prefix of its own type, ``no`` otherwise, null without codes."""
    hit = reduce(lambda a, b: a | b, [(F.col(code_type) == t) & F.col(code).startswith(p) for t, ps in prefixes.items() for p in ps], F.lit(False))
    return facts.groupBy(key).agg(F.when(F.count(code) > 0, F.when(F.coalesce(F.max(hit), F.lit(False)), yes).otherwise(no)).alias("option"))
