"""Sinks and readers of results: feature records as JSON lines, cohorts, run results, predictions, wide tables of strings, code dictionaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_records(records: DataFrame, path: str, entity: str, buckets: int = 256) -> None:
    """Feature records as JSON lines, an entity's together in one bucket's files; timestamps as ISO text."""
    dated = [f.name for f in records.schema.fields if f.dataType.simpleString() in ("timestamp", "timestamp_ntz")]
    out = records.withColumns({c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS") for c in dated})
    bucket = F.pmod(F.xxhash64(F.col(entity)), F.lit(buckets)).cast("int")
    out.withColumn("bucket", bucket).repartition("bucket").sortWithinPartitions("bucket", entity).write.mode("overwrite").partitionBy("bucket").json(path)


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of :func:`write_records` by an explicit schema (DDL); fields that a line lacks are null."""
    return spark.read.schema(schema).json(path)


def write_cohort(path: str, members: DataFrame, pairs: DataFrame, key: str, arm: str, case: str, control: str) -> None:
    """Three tables: members (key, role), pairs, and match_stats with the counts of both."""
    members.select(key, F.when(F.col(arm) == 1, "case").otherwise("control").alias("role")).write.mode("overwrite").parquet(f"{path}/members")
    pairs.write.mode("overwrite").parquet(f"{path}/pairs")
    match_stats(members, pairs, arm, case, control).write.mode("overwrite").parquet(f"{path}/match_stats")


def match_stats(members: DataFrame, pairs: DataFrame, arm: str, case: str, control: str) -> DataFrame:
    """One row: cases, controls, pairs, used cases and controls, share of the cases matched."""
    people = members.agg(F.count_if(F.col(arm) == 1).alias("cases"), F.count_if(F.col(arm) == 0).alias("controls"))
    used = pairs.agg(F.count("*").alias("pairs"), F.count_distinct(case).alias("used_cases"), F.count_distinct(control).alias("used_controls"))
    both = people.join(used)  # one row each
    return both.withColumn("matched_share", F.col("used_cases") / F.nullif(F.col("cases"), F.lit(0)))


def append_runs(runs: DataFrame, path: str) -> None:
    """Run results appended as JSON lines, for :func:`tidemark.sources.tables.latest_runs`."""
    runs.write.mode("append").json(path)


def write_predictions(scored: DataFrame, path: str, doc: str, position: str, text: str, gold: str, scores: str) -> None:
    """Raw predictions: document, position, text, gold vector and score vector."""
    scored.select(doc, position, text, F.col(gold).cast("array<double>").alias("gold"), F.col(scores).cast("array<double>").alias("scores")).write.mode("overwrite").parquet(path)


def read_wide_strings(spark: SparkSession, path: str) -> DataFrame:
    """A wide CSV with every column as text, so that no type is guessed from the rows."""
    return spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')


def code_dictionary(spark: SparkSession, path: str, code_type: str | None = None) -> DataFrame:
    """(code, code_type, description) of JSON lines, of one code type if given."""
    codes = spark.read.schema("code string, code_type string, description string").json(path).dropDuplicates(["code", "code_type"])
    return codes.where(F.col("code_type") == code_type) if code_type else codes
