"""Delimited record files: record ends by suffix, rejects kept apart, source profiles, code lists, annotated documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_records(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str], key: str, sep: str = "|", end: str | None = None, pattern: str | None = None, time: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(good, rejects) of files with a header line and ``sep`` between cells; records end with a newline or with ``end`` and a newline.

    A record with too few cells is rejected alone; one with too many keeps the surplus separators in its last cell. Keys are trimmed;
    records without one are rejected. Subfolders are searched; ``pattern`` filters file names.
    """
    reader = spark.read.option("recursiveFileLookup", "true").option("lineSep", f"{end}\n" if end else "\n")
    reader = reader.option("pathGlobFilter", pattern) if pattern else reader
    lines = reader.text(list(path) if not isinstance(path, str) else path).select("value", F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line"))
    header = sep.join(columns)
    body = F.when(F.startswith("value", F.lit(header)), F.substr("value", F.lit(len(header) + 1))).otherwise(F.col("value"))
    body = F.regexp_replace(body, r"^\r?\n|\r?\n$", "")
    cells = lines.select("source_file", "_block", "_line", body.alias("value")).where("trim(value) <> ''").withColumn("cells", F.split("value", r"\|" if sep == "|" else sep, len(columns)))
    named = cells.select("source_file", F.struct("_block", "_line").alias("position"), "value", F.size("cells").alias("width"), *[F.get("cells", F.lit(i)).alias(c) for i, c in enumerate(columns)])
    named = named.withColumn(key, F.trim(key))
    fine = (F.col("width") == len(columns)) & (F.coalesce(F.col(key), F.lit("")) != "")
    good = named.where(fine).drop("value", "width")
    if time:
        good = good.withColumn(time, F.coalesce(F.try_to_timestamp(time, F.lit("M/d/yyyy h:mm:ss a")), F.try_to_timestamp(time, F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(time, F.lit("M/d/yyyy"))))
    reason = F.when(F.col("width") < len(columns), "short").otherwise("no key")
    return good, named.where(~fine).select("source_file", "value", reason.alias("reason"))


def check_rejects(good: DataFrame, rejects: DataFrame, share: float = 0.01) -> None:
    """Raise if the short records reach the share."""
    bad, fine = rejects.where("reason = 'short'").count(), good.count()
    if bad and bad >= share * (bad + fine):
        raise ValueError(f"{bad} of {bad + fine} records are short")


def profile_sources(good: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(source_file, column, sample): the first record of each file, cell by cell."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("sample")) for c in columns])
    one = good.groupBy("source_file").agg(F.min_by(pairs, "position").alias("p"))
    return one.select("source_file", F.explode("p").alias("p")).select("source_file", "p.*")


def code_list(spark: SparkSession, path: str, include: str = "include") -> DataFrame:
    """Distinct (code_type, code) of a CSV list with an include flag."""
    rows = spark.read.csv(path, header=True)
    keep = F.lower(F.trim(include)).isin("1", "true", "yes", "y")
    return rows.where(keep).select(F.trim("code_type").alias("code_type"), F.trim("code").alias("code")).dropDuplicates()


def notes_csv(spark: SparkSession, path: str, names: dict[str, str], source: str, encoding: str = "UTF-8") -> DataFrame:
    """A foreign CSV of notes: quoted line breaks, columns renamed, a constant source."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding=encoding)
    known = {old.lower(): new for old, new in names.items()}  # headers differ in case from file to file
    return rows.withColumnsRenamed({c: known.get(c.strip().lower(), c) for c in rows.columns}).withColumn("source_table", F.lit(source))


def list_cells(df: DataFrame, *columns: str) -> DataFrame:
    """Cells such as "['a', 'b']" as arrays of strings."""
    return df.withColumns({c: F.from_json(F.col(c), "array<string>", {"allowSingleQuotes": "true"}) for c in columns})


def annotated_spans(spark: SparkSession, path: str) -> DataFrame:
    """(id, text, type, start, end) of JSON documents with a span list; spans without a start are left out."""
    schema = "id long, text string, spans array<struct<type:string,start:int,end:int>>"
    docs = spark.read.schema(schema).json(path, multiLine=True)
    return docs.select("id", "text", F.explode("spans").alias("s")).select("id", "text", "s.*").where("start is not null")
