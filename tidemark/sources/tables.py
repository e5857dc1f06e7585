"""Tables that operators write and read again, increments, and snapshots."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_path(spark: SparkSession, name: str, folder: str | None = None) -> str:
    """A new path in a folder; by default under spark.checkpoint.dir, which executors share."""
    base = folder or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """``df`` written as Parquet to a new folder and read back."""
    spark = df.sparkSession
    path = new_path(spark, name, folder)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def anti_processed(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key has not been processed."""
    return df.join(done.select(key).distinct(), key, "left_anti")


def recycle(snapshots: DataFrame, fresh: DataFrame, key: str, feature: str, priority: str, stale: Sequence[str] = ()) -> DataFrame:
    """Each entity's records from its first snapshot in priority order, stale features dropped, fresh ones added."""
    first = snapshots.groupBy(key).agg(F.min(priority).alias("_p"))
    kept = snapshots.join(first, key).where(F.col(priority) == F.col("_p")).drop("_p")
    kept = kept.where(~F.col(feature).isin(*stale)) if stale else kept
    return kept.drop(priority).unionByName(fresh, allowMissingColumns=True)


def refreshed(
    snapshots: DataFrame, versions: DataFrame, key: str, feature: str, priority: str, version: str, value: str, recompute: Callable[[DataFrame], DataFrame],
    backfill: DataFrame | None = None, backfill_feature: str = "age",
) -> DataFrame:
    """Records of an earlier extraction brought up to date: (key, feature, value and the snapshots' other columns, version).

    Each entity keeps the records of its first snapshot in priority order, but for features of which ``versions`` (feature, version: the
    feature dimension, which is collected) has a later version. ``recompute`` gets the (key, feature) pairs that are stale or missing, and only these, and
    gives their records; a pair without a record gets one with a null value, so that a second run over the result has nothing to do.
    Features that ``versions`` does not list stay as they are. ``backfill`` (key, value) fills a null or missing ``backfill_feature`` at last.
    """
    now = {r[0]: r[1] for r in versions.select(feature, version).collect()}
    current = snapshots.sparkSession.createDataFrame(list(now.items()), f"`{feature}` string, _now {dict(snapshots.dtypes)[version]}")
    first = snapshots.groupBy(key).agg(F.min(priority).alias("_p"))
    mine = snapshots.join(first.select(F.col(key).alias("_k"), "_p"), F.col(key).eqNullSafe(F.col("_k")) & (F.col(priority) == F.col("_p"))).drop("_k", "_p", priority)
    kept = mine.join(current, feature, "left").where("_now is null").drop("_now").unionByName(mine.join(current, feature).where(F.col(version) >= F.col("_now")).drop("_now"))
    held = kept.select(key, feature).distinct().withColumn("_kept", F.lit(True)).unionByName(first.select(key, F.lit(None).cast("string").alias(feature), F.lit(True).alias("_kept")))
    lacking = held.groupBy(key).agg(F.array_except(F.array(*[F.lit(n) for n in sorted(now)]), F.collect_set(feature)).alias("_todo"))  # as many as there are features
    todo = written(lacking.select(key, F.explode("_todo").alias(feature)), "stale")
    fresh = recompute(todo)
    found = todo.join(fresh.withColumnsRenamed({key: "_k", feature: "_f"}), F.col(key).eqNullSafe(F.col("_k")) & (F.col(feature) == F.col("_f")), "left").drop("_k", "_f")
    fresh = found.join(current, feature).withColumnRenamed("_now", version)
    out = kept.unionByName(fresh, allowMissingColumns=True).select(*[c for c in snapshots.columns if c != priority])
    if backfill is None:
        return out
    older = backfill.groupBy(F.col(key).alias("_k")).agg(F.min(value).alias("_old"))
    aged = out.where(F.col(feature) == backfill_feature)
    bare = first.select(key).join(aged.select(F.col(key).alias("_k")).distinct(), F.col(key).eqNullSafe(F.col("_k")), "left_anti").withColumn(feature, F.lit(backfill_feature))
    aged = aged.unionByName(bare, allowMissingColumns=True).join(older, F.col(key).eqNullSafe(F.col("_k")), "left").withColumn(value, F.coalesce(value, "_old")).drop("_k", "_old")
    return out.where(F.col(feature) != backfill_feature).unionByName(aged.where(F.col(value).isNotNull() | F.col(version).isNotNull()))


def latest_runs(df: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """The latest record of each run name."""
    rest = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*by, "_r.*").select(*df.columns)


def write_replaced(df: DataFrame, path: str, cluster_by: str | None = None) -> None:
    """One job that replaces the table; rows of an entity lie together when ``cluster_by`` is given."""
    out = df.repartition(cluster_by).sortWithinPartitions(cluster_by) if cluster_by else df
    out.write.mode("overwrite").parquet(path)


def write_wide_csv(df: DataFrame, path: str, first: Sequence[str] = ()) -> None:
    df.select(*first, *sorted(c for c in df.columns if c not in first)).write.mode("overwrite").csv(path, header=True)


def id_lines(df: DataFrame, key: str, prefix: str = "EMPI:") -> DataFrame:
    """Distinct ids as text lines for an export."""
    return df.select(F.col(key).cast("string").alias("_k")).where("_k is not null").distinct().select(F.concat(F.lit(prefix), "_k").alias("value"))


def union_aliased(tables: Sequence[tuple[DataFrame, dict[str, str], str]]) -> DataFrame:
    """Tables with different column names under common ones: (table, {common: own}, source name)."""
    out = None
    for df, names, source in tables:
        part = df.select(*[F.col(own).alias(common) for common, own in names.items()], F.lit(source).alias("source_table"))
        out = part if out is None else out.unionByName(part)
    return out


def training_rows(df: DataFrame, instruction: str, text: str, answer: str, split: str, index: str = "index") -> DataFrame:
    """Nested rows for tuning: prompt messages, reward model and extra information; ``index`` is a column such as :func:`row_index` adds."""
    message = F.struct(F.lit("user").alias("role"), F.concat_ws("\n\n", F.lit(instruction), F.col(text)).alias("content"))
    return df.where(F.col(answer).isNotNull()).select(
        F.array(message).alias("prompt"), F.struct(F.lit("rule").alias("style"), F.col(answer).cast("string").alias("ground_truth")).alias("reward_model"),
        F.struct(F.lit(split).alias("split"), F.col(index).cast("long").alias("index")).alias("extra_info"),
    )


def row_index(df: DataFrame, *order: str) -> DataFrame:
    """Adds ``index``, from 0 in the given order: rows are dealt by ranges, counted by range and numbered within each.

    Equal rows are numbered in any order.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()})
    placed = written(placed, "indexed")
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a range
    starts = sizes.select("_part", before.alias("_before"), "_first")
    return placed.join(starts, "_part").withColumn("index", F.col("_before") + F.col("_at") - F.col("_first")).drop("_part", "_at", "_before", "_first")


def labelled_chunks(labels: DataFrame, remap: DataFrame, synthetic: DataFrame | None = None) -> DataFrame:
    """Labels under requested names: ``remap`` (feature, source_feature); nulls and DROP leave; ``is_synthetic`` tells the source."""
    rows = labels.withColumn("is_synthetic", F.lit(False))
    if synthetic is not None:
        rows = rows.unionByName(synthetic.withColumn("is_synthetic", F.lit(True)))
    rows = rows.where("label is not null and label <> 'DROP'").withColumnRenamed("feature", "source_feature")
    return rows.join(remap, "source_feature").drop("source_feature")
