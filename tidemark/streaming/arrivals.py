"""New files only: a file stream that takes what has arrived, then stops."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def process_arrivals(spark: SparkSession, folder: str, schema, out: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda d: d, kind: str = "parquet") -> None:
    """Run ``transform`` over files of ``folder`` that no earlier call has seen and append the result to ``out``.

    The checkpoint remembers files, so a call after a failure neither loses nor repeats one.
    """
    arrived = spark.readStream.format(kind).schema(schema).load(folder)
    query = transform(arrived).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
    query.awaitTermination()
