"""Token counts through a digest cache: only texts whose digest is not stored yet are encoded.

The cache is a Parquet folder of (version, digest, n_tokens). ``version`` digests the tokenizer's
file and its settings, so a changed vocabulary never meets old counts. The digest is taken of the
*normalised* content. A normaliser may only fold texts that the tokenizer gives equal counts; the
byte-level tokenizers have no normaliser of their own, so by default it is the identity on UTF-8.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch
from .units import LibraryMemo

CACHE_SCHEMA = "version string, digest string, n_tokens long"


def tokenizer_version(path: str, settings: str = "add_special_tokens=False") -> str:
    """SHA-256 of the tokenizer's file and settings."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + b"\0" + settings.encode()).hexdigest()


def read_cache(spark: SparkSession, folder: str) -> DataFrame:
    """The stored counts; a folder that doesn't exist yet is an empty cache."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(folder)


def _counter(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = LibraryMemo.of(path)
        for batch in batches:
            ids = memo.ids(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("version"), batch.column("digest"), pa.array([len(x) // 4 for x in ids], pa.int64())], ["version", "digest", "n_tokens"])

    return count


def fill_cache(docs: DataFrame, folder: str, path: str, text_col: str = "text", normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """Append the counts of texts that the cache lacks; returns (digest, n_tokens) for the tokenizer.

    Texts are digested once, anti-joined with the cache on (version, digest), and one text of each
    missing digest is encoded. Null texts count as empty. Two runs at once may both append a digest;
    reading takes one of them (they are equal).
    """
    spark, version = docs.sparkSession, tokenizer_version(path)
    text = F.coalesce(F.col(text_col), F.lit(""))
    text = normalise(text) if normalise else text
    rows = docs.select(F.lit(version).alias("version"), F.sha2(text.cast("binary"), 256).alias("digest"), text.alias("text"))
    stored = read_cache(spark, folder).where(F.col("version") == version).select("digest")
    misses = rows.join(stored, "digest", "left_anti") if stored.take(1) else rows
    misses = misses.dropDuplicates(["digest"])
    misses.mapInArrow(_counter(path), CACHE_SCHEMA).write.mode("append").parquet(folder)
    return spark.read.schema(CACHE_SCHEMA).parquet(folder).where(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, path: str, folder: str | None = None, limit: int = 512, id_col: str = "doc_id", text_col: str = "text", normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row, repeated rows and null ids included.

    ``path`` is the tokenizer's file, ``folder`` the cache (none: a new one in the shared folder).
    A null or empty text has 0 bytes and 0 tokens. Other columns are not read.
    """
    counts = fill_cache(docs, folder or scratch(docs.sparkSession, "token-cache"), path, text_col, normalise)
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.sha2((normalise(text) if normalise else text).cast("binary"), 256)
    rows = docs.select(F.col(id_col).alias(id_col), F.octet_length(text).cast("long").alias("n_bytes"), key.alias("digest"))
    return rows.join(counts, "digest").select(id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
