"""Helpers shared by the training-data operators: scratch tables and connected components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read by Spark (so any store that Spark reads will do)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which the driver and all executors share.

    Only where the session has none (tests, notebooks) is a local one made and set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, bucket: str | None = None, buckets: int = 0) -> DataFrame:
    """``df`` written once to the shared folder and read again: cuts lineage, survives lost executors.

    With ``bucket`` the rows lie in so many buckets of that column, so that a join on it does not move them. What the write shuffled is not needed again; Spark deletes it as soon as the driver collects its own garbage, so that
    is done here.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    if bucket:
        table_name = path.rsplit("/", 1)[1].replace("-", "_")
        df.write.format("parquet").bucketBy(buckets, bucket).option("path", path).saveAsTable(table_name)
        out = spark.table(table_name)
        _named[path] = table_name
    else:
        df.write.parquet(path)
        out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    release(spark)
    return out


#: Tables that operators have written, by application, and that nobody has discarded; names of those that the catalogue knows.
_written: dict[str, list[str]] = {}
_named: dict[str, str] = {}


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files and broadcasts of plans that nothing refers to any more; the driver's Python gives free memory back."""
    give_back()
    spark._jvm.java.lang.System.gc()


def give_back() -> None:
    """Free memory of this Python process goes back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError):  # only where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


#: Bytes of a batch, about, that a function gets at once.
BATCH_BYTES = 4 << 20


def in_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of bounded size: Spark counts rows, and ten thousand whole texts become strings many times that large."""
    for batch in batches:
        if getattr(batch, "nbytes", 0) <= BATCH_BYTES:
            yield batch
            continue
        rows = max(1, batch.num_rows * BATCH_BYTES // batch.nbytes)
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def emptied(work: Callable) -> Callable:
    """``work`` for ``mapInArrow``: batches come in parts, and its worker gives free memory back in the end (Spark keeps it for other tasks, with all that it once took)."""

    @wraps(work)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(in_parts(batches))
        give_back()

    return run


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder, by the file system that its path names."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def discard_paths(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables by their paths, and what the catalogue knows of them."""
    known = _written.get(spark.sparkContext.applicationId, [])
    for path in paths:
        if name := _named.pop(path, None):
            spark.sql(f"DROP TABLE IF EXISTS `{name}`")
        delete(spark, path)
        if path in known:
            known.remove(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables made by :func:`materialise` that nothing needs any more."""
    for df in tables:
        discard_paths(df.sparkSession, [df._scratch_path])


@contextmanager
def recorded(spark: SparkSession) -> Iterator[list[str]]:
    """Gives a list that in the end has the paths of the tables that were written meanwhile and not discarded."""
    before, paths = set(_written.get(spark.sparkContext.applicationId, [])), []
    yield paths
    paths += [p for p in _written.get(spark.sparkContext.applicationId, []) if p not in before]


def free_name(df: DataFrame, name: str) -> str:
    """``name`` behind as many underscores as no column of ``df`` has (names differ by more than case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def sample_by_hash(df: DataFrame, hashed, n: int) -> DataFrame:
    """The rows of the ``n`` smallest different hashes, one for each: a repeatable sample of at most ``n`` rows.

    Tasks pass on ``n`` hashes each, not ``n`` rows, before the rows themselves are picked.
    """
    rows = df.withColumn("_hash", hashed)
    top = rows.select("_hash").distinct().orderBy("_hash").limit(n).agg(F.max("_hash")).first()[0]
    return rows.where(F.col("_hash") <= F.lit(top)).dropDuplicates(["_hash"]).drop("_hash")


def _observed(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges written, and their number and checksum, taken while they are written."""
    seen = Observation()
    sums = F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")
    out = materialise(edges.observe(seen, *sums), "edges")
    return out, (seen.get["n"], seen.get["sum"])


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected edges (a, b: long) as (node, component), component = smallest node.

    Alternating large-star and small-star rounds: each round is two aggregations by node and two
    equi-joins in one job, written to the shared folder. Every component ends as a star around its smallest
    node. Nothing is collected but a count and a checksum per round. Self-loops and null ends are
    ignored; a node without an edge is not in the result.
    """
    edges, state = _observed(edges.where("a is not null and b is not null and a <> b").select("a", "b").distinct())
    for _ in range(max_rounds if state[0] else 0):
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(low.select("a", F.col("m").alias("b"))).distinct()
        )  # every edge runs from the larger node to the smaller
        new, now = _observed(small)
        discard(edges)
        edges, state, old = new, now, state
        if state == old:
            break
    else:
        if state[0]:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
