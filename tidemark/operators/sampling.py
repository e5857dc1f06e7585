"""Deterministic samples and splits: order by a seeded hash, never by chance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import ranked, running


def draw(seed: int, *keys: str) -> Column:
    """A number in [0, 1) that depends on the keys and the seed only."""
    return (F.xxhash64(F.lit(seed), *keys).bitwiseAND(F.lit((1 << 52) - 1))) / F.lit(float(1 << 52))


def one_per_key(df: DataFrame, key: str, order: Sequence) -> DataFrame:
    """One row per key: the first by ``order``. An aggregate, so a key with very many rows is reduced before the shuffle."""
    rest = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(key, "_row.*").select(*df.columns)


def per_class(df: DataFrame, c: str, n: int, order: Sequence) -> DataFrame:
    """The first n rows of each class by ``order``."""
    w = Window.partitionBy(c).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def first_k_keys(df: DataFrame, key: str, order: Sequence, k: int) -> DataFrame:
    """All rows of the k keys whose first row comes earliest."""
    firsts = df.groupBy(key).agg(F.min(F.struct(*order)).alias("_first")).orderBy("_first", key).limit(k)
    return df.join(firsts.select(key), key, "left_semi")


def head_split(df: DataFrame, stratum: str, order: Sequence, eval_fraction: float) -> DataFrame:
    """Adds ``split``: the first rows of each stratum are eval, the rest train. A stratum may hold any share of the rows."""
    placed = running(df, [stratum], order, {"_n": ("sum", F.lit(1).cast("long"))})
    return placed.select(*df.columns, F.when(F.col("_n") < F.floor(F.col("_n_all") * eval_fraction), "eval").otherwise("train").alias("split"))


def three_way_split(df: DataFrame, pool: str, order: Sequence, train: str = "train", halves: tuple[str, str] = ("train", "validation"), rest: str = "test", most: int | None = None) -> DataFrame:
    """Adds ``split``: rows of the pool ``train`` are halved in the given order, the smaller half last; all other rows are ``rest``.

    ``most`` keeps that many rows of each half, the first in order (the size of a training run); the rest is kept whole. A null pool is ``rest``.
    """
    placed = running(df, [pool], order, {"_n": ("sum", F.lit(1).cast("long"))})
    first = F.col("_n") < F.ceil(F.col("_n_all") / 2)
    split = F.when(F.col(pool) == train, F.when(first, halves[0]).otherwise(halves[1])).otherwise(rest)
    place = F.when(first, F.col("_n")).otherwise(F.col("_n") - F.ceil(F.col("_n_all") / 2))
    out = placed.withColumn("split", split)
    if most is not None:
        out = out.where((F.col("split") == rest) | (place < most))
    return out.select(*df.columns, "split")


def key_split(df: DataFrame, key: str, fractions: dict[str, float], seed: int = 0) -> DataFrame:
    """Adds ``split`` by the key's draw, so all rows of a key fall together; no shuffle."""
    u, edge, out = draw(seed, key), 0.0, None
    for name, part in list(fractions.items())[:-1]:
        edge += part
        out = F.when(u < edge, name) if out is None else out.when(u < edge, name)
    last = list(fractions)[-1]
    return df.withColumn("split", out.otherwise(last) if out is not None else F.lit(last))


def downsample(df: DataFrame, n: int, seed: int, *keys: str) -> DataFrame:
    return df.orderBy(draw(seed, *keys), *keys).limit(n)


def stride(df: DataFrame, by: str, order: Sequence, step: int) -> DataFrame:
    """Every ``step``-th row of each group, from the first."""
    return ranked(df, [by], order, "_n").where((F.col("_n") - 1) % step == 0).drop("_n")


def pack_budget(df: DataFrame, by: str, order: Sequence, cost: str, budget: float, separator: float = 0) -> DataFrame:
    """Rows of each group in order while their running cost (and separators between them) stays within the budget."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    running = F.sum(F.col(cost) + separator).over(w) - separator
    return df.withColumn("running", running).where(F.col("running") <= budget)


def weighted_choice(groups: DataFrame, by: str, order: Sequence, weight: str, seed: int) -> DataFrame:
    """One group per ``by``, chosen in proportion to its weight by a hashed draw."""
    w = Window.partitionBy(by)
    upto = F.sum(weight).over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    picked = groups.withColumns({"_upto": upto, "_all": F.sum(weight).over(w)}).where(F.col("_upto") > draw(seed, by) * F.col("_all"))
    rest = [c for c in groups.columns if c != by]
    return picked.groupBy(by).agg(F.min_by(F.struct(*rest), "_upto").alias("_row")).select(by, "_row.*").select(*groups.columns)


def hashed_page(df: DataFrame, key: str, n: int, offset: int = 0, tail: int = 5) -> DataFrame:
    """A page of a pseudo-random order: by the last characters of the id, then the id (n and offset are the page)."""
    text = F.col(key).cast("string")
    return df.orderBy(F.substring(text, -tail, tail), text).offset(offset).limit(n)


def swapped_sentences(df: DataFrame, doc: str, order: str, text: str, share: float, seed: int, number: Column | None = None) -> DataFrame:
    """Adds ``swapped`` text and its label: the drawn sentences of a document trade places in a circle, the others stay (label 0).

    ``number`` (from 0 to 1) is what a sentence draws, by default a hash of document, place and seed. A document with a single drawn sentence keeps it.
    """
    drawn = df.withColumn("_u", draw(seed, doc, order) if number is None else number).where(F.col("_u") < share)
    circle = Window.partitionBy(doc)
    following = F.coalesce(F.lead(text).over(circle.orderBy("_u", order)), F.first(text).over(circle.orderBy("_u", order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    moved = drawn.withColumns({"swapped": following, "_n": F.count("*").over(circle)}).where("_n > 1").select(doc, order, "swapped", F.lit(1).alias("label"))
    return df.join(moved, [doc, order], "left").withColumns({"swapped": F.coalesce("swapped", text), "label": F.coalesce("label", F.lit(0))})


def listed_split(df: DataFrame, key: str, splits: DataFrame, default: str | None = None) -> DataFrame:
    """Adds ``split`` from id lists (key, split); ids in no list get the default. An id in several lists takes the first by name."""
    one = splits.groupBy(key).agg(F.min("split").alias("split"))
    out = df.join(one, key, "left")
    return out.withColumn("split", F.coalesce("split", F.lit(default))) if default is not None else out


def older_column(df: DataFrame, older: DataFrame, key: str, column: str) -> DataFrame:
    """``column`` of an older snapshot where this one lacks it: the column, or its value in a row. Of several values of a key the least counts."""
    past = older.groupBy(key).agg(F.min(column).alias("_old"))
    own = F.col(column) if column in df.columns else F.lit(None)
    return df.join(past, key, "left").withColumn(column, F.coalesce(own, "_old")).drop("_old")


def id_sets(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, held): each id of either set once, as ``both``, ``first`` or ``second``."""
    one = a.select(key).where(F.col(key).isNotNull()).select(key, F.lit(1).alias("_s")).union(b.select(key).where(F.col(key).isNotNull()).select(key, F.lit(2).alias("_s")))
    s = one.groupBy(key).agg(F.bit_or("_s").alias("_s"))
    return s.select(key, F.when(F.col("_s") == 3, "both").when(F.col("_s") == 1, "first").otherwise("second").alias("held"))


def numbered(df: DataFrame, order: str, width: int = 2) -> DataFrame:
    """Adds ``number``, from 0 in the order of a text column of distinct values; texts are ordered within their first characters, so no task sees them all."""
    cut = df.withColumn("_head", F.substring(order, 1, width))
    heads = cut.groupBy("_head").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_head").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row for each pair of characters
    place = F.row_number().over(Window.partitionBy("_head").orderBy(order)) - 1
    return cut.join(heads.select("_head", before.alias("_before")), "_head").withColumn("number", F.col("_before") + place).drop("_head", "_before")


def vocabulary(df: DataFrame, tokens: str, unknown: str = "UNK") -> DataFrame:
    """(token, n, id): the tokens of arrays with their counts and ids in order; the unknown token comes last, with count 0."""
    counts = df.select(F.explode(tokens).alias("token")).where("token is not null").groupBy("token").agg(F.count("*").alias("n"))
    known = numbered(counts, "token").withColumnRenamed("number", "id")
    last = counts.agg(F.count("*").alias("id")).select(F.lit(unknown).alias("token"), F.lit(0).cast("long").alias("n"), "id")
    return known.select("token", "n", "id").union(last)
