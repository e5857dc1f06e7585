"""Embedding near-duplicates by an epsilon grid order join.

Unit vectors are projected on a few leading principal directions and cut into grid cells of side
epsilon, the distance that the cosine threshold allows. Within a label, rows are sorted by their cells
(the epsilon grid order) and the sorted sequence is cut into blocks of bounded size. A pair of blocks is
joined only if the boxes of their projections are within epsilon in every direction, which no pair of
near vectors can violate. Pairs of intervals are found by a recursive join: boxes of ever longer intervals are
built, the longest meet first, and a pair of intervals that isn't too far apart is taken apart in a join with their parts.

Equal vectors of a label are folded into one row with a count first. A pair of blocks returns, for each
vector, how many vectors it links to and the edges of a spanning forest, never all its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, materialise, sample_by_hash

#: Leading directions, rows in the sample that they are fitted on, rows to a block, rows to a cell range.
DIMENSIONS, SAMPLE, BLOCK = 8, 5000, 512
#: An interval has 2^FAN parts; intervals are built LEVELS times over.
FAN, LEVELS = 4, 3
_VECTOR = "array<double>"


def principal_directions(vectors: DataFrame, dims: int = DIMENSIONS, sample: int = SAMPLE) -> np.ndarray | None:
    """Leading principal directions (dims x width) of a bounded sample; any orthonormal ones would be exact."""
    rows = sorted(sample_by_hash(vectors.select("unit"), F.xxhash64("unit"), sample).collect())
    if not rows:
        return None
    width = max(len(r[0]) for r in rows)
    x = np.array([r[0] for r in rows if len(r[0]) == width])
    _, _, v = np.linalg.svd(x - x.mean(0), full_matrices=False)
    return v[:dims]


def _forest(links: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what a block pair's links connect: at most one for each row."""
    rows, cols = np.nonzero(links)
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for a, b in zip(left[rows].tolist(), right[cols].tolist()):
        x, y = root(a), root(b)
        if x != y:
            parent[x] = y
            out.append((a, b))
    return out


def interval_pairs(boxes: pd.DataFrame, epsilon: float) -> list[tuple[int, int]]:
    """Pairs (i <= j) of blocks of one label whose boxes are within epsilon in every direction.

    ``boxes`` is in sequence order with columns block, low and high. The recursion joins two intervals of
    the sequence by halving the longer one and drops a pair of intervals as soon as their boxes are apart.
    """
    low, high, ids = np.stack(boxes["low"].to_numpy()), np.stack(boxes["high"].to_numpy()), boxes["block"].tolist()
    out, todo = [], [(0, len(ids), 0, len(ids))]
    while todo:
        a, b, c, d = todo.pop()
        apart = np.maximum(low[a:b].min(0) - high[c:d].max(0), low[c:d].min(0) - high[a:b].max(0))
        if (apart > epsilon).any():
            continue
        if b - a == 1 and d - c == 1:
            out.append((ids[a], ids[c]))
        elif (a, b) == (c, d):
            m = (a + b) // 2
            todo += [(a, m, a, m), (a, m, m, b), (m, b, m, b)]
        elif b - a >= d - c:
            m = (a + b) // 2
            todo += [(a, m, c, d), (m, b, c, d)]
        else:
            m = (c + d) // 2
            todo += [(a, b, c, m), (a, b, m, d)]
    return out


def block_pairs(boxes: DataFrame, epsilon: float, dims: int, fan: int = FAN, levels: int = LEVELS) -> DataFrame:
    """(label, i, j), i <= j: the blocks of one label whose boxes (label, block, low, high) are within epsilon in every direction.

    Block numbers follow the sequence. The longest intervals of a label, one for 2^(fan * levels) blocks of a partition, are joined by
    :func:`interval_pairs` in one task; below them each level is a join of the pairs with the parts of both intervals.
    """
    ends = lambda f, c: F.array(*[f(F.get(c, F.lit(k))) for k in range(dims)]).alias(c)
    tree = [boxes.select("label", "block", "low", "high")]
    for _ in range(levels):
        tree.append(tree[-1].groupBy("label", F.shiftright("block", fan).alias("block")).agg(ends(F.min, "low"), ends(F.max, "high")))
    kind = dict(boxes.dtypes)["label"]

    def joined(top: pd.DataFrame) -> pd.DataFrame:
        pairs = interval_pairs(top.sort_values("block").reset_index(drop=True), epsilon)
        return pd.DataFrame(pairs, columns=["i", "j"]).assign(label=top["label"].iloc[0])[["label", "i", "j"]]

    pairs = tree[-1].groupBy("label").applyInPandas(joined, f"label {kind}, i long, j long")
    for level in tree[-2::-1]:
        part = lambda k: level.select(F.col("label"), F.shiftright("block", fan).alias(k), *[F.col(c).alias(f"{c}_{k}") for c in ("block", "low", "high")])  # noqa: E731, B023
        both = pairs.join(part("i"), ["label", "i"]).join(part("j"), ["label", "j"]).where("block_i <= block_j")
        for k in range(dims):
            of = lambda c: F.get(c, F.lit(k))  # noqa: E731, B023
            both = both.where((of("low_i") - of("high_j") <= epsilon) & (of("low_j") - of("high_i") <= epsilon))
        pairs = both.select("label", F.col("block_i").alias("i"), F.col("block_j").alias("j"))
    return pairs


def link_vectors(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", block: int = BLOCK, dims: int = DIMENSIONS) -> DataFrame:
    """(id, n_links, component_id, kept) of every row.

    Rows link when their labels are equal and not null and the cosine of their vectors, in double
    precision, is at least the threshold. A vector that is null, empty, zero, or holds a null or
    non-finite component links with nothing; so do vectors of different width. ``n_links`` counts other rows linked
    directly, copies included; ``component_id`` is the smallest id reachable. A row with a null id is returned
    with its links but is nobody's component_id; if all are null so is the result. Repeated rows count
    as other rows.
    """
    spark = vectors.sparkSession
    plain = F.transform(F.col(vector_col).cast(_VECTOR), lambda x: x + F.lit(0.0))  # no negative zero
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), plain.alias("v"), F.col(label_col).alias("label"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    top = F.array_max(F.transform("v", F.abs))
    rows = rows.withColumn("top", F.when(F.col("label").isNotNull() & F.coalesce(fine, F.lit(False)), top))
    # rows are found again by 128 bits of their label and vector
    usable = rows.where(F.col("top") > 0).withColumns({"h": F.xxhash64("label", "v", F.size("v")), "g": F.xxhash64(F.lit(7), F.size("v"), "v", "label")})
    folded = usable.groupBy("label", "v").agg(F.count("*").alias("copies"), F.min("id").alias("low"), F.first("h").alias("h"), F.first("g").alias("g"), F.first("top").alias("top"))
    scaled = F.transform("v", lambda x: x / F.col("top"))  # so that no square overflows or vanishes
    norm = F.sqrt(F.aggregate("s", F.lit(0.0), lambda s, x: s + x * x))
    units = folded.withColumn("s", scaled).withColumn("n", norm).select("label", F.transform("s", lambda x: x / F.col("n")).alias("unit"), "copies", "low", "h", "g")
    distinct = materialise(units.withColumn("node", F.monotonically_increasing_id()), "vectors")
    directions = principal_directions(distinct, dims)
    if directions is None:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"))
    epsilon = math.sqrt(max(0.0, 2 - 2 * threshold)) * (1 + 1e-9) + 1e-9
    width = directions.shape[1]

    @F.pandas_udf("array<double>")
    def project(units: pd.Series) -> pd.Series:
        return pd.Series([directions @ u if len(u) == width else np.full(len(directions), float(len(u)) * 10) for u in units])

    placed = distinct.withColumn("p", project("unit")).withColumn("cells", F.transform("p", lambda x: F.floor(x / epsilon)))
    # the sequence is dealt by range, so equal cells may meet in one task only up to its share of rows; node breaks ties
    parts = max(1, spark.sparkContext.defaultParallelism * 2)
    ordered = placed.repartitionByRange(parts, "label", "cells", "node").sortWithinPartitions("label", "cells", "node")
    schema = f"{ordered.select('label').schema[0].simpleString().replace(':', ' ', 1)}, block long, low array<double>, high array<double>, nodes array<long>, copies array<long>, units array<array<double>>"

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        number, kept = TaskContext.get().partitionId() << 40, None
        for pdf in batches:
            kept = pdf if kept is None else pd.concat([kept, pdf])
            runs = [g for _, g in kept.groupby("label", sort=False)]
            for k, g in enumerate(runs):
                whole = len(g) // block * block if k == len(runs) - 1 else len(g)
                for at in range(0, whole, block):
                    yield made(g.iloc[at : at + block], number)
                    number += 1
            kept = runs[-1].iloc[len(runs[-1]) // block * block :] if runs else None
        if kept is not None and len(kept):
            yield made(kept, number)

    def made(g: pd.DataFrame, number: int) -> pd.DataFrame:
        p = np.stack(g["p"].to_numpy())
        return pd.DataFrame({"label": [g["label"].iloc[0]], "block": [number], "low": [p.min(0)], "high": [p.max(0)], "nodes": [g["node"].to_numpy()], "copies": [g["copies"].to_numpy()], "units": [[np.asarray(u) for u in g["unit"]]]})

    blocks = materialise(ordered.select("label", "p", "node", "copies", "unit").mapInPandas(cut, schema), "blocks")
    pairs = block_pairs(blocks, epsilon, len(directions)).select("i", "j").repartition(4 * parts)
    side = lambda k: blocks.select(F.col("block").alias(k), F.col("nodes").alias(f"nodes_{k}"), F.col("copies").alias(f"copies_{k}"), F.col("units").alias(f"units_{k}"))
    both = pairs.join(side("i"), "i").join(side("j"), "j")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                yield compared(r.i == r.j, r)

    def compared(same: bool, r) -> pd.DataFrame:
        left, right = np.array([np.asarray(u, float) for u in r.units_i], dtype=object), np.array([np.asarray(u, float) for u in r.units_j], dtype=object)
        wide = [len(u) for u in r.units_i], [len(u) for u in r.units_j]
        if len(set(wide[0]) | set(wide[1])) == 1:
            links = np.stack(list(left)).astype(float) @ np.stack(list(right)).astype(float).T >= threshold
        else:
            links = np.array([[len(u) == len(v) and float(np.dot(u, v)) >= threshold for v in r.units_j] for u in r.units_i])
        ni, nj, ci, cj = (np.asarray(x) for x in (r.nodes_i, r.nodes_j, r.copies_i, r.copies_j))
        if same:
            np.fill_diagonal(links, False)
        counts = [(ni, links @ cj)] + ([] if same else [(nj, links.T @ ci)])
        node = np.concatenate([n[c > 0] for n, c in counts])
        n_links = np.concatenate([c[c > 0] for _, c in counts])
        edges = _forest(links, ni, nj)
        return pd.DataFrame({
            "node": np.concatenate([node, np.array([a for a, _ in edges], np.int64)]).astype("int64"),
            "n_links": np.concatenate([n_links, np.zeros(len(edges), np.int64)]).astype("int64"),
            "other": pd.array([None] * len(node) + [b for _, b in edges], dtype="Int64"),
        })

    found = materialise(both.select("i", "j", *(f"{n}_{k}" for k in "ij" for n in ("nodes", "copies", "units"))).mapInPandas(compare, "node long, n_links long, other long"), "links")
    ends = components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b"))).withColumnRenamed("node", "n")
    counts = found.groupBy("node").agg(F.sum("n_links").alias("n_links"))
    known = distinct.select("node", "copies", "low", "h", "g").join(counts, "node", "left").join(ends, F.col("node") == F.col("n"), "left").drop("n")
    known = known.select("h", "g", "low", (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    least = known.groupBy("component").agg(F.min("low").alias("component_id"))
    named = known.join(least, "component").select("h", "g", "n_links", "component_id")
    linked = usable.select("id", "h", "g").join(named, ["h", "g"]).select("id", "n_links", "component_id")
    alone = rows.where("top is null or top <= 0").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.union(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
