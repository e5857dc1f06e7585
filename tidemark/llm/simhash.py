"""SimHash near-duplicates: pigeonhole blocks over fingerprints, then Hamming distance.

A fingerprint of 64 bits is cut into ``blocks`` blocks. Two fingerprints that differ in at most
``max_bits`` bits leave at least ``blocks - max_bits`` blocks untouched, so they meet in a join on
some choice of that many blocks; the join's pairs are then verified by ``bit_count(a ^ b)``.

Equal texts and equal fingerprints are folded into one representative before any join, so a group
of copies costs one row however large it is. A key that many *different* fingerprints share does
not make all pairs: see :func:`near_fingerprints` and :func:`near_texts`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, discard, emptied, materialise
from .substring import _mixed, word_hashes

SEED = 42
#: Members of a bucket up to which its pairs are made directly.
BUCKET = 64
#: The same where links are verified by texts: beyond it, members of a bucket are compared with one of them first.
PIVOT = 16
#: Shingles that the order of prefixes puts last, at most (their number does not depend on the corpus).
FREQUENT = 1 << 17
#: Members of a prefix's bucket beyond which pairs are made once, with all that they share, and not by each shingle.
CROWDED = 32


def shingle_hashes(text: bytes | None, size: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``size`` words of a text whose A-Z are lowered; repeats stay.

    Words are separated by space and tab to carriage return. Fewer words than ``size``: one hash of
    all words. No word (or null): no hash.
    """
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) < size:
        return np.array([digest(joined, SEED)], np.uint64)
    starts = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1, out=starts[1:])
    starts = starts.tolist()
    return np.fromiter((digest(joined[a : b - 1], SEED) for a, b in zip(starts, starts[size:])), np.uint64, len(words) - size + 1)


def majority(hashes: np.ndarray) -> int:
    """The signed 64-bit integer whose bits are those set in over half of the hashes; none: zero."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):  # bounded memory for very long texts
        part = np.ascontiguousarray(hashes[at : at + (1 << 15)]).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprint(text: Column, size: int) -> Column:
    """SimHash of a whole text as a signed long."""

    @F.pandas_udf(T.LongType())
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([majority(shingle_hashes(x, size)) for x in texts], dtype="int64")

    return of(text.cast("binary"))


def _cuts(blocks: int) -> list[tuple[int, int]]:
    """(shift, width) of each block of the 64 bits."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def block_keys(bits: Column, blocks: int, agree: int) -> Column:
    """Array of (which blocks, their bits): one for every choice of ``agree`` of the blocks."""
    keys = []
    for which, chosen in enumerate(combinations(_cuts(blocks), agree)):
        mask = sum(((1 << width) - 1) << shift for shift, width in chosen)
        mask -= (1 << 64) if mask >= 1 << 63 else 0
        keys.append(F.struct(F.lit(which).alias("which"), bits.bitwiseAND(F.lit(mask)).alias("part")))
    return F.array(*keys)


def near_fingerprints(prints: DataFrame, max_bits: int = 2, blocks: int = 4) -> DataFrame:
    """Links (a, b) that join every two distinct fingerprints within ``max_bits`` bits.

    ``prints`` has one column ``bits`` of distinct longs. Buckets of up to ``BUCKET`` members make
    their pairs. In larger ones two fingerprints within two bits have a common neighbour at one
    bit or less, and all fingerprints around such a neighbour are within two bits of each other: each
    member names its neighbours and is linked to the smallest member that names the same one, so the
    rows stay proportional to the members. Pairs implied by such a star are not listed.
    """
    if max_bits != 2:
        raise ValueError("the stars around common neighbours hold for two bits; beyond that use near_texts")
    agree = blocks - max_bits
    keyed = prints.select("bits", F.explode(block_keys(F.col("bits"), blocks, agree)).alias("key")).select("bits", "key.*")
    sizes = keyed.groupBy("which", "part").agg(F.count("*").alias("n")).where("n > 1")
    keyed = materialise(keyed.join(sizes, ["which", "part"]), "blocks")
    few = keyed.where(F.col("n") <= BUCKET)
    pairs = (
        few.alias("x").join(few.alias("y"), ["which", "part"]).where("x.bits < y.bits")
        .where(F.bit_count(F.col("x.bits").bitwiseXOR(F.col("y.bits"))) <= max_bits)
        .select(F.col("x.bits").alias("a"), F.col("y.bits").alias("b"))
    )
    masks = [0, *((1 << i) - ((1 << 64) if i == 63 else 0) for i in range(64))]
    many = keyed.where(F.col("n") > BUCKET).select("bits").distinct()
    around = many.select("bits", F.explode(F.array(*[F.col("bits").bitwiseXOR(F.lit(m)) for m in masks])).alias("around"))
    lowest = around.groupBy("around").agg(F.min("bits").alias("low"), F.count("*").alias("n")).where("n > 1")
    stars = (
        around.join(lowest.drop("n"), "around").where("bits <> low")
        .where(F.bit_count(F.col("bits").bitwiseXOR(F.col("low"))) <= max_bits)
        .select(F.col("low").alias("a"), F.col("bits").alias("b"))
    )
    return pairs.union(stars).distinct()


def fingerprint_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, max_bits: int = 2) -> DataFrame:
    """(id, fingerprint as 16 hex digits, component_id) of every row; see the module's text.

    Null and empty texts have fingerprint zero and are linked like any other. ``component_id`` is
    the smallest id reachable (null ids are ignored for it, but their rows are returned). Repeated
    rows are returned as often as they come. An empty table gives an empty result. Columns other
    than the two named are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), fingerprint(F.col(text_col), size).alias("bits"))
    rows = materialise(rows, "prints")
    prints = rows.groupBy("bits").agg(F.min("id").alias("low"))
    links = near_fingerprints(prints.select("bits"), max_bits)
    ends = components(links)
    own = prints.join(ends.withColumnRenamed("node", "bits"), "bits", "left").select("bits", "low", F.coalesce("component", "bits").alias("component"))
    least = own.groupBy("component").agg(F.min("low").alias("component_id"))
    named = own.join(least, "component").select("bits", "component_id")
    return rows.join(named, "bits").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


#: Texts whose shingles a task holds at a time.
TEXTS = 512


def _some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch.column("id")), TEXTS):
            yield batch.slice(at, TEXTS)


def text_shingles(text: bytes | None, size: int) -> np.ndarray:
    """64-bit hashes of the same runs of words as :func:`shingle_hashes` has, by numpy; for sets that no contract fixes."""
    words = word_hashes(text)
    n = max(len(words) - size + 1, min(len(words), 1))
    out = np.zeros(n, np.uint64)
    for j in range(min(size, len(words))):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[j : j + n]
    return _mixed(out)


def _shingle_sets(texts: DataFrame, size: int) -> DataFrame:
    """(id, hashes): the different shingles of each text (id, text), ascending as unsigned numbers."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _some(batches):
            found = [np.unique(text_shingles(x, size)).view(np.int64) for x in batch.column("text").to_pylist()]
            runs = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
            hashes = pa.ListArray.from_arrays(runs, pa.array(np.concatenate(found) if found else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), hashes], ["id", "hashes"])

    return texts.select("id", F.col("text").cast("binary").alias("text")).mapInArrow(emptied(sets), "id long, hashes array<bigint>")


@F.pandas_udf(T.StructType([T.StructField("bits", T.LongType()), T.StructField("n", T.IntegerType())]))
def _print_and_size(texts: pd.Series, sizes: pd.Series) -> pd.DataFrame:
    rows = []
    for x, n in zip(texts, sizes):
        h = text_shingles(x, int(n))
        rows.append((majority(h), len(np.unique(h))))
    return pd.DataFrame(rows, columns=["bits", "n"])


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    left = sets.select(F.col("id").alias("a"), F.col("hashes").alias("ha"))
    right = sets.select(F.col("id").alias("b"), F.col("hashes").alias("hb"))
    both = F.size(F.array_intersect("ha", "hb"))
    return (
        pairs.join(left, "a").join(right, "b")
        .where(both >= similarity * (F.size("ha") + F.size("hb") - both)).select("a", "b")
    )


def _frequent(texts: DataFrame, size: int, similarity: float) -> pa.Table:
    """(shingle, n) of up to ``FREQUENT`` shingles that most texts share.

    Shingles whose hash is as low as those at which a prefix ends are counted exactly, for these make the buckets; of the
    others tasks report what occurs three times within some thousand texts. Any choice gives the same links; this one keeps buckets small.
    """
    low = np.uint64(min(int((1.05 - similarity) * 2**64), 2**64 - 1))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch.column("text")), 4 * TEXTS):
                sets = [np.unique(text_shingles(x, size)) for x in batch.column("text").slice(at, 4 * TEXTS).to_pylist()]
                h, n = np.unique(np.concatenate(sets), return_counts=True)
                told = (n > 2) | (h < low)
                yield pa.RecordBatch.from_arrays([pa.array(h[told].view(np.int64)), pa.array(n[told])], ["shingle", "n"])

    counted = texts.select(F.col("text").cast("binary").alias("text")).mapInArrow(emptied(count), "shingle long, n long")
    counted = materialise(counted.groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") > PIVOT), "frequent")
    # the levels (at most a few hundred) show down to which count they are few enough; no task sends more than these
    level = F.floor(8 * F.log2("n"))
    least, held = None, 0
    for r in counted.groupBy(level.alias("level")).agg(F.count("*").alias("held")).orderBy(F.desc("level")).collect():
        held += r["held"]
        if held > FREQUENT:
            break
        least = r["level"]
    top = counted.where(F.lit(False) if least is None else level >= least).toArrow()
    discard(counted)
    return top


def prefix(hashes: np.ndarray, ranks: np.ndarray, frequent: np.ndarray, similarity: float) -> np.ndarray:
    """The first of a set's ascending hashes, those in ``frequent`` (ascending) last and by rank: similar sets share one of them."""
    least = int(np.ceil(similarity * len(hashes) - 1e-9))
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
        hashes = hashes[np.argsort(np.where(frequent[at] == hashes, ranks[at], 0), kind="stable")]
    return hashes[: len(hashes) - least + 1]


def _across(rows: DataFrame, texts: DataFrame, own: DataFrame, size: int, similarity: float) -> DataFrame:
    """Candidates (a, b) of different components of ``own`` (node, component): every pair that is similar enough is among them.

    Two sets of Jaccard similarity s share more than they lose, so in any common order of shingles the first
    n - ceil(s n) + 1 of each have one in common (prefix filter). Rare shingles come first. A pair must also share
    so many of these that its similarity can be reached. Pairs within the largest component of a bucket are not made. In a bucket
    of more than ``CROWDED`` members a pair is made once, by the first such shingle that it shares, and only if it shares enough.
    """
    ranked = _frequent(texts, size, similarity)
    keys, shared_by = ranked.column("shingle").to_numpy().view(np.uint64), ranked.column("n").to_numpy()
    ranks = np.empty(len(keys), np.int64)
    ranks[np.lexsort((keys, shared_by))] = np.arange(1, len(keys) + 1)
    order = np.argsort(keys)
    box = texts.sparkSession.sparkContext.broadcast((keys[order], ranks[order]))  # at most 2 MB

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, ranks = box.value
        for batch in _some(batches):
            sets = [np.unique(text_shingles(x, size)) for x in batch.column("text").to_pylist()]
            heads = [prefix(h, ranks, frequent, similarity).view(np.int64) for h in sets]
            runs = pa.array(np.cumsum([0, *map(len, heads)]), pa.int32())
            keys = pa.ListArray.from_arrays(runs, pa.array(np.concatenate(heads) if heads else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([len(h) for h in sets], pa.int64()), keys], ["id", "n", "keys"])

    # prefixes are cut where the texts are read, so no text moves
    cuts = texts.select("id", F.col("text").cast("binary").alias("text")).mapInArrow(emptied(cut), "id long, n long, keys array<long>")
    cuts = cuts.join(rows.select("id").distinct(), "id", "left_semi").join(own.withColumnRenamed("node", "id"), "id", "left")
    cuts = materialise(cuts.select("id", "n", F.coalesce("component", "id").alias("own"), "keys"), "heads")
    keyed = cuts.select("id", "n", "own", F.explode("keys").alias("key")).repartition("key")
    parts = keyed.groupBy("key", "own").agg(F.count("*").alias("members"))
    mixed = parts.groupBy("key").agg(F.count("*").alias("parts"), F.max_by("own", F.struct("members", "own")).alias("top"), F.sum("members").alias("members")).where("parts > 1").drop("parts")
    placed = materialise(keyed.join(mixed, "key"), "prefixes")
    rest = lambda n: F.ceil(similarity * n - 1e-9) - 1
    least, beyond = similarity / (1 + similarity), rest(F.greatest("x.n", "y.n"))
    ends = F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")

    def meeting(members: DataFrame) -> DataFrame:
        x, y = members.where("own <> top").alias("x"), members.alias("y")
        meet = x.join(y, "key").where("x.own <> y.own and (y.own = y.top or x.id < y.id)")
        return meet.where(F.least("x.n", "y.n") >= similarity * F.greatest("x.n", "y.n"))

    shared = meeting(placed.where(F.col("members") <= CROWDED)).select(*ends, (F.col("x.n") + F.col("y.n")).alias("both"), beyond.alias("beyond"))
    shared = shared.groupBy("a", "b").agg(F.count("*").alias("common"), F.min("both").alias("both"), F.max("beyond").alias("beyond"))
    shared = shared.where(F.col("common") + F.col("beyond") >= least * F.col("both") - 1e-6).select("a", "b")
    # pairs with a crowded shingle in common are made by the first of these, and only where the whole prefixes share enough
    many = placed.where(F.col("members") > CROWDED)
    heads = many.groupBy("id").agg(F.collect_set("key").alias("crowded")).join(cuts.select("id", "keys"), "id")
    common = F.size(F.array_intersect("x.keys", "y.keys"))
    crowds = meeting(many.join(heads, "id")).where(F.array_min(F.array_intersect("x.crowded", "y.crowded")) == F.col("key"))
    crowds = crowds.where(common + beyond >= least * (F.col("x.n") + F.col("y.n")) - 1e-6).select(*ends)
    out = materialise(shared.union(crowds).distinct(), "across")
    discard(placed, cuts)
    return out


def near_texts(prints: DataFrame, texts: DataFrame, size: int = 5, similarity: float = 0.8, max_bits: int = 12, blocks: int = 8, agree: int = 3) -> DataFrame:
    """Links (a, b) between different texts whose sets of ``size``-word shingles are similar.

    ``prints`` (id: long, bits, n) has the fingerprint and the number of different shingles of each distinct text, ``texts``
    (id, text) the texts, of which only those of candidates are moved. Candidates agree in ``agree`` of
    ``blocks`` fingerprint blocks (certain up to ``blocks - agree`` differing bits, likely beyond; 24 bits agree, so chance
    brings few together), differ in at most ``max_bits`` bits, and are then verified by the exact Jaccard similarity of their
    shingle sets.

    In a bucket with more than ``PIVOT`` members each member is compared with one of them only, the pivot, so a tight
    group makes no pairs within itself.

    Pairs that this leaves are found by an exact join on rare shingles between the components so far (:func:`_across`),
    so the components of all links are those of all pairs that are similar enough.
    """

    def sets_of(pairs: DataFrame) -> DataFrame:
        ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        return _shingle_sets(texts.join(ids, "id", "left_semi"), size)

    rows = prints.where("n > 0")
    keyed = rows.select("id", "bits", F.explode(block_keys(F.col("bits"), blocks, agree)).alias("key")).select("id", "bits", F.xxhash64("key.which", "key.part").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("id", "bits")).alias("pivot")).where("n > 1")
    keyed = materialise(keyed.join(sizes, "key"), "blocks")
    near = lambda a, b: F.bit_count(a.bitwiseXOR(b)) <= max_bits
    few = keyed.where(F.col("n") <= PIVOT).select("id", "bits", "key")
    many = keyed.where(F.col("n") > PIVOT)
    direct = few.alias("x").join(few.alias("y"), "key").where("x.id < y.id").where(near(F.col("x.bits"), F.col("y.bits"))).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    star = many.where("id <> pivot.id").where(near(F.col("bits"), F.col("pivot.bits"))).select(F.col("pivot.id").alias("a"), F.col("id").alias("b"))
    pairs = materialise(direct.union(star).distinct(), "pairs")
    sets = materialise(sets_of(pairs), "sets")
    links = materialise(_verified(pairs, sets, similarity), "links")
    discard(sets)
    ends = components(links)
    discard(keyed, pairs)
    more = _across(rows, texts, ends, size, similarity)
    if not more.take(1):
        return links
    sets = materialise(sets_of(more), "sets")
    links = materialise(links.union(_verified(more, sets, similarity)), "links")
    discard(sets, more)
    return links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: float = 0.8, **how) -> DataFrame:
    """(id, component_id): groups of texts that are equal or near each other; component_id = smallest id.

    Null and empty texts are groups of their own (each id alone). Rows with a null id are left out. Different texts
    under one id belong together.
    """
    full = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where(F.col("id").isNotNull())
    digest = F.when(F.length(F.trim("text")) > 0, F.sha2(F.col("text").cast("binary"), 256))
    digest = F.coalesce(digest, F.concat(F.lit("alone "), F.col("id").cast("string")))
    seen = full.select("id", digest.alias("digest"), _print_and_size(F.col("text").cast("binary"), F.lit(size)).alias("p"))
    seen = materialise(seen.select("id", "digest", "p.bits", "p.n"), "prints")
    same = materialise(seen.groupBy("digest").agg(F.min("id").alias("low"), F.min("bits").alias("bits"), F.min("n").alias("n")), "same")
    firsts = same.select(F.col("low").alias("id"), "bits", "n")
    ends = components(near_texts(firsts, full, size, similarity, **how))
    named = same.join(ends.withColumnRenamed("node", "low"), "low", "left").select("digest", F.coalesce("component", "low").alias("component_id"))
    return seen.select("id", "digest").join(named, "digest").select(F.col("id").alias(id_col), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` with one document of each group of near duplicates: the one of smallest id.

    Repeated rows of the kept id are kept once. Rows with a null id are in no group and stay.
    """
    stay = near_duplicates(docs, id_col, text_col, **how).where(F.col(id_col) == F.col("component_id")).select(id_col).distinct()
    named = docs.where(F.col(id_col).isNotNull()).join(stay, id_col, "left_semi").dropDuplicates([id_col])
    return named.unionByName(docs.where(F.col(id_col).isNull()))
