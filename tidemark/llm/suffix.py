"""Exact substring deduplication: every byte covered by a string of ``length`` bytes that also starts elsewhere.

1. Every run of successive window starts that share a minimizer (the leftmost of the smallest hashes of the
   32-byte strings in the window) is filed under that minimizer's hash. Equal windows have equal minimizers at
   equal offsets, so all starts of a repeated string meet under one hash; most hashes occur once and end there.
2. Runs of equal content are counted: where there are two, every window of them is repeated.
3. The other runs under a shared hash, one for each different content, are dealt to shards by that hash. Spark sorts a
   shard's rows on disk by hash and it is worked through in blocks of bounded size, so it may exceed memory. The suffixes of a
   block are sorted by induction with their common prefixes (:mod:`tidemark.llm.induced`); those that share ``length`` bytes with
   a neighbour are repeated. Under a hash with very many different contents the starts are cut into stretches of ``STRETCH`` at fixed
   distances from the minimizer, which are dealt out by the bytes that all windows of a stretch hold. Equal stretches are repeated as a
   whole; only where different ones hold the same bytes, the windows themselves, of one of each, are dealt out and counted.
4. The covered bytes are cut from each text.

Spans are judged on the input; no string reaches over the end of a document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise
from .induced import repeated_starts

LENGTH, GRAM = 200, 32
#: Bytes of a shard's text to a block; different contents under one hash up to which they stay in one shard.
BLOCK_BYTES, CROWD = 4 << 20, 2048
#: Successive window starts under a crowded hash that are compared as one first.
STRETCH = 16
_P = np.uint64(0x9E3779B97F4A7C15)
#: Window starts that one pass over a long text handles; positions in it take the low 20 bits of a key.
_PIECE = (1 << 20) - 4096


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the 32 bytes from each place, by doubling."""
    h, power, size = data.astype(np.uint64) + np.uint64(1), _P, 1
    while size < GRAM:
        h = h[:-size] * power + h[size:]
        with np.errstate(over="ignore"):
            power = power * power
        size *= 2
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def runs(text: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimizer hash, first start, number of starts) of the runs of window starts of a text."""
    out = []
    data, span = np.frombuffer(text, np.uint8), length - GRAM + 1
    for at in range(0, max(len(data) - length + 1, 0), _PIECE):
        h = gram_hashes(data[at : at + _PIECE + length - 1])
        key = (h & ~np.uint64((1 << 20) - 1)) | np.arange(len(h), dtype=np.uint64)
        low, size = key, 1
        while 2 * size <= span:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        low = np.minimum(low[: len(h) - span + 1], low[span - size : len(h) - size + 1])
        place = (low & np.uint64((1 << 20) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        out.append((h[place[first]], at + first, np.diff(np.append(first, len(place)))))
    if not out:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out))


def _run_batches(length: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, keys, texts = (batch.column(c) for c in ("doc", "key", "text"))
            for at in range(0, len(docs), 128):
                part = texts.slice(at, 128).to_pylist()
                found = [runs(t, length) for t in part]
                content = [xxhash.xxh3_64_intdigest(t[a : a + n + length - 1]) for t, (_, s, ns) in zip(part, found) for a, n in zip(s.tolist(), ns.tolist())]
                which = pa.array(np.repeat(np.arange(len(part)), [len(f[0]) for f in found]))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([f[0] for f in found]).view(np.int64)), docs.slice(at, 128).take(which), keys.slice(at, 128).take(which),
                    pa.array(np.concatenate([f[1] for f in found])), pa.array(np.concatenate([f[2] for f in found]).astype(np.int32)),
                    pa.array(np.array(content, np.uint64).view(np.int64)),
                ], ["anchor", "doc", "key", "start", "n", "content"])

    return find


_MARK = "doc long, key long, start long, n long"


def _marks(rows: list[tuple], *more: pa.DataType) -> pa.RecordBatch:
    kinds = [pa.int64()] * 4 + list(more)
    columns = list(zip(*rows)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc", "key", "start", "n", "bytes"][: len(kinds)])


def _sorted_shard(length: int):
    def worked(block: list[tuple]) -> pa.RecordBatch:
        text = np.frombuffer(b"".join(b[4] for b in block), np.uint8)
        sizes = np.array([len(b[4]) for b in block])
        begin = np.cumsum(sizes) - sizes
        counts = sizes - length + 1
        starts = np.concatenate([b + np.arange(c) for b, c in zip(begin, counts)])
        hits = np.sort(repeated_starts(text, starts, length))
        owner = np.searchsorted(begin, hits, side="right") - 1
        cut = np.flatnonzero(np.concatenate([[True], (np.diff(hits) != 1) | (np.diff(owner) != 0)])) if len(hits) else np.empty(0, np.int64)
        rows = []
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(hits)]):
            _, doc, key, start, _ = block[owner[a]]
            rows.append((doc, key, start + int(hits[a] - begin[owner[a]]), b - a))
        return _marks(rows)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size, last = [], 0, None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "doc", "key", "start", "bytes"))):
                if row[0] != last and size >= BLOCK_BYTES:
                    yield worked(block)
                    block, size = [], 0
                last = row[0]
                block.append(row)
                size += len(row[4])
        if block:
            yield worked(block)

    return work


def stretches(body: bytes, anchor: int, length: int = LENGTH) -> Iterator[tuple[bytes, int, int]]:
    """(bytes that all windows of the stretch hold, first start, number of starts) of a run's bytes.

    Stretches are cut at multiples of ``STRETCH`` before the minimizer, so equal windows lie in stretches that hold the same bytes.
    """
    n = len(body) - length + 1
    place = n - 1 + int(np.flatnonzero(gram_hashes(np.frombuffer(body, np.uint8)[n - 1 : length]).view(np.int64) == anchor)[0])
    for k in range((place - n + 1) // STRETCH, place // STRETCH + 1):
        first, last = max(place - STRETCH * (k + 1) + 1, 0), min(place - STRETCH * k, n - 1)
        at = place - STRETCH * k
        yield body[at : at - STRETCH + 1 + length], first, last - first + 1


def _stretch_batches(length: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for anchor, doc, key, start, body in zip(*(batch.column(c).to_pylist() for c in ("anchor", "doc", "key", "start", "bytes"))):
                out += [(hashlib.blake2b(core, digest_size=16).digest(), doc, key, start + at, body[at : at + n + length - 1]) for core, at, n in stretches(body, anchor, length)]
            columns = list(zip(*out)) or [()] * 5
            kinds = [pa.binary(), *[pa.int64()] * 3, pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["core", "doc", "key", "start", "bytes"])

    return cut


def _met_stretches(length: int):
    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of stretches sorted by core and bytes: those that equal another, without bytes; and one of each that has its core in common with different ones, with them."""
        held, twice, alone = None, False, None  # the last row, whether it equals the one before; the first row of a core so far without a different one
        for batch in batches:
            out = []
            for row in zip(*(batch.column(c).to_pylist() for c in ("core", "doc", "key", "start", "bytes"))):
                same = held is not None and row[0] == held[0] and row[4] == held[4]
                if held is not None and (twice or same):
                    out.append((*held[1:4], len(held[4]) - length + 1, None))
                if held is None or row[0] != held[0]:
                    alone = row
                elif not same:
                    out += [(*r[1:4], len(r[4]) - length + 1, r[4]) for r in (alone, row) if r is not None]
                    alone = None
                held, twice = row, same
            yield _marks(out, pa.binary())
        if held is not None and twice:
            yield _marks([(*held[1:4], len(held[4]) - length + 1, None)], pa.binary())

    return met


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted windows, those that equal the one before or behind."""
    held, held_twice = None, False  # the last row so far
    for batch in batches:
        rows = list(zip(*(batch.column(c).to_pylist() for c in ("window", "doc", "key", "start"))))
        out = []
        for row in rows:
            same = held is not None and row[0] == held[0]
            if held is not None and (held_twice or same):
                out.append((*held[1:], 1))
            held, held_twice = row, same
        yield _marks(out)
    if held is not None and held_twice:
        yield _marks([(*held[1:], 1)])


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD, with_text: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) of every row.

    Null and empty texts have 0 bytes and keep the digest of nothing. Rows that repeat a text of at least
    ``length`` bytes lose it all, each of them, whatever their ids (null ids too). An empty table gives no row.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), text.alias("text")).withColumn("key", F.xxhash64("text"))
    long_rows = rows.where(F.length("text") >= length)
    runs_of = long_rows.mapInArrow(_run_batches(length), "anchor long, doc long, key long, start long, n int, content long")
    # most minimizers occur once: their runs are found again rather than kept, and leave before anything else is grouped
    often = materialise(runs_of.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1").select("anchor"), "often")  # written, so that Spark can split the join at a hot one
    found = materialise(runs_of.join(often, "anchor", "left_semi"), "runs")
    discard(often)
    contents = found.groupBy("anchor", "content").agg(F.count("*").alias("c"), F.min(F.struct("doc", "key", "start", "n")).alias("one"))
    contents = materialise(contents.withColumn("c", F.col("c").cast("int")), "contents")
    crowds = contents.groupBy("anchor").agg(F.count("*").alias("d")).where("d > 1")
    same = contents.where("c > 1").select("anchor", "content")
    whole = found.join(same, ["anchor", "content"]).select("doc", "key", "start", F.col("n").cast("long").alias("n"))
    mixed = contents.join(crowds, "anchor").select("anchor", "d", "one.*")
    wanted = mixed.groupBy("doc", "key").agg(F.collect_list(F.struct("anchor", "d", "start", "n")).alias("runs"))  # at most the text's own length

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, key, body, want in zip(*(batch.column(c).to_pylist() for c in ("doc", "key", "text", "runs"))):
                yield pa.RecordBatch.from_arrays([
                    pa.array([r["anchor"] for r in want], pa.int64()), pa.array([r["d"] for r in want], pa.int64()), pa.array([doc] * len(want), pa.int64()), pa.array([key] * len(want), pa.int64()),
                    pa.array([r["start"] for r in want], pa.int64()), pa.array([body[r["start"] : r["start"] + r["n"] + length - 1] for r in want], pa.binary()),
                ], ["anchor", "d", "doc", "key", "start", "bytes"])

    joined = long_rows.join(wanted, long_rows["doc"].eqNullSafe(wanted["doc"]) & (long_rows["key"] == wanted["key"])).select(long_rows["doc"], long_rows["key"], "text", "runs")
    pieces = materialise(joined.mapInArrow(cut, "anchor long, d long, doc long, key long, start long, bytes binary"), "pieces")
    few = pieces.where(F.col("d") <= crowd).repartition("anchor").sortWithinPartitions("anchor").select("anchor", "doc", "key", "start", "bytes")
    sorted_marks = few.mapInArrow(_sorted_shard(length), _MARK)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, key, start, body in zip(*(batch.column(c).to_pylist() for c in ("doc", "key", "start", "bytes"))):
                digests = [hashlib.blake2b(body[i : i + length], digest_size=16).digest() for i in range(len(body) - length + 1)]
                n = len(digests)
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array([doc] * n, pa.int64()), pa.array([key] * n, pa.int64()), pa.array(range(start, start + n), pa.int64())], ["window", "doc", "key", "start"])

    cores = pieces.where(F.col("d") > crowd).mapInArrow(_stretch_batches(length), "core binary, doc long, key long, start long, bytes binary")
    met = materialise(cores.repartitionByRange("core").sortWithinPartitions("core", "bytes").mapInArrow(_met_stretches(length), _MARK + ", bytes binary"), "stretches")
    # equal windows are neighbours in one range of the sorted windows, however many share a hash
    dealt = met.where("bytes is not null").select("doc", "key", "start", "bytes").mapInArrow(windows, "window binary, doc long, key long, start long")
    crowd_marks = met.where("bytes is null").select("doc", "key", "start", "n").union(dealt.repartitionByRange("window").sortWithinPartitions("window").mapInArrow(_neighbours, _MARK))
    marks = whole.union(sorted_marks).union(crowd_marks)
    spans = marks.groupBy("doc", "key").agg(F.array_sort(F.collect_set(F.struct("start", "n"))).alias("spans")).select(F.col("doc").alias("d"), F.col("key").alias("k"), "spans")
    schema = "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, body, spans in zip(*(batch.column(c).to_pylist() for c in ("doc", "text", "spans"))):
                merged: list[list[int]] = []
                for s in spans or ():
                    a, b = s["start"], s["start"] + s["n"] + length - 1
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                rest, at = [], 0
                for a, b in merged:
                    rest.append(body[at:a])
                    at = b
                rest = b"".join([*rest, body[at:]])
                out.append((doc, len(body), len(body) - len(rest), len(merged), hashlib.sha256(rest).hexdigest()) + ((rest,) if with_text else ()))
            columns = list(zip(*out)) or [()] * (5 + with_text)
            kinds = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * with_text
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + with_text])

    all_rows = rows.join(spans, rows["doc"].eqNullSafe(spans["d"]) & (rows["key"] == spans["k"]), "left").select("doc", "text", "spans")
    return all_rows.mapInArrow(kept, schema).withColumnRenamed("doc", id_col)
