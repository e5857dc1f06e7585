"""Token-id files: one concatenated id array per file, document boundaries in Elias-Fano form.

File layout, all little-endian: ids (2 or 4 bytes each) | low bits | high bits | block ranks |
document ids (8 bytes each) | footer (JSON) | length of the footer (4 bytes) | magic. The n + 1 boundaries of n
documents take 2 + log2(ids / documents) bits each, and a rank for every 512 high bits lets
``select`` find any boundary without a table of 64-bit offsets.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, scratch
from .files import new_file, random_file
from .units import LibraryMemo

MAGIC, BLOCK = b"EFTOK1\n\0", 512
#: Bytes of text to a file, about; a longer document has a file to itself.
FILE_BYTES = 32 << 20


class EliasFano:
    """A non-decreasing sequence of integers from 0, in near-minimal space."""

    def __init__(self, n: int, low_width: int, low: np.ndarray, high: np.ndarray, ranks: np.ndarray):
        self.n, self.low_width, self.low, self.high, self.ranks = n, low_width, low, high, ranks

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        width = max(0, (top // max(n, 1)).bit_length() - 1)
        if width:
            bits = (values[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
            low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        else:
            low = np.empty(0, np.uint8)
        size = -(-(n + (top >> width) + 1) // BLOCK) * BLOCK
        marks = np.zeros(size, np.uint8)
        marks[(values >> np.uint64(width)).astype(np.int64) + np.arange(n)] = 1
        ranks = np.zeros(size // BLOCK + 1, np.uint32)
        np.cumsum(marks.reshape(-1, BLOCK).sum(axis=1), out=ranks[1:])
        return cls(n, width, low, np.packbits(marks, bitorder="little"), ranks)

    def select(self, at) -> np.ndarray:
        """The values at these indexes."""
        at = np.asarray(at, np.int64)
        out = np.empty(len(at), np.int64)
        for k in range(0, len(at), 4096):
            part = at[k : k + 4096]
            block = np.searchsorted(self.ranks, part, side="right") - 1
            rows = np.unpackbits(self.high.reshape(-1, BLOCK // 8)[block], axis=1, bitorder="little")
            inside = part - self.ranks[block]
            position = (np.cumsum(rows, axis=1, dtype=np.int64) == (inside + 1)[:, None]).argmax(axis=1) + block * BLOCK
            value = (position - part) << self.low_width
            if self.low_width:
                bit = part[:, None] * self.low_width + np.arange(self.low_width)
                value += (((self.low[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1).astype(np.int64) << np.arange(self.low_width)).sum(axis=1)
            out[k : k + 4096] = value
        return out

    def parts(self) -> list[bytes]:
        return [self.low.tobytes(), self.high.tobytes(), self.ranks.astype("<u4").tobytes()]

    @property
    def bits(self) -> int:
        return 8 * sum(map(len, self.parts()))


class TokenFileWriter:
    """Streams documents' ids to one file; holds 16 bytes a document in memory, never the ids."""

    def __init__(self, path: str, width: int):
        self.path, self.kind, self.out = path, f"<u{width}", new_file(path)
        self.width, self.doc_ids, self.lengths = width, [], []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.out.write(ids.astype(self.kind).tobytes())
        self.doc_ids.append(doc_id)
        self.lengths.append(len(ids))

    def close(self) -> int:
        """Returns the number of ids."""
        ends = np.concatenate([[0], np.cumsum(np.array(self.lengths, np.int64))])
        boundaries = EliasFano.of(ends)
        nulls = sum(x is None for x in self.doc_ids)  # they sort first
        parts = [*boundaries.parts(), np.array(self.doc_ids[nulls:], "<i8").tobytes()]
        footer = json.dumps({"width": self.width, "ids": int(ends[-1]), "documents": len(self.lengths), "nulls": nulls, "low_width": boundaries.low_width, "parts": list(map(len, parts))}).encode()
        for part in (*parts, footer, struct.pack("<I", len(footer)), MAGIC):
            self.out.write(part)
        self.out.close()
        return int(ends[-1])


class TokenFile:
    """Random access to a file: ``ids(k)`` and ``offsets(k)`` by select, ``doc_ids`` in file order."""

    def __init__(self, path: str):
        self.file = random_file(path)
        size = self.file.size()
        length, magic = struct.unpack("<I8s", self.file.read_at(12, size - 12))
        if magic != MAGIC:
            raise ValueError(f"{path} is not a token file")
        meta = json.loads(self.file.read_at(length, size - 12 - length))
        at, parts = meta["ids"] * meta["width"], []
        for n in meta["parts"]:
            parts.append(self.file.read_at(n, at))
            at += n
        self.kind, self.n_ids, self.n = f"<u{meta['width']}", meta["ids"], meta["documents"]
        low, high, ranks = np.frombuffer(parts[0], np.uint8), np.frombuffer(parts[1], np.uint8), np.frombuffer(parts[2], "<u4")
        self.boundaries = EliasFano(self.n + 1, meta["low_width"], low, high, ranks)
        self.doc_ids = [None] * meta["nulls"] + np.frombuffer(parts[3], "<i8").tolist()

    def offsets(self, k) -> np.ndarray:
        return self.boundaries.select(k)

    def between(self, start: int, end: int) -> np.ndarray:
        width = int(self.kind[2:])
        return np.frombuffer(self.file.read_at((end - start) * width, start * width), self.kind)

    def ids(self, k: int) -> np.ndarray:
        return self.between(*self.offsets([k, k + 1]).tolist())


def write_token_files(docs: DataFrame, path: str, folder: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Encode whole texts, in ascending order of id, into files under ``folder``; returns their manifest.

    Manifest: (path, first_id, documents, n_ids, order, start), ``start`` counting the ids of all files before.
    Null texts are empty (only the end id is written); rows with a null id come first. Files are named anew by
    every attempt of a task, and only those of attempts that succeeded are in the manifest.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    spark = docs.sparkSession
    total = rows.agg(F.sum(F.octet_length("text")).cast("long")).first()[0] or 0
    files = max(-(-total // file_bytes), spark.sparkContext.defaultParallelism)
    width = 2 if LibraryMemo.of(path).tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
    rows = rows.repartitionByRange(files, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    schema = "path string, first_id long, documents long, n_ids long, part int"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        memo, out, end = LibraryMemo.of(path), None, np.array([end_id], "<u4").tobytes()
        part = TaskContext.get().partitionId()
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for at in range(0, len(ids), 512):
                for doc_id, x in zip(ids[at : at + 512], memo.ids(batch.column("text").slice(at, 512).to_pylist())):
                    if out is None:
                        first, out = doc_id, TokenFileWriter(f"{folder}/part-{part:05d}-{uuid.uuid4().hex}.eftok", width)
                    out.add(doc_id, np.frombuffer(x + end, "<u4"))
        if out is not None:
            n_ids = out.close()
            yield pa.RecordBatch.from_pydict({"path": [out.path], "first_id": pa.array([first], pa.int64()), "documents": [len(out.lengths)], "n_ids": [n_ids], "part": pa.array([part], pa.int32())})

    manifest = materialise(rows.mapInArrow(write, schema), "manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file, not for each document
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files of a manifest."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                file = TokenFile(path)
                for at in range(0, file.n, 1024):
                    k = min(at + 1024, file.n)
                    bounds = file.offsets(np.arange(at, k + 1))
                    crcs = []
                    for a, b in zip(bounds.tolist(), bounds[1:].tolist()):
                        crcs.append(zlib.crc32(file.between(a, b).astype("<u4").tobytes()))
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array(file.doc_ids[at:k], pa.int64()), "start": pa.array(start + bounds[:-1], pa.int64()), "n_tokens": pa.array(np.diff(bounds), pa.int64()), "ids_crc32": pa.array(crcs, pa.int64())})

    spread = manifest.repartition(max(1, manifest.count()))
    return spread.select("path", "start").mapInArrow(read, schema)


def token_files(docs: DataFrame, path: str, folder: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the files, then read every document's place and checksum back from them.

    Returns (id, start, n_tokens with the end id, ids_crc32 of its ids as 4-byte little-endian
    integers); repeated ids keep a row each, an empty table has no file and no row.
    """
    folder = folder or scratch(docs.sparkSession, "token-files")
    manifest = write_token_files(docs, path, folder, end_id, id_col, text_col, file_bytes)
    return read_token_files(manifest).withColumnRenamed("doc_id", id_col)
