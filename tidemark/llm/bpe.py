"""Byte-level BPE: higher-order functions fold ranked merges over the bytes of distinct words.

1. Documents are packed into chunks of bounded text. A chunk lists its distinct words (matches of the pattern), dealt to
   ranges by hash, and keeps each document as numbers of these words; both are written compressed, so no text is shuffled.
2. The words of a range meet in one task, each distinct one once. ``aggregate`` folds the merges over its array of byte
   ids: each element holds its id and the rank of the pair with the next one, the lowest rank (leftmost of equals)
   is merged, until none is left. The rank map is a literal array in which every first id of a pair has its own offset.
3. The ids go back to the chunks that hold the word, where each document's ids are put together and decoded: the
   binary pieces of its ids, concatenated.

Words beyond ``LONG`` bytes, for which the fold would take quadratic time, are merged with a heap in the chunk by the same rule.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import pickle
from array import array
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import emptied, materialise
from .units import units, words

#: Buckets that a table of chunks has at most (Spark's own limit is 100,000).
MOST_BUCKETS = 50_000
#: Above any id; an element of the fold is rank << BITS | id.
BITS = 20
NONE = 1 << BITS
#: Bytes up to which a word is folded; bytes of text to a chunk, about, and to a range of words.
LONG, CHUNK_BYTES, RANGE_BYTES = 48, 16 << 20, 16 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a .tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))}


class Ranks:
    """Pairs of ids with the id that they merge to, and the bytes of each id."""

    _open: dict[str, Ranks] = {}

    def __init__(self, path: str):
        ranks = read_ranks(path)
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"the rank file lacks the bytes {missing}")
        self.byte_ids = [ranks[bytes([b])] for b in range(256)]
        self.pieces = [b""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            self.pieces[rank] = piece

    @cached_property
    def pairs(self) -> dict[tuple[int, int], int]:
        """The id that each pair of ids merges to; tasks without a long word don't need it."""
        ranks = {piece: rank for rank, piece in enumerate(self.pieces) if piece}
        out = {}
        for piece, rank in ranks.items():
            for i in range(1, len(piece)):
                a, b = ranks.get(piece[:i]), ranks.get(piece[i:])
                if a is not None and b is not None:
                    out[a, b] = rank
        return out

    @classmethod
    def of(cls, path: str) -> Ranks:
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def merge(self, word: bytes) -> list[int]:
        """The ids of one word, by a heap of pairs: the lowest rank first, the leftmost of equals."""
        ids, n, pairs = [self.byte_ids[b] for b in word], len(word), self.pairs
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (r := pairs.get((a, b))) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = right[i] if alive[i] else n
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], right[i] = rank, False, right[j]
            if right[i] < n:
                left[right[i]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y < n and (r := pairs.get((ids[x], ids[y]))) is not None:
                    heapq.heappush(heap, (r, x, ids[x], ids[y]))
        return [x for x, on in zip(ids, alive) if on]

    def table(self) -> tuple[list[int], list[int]]:
        """Entries (first id + 1 << BITS | merged id) and, for each first id, an offset: the entry of a pair is at offset + second id.

        Offsets are drawn until no two rows of the table meet, the longest row first; a free place, 0, matches no id.
        """
        rows: dict[int, list[tuple[int, int]]] = {}
        for (a, b), rank in self.pairs.items():
            rows.setdefault(a, []).append((b, rank))
        size = 1 << max(8, (4 * len(self.pairs)).bit_length(), len(self.pieces).bit_length())
        entries, free, rng = np.zeros(size, np.int64), np.ones(size, bool), np.random.default_rng(1)
        offsets = np.zeros(len(self.pieces), np.int64)
        for a, row in sorted(rows.items(), key=lambda x: (-len(x[1]), x[0])):
            second = np.array([b for b, _ in row])
            while True:
                drawn = rng.integers(-int(second.min()), size - int(second.max()), 64 if len(row) < 200 else 4)
                fits = np.flatnonzero(free[second[:, None] + drawn].all(axis=0))
                if len(fits):
                    break
            at = second + drawn[fits[0]]
            free[at], offsets[a] = False, drawn[fits[0]]
            entries[at] = a + 1 << BITS | np.array([rank for _, rank in row])
        self.__dict__.pop("pairs", None)  # the driver needs them for nothing else
        return entries.tolist(), offsets.tolist()


def _numbers(values: list[int], kind: str) -> Column:
    """A literal array; it is written as text, which Spark folds to one constant."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def _with(value: Column, f) -> Column:
    """``f(value)`` with the value taken once, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), 0)


def fold(start: Column, path: str) -> Column:
    """The ids (array<bigint>) that the byte ids of one word merge to; null stays null. Built-in functions only."""
    entries, offsets = Ranks.of(path).table()
    low_bits = F.lit(NONE - 1)

    def element(t: Column, o: Column, a: Column, b: Column) -> Column:
        """rank << BITS | a, where the pair (a, b) has a rank; the largest rank is none."""
        merged = F.get(t, (F.get(o, a.cast("int")) + b).cast("int")).bitwiseXOR(F.shiftleft(a + 1, BITS))
        return F.shiftleft(F.least(merged, F.lit(NONE).cast("long")), BITS).bitwiseOR(a)

    def step(t: Column, o: Column, s: Column) -> Column:
        def at(low: Column) -> Column:
            def merged(p: Column) -> Column:  # the pair is at p and p + 1; its neighbours' ranks change
                before, behind = F.get(s, p - 2).bitwiseAND(low_bits), F.get(s, p + 1).bitwiseAND(low_bits)
                fresh = F.array(element(t, o, before, low), element(t, o, low, behind))
                return F.concat(F.slice(s, F.lit(1), p - 2), fresh, F.slice(s, p + 2, F.lit(1 << 20)))

            place = F.array_position(F.transform(s, lambda e: F.shiftright(e, BITS)), low).cast("int")
            return F.when(low < NONE, _with(place, merged)).otherwise(s)

        return _with(F.shiftright(F.array_min(s), BITS), at)

    def folded(t: Column, o: Column, ids: Column) -> Column:
        begin = F.transform(ids, lambda a, i: element(t, o, a, F.get(ids, i + 1)))
        return F.aggregate(ids, begin, lambda s, _: step(t, o, s), lambda s: F.transform(F.slice(s, F.lit(2), F.lit(1 << 20)), lambda e: e.bitwiseAND(low_bits)))

    ids = F.concat(F.array(low_bits.cast("long")), start.cast("array<bigint>"))  # a first id that is in no pair, so every pair has a neighbour before it
    return _with(_numbers(entries, "bigint"), lambda t: _with(_numbers(offsets, "bigint"), lambda o: _with(ids, lambda i: folded(t, o, i))))


def _pieces_of(ids: Column, path: str) -> Column:
    """The binary pieces of an array of ids, concatenated; an id outside the vocabulary adds nothing."""
    pieces = F.split(F.lit(",".join(p.hex() for p in Ranks.of(path).pieces)), ",")
    return F.unhex(F.array_join(_with(pieces, lambda p: F.transform(ids, lambda i: F.get(p, i.cast("int")))), ""))


def encode_words(table: DataFrame, path: str, word: str = "word") -> DataFrame:
    """Adds ``ids`` (array<bigint>), ``ids_text`` and ``decoded`` (binary) to a table of words of at most a few dozen bytes.

    Built-in functions only. A null word stays null; an empty one has no ids.
    """
    text = F.hex(F.encode(F.col(word), "UTF-8"))
    places = F.when(F.length(word) == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.octet_length(word)))
    start = _with(_numbers(Ranks.of(path).byte_ids, "bigint"), lambda t: F.transform(places, lambda i: F.get(t, F.conv(F.substr(text, 2 * i - 1, F.lit(2)), 16, 10).cast("int"))))
    done = table.withColumn("ids", fold(start, path))
    return done.withColumns({"ids_text": F.array_join(F.transform("ids", lambda i: i.cast("string")), ","), "decoded": _pieces_of(F.col("ids"), path)})


def decode_ids(table: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """Adds ``decoded``: the binary pieces of an array of ids, concatenated. An id outside the vocabulary adds nothing."""
    return table.withColumn("decoded", _pieces_of(F.col(ids), path))


def _squeezed(*arrays) -> bytes:
    """Arrays of integers and other values as compressed bytes; the bytes of equal weight of all numbers lie together."""
    planes = [(x.dtype.str, np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes()) if isinstance(x, np.ndarray) and len(x) else x for x in arrays]
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(planes, protocol=5))


def _unsqueezed(data: bytes) -> list:
    planes = pickle.loads(zstandard.ZstdDecompressor().decompress(data))
    return [np.ascontiguousarray(np.frombuffer(x[1], np.uint8).reshape(np.dtype(x[0]).itemsize, -1).T).view(x[0]).ravel() if isinstance(x, tuple) else x for x in planes]


def _gather(flat: np.ndarray, lengths: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The runs ``which`` of ``flat``, laid end to end; ``lengths`` are those of all runs."""
    starts, n = (np.cumsum(lengths) - lengths)[which], lengths[which]
    return flat[np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())]


class _Chunk:
    """Documents as numbers of units, and units as numbers of words; closed, words are numbered by (range, word)."""

    def __init__(self, ranges: int):
        self.ranges, self.size = ranges, 0
        self.units: dict[str, int] = {}
        self.words: dict[str, int] = {}
        self.of_unit, self.flat = array("I"), array("I")  # words in each unit, and which
        self.rows: list[int | None] = []
        self.docs: list[np.ndarray] = []

    def add(self, row: int | None, text: str | None) -> None:
        us, known = units(text) if text else [], self.units
        for u in dict.fromkeys(us):
            if u not in known:
                known[u] = len(known)
                ws = (u,) if u.isalpha() or u[0] == " " and u[1:].isalpha() else words(u)  # most units are a run of letters
                self.of_unit.append(len(ws))
                self.flat.extend([self.words.setdefault(w, len(self.words)) for w in (ws if len(ws) > 1 else (u,))])
        self.rows.append(row)
        self.docs.append(np.fromiter(map(known.__getitem__, us), np.uint32, len(us)))
        self.size += len(text or "")

    def close(self) -> Iterator[tuple[int, bytes]]:
        """(range, distinct words), ascending, then (-1, the documents)."""
        self.units.clear()
        dealt: dict[int, list[tuple[bytes, int]]] = {}
        long_words = []
        for w, k in self.words.items():
            b = w.encode()
            if len(b) > LONG:
                long_words.append((b, k))
            else:
                dealt.setdefault(xxhash.xxh3_64_intdigest(b) % self.ranges, []).append((b, k))
        number, n = np.empty(len(self.words), np.uint32), 0
        self.words.clear()
        for part in sorted(dealt):
            own = sorted(dealt.pop(part))
            number[[k for _, k in own]] = np.arange(n, n + len(own), dtype=np.uint32)
            n += len(own)
            yield part, zstandard.compress(b"\xff".join([b for b, _ in own]))
        number[[k for _, k in long_words]] = np.arange(n, n + len(long_words), dtype=np.uint32)
        in_doc = np.array([len(d) for d in self.docs], np.uint32)
        flat = number[np.frombuffer(self.flat, np.uint32)] if len(self.flat) else np.empty(0, np.uint32)
        yield -1, _squeezed(self.rows, in_doc, np.concatenate(self.docs), np.array(self.of_unit, np.uint32), flat, [b for b, _ in long_words])


def _packed(ranges: int, chunk_bytes: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, chunk = TaskContext.get().partitionId() << 32, _Chunk(ranges)

        def closed() -> Iterator[pa.RecordBatch]:
            for part, data in chunk.close():
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([part], pa.int64()), pa.array([data], pa.binary())], ["chunk", "part", "data"])

        for batch in batches:
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist()):
                chunk.add(row, text)
                if chunk.size >= chunk_bytes:
                    yield from closed()
                    number, chunk = number + 1, _Chunk(ranges)
        if chunk.rows:
            yield from closed()

    return pack


def _distinct(path: str):
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each range: its distinct words in order, as byte ids, with the chunks that hold them."""
        byte_ids = np.array(Ranks.of(path).byte_ids, np.int64)

        def met(part: int, holders: dict[bytes, list[int]]) -> Iterator[pa.RecordBatch]:
            ws = sorted(holders)
            for at in range(0, len(ws), 8192):
                some = ws[at : at + 8192]
                named = [holders.pop(w) for w in some]
                runs = lambda xs: pa.array(np.cumsum([0, *map(len, xs)]), pa.int32())
                start = pa.ListArray.from_arrays(runs(some), pa.array(byte_ids[np.frombuffer(b"".join(some), np.uint8)]))
                chunks = pa.ListArray.from_arrays(runs(named), pa.array([c for cs in named for c in cs], pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(some), pa.int64()), start, chunks], ["part", "start", "chunks"])

        last, holders = None, {}
        for batch in batches:
            for part, chunk, data in zip(*(batch.column(c).to_pylist() for c in ("part", "chunk", "data"))):
                if part != last:
                    yield from met(last, holders)
                    last, holders = part, {}
                for w in zstandard.decompress(data).split(b"\xff"):
                    holders.setdefault(w, []).append(chunk)
        yield from met(last, holders)

    return meet


def _back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each range and chunk: the ids of the chunk's words of that range, in order."""

    def sent(part: int, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        n_chunks, chunks, n_ids, ids = (np.concatenate(x) for x in zip(*held))
        word = np.repeat(np.arange(len(n_chunks)), n_chunks)
        order = np.argsort(chunks, kind="stable")
        cut = np.flatnonzero(np.concatenate([[True], np.diff(chunks[order]) != 0])).tolist()
        for a, b in zip(cut, [*cut[1:], len(order)]):
            own = word[order[a:b]]
            data = _squeezed(n_ids[own].astype(np.uint8), _gather(ids, n_ids, own).astype(np.uint32))
            yield pa.RecordBatch.from_arrays([pa.array([int(chunks[order[a]])]), pa.array([part], pa.int64()), pa.array([data], pa.binary())], ["chunk", "part", "data"])

    last, held = None, []
    for batch in batches:
        parts = batch.column("part").to_numpy()
        cut = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)]
        for a, b in zip(cut, cut[1:]):
            if a == b:
                continue
            if parts[a] != last and held:
                yield from sent(last, held)
                held = []
            last, rows = int(parts[a]), batch.slice(a, b - a)
            lists = [rows.column(c) for c in ("chunks", "ids")]
            held.append(tuple(x for c in lists for x in (np.diff(c.offsets.to_numpy()), c.flatten().to_numpy())))
    if held:
        yield from sent(last, held)


def _assembler(path: str, with_ids: bool):
    def assembled(docs: bytes, known: list[bytes]) -> list[tuple]:
        ranks = Ranks.of(path)
        rows, in_doc, doc_units, of_unit, unit_words, long_words = _unsqueezed(docs)
        runs = [_unsqueezed(x) for x in known]
        merged = [ranks.merge(w) for w in long_words]
        n_ids = np.concatenate([np.asarray(n, np.int64) for n, _ in runs] + [np.array([len(m) for m in merged], np.int64)])
        ids = np.concatenate([np.asarray(i, np.int64) for _, i in runs] + [np.array([i for m in merged for i in m], np.int64)])
        of_unit = np.asarray(of_unit, np.int64)
        unit_ids = _gather(ids, n_ids, np.asarray(unit_words, np.int64))
        ends = np.cumsum(np.add.reduceat(n_ids[unit_words], np.cumsum(of_unit) - of_unit) if len(of_unit) else np.empty(0, np.int64)).tolist()
        name = list(map(str, range(len(ranks.pieces))))
        texts, decoded, begin = [], [], 0
        for end in ends:  # of units: their ids in decimal, and the pieces that the ids stand for
            own = unit_ids[begin:end].tolist()
            texts.append(",".join(map(name.__getitem__, own)))
            decoded.append(b"".join(map(ranks.pieces.__getitem__, own)))
            begin = end
        out, begin = [], 0
        for row, n in zip(rows, np.asarray(in_doc, np.int64).tolist()):
            us = doc_units[begin : begin + n].tolist() if n else []
            begin += n
            text = ",".join(map(texts.__getitem__, us))
            whole = b"".join(map(decoded.__getitem__, us))
            out.append((row, text.count(",") + 1 if us else 0, hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(whole).hexdigest(), text)[: 4 + with_ids])
        return out

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row is a chunk: its documents, and the ids of its words by range."""
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()][: 4 + with_ids]
        for batch in batches:
            for k in range(len(batch.column("data"))):
                known = batch.column("known")[k].as_py() or []
                columns = list(zip(*assembled(batch.column("data")[k].as_py(), [x["data"] for x in known])))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids_text"][: 4 + with_ids])

    return assemble


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, with_ids: bool = False) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256[, ids_text]) of every row.

    A null or empty text has no ids (digests of the empty string). Repeated rows and null ids keep a row
    each. ``ids_text`` is the decimal ids joined by commas. A chunk ends with the document that fills it, so a very long
    text is one chunk. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("row"), F.col(text_col).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text")).cast("long")).first()[0] or 0
    at_once = 2 * docs.sparkSession.sparkContext.defaultParallelism
    ranges, chunks = max(-(-total // RANGE_BYTES), at_once), max(-(-total // chunk_bytes), at_once)
    # the chunks lie in buckets, so that only ids are moved to them
    buckets = max(chunks, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    packed = materialise(rows.mapInArrow(emptied(_packed(ranges, chunk_bytes)), "chunk long, part long, data binary"), "chunks", bucket="chunk", buckets=min(int(buckets), MOST_BUCKETS))
    of_range = packed.where("part >= 0").select("part", "chunk", "data").repartition(int(ranges), "part").sortWithinPartitions("part", "chunk")
    encoded = of_range.mapInArrow(emptied(_distinct(path)), "part long, start array<bigint>, chunks array<bigint>").select("part", "chunks", fold(F.col("start"), path).alias("ids"))
    ids = encoded.mapInArrow(emptied(_back), "chunk long, part long, data binary").groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("part", "data"))).alias("known"))
    whole = packed.where("part < 0").select("chunk", "data").join(ids, "chunk", "left").select("data", "known")
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids_text string" * with_ids
    return whole.mapInArrow(emptied(_assembler(path, with_ids)), schema).withColumnRenamed("doc_id", id_col)
