"""Cross-tokenizer alignment: which tokens of one tokenizer end where tokens of another end, and how often.

1. Each whole text is encoded by both tokenizers; byte offsets at which tokens of both end cut it into groups, and the
   tokens that end together are linked. Rows are numbered where they are read.
2. A task inverts its links: for every id pair it keeps, a block of 65,536 row numbers at a time, compressed bitmaps of the
   documents: plane ``k`` holds those whose number of links of the pair has bit ``k``. A container is a sorted list of
   two-byte places, or a bitmap of 8 KiB where that is smaller.
3. Containers of a (pair, block) are OR-merged and popcounted: the union of the planes gives documents, the planes weighted by
   2^k give links. A pair in all documents is dealt out by block; only its few numbers per block meet.
4. The postings carry each pair's count back to the documents of a block, where it is summed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .units import _DOUBLED, _OTHER, _OTHER_ASCII, LibraryMemo, words

#: Links that a task holds before it inverts them, and units that a memo holds (neither changes a result).
HELD_LINKS, MEMO_UNITS = 1 << 22, 500_000
#: Row numbers of a block and bytes of its plain bitmap; a list of places is shorter below this many.
BLOCK_BITS, PLAIN = 16, 8192
_COUNTS = ["n_a", "n_b", "n_groups", "n_links"]
_INNER = [("row", pa.int64()), *[(c, pa.int64()) for c in _COUNTS], ("groups_sha256", pa.string()), ("pair", pa.int64()), ("block", pa.int64()), ("plane", pa.int32()), ("bits", pa.binary())]


class WordMemo(LibraryMemo):
    """Byte-level ids of pieces of text, special strings taken as plain text; what is held are words."""

    _open: dict[str, WordMemo] = {}

    def __init__(self, path: str):
        super().__init__(path, MEMO_UNITS)
        self.tokenizer.encode_special_tokens, self.special = True, []
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        byte = {c: b for b, c in _byte_letters().items()}
        self.bytes = [b""] * (max(vocabulary.values(), default=-1) + 1)
        for entry, i in vocabulary.items():
            self.bytes[i] = bytes(byte[c] for c in entry) if all(c in byte for c in entry) else entry.encode()

    def of_units(self, units: list[str]) -> list[bytes]:
        split = [[u] if u[0] == " " and u[1:].isalpha() else words(u) for u in units]
        if len(self.memo) > self.limit:
            self.memo.clear()
        self._encode_words(list({w for ws in split for w in ws if w not in self.memo}))
        return [b"".join(map(self.memo.__getitem__, ws)) for ws in split]

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int64)


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Pieces:
    """A piece model with the bytes of its pieces.

    Where no piece holds a space behind another character, nor a newline, a text may be cut in front of such a space and on both
    sides of a newline. The model puts a space in front of what it is given; behind a newline of our own it is seen to be there.
    """

    _open: dict[str, Pieces] = {}

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.lead = self.model.encode("\n")
        self.apart = len(self.lead) == 2 and all(self.bytes) and not any("▁" in p.lstrip("▁") or "\n" in p for p in pieces)
        self.apart = self.apart and self.model.encode("a b\nc\nd") == [i for x in self.of_units([" a", " b", "\n", "c", "\n", "d"]) for i in x]

    @classmethod
    def of(cls, path: str) -> Pieces:
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def of_units(self, units: list[str]) -> list[list[int]]:
        got = self.model.encode([u[1:] if u[0] == " " else u if u == "\n" else "\n" + u for u in units], num_threads=1)
        return [ids if u[0] == " " else ids[1:] if u == "\n" else ids[2:] for u, ids in zip(units, got)]


class Aligner:
    """Both tokenizers of a task, and a bounded memo of how their tokens meet in a unit of text.

    Tokens of both end wherever a text may be cut (:meth:`cut`), so groups, links and their listing are those of the units in
    order. Texts that may not be cut so are aligned as a whole.
    """

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = WordMemo.of(path_a), Pieces.of(path_b)
        self.width = len(self.b.bytes)
        if len(self.a.bytes) * self.width >= 1 << 47:
            raise ValueError("the vocabularies have too many id pairs for 47 bits")
        self.size_a = np.array([len(x) for x in self.a.bytes], np.int64)
        self.size_b = np.array([len(x) for x in self.b.bytes], np.int64)
        self.shown = [b"%d%c" % (i, c) for i in range(len(self.a.bytes)) for c in b",|"] + [b"%d%c" % (i, c) for i in range(self.width) for c in b",;"]
        self.shown_size = np.array([len(x) for x in self.shown], np.int64)
        self.apart = self.a.apart and self.b.apart
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.listed: list[bytes] = []  # of each known unit: its groups, its links, and its tokens of A and of B
        self.links: list[bytes] = []
        self.tokens = np.zeros((2, 0), np.int64)

    def cut(self, text: str) -> list[str] | None:
        """A space and the text cut in front of spaces and around newlines, or None where there is more white space than lone ones."""
        if not self.apart or text[0] in " \n" or text[-1] in " \n" or any(x in text for x in _DOUBLED) or any(x in text for x in (_OTHER_ASCII if text.isascii() else _OTHER)):
            return None
        return (" " + text).replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")[1:]

    def align(self, texts: list[str | None]) -> list[tuple[int, int, int, int, str, np.ndarray]]:
        """(tokens of A, of B, groups, links, digest of the groups, id pair of every link) of each text."""
        cuts = [None if not t or "▁" in t else self.cut(t) for t in texts]
        missing = {u for c in cuts if c for u in c if u not in self.known}
        if len(self.known) + len(missing) > MEMO_UNITS:
            self.forget()
            missing = {u for c in cuts if c for u in c}
        self._learn(list(missing))
        return [self._sum(c) if c else self._whole(t) if t and "▁" not in t else _NOTHING for t, c in zip(texts, cuts)]

    def _sum(self, cut: list[str]) -> tuple:
        at = list(map(self.known.__getitem__, cut))
        n_a, n_b = self.tokens[:, np.array(at)].sum(1).tolist()
        pairs = np.frombuffer(b"".join(map(self.links.__getitem__, at)), np.int64)
        digest = hashlib.sha256(b"".join(map(self.listed.__getitem__, at))[:-1]).hexdigest()
        return n_a, n_b, len(pairs), len(pairs), digest, pairs  # a token of a unit has bytes, so a group has a link

    def _learn(self, units: list[str]) -> None:
        for k in range(0, len(units), 8192):
            part = units[k : k + 8192]
            got_a, got_b = self.a.of_units(part), self.b.of_units(part)
            n_a, n_b = np.array([len(x) // 4 for x in got_a]), np.array([len(x) for x in got_b])
            a = np.frombuffer(b"".join(got_a), "<u4").astype(np.int64)
            b = np.fromiter((i for x in got_b for i in x), np.int64, int(n_b.sum()))
            if not self._same("".join(part), a, b):
                raise RuntimeError("a unit of text is not what its tokens join to")
            cuts, pairs, code = self._groups(a, b)
            shown, ends = b"".join(map(self.shown.__getitem__, code.tolist())), np.cumsum(self.shown_size[code])[np.cumsum(n_a + n_b) - 1].tolist()
            sizes = np.cumsum(self.size_a[a])[np.cumsum(n_a) - 1]
            last = (8 * np.searchsorted(cuts, sizes, "right")).tolist()
            raw = pairs.tobytes()
            at = len(self.listed)
            self.listed += [shown[i:j] for i, j in zip([0, *ends], ends)]
            self.links += [raw[i:j] for i, j in zip([0, *last], last)]
            self.known.update(zip(part, range(at, at + len(part))))
            self.tokens = np.concatenate([self.tokens, np.stack([n_a, n_b])], axis=1)

    def _same(self, text: str, a: np.ndarray, b: np.ndarray) -> bool:
        body = text.encode()
        return b"".join(map(self.a.bytes.__getitem__, a.tolist())) == body and b"".join(map(self.b.bytes.__getitem__, b.tolist())) == body

    def _whole(self, text: str) -> tuple:
        a, b = self.a.whole(" " + text), np.array(self.b.model.encode(text), np.int64)
        if not self._same(" " + text, a, b):
            return _NOTHING
        cuts, pairs, code = self._groups(a, b)
        return len(a), len(b), len(cuts), len(pairs), hashlib.sha256(b"".join(map(self.shown.__getitem__, code.tolist()))[:-1]).hexdigest(), pairs

    def _groups(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places where tokens of both end, id pair of every link, places in ``shown`` of the listing) of tokens of the same bytes."""
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        at_b = np.zeros(int(ends_b[-1]) + 1 if len(ends_b) else 1, bool)
        at_b[ends_b] = True
        hit = at_b[ends_a]
        common = ends_a[hit]
        cuts = common[_starts(common)]
        low, high = np.searchsorted(ends_b, common, "left"), np.searchsorted(ends_b, common, "right")
        each = high - low  # more than one only where an entry has no bytes
        first = np.repeat(low - np.cumsum(each) + each, each) + np.arange(int(each.sum()))
        pairs = np.repeat(a[hit], each) * self.width + b[first]
        group_a, group_b, n = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b), len(cuts)
        upto_a, upto_b = np.cumsum(np.bincount(group_a, minlength=n)), np.cumsum(np.bincount(group_b, minlength=n))
        last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        last_a[upto_a - 1] = 1
        last_b[upto_b - 1] = 1
        code = np.empty(len(a) + len(b), np.int64)
        code[np.arange(len(a)) + np.concatenate([[0], upto_b])[group_a]] = 2 * a + last_a
        code[np.arange(len(b)) + upto_a[group_b]] = 2 * (len(self.a.bytes) + b) + last_b
        return cuts, pairs, code


_NOTHING = (0, 0, 0, 0, "", np.zeros(0, np.int64))


def _starts(values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.concatenate([np.ones(min(len(values), 1), bool), values[1:] != values[:-1]]))


def containers(keys: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Of sorted ``value << 16 | place``: the distinct values and the container of each one's places."""
    value, place = keys >> BLOCK_BITS, (keys & 0xFFFF).astype("<u2")
    starts = _starts(value)
    ends = np.append(starts, len(keys))[1:]
    if (2 * (ends - starts) < PLAIN).all():
        offsets = np.append(starts, len(keys)).astype("<i4") * 2
        return value[starts], pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(place.tobytes())])
    out = []
    for s, e in zip(starts.tolist(), ends.tolist()):
        if 2 * (e - s) < PLAIN:
            out.append(place[s:e].tobytes())
        else:
            plain = np.zeros(1 << BLOCK_BITS, np.uint8)
            plain[place[s:e]] = 1
            out.append(np.packbits(plain).tobytes())
    return value[starts], pa.array(out, pa.binary())


def places(bits: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(index of the container, place) of everything that the containers hold."""
    bits = bits.cast(pa.binary())
    offsets = np.frombuffer(bits.buffers()[1], "<i4")[bits.offset : bits.offset + len(bits) + 1].astype(np.int64)
    sizes, data = np.diff(offsets), np.frombuffer(bits.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    plain = sizes == PLAIN
    if not plain.any():
        return np.repeat(np.arange(len(bits)), sizes // 2), data.view("<u2").astype(np.int64)
    index, found = [], []
    for k in np.flatnonzero(plain).tolist():
        at = np.flatnonzero(np.unpackbits(data[offsets[k] - offsets[0] : offsets[k + 1] - offsets[0]]))
        index.append(np.full(len(at), k))
        found.append(at)
    listed = np.repeat(~plain, sizes)
    index.append(np.repeat(np.flatnonzero(~plain), sizes[~plain] // 2))
    found.append(data[listed].view("<u2").astype(np.int64))
    return np.concatenate(index), np.concatenate(found)


def _inverted(keys: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, pa.Array]]:
    """(plane, pairs, containers) of the links of a block, given as ``pair << 16 | place``."""
    links = np.sort(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
    starts = _starts(links)
    once, times = links[starts], np.diff(np.append(starts, len(links)))
    for plane in range(int(times.max(initial=0)).bit_length()):
        yield plane, *containers(once[(times >> plane & 1) == 1])


def _aligned(path_a: str, path_b: str, id_type: pa.DataType):
    schema = pa.schema([("id", id_type), *_INNER])

    def rows(n: int, filled: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([filled[f.name] if f.name in filled else pa.nulls(n, f.type) for f in schema], schema=schema)

    def inverted(block: int, keys: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for plane, pairs, bits in _inverted(keys):
            for at in range(0, len(pairs), 50_000):
                part = pairs[at : at + 50_000]
                yield rows(len(part), {"pair": pa.array(part), "block": pa.array(np.full(len(part), block)), "plane": pa.array(np.full(len(part), plane, np.int32)), "bits": bits.slice(at, len(part))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, row = Aligner(path_a, path_b), TaskContext.get().partitionId() << 33
        keys, held, block = [], 0, row >> BLOCK_BITS
        for batch in batches:
            found = []
            texts = batch.column("text").to_pylist()
            for *counts, pairs in (x for k in range(0, len(texts), 256) for x in both.align(texts[k : k + 256])):
                if row >> BLOCK_BITS != block or held >= HELD_LINKS:
                    yield from inverted(block, keys)
                    keys, held, block = [], 0, row >> BLOCK_BITS
                found.append((row, *counts))
                keys.append(pairs << BLOCK_BITS | (row & 0xFFFF))
                held += len(pairs)
                row += 1
            if found:
                columns = dict(zip(["row", *_COUNTS, "groups_sha256"], zip(*found)))
                yield rows(len(found), {"id": batch.column("id").cast(id_type)} | {k: pa.array(v, schema.field(k).type) for k, v in columns.items()})
        yield from inverted(block, keys)

    return run


def _merged(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the row, place, multiplicity) of all that the containers of the rows hold, OR-merged plane by plane."""
    lists = batch.column("parts")
    flat = lists.flatten()
    owner = np.repeat(np.arange(len(batch)), lists.value_lengths().to_numpy(zero_copy_only=False))
    index, place = places(flat.field("bits"))
    plane = flat.field("plane").to_numpy(zero_copy_only=False).astype(np.int64)
    once = np.unique((owner[index] << BLOCK_BITS | place) << 6 | plane[index])
    key = once >> 6
    starts = _starts(key)
    times = np.add.reduceat(np.int64(1) << (once & 63), starts) if len(key) else np.zeros(0, np.int64)
    return key[starts] >> BLOCK_BITS, key[starts] & 0xFFFF, times


def _popcounts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        owner, _, times = _merged(batch)
        docs, links = np.bincount(owner, minlength=len(batch)), np.zeros(len(batch), np.int64)
        np.add.at(links, owner, times)
        yield pa.RecordBatch.from_arrays([batch.column("pair"), batch.column("block"), batch.column("parts"), pa.array(docs, pa.int64()), pa.array(links)], ["pair", "block", "parts", "n_docs", "n_links"])


def _returned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of counts and of best links by row number; the rows come a block after the other."""
    now, sums = None, np.zeros((2, 1 << BLOCK_BITS), np.int64)

    def done() -> pa.RecordBatch:
        at = np.flatnonzero(sums[1])
        return pa.RecordBatch.from_arrays([pa.array(at + (now << BLOCK_BITS)), pa.array(sums[0, at]), pa.array(sums[1, at])], ["row", "n_best", "count_sum"])

    for batch in batches:
        owner, place, times = _merged(batch)
        count, best = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("count", "best"))
        blocks = batch.column("block").to_numpy(zero_copy_only=False)
        for block in np.unique(blocks).tolist():
            if block != now:
                if now is not None:
                    yield done()
                now = block
                sums[:] = 0
            here = blocks[owner] == block
            np.add.at(sums[0], place[here], (times * best[owner])[here])
            np.add.at(sums[1], place[here], (times * count[owner])[here])
    if now is not None:
        yield done()


class Alignment:
    """One alignment of a table: its documents, its postings, and what is counted from them.

    A text that is null, empty, or that one of the tokenizers does not give back byte by byte has no tokens. Repeated rows and
    null ids are rows of their own; an empty table has no rows. Columns other than the id and the text are not read.
    """

    def __init__(self, docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text"):
        known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        kind = known.schema["id"].dataType
        id_type = known.limit(0).toArrow().schema.field("id").type
        schema = f"id {kind.simpleString()}, row long, {', '.join(c + ' long' for c in _COUNTS)}, groups_sha256 string, pair long, block long, plane int, bits binary"
        self.id_col, self.width = id_col, len(Pieces.of(path_b).bytes)
        self._rows = materialise(known.mapInArrow(_aligned(path_a, path_b, id_type), schema), "aligned")
        parts = self._rows.where("pair is not null").groupBy("pair", "block").agg(F.collect_list(F.struct("plane", "bits")).alias("parts"))
        kept = "pair long, block long, parts array<struct<plane:int,bits:binary>>, n_docs long, n_links long"
        self._postings = materialise(parts.mapInArrow(_popcounts, kept), "postings")

    def pair_counts(self) -> DataFrame:
        """(a, b, n_docs, n_links, best): each linked id pair; best where no pair of the same b has more links."""
        return self._scored().select(F.expr(f"pair div {self.width}").alias("a"), F.expr(f"pair % {self.width}").alias("b"), "n_docs", F.col("count").alias("n_links"), "best")

    def _scored(self) -> DataFrame:
        counts = self._postings.groupBy("pair").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_links").alias("count")).withColumn("_b", F.col("pair") % self.width)
        top = counts.groupBy("_b").agg(F.max("count").alias("_top"))
        return counts.join(top, "_b").select("pair", "n_docs", "count", (F.col("count") == F.col("_top")).alias("best"))

    def documents(self) -> DataFrame:
        """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row."""
        scored = self._postings.select("pair", "block", "parts").join(self._scored().drop("n_docs"), "pair")
        back = scored.repartition("block").sortWithinPartitions("block").mapInArrow(_returned, "row long, n_best long, count_sum long")
        rows = self._rows.where("pair is null").select("row", F.col("id").alias(self.id_col), *_COUNTS, "groups_sha256")
        zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
        return rows.join(back, "row", "left").select(self.id_col, *_COUNTS, zero("n_best"), zero("count_sum"), "groups_sha256")


def align_documents(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """:meth:`Alignment.documents` of a new alignment."""
    return Alignment(docs, path_a, path_b, id_col, text_col).documents()
