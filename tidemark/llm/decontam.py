"""Benchmark decontamination by latent semantic retrieval.

1. Documents are cut into overlapping passages of words; document frequencies of hashed words are counted over
   all passages of the corpus.
2. A randomised SVD of the passages' TF-IDF matrix: each partition multiplies its rows with a random
   sketch and back, and Spark adds the partial products; the basis and the singular values follow from small
   matrices (terms x sketch) on the driver. Their size depends on the hashed vocabulary, not on the corpus.
3. Every passage is projected on the basis, scaled by the singular values, and compared by cosine with
   the projections of all passages of the benchmark, in blocks: these are a stated query set.
4. Passages of fixed length miss short and much changed items, so pairs are also found exactly: a stretch can't hold
   more of an item in order than it holds of its words at all, so items of which a block of the document has enough words are candidates
   wherever they may start.
5. Candidates are verified: longest common subsequence of words with the item's passage, and where the benchmark has
   answers, the answer's words within the matching document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import emptied, materialise

#: Words of a passage and its stride (half of it), hashed terms, latent dimensions, oversampling. Frequencies and the basis are
#: taken over passages side by side, so each word counts once; the search takes overlapping ones.
PASSAGE, STRIDE, TERMS, RANK, EXTRA = 32, 16, 1 << 13, 40, 8
#: Cosine of a candidate, share of the item's passage in the longest common subsequence, seed.
COSINE, COMMON, SEED = 0.6, 0.8, 7
#: Bytes of the benchmark that are searched at a time.
PART_BYTES = 16 << 20
#: ASCII letters lowered, digits and bytes beyond ASCII kept, all else a space.
_PLAIN = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in bytes(range(256)).lower())


def words(text: bytes | None) -> list[bytes]:
    """Lower-cased runs of letters and digits (any byte beyond ASCII counts as a letter)."""
    return bytes(text or b"").translate(_PLAIN).split()


def numbers(text: bytes | None) -> np.ndarray:
    """32-bit hashes of the words of a text; a word's term is its hash modulo ``TERMS``."""
    ws = words(text)
    return np.fromiter(map(xxhash.xxh3_64_intdigest, ws), np.uint64, len(ws)).astype(np.uint32)


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, words): each text as its words' hashes, four bytes a word, so that later passes need not split it again."""
    for batch in batches:
        texts = batch.column("text")
        for at in range(0, len(texts), 512):
            found = [numbers(x).tobytes() for x in texts.slice(at, 512).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, 512), pa.array(found, pa.binary())], ["doc_id", "words"])


def _pieces(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, document) of each piece of ``size`` words of documents laid end to end; the last piece of one may be shorter."""
    n = -(-lengths // size)
    doc = np.repeat(np.arange(len(lengths)), n)
    within = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    return (np.cumsum(lengths) - lengths)[doc] + within * size, doc


def _sums_of(terms: np.ndarray, at: np.ndarray, weighted: np.ndarray) -> np.ndarray:
    """Of each piece: its TF-IDF row (not written out) times a basis whose rows are multiplied by the term's weight already."""
    return np.add.reduceat(weighted[terms], at, axis=0)


def _passages(terms: list[np.ndarray], weighted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Projected unit rows of all passages of some documents, with their document and first word.

    A passage is two successive strides of words; a document of one stride is one passage.
    """
    lengths = np.array([len(t) for t in terms])
    at, doc = _pieces(lengths, STRIDE)
    x = _sums_of(np.concatenate(terms), at, weighted)
    pair = np.flatnonzero(doc[1:] == doc[:-1])
    single = np.flatnonzero(lengths[doc] <= STRIDE)
    rows = np.concatenate([x[pair] + x[pair + 1], x[single]])
    first = np.concatenate([pair, single])
    begin = (np.cumsum(lengths) - lengths)[doc[first]]
    return _unit(rows), doc[first], at[first] - begin


def _terms(numbers: np.ndarray) -> np.ndarray:
    return (numbers % TERMS).astype(np.int64)


def _documents(batches: Iterator[pa.RecordBatch], some: int = 64) -> Iterator[list[np.ndarray]]:
    """Term numbers of a few documents at a time; documents without a word are left out."""
    for batch in batches:
        column = batch.column("words")
        for at in range(0, len(column), some):
            terms = [_terms(np.frombuffer(x, np.uint32)) for x in column.slice(at, some).to_pylist() if x]
            if terms:
                yield terms


def _sums(batches: Iterator[np.ndarray], width: int) -> Iterator[pa.RecordBatch]:
    """One row for each term of a partition's sum."""
    total = None
    for x in batches:
        total = x if total is None else total + x
    if total is not None:
        for at in range(0, TERMS, 1024):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + 1024)), pa.array(list(total[at : at + 1024].astype(np.float64)), pa.list_(pa.float64()))], ["term", "v"])


def _gathered(sums: DataFrame, width: int) -> np.ndarray:
    """Partial sums added by Spark; the result has one row for each hashed term, however large the corpus."""
    added = sums.groupBy("term").agg(*[F.sum(F.get("v", F.lit(i))).alias(f"v{i}") for i in range(width)])
    out = np.zeros((TERMS, width))
    for row in added.collect():
        out[row["term"]] = row[1:]
    return out


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """Smoothed inverse passage frequency of each hashed term over all passages of ``docs`` (column words)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[np.ndarray]:
            total = np.zeros((TERMS, 2))
            for terms in _documents(batches):
                at, _ = _pieces(np.array([len(t) for t in terms]), PASSAGE)
                ts = np.concatenate(terms)
                number = np.zeros(len(ts), np.int64)
                number[at[1:]] = 1
                key = np.cumsum(number) * TERMS + ts
                key.sort()
                once = key[np.concatenate([[True], key[1:] != key[:-1]])] % TERMS
                total[:, 0] += np.bincount(once, minlength=TERMS)
                total[0, 1] += len(at)
            if total[0, 1]:
                yield total

        return _sums(parts(), 2)

    got = _gathered(docs.select("words").mapInArrow(emptied(count), "term long, v array<double>"), 2)
    return np.log((1 + got[:, 1].sum()) / (1 + got[:, 0])) + 1


def randomised_svd(docs: DataFrame, idf: np.ndarray, rank: int = RANK, extra: int = EXTRA) -> np.ndarray:
    """Terms x rank basis of the passages' leading right singular vectors, each divided by its singular value.

    One pass forms A'(A W) for a random W, whose range holds the leading directions; the small
    eigenproblem of that sketch gives vectors and values.
    """
    sketch = np.random.default_rng(SEED).standard_normal((TERMS, rank + extra)).astype(np.float32)
    box = docs.sparkSession.sparkContext.broadcast((idf.astype(np.float32), sketch))  # terms x sketch, 2 MB

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf_, w = box.value

        weighted, total = idf_[:, None] * w, np.zeros((TERMS, w.shape[1]))

        def parts() -> Iterator[np.ndarray]:
            seen = False
            for terms in _documents(batches):
                seen = True
                at, _ = _pieces(np.array([len(t) for t in terms]), PASSAGE)
                ts = np.concatenate(terms)
                y = _sums_of(ts, at, weighted)
                y /= np.maximum(np.add.reduceat(idf_[ts] ** 2, at), 1e-12)[:, None]  # rows have length one, on both sides of the product
                piece = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(ts))))
                order = np.argsort(ts.astype(np.int16), kind="stable")
                cut = np.flatnonzero(np.concatenate([[True], np.diff(ts[order]) != 0]))
                total[ts[order][cut]] += np.add.reduceat(y[piece[order]], cut, axis=0)
            if seen:
                yield total * idf_[:, None]

        return _sums(parts(), w.shape[1])

    g = _gathered(docs.select("words").mapInArrow(emptied(multiply), "term long, v array<double>"), rank + extra)
    w = sketch.astype(np.float64)
    # Nystroem form of the symmetric A'A from its product with W
    core = w.T @ g
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    keep = values > 1e-9 * max(values.max(), 1e-30)
    half = g @ vectors[:, keep] / np.sqrt(values[keep])
    u, s, _ = np.linalg.svd(half, full_matrices=False)
    u, s = u[:, :rank], np.maximum(s[:rank], 1e-12)
    return (u / s).astype(np.float32)


def common_subsequence(a: list, b: list) -> int:
    """Length of the longest common subsequence of two lists of words, bit-parallel."""
    places: dict = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    row = (1 << len(a)) - 1
    full = row
    for w in b:
        hit = row & places.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", answer_col: str | None = None, cosine: float = COSINE, common: float = COMMON, part_bytes: int = PART_BYTES) -> DataFrame:
    """(doc_id, item_id, common_words, item_words, similarity): documents that hold an item or a paraphrase of it.

    ``similarity`` is the share of the item's words in the longest common subsequence with the stretch of the document
    around a candidate passage. With ``answer_col`` a pair also needs the words of a non-null, non-empty answer in the
    document. Items without a word and documents with null or empty text match nothing; a null doc_id or item_id is
    returned as it is. The benchmark is a query set: parts of at most about ``part_bytes`` are read by every task, one
    after the other. Repeated rows of a document give repeated pairs only as often as the document comes.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    answer = (F.col(answer_col) if answer_col else F.lit(None)).cast("binary")
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text).cast("binary").alias("text"), answer.alias("answer")).where("text is not null").distinct()
    size = items.agg(F.sum(F.length("text") + F.coalesce(F.length("answer"), F.lit(0)))).first()[0] or 0
    schema = "doc_id long, item_id long, common_words long, item_words long, similarity double"
    if not size:
        return spark.createDataFrame([], schema)
    rows = materialise(rows.mapInArrow(emptied(_numbered), "doc_id long, words binary"), "words")
    idf = inverse_frequencies(rows)
    basis = (idf[:, None] * randomised_svd(rows, idf)).astype(np.float32)
    out, parts = None, -(-size // part_bytes)
    for part in range(parts):
        some = items.where(F.pmod(F.xxhash64("item", "text", "answer"), F.lit(parts)) == part).collect()
        query = [(r[0], w, numbers(r[2]).tolist()) for r in some if len(w := numbers(r[1]))]
        if query:
            found = rows.mapInArrow(emptied(_search(spark.sparkContext.broadcast((basis, query)), cosine, common)), schema)
            out = found if out is None else out.union(found)
    return spark.createDataFrame([], schema) if out is None else out


def _search(box, cosine: float, common: float):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        basis, items = box.value
        q, owner, _ = _passages([_terms(ws) for _, ws, _ in items], basis)
        every = Items([ws for _, ws, _ in items], common)
        for batch in batches:
            out, ids, column = [], batch.column("doc_id").to_pylist(), batch.column("words")
            for begin in range(0, len(ids), 64):
                some = [(k, np.frombuffer(x, np.uint32)) for k, x in enumerate(column.slice(begin, 64).to_pylist(), begin) if x]
                if not some:
                    continue
                rows, doc, first = _passages([_terms(ws) for _, ws in some], basis)
                enough = [every.candidates(ws) for _, ws in some]  # no other pair has enough words in common
                near: dict[tuple[int, int], set[int]] = {(d, item): {-1} for d, found in enumerate(enough) for item in found}  # anywhere
                for c, r in _close(rows, q, cosine):
                    for d, item, place in zip(doc[r].tolist(), owner[c].tolist(), first[r].tolist()):
                        if (d, item) in near:
                            near[d, item].add(place)
                for (d, item), places in near.items():
                    (ident, iw, answer), (k, numbers_) = items[item], some[d]
                    ws = numbers_.tolist()
                    if answer and not _has(ws, answer):
                        continue
                    best = max(_common_anywhere(iw, numbers_, common) if p < 0 else _common_near(iw.tolist(), ws, p, common) for p in places)
                    if best >= common * len(iw):
                        out.append((ids[k], ident, best, len(iw), best / len(iw)))
            columns = list(zip(*out)) or [()] * 5
            kinds = [pa.int64()] * 4 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "item_id", "common_words", "item_words", "similarity"])

    return search


def _close(rows: np.ndarray, q: np.ndarray, cosine: float, cells: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, row) numbers of all pairs of unit rows within the cosine, from products of at most ``cells`` cells."""
    for a in range(0, len(q), 4096):
        part = q[a : a + 4096]
        step = max(1, cells // len(part))
        for k in range(0, len(rows), step):
            hits = np.flatnonzero((part @ rows[k : k + step].T >= cosine).ravel())
            wide = min(step, len(rows) - k)
            yield a + hits // wide, k + hits % wide


class Items:
    """The words of all items, numbered, to find the items of which a stretch of words holds enough."""

    def __init__(self, items: list[np.ndarray], common: float, block: int = 1024):
        self.sizes = np.array([len(w) for w in items])
        self.vocabulary, self.at = np.unique(np.concatenate(items), return_inverse=True)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.least, self.block, self.over = common * self.sizes, block, int((self.sizes + self.sizes // 4).max())

    def candidates(self, ws: np.ndarray) -> list[int]:
        """Items whose words, counted as often as they come, are present to the least share within a block; blocks overlap by the longest stretch."""
        hit = np.zeros(len(self.sizes), bool)
        for a in range(0, max(1, len(ws) - self.over), self.block):
            part = ws[a : a + self.block + self.over]
            place = np.minimum(np.searchsorted(self.vocabulary, part), len(self.vocabulary) - 1)
            present = np.zeros(len(self.vocabulary), np.int8)
            present[place[self.vocabulary[place] == part]] = 1
            hit |= np.add.reduceat(present[self.at], self.starts, dtype=np.int64) >= self.least
        return np.flatnonzero(hit).tolist()


def _common_anywhere(item: np.ndarray, ws: np.ndarray, common: float) -> int:
    """Longest common subsequence of the item with any stretch of 1.25 times its length that has enough of its words; starts a quarter of it apart."""
    n = len(item)
    count = np.concatenate([[0], np.cumsum(np.isin(ws, item))])
    begin = np.arange(0, len(ws), max(1, n // 4))
    held = count[np.minimum(begin + n + n // 4, len(ws))] - count[begin]
    words_ = item.tolist()
    return max((common_subsequence(words_, ws[a : a + n + n // 4].tolist()) for a in begin[held >= common * n].tolist()), default=0)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _has(ws: list[int], answer: list[int]) -> bool:
    n = len(answer)
    return any(ws[i : i + n] == answer for i in range(len(ws) - n + 1))


def _common_near(item: list[int], ws: list[int], place: int, common: float) -> int:
    """Longest common subsequence of the item with any stretch of 1.25 times its length around a candidate passage.

    Words that the neighbourhood lacks can't be in it, so most candidates end with the first test.
    """
    n = len(item)
    around = set(ws[max(0, place - n) : place + PASSAGE + n])
    if sum(w in around for w in item) < common * n:
        return 0
    return max(common_subsequence(item, ws[a : a + n + n // 4]) for a in range(max(0, place - n), place + PASSAGE, max(1, n // 4)))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` without the documents that hold an item; rows with a null id are judged by no id and stay."""
    hits = contaminated(docs, benchmark, id_col, text_col, **how).select("doc_id").where("doc_id is not null").distinct()
    return docs.join(hits, docs[id_col] == hits["doc_id"], "left_anti")
