"""Hierarchical language identification: the family first, then linear SVMs within it.

Features are counts of hashed byte 1- to 3-grams of the letters of a text, lower-cased, as square roots scaled to
length one. One multi-class level picks the language family by one-versus-rest linear support
vector machines; within the family one machine for each pair of languages votes for one of them. The
machines are trained here, by a deterministic sub-gradient method on a bounded sample of labelled
rows; the sample is picked by the hash of the text, and prediction reads every row whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import emptied, free_name

#: Language codes by family. A language that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
}
#: Hashed features, labelled rows that training reads at most (more where 20 of each language are more).
BINS, TRAIN_ROWS = 1 << 13, 3000
_LETTER = regex.compile(r"\p{L}")
_KEEP = np.zeros(256, np.uint8)  # ASCII letters lowered, bytes of other characters as they are, all else 0
_KEEP[128:] = np.arange(128, 256)
for _b in range(26):
    _KEEP[65 + _b] = _KEEP[97 + _b] = 97 + _b


def features(text: bytes) -> np.ndarray:
    """The feature vector of a text's bytes; all zeros where nothing is left of it."""
    counts = np.zeros(BINS, np.float32)
    for at in range(0, len(text), 1 << 20):  # bounded memory for very long texts
        b = _KEEP[np.frombuffer(text[at : at + (1 << 20)], np.uint8)].astype(np.int32)  # strings over a cut are left out
        if len(b) > 1:  # one gap for a run of other characters
            b = b[np.concatenate([[True], (b[1:] != 0) | (b[:-1] != 0)])]
        pairs = b[:-1] * 251 + b[1:] * 7919
        triples = pairs[:-1] * 31 + b[2:] * 104729
        for h in (b * 40503 >> 3, pairs, triples):
            counts += np.bincount(h & (BINS - 1), minlength=BINS)
    counts = np.sqrt(counts)
    norm = np.linalg.norm(counts)
    return counts / norm if norm else counts


@dataclass
class Machines:
    """One-versus-rest linear machines: weights (classes x bins), intercepts, class names."""

    names: list[str]
    weights: np.ndarray
    bias: np.ndarray

    def margins(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights.T + self.bias


def train_machines(x: np.ndarray, y: list[str], rounds: int = 60, rate: float = 4.0, penalty: float = 1e-4) -> Machines:
    """Squared-hinge one-versus-rest machines by full-batch gradient steps with momentum."""
    names = sorted(set(y))
    signs = np.where(np.array(y)[:, None] == np.array(names)[None, :], 1.0, -1.0).astype(np.float32)
    share = np.maximum((signs > 0).mean(0), 1e-6)
    weight = np.where(signs > 0, 0.5 / share, 0.5 / np.maximum(1 - share, 1e-6)).astype(np.float32)
    w, b = np.zeros((len(names), x.shape[1]), np.float32), np.zeros(len(names), np.float32)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(rounds if len(names) > 1 else 0):
        slack = np.maximum(0, 1 - signs * (x @ w.T + b)) * signs * weight
        vw = 0.8 * vw + rate / 8 * (slack.T @ x / len(x) - penalty * w)
        vb = 0.8 * vb + rate / 8 * slack.mean(0)
        w, b = w + vw, b + vb
    if len(names) == 1:
        b += 1
    return Machines(names, w, b)


@dataclass
class PairMachines:
    """One-versus-one linear machines of the languages of a family: (first, second) by index, weights (pairs x bins), intercepts, names."""

    names: list[str]
    pairs: list[tuple[int, int]]
    weights: np.ndarray
    bias: np.ndarray

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Share of the pairs that a language wins, plus its mean margin in them (at most one, so it parts equal votes and grades the score)."""
        out = np.zeros((len(x), len(self.names)), np.float32)
        if not self.pairs:
            return out + 1
        pair = np.clip(x @ self.weights.T + self.bias, -1, 1)
        for k, (a, b) in enumerate(self.pairs):
            won = np.where(pair[:, k] >= 0, 1.0, -1.0)
            out[:, a] += won + pair[:, k] / len(self.pairs)
            out[:, b] -= won + pair[:, k] / len(self.pairs)
        return out / (len(self.names) - 1)


def train_pairs(x: np.ndarray, y: list[str]) -> PairMachines:
    """A machine for each pair of languages, on the rows of these two only."""
    names = sorted(set(y))
    of, pairs = np.array(y), list(combinations(range(len(names)), 2))
    weights, bias = np.zeros((len(pairs), x.shape[1]), np.float32), np.zeros(len(pairs), np.float32)
    for k, (a, b) in enumerate(pairs):
        pick = np.flatnonzero((of == names[a]) | (of == names[b]))
        both = train_machines(x[pick], of[pick].tolist())  # names in order: the first is a
        weights[k], bias[k] = (both.weights[0] - both.weights[1]) / 2, (both.bias[0] - both.bias[1]) / 2
    return PairMachines(names, pairs, weights, bias)


@dataclass
class LanguageModel:
    """Machines over families and, for each family with several languages, machines within it."""

    families: Machines
    within: dict[str, PairMachines]

    def predict(self, texts: list[bytes | None]) -> list[tuple[str, float]]:
        """(language, score between 0 and 1); ``und`` and 0 for a null text or one without a letter."""
        out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        use = [i for i, t in enumerate(texts) if t and _LETTER.search(t.decode("utf-8", "replace"))]
        for at in range(0, len(use), 256):
            rows = use[at : at + 256]
            x = np.stack([features(texts[i]) for i in rows])
            top, share = _best(self.families.margins(x))
            inner = {f: _best(m.margins(x)) for f, m in self.within.items()}
            for k, i in enumerate(rows):
                family = self.families.names[top[k]]
                best, part = inner[family]
                out[i] = (self.within[family].names[best[k]], float(share[k] * part[k]))
        return out


def _best(margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the largest margin (the first of equals) and its share in a softmax of the margins."""
    top = margins.argmax(axis=1)
    e = np.exp(3 * (margins - margins.max(axis=1, keepdims=True)))
    return top, (e / e.sum(axis=1, keepdims=True))[np.arange(len(top)), top]


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The features of each row that aren't zero: their places (two bytes each), then their values."""
    for batch in batches:
        found = [features(x) for x in batch.column("text").to_pylist()]
        places = [np.flatnonzero(x).astype(np.uint16) for x in found]
        packed = [at.tobytes() + x[at].tobytes() for at, x in zip(places, found)]
        yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("h"), pa.array(packed, pa.binary())], ["lang", "h", "x"])


def _sample(usable: DataFrame, each: int, counts: DataFrame) -> DataFrame:
    """At most ``each`` rows of each language, those of smallest hash; equal texts with equal labels count once.

    Rows beyond the hash that half as many again would need leave where they are read, so one pass serves all languages.
    ``counts`` has a row for each language, which the driver has held already, so it is broadcast.
    """
    share = F.least(F.lit(1.0), (F.lit(1.5 * each + 30)) / F.greatest(F.col("n"), F.lit(1)))
    near = usable.join(F.broadcast(counts.withColumn("share", share)), "lang").where((F.col("h") / F.lit(float(1 << 64)) + F.lit(0.5)) <= F.col("share"))
    once = near.select("lang", "h", "text").dropDuplicates(["lang", "h"])
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    return once.withColumn("place", place).where(F.col("place") <= each).select("lang", "h", "text")


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", rows: int = TRAIN_ROWS, families: dict = FAMILIES) -> LanguageModel | None:
    """Fit on at most ``rows`` rows with text and language, an even share for each language; None without any row.

    Equal texts with equal labels count once, so that copies don't crowd the sample.
    """
    usable = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    usable = usable.select(F.col(lang_col).alias("lang"), F.xxhash64(text_col).alias("h"), F.col(text_col).cast("binary").alias("text"))
    counted = usable.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()  # one row a language
    if not counted:
        return None
    each = max(20, rows // len(counted))
    counts = labelled.sparkSession.createDataFrame([(r["lang"], r["n"]) for r in counted], "lang string, n long")
    # whole texts become features before they reach the driver, six bytes for each that isn't zero
    got = sorted(_sample(usable, each, counts).mapInArrow(emptied(_feature_rows), "lang string, h long, x binary").collect(), key=lambda r: (r["lang"], r["h"]))
    x, y = np.zeros((len(got), BINS), np.float32), [r["lang"] for r in got]
    for k, r in enumerate(got):
        n = len(r["x"]) // 6
        x[k, np.frombuffer(r["x"], np.uint16, n)] = np.frombuffer(r["x"][2 * n :], np.float32)
    del got
    family = {lang: name for name, members in families.items() for lang in members}
    of = [family.get(lang, lang) for lang in y]
    within = {}
    for name in sorted(set(of)):
        pick = [i for i, f in enumerate(of) if f == name]
        within[name] = train_pairs(x[pick], [y[i] for i in pick])
    return LanguageModel(train_machines(x, of), within)


def predict(docs: DataFrame, model: LanguageModel | None, text_col: str = "text", out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with the two columns of a prediction added, in place of columns of these names; without a model every text is ``und``."""

    body = free_name(docs, "text")
    schema = StructType([StructField(out[0], StringType()), StructField(out[1], DoubleType())])
    box = docs.sparkSession.sparkContext.broadcast(model)  # bins x languages, at most a few MB

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(body).to_pylist()
            pairs = box.value.predict(texts) if box.value else [("und", 0.0)] * len(texts)
            columns = [batch.column(n) for n in batch.schema.names if n != body]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.float64())], [*(n for n in batch.schema.names if n != body), *out])

    kept = [c for c in docs.columns if c not in out]
    wide = docs.select(*kept).withColumn(body, F.col(text_col).cast("binary"))
    full = StructType([f for f in docs.schema.fields if f.name in kept] + schema.fields)
    return wide.mapInArrow(emptied(apply), full)


def held_out(id_col: str = "doc_id"):
    """True where crc32 of the id's text leaves 0 modulo 5 (a null id: false)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = TRAIN_ROWS) -> DataFrame:
    """(id, held_out, lang_pred, score) of every row; learns from rows that aren't held out only.

    Repeated rows and null ids keep a row each; an empty table has no model and no row.
    """
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    model = train(known.where(~held_out("id") & F.col("id").isNotNull()), rows=rows)
    out = predict(known.select("id", "text", held_out("id").alias("held_out")), model)
    return out.select(F.col("id").alias(id_col), "held_out", "lang_pred", "score")
