"""Quality by compression: how much smaller a text gets with a dictionary of good texts than with one of bad texts.

Two Zstandard dictionaries of equal size are trained on pieces of good and of bad labelled texts. A text is compressed piece by
piece with each, so that the dictionary and not the text's own past decides; the difference of the two sizes by the
bytes of the text is its margin, drawn to the labelled texts' mean margin where a text has few bytes. Labelled texts
that no dictionary has seen turn margins into probabilities by a logistic curve.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows of each class that training reads, pieces of each class that a dictionary is trained on: both are bounds of the sample.
TRAIN_ROWS, TRAIN_PIECES = 20_000, 4_000
#: Bytes of a piece (texts are compressed so) and of a dictionary.
PIECE, DICTIONARY = 1024, 112 << 10
LEVEL = 3
#: Bytes of a usual text that are counted to each text's own.
PRIOR_BYTES = 32


def pieces(text: bytes) -> list[bytes]:
    return [text[i : i + PIECE] for i in range(0, len(text), PIECE)]


def train_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary; too few samples for training are taken as they are."""
    samples = [x for x in samples if x]
    if len(samples) >= 16 and sum(map(len, samples)) >= 2 * DICTIONARY:
        try:
            return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
        except zstandard.ZstdError:  # samples that have nothing in common
            pass
    return b"\n".join(samples)[:DICTIONARY]


@dataclass
class QualityModel:
    """The dictionaries of bad and good texts, the mean margin, and the curve: probability = 1 / (1 + exp(-(slope * margin + offset)))."""

    dictionaries: tuple[bytes, bytes]
    mean: float = 0.0
    slope: float = 0.0
    offset: float = 0.0

    def __post_init__(self) -> None:
        self._tools = None

    def __getstate__(self):
        return self.__dict__ | {"_tools": None}

    def gain(self, text: bytes | None) -> int:
        """Size with the bad dictionary less the size with the good one; 0 for an empty or null text."""
        if not text:
            return 0
        if self._tools is None:
            self._tools = []
            for data in self.dictionaries:
                made = zstandard.ZstdCompressionDict(data) if data else None
                if made:
                    made.precompute_compress(level=LEVEL)
                self._tools.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=made, write_content_size=False, write_dict_id=False))
        bad, good = self._tools
        return sum(len(bad.compress(p)) - len(good.compress(p)) for p in pieces(text))

    def margin(self, gain, size):
        """Of numbers, arrays or columns."""
        return (gain + PRIOR_BYTES * self.mean) / (size + PRIOR_BYTES)


def fit_curve(margin: np.ndarray, good: np.ndarray, bad: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve for weights of good and bad at each margin, by Newton steps.

    The targets are drawn in by one text of each class, so classes that a margin parts have a finite curve too.
    """
    n_good, n_bad = good.sum(), bad.sum()
    if not n_good or not n_bad:
        return 0.0, float(np.log((n_good + 1) / (n_bad + 1)))
    high, low = (n_good + 1) / (n_good + 2), 1 / (n_bad + 2)
    scale = max(float(np.sqrt((margin**2 * (good + bad)).sum() / (good + bad).sum())), 1e-9)
    x = np.stack([margin / scale, np.ones_like(margin)])
    loss = lambda w: float(((good + bad) * np.logaddexp(0, w @ x) - (good * high + bad * low) * (w @ x)).sum())
    w = np.array([0.0, np.log(n_good / n_bad)])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
        gradient = x @ (good * (p - high) + bad * (p - low))
        weight = (good + bad) * p * (1 - p)
        step = np.linalg.solve((x * weight) @ x.T + 1e-9 * np.eye(2), gradient)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for label, text in zip(batch.column("label").to_pylist(), batch.column("text").to_pylist()):
            found = pieces(text)
            for at in range(0, len(found), 256):
                part = found[at : at + 256]
                yield pa.RecordBatch.from_arrays([pa.array([label] * len(part), pa.int32()), pa.array(part, pa.binary())], ["label", "piece"])


def train(labelled: DataFrame, rows: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", bound: int = TRAIN_ROWS) -> QualityModel:
    """Fit on at most ``bound`` labelled ids of each class (of smallest hash), ``rows`` holding their texts.

    ``labelled`` has (id, label 0 or 1); other labels and null ids count for nothing. The picked ids, whose number is bounded,
    are broadcast to the texts. Half the texts, by a hash of the text so that copies stay together, go to the dictionaries (at most
    ``TRAIN_PIECES`` pieces a class, of smallest hash), the others to the curve, one for each id. Without a label of a class its dictionary is empty
    and the curve is flat.
    """
    known = labelled.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"), F.xxhash64(id_col).alias("h"))
    picked = [known.where(F.col("label") == k).orderBy("h", "id").limit(bound) for k in (0, 1)]
    ids = F.broadcast(picked[0].union(picked[1]).select("id", "label"))
    texts = rows.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text")).join(ids, "id")
    half = F.crc32("text") % 2
    cut = texts.where(half == 0).mapInArrow(_cut, "label int, piece binary").withColumn("h", F.xxhash64("piece", F.lit(1)))
    samples = [[bytes(r["piece"]) for r in cut.where(F.col("label") == k).dropDuplicates(["h"]).orderBy("h").limit(TRAIN_PIECES).collect()] for k in (0, 1)]
    model = QualityModel((train_dictionary(samples[0]), train_dictionary(samples[1])))
    seen = texts.where(half == 1).select("id", "label", gains(model)("text").alias("gain"), F.octet_length("text").alias("size"))
    one = seen.groupBy("id", "label").agg(F.min(F.struct("gain", "size")).alias("x")).select("label", "x.*").collect()  # a row for each picked id
    at = np.array([[r["gain"], r["size"], r["label"]] for r in one], float).reshape(-1, 3)
    model.mean = float((at[:, 0] / np.maximum(at[:, 1], 1)).mean()) if len(at) else 0.0
    model.slope, model.offset = fit_curve(model.margin(at[:, 0], at[:, 1]), at[:, 2], 1 - at[:, 2])
    return model


def gains(model: QualityModel):
    """A column function: binary texts to gains."""

    @F.pandas_udf("long")
    def gain(text: pd.Series) -> pd.Series:
        return pd.Series([model.gain(x) for x in text], dtype="int64")

    return gain


def predict(docs: DataFrame, model: QualityModel, text_col: str = "text") -> Column:
    """The probability that a text is good, as a column of ``docs``; null and empty texts have the mean margin."""
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    margin = model.margin(gains(model)(text), F.octet_length(text))
    power = F.greatest(F.least(F.lit(model.slope) * margin + F.lit(model.offset), F.lit(30.0)), F.lit(-30.0))
    return 1 / (1 + F.exp(-power))


def held_out(id_col: str = "doc_id") -> Column:
    """True where crc32 of the id's text leaves 2 modulo 4 (a null id: false)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def score_quality(docs: DataFrame, labels: DataFrame, least: float = 0.7, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(id, held_out, score, predicted) of every row; learns from labels whose ids aren't held out only.

    Repeated rows and null ids keep a row each; an id with several labels counts with each; an empty table gives no row.
    """
    model = train(labels.where(~held_out(id_col)), docs, id_col, text_col, label_col)
    scored = docs.select(F.col(id_col).alias(id_col), held_out(id_col).alias("held_out"), predict(docs, model, text_col).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= least).cast("int"))
