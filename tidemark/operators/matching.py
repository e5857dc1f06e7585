"""Pairs of cases and controls on a line: most pairs within a caliper, then least total distance, as a stream over sorted people.

Walk along the sorted people, up one level at a case and down one at a control. A best set of pairs needs no crossings, and whoever is
passed over is passed over where nobody waits for a partner. So it consists of stretches between two neighbouring visits of the same level;
within a stretch everybody is paired, the n-th case with the n-th control, and its distance is the difference of two running
sums. Choosing stretches that don't overlap takes one step a person. A stretch dies when its next pair is further apart than the
caliper: levels die from the outside, so the living ones are an interval around the present level.

A pass in rising order notes for each person the stretch that ends there, if it is worth it; a pass in falling order follows the
notes. Either holds the living levels and the people of one caliper at most, however many people share a key.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.tables import written


class Line:
    """The walk over one key's people in rising order."""

    def __init__(self, caliper: float):
        self.caliper, self.at, self.level, self.low, self.high = caliper, 0, 0, 0, 0
        self.met, self.gone, self.near = [0, 0], [0, 0], (deque(), deque())  # by arm: people so far, those beyond the caliper, the others' numbers
        self.sum, self.pairs, self.distance = 0.0, 0, 0.0
        self.last = {0: (0, 0, 0.0, 0.0)}  # by living level: place of the last visit, best pairs and distance up to it, running sum

    def push(self, number: float, arm: int) -> tuple[int, int, int]:
        """(rank within the arm, level reached, place where a stretch worth taking began or -1)."""
        self.at += 1
        self.met[arm] += 1
        for k in (0, 1):
            while self.near[k] and number - self.near[k][0] > self.caliper:
                self.near[k].popleft()
                self.gone[k] += 1
        self.near[arm].append(number)
        rank = self.met[arm]
        if arm:
            self.sum -= number
            self.level += 1
            for dead in range(max(rank - self.gone[0], self.low), self.high + 1):
                del self.last[dead]
            self.high = min(self.high, rank - self.gone[0] - 1)
        else:
            self.sum += number
            self.level -= 1
            for dead in range(self.low, min(self.gone[1] - rank, self.high) + 1):
                del self.last[dead]
            self.low = max(self.low, self.gone[1] - rank + 1)
        begun = self.last.get(self.level)
        self.low, self.high = min(self.low, self.level), max(self.high, self.level)
        start = -1
        if begun:
            pairs, distance = begun[1] + (self.at - begun[0]) // 2, begun[2] + abs(self.sum - begun[3])
            if pairs > self.pairs or pairs == self.pairs and distance < self.distance - 1e-9:
                self.pairs, self.distance, start = pairs, distance, begun[0]
        self.last[self.level] = (self.at, self.pairs, self.distance, self.sum)
        return rank, self.level, start


class Way:
    """The notes of one key followed in falling order."""

    def __init__(self):
        self.stop = self.level = None

    def push(self, at: int, level: int, start: int) -> int | None:
        """The level of the stretch that a person is in, or None for one who stays alone."""
        if self.stop is not None and at > self.stop:
            return self.level
        if start < 0:
            self.stop = None
            return None
        self.stop, self.level = start, level
        return level


def _noted(caliper: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, line = None, None
        for frame in frames:
            out = []
            for k, number, arm in zip(frame["key"].tolist(), frame["number"].tolist(), frame["arm"].tolist()):
                if line is None or k != key:
                    key, line = k, Line(caliper)
                out.append((*line.push(number, arm), line.at))
            rank, level, start, at = zip(*out) if out else ((), (), (), ())
            yield pd.DataFrame({"key": frame["key"], "id": frame["id"], "arm": frame["arm"], "rank": pd.Series(rank, dtype="int64"), "level": pd.Series(level, dtype="int64"), "start": pd.Series(start, dtype="int64"), "at": pd.Series(at, dtype="int64")})

    return run


def _followed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    key, way = None, None
    for frame in frames:
        out = []
        for k, at, level, start in zip(*(frame[c].tolist() for c in ("key", "at", "level", "start"))):
            if way is None or k != key:
                key, way = k, Way()
            out.append(way.push(at, level, start))
        taken = pd.Series(out, dtype="Int64")
        kept = frame[taken.notna()]
        # the n-th case of a stretch that began at this level has the n-th control: ranks differ by the level
        yield pd.DataFrame({"key": kept["key"], "id": kept["id"], "arm": kept["arm"], "place": kept["rank"] - kept["arm"] * taken[taken.notna()].astype("int64")})


def nearest_pairs(people: DataFrame, key: str, arm: str, exact: Sequence[str], number: str, caliper: float) -> DataFrame:
    """(case, control): equal ``exact`` columns, numbers within the caliper, each person at most once, most pairs and then least distance.

    People without a key, an arm of 0 or 1, an exact value or a finite number are left out. Equal numbers are taken in the order of
    keys. The people of one exact value are one sorted stream, which Spark sorts on disk; a task holds none of it but a caliper's width.
    """
    kind = dict(people.dtypes)[key]
    known = people.where(F.col(key).isNotNull() & F.col(arm).isin(0, 1) & (F.abs(F.col(number).cast("double")) < float("inf")))
    for c in exact:
        known = known.where(F.col(c).isNotNull())
    rows = known.select(F.to_json(F.struct(*[F.col(c).alias(f"e{i}") for i, c in enumerate(exact)])).alias("key") if exact else F.lit("").alias("key"), F.col(number).cast("double").alias("number"), F.col(key).alias("id"), F.col(arm).cast("int").alias("arm"))
    both = rows.groupBy("key").agg(F.max("arm").alias("_high"), F.min("arm").alias("_low")).where("_high > _low").select("key")
    lines = rows.join(both, "key", "left_semi").repartition("key").sortWithinPartitions("key", "number", "id")
    noted = written(lines.mapInPandas(_noted(caliper), f"key string, id {kind}, arm int, rank long, level long, start long, at long"), "lines")
    found = noted.repartition("key").sortWithinPartitions("key", F.desc("at")).mapInPandas(_followed, f"key string, id {kind}, arm int, place long")
    found = written(found, "paired")
    side = lambda k, name: found.where(F.col("arm") == k).select("key", "place", F.col("id").alias(name))
    return side(1, "case").join(side(0, "control"), ["key", "place"]).select("case", "control")
