"""Sections, chunks, phrases, keyword tables, refreshed snapshots and patient rows against plain Python, with odd rows."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import notes, text
from tidemark.operators import keywords, pooling
from tidemark.sources import tables


def test_sections(spark):
    note = "Admission Date:\n2020\nSex: F\nHistory of Present Illness:\nCame in. Left later.\nstill ill\n\nnew paragraph ----- after\nMeds:\n1. one\ncontinued\n2. two\nDisp:\nDisp: 3\nThis is not: a Title\n(Odd) Title (of things):\n"
    rows = [(1, note), (2, None), (3, "  \n\n "), (4, "___"), (5, "x")]
    got = {}
    for r in notes.sections(spark.createDataFrame(rows, "id int, t string"), "t").collect():
        got.setdefault(r.id, []).append((r.section_index, r.kind, r.section))
    assert got == {
        1: [
            (0, "answer", "Admission Date:\n2020"), (1, "inline", "Sex: F"), (2, "title", "History of Present Illness:"), (3, "text", "Came in. Left later.\nstill ill"), (4, "text", "new paragraph"), (5, "rule", "-----"),
            (6, "text", "after"), (7, "title", "Meds:"), (8, "item", "1. one\ncontinued"), (9, "item", "2. two\nDisp:\nDisp: 3\nThis is not: a Title"), (10, "title", "(Odd) Title (of things):"),
        ],
        4: [(0, "rule", "___")], 5: [(0, "text", "x")],
    }
    cut = notes.sentences(spark.createDataFrame(rows, "id int, t string"), "t").where("id = 1 and section_index = 3").orderBy("part_index").collect()
    assert [r.sentence for r in cut] == ["Came in.", "Left later.\nstill ill"]


def packed(body, size, overlap, seps=("\n\n", "\n", " ")):
    def pieces(x, left):
        if len(x.split()) <= size:
            return [x]
        return [p for part in x.split(left[0]) for p in pieces(part, left[1:])] if left else x.split()

    out, now, n = [], "", 0
    for p in pieces(body, list(seps)):
        k = len(p.split())
        if not k:
            continue
        if n and n + k > size:
            out.append(now)
            tail = now.split()[-overlap:] if overlap else []
            now, n = (" ".join(tail), len(tail)) if len(tail) + k <= size else ("", 0)
        now, n = f"{now} {p.strip()}" if now else p.strip(), n + k
    return [*out, now] if n else out


@pytest.mark.parametrize("size,overlap", [(5, 2), (7, 0), (3, 3), (200, 20)])
def test_separator_chunks(spark, size, overlap):
    rng = np.random.default_rng(size)
    texts = ["".join(str(rng.choice(["w", "ab", " ", " ", "\n", "\n\n", ".", "\t"])) for _ in range(rng.integers(1, 400))) for _ in range(40)] + [None, "", " \n ", "one", "w " * 3000]
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {}
    for r in text.split_chunks(frame, "t", size, overlap).collect():
        got.setdefault(r.id, {})[r.chunk_index] = r.chunk
    for i, t in enumerate(texts):
        assert [got.get(i, {})[k] for k in sorted(got.get(i, {}))] == packed(t or "", size, overlap)
    assert "Python" not in text.split_chunks(frame, "t")._jdf.queryExecution().toString()


def test_phrases(spark):
    words = "The chest pain, a (Chest  pain) and chestpain; chest painful chest pain".split(" ")
    frame = spark.createDataFrame([(1, " ".join(words)), (2, None), (3, "")], "id int, t string")
    assert [r.hit for r in text.keyword_in_context(frame, "t", "chest pain", 1).orderBy("hit").collect()] == [1, 4, 10]
    assert text.keyword_in_context(frame, "t", "chest pain", 1).orderBy("hit").first().context == "The chest pain, a"
    got = [(r.start, r.end, r.found, r.context) for r in text.phrases_in_context(frame, "t", ["painful", "chest pain"], 1).orderBy("start").collect()]
    assert got == [(0, 7, ["chest pain"], "The chest pain, a (Chest pain) and"), (8, 12, ["painful", "chest pain"], "chest painful chest pain")]


@pytest.mark.parametrize("mode", ["word", "substring"])
def test_keyword_table(spark, mode):
    """Equal to a search for each keyword; ten thousand keywords change the tables, not the plan."""
    rng = np.random.default_rng(5)
    words = ["pain", "chest", "éa", "x1", "of_", "+ve", "a", "İ", "no"]
    make = lambda: "".join(str(rng.choice(words)) + str(rng.choice([" ", "  ", ", ", "-", ".", ""])) for _ in range(rng.integers(0, 9)))
    texts = [make() for _ in range(150)] + [None, "", "PAIN", "pain", "pain"]
    keys = sorted({make().strip() for _ in range(60)} | {"pain", "Pain", "chest pain", "+ve", "a", "éa", "x1 pain", "-"})
    frame = spark.createDataFrame([(i if i % 9 else None, t, "k", 1) for i, t in enumerate(texts)], "id int, t string, keyword string, gram int")
    dim = spark.createDataFrame([(k,) for k in [*keys, *keys[:5], None, " "]], "keyword string")
    got = sorted(((r.t, r.found) for r in keywords.keyword_table_hits(frame, "t", dim, "keyword", mode).collect()), key=repr)
    able = [k for k in keys if k.strip() and (mode == "substring" or re.search(r"\w", k))]
    want = frame.select("t", F.array_sort(text.keywords(F.col("t"), able, mode)).alias("found")).collect()
    assert got == sorted(((r.t, r.found) for r in want), key=repr)
    few, many = (keywords.keyword_table_hits(frame, "t", spark.range(n).select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("keyword")), "keyword", mode)._jdf.queryExecution().optimizedPlan().toString() for n in (10, 10_000))
    assert len(few.splitlines()) == len(many.splitlines())
    assert keywords.keyword_table_hits(frame, "t", dim.where("false"), "keyword", mode).where("size(found) > 0").count() == 0
    assert keywords.keyword_table_hits(frame.where("false"), "t", dim, "keyword", mode).count() == 0


def test_refreshed(spark):
    rows = [(1, 1, "a", "old", 1, "x"), (1, 1, "b", "keep", 2, "x"), (2, 1, "b", "late", 2, "y"), (2, 2, "a", None, 3, "z"), (1, 3, "age", None, None, None), (1, None, "b", "nobody", 1, "n"), (2, 2, "free", "as is", 0, "z")]
    snapshots = spark.createDataFrame(rows, "priority int, id int, feature string, value string, version int, more string")
    versions = spark.createDataFrame([("a", 2), ("b", 2), ("c", 1)], "feature string, version int")
    asked = []

    def recompute(todo):
        asked.append(sorted(((r.id, r.feature) for r in todo.collect()), key=str))
        return todo.where("feature <> 'c'").select("id", "feature", F.concat(F.lit("new "), "feature").alias("value"))

    ages = spark.createDataFrame([(1, "50"), (3, "60"), (3, "60"), (7, "70")], "id int, value string")
    out = tables.refreshed(snapshots, versions, "id", "feature", "priority", "version", "value", recompute, ages)
    got = sorted(((r.id, r.feature, r.value, r.version, r.more) for r in out.collect()), key=str)
    assert got == sorted([
        (1, "a", "new a", 2, None), (1, "b", "keep", 2, "x"), (1, "c", None, 1, None), (1, "age", "50", None, None), (2, "a", None, 3, "z"), (2, "free", "as is", 0, "z"), (2, "b", "new b", 2, None), (2, "c", None, 1, None),
        (3, "age", "60", None, None), (3, "a", "new a", 2, None), (3, "b", "new b", 2, None), (3, "c", None, 1, None), (None, "a", "new a", 2, None), (None, "b", "new b", 2, None), (None, "c", None, 1, None),
    ], key=str)
    assert out.columns == ["id", "feature", "value", "version", "more"] and (1, "b") not in asked[0] and (1, "a") in asked[0]
    again = tables.refreshed(out.withColumn("priority", F.lit(0)), versions, "id", "feature", "priority", "version", "value", recompute, ages)
    assert sorted(((r.id, r.feature, r.value, r.version, r.more) for r in again.collect()), key=str) == got and asked[1] == []


def test_patient_row(spark):
    rows = [(1, "a", "Yes", 1), (1, "b", "3", 2), (1, "b", "3", 3), (1, "odd", "p", 4), (1, "odd", "q", 5), (1, "odd", "p", 6), (2, "other", "x", 7), (None, "b", "12", 8), (3, None, "z", 9), (3, "a", None, 10)]
    long = spark.createDataFrame(rows, "id int, feature string, value string, pos int")
    registry = [{"feature": "a", "rule": "any", "default": "none"}, {"feature": "b", "rule": "duration"}, {"feature": "odd", "rule": "twice", "default": "0"}]
    twice = lambda pdf: ",".join(pdf[pdf["n"] > 1]["value"]) or None
    got = {r.id: tuple(r)[1:] for r in pooling.patient_row(long, "id", "feature", "value", "pos", registry, {"twice": twice}).collect()}
    assert got == {1: ("true", "3", "p"), 2: ("none", None, "0"), None: ("none", "12", "0"), 3: ("false", None, "0")}
    with pytest.raises(ValueError, match="twice"):
        pooling.patient_row(long, "id", "feature", "value", "pos", registry)
