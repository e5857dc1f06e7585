"""Sinks read back, the feature registry, and the cohort and case jobs as a whole."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import exposure, features, quality, scoring
from tidemark.plans import jobs
from tidemark.plans.code_sets import code_set_rows
from tidemark.sources import exports, records, tables


def test_records_round_trip(spark, tmp_path):
    rows = [("p1", "x", datetime(2020, 1, 2, 3, 4, 5), "Yes"), ("p2", "y", None, None), ("p1", "z", None, "No")]
    df = spark.createDataFrame(rows, "entity_id string, feature_name string, date timestamp, prediction string")
    exports.write_records(df, f"file://{tmp_path}/r", "entity_id", 4)
    back = exports.read_records(spark, f"file://{tmp_path}/r", "entity_id string, feature_name string, date string, prediction string")
    got = {(r.entity_id, r.feature_name, r.date, r.prediction) for r in back.collect()}
    assert got == {("p1", "x", "2020-01-02T03:04:05.000000", "Yes"), ("p2", "y", None, None), ("p1", "z", None, "No")}


def test_cohort_and_runs(spark, tmp_path):
    members = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "id int, arm int")
    exports.write_cohort(f"file://{tmp_path}/c", members, spark.createDataFrame([(1, 3)], "case int, control int"), "id", "arm", "case", "control")
    stats = spark.read.parquet(f"file://{tmp_path}/c/match_stats").first()
    assert (stats.cases, stats.controls, stats.pairs, stats.matched_share) == (1, 2, 1, 1.0)
    assert {(r.id, r.role) for r in spark.read.parquet(f"file://{tmp_path}/c/members").collect()} == {(1, "case"), (2, "control"), (3, "control")}
    for at, score in ((1, 0.1), (2, 0.2)):
        exports.append_runs(spark.createDataFrame([("m", at, score)], "optimizer string, at int, score double"), f"file://{tmp_path}/runs")
    assert tables.latest_runs(spark.read.json(f"file://{tmp_path}/runs"), ["optimizer"], "at").first()["score"] == 0.2


def test_wide_strings_and_dictionary(spark, tmp_path):
    (tmp_path / "wide.csv").write_text('id,cancer_outcome__a,cancer_outcome__b\n007,Yes,\n008,"x\ny",No\n')
    wide = exports.read_wide_strings(spark, f"file://{tmp_path}/wide.csv")
    assert {f.dataType.simpleString() for f in wide.schema.fields} == {"string"} and {r.id for r in wide.collect()} == {"007", "008"}
    assert exposure.column_families(wide, {"outcome": "^cancer_outcome__"}) == {"outcome": ["cancer_outcome__a", "cancer_outcome__b"]}
    assert exposure.renamed_by_prefix(wide, "cancer_outcome__").columns == ["id", "a", "b"]
    (tmp_path / "codes.jsonl").write_text('{"code": "A1", "code_type": "ICD10", "description": "d"}\n{"code": "1", "code_type": "ICD9", "description": "e"}\n')
    assert [r.code for r in exports.code_dictionary(spark, f"file://{tmp_path}/codes.jsonl", "ICD9").collect()] == ["1"]
    scored = spark.createDataFrame([(1, 0, "t", [1, 0], [0.5, 0.25])], "doc int, at int, text string, y array<int>, s array<float>")
    exports.write_predictions(scored, f"file://{tmp_path}/p", "doc", "at", "text", "y", "s")
    assert spark.read.parquet(f"file://{tmp_path}/p").first()["scores"] == [0.5, 0.25]


def test_foreign_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("NOTE_ID,Text\n1,caf\xe9\n".encode("latin-1"))
    got = records.notes_csv(spark, f"file://{tmp_path}/a.csv", {"note_id": "id", "text": "body"}, "src", "ISO-8859-1").first()
    assert (got["id"], got["body"], got["source_table"]) == ("1", "café", "src")


def test_registry(spark):
    reg = features.Registry([features.Feature("smoking", "Smokes?", ("smok", "tobacco"), ("A", "B"), ("known_mode", (["A", "B"], ["E"], "F")), "substring"), features.Feature("plain", "Any?")])
    assert reg.keywords(spark).count() == 2 and reg.options(spark).count() == 2
    notes = spark.createDataFrame([("smoker",), ("none",), (None,)], "body string")
    assert notes.where(reg.chunk_filter("smoking", "body")).count() == 1 and notes.where(reg.chunk_filter("plain", "body")).count() == 2
    long = spark.createDataFrame([(1, "smoking", "E", 1), (1, "smoking", "B", 2), (2, "smoking", "E", 1), (3, "smoking", "Z", 1)], "id int, feature_name string, prediction string, pos int")
    from tidemark.operators import pooling

    got = {r.id: r.prediction for r in pooling.pool(long, ["id"], "feature_name", "prediction", "pos", reg.pooling_spec()).collect()}
    assert got == {1: "B", 2: "E", 3: "F"}
    with pytest.raises(ValueError):
        features.Registry([features.Feature("a", ""), features.Feature("a", "")])


def test_null_examples(spark):
    d = spark.createDataFrame([(1, None), (2, "x"), (3, None)], "id int, f string")
    assert [r.id for r in quality.null_examples(d, "f", ["id"], 1).collect()] == [1]
    with pytest.raises(ValueError):
        quality.null_examples(d.where("f is not null"), "f", ["id"], 1)


def test_study_as_a_whole(spark):
    day = datetime(2020, 1, 1)
    facts = [(i, day, "DX") for i in range(40)] + [(i, day + timedelta(days=1), "RX") for i in range(0, 40, 4)] + [(1, day - timedelta(days=9), "RX")]
    facts += [(i, day + timedelta(days=2000), "NOTE") for i in range(39)]
    f = spark.createDataFrame(facts, "id int, at timestamp, kind string")
    people = spark.createDataFrame([(i, 30 + i % 5, "m" if i % 3 else "f") for i in range(40)], "id int, age int, sex string")
    members, pairs, balance = jobs.study(f, f.where("kind = 'RX'"), people, [f.where("kind = 'NOTE'")], "id", "at", F.col("kind") == "DX", 730, 365 * 5, (30, 34), "age", ["sex"])
    got = members.collect()
    assert {r.id for r in got} == {i for i in range(39) if i % 5 < 4 and i != 1} and all(r.arm == (r.id % 4 == 0) for r in got)
    made = pairs.collect()
    assert len({r.case for r in made}) == len(made) == len({r.control for r in made}) == sum(r.arm for r in got)
    assert {(b["round"], b["variable"]) for b in balance.collect()} == {(r, v) for r in {p["round"] for p in made} for v in ("age", "sex")}


def test_structured_cases(spark):
    day = datetime(2020, 1, 1)
    facts = spark.createDataFrame([(1, day + timedelta(days=800), "C34.1"), (1, day + timedelta(days=900), "C34.2"), (2, day + timedelta(days=10), "C34.1"), (3, day + timedelta(days=800), "J10")], "id int, at timestamp, code string")
    index = spark.createDataFrame([(i, day) for i in (1, 2, 3)], "id int, index_date timestamp")
    notes = spark.createDataFrame([(1, 10, day + timedelta(days=790), "stage one"), (1, 11, day + timedelta(days=810), "stage stage two"), (1, 12, day + timedelta(days=1300), "stage stage stage")], "id int, note int, note_date timestamp, body string")
    dim = spark.createDataFrame([("C34", "lung")], "prefix string, label string")
    out = jobs.structured_cases(facts, notes, index, "id", "at", "code", dim, "body", ["stage"], "note", scoring.keyword_scorer("two", "body")).collect()
    assert [(r.id, r.keyword, r.note, r.prediction) for r in out] == [(1, "lung", 11, "Yes")]


def test_code_sets():
    rows = code_set_rows()
    assert len({f for f, _, _ in rows}) == 65 and ("autoimmune_type_1_diabetes", "ICD9", "250.93") in rows and ("comorbid_chronic_skin_inflammation_burns", "ICD10", "T31") in rows
