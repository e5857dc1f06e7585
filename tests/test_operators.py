"""Small hand-made cases with known answers, and brute force for matching and the models."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import dates, rules, text
from tidemark.operators import codes, cohort, evalm, features, history, matching, pooling, quality, ranks, sampling, scoring, stats
from tidemark.plans import jobs
from tidemark.sources import records, tables
from tidemark.streaming import arrivals


def values(df, column):
    return [r[column] for r in df.collect()]


def test_alcohol_text(spark):
    cases = {"5/week 0/4 cage": "A", "done": None, "No.": "B", "social": "A", "low risk": "B", "one drink a week": "A", "cage 0/4": None, "0 drinks": "B", "denies etoh": "B", "3": "A", "Moderate": "A", "": None, "no, occasional wine": "B", None: None}
    df = spark.createDataFrame([(k,) for k in cases], "x string").withColumn("y", rules.alcohol_text(F.col("x")))
    assert dict(df.collect()) == cases


def test_status_rules(spark):
    r = spark.createDataFrame([(1, "User-Yes", ""), (1, "Per Week", "0"), (2, "Per Week", "0.0"), (3, "Other", "x"), (4, "Per Week", "1-2")], "id int, c string, r string")
    got = dict(rules.alcohol_status(r, ["id"], "c", "r", ["User-Yes"], ["User-No"], ["Per Week"]).collect())
    assert got == {1: "A", 2: "B", 3: None, 4: "A"}
    s = spark.createDataFrame([(1, "Never", ""), (1, "status", "Never Smoker"), (2, "Never", ""), (2, "Quit", ""), (3, "status", "current every day smoker")], "id int, c string, r string")
    assert dict(rules.smoking_status(s, ["id"], "c", "r", ["Never"], ["Quit"], ["Pack"], {("status", "never smoker"): "A", ("status", "current every day smoker"): "C"}).collect()) == {1: "A", 2: "B", 3: "C"}
    a = spark.createDataFrame([(1, "d", "1-2"), (1, "d", "bad"), (2, "o", "3.0"), (3, "d", "0"), (4, "d", "7"), (5, "d", "")], "id int, c string, r string")
    assert dict(rules.amount_option(a, ["id"], {"d": 1, "o": 1 / 0.6}, "c", "r").collect()) == {1: "B", 2: "C", 3: "A", 4: "D", 5: None}


def test_text_rules(spark):
    d = spark.createDataFrame([("12 3 99",), ("12/3/99",), ("on May 3rd",), ("3 june",), ("March 2021",), ("nothing",), ("seen 12.12.23",), ("pain 7/10",), ("3 of june",), ("Jan '23",)], "x string")
    assert values(d.select(text.contains_date(F.col("x")).alias("y")), "y") == [False, True, True, True, True, False, True, False, False, True]
    k = spark.createDataFrame([("doxycycline éa",), ("doxy, ÉA",), (None,)], "x string")
    assert values(k.select(text.keywords(F.col("x"), ["doxy", "éa"]).alias("y")), "y") == [["éa"], ["doxy", "éa"], None]
    assert values(k.select(text.keywords(F.col("x"), ["doxy"], "substring").alias("y")), "y") == [["doxy"], ["doxy"], None]
    p = spark.createDataFrame([("<think>1</think> B. yes",), ("it was 20240131 or 01312024",), ("about 14 days",), ("F",)], "x string")
    assert values(p.select(text.parse_answer(F.col("x"), "choice").alias("y")), "y")[0] == "B"
    assert values(p.select(text.parse_answer(F.col("x"), "date").alias("y")), "y")[1] == "01312024"
    assert values(p.select(text.parse_answer(F.col("x"), "number").alias("y")), "y")[2:] == ["14", "F"]
    o = spark.createDataFrame([("A. Yes, B. No, maybe, C. Unknown", "B")], "o string, l string")
    assert values(o.select(text.option_text(F.col("o"), F.col("l")).alias("y")), "y") == ["No, maybe"]


def test_dates(spark):
    d = spark.createDataFrame([("1/2/2020",), ("2020-01-02",), ("2020-01-02 03:04:05",), ("nope",), (None,)], "x string").select(dates.parse_mixed(F.col("x")).alias("y"))
    assert [str(v) if v else None for v in values(d, "y")] == ["2020-01-02 00:00:00", "2020-01-02 00:00:00", "2020-01-02 03:04:05", None, None]


def test_boundary_codes(spark):
    dim = spark.createDataFrame([("20", "cat"), ("35.0", "dot"), ("M35.0", "m")], "code string, label string")
    facts = spark.createDataFrame([("200.5",), ("20.5",), ("20",), ("35.01",), ("M35.01",), ("M35",), (None,)], "c string")
    got = {r.c: r.label for r in codes.boundary_match(facts, dim, "c").collect()}
    assert got == {"200.5": None, "20.5": "cat", "20": "cat", "35.01": "dot", "M35.01": "m", "M35": None, None: None}


def test_pooling(spark):
    r = spark.createDataFrame([(1, "dur", "7", 0), (1, "dur", "7", 1), (1, "dur", "14", 2), (1, "dur", "F", 3), (2, "dur", "F", 4), (3, "dur", "0", 5), (1, "any", "No", 6), (1, "any", "Yes", 7), (1, "stage", "II", 8), (1, "stage", "IV", 9), (1, "stage", "odd", 10), (1, "first", "05032020", 11), (1, "first", "X", 12)], "id int, feature_name string, prediction string, pos int")
    spec = {"dur": ("duration", ()), "any": ("any", ()), "stage": ("ranked", ("I", "II", "III", "IV")), "first": ("earliest", ())}
    got = {(x["id"], x["feature_name"]): x["prediction"] for x in pooling.pool(r, ["id"], "feature_name", "prediction", "pos", spec).collect()}
    assert got == {(1, "dur"): "21", (2, "dur"): "F", (3, "dur"): "0", (1, "any"): "true", (1, "stage"): "IV", (1, "first"): "05032020"}
    wide = jobs.pooled_wide(r, "id", "pos", spec, ["any", "dur"]).where("id = 1").first()
    assert wide["dur"] == "21" and wide["any"] == "true"


def brute_match(a, b, caliper):
    best = (0, 0.0)
    for k in range(min(len(a), len(b)), 0, -1):
        found = [sum(abs(x - y) for x, y in zip(c, p)) for c in itertools.combinations(a, k) for p in itertools.permutations(b, k) if all(abs(x - y) <= caliper for x, y in zip(c, p))]
        if found:
            return k, min(found)
    return best


def walked(a, b, caliper):
    """The pairs (case place, control place) that the two passes give, and the walk."""
    line, way = matching.Line(caliper), matching.Way()
    notes = [(*line.push(x, arm), line.at, arm) for x, arm in sorted([(x, 1) for x in a] + [(x, 0) for x in b])]
    sides = ({}, {})
    for rank, level, start, at, arm in reversed(notes):
        if (of := way.push(at, level, start)) is not None:
            sides[arm][rank - arm * of] = rank - 1
    assert sides[0].keys() == sides[1].keys()
    return sorted((sides[1][k], sides[0][k]) for k in sides[1]), line


def test_matching(spark):
    rng = np.random.default_rng(0)
    for _ in range(60):
        a, b = (sorted(rng.integers(0, 25, rng.integers(0, 5)).tolist()) for _ in range(2))
        got, _ = walked(a, b, 5)
        k, d = brute_match(a, b, 5)
        assert len(got) == k and abs(sum(abs(a[i] - b[j]) for i, j in got) - d) < 1e-9
    rows = [(i, int(i < 20), "f" if i % 2 else "m", float(rng.integers(20, 80))) for i in range(80)]
    people = spark.createDataFrame(rows, "id long, arm int, sex string, age double")
    pairs = cohort.match(people, "id", "arm", ["sex"], "age", 5.0, 0).collect()
    by = {r[0]: r for r in rows}
    used = [x for p in pairs for x in (p["case"], p["control"])]
    assert len(used) == len(set(used)) == 40
    assert all(by[p["case"]][2] == by[p["control"]][2] and abs(by[p["case"]][3] - by[p["control"]][3]) <= 5 for p in pairs if p["round"] == "1:sex:age")


def brute_cox(t, e, x):
    beta = np.zeros(x.shape[1])
    for _ in range(40):
        g, h = np.zeros_like(beta), np.zeros((len(beta),) * 2)
        r = np.exp(x @ beta)
        for u in sorted(set(t[e == 1])):
            risk, dead = t >= u, (t == u) & (e == 1)
            d = dead.sum()
            for k in range(d):
                w = np.where(risk, r, 0) - k / d * np.where(dead, r, 0)
                m = w @ x / w.sum()
                g += x[dead].sum(0) / d - m
                h += (x.T * w) @ x / w.sum() - np.outer(m, m)
        beta = beta + np.linalg.solve(h, g)
    return beta, np.sqrt(np.diag(np.linalg.inv(h)))


def test_cox(spark):
    rng = np.random.default_rng(1)
    x = np.column_stack([rng.integers(0, 2, 120), rng.normal(size=120)])
    t = np.ceil(rng.exponential(8 / np.exp(0.7 * x[:, 0])))
    e = (rng.random(120) < 0.7).astype(int)
    beta, se = brute_cox(t, e, x)
    got = stats.coxph(spark.createDataFrame([(float(a), int(b), float(c), float(d)) for a, b, (c, d) in zip(t, e, x)], "t double, e int, a double, b double"), "t", "e", ["a", "b"])
    assert all(abs(r["coef"] - b) < 1e-5 and abs(r["se"] - s) < 1e-5 and r["converged"] for r, b, s in zip(got, beta, se))


def test_cox_models_together(spark):
    """Many strata at once: each as brute force gives it, jobs that do not grow with them, constant covariates left out, q over strata."""
    rng = np.random.default_rng(2)
    rows, want = [], {}
    for g in range(12):
        x = np.column_stack([rng.integers(0, 2, 60), rng.normal(size=60) if g % 3 else np.ones(60)])
        t, e = np.ceil(rng.exponential(6, 60)), (rng.random(60) < 0.6).astype(int)
        rows += [(g if g else None, float(a), int(b), float(c), float(d)) for a, b, (c, d) in zip(t, e, x)]
        want[g if g else None] = brute_cox(t, e, x if g % 3 else x[:, :1])
    rows += [(99, 1.0, 0, 1.0, 2.0), (99, 2.0, 0, 0.0, 1.0), (5, None, 1, 1.0, 1.0), (5, 3.0, 1, None, 1.0)]
    frame = spark.createDataFrame(rows, "g int, t double, e int, a double, b double")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("cox", "cox")
    got = stats.cox_models(frame, ["g"], "t", "e", ["a", "b"])
    jobs_of_all = len(tracker.getJobIdsForGroup("cox"))
    spark.sparkContext.setJobGroup("one", "one")
    stats.cox_models(frame.where("g = 5"), ["g"], "t", "e", ["a", "b"])
    jobs_of_one = len(tracker.getJobIdsForGroup("one"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs_of_all <= 2.5 * jobs_of_one
    assert {r["g"] for r in got} == set(want)
    for g, (beta, se) in want.items():
        mine = [r for r in got if r["g"] == g]
        assert [r["name"] for r in mine] == (["a", "b"] if (g or 0) % 3 else ["a"])
        assert all(abs(r["coef"] - b) < 1e-5 and abs(r["se"] - s) < 1e-5 and r["converged"] for r, b, s in zip(mine, beta, se))
    typed = stats.cox_by_type(frame, "g", "t", "e", ["a", "b"], "a")
    ps = np.array([r["p"] for r in typed])
    order = np.argsort(ps)
    q = np.minimum.accumulate((ps[order] * len(ps) / np.arange(1, len(ps) + 1))[::-1])[::-1]
    assert np.allclose([typed[i]["q"] for i in order], np.minimum(q, 1)) and len(typed) == 11
    grid = [{"covariates": ["a"]}, {"where": "g > 3", "covariates": ["a", "b"]}, {"covariates": ["a"]}]
    three = stats.ablate(spark, frame, grid, "t", "e")
    alone = stats.coxph(frame.where("g > 3"), "t", "e", ["a", "b"])
    assert len(three) == 4 and three[0] == three[3] and all(abs(x["coef"] - y["coef"]) < 1e-8 for x, y in zip(three[1:3], alone))


@pytest.mark.parametrize("partitions", [1, 7])
def test_running_and_quantiles(spark, partitions):
    rng = np.random.default_rng(3)
    rows = [(("hot" if rng.random() < 0.8 else None if rng.random() < 0.3 else f"g{rng.integers(0, 3)}"), int(rng.integers(0, 40)), i, float(rng.integers(1, 5))) for i in range(2500)]
    frame = spark.createDataFrame(rows, "g string, o int, id int, v double")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        for falling in (False, True):
            got = {r.id: r for r in ranks.running(frame, ["g"], ["o", "id"], {"s": ("sum", "v"), "m": ("min", F.col("v") * -1)}, falling).collect()}
            for g in {r[0] for r in rows}:
                mine = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2]), reverse=falling)
                for k, r in enumerate(mine):
                    x = got[r[2]]
                    assert x.s == sum(q[3] for q in mine[:k]) and x.m == (min(-q[3] for q in mine[:k]) if k else None) and x.s_all == sum(q[3] for q in mine)
        q = {r.g: r for r in ranks.quantiles(frame.withColumn("o", F.when(F.col("id") % 5 > 0, F.col("o"))), ["g"], "o", [0, 0.25, 0.5, 0.9, 1]).collect()}
        for g in {r[0] for r in rows}:
            values = [r[1] for r in rows if r[0] == g and r[2] % 5]
            assert q[g].n == len(values) and np.allclose(q[g].q, np.quantile(values, [0, 0.25, 0.5, 0.9, 1]))
        assert ranks.running(frame.where("false"), [], ["o"], {"s": ("sum", "v")}).count() == 0
        split = {r.id: r.split for r in sampling.three_way_split(frame.withColumn("pool", F.when(F.col("id") % 3 == 0, "test").otherwise("train")), "pool", ["id"], most=100).collect()}
        assert sum(v == "train" for v in split.values()) == sum(v == "validation" for v in split.values()) == 100 and sum(v == "test" for v in split.values()) == sum(i % 3 == 0 for i in range(2500))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_level_differences(spark):
    """The mean standardised difference over pairs of groups, of numbers and of a category of three levels, by numpy."""
    rng = np.random.default_rng(4)
    rows = [(f"g{i % 3}", float(rng.normal() + i % 3), f"l{rng.integers(0, 3)}") for i in range(300)]
    table = stats.baseline_table(spark.createDataFrame(rows, "g string, x double, l string"), "g", ["x"], ["l"])
    got = {r.variable: r.smd for r in table.select("variable", "smd").distinct().collect()}
    x = [np.array([r[1] for r in rows if r[0] == f"g{k}"]) for k in range(3)]
    want = np.mean([abs(a.mean() - b.mean()) / np.sqrt((a.var(ddof=1) + b.var(ddof=1)) / 2) for a, b in itertools.combinations(x, 2)])
    p = [np.array([np.mean([r[2] == f"l{j}" for r in rows if r[0] == f"g{k}"]) for j in (1, 2)]) for k in range(3)]
    cat = np.mean([np.sqrt((a - b) @ np.linalg.inv((np.diag(a) - np.outer(a, a) + np.diag(b) - np.outer(b, b)) / 2) @ (a - b)) for a, b in itertools.combinations(p, 2)])
    assert abs(got["x"] - want) < 1e-9 and abs(got["l"] - cat) < 1e-9


def test_p_values():
    assert abs(stats.chi2_p(3.841459, 1) - 0.05) < 1e-6 and abs(stats.t_p(2.228139, 10) - 0.05) < 1e-6
    assert abs(stats.normal_p(1.959964) - 0.05) < 1e-6 and abs(stats.chi2_p(18.307, 10) - 0.05) < 1e-5


def test_percent_error(spark):
    d = spark.createDataFrame([("0", "0"), ("0", "3"), ("F", "1"), ("2", "F"), ("10", "15"), ("1", "9")], "a string, b string")
    assert values(d.select(evalm.percent_error(F.col("a"), F.col("b")).alias("y")), "y") == [0.0, 100.0, 100.0, 100.0, 50.0, 100.0]


def test_histories(spark):
    w = spark.createDataFrame([("d1", "p1", "p2", "p3", "*", "0.7", "0.9", "base"), ("d2", "p1", "p2", "p3", None, "*", None, "base")], "k string, a string, b string, c string, x string, y string, z string, f string")
    assert [(r.k, r.prompt) for r in history.best_of_wide(w, "k", ["a", "b", "c"], ["x", "y", "z"], "f").orderBy("k").collect()] == [("d1", "p3"), ("d2", "base")]
    h = spark.createDataFrame([(1, i, v, p) for i, (v, p) in enumerate([(0.5, 0.4), (0.9, None), (0.7, 0.6), (0.6, 0.8)])], "m int, i int, v double, p double")
    assert [(r.best, r.at_best) for r in history.value_at_best(h, ["m"], ["i"], "v", "p").orderBy("i").collect()] == [(0.5, 0.4), (0.7, 0.6), (0.7, 0.6)]


def test_record_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    body = "EMPI|Note|Text\n" + "\n".join(["1|n1|line one\nline | two[report_end]", " 2 |n2|x[report_end]", "|n3|no key[report_end]", "4|short[report_end]"]) + "\n"
    (tmp_path / "a" / "xHnp.txt").write_text(body)
    (tmp_path / "a" / "other.txt").write_text("junk")
    good, bad = records.read_records(spark, str(tmp_path), ["EMPI", "Note", "Text"], "EMPI", end="[report_end]", pattern="*Hnp.txt")
    assert {(r.EMPI, r.Text) for r in good.collect()} == {("1", "line one\nline | two"), ("2", "x")}
    assert sorted(values(bad, "reason")) == ["no key", "short"]
    with pytest.raises(ValueError):
        records.check_rejects(good, bad)
    assert {r.column for r in records.profile_sources(good, ["EMPI", "Note"]).collect()} == {"EMPI", "Note"}


def test_arrivals(spark, tmp_path):
    src, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    first = spark.range(5).withColumnRenamed("id", "x")
    first.write.parquet(src)
    arrivals.process_arrivals(spark, src, first.schema, out, check)
    first.where("x < 2").write.mode("append").parquet(src)
    arrivals.process_arrivals(spark, src, first.schema, out, check)
    assert spark.read.parquet(out).count() == 7


def test_scoring_memo(spark):
    asked = spark.sparkContext.accumulator(0)

    def scorer(pdf):
        import pandas as pd

        asked.add(len(pdf))
        return pd.DataFrame({"prediction": ["Yes" if t and "a" in t else "No" for t in pdf["text"]]})

    d = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None), (5, None)], "id int, text string")
    memo = spark.createDataFrame([("b", "Old"), ("b", "Older")], "text string, prediction string")
    out, fresh = scoring.score_with_memo(d, memo, ["text"], scorer, "prediction string")
    assert dict(out.select("id", "prediction").collect()) == {1: "Yes", 2: "Yes", 3: "Old", 4: "No", 5: "No"}
    assert out.columns == ["id", "text", "prediction"] and fresh.count() == 2
    again, none = scoring.score_with_memo(d, memo.unionByName(fresh), ["text"], scorer, "prediction string")
    assert again.count() == 5 and none.count() == 0


def test_bow(spark):
    d = spark.createDataFrame([(i, "good fine day" if i % 2 else "bad sad night", float(i % 2)) for i in range(40)], "id int, text string, y double")
    model = scoring.train_bow(d, "text", ["y"])
    assert model.transform(d).where("y = y_hat").count() == 40
    best = scoring.bow_thresholds(model, d, ["y"]).first()
    assert best["label"] == "y" and best["f1"] == 1.0


def test_sampling(spark):
    d = spark.range(1000).withColumn("k", F.col("id") % 50)
    s = sampling.key_split(d, "k", {"train": 0.6, "val": 0.2, "test": 0.2}, 3)
    assert s.select("k", "split").distinct().count() == 50 and s.where("split = 'train'").count() > 400
    assert values(sampling.downsample(d, 10, 1, "id"), "id") == values(sampling.downsample(d.repartition(7), 10, 1, "id"), "id")
    w = sampling.weighted_choice(spark.createDataFrame([(1, "a", 1), (1, "b", 3), (2, "c", 5)], "g int, c string, w int"), "g", ["c"], "w", 1)
    assert w.count() == 2


def test_quality(spark):
    d = spark.createDataFrame([(1, "Yes", 1.0), (1, "Maybe", -1.0), (2, None, None)], "id int, a string, n double")
    got = {r.check: r.failures for r in quality.expect(d, [quality.required("a"), quality.domain("a", ["Yes", "No"]), quality.non_negative("n")]).collect()}
    assert got == {"required:a": 1, "domain:a": 1, "non_negative:n": 1} and quality.unique(d, ["id"]).first().failures == 1
    r = quality.reconcile(d.groupBy("id").agg(F.count("*").alias("v")), spark.createDataFrame([(1, 2), (2, 2), (3, 1)], "id int, v int"), "id", "v")
    assert r.first().failures == 2


def test_jobs(spark):
    docs = spark.createDataFrame([("p1", 1, "has fever today"), ("p1", 2, "fever fever"), ("p2", 3, "nothing"), ("p3", 4, "mild Fever")], "entity string, note int, body string")
    v = jobs.validation_set(docs, "entity", "note", "body", ["fever"], ["note", "chunk_index"], 5)
    assert sorted(values(v, "note")) == [1, 4]
    assert features.best_record(docs, "entity", "body", ["fever"], "note").where("entity = 'p1'").first()["note"] == 2
    s = jobs.score_notes(docs, "entity", "note", "body", ["fever"], scoring.keyword_scorer("mild", "chunk"))
    assert {(r.note, r.positive) for r in s.collect()} == {(1, False), (2, False), (4, True)}
    runs = spark.createDataFrame([("m", "f", i, x) for i, x in enumerate([0.2, 0.1, 0.6])], "m string, f string, i int, s double")
    assert [round(r.best, 3) for r in jobs.run_analysis(runs, "m", "f", "i", "s", 3).orderBy("point").collect()] == [0.2, 0.2, 0.6]
    assert tables.id_lines(docs, "entity").count() == 3


def test_no_cartesian_plans(spark):
    from tidemark.plans import catalogue

    for name in ("interval_pairs", "longest_prefix", "boundary_prefix", "span_overlap", "context_expand", "code_set_flags"):
        assert "CartesianProduct" not in catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()


@pytest.mark.parametrize("sides", [(20_000, 80_000), (50_000, 50_000)])
def test_matching_keeps_a_caliper_width(sides):
    """A dense run of 100,000 people: what is held is a caliper's width of it, and the time does not grow with that width."""
    import tracemalloc

    rng = np.random.default_rng(12)
    people = sorted([(float(x), 1) for x in rng.uniform(0, 1000, sides[0])] + [(float(x), 0) for x in rng.uniform(0, 1000, sides[1])])
    line = matching.Line(5.0)
    tracemalloc.start()
    for x, arm in people:
        line.push(x, arm)
    top = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert line.pairs > 0.99 * sides[0] and top < 2 << 20 and len(line.last) < 1500


def test_matching_is_best_by_brute_force():
    rng = np.random.default_rng(13)
    for _ in range(300):
        cases, controls = (sorted(rng.integers(0, 30, rng.integers(0, 9)).tolist()) for _ in range(2))
        best = [[(0, 0)] * (len(controls) + 1) for _ in range(len(cases) + 1)]
        for i, x in enumerate(cases):
            for j, y in enumerate(controls):
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], (best[i][j][0] + 1, best[i][j][1] - abs(x - y)) if abs(x - y) <= 3 else (0, 0))
        found, line = walked(cases, controls, 3)
        assert len(found) == line.pairs
        assert (len(found), -sum(abs(cases[i] - controls[j]) for i, j in found)) == best[-1][-1]
        assert all(a < c and b < d for (a, b), (c, d) in zip(found, found[1:])) and all(abs(cases[i] - controls[j]) <= 3 for i, j in found)


def test_pairs_of_streams(spark):
    """Many keys over many batches, people who can't take part, ties, and the best by brute force for every key."""
    rng = np.random.default_rng(14)
    rows = [(int(i), int(rng.random() < 0.3), int(rng.integers(0, 40)), float(rng.integers(0, 30))) for i in range(900)]
    odd = [(None, 1, 1, 3.0), (9001, None, 1, 3.0), (9002, 2, 1, 3.0), (9003, 1, None, 3.0), (9004, 1, 1, None), (9005, 0, 1, float("nan")), (9006, 0, 1, float("inf"))]
    people = spark.createDataFrame([(*r, "x", 5) for r in rows + odd], "id long, arm int, sex int, age double, key string, number int")
    got = [tuple(r) for r in cohort.match_round(people, "id", "arm", ["sex"], "age", 2.0).collect()]
    by = {r[0]: r for r in rows}
    assert len({x for p in got for x in p}) == 2 * len(got)
    for sex in range(40):
        a, b = (sorted(r[3] for r in rows if r[2] == sex and r[1] == k) for k in (1, 0))
        mine = [(by[c], by[d]) for c, d in got if by[c][2] == sex]
        assert all(c[1] == 1 and d[1] == 0 and c[2] == d[2] and abs(c[3] - d[3]) <= 2 for c, d in mine)
        want, line = walked(a, b, 2.0)
        assert len(mine) == len(want) == line.pairs and abs(sum(abs(c[3] - d[3]) for c, d in mine) - sum(abs(a[i] - b[j]) for i, j in want)) < 1e-9
    assert cohort.match_round(people.where("false"), "id", "arm", [], "age", 2.0).count() == 0
    texts = people.where("id < 100").withColumn("id", F.col("id").cast("string"))
    assert cohort.match_round(texts, "id", "arm", [], "age", 2.0).count() == walked(*(sorted(r[3] for r in rows if r[0] < 100 and r[1] == k) for k in (1, 0)), 2.0)[1].pairs
