"""More registered queries: sinks read back, rules over cells, covariates, periods, run reports, and the jobs as wholes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from tidemark.functions import dates, rules, text
from tidemark.operators import cohort, codes, evalm, exposure, features, history, pooling, sampling, scoring
from tidemark.plans import jobs
from tidemark.plans.catalogue import _ARMS, _IDX, _K, _LAB, _R, _events, _index, _lab, _t, query
from tidemark.sources import exports, records, tables

# ---- sinks -----------------------------------------------------------------------------------------------------------


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey % 2 = 0")
def replaced_table(spark, d):
    path = tables.new_path(spark, "replaced")
    c = _t(spark, d, "customer").select("c_custkey", "c_mktsegment")
    tables.write_replaced(c, path)
    tables.write_replaced(c.where("c_custkey % 2 = 0"), path, "c_mktsegment")
    return spark.read.parquet(path)


@query("SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_brand, CAST(p_size AS VARCHAR) AS p_size, p_type FROM part")
def wide_csv(spark, d):
    path = tables.new_path(spark, "wide")
    tables.write_wide_csv(_t(spark, d, "part").select("p_type", "p_size", "p_brand", "p_partkey"), path, ["p_partkey"])
    return exports.read_wide_strings(spark, path)


@query("""WITH p AS (SELECT c_custkey, c_mktsegment AS s, CAST(c_custkey % 5 = 0 AS INT) AS arm FROM customer), r AS (SELECT *, row_number() OVER (PARTITION BY s, arm ORDER BY c_custkey) AS n FROM p),
    m AS (SELECT a.c_custkey AS c, b.c_custkey AS d FROM r a JOIN r b ON a.s = b.s AND a.n = b.n AND a.arm = 1 AND b.arm = 0)
    SELECT (SELECT count(*) FROM p WHERE arm = 1) AS cases, (SELECT count(*) FROM p WHERE arm = 0) AS controls, count(*) AS pairs, count(DISTINCT c) AS used_cases, count(DISTINCT d) AS used_controls, round(count(DISTINCT c) / (SELECT count(*) FROM p WHERE arm = 1), 6) AS matched_share, CAST(sum(c * 7 + d) AS BIGINT) AS held FROM m""")
def cohort_tables(spark, d):
    people = _t(spark, d, "customer").withColumn("arm", (F.col("c_custkey") % 5 == 0).cast("int"))
    pairs = cohort.match_round(people, "c_custkey", "arm", ["c_mktsegment"], None, 0)
    path = tables.new_path(spark, "cohort")
    exports.write_cohort(path, people, pairs, "c_custkey", "arm", "case", "control")
    held = spark.read.parquet(f"{path}/pairs").agg(F.sum(F.col("case") * 7 + F.col("control")).alias("held"))
    return spark.read.parquet(f"{path}/match_stats").join(held).withColumn("matched_share", _R("matched_share"))  # one row each


# ---- cells -----------------------------------------------------------------------------------------------------------

@query("""WITH c AS (SELECT c_custkey, c_custkey % 400 + 20 AS w, c_nationkey * 3 + 20 AS h FROM customer), b AS (SELECT c_custkey, CASE WHEN w BETWEEN 50 AND 1000 AND h BETWEEN 36 AND 90 THEN 703.0 * w / (h * h) END AS v FROM c)
    SELECT c_custkey, round(CASE WHEN v BETWEEN 10 AND 100 THEN v END, 6) AS bmi FROM b""")
def bmi_values(spark, d):
    return _t(spark, d, "customer").select("c_custkey", _R(rules.bmi(F.col("c_custkey") % 400 + 20, F.col("c_nationkey") * 3 + 20)).alias("bmi"))


@query("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'male' WHEN 1 THEN 'female' ELSE 'unknown' END AS sex, CASE c_nationkey % 4 WHEN 0 THEN 'hispanic' WHEN 1 THEN '' ELSE lower(c_mktsegment) END AS race FROM customer""")
def sex_and_race(spark, d):
    c, k, n = _t(spark, d, "customer"), F.col("c_custkey") % 3, F.col("c_nationkey") % 4
    birth, legal = F.when(k == 0, " Male").when(k == 1, "Unknown").otherwise(F.lit(None)), F.when(k == 1, "Female ").otherwise("UNKNOWN")
    group, ethnic = F.when(n > 1, F.col("c_mktsegment")), F.when(n == 0, "HISPANIC").otherwise("OTHER")
    return c.select("c_custkey", rules.sex(birth, legal).alias("sex"), rules.race(group, ethnic).alias("race"))


@query("""SELECT p_partkey, p_name AS clean, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size AS VARCHAR) WHEN p_partkey % 3 = 1 THEN CAST(p_size AS VARCHAR) || '.5' ELSE 'F' END AS number,
    CASE p_partkey % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'A' WHEN 3 THEN 'B' END AS choice, list_transform(string_split(p_name, ' '), lambda x: x || '!') AS cells FROM part""")
def cleaned_cells(spark, d):
    n, p = F.col("p_partkey"), _t(spark, d, "part")
    number = F.when(n % 3 == 0, F.concat(F.col("p_size").cast("string"), F.lit(".0"))).when(n % 3 == 1, F.concat(F.col("p_size").cast("string"), F.lit(".5"))).otherwise("F")
    said = F.element_at(F.array(F.lit("(a)"), F.lit("B. No"), F.lit("Yes."), F.lit("no"), F.lit("perhaps")), (n % 5 + 1).cast("int"))
    cells = F.concat(F.lit("['"), F.array_join(F.split("p_name", " "), "!', '"), F.lit("!']"))
    out = p.select("p_partkey", text.strip_control(F.concat(F.lit(" "), F.translate("p_name", "~", " "), F.lit("\x01\x1f "))).alias("clean"), text.normal_number(number).alias("number"), text.choice_key(said, {"A": "Yes", "B": "No"}).alias("choice"), cells.alias("cells"))
    return records.list_cells(out, "cells")


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN '0' WHEN o_orderstatus = 'F' THEN CASE WHEN o_custkey % 2 = 0 THEN CAST(o_custkey % 90 AS VARCHAR) WHEN o_custkey % 3 = 0 THEN CAST(o_custkey % 40 AS VARCHAR) ELSE 'F' END END AS days FROM orders""")
def staged_days(spark, d):
    took, k = F.when(F.col("o_orderstatus") == "O", "No").when(F.col("o_orderstatus") == "F", "Yes"), F.col("o_custkey")
    return _t(spark, d, "orders").select("o_orderkey", scoring.staged(took, F.when(k % 2 == 0, k % 90), F.when(k % 3 == 0, k % 40)).alias("days"))


@query("""SELECT c_mktsegment, CASE c_mktsegment WHEN 'BUILDING' THEN 'trade' WHEN 'MACHINERY' THEN 'trade' WHEN 'HOUSEHOLD' THEN 'home' ELSE 'other' END AS kind, CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 1 WHEN 'HOUSEHOLD' THEN 0 END AS kind_level, count(*) AS n FROM customer GROUP BY 1""")
def recoded_covariates(spark, d):
    c = _t(spark, d, "customer").withColumn("kind", F.concat(F.lit(" "), F.lower("c_mktsegment")))
    spec = {"kind": {"rules": [(["Building", "machinery"], "trade"), (["HOUSEHOLD"], "home")], "levels": ["home", "trade"], "other": "other", "missing": "unknown"}}
    return exposure.recoded_levels(c, spec).groupBy("c_mktsegment", "kind", "kind_level").agg(F.count("*").alias("n"))


# ---- covariates, periods, labels -------------------------------------------------------------------------------------

@query(f"""WITH {_IDX}, o AS (SELECT user_id, ts, CASE WHEN value < 30 THEN 'low' WHEN value < 90 THEN 'high' END AS option FROM events WHERE event_type = 'click'), n AS (SELECT o.*, abs(date_diff('microsecond', index_date, ts)) AS g FROM o JOIN idx USING (user_id) WHERE option IS NOT NULL AND date_diff('microsecond', index_date, ts) <= 2 * 86400000000)
    SELECT user_id, arg_min(option, {{'g': g, 't': ts}}) AS option FROM n GROUP BY 1""")
def closest_option(spark, d):
    o = _t(spark, d, "events").where("event_type = 'click'").select("user_id", "ts", F.when(F.col("value") < 30, "low").when(F.col("value") < 90, "high").alias("option"))
    return cohort.closest_covariate(o, _index(spark, d), "user_id", "ts", "option", 2)


@query("""WITH f AS (SELECT o_custkey, min(o_orderdate) AS first FROM orders WHERE o_orderpriority LIKE '1%' GROUP BY 1), l AS (SELECT o_custkey, max(o_orderdate) AS last FROM orders GROUP BY 1)
    SELECT o_custkey FROM f JOIN l USING (o_custkey) WHERE last > first + INTERVAL 730 DAY""")
def followed_people(spark, d):
    o = _t(spark, d, "orders")
    f = cohort.index_dates(o, "o_custkey", "o_orderdate", F.col("o_orderpriority").like("1%"))
    wide = f.join(o.groupBy("o_custkey").agg(F.max("o_orderdate").alias("last")), "o_custkey").withColumns({"death": F.lit(None).cast("timestamp"), "hit": F.lit(None).cast("timestamp")})
    return cohort.follow_positive(cohort.followup(wide, "index_date", "last", "death", "hit")).select("o_custkey")


@query(f"""WITH {_IDX}, p AS (SELECT event_type, {_K} % 3 AS k, user_id, date_diff('microsecond', index_date, ts) / 86400000000.0 AS g FROM events JOIN idx USING (user_id))
    SELECT event_type, CASE WHEN event_type = 'error' THEN 'outcome' WHEN g <= 0 THEN 'pre_index' WHEN g < 14 THEN 'treatment' ELSE 'outcome' END AS period, k, count(*) AS n, count(DISTINCT user_id) AS entities FROM p GROUP BY 1, 2, 3""")
def keyword_periods(spark, d):
    e = _events(spark, d).select("user_id", "event_type", "ts", (F.col("k") % 3).alias("k"))
    return pooling.counts_by_period(e, _index(spark, d), "user_id", "event_type", "ts", "k", 14, {"error": "outcome"})


@query("""WITH r AS (SELECT event_type AS feature, user_id, event_id % 4 = 0 AS s FROM events) SELECT feature, count(*) AS n, count(DISTINCT user_id) AS entities, round(avg(CAST(s AS INT)), 6) AS structured_share FROM r GROUP BY 1""")
def record_summary(spark, d):
    e = _t(spark, d, "events").select(F.col("event_type").alias("feature"), F.col("user_id").alias("entity_id"), F.when(F.col("event_id") % 4 == 0, "structured").otherwise("model").alias("method"))
    return features.summary(e, "method", "feature").withColumn("structured_share", _R("structured_share"))


@query("""WITH l AS (SELECT doc_id, 'quality' AS f, CASE WHEN toxic = 1 THEN 'DROP' ELSE CAST(quality AS VARCHAR) END AS label, false AS is_synthetic FROM labels UNION ALL SELECT doc_id, 'toxic', CASE WHEN doc_id % 3 > 0 THEN CAST(toxic AS VARCHAR) END, true FROM labels)
    SELECT doc_id, g AS feature, label, is_synthetic FROM l JOIN (VALUES ('quality', 'good'), ('quality', 'fine'), ('toxic', 'bad')) AS m(f, g) USING (f) WHERE label IS NOT NULL AND label <> 'DROP'""")
def loaded_labels(spark, d):
    l = _t(spark, d, "labels")
    own = l.select("doc_id", F.lit("quality").alias("feature"), F.when(F.col("toxic") == 1, "DROP").otherwise(F.col("quality").cast("string")).alias("label"))
    made = l.select("doc_id", F.lit("toxic").alias("feature"), F.when(F.col("doc_id") % 3 > 0, F.col("toxic").cast("string")).alias("label"))
    remap = spark.createDataFrame([("good", "quality"), ("fine", "quality"), ("bad", "toxic")], "feature string, source_feature string")
    return tables.labelled_chunks(own, remap, made).select("doc_id", "feature", "label", "is_synthetic")


@query(f"""WITH {_LAB} SELECT t / 100.0 AS threshold, round(count(*) FILTER (WHERE CASE WHEN n_chars >= 6000 THEN 1.0 ELSE score END > t / 100.0) / count(*), 6) AS share_labelled FROM lab, range(1, 100) r(t) GROUP BY t""")
def labelled_shares(spark, d):
    lab = _lab(spark, d).withColumn("score", F.when(F.col("n_chars") >= 6000, 1.0).otherwise(F.col("score")))
    swept = evalm.sweep(lab, "quality", "score")
    return evalm.labelled_share(swept, F.lit(lab.count())).select("threshold", _R("share_labelled").alias("share_labelled"))


@query(f"""WITH {_LAB}, b AS (SELECT quality AS y, doc_id, CASE WHEN n_chars >= 6000 THEN 1.0 ELSE score END AS s FROM lab), w AS (SELECT t / 100.0 AS t, count(*) FILTER (WHERE y = 1 AND s > t / 100.0) AS tp, count(*) FILTER (WHERE y = 0 AND s > t / 100.0) AS fp, count(*) FILTER (WHERE y = 1 AND NOT s > t / 100.0) AS fn FROM b, range(1, 100) r(t) GROUP BY r.t),
    c AS (SELECT arg_max(t, {{'f': CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 't': -t}}) AS cut FROM w), f AS (SELECT doc_id, CASE WHEN y = 1 AND NOT s > cut THEN 'false_negative' WHEN y = 0 AND s > cut THEN 'false_positive' END AS kind FROM b, c)
    SELECT kind, doc_id FROM f WHERE kind IS NOT NULL QUALIFY row_number() OVER (PARTITION BY kind ORDER BY doc_id) <= 12""")
def review_at_best(spark, d):
    lab = _lab(spark, d).withColumn("score", F.when(F.col("n_chars") >= 6000, 1.0).otherwise(F.col("score")))
    return jobs.review_by_threshold(lab, "quality", "score", ["doc_id"], 12).select("kind", "doc_id")


@query("""WITH c AS (SELECT *, ((conv_id * 31 + turn * 17) % 97) / 97.0 AS u FROM conversations), r AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM c WHERE u < 0.6 WINDOW w AS (PARTITION BY conv_id ORDER BY u, turn)),
    m AS (SELECT a.conv_id, a.turn, b.text AS swapped FROM r a JOIN r b ON a.conv_id = b.conv_id AND b.i = a.i % a.n + 1 WHERE a.n > 1)
    SELECT c.conv_id, c.turn, coalesce(swapped, text) AS swapped, CAST(swapped IS NOT NULL AS INT) AS label FROM c LEFT JOIN m USING (conv_id, turn)""")
def swapped_texts(spark, d):
    u = ((F.col("conv_id") * 31 + F.col("turn") * 17) % 97) / 97.0
    return sampling.swapped_sentences(_t(spark, d, "conversations"), "conv_id", "turn", "text", 0.6, 0, u).select("conv_id", "turn", "swapped", "label")


@query("""SELECT doc_id, lang, CASE WHEN lang <> 'en' OR lang IS NULL THEN 'test' WHEN r <= ceil(n / 2) THEN 'train' ELSE 'validation' END AS split FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents)
    WHERE lang <> 'en' OR CASE WHEN r <= ceil(n / 2) THEN r ELSE r - ceil(n / 2) END <= 150""")
def three_way_split(spark, d):
    return sampling.three_way_split(_t(spark, d, "documents").select("doc_id", "lang"), "lang", ["doc_id"], "en", most=150)


# ---- runs ------------------------------------------------------------------------------------------------------------

def _runs(spark, d):
    o = _t(spark, d, "orders").where("o_custkey <= 600")
    return o.select(F.col("o_orderpriority").alias("method"), (F.col("o_custkey") % 6).cast("string").alias("feature"), F.col("o_custkey").alias("step"), F.col("o_orderkey").alias("stamp"), (F.col("o_totalprice") / 1000).alias("score"), F.concat_ws(" ", "o_orderstatus", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority"))).alias("prompt"))


_RUNS = """runs AS (SELECT o_orderpriority AS method, CAST(o_custkey % 6 AS VARCHAR) AS feature, o_custkey AS step, o_orderkey AS stamp, o_totalprice / 1000 AS score, concat_ws(' ', o_orderstatus, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END) AS prompt FROM orders WHERE o_custkey <= 600),
    latest AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY method, feature, step ORDER BY stamp DESC) = 1), top AS (SELECT method, feature, max(score) AS score FROM latest GROUP BY 1, 2)"""
_METHODS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _report(spark, d):
    return jobs.run_report(_runs(spark, d), ["method", "feature", "step"], "stamp", "method", "feature", "step", "score", "prompt", _METHODS)


@query(f"""WITH {_RUNS}, w AS (SELECT feature, {', '.join(f"round(max(score) FILTER (WHERE method = '{m}'), 6) AS m{i}" for i, m in enumerate(_METHODS))} FROM top GROUP BY 1) SELECT w.*, (SELECT arg_min(method, {{'s': -score, 'm': method}}) FROM top t WHERE t.feature = w.feature) AS best FROM w""")
def run_matrix(spark, d):
    m = _report(spark, d)["matrix"]
    return m.select("feature", *[_R(f"`{x}`").alias(f"m{i}") for i, x in enumerate(_METHODS)], "best")


@query(f"""WITH {_RUNS} SELECT method, round(avg(len(string_split(prompt, ' ')) - CAST(prompt LIKE '%NOT SPECIFIED' AS INT) * 0), 6) AS words, round(avg(length(prompt)), 6) AS characters, (SELECT round(avg(score), 5) FROM top t WHERE t.method = latest.method) AS mean FROM latest GROUP BY 1""")
def run_lengths(spark, d):
    r = _report(spark, d)
    return r["lengths"].join(r["ranking"].select("method", "mean"), "method").select("method", _R("words").alias("words"), _R("characters").alias("characters"), _R("mean", 5).alias("mean"))


@query(f"""WITH {_LAB}, k AS (SELECT *, doc_id % 4 = 0 AS synthetic FROM lab), e AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS place FROM k WHERE quality IS DISTINCT FROM pred)
    SELECT lang, 'accuracy' AS kind, round(avg(CAST(quality = pred AS INT)), 6) AS x, count(*) AS n FROM k GROUP BY 1 UNION ALL SELECT lang, 'natural', round(avg(CAST(quality = pred AS INT)) FILTER (WHERE NOT synthetic), 6), count(*) FROM k GROUP BY 1
    UNION ALL SELECT lang, 'confusion ' || quality || pred, NULL, count(*) FROM k GROUP BY lang, quality, pred UNION ALL SELECT lang, 'error ' || place, doc_id, 1 FROM e WHERE place <= 5""")
def evaluation_report(spark, d):
    lab = _lab(spark, d).withColumn("synthetic", F.col("doc_id") % 4 == 0)
    scores, table, wrong = jobs.evaluation(lab, ["lang"], "quality", "pred", "synthetic", ["doc_id"], 5)
    row = lambda f, kind, x, n: f.select("lang", kind.alias("kind"), x.cast("double").alias("x"), n.cast("long").alias("n"))
    out = row(scores, F.lit("accuracy"), _R("combined"), F.col("n")).union(row(scores, F.lit("natural"), _R("natural"), F.col("n")))
    out = out.union(row(table, F.concat(F.lit("confusion "), F.col("gt").cast("string"), F.col("pred").cast("string")), F.lit(None), F.col("n")))
    return out.union(row(wrong, F.concat(F.lit("error "), F.col("place").cast("string")), F.col("doc_id"), F.lit(1)))


# ---- jobs ------------------------------------------------------------------------------------------------------------

@query(f"""WITH {_IDX}, e AS (SELECT *, {_K} AS k FROM events), m AS (SELECT e.* FROM e JOIN idx USING (user_id)),
    dx AS (SELECT user_id, label, min(ts) AS ts FROM m JOIN (VALUES ('1', 'ones'), ('2', 'twos'), ('21', 'special')) AS dim(prefix, label) ON starts_with(CAST(k AS VARCHAR), prefix) WHERE NOT (starts_with(CAST(k AS VARCHAR), '21') AND prefix = '2') GROUP BY 1, 2),
    rx AS (SELECT m.user_id, event_type || k % 3 AS drug, CASE k % 3 WHEN 0 THEN 'none' ELSE event_type || k % 3 END AS c, ts FROM m JOIN idx USING (user_id) WHERE event_type = 'purchase' AND ts >= index_date AND ts < index_date + INTERVAL 7 DAY),
    co AS (SELECT m.user_id, arg_min(CASE WHEN value < 30 THEN 'low' ELSE 'high' END, {{'g': abs(date_diff('microsecond', index_date, ts)), 't': ts}}) AS option FROM m JOIN idx USING (user_id) WHERE event_type = 'view' AND value IS NOT NULL AND date_diff('day', index_date, ts) <= 91 AND date_diff('microsecond', index_date, ts) <= 90 * 86400000000 GROUP BY 1),
    nt AS (SELECT DISTINCT m.user_id, ts, event_type AS body, k FROM m JOIN idx USING (user_id) WHERE ts >= index_date AND ts < index_date + INTERVAL 7 DAY)
    SELECT CAST(user_id AS VARCHAR) AS entity_id, 'diagnosis' AS feature_name, label AS keyword, 'Yes' AS prediction, 'structured' AS method, count(*) AS n FROM dx GROUP BY ALL UNION ALL SELECT CAST(user_id AS VARCHAR), 'exposure', drug, 'Yes', 'structured', count(*) FROM rx GROUP BY ALL
    UNION ALL SELECT CAST(user_id AS VARCHAR), 'sex', NULL, CASE WHEN user_id % 2 = 0 THEN 'male' ELSE 'female' END, 'structured', 1 FROM idx UNION ALL SELECT CAST(user_id AS VARCHAR), 'race', NULL, 'group' || user_id % 3, 'structured', 1 FROM idx UNION ALL SELECT CAST(user_id AS VARCHAR), 'age', NULL, CAST(20 + user_id % 60 AS VARCHAR), 'structured', 1 FROM idx
    UNION ALL SELECT CAST(user_id AS VARCHAR), 'last_activity', NULL, strftime(max(ts), '%Y-%m-%d'), 'structured', 1 FROM m GROUP BY user_id UNION ALL SELECT CAST(user_id AS VARCHAR), 'spending', NULL, option, 'structured', 1 FROM co
    UNION ALL SELECT CAST(user_id AS VARCHAR), f.feature, f.keyword, CASE WHEN k % 2 = 0 THEN 'Yes' ELSE 'No' END, 'model', count(*) FROM (SELECT * FROM nt) n JOIN (VALUES ('trouble', 'error'), ('buying', 'purchase'), ('looking', 'view'), ('looking', 'click')) AS f(feature, keyword) ON n.body = f.keyword GROUP BY ALL""")
def extracted_features(spark, d):
    e, index = _events(spark, d).withColumn("code", F.col("k").cast("string")), _index(spark, d)
    dim = spark.createDataFrame([("1", "ones"), ("2", "twos"), ("21", "special")], "prefix string, label string")
    meds = e.where("event_type = 'purchase'").withColumn("drug", F.concat("event_type", (F.col("k") % 3).cast("string")))
    classes = spark.createDataFrame([("purchase0", "none", 1)], "keyword string, drug_class string, order int")
    u = F.col("user_id")
    people = e.select("user_id").distinct().select("user_id", F.when(u % 2 == 0, "Male").otherwise("Female").alias("Sex_At_Birth"), F.lit("x").alias("Gender_Legal_Sex"), F.concat(F.lit("Group"), (u % 3).cast("string")).alias("Race_Group"), F.lit("NO").alias("Ethnic_Group"), (u % 60 + 20).alias("Age"))
    spending = e.where("event_type = 'view' and value is not null").select("user_id", "ts", F.when(F.col("value") < 30, "low").otherwise("high").alias("option"))
    registry = features.Registry([features.Feature("trouble", "Any trouble?", ("error",)), features.Feature("buying", "Any buying?", ("purchase",)), features.Feature("looking", "Any looking?", ("view", "click"), mode="substring"), features.Feature("free", "Nothing to look for")])
    notes = e.select("user_id", F.col("event_id").alias("note"), "ts", F.concat_ws(" ", "event_type", (F.col("k") + 1000).cast("string")).alias("body"))
    even = lambda pdf: pd.DataFrame({"prediction": ["Yes" if int(x.split()[-1]) % 2 == 0 else "No" for x in pdf["chunk"]]})
    out = jobs.extract_features(index, "user_id", e, "ts", "code", dim, meds, "drug", classes, people, "Age", [e], {"spending": spending}, notes, "note", "body", registry, even, 7)
    return out.groupBy("entity_id", "feature_name", "keyword", "prediction", "method").agg(F.count("*").alias("n"))


@query(f"""WITH {_ARMS}, c AS (SELECT user_id, CAST(exposed AS INT) AS arm, user_id % 2 AS sex FROM arms WHERE NOT (NOT exposed AND seen) AND user_id % 50 BETWEEN 5 AND 44), l AS (SELECT user_id, max(ts) AS latest FROM events WHERE event_type = 'view' GROUP BY 1),
    m AS (SELECT c.* FROM c JOIN l USING (user_id) JOIN arms USING (user_id) WHERE latest > index_date + INTERVAL 5 DAY) SELECT count(*) AS members, count(*) FILTER (WHERE arm = 1) AS exposed, 1 AS rounds FROM m""")
def whole_study(spark, d):
    e = _t(spark, d, "events")
    people = e.select("user_id").distinct().withColumns({"age": (F.col("user_id") % 50).cast("double"), "sex": F.col("user_id") % 2})
    spending = e.where("event_type = 'view' and value is not null").select("user_id", "ts", F.when(F.col("value") < 30, "low").otherwise("high").alias("option"))
    members, pairs, balance = jobs.study(e, e.where("event_type = 'purchase'"), people, [e.where("event_type = 'view'")], "user_id", "ts", F.col("event_type") == "signup", 3, 5, (5, 45), "age", ["sex", "spending"], 5.0, {"spending": spending}, 1, tables.new_path(spark, "study"))
    # every round that paired somebody has its balance of all three variables
    rounds = balance.groupBy("round").agg(F.count("*").alias("n")).where("n = 3").agg(F.count("*").alias("balanced"))
    paired = pairs.agg(F.count_distinct("round").alias("paired"))
    return members.agg(F.count("*").alias("members"), F.count_if(F.col("arm") == 1).alias("exposed")).join(rounds).join(paired).select("members", "exposed", (F.col("balanced") == F.col("paired")).cast("int").alias("rounds"))  # one row each
