"""More registered queries: code sets, exposure rows, pooled answers, cohort jobs, survival models and rules over codes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import dates, rules
from tidemark.operators import codes, cohort, evalm, exposure, features, pooling, sampling, stats
from tidemark.plans import jobs
from tidemark.plans.catalogue import _ARMS, _IDX, _K, _LAB, _R, _arms, _events, _index, _lab, _surv, _SURV, _t, query
from tidemark.plans.code_sets import code_set_dimension, code_set_rows
from tidemark.sources import exports

# ---- codes -----------------------------------------------------------------------------------------------------------

_CODED = f"""coded AS (SELECT user_id, ts, event_id, CASE WHEN event_id % 2 = 0 THEN 'ICD10' ELSE 'ICD9' END AS code_type,
    CASE WHEN event_id % 2 = 0 THEN chr(65 + CAST(event_id // 2 % 26 AS INT)) || lpad(CAST({_K} AS VARCHAR), 2, '0') || '.' || CAST(event_id % 10 AS VARCHAR)
      WHEN event_id % 3 = 0 THEN '250.' || lpad(CAST({_K} AS VARCHAR), 2, '0') ELSE lpad(CAST({_K} * 8 AS VARCHAR), 3, '0') || '.' || CAST(event_id % 10 AS VARCHAR) END AS code FROM events)"""


def _coded(spark, d):
    k, i = F.col("k").cast("string"), F.col("event_id")
    tenth = (i % 10).cast("string")
    ten = F.concat(F.char(F.lit(65) + F.floor(i / 2) % 26), F.lpad(k, 2, "0"), F.lit("."), tenth)
    nine = F.when(i % 3 == 0, F.concat(F.lit("250."), F.lpad(k, 2, "0"))).otherwise(F.concat(F.lpad((F.col("k") * 8).cast("string"), 3, "0"), F.lit("."), tenth))
    return _events(spark, d).select("user_id", "ts", "event_id", F.when(i % 2 == 0, "ICD10").otherwise("ICD9").alias("code_type"), F.when(i % 2 == 0, ten).otherwise(nine).alias("code"))


_SETS = "dim(feature, code_type, prefix) AS (VALUES " + ", ".join(str(r) for r in code_set_rows()) + ")"


@query(f"""WITH {_CODED}, {_SETS}, h AS (SELECT DISTINCT user_id, event_id, ts, feature FROM coded JOIN dim ON coded.code_type = dim.code_type AND starts_with(code, prefix))
    SELECT user_id, feature, count(*) AS n, count(DISTINCT CAST(ts AS DATE)) AS n_dates FROM h GROUP BY 1, 2""")
def code_set_features(spark, d):
    return codes.code_flags(_coded(spark, d), code_set_dimension(spark), "user_id", "code", "code_type", "ts")


@query(f"""WITH {_CODED} SELECT event_id FROM coded WHERE starts_with(code, '25') OR starts_with(code, 'K5') OR starts_with(code, 'K50')""")
def rows_by_prefix(spark, d):
    return codes.rows_by_prefix(_coded(spark, d), spark.createDataFrame([("25",), ("K5",), ("K50",)], "prefix string"), "code").select("event_id")


@query(f"""WITH {_CODED} SELECT user_id, CASE WHEN bool_or((code_type = 'ICD10' AND starts_with(code, 'K')) OR (code_type = 'ICD9' AND starts_with(code, '250.0'))) THEN 'A' ELSE 'B' END AS option FROM coded GROUP BY 1""")
def typed_options(spark, d):
    return codes.typed_option(_coded(spark, d), "user_id", "code", "code_type", {"ICD10": ["K"], "ICD9": ["250.0"]})


@query("""SELECT p_partkey, p_brand FROM part WHERE p_brand LIKE 'Brand#1%' OR p_brand LIKE 'Brand#22%'""")
def strict_prefixes(spark, d):
    dim = spark.createDataFrame([("Brand#1", "a"), ("Brand#22", "b")], "prefix string, label string")
    return codes.strict_prefix_join(_t(spark, d, "part"), dim, "p_brand", "prefix")[0].select("p_partkey", "p_brand")


@query("""WITH dim(keyword, drug_class, ord) AS (VALUES ('brass', 'metal', 2), ('economy anodized steel', 'plain', 1), ('steel', 'alloy', 3), ('standard brass plated mixture', 'long', 0), ('promo', 'offer', 4)),
    t AS (SELECT DISTINCT lower(trim(p_type)) AS t FROM part), x AS (SELECT t, arg_min(drug_class, ord) AS c FROM t JOIN dim ON t = keyword GROUP BY 1), n AS (SELECT t, arg_min(drug_class, ord) AS c FROM t JOIN dim ON contains(t, keyword) OR contains(keyword, t) GROUP BY 1)
    SELECT p_partkey, coalesce(x.c, n.c, p_type) AS drug_class FROM part LEFT JOIN x ON x.t = lower(trim(p_type)) LEFT JOIN n ON n.t = lower(trim(p_type))""")
def drug_classes(spark, d):
    dim = spark.createDataFrame([("brass", "metal", 2), ("ECONOMY ANODIZED STEEL", "plain", 1), ("steel", "alloy", 3), ("standard brass plated mixture", "long", 0), ("promo", "offer", 4)], "keyword string, drug_class string, order int")
    return rules.drug_class(_t(spark, d, "part"), "p_type", dim).select("p_partkey", "drug_class")


# ---- exposure rows ---------------------------------------------------------------------------------------------------

_CLASSES = {"urgent": "1-URGENT", "high": "2-HIGH", "medium": "3-MEDIUM", "unspecified": "4-NOT SPECIFIED", "low": "5-LOW"}
_WIDE = "wide AS (SELECT o_custkey, " + ", ".join(
    f"max(CASE WHEN o_orderpriority = '{v}' AND o_orderstatus = 'F' THEN 'Yes' END) AS got_{k}, max(CASE WHEN o_orderpriority = '{v}' AND o_orderstatus = 'F' THEN CASE WHEN o_orderkey % 5 = 0 THEN 'F' ELSE CAST(o_orderkey % 70 AS VARCHAR) END END) AS days_{k}" for k, v in _CLASSES.items()) + " FROM orders GROUP BY 1)"
_GOT = [f"got_{k}" for k in _CLASSES]
_DAYS = [f"days_{k}" for k in _CLASSES]
_ANY = "(" + " OR ".join(f"coalesce({c} = 'Yes', false)" for c in _GOT) + ")"
_COUNT = "(" + " + ".join(f"CAST(coalesce({c} = 'Yes', false) AS INT)" for c in _GOT) + ")"
_KNOWN = "list_filter([" + ", ".join(f"CASE WHEN {c} NOT IN ('F', '', '0') THEN TRY_CAST({c} AS DOUBLE) END" for c in _DAYS) + "], lambda x: x IS NOT NULL)"


def _wide(spark, d):
    o = _t(spark, d, "orders")
    days = F.when(F.col("o_orderkey") % 5 == 0, "F").otherwise((F.col("o_orderkey") % 70).cast("string"))
    aggs = []
    for k, v in _CLASSES.items():
        mine = (F.col("o_orderpriority") == v) & (F.col("o_orderstatus") == "F")
        aggs += [F.max(F.when(mine, "Yes")).alias(f"got_{k}"), F.max(F.when(mine, days)).alias(f"days_{k}")]
    return o.groupBy("o_custkey").agg(*aggs)


@query(f"""WITH {_WIDE}, x AS (SELECT *, {_ANY} AS exposed, {_COUNT} AS classes, {_KNOWN} AS known FROM wide), y AS (SELECT *, CASE WHEN exposed AND len(known) > 0 THEN list_sum(known) END AS total, CASE WHEN exposed THEN list_max(known) END AS longest FROM x)
    SELECT o_custkey, CASE WHEN exposed THEN 'Yes' ELSE 'No' END AS any_exposure, CASE WHEN classes = 0 THEN 'None' WHEN classes = 1 THEN '1 class' WHEN classes = 2 THEN '2 classes' ELSE '3+ classes' END AS classes, total, longest,
      CASE WHEN total <= 90 THEN 'Low (≤90 days)' WHEN total <= 180 THEN 'Medium (91–180 days)' WHEN total > 180 THEN 'High (>180 days)' END AS band,
      CASE WHEN NOT exposed THEN 'None' WHEN total IS NULL THEN 'Unknown' WHEN total <= 29 THEN '1-29' WHEN total <= 89 THEN '30-89' WHEN total <= 364 THEN '90-364' ELSE '365+' END AS dose,
      CASE WHEN NOT exposed THEN 'None' WHEN classes = 1 THEN '1' WHEN classes = 2 THEN '2' WHEN classes >= 3 THEN '3+' END AS courses FROM y""")
def exposure_rows(spark, d):
    w = _wide(spark, d)
    exposed = exposure.any_yes(_GOT) == "Yes"
    w = w.withColumns({"total": exposure.total_days(_DAYS, exposed), "longest": exposure.longest_days(_DAYS, exposed), "n": exposure.yes_count(_GOT)})
    return w.select("o_custkey", exposure.any_yes(_GOT).alias("any_exposure"), exposure.class_group(F.col("n")).alias("classes"), "total", "longest", exposure.duration_band(F.col("total")).alias("band"), exposure.dose_level(exposed, F.col("total")).alias("dose"), exposure.course_level(exposed, F.col("n")).alias("courses"))


@query(f"""WITH {_WIDE} SELECT o_custkey FROM wide WHERE NOT {_ANY} OR list_sum({_KNOWN}) >= 30""")
def long_exposures(spark, d):
    w, exposed = _wide(spark, d), exposure.any_yes(_GOT) == "Yes"
    return exposure.long_exposure_only(w, exposed, exposure.total_days(_DAYS, exposed)).select("o_custkey")


@query(f"""WITH {_WIDE} SELECT o_custkey, CASE {' '.join(f"WHEN got_{k} = 'Yes' THEN '{v}'" for k, v in _CLASSES.items())} END AS type FROM wide WHERE {_COUNT} = 1""")
def single_class_rows(spark, d):
    return exposure.single_class_rows(_wide(spark, d), ["o_custkey"], {f"got_{k}": v for k, v in _CLASSES.items()})


@query(f"""WITH {_WIDE} SELECT count(*) AS n, count(urgent) AS urgent, count(low) AS low FROM (SELECT got_urgent AS urgent, got_low AS low FROM wide)""")
def renamed_families(spark, d):
    w = exposure.renamed_by_prefix(_wide(spark, d), "got_")
    names = exposure.column_families(w, {"plain": r"^(urgent|low)$"})["plain"]
    return w.agg(F.count("*").alias("n"), *[F.count(c).alias(c) for c in names])


@query(f"""WITH {_WIDE} SELECT classes, count(*) AS n, level FROM (SELECT CASE WHEN {_COUNT} = 0 THEN 'None' WHEN {_COUNT} = 1 THEN '1' WHEN {_COUNT} = 2 THEN '2' ELSE '3+' END AS classes, CAST(least({_COUNT}, 3) AS INT) AS level FROM wide) GROUP BY ALL""")
def course_levels(spark, d):
    n = exposure.yes_count(_GOT)
    w = _wide(spark, d).select(exposure.course_level(n > 0, n).alias("classes"))
    return w.groupBy("classes").agg(F.count("*").alias("n")).withColumn("level", exposure.level_number(F.col("classes"), exposure.COURSE_LEVELS))


@query()
def dose_response(spark, d):
    s = _surv(spark, d).withColumn("dose", exposure.dose_level(F.col("arm") == 1, F.when(F.col("c_custkey") % 7 > 0, F.col("c_custkey") % 120)))
    rows = exposure.level_models(s.withColumn("balance", F.col("c_acctbal") / 10000), "dose", exposure.DOSE_LEVELS, "t", "e", ["balance"])
    return spark.createDataFrame(rows, "exposure string, model string, name string, coef double, hr double, low double, high double, se double, z double, p double, converged boolean")


@query(f"""WITH {_SURV}, s AS (SELECT surv.*, c_mktsegment FROM surv JOIN customer USING (c_custkey)) SELECT c_mktsegment AS stratum, count(*) FILTER (WHERE e = 1) AS events FROM s GROUP BY 1 HAVING count(*) FILTER (WHERE e = 1) >= 10""")
def strata_with_events(spark, d):
    models = stats.cox_by_type(_surv(spark, d), "c_mktsegment", "t", "e", ["arm"], "arm")
    s = _surv(spark, d).groupBy(F.col("c_mktsegment").alias("stratum")).agg(F.count_if(F.col("e") == 1).alias("events"))
    fitted = spark.createDataFrame([(m["c_mktsegment"],) for m in models], "stratum string")
    return s.join(fitted, "stratum", "left_semi")


@query("""SELECT 'c_acctbal' AS variable, CASE WHEN grouping(c_mktsegment) = 1 THEN 'overall' ELSE c_mktsegment END AS "group", count(c_acctbal) AS n, round(avg(c_acctbal), 5) AS mean, round(stddev_samp(c_acctbal), 5) AS sd, round(median(c_acctbal), 5) AS median, min(c_acctbal) AS min, max(c_acctbal) AS max
    FROM customer GROUP BY GROUPING SETS ((c_mktsegment), ())""")
def moments_table(spark, d):
    m = stats.moments_table(_t(spark, d, "customer"), "c_mktsegment", ["c_acctbal"])
    return m.withColumns({c: _R(c, 5) for c in ("mean", "sd", "median")})


@query("""WITH c AS (SELECT c_nationkey % 2 AS arm, c_acctbal AS x, CAST(c_custkey % 3 = 0 AS DOUBLE) AS y FROM customer), s AS (SELECT arm, avg(x) AS m, var_samp(x) AS v, avg(y) AS p FROM c GROUP BY 1),
    d AS (SELECT (a.m - b.m) / sqrt((a.v + b.v) / 2) AS x, abs(a.p - b.p) / sqrt((a.p * (1 - a.p) + b.p * (1 - b.p)) / 2) AS y FROM s a, s b WHERE a.arm = 1 AND b.arm = 0)
    SELECT 'c_acctbal' AS variable, round(x, 6) AS smd, abs(x) < 0.1 AS balanced FROM d UNION ALL SELECT 'third', round(y, 6), y < 0.1 FROM d""")
def balance_report(spark, d):
    rows = stats.balance(_surv(spark, d).withColumn("third", F.col("c_custkey") % 3 == 0), "arm", ["c_acctbal"], ["third"])
    return spark.createDataFrame(rows, "variable string, smd double, balanced boolean").withColumn("smd", F.round("smd", 6))


# ---- pooled answers --------------------------------------------------------------------------------------------------

_ANSWERS = "answers AS (SELECT user_id, event_id, chr(65 + CAST(event_id % 7 AS INT)) AS a FROM events)"


def _answers(spark, d):
    return _t(spark, d, "events").select("user_id", "event_id", F.char(F.lit(65) + F.col("event_id") % 7).alias("a"))


@query(f"""WITH {_ANSWERS}, c AS (SELECT user_id, a, count(*) AS n FROM answers WHERE a IN ('A', 'B', 'C', 'D') AND user_id % 3 > 0 OR a = 'E' AND user_id % 3 = 0 GROUP BY 1, 2), k AS (SELECT user_id, arg_min(a, (-n, a)) FILTER (WHERE a < 'E') AS m, bool_or(a = 'E') AS e FROM c GROUP BY 1),
    f AS (SELECT user_id, CASE WHEN bool_or(a = 'E') THEN 'E' WHEN bool_or(a = 'D') THEN 'D' WHEN bool_or(a = 'C') THEN 'C' ELSE 'G' END AS longest FROM answers GROUP BY 1)
    SELECT f.user_id, coalesce(k.m, CASE WHEN k.e THEN 'E' END, 'F') AS amount, f.longest FROM f LEFT JOIN k USING (user_id)""")
def pooled_letters(spark, d):
    a = _answers(spark, d)
    seen = F.when(((F.col("user_id") % 3 > 0) & (F.col("a") < "E")) | ((F.col("user_id") % 3 == 0) & (F.col("a") == "E")), F.col("a"))
    return a.groupBy("user_id").agg(pooling.known_mode(seen, ["A", "B", "C", "D"], ["E"], "F").alias("amount"), pooling.first_present(F.col("a"), ["E", "D", "C"], "G").alias("longest"))


@query(f"""SELECT user_id, CASE WHEN bool_or({_K} IN (1, 2)) THEN 'Yes' ELSE 'No' END AS low, CASE WHEN bool_or({_K} = 50) THEN 'Yes' ELSE 'No' END AS fifty, CASE WHEN bool_or({_K} NOT IN (1, 2, 50)) THEN 'Yes' ELSE 'No' END AS other FROM events GROUP BY 1""")
def prior_groups(spark, d):
    return pooling.prior_groups(_events(spark, d), "user_id", "k", {"low": [1, 2], "fifty": [50]})


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), m AS (SELECT user_id, arg_min(event_type, (-n, event_type)) AS event_type FROM c GROUP BY 1) SELECT m.user_id, m.event_type, round(avg(value), 6) AS value FROM m JOIN events USING (user_id) GROUP BY 1, 2""")
def modal_attributes(spark, d):
    return pooling.modal_attributes(_t(spark, d, "events"), "user_id", ["event_type"], ["value"]).withColumn("value", _R("value"))


@query(f"""WITH dim(k, category) AS (SELECT range, 'c' || CAST(range % 7 AS VARCHAR) FROM range(0, 100)), n AS (SELECT user_id, category, count(DISTINCT {_K}) AS n FROM events JOIN dim ON {_K} = dim.k GROUP BY 1, 2),
    b AS (SELECT DISTINCT user_id, 'c3' AS category, 1 AS n FROM events WHERE event_type = 'signup') SELECT user_id, category, CAST(sum(n) AS BIGINT) AS n FROM (SELECT * FROM n UNION ALL SELECT * FROM b) GROUP BY 1, 2""")
def condition_counts_with_bonus(spark, d):
    r = spark.range(100).withColumn("k", F.col("id").cast("int"))
    dim = r.select("k", F.concat(F.lit("c"), F.col("k") % 7).alias("category"))
    e = _events(spark, d)
    return pooling.condition_counts_with(e, dim, "user_id", "k", e.where("event_type = 'signup'"), "c3")


@query(f"""WITH dim(applies_to, category, k) AS (VALUES ('x', 'low', 1), ('x', 'low', 2), ('x', 'mid', 50), ('y', 'low', 2), ('y', 'high', 99)), u AS (SELECT DISTINCT user_id FROM events), p AS (SELECT DISTINCT applies_to, category FROM dim),
    h AS (SELECT DISTINCT user_id, applies_to, category FROM events JOIN dim ON {_K} = dim.k) SELECT u.user_id, p.applies_to, p.category, h.user_id IS NOT NULL AS present FROM u CROSS JOIN p LEFT JOIN h ON h.user_id = u.user_id AND h.applies_to = p.applies_to AND h.category = p.category""")
def any_of_conditions(spark, d):
    dim = spark.createDataFrame([("x", "low", 1), ("x", "low", 2), ("x", "mid", 50), ("y", "low", 2), ("y", "high", 99)], "applies_to string, category string, k int")
    return pooling.any_of(_events(spark, d), dim, "user_id", "k")


@query("""SELECT user_id, count(DISTINCT CASE WHEN event_type = 'purchase' THEN CAST(ts AS DATE) END) AS courses FROM events GROUP BY 1""")
def course_counts(spark, d):
    yes = F.when(F.col("event_type") == "purchase", "Yes").otherwise("No")
    return _t(spark, d, "events").groupBy("user_id").agg(pooling.course_count(F.col("ts"), yes).alias("courses"))


# ---- cohorts and whole jobs ------------------------------------------------------------------------------------------

@query("""SELECT c_custkey, floor(date_diff('day', DATE '1950-03-01', min(CAST(o_orderdate AS DATE))) / 365.25 / 10)::INT * 10 AS decade, round(date_diff('day', DATE '1950-03-01', min(CAST(o_orderdate AS DATE))) / 365.25, 6) AS age FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def ages_at_index(spark, d):
    first = _t(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderdate").alias("at"))
    age = dates.age_at(F.lit("1950-03-01").cast("date"), F.to_date("at"))
    return first.select("c_custkey", dates.age_decade(age).alias("decade"), _R(age).alias("age"))


@query(f"""WITH {_IDX} SELECT event_id FROM events JOIN idx USING (user_id) WHERE ts >= index_date AND ts < index_date + INTERVAL 4 DAY""")
def window_rows(spark, d):
    e = _t(spark, d, "events").join(_index(spark, d), "user_id")
    return e.where(dates.in_window(F.col("ts"), F.col("index_date"), F.col("index_date") + F.expr("interval 4 days"))).select("event_id")


@query(f"""WITH {_ARMS}, l AS (SELECT user_id, max(ts) AS latest FROM events WHERE event_type IN ('view', 'click') GROUP BY 1)
    SELECT a.user_id, a.exposed FROM arms a JOIN l USING (user_id) WHERE a.user_id % 50 >= 10 AND a.user_id % 50 < 40 AND l.latest > a.index_date + INTERVAL 20 DAY""")
def built_cohort(spark, d):
    e = _t(spark, d, "events")
    people = e.select("user_id").distinct().withColumn("age", F.col("user_id") % 50)
    out = jobs.build_cohort(e, e.where("event_type = 'purchase'"), people, [e.where("event_type = 'view'"), e.where("event_type = 'click'")], "user_id", "ts", F.col("event_type") == "signup", 3, 20, (10, 40), "age")
    return out.select("user_id", "exposed")


@query("""SELECT c_mktsegment, arm, count(*) AS n FROM (SELECT c_mktsegment, c_custkey % 2 AS arm, row_number() OVER (PARTITION BY c_custkey % 2 ORDER BY c_custkey) AS r FROM customer) WHERE r <= 40 GROUP BY 1, 2""")
def first_of_each_arm(spark, d):
    c = _t(spark, d, "customer").withColumn("arm", F.col("c_custkey") % 2)
    return sampling.per_class(c, "arm", 40, ["c_custkey"]).groupBy("c_mktsegment", "arm").agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE 0 END AS arm FROM customer) SELECT count(*) FILTER (WHERE arm = 1) AS cases, count(*) FILTER (WHERE arm = 0) AS controls FROM p""")
def match_report(spark, d):
    people = _t(spark, d, "customer").withColumn("arm", F.when(F.col("c_custkey") % 5 == 0, 1).otherwise(0)).withColumn("balance", F.col("c_acctbal") / 100)
    pairs = cohort.match(people.select("c_custkey", "arm", "c_mktsegment", "balance"), "c_custkey", "arm", ["c_mktsegment"], "balance", 5.0, 1)
    s = exports.match_stats(people, pairs, "arm", "case", "control")
    return s.where("pairs = used_cases and pairs = used_controls and pairs > 0").select("cases", "controls")


@query(f"""WITH f AS (SELECT CAST(user_id AS VARCHAR) AS entity_id, event_type, min(ts) AS date FROM events GROUP BY 1, 2), a AS (SELECT user_id, max(ts) AS last FROM events GROUP BY 1)
    SELECT entity_id, 'first_event' AS feature_name, event_type AS keyword, 'Yes' AS prediction FROM f UNION ALL SELECT CAST(user_id AS VARCHAR), 'last_activity', NULL, strftime(last, '%Y-%m-%d') FROM a""")
def extracted_features(spark, d):
    e = _events(spark, d).withColumn("code", F.col("k").cast("string"))
    last = features.last_activity([e.select("user_id", "ts")], "user_id", "ts")
    out = jobs.extract([features.coded(e, "user_id", "ts", "code", "event_type", "first_event"), features.activity_records(last, "user_id")])
    return out.select("entity_id", "feature_name", "keyword", "prediction")


@query("""WITH a AS (SELECT user_id, max(ts) AS last FROM events WHERE event_type IN ('view', 'click') GROUP BY 1), b AS (SELECT user_id, min(ts) AS death FROM events WHERE event_type = 'error' GROUP BY 1)
    SELECT a.user_id, a.last AS last_activity, b.death, b.death IS NOT NULL AS deceased FROM a LEFT JOIN b USING (user_id)""")
def last_activities(spark, d):
    e = _t(spark, d, "events").select("user_id", "ts", "event_type")
    tables = [e.where("event_type = 'view'"), e.where("event_type = 'click'")]
    return features.last_activity(tables, "user_id", "ts", e.where("event_type = 'error'"))


@query(f"""WITH {_LAB} SELECT lang, count(*) AS n, round(avg(CAST(quality AS DOUBLE)), 6) AS rate FROM lab GROUP BY 1""")
def outcome_rates(spark, d):
    return jobs.outcome_rates(_lab(spark, d), "lang", "quality").withColumn("rate", _R("rate"))


@query(f"""WITH {_LAB}, s AS (SELECT t / 100.0 AS threshold, count(*) FILTER (WHERE quality = 1 AND score > t / 100.0) AS tp, count(*) FILTER (WHERE quality = 0 AND score > t / 100.0) AS fp, count(*) FILTER (WHERE quality = 1 AND NOT score > t / 100.0) AS fn FROM lab, range(1, 100) r(t) GROUP BY t)
    SELECT round(max(CASE WHEN tp + fn > 0 AND tp / (tp + fn) >= 0.75 THEN CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END END), 6) AS precision, round(max(CASE WHEN tp + fp > 0 AND tp / (tp + fp) >= 0.5 THEN tp / (tp + fn) END), 6) AS recall FROM s""")
def fixed_points(spark, d):
    lab = _lab(spark, d).withColumn("score", F.when(F.col("n_chars") >= 6000, 1.0).otherwise(F.col("score")))
    s = evalm.sweep(lab, "quality", "score")
    p, r = evalm.precision_at_recall(s, 0.75), evalm.recall_at_precision(s, 0.5)
    return p.join(r).select(_R("precision").alias("precision"), _R("recall").alias("recall"))
