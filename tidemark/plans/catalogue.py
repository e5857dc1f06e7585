"""Registered queries over the given tables, and the SQL that each is compared with.

Roles of the tables: ``events`` holds dated facts of an entity (user_id), with sign-up as index, purchase as
exposure, error as outcome and k of ``props`` as code; ``documents`` are notes of a patient (source); ``conversations``
are ordered sentences; ``labels`` are gold and predicted values; ``customer``, ``orders`` and ``part`` give covariates, long
histories and codes with prefixes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import dates, rules, text
from tidemark.operators import asof, codes, cohort, corpus, evalm, features, history, pooling, quality, sampling, scoring, stats
from tidemark.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return tables.read(spark, d, name)


def _events(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))


def _index(spark: SparkSession, d: str) -> DataFrame:
    return cohort.index_dates(_t(spark, d, "events"), "user_id", "ts", F.col("event_type") == "signup")


def _arms(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events")
    return cohort.assign_arms(_index(spark, d), e.where("event_type = 'purchase'"), "user_id", "ts", 3)


# as the SQL rounds: the product, which may fall below a half that the decimal digits reach (0.5203125 at six places)
_R = lambda c, n=6: F.round((F.col(c) if isinstance(c, str) else c) * F.lit(10.0**n)) / F.lit(10.0**n)
_IDX = "idx AS (SELECT user_id, min(ts) AS index_date FROM events WHERE event_type = 'signup' GROUP BY user_id)"
_ARMS = _IDX + """, arms AS (SELECT i.user_id, i.index_date, bool_or(coalesce(e.ts >= i.index_date AND e.ts < i.index_date + INTERVAL 3 DAY, false)) AS exposed, count(e.ts) > 0 AS seen
    FROM idx i LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') e ON e.user_id = i.user_id GROUP BY ALL)"""
_K = "CAST(json_extract_string(props, '$.k') AS INT)"


# ---- cohort ----------------------------------------------------------------------------------------------------------

@query(f"""WITH {_ARMS}, o AS (SELECT a.user_id, a.exposed, bool_or(coalesce(e.ts >= a.index_date + INTERVAL 26 DAY, false)) AS outcome
    FROM arms a LEFT JOIN (SELECT * FROM events WHERE event_type = 'error') e ON e.user_id = a.user_id GROUP BY ALL)
    SELECT exposed, count(*) AS n, count(*) FILTER (WHERE outcome) AS outcomes, round(avg(CAST(outcome AS INT)), 6) AS rate FROM o GROUP BY exposed""")
def outcome_by_exposure(spark, d):
    arms = _arms(spark, d).select("user_id", "index_date", "exposed")
    e = _t(spark, d, "events").where("event_type = 'error'").select("user_id", "ts")
    late = F.coalesce(F.bool_or(dates.days_between(F.col("ts"), F.col("index_date")) >= 26), F.lit(False))
    o = arms.join(e, "user_id", "left").groupBy("user_id", "exposed").agg(late.alias("outcome"))
    return o.groupBy("exposed").agg(F.count("*").alias("n"), F.count_if("outcome").alias("outcomes"), _R(F.avg(F.col("outcome").cast("int"))).alias("rate"))


@query(f"WITH {_ARMS} SELECT user_id, exposed, NOT exposed AND seen AS outside_only FROM arms")
def study_arms(spark, d):
    return _arms(spark, d).select("user_id", "exposed", "outside_only")


@query(f"""WITH {_IDX}, l AS (SELECT user_id, max(ts) AS latest FROM events WHERE event_type IN ('view', 'click') GROUP BY user_id)
    SELECT i.user_id, i.index_date FROM idx i JOIN l USING (user_id) WHERE l.latest > i.index_date + INTERVAL 20 DAY""")
def note_coverage(spark, d):
    e = _t(spark, d, "events")
    return cohort.coverage_filter(_index(spark, d), [e.where("event_type = 'view'"), e.where("event_type = 'click'")], "user_id", "ts", 20)


@query("""WITH f AS (SELECT o_custkey, min(o_orderdate) AS first FROM orders WHERE o_orderpriority LIKE '1%' GROUP BY 1),
    l AS (SELECT o_custkey, max(o_orderdate) AS last FROM orders GROUP BY 1),
    h AS (SELECT o_custkey, min(o_orderdate) AS hit FROM orders WHERE o_totalprice > 250000 GROUP BY 1)
    SELECT f.o_custkey, CAST(coalesce(h.hit >= f.first + INTERVAL 730 DAY, false) AS INT) AS had_event,
      round(date_diff('microsecond', f.first + INTERVAL 730 DAY, CASE WHEN h.hit >= f.first + INTERVAL 730 DAY THEN h.hit ELSE l.last END) / 86400000000.0 / 365.25, 6) AS years
    FROM f JOIN l USING (o_custkey) LEFT JOIN h USING (o_custkey)""")
def follow_up_clock(spark, d):
    o = _t(spark, d, "orders")
    f = cohort.index_dates(o, "o_custkey", "o_orderdate", codes.like_any(F.col("o_orderpriority"), ["1%"]))
    l = o.groupBy("o_custkey").agg(F.max("o_orderdate").alias("last"))
    h = o.where("o_totalprice > 250000").groupBy("o_custkey").agg(F.min("o_orderdate").alias("hit"))
    wide = f.join(l, "o_custkey").join(h, "o_custkey", "left").withColumn("death", F.lit(None).cast("timestamp"))
    return cohort.followup(wide, "index_date", "last", "death", "hit").select("o_custkey", "had_event", _R("years").alias("years"))


@query()
def matched_pairs(spark, d):
    people = _t(spark, d, "customer").withColumn("arm", F.when(F.col("c_custkey") % 5 == 0, 1).otherwise(0)).withColumn("balance", F.col("c_acctbal") / 100)
    return cohort.match(people.select("c_custkey", "arm", "c_mktsegment", "c_nationkey", "balance"), "c_custkey", "arm", ["c_mktsegment", "c_nationkey"], "balance", 5.0, 1)


@query("""WITH RECURSIVE p AS (SELECT c_custkey AS id, CAST(c_custkey % 5 = 0 AS INT) AS arm, c_mktsegment AS s, c_nationkey AS n, c_acctbal / 100 AS x FROM customer),
    a AS (SELECT *, row_number() OVER (PARTITION BY s, n ORDER BY x, id) AS i FROM p WHERE arm = 1), b AS (SELECT *, row_number() OVER (PARTITION BY s, n ORDER BY x, id) AS j FROM p WHERE arm = 0),
    o AS (SELECT s, n, j, x, id FROM b UNION ALL SELECT DISTINCT s, n, CAST(NULL AS BIGINT), CAST(NULL AS DOUBLE), CAST(NULL AS BIGINT) FROM a),
    r AS (SELECT DISTINCT s, n, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS j, 0 AS pairs, CAST(0 AS DOUBLE) AS d, CAST([] AS STRUCT(c BIGINT, d BIGINT)[]) AS found FROM a
        UNION ALL SELECT r.s, r.n, a.i, coalesce(o.j, r.j), r.pairs + CASE WHEN o.j IS NULL THEN 0 ELSE 1 END, r.d + coalesce(abs(a.x - o.x), 0), CASE WHEN o.j IS NULL THEN found ELSE list_append(found, {'c': a.id, 'd': o.id}) END
        FROM r JOIN a ON a.s = r.s AND a.n = r.n AND a.i = r.i + 1 JOIN o ON o.s = r.s AND o.n = r.n AND (o.j IS NULL OR (o.j > r.j AND abs(a.x - o.x) <= 5))),
    e AS (SELECT s, n, max(i) AS i FROM a GROUP BY 1, 2), best AS (SELECT arg_min(found, {'p': -pairs, 'd': d}) AS found FROM r JOIN e USING (s, n, i) GROUP BY s, n)
    SELECT f.c AS case_id, f.d AS control_id FROM (SELECT unnest(found) AS f FROM best)""")
def pairs_by_number(spark, d):
    people = _t(spark, d, "customer").withColumn("arm", (F.col("c_custkey") % 5 == 0).cast("int")).withColumn("balance", F.col("c_acctbal") / 100)
    return cohort.match_round(people, "c_custkey", "arm", ["c_mktsegment", "c_nationkey"], "balance", 5.0).select(F.col("case").alias("case_id"), F.col("control").alias("control_id"))


# ---- as-of and interval joins ----------------------------------------------------------------------------------------

@query(f"""WITH {_IDX} SELECT i.user_id, arg_max(e.value, (e.ts, e.event_id)) AS value FROM idx i JOIN events e USING (user_id)
    WHERE e.ts <= i.index_date + INTERVAL 5 DAY AND e.value IS NOT NULL GROUP BY i.user_id""")
def latest_before(spark, d):
    return asof.latest_before(_t(spark, d, "events"), _index(spark, d), "user_id", "ts", "value", cutoff_days=5, tie="event_id").select("user_id", "value")


@query(f"""WITH {_IDX}, r AS (SELECT i.user_id, e.value, row_number() OVER (PARTITION BY i.user_id ORDER BY abs(date_diff('microsecond', i.index_date, e.ts)), e.ts, e.event_id) AS n
    FROM idx i JOIN events e USING (user_id) WHERE e.event_type = 'view' AND e.value IS NOT NULL AND e.ts <= i.index_date + INTERVAL 2 DAY) SELECT user_id, value FROM r WHERE n = 1""")
def nearest_value(spark, d):
    return asof.nearest(_t(spark, d, "events").where("event_type = 'view'"), _index(spark, d), "user_id", "ts", "value", max_after=2, tie="event_id")


@query("""SELECT a.event_id AS error_id, b.event_id AS click_id FROM events a JOIN events b ON a.user_id = b.user_id
    WHERE a.event_type = 'error' AND b.event_type = 'click' AND b.ts >= a.ts - INTERVAL 6 HOUR AND b.ts < a.ts + INTERVAL 6 HOUR""")
def interval_pairs(spark, d):
    e = _t(spark, d, "events")
    a = e.where("event_type = 'error'").select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("error_id"))
    b = e.where("event_type = 'click'").select("user_id", "ts", F.col("event_id").alias("click_id"))
    return asof.within_days(a, b, "user_id", "at", "ts", 0.25, 0.25).select("error_id", "click_id")


@query(f"""WITH {_IDX} SELECT user_id, CAST(floor(date_diff('microsecond', index_date, ts) / 604800000000.0) AS INT) AS block, count(*) AS n, round(sum(value), 4) AS total
    FROM events JOIN idx USING (user_id) WHERE ts >= index_date GROUP BY 1, 2""")
def time_blocks(spark, d):
    e = _t(spark, d, "events").join(_index(spark, d), "user_id").where("ts >= index_date")
    return dates.time_blocks(e, "ts", "index_date", weeks=1).groupBy("user_id", "block").agg(F.count("*").alias("n"), _R(F.sum("value"), 4).alias("total"))


@query(f"""WITH {_IDX}, p AS (SELECT user_id, date_diff('microsecond', index_date, ts) / 86400000000.0 AS g FROM events JOIN idx USING (user_id))
    SELECT CASE WHEN g <= 0 THEN 'pre_index' WHEN g < 14 THEN 'treatment' ELSE 'outcome' END AS period, count(*) AS n, count(DISTINCT user_id) AS users FROM p GROUP BY 1""")
def study_periods(spark, d):
    e = _t(spark, d, "events").join(_index(spark, d), "user_id")
    return e.withColumn("period", dates.classify_period(F.col("ts"), F.col("index_date"), 14)).groupBy("period").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query("""SELECT e.user_id, max(e.ts) AS last_activity, min(CASE WHEN event_type = 'error' THEN ts END) AS earliest_error, bool_or(event_type = 'error') AS has_error FROM events e GROUP BY e.user_id""")
def last_activity(spark, d):
    return _t(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("last_activity"), F.min(F.when(F.col("event_type") == "error", F.col("ts"))).alias("earliest_error"), F.bool_or(F.col("event_type") == "error").alias("has_error"))


# ---- codes -----------------------------------------------------------------------------------------------------------

_DIM = "dim(prefix, label, ord) AS (VALUES ('Brand#1', 'ones', 3), ('Brand#13', 'thirteen', 1), ('Brand#2', 'twos', 2), ('Brand#4', 'fours', 4), ('Brand', 'any', 9))"


def _dim(spark):
    return spark.createDataFrame([("Brand#1", "ones", 3), ("Brand#13", "thirteen", 1), ("Brand#2", "twos", 2), ("Brand#4", "fours", 4), ("Brand", "any", 9)], "prefix string, label string, ord int")


@query(f"""WITH {_DIM} SELECT p_partkey, arg_max(label, length(prefix)) AS label, max(prefix) AS matched_prefix FROM part JOIN dim ON starts_with(p_brand, prefix) GROUP BY p_partkey""")
def longest_prefix(spark, d):
    return codes.prefix_join(_t(spark, d, "part"), _dim(spark), "p_brand", "prefix").select("p_partkey", "label", "matched_prefix")


@query(f"""WITH {_DIM} SELECT p_partkey, coalesce(arg_min(label, ord), max(p_type)) AS label FROM part LEFT JOIN dim ON starts_with(p_brand, prefix) GROUP BY p_partkey""")
def first_prefix_label(spark, d):
    return codes.label_or_code(_t(spark, d, "part"), _dim(spark), "p_brand", "prefix", "label", "ord").select("p_partkey", "label")


@query(f"""WITH c AS (SELECT event_id, CAST({_K} AS VARCHAR) || '.' || CAST(event_id % 10 AS VARCHAR) AS code FROM events), dim(code, category) AS (VALUES ('20', 'a'), ('35.0', 'b'), ('35', 'c'), ('7', 'd'), ('71.5', 'e'))
    SELECT event_id, CASE WHEN c.code IN ('35.0', '71.5') THEN (SELECT category FROM dim WHERE dim.code = c.code) ELSE (SELECT category FROM dim WHERE dim.code = split_part(c.code, '.', 1)) END AS category
    FROM c WHERE split_part(c.code, '.', 1) IN ('20', '35', '7') OR c.code = '71.5'""")
def boundary_prefix(spark, d):
    facts = _events(spark, d).select("event_id", F.concat_ws(".", F.col("k").cast("string"), (F.col("event_id") % 10).cast("string")).alias("fact_code"))
    dim = spark.createDataFrame([("20", "a"), ("35.0", "b"), ("35", "c"), ("7", "d"), ("71.5", "e")], "code string, category string")
    return codes.boundary_match(facts, dim, "fact_code").where("category is not null").select("event_id", "category")


@query("""SELECT event_id FROM events WHERE (event_type, CAST(json_extract_string(props, '$.k') AS INT)) IN (('click', 1), ('click', 2), ('view', 3))""")
def coded_pairs(spark, d):
    wanted = spark.createDataFrame([("click", 1), ("click", 2), ("view", 3), ("view", 3)], "event_type string, k int")
    return codes.pair_semi(_events(spark, d), wanted, ["event_type", "k"]).select("event_id")


@query(f"""SELECT user_id, feature, count(*) AS n, count(DISTINCT CAST(ts AS DATE)) AS n_dates FROM events JOIN (VALUES ('low', 'click', '1'), ('low', 'click', '2'), ('low', 'click', '12'), ('nine', 'view', '9')) AS f(feature, code_type, prefix)
    ON event_type = code_type AND starts_with(CAST({_K} AS VARCHAR), prefix) WHERE NOT (prefix = '12') GROUP BY 1, 2""")
def code_set_flags(spark, d):
    e = _events(spark, d).withColumn("code", F.col("k").cast("string"))
    dim = spark.createDataFrame([("low", "click", "1"), ("low", "click", "2"), ("low", "click", "12"), ("nine", "view", "9")], "feature string, code_type string, prefix string")
    return codes.code_flags(e, dim, "user_id", "code", "event_type", "ts")


@query("""SELECT p_partkey FROM part WHERE p_type LIKE 'ECONOMY%' OR p_type LIKE '%BRASS'""")
def types_like(spark, d):
    return _t(spark, d, "part").where(codes.like_any(F.col("p_type"), ["ECONOMY%", "%BRASS"])).select("p_partkey")


# ---- pooling ---------------------------------------------------------------------------------------------------------

@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY 1, 2) SELECT user_id, arg_min(event_type, (-n, f)) AS event_type FROM c GROUP BY 1""")
def pooled_majority(spark, d):
    return pooling.majority(_t(spark, d, "events"), ["user_id"], "event_type", "event_id")


@query("SELECT user_id, bool_or(event_type = 'error') AS any_error, bool_or(event_type = 'signup') AS any_signup FROM events GROUP BY 1")
def pooled_any(spark, d):
    return _t(spark, d, "events").groupBy("user_id").agg(pooling.any_equal(F.col("event_type"), "error").alias("any_error"), pooling.any_equal(F.col("event_type"), "signup").alias("any_signup"))


@query(f"""WITH e AS (SELECT user_id, event_type, event_id, {_K} AS k, array_position(['view', 'click', 'purchase'], event_type) AS rank FROM events)
    SELECT user_id, CASE WHEN count(k) = 0 THEN 'F' ELSE CAST(coalesce(sum(DISTINCT CASE WHEN k > 0 THEN k END), 0) AS VARCHAR) END AS duration, CAST(max(k) AS VARCHAR) AS top,
      coalesce(arg_max(event_type, rank) FILTER (WHERE rank > 0), arg_min(event_type, event_id)) AS stage FROM e GROUP BY 1""")
def pooled_rules(spark, d):
    e, k = _events(spark, d), F.col("k").cast("string")
    return e.groupBy("user_id").agg(pooling.distinct_duration(k).alias("duration"), pooling.numeric_max(k).alias("top"), pooling.highest_ranked(F.col("event_type"), F.col("event_id"), ["view", "click", "purchase"]).alias("stage"))


@query("""SELECT user_id, max(CASE WHEN event_type = 'click' THEN 'Yes' END) AS click, max(CASE WHEN event_type = 'error' THEN 'Yes' END) AS error,
    max(CASE WHEN event_type = 'purchase' THEN 'Yes' END) AS purchase FROM events GROUP BY 1""")
def pivot_presence(spark, d):
    return pooling.to_wide(_t(spark, d, "events").withColumn("yes", F.lit("Yes")), "user_id", "event_type", "yes", ["click", "error", "purchase"])


@query(f"""WITH dim(k, category) AS (SELECT range, 'c' || CAST(range % 7 AS VARCHAR) FROM range(0, 100) UNION ALL SELECT range, 'even' FROM range(0, 100, 2))
    SELECT user_id, category, count(DISTINCT {_K}) AS n FROM events JOIN dim ON {_K} = dim.k GROUP BY 1, 2""")
def condition_counts(spark, d):
    r = spark.range(100).withColumn("k", F.col("id").cast("int"))
    dim = r.select("k", F.concat(F.lit("c"), F.col("k") % 7).alias("category")).union(r.where("k % 2 = 0").select("k", F.lit("even").alias("category")))
    return pooling.condition_counts(_events(spark, d), dim, "user_id", "k")


@query(f"""WITH s AS (SELECT user_id, sum({_K}) AS days FROM events WHERE event_type = 'purchase' GROUP BY 1), u AS (SELECT DISTINCT user_id FROM events)
    SELECT CASE WHEN days IS NULL THEN 'Unknown' WHEN days < 1 THEN 'None' WHEN days < 30 THEN '1-29' WHEN days < 90 THEN '30-89' WHEN days < 365 THEN '90-364' ELSE '365+' END AS bin, count(*) AS n
    FROM u LEFT JOIN s USING (user_id) GROUP BY 1""")
def dose_bins(spark, d):
    e = _events(spark, d)
    s = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.sum("k").alias("days"))
    return e.select("user_id").distinct().join(s, "user_id", "left").groupBy(pooling.dose_bins(F.col("days")).alias("bin")).agg(F.count("*").alias("n"))


# ---- text ------------------------------------------------------------------------------------------------------------

_HIT = lambda c, k: f"regexp_matches({c}, '(?i)(^|[^\\p{{L}}\\p{{N}}_]){k}($|[^\\p{{L}}\\p{{N}}_])')"


@query(f"""SELECT doc_id, concat_ws(',', CASE WHEN {_HIT('text', 'the')} THEN 'the' END, CASE WHEN {_HIT('text', 'que')} THEN 'que' END, CASE WHEN {_HIT('text', 'der')} THEN 'der' END) AS found FROM documents""")
def keyword_hits(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.array_join(text.keywords(F.col("text"), ["the", "que", "der"]), ",").alias("found"))


@query("""SELECT doc_id FROM documents WHERE (contains(lower(text), 'tion') OR contains(lower(text), 'ción')) AND contains(lower(text), 'th')""")
def keyword_groups(spark, d):
    return _t(spark, d, "documents").where(text.require_all(F.col("text"), [["tion", "ción"], ["th"]], "substring")).select("doc_id")


@query(f"SELECT source, arg_min(doc_id, (doc_id % 97, doc_id)) AS doc_id FROM documents WHERE {_HIT('text', 'the')} GROUP BY source")
def one_per_source(spark, d):
    hits = _t(spark, d, "documents").where(F.size(text.keywords(F.col("text"), ["the"])) > 0)
    return sampling.one_per_key(hits.select("source", "doc_id"), "source", [F.col("doc_id") % 97, F.col("doc_id")])


@query("""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') AS w FROM documents), s AS (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 20, 1), 180)) AS s FROM w WHERE len(w) > 0)
    SELECT doc_id, CAST(s // 180 AS INT) AS chunk_index, array_to_string(w[s + 1 : s + 200], ' ') AS chunk FROM s""")
def note_chunks(spark, d):
    return text.chunk(_t(spark, d, "documents").select("doc_id", "text"), "text").select("doc_id", "chunk_index", "chunk")


@query("""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') AS w FROM documents), h AS (SELECT doc_id, w, unnest(range(0, len(w))) AS hit FROM w)
    SELECT doc_id, CAST(hit AS INT) AS hit, array_to_string(w[greatest(hit - 5, 0) + 1 : hit + 6], ' ') AS context FROM h WHERE """ + _HIT("w[hit + 1]", "with"))
def keyword_context(spark, d):
    return text.keyword_in_context(_t(spark, d, "documents").select("doc_id", "text"), "text", "with", 5).select("doc_id", "hit", "context")


# ---- evaluation ------------------------------------------------------------------------------------------------------

_LAB = "lab AS (SELECT l.doc_id, d.lang, l.quality, l.toxic, CAST(d.n_chars > 1500 AS INT) AS pred, least(d.n_chars / 6000.0, 1.0) AS score, d.n_chars FROM labels l JOIN documents d USING (doc_id))"


def _lab(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "lang", "n_chars")
    return _t(spark, d, "labels").join(docs, "doc_id").withColumns({"pred": (F.col("n_chars") > 1500).cast("int"), "score": F.least(F.col("n_chars") / F.lit(6000.0), F.lit(1.0))})


@query(f"WITH {_LAB} SELECT quality AS gt, pred, count(*) AS n FROM lab GROUP BY 1, 2")
def confusion(spark, d):
    return evalm.confusion(_lab(spark, d), "quality", "pred")


@query(f"WITH {_LAB} SELECT lang, count(*) AS n, round(avg(CAST(quality = pred AS INT)), 6) AS accuracy FROM lab GROUP BY 1")
def accuracy_by_lang(spark, d):
    return evalm.accuracy(_lab(spark, d), "quality", "pred", ["lang"]).withColumn("accuracy", _R("accuracy"))


@query(f"""WITH {_LAB}, s AS (SELECT t / 100.0 AS threshold, count(*) FILTER (WHERE quality = 1 AND score > t / 100.0) AS tp, count(*) FILTER (WHERE quality = 0 AND score > t / 100.0) AS fp,
    count(*) FILTER (WHERE quality = 1 AND NOT score > t / 100.0) AS fn FROM lab, range(1, 100) r(t) GROUP BY t) SELECT threshold, tp, fp, fn,
    round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1 FROM s""")
def threshold_sweep(spark, d):
    lab = _lab(spark, d).withColumn("score", F.when(F.col("n_chars") >= 6000, 1.0).otherwise(F.col("score")))
    s = evalm.sweep(lab, "quality", "score")
    return s.withColumns({c: _R(c) for c in ("precision", "recall", "f1")})


@query(f"""WITH {_LAB}, p AS (SELECT a.lang, avg(CASE WHEN a.n_chars > b.n_chars THEN 1.0 WHEN a.n_chars = b.n_chars THEN 0.5 ELSE 0.0 END) AS auc FROM lab a JOIN lab b ON a.lang = b.lang AND a.quality = 1 AND b.quality = 0 GROUP BY 1)
    SELECT l.lang, round(p.auc, 6) AS auc FROM (SELECT DISTINCT lang FROM lab) l LEFT JOIN p USING (lang)""")
def auc_by_lang(spark, d):
    return evalm.auc(_lab(spark, d), "quality", "n_chars", ["lang"]).withColumn("auc", _R("auc"))


@query(f"""WITH {_LAB} SELECT round(avg(CASE WHEN a.n_chars > b.n_chars THEN 1.0 WHEN a.n_chars = b.n_chars THEN 0.5 ELSE 0.0 END), 6) AS auc FROM lab a, lab b WHERE a.quality = 1 AND b.quality = 0""")
def auc_overall(spark, d):
    return evalm.auc(_lab(spark, d), "quality", "n_chars").select(_R("auc").alias("auc"))


@query(f"""WITH {_LAB}, c AS (SELECT lang, count(*) FILTER (WHERE quality = 1 AND pred = 1) AS tp, count(*) FILTER (WHERE quality = 0 AND pred = 1) AS fp, count(*) FILTER (WHERE quality = 1 AND pred = 0) AS fn FROM lab GROUP BY 1)
    SELECT lang, tp, fp, fn, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1, round(CASE WHEN tp + fp + fn > 0 THEN tp / (tp + fp + fn) ELSE 0 END, 6) AS jaccard FROM c""")
def label_metrics(spark, d):
    m = evalm.multilabel(_lab(spark, d), "lang", "quality", "pred")
    return m.select("lang", "tp", "fp", "fn", _R("f1").alias("f1"), _R("jaccard").alias("jaccard"))


@query(f"""WITH {_LAB}, e AS (SELECT lang, CASE WHEN quality = 0 THEN CASE WHEN toxic = 0 THEN 0.0 ELSE 100.0 END ELSE least(100.0, abs(toxic - quality) * 100.0) END AS pe, abs(toxic - quality) AS ae FROM lab)
    SELECT lang, round(avg(pe), 6) AS percent_error, round(avg(ae), 6) AS absolute_error FROM e GROUP BY 1""")
def numeric_errors(spark, d):
    lab = _lab(spark, d).withColumns({"q": F.col("quality").cast("string"), "x": F.col("toxic").cast("string")})
    return evalm.numeric_error(lab, "q", "x", ["lang"]).withColumns({c: _R(c) for c in ("percent_error", "absolute_error")})


# ---- histories -------------------------------------------------------------------------------------------------------

@query("""SELECT event_id, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS best FROM events WHERE value > 0""")
def running_best(spark, d):
    return history.running_best(_t(spark, d, "events"), ["user_id"], ["ts", "event_id"], "value").select("event_id", "best")


@query(f"""WITH e AS (SELECT *, {_K} AS k FROM events WHERE value IS NOT NULL), b AS (SELECT *, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM e WHERE k IS NOT NULL),
    m AS (SELECT *, CASE WHEN prev IS NULL OR value > prev THEN k END AS fresh FROM b)
    SELECT event_id, last_value(fresh IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS at_best FROM m""")
def value_at_best(spark, d):
    return history.value_at_best(_events(spark, d), ["user_id"], ["ts", "event_id"], "value", "k").select("event_id", "at_best")


@query("""WITH m AS (SELECT event_type, avg(value) AS mean FROM events GROUP BY 1) SELECT event_type, round(mean, 6) AS mean, CAST(rank() OVER (ORDER BY mean DESC) AS INT) AS rank FROM m""")
def rank_methods(spark, d):
    return history.rank_methods(_t(spark, d, "events"), "event_type", "value").withColumn("mean", _R("mean"))


@query("""WITH b AS (SELECT user_id, event_id, ts, value, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM events WHERE value IS NOT NULL)
    SELECT event_id, coalesce(prev IS NULL OR value > prev, false) AS accepted, greatest(value, prev) AS best FROM b""")
def accept_history(spark, d):
    return history.accept_history(_t(spark, d, "events").where("value is not null"), ["user_id"], ["ts", "event_id"], "value").select("event_id", "accepted", "best")


@query(f"""WITH s AS (SELECT user_id, value AS y, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE value IS NOT NULL),
    p AS (SELECT DISTINCT user_id, n, r.p FROM s, range(0, 11) r(p)), a AS (SELECT user_id, p, n, p / 10.0 * (n - 1) AS at, CAST(floor(p / 10.0 * (n - 1)) AS BIGINT) AS low FROM p)
    SELECT a.user_id, CAST(a.p AS INT) AS point, round(l.y + (a.at - a.low) * (h.y - l.y), 6) AS value FROM a JOIN s l ON l.user_id = a.user_id AND l.i = a.low JOIN s h ON h.user_id = a.user_id AND h.i = least(a.low + 1, a.n - 1)""")
def resampled_curves(spark, d):
    e = _t(spark, d, "events").where("value is not null").select("user_id", "event_id", "value")
    return history.resample(e, ["user_id"], "event_id", "value").withColumn("value", _R("value"))


@query("""SELECT event_type, round(sum(value * event_id) / sum(event_id), 6) AS value FROM events WHERE value IS NOT NULL GROUP BY 1""")
def weighted_means(spark, d):
    return history.weighted_curve(_t(spark, d, "events").where("value is not null"), ["event_type"], "value", "event_id").withColumn("value", _R("value"))


# ---- ordered sentences -----------------------------------------------------------------------------------------------

@query("""WITH c AS (SELECT *, CASE WHEN role = 'system' OR length(text) < 40 THEN turn END AS b FROM conversations),
    m AS (SELECT *, last_value(b IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS f,
      first_value(b IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS t FROM c)
    SELECT m.conv_id, m.turn, string_agg(x.text, ' ' ORDER BY x.turn) AS context FROM m JOIN conversations x ON x.conv_id = m.conv_id AND (m.f IS NULL OR x.turn >= m.f) AND (m.t IS NULL OR x.turn <= m.t)
    WHERE m.role = 'user' GROUP BY 1, 2""")
def context_expand(spark, d):
    c = _t(spark, d, "conversations")
    return corpus.expand_context(c, "conv_id", "turn", (F.col("role") == "system") | (F.length("text") < 40), "text", F.col("role") == "user")


@query("""SELECT conv_id, turn, coalesce(lag(role) OVER w, '<s>') AS before, coalesce(lead(role) OVER w, '</s>') AS after, round((row_number() OVER w - 1) / count(*) OVER (PARTITION BY conv_id), 6) AS position
    FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def sentence_neighbours(spark, d):
    n = corpus.neighbours(_t(spark, d, "conversations"), "conv_id", "turn", "role")
    return n.select("conv_id", "turn", F.get("before", F.lit(0)).alias("before"), F.get("after", F.lit(0)).alias("after"), _R("position").alias("position"))


@query("""WITH m AS (SELECT *, CASE WHEN role = 'user' THEN 1 WHEN length(text) < 60 THEN 0 END AS mark FROM conversations)
    SELECT conv_id, turn, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), 0) = 1 AS inside FROM m""")
def section_state(spark, d):
    return corpus.section_state(_t(spark, d, "conversations"), "conv_id", "turn", F.col("role") == "user", F.length("text") < 60).select("conv_id", "turn", "inside")


@query("""WITH s AS (SELECT *, min(CASE WHEN role = 'assistant' THEN turn END) OVER (PARTITION BY conv_id) AS stop FROM conversations) SELECT conv_id, turn FROM s WHERE stop IS NULL OR turn <= stop""")
def short_circuit(spark, d):
    return corpus.short_circuit(_t(spark, d, "conversations"), ["conv_id"], "turn", F.col("role") == "assistant").select("conv_id", "turn")


@query("""WITH t AS (SELECT event_id, user_id, CAST(epoch(ts) AS BIGINT) AS s, CAST(epoch(ts) AS BIGINT) + 600 AS e FROM events WHERE event_type = 'view'), p AS (SELECT user_id, event_type AS type, CAST(epoch(ts) AS BIGINT) AS s, CAST(epoch(ts) AS BIGINT) + 3600 AS e FROM events WHERE event_type IN ('click', 'error'))
    SELECT t.event_id, coalesce(string_agg(DISTINCT p.type, ',' ORDER BY p.type), '') AS types FROM t LEFT JOIN p ON p.user_id = t.user_id AND t.s <= p.e AND p.s <= t.e GROUP BY 1""")
def span_overlap(spark, d):
    # the nearest second, the even one of two that are equally near
    e = _t(spark, d, "events").withColumn("start", F.rint(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).cast("long"))
    tokens = e.where("event_type = 'view'").select("user_id", "event_id", "start", (F.col("start") + 600).alias("end"))
    spans = e.where("event_type in ('click', 'error')").select("user_id", F.col("event_type").alias("type"), "start", (F.col("start") + 3600).alias("end"))
    return corpus.span_overlap(tokens, spans, "user_id", ["event_id"]).select("event_id", F.array_join("types", ",").alias("types"))


# ---- statistics ------------------------------------------------------------------------------------------------------

_SURV = "surv AS (SELECT c_custkey, CAST(c_nationkey % 2 AS INT) AS arm, CAST(c_acctbal / 1000 AS INT) + 2 AS t, CAST(c_custkey % 3 > 0 AS INT) AS e FROM customer)"


def _surv(spark, d):
    c = _t(spark, d, "customer")
    return c.select("c_custkey", (F.col("c_nationkey") % 2).alias("arm"), (F.rint(F.col("c_acctbal") / 1000) + 2).cast("int").alias("t"), (F.col("c_custkey") % 3 > 0).cast("int").alias("e"), "c_acctbal", "c_mktsegment")


@query(f"""WITH {_SURV}, c AS (SELECT arm, t AS time, count(*) FILTER (WHERE e = 1) AS events, count(*) FILTER (WHERE e = 0) AS censored FROM surv GROUP BY 1, 2),
    r AS (SELECT *, CAST(sum(events + censored) OVER (PARTITION BY arm ORDER BY time DESC) AS BIGINT) AS at_risk FROM c)
    SELECT arm, time, at_risk, events, censored, round(CASE WHEN min(1 - events / at_risk) OVER w <= 0 THEN 0 ELSE exp(sum(ln(CASE WHEN events < at_risk THEN 1 - events / at_risk END)) OVER w) END, 6) AS survival FROM r WINDOW w AS (PARTITION BY arm ORDER BY time)""")
def km_curve(spark, d):
    return stats.km(_surv(spark, d), "t", "e", ["arm"]).withColumn("survival", _R("survival"))


@query(f"""WITH {_SURV}, c AS (SELECT t, count(*) FILTER (WHERE arm = 1 AND e = 1) AS d1, count(*) FILTER (WHERE e = 1) AS d, count(*) FILTER (WHERE arm = 1) AS n1, count(*) AS n FROM surv GROUP BY 1),
    r AS (SELECT d1, d, sum(n1) OVER (ORDER BY t DESC) AS r1, sum(n) OVER (ORDER BY t DESC) AS r FROM c),
    s AS (SELECT sum(d1) AS o, sum(d * r1 / r) AS x, sum(CASE WHEN r > 1 THEN d * (r1 / r) * (1 - r1 / r) * (r - d) / (r - 1) ELSE 0 END) AS v FROM r WHERE d > 0)
    SELECT CAST(o AS BIGINT) AS observed, round(x, 5) AS expected, round(v, 5) AS variance, round((o - x) * (o - x) / v, 5) AS chi2 FROM s""")
def logrank_test(spark, d):
    r = stats.logrank(_surv(spark, d), "t", "e", "arm")
    return r.select("observed", *[_R(c, 5).alias(c) for c in ("expected", "variance", "chi2")])


@query()
def cox_model(spark, d):
    rows = stats.coxph(_surv(spark, d).withColumn("balance", F.col("c_acctbal") / 10000), "t", "e", ["arm", "balance"])
    return spark.createDataFrame(rows, "name string, coef double, hr double, low double, high double, se double, z double, p double, converged boolean")


@query("""WITH s AS (SELECT avg(c_acctbal) FILTER (WHERE a = 1) AS m1, avg(c_acctbal) FILTER (WHERE a = 0) AS m0, var_samp(c_acctbal) FILTER (WHERE a = 1) AS v1, var_samp(c_acctbal) FILTER (WHERE a = 0) AS v0,
      count(c_acctbal) FILTER (WHERE a = 1) AS n1, count(c_acctbal) FILTER (WHERE a = 0) AS n0 FROM (SELECT c_acctbal, c_nationkey % 2 AS a FROM customer))
    SELECT n1, n0, round((m1 - m0) / sqrt((v1 + v0) / 2), 6) AS smd, round((m1 - m0) / sqrt(v1 / n1 + v0 / n0), 6) AS t FROM s""")
def smd_numeric(spark, d):
    return stats.smd_numeric(_surv(spark, d), "arm", "c_acctbal").select("n1", "n0", _R("smd").alias("smd"), _R("t").alias("t"))


@query("""WITH c AS (SELECT c_nationkey % 2 AS a, c_mktsegment AS m, count(*) AS n FROM customer GROUP BY 1, 2), r AS (SELECT a, sum(n) AS r FROM c GROUP BY 1), k AS (SELECT m, sum(n) AS k FROM c GROUP BY 1),
    x AS (SELECT r.a, k.m, r.r * k.k / (SELECT sum(n) FROM c) AS e FROM r, k) SELECT round(sum((coalesce(n, 0) - e) * (coalesce(n, 0) - e) / e), 6) AS chi2, CAST((count(DISTINCT x.a) - 1) * (count(DISTINCT x.m) - 1) AS BIGINT) AS df FROM x LEFT JOIN c ON c.a = x.a AND c.m = x.m""")
def chi2_test(spark, d):
    return stats.chi2(_surv(spark, d), "arm", "c_mktsegment").select(_R("chi2").alias("chi2"), F.col("df").cast("long").alias("df"))


@query("""WITH p AS (SELECT event_type AS test, avg(value) / 100.0 / (1 + count(*)) AS p FROM events WHERE value IS NOT NULL GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY p, test) AS k, count(*) OVER () AS m FROM p)
    SELECT test, round(least(1.0, min(p * m / k) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 8) AS q FROM r""")
def bh_adjust(spark, d):
    p = _t(spark, d, "events").where("value is not null").groupBy(F.col("event_type").alias("test")).agg((F.avg("value") / 100.0 / (1 + F.count("*"))).alias("p"))
    return stats.bh(p, "p", tie="test").select("test", _R("q", 8).alias("q"))


@query("""WITH v AS (SELECT c_mktsegment AS g, c_acctbal AS x FROM customer), r AS (SELECT x, count(*) AS n, sum(count(*)) OVER (ORDER BY x) - count(*) + (count(*) + 1) / 2.0 AS rk FROM v GROUP BY x),
    s AS (SELECT g, count(*) AS k, sum(rk) AS r FROM v JOIN r USING (x) GROUP BY g), t AS (SELECT sum(n) AS n, sum(n * n * n - n) AS t FROM r)
    SELECT round((12.0 / (t.n * (t.n + 1)) * sum(s.r * s.r / s.k) - 3 * (t.n + 1)) / (1 - t.t / (CAST(t.n AS DOUBLE) * t.n * t.n - t.n)), 5) AS h, count(*) - 1 AS df FROM s, t GROUP BY t.n, t.t""")
def kruskal_test(spark, d):
    return stats.kruskal(_t(spark, d, "customer"), "c_mktsegment", "c_acctbal").select(_R("h", 5).alias("h"), F.col("df").cast("long").alias("df"))


_TAIL = "exp(-statistic / 2) * list_sum(list_transform(range(0, df // 2), lambda i: exp(i * ln(statistic / 2) - lgamma(i + 1))))"  # of a chi-square value of even df


@query(f"""WITH c AS (SELECT c_mktsegment AS g, CAST(c_acctbal AS DOUBLE) AS a, CAST(c_nationkey AS DOUBLE) AS k, CASE WHEN c_custkey % 3 = 0 THEN 'third' ELSE 'other' END AS l, CAST(c_nationkey % 7 AS VARCHAR) AS m FROM customer),
    v AS (SELECT 'a' AS variable, g, a AS x FROM c UNION ALL SELECT 'k', g, k FROM c), r AS (SELECT variable, x, count(*) AS n, sum(count(*)) OVER (PARTITION BY variable ORDER BY x) - count(*) + (count(*) + 1) / 2.0 AS rk FROM v GROUP BY 1, 2),
    s AS (SELECT variable, g, count(*) AS n, sum(rk) AS r, avg(x) AS mean, var_samp(x) AS var FROM v JOIN r USING (variable, x) GROUP BY 1, 2), t AS (SELECT variable, CAST(sum(n) AS DOUBLE) AS n, sum(CAST(n AS DOUBLE) ** 3 - n) AS t FROM r GROUP BY 1),
    h AS (SELECT s.variable, (12.0 / (t.n * (t.n + 1)) * sum(s.r * s.r / s.n) - 3 * (t.n + 1)) / (1 - t.t / (t.n ** 3 - t.n)) AS statistic, count(*) - 1 AS df FROM s JOIN t USING (variable) GROUP BY s.variable, t.n, t.t),
    d AS (SELECT x.variable, avg(abs(x.mean - y.mean) / sqrt((x.var + y.var) / 2)) AS smd FROM s x JOIN s y ON x.variable = y.variable AND x.g > y.g GROUP BY 1),
    w AS (SELECT 'l' AS variable, g, l AS lev FROM c UNION ALL SELECT 'm', g, m FROM c), o AS (SELECT variable, g, lev, count(*) AS n FROM w GROUP BY ALL), rg AS (SELECT variable, g, sum(n) AS r FROM o GROUP BY 1, 2), cl AS (SELECT variable, lev, sum(n) AS k FROM o GROUP BY 1, 2),
    e AS (SELECT rg.variable, rg.g, cl.lev, rg.r * cl.k / (SELECT count(*) FROM c) AS e FROM rg JOIN cl USING (variable)), q AS (SELECT variable, sum((coalesce(n, 0) - e) ** 2 / e) AS statistic, (count(DISTINCT g) - 1) * (count(DISTINCT lev) - 1) AS df FROM e LEFT JOIN o USING (variable, g, lev) GROUP BY 1),
    f AS (SELECT g, avg(CAST(l = 'third' AS INT)) AS p FROM c GROUP BY 1), z AS (SELECT avg(abs(x.p - y.p) / sqrt((x.p * (1 - x.p) + y.p * (1 - y.p)) / 2)) AS smd FROM f x JOIN f y ON x.g > y.g)
    SELECT variable, test, round(statistic, 5) AS statistic, CAST(df AS BIGINT) AS df, round({_TAIL}, 6) AS p, round(smd, 6) AS smd FROM (
        SELECT variable, 'kruskal' AS test, statistic, df, smd FROM h JOIN d USING (variable) UNION ALL SELECT variable, 'chi2', statistic, df, CASE WHEN variable = 'l' THEN (SELECT smd FROM z) END FROM q)""")
def baseline_tests(spark, d):
    c = _t(spark, d, "customer").select(F.col("c_mktsegment").alias("g"), F.col("c_acctbal").alias("a"), F.col("c_nationkey").alias("k"), F.when(F.col("c_custkey") % 3 == 0, "third").otherwise("other").alias("l"), (F.col("c_nationkey") % 7).cast("string").alias("m"))
    b = stats.baseline_table(c, "g", ["a", "k"], ["l", "m"]).select("variable", "test", "statistic", "df", "p", "smd").distinct()
    # SQL has no inverse of a matrix, so the difference of the variable of seven levels is tested elsewhere
    return b.select("variable", "test", _R("statistic", 5).alias("statistic"), F.col("df").cast("long").alias("df"), _R("p").alias("p"), F.when(F.col("variable") != "m", _R("smd")).alias("smd"))


@query("""SELECT 'a' AS variable, g AS "group", count(a) AS n, round(quantile_cont(a, 0.25), 5) AS q1, round(quantile_cont(a, 0.5), 5) AS median, round(quantile_cont(a, 0.75), 5) AS q3 FROM (SELECT CASE WHEN event_type = 'view' THEN 'view' ELSE 'other' END AS g, value AS a FROM events UNION ALL SELECT 'overall', value FROM events) GROUP BY g
    UNION ALL SELECT 'b', g, count(b), round(quantile_cont(b, 0.25), 5), round(quantile_cont(b, 0.5), 5), round(quantile_cont(b, 0.75), 5) FROM (SELECT CASE WHEN event_type = 'view' THEN 'view' ELSE 'other' END AS g, user_id % 13 AS b FROM events UNION ALL SELECT 'overall', user_id % 13 FROM events) GROUP BY g""")
def baseline_quartiles(spark, d):
    e = _t(spark, d, "events").select(F.when(F.col("event_type") == "view", "view").otherwise("other").alias("g"), F.col("value").alias("a"), (F.col("user_id") % 13).alias("b"))
    q = stats.baseline_table(e, "g", ["a", "b"], [])
    return q.select("variable", "group", "n", *[_R(c, 5).alias(c) for c in ("q1", "median", "q3")])


@query(f"""WITH {_SURV}, x AS (SELECT c_mktsegment AS g, t, CAST(sum(e) AS BIGINT) AS d, sum(e * arm) AS d1, count(*) AS n, sum(arm) AS n1 FROM surv JOIN customer USING (c_custkey) GROUP BY 1, 2),
    r AS (SELECT g, d, d1, sum(n) OVER w AS n, sum(n1) OVER w AS n1 FROM x WINDOW w AS (PARTITION BY g ORDER BY t DESC)), u AS (SELECT *, unnest(range(0, d)) AS l FROM r WHERE d > 0),
    k AS (SELECT g, list({{'a': CAST(n1 - l * d1 / d AS DOUBLE), 'b': CAST(n - n1 - l * (d - d1) / d AS DOUBLE)}}) AS k FROM u GROUP BY g), s AS (SELECT g, CAST(sum(d1) AS DOUBLE) AS d1, sum(d) AS events FROM x GROUP BY g HAVING sum(d) >= 10),
    b AS (SELECT g, events, k, list_reduce(CAST(range(0, 26) AS DOUBLE[]), lambda b, i: b + (d1 - list_sum(list_transform(k, lambda z: z.a * exp(b) / (z.a * exp(b) + z.b)))) / list_sum(list_transform(k, lambda z: z.a * exp(b) * z.b / (z.a * exp(b) + z.b) ** 2))) AS coef FROM s JOIN k USING (g)),
    i AS (SELECT *, 1 / sqrt(list_sum(list_transform(k, lambda z: z.a * exp(coef) * z.b / (z.a * exp(coef) + z.b) ** 2))) AS se FROM b)
    SELECT g AS stratum, CAST(events AS BIGINT) AS events, round(coef, 5) AS coef, round(se, 5) AS se, round(exp(coef), 4) AS hr, round(exp(coef - 1.959964 * se), 4) AS low, round(exp(coef + 1.959964 * se), 4) AS high FROM i""")
def cox_by_type(spark, d):
    found = stats.cox_by_type(_surv(spark, d), "c_mktsegment", "t", "e", ["arm"], "arm")
    rows = spark.createDataFrame([r | {"stratum": r["c_mktsegment"]} for r in found], "stratum string, events long, coef double, se double, hr double, low double, high double")
    return rows.withColumns({c: _R(c, 5) for c in ("coef", "se")} | {c: _R(c, 4) for c in ("hr", "low", "high")})


@query("""SELECT 'c_acctbal' AS variable, NULL::VARCHAR AS level, c_mktsegment AS "group", count(c_acctbal) AS n, NULL::DOUBLE AS share, round(quantile_cont(c_acctbal, 0.5), 6) AS median, round(quantile_cont(c_acctbal, 0.25), 6) AS q1, round(quantile_cont(c_acctbal, 0.75), 6) AS q3 FROM customer GROUP BY c_mktsegment
    UNION ALL SELECT 'c_nationkey', CAST(c_nationkey AS VARCHAR), c_mktsegment, count(*), round(count(*) / sum(count(*)) OVER (PARTITION BY c_mktsegment), 6), NULL, NULL, NULL FROM customer GROUP BY c_mktsegment, c_nationkey""")
def baseline_table(spark, d):
    b = stats.baseline_table(_t(spark, d, "customer"), "c_mktsegment", ["c_acctbal"], ["c_nationkey"]).where("group <> 'overall'").drop("test", "statistic", "df", "p", "smd")
    return b.withColumns({c: _R(c) for c in ("share", "median", "q1", "q3")})


# ---- sampling, increments, checks ------------------------------------------------------------------------------------

@query("""SELECT doc_id, source, CASE WHEN row_number() OVER (PARTITION BY source ORDER BY doc_id) <= floor(count(*) OVER (PARTITION BY source) * 0.25) THEN 'eval' ELSE 'train' END AS split FROM documents""")
def head_split(spark, d):
    return sampling.head_split(_t(spark, d, "documents").select("doc_id", "source"), "source", ["doc_id"], 0.25)


@query("""WITH f AS (SELECT source, min(doc_id) AS f FROM documents WHERE lang = 'de' GROUP BY 1 ORDER BY f, source LIMIT 5) SELECT doc_id FROM documents WHERE lang = 'de' AND source IN (SELECT source FROM f)""")
def first_sources(spark, d):
    return sampling.first_k_keys(_t(spark, d, "documents").where("lang = 'de'"), "source", ["doc_id"], 5).select("doc_id")


@query("""SELECT doc_id FROM (SELECT doc_id, sum(n_chars + 2) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - 2 AS running FROM documents) WHERE running <= 20000""")
def packed_prompts(spark, d):
    return sampling.pack_budget(_t(spark, d, "documents").select("doc_id", "source", "n_chars"), "source", ["doc_id"], "n_chars", 20000, 2).select("doc_id")


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n FROM documents) WHERE (n - 1) % 10 = 0")
def stride_sample(spark, d):
    return sampling.stride(_t(spark, d, "documents").select("doc_id", "lang"), "lang", ["doc_id"], 10).select("doc_id")


@query("SELECT event_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error')")
def unprocessed(spark, d):
    e = _t(spark, d, "events")
    return tables.anti_processed(e, e.where("event_type = 'error'"), "user_id").select("event_id")


@query(f"""WITH s AS (SELECT user_id, event_type AS feature, CAST({_K} AS VARCHAR) AS prediction, {_K} % 3 AS priority FROM events), f AS (SELECT user_id, min(priority) AS p FROM s GROUP BY 1)
    SELECT s.user_id, s.feature, s.prediction FROM s JOIN f ON s.user_id = f.user_id AND s.priority = f.p WHERE s.feature <> 'view' UNION ALL SELECT user_id, 'view', 'fresh' FROM f""")
def recycled_snapshots(spark, d):
    s = _events(spark, d).select("user_id", F.col("event_type").alias("feature"), F.col("k").cast("string").alias("prediction"), (F.col("k") % 3).alias("priority"))
    fresh = s.select("user_id").distinct().select("user_id", F.lit("view").alias("feature"), F.lit("fresh").alias("prediction"))
    return tables.recycle(s, fresh, "user_id", "feature", "priority", ["view"])


@query("SELECT event_type, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS ts FROM events GROUP BY 1")
def latest_runs(spark, d):
    e = _t(spark, d, "events").select("event_type", "event_id", "ts").withColumn("order", F.struct("ts", "event_id"))
    return tables.latest_runs(e, ["event_type"], "order").drop("order")


@query("""SELECT 'required:text' AS "check", 'hard' AS severity, count(*) FILTER (WHERE text IS NULL) AS failures FROM documents UNION ALL SELECT 'domain:lang', 'advisory', count(*) FILTER (WHERE lang NOT IN ('en', 'fr')) FROM documents
    UNION ALL SELECT 'non_negative:n_chars', 'hard', count(*) FILTER (WHERE n_chars < 0) FROM documents UNION ALL SELECT 'unique:doc_id', 'hard', count(*) - count(DISTINCT doc_id) FROM documents""")
def quality_checks(spark, d):
    docs = _t(spark, d, "documents")
    one = quality.expect(docs, [quality.required("text"), quality.domain("lang", ["en", "fr"], "advisory"), quality.non_negative("n_chars")])
    return one.unionByName(quality.unique(docs, ["doc_id"]))


@query("SELECT doc_id, CASE WHEN contains(lower(text), 'tion') THEN 'Yes' ELSE 'No' END AS prediction FROM documents")
def scored_notes(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "text")
    out, _ = scoring.score_with_memo(docs, None, ["text"], scoring.keyword_scorer("tion"), "prediction string")
    return out.select("doc_id", "prediction")


@query("""SELECT c_custkey, CASE WHEN c_acctbal < 18.5 THEN 'underweight' WHEN c_acctbal < 25 THEN 'normal weight' WHEN c_acctbal < 30 THEN 'overweight' ELSE 'obese' END AS category FROM customer""")
def bmi_categories(spark, d):
    return _t(spark, d, "customer").select("c_custkey", rules.bmi_category(F.col("c_acctbal")).alias("category"))


@query(f"""WITH e AS (SELECT user_id, CASE WHEN event_type = 'click' THEN {_K} * 1.0 WHEN event_type = 'view' THEN {_K} / 0.6 END AS w FROM events) SELECT user_id, CASE WHEN max(w) = 0 THEN 'A' WHEN max(w) <= 30 THEN 'B' WHEN max(w) <= 120 THEN 'C' WHEN max(w) IS NOT NULL THEN 'D' END AS option FROM e GROUP BY 1""")
def amount_options(spark, d):
    return rules.amount_option(_events(spark, d).withColumn("r", F.col("k").cast("string")), ["user_id"], {"click": 1, "view": 1 / 0.6}, "event_type", "r", (0, 30, 120))


# ---- records, unions, whole jobs -------------------------------------------------------------------------------------

@query("""WITH c AS (SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('view', 'click', 'refund') GROUP BY 1), v(option) AS (VALUES ('view'), ('click'), ('refund'))
    SELECT 'kind' AS feature, option, round(coalesce(n, 0) / (SELECT sum(n) FROM c), 6) AS share FROM v LEFT JOIN c ON option = event_type""")
def option_prevalence(spark, d):
    valid = spark.createDataFrame([("kind", "view"), ("kind", "click"), ("kind", "refund")], "feature string, option string")
    e = _t(spark, d, "events").select(F.lit("kind").alias("feature"), "event_type")
    return features.prevalence(e, "feature", "event_type", valid).withColumn("share", _R("share"))


@query("""WITH f AS (SELECT CAST(user_id AS VARCHAR) AS entity_id, event_type AS keyword, ts, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts) AS n FROM events)
    SELECT entity_id, 'first_event' AS feature_name, keyword, ts AS date, 'Yes' AS prediction FROM f WHERE n = 1""")
def first_coded_records(spark, d):
    e = _events(spark, d).withColumn("code", F.col("k").cast("string"))
    return features.coded(e, "user_id", "ts", "code", "event_type", "first_event").select("entity_id", "feature_name", "keyword", "date", "prediction")


@query("""SELECT 'EMPI:' || CAST(user_id AS VARCHAR) AS value FROM events WHERE user_id IS NOT NULL GROUP BY user_id""")
def id_export(spark, d):
    return tables.id_lines(_t(spark, d, "events"), "user_id")


@query("""SELECT source AS entity_id, doc_id AS note_id, length(text) AS n, 'documents' AS source_table FROM documents UNION ALL SELECT role, conv_id * 1000 + turn, length(text), 'conversations' FROM conversations""")
def united_notes(spark, d):
    a = _t(spark, d, "documents").withColumn("n", F.length("text"))
    b = _t(spark, d, "conversations").withColumns({"n": F.length("text"), "note": F.col("conv_id") * 1000 + F.col("turn")})
    return tables.union_aliased([(a, {"entity_id": "source", "note_id": "doc_id", "n": "n"}, "documents"), (b, {"entity_id": "role", "note_id": "note", "n": "n"}, "conversations")])


@query("""WITH m AS (SELECT event_type, user_id % 5 AS method, avg(value) AS v FROM events WHERE value IS NOT NULL GROUP BY 1, 2) SELECT event_type, round(avg(v), 6) AS mean, max(v) - min(v) > 5 AS disagree, count(DISTINCT method) AS methods FROM m GROUP BY 1""")
def method_consensus(spark, d):
    m = _t(spark, d, "events").where("value is not null").groupBy("event_type", (F.col("user_id") % 5).alias("method")).agg(F.avg("value").alias("v"))
    return history.consensus(m, "event_type", "method", "v", 5).withColumn("mean", _R("mean"))


@query(f"""WITH {_LAB}, c AS (SELECT lang, doc_id % 3 = 0 AS syn, CAST(quality = pred AS INT) AS hit FROM lab)
    SELECT lang, count(*) AS n, round(avg(hit), 6) AS combined, round(avg(hit) FILTER (WHERE NOT syn), 6) AS natural, round(avg(hit) FILTER (WHERE syn), 6) AS synthetic FROM c GROUP BY 1""")
def evaluation_job(spark, d):
    from tidemark.plans import jobs

    out = jobs.evaluate(_lab(spark, d).withColumn("syn", F.col("doc_id") % 3 == 0), ["lang"], "quality", "pred", "syn")
    return out.withColumns({c: _R(c) for c in ("combined", "natural", "synthetic")})


@query(f"""WITH k AS (SELECT source, doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') AS w FROM documents WHERE {_HIT('text', 'the')}), s AS (SELECT source, doc_id, w, unnest(range(0, greatest(len(w) - 20, 1), 180)) AS s FROM k),
    c AS (SELECT source, doc_id, s // 180 AS chunk_index, array_to_string(w[s + 1 : s + 200], ' ') AS chunk FROM s)
    SELECT source, min(doc_id) AS doc_id FROM c WHERE {_HIT('chunk', 'the')} GROUP BY 1""")
def validation_set(spark, d):
    from tidemark.plans import jobs

    docs = _t(spark, d, "documents").select("source", "doc_id", "text")
    return jobs.validation_set(docs, "source", "doc_id", "text", ["the"], ["doc_id", "chunk_index"], 1_000_000).select("source", "doc_id")


@query("""SELECT 'Judge the text.' || chr(10) || chr(10) || text AS content, CAST(quality AS VARCHAR) AS ground_truth, 'train' AS split, row_number() OVER (ORDER BY doc_id) - 1 AS index FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL""")
def training_rows(spark, d):
    rows = _t(spark, d, "documents").select("doc_id", "text").join(_t(spark, d, "labels"), "doc_id").where("quality is not null")
    out = tables.training_rows(tables.row_index(rows, "doc_id"), "Judge the text.", "text", "quality", "train")
    return out.select(F.get("prompt", F.lit(0))["content"].alias("content"), "reward_model.ground_truth", "extra_info.split", "extra_info.index")


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY 1, 2""")
def priced_summary(spark, d):
    l = _t(spark, d, "lineitem").where("l_shipdate <= date '1998-09-02'")
    return l.groupBy("l_returnflag", "l_linestatus").agg(_R(F.sum("l_quantity"), 2).alias("sum_qty"), _R(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query(f"""WITH {_LAB} SELECT lang, doc_id FROM lab WHERE quality IS DISTINCT FROM pred ORDER BY doc_id LIMIT 25""")
def error_listing(spark, d):
    return evalm.errors(_lab(spark, d), "quality", "pred", ["doc_id"], 25).select("lang", "doc_id")


from tidemark.plans import catalogue_notes, catalogue_rows, catalogue_study, catalogue_text  # noqa: E402, F401 - they add their queries
