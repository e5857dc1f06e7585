"""More registered queries: prompts and answers, corpora, vocabularies, evaluation by score, samples and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import prompts, text
from tidemark.operators import corpus, evalm, history, quality, sampling, stats
from tidemark.plans import jobs
from tidemark.plans.catalogue import _HIT, _LAB, _R, _events, _K, _lab, _t, query
from tidemark.sources import tables

_WS = "regexp_split_to_array(text, '[ \\t\\n\\x0b\\f\\r]+')"

# ---- prompts and answers ---------------------------------------------------------------------------------------------


@query("""SELECT conv_id, turn, replace(replace('Was {keyword} given? {abx}.', '{keyword}', role), '{abx}', role) || CASE role WHEN 'user' THEN chr(10) || 'asks' WHEN 'system' THEN chr(10) || 'rules' ELSE '' END AS prompt FROM conversations""")
def hinted_prompts(spark, d):
    c = _t(spark, d, "conversations").select("conv_id", "turn", "role", prompts.fill_keyword(F.lit("Was {keyword} given? {abx}."), F.col("role")).alias("prompt"))
    return prompts.with_hints(c, "prompt", "role", spark.createDataFrame([("USER", "asks"), ("system", "rules")], "keyword string, hint string")).select("conv_id", "turn", "prompt")


@query("""SELECT 'Is it ' || lang || '? Respond ONLY with a single letter, nothing else.' AS instruction, text AS input, CAST(quality AS VARCHAR) AS output, source AS feature FROM documents JOIN labels USING (doc_id)""")
def instruction_rows(spark, d):
    rows = _t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id").withColumn("found", F.array("lang"))
    return prompts.instruction_rows(rows, F.lit("Is it {keyword}?"), "found", "text", "quality", "source")


@query("""SELECT text AS context, category, label FROM (SELECT text, 'quality' AS category, quality AS label FROM documents JOIN labels USING (doc_id) UNION ALL SELECT text, 'toxic', toxic FROM documents JOIN labels USING (doc_id)) WHERE label IS NOT NULL""")
def binary_rows(spark, d):
    return prompts.binary_rows(_t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id"), "text", ["quality", "toxic"])


@query("""SELECT text AS chunk, CAST(quality AS VARCHAR) AS val_unified, lang AS feature FROM documents JOIN labels USING (doc_id)""")
def adapted_chunks(spark, d):
    rows = _t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id")
    return prompts.as_labelled_chunks(rows, "text", "quality", "lang").select("chunk", "val_unified", "feature")


@query("""WITH l AS (SELECT conv_id, turn, list_filter([CASE WHEN role = 'user' THEN 'ask' END, CASE WHEN length(text) > 100 THEN 'long' END, CASE WHEN turn = 0 THEN 'Other' END], lambda x: x IS NOT NULL) AS labels FROM conversations)
    SELECT conv_id, turn, CASE WHEN len(labels) = 1 THEN CASE labels[1] WHEN 'ask' THEN 'A' WHEN 'long' THEN 'B' END END AS letter, len(list_filter(labels, lambda x: x <> 'Other')) > 0 AS boundary FROM l""")
def label_letters(spark, d):
    c = _t(spark, d, "conversations")
    labels = F.array_compact(F.array(F.when(F.col("role") == "user", "ask"), F.when(F.length("text") > 100, "long"), F.when(F.col("turn") == 0, "Other")))
    c = c.withColumn("labels", labels)
    return c.select("conv_id", "turn", prompts.label_letter(F.col("labels"), {"ask": "A", "long": "B"}).alias("letter"), prompts.is_boundary(F.col("labels")).alias("boundary"))


@query(f"""SELECT event_id, {_K} AS k, CASE WHEN event_id % 3 = 0 THEN {_K} WHEN event_id % 3 = 1 THEN CAST(event_id % 50 AS INT) ELSE 0 END AS score FROM events""")
def parsed_answers(spark, d):
    e = _t(spark, d, "events")
    k = F.get_json_object("props", "$.k")
    tail = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" Important Score: "), k)).when(F.col("event_id") % 3 == 1, F.concat(F.lit(" score = "), (F.col("event_id") % 50).cast("string"), F.lit("/50"))).otherwise(" none")
    fenced = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("So:\n```json\n"), "props", F.lit("\n```"))).otherwise(F.concat(F.lit("I say "), "props"))
    answer = F.concat(fenced, tail)
    return e.select("event_id", prompts.parsed_json(answer, "k int")["k"].alias("k"), prompts.importance(answer).alias("score"))


@query(f"""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'B' WHEN 1 THEN CAST({_K} AS VARCHAR) WHEN 2 THEN '20240' || CAST(event_id % 10 AS VARCHAR) || '15' END AS answer FROM events""")
def model_answers(spark, d):
    e, k = _t(spark, d, "events"), F.get_json_object("props", "$.k")
    i = F.col("event_id") % 4
    said = F.when(i == 0, "<think>A or C</think> I think B.").when(i == 1, F.concat(F.lit("about "), k, F.lit(" packs"))).when(i == 2, F.concat(F.lit("on 20240"), (F.col("event_id") % 10).cast("string"), F.lit("15")))
    return e.select("event_id", F.when(i == 0, text.parse_answer(said, "choice")).when(i == 1, text.parse_answer(said, "number")).when(i == 2, text.parse_answer(said, "date")).alias("answer"))


@query("""SELECT event_id, event_id % 5 IN (0, 1, 2) AS dated FROM events""")
def dated_texts(spark, d):
    n = F.col("event_id")
    day, year = (n % 28 + 1).cast("string"), (n % 20 + 2000).cast("string")
    said = F.when(n % 5 == 0, F.concat(F.lit("seen "), day, F.lit(".12. "), year)).when(n % 5 == 1, F.concat(F.lit("on "), day, F.lit("th March"))).when(n % 5 == 2, F.concat(F.lit("since Sep '"), F.substring(year, 3, 2))).when(n % 5 == 3, F.concat_ws(" ", F.lit("values"), day, F.lit("3"), F.lit("99"))).otherwise(F.concat(F.lit("pain "), day, F.lit("/10 maybe 12")))
    return _t(spark, d, "events").select("event_id", text.contains_date(said).alias("dated"))


@query("""SELECT DISTINCT p_type, CASE WHEN starts_with(p_type, 'E') THEN 'Yes' ELSE 'No' END AS answer, regexp_replace(lower(p_type), '[^a-z0-9]+', '_', 'g') AS slug FROM part""")
def option_texts(spark, d):
    p = _t(spark, d, "part").select("p_type").distinct()
    letter = F.when(F.startswith("p_type", F.lit("E")), "A").otherwise("B")
    return p.select("p_type", text.option_text(F.lit("A. Yes, B. No"), letter).alias("answer"), text.normal_slug(F.col("p_type")).alias("slug"))


# ---- corpora ---------------------------------------------------------------------------------------------------------

@query(f"""WITH w AS (SELECT unnest(list_filter({_WS}, lambda x: x <> '')) AS token FROM conversations), c AS (SELECT token, count(*) AS n FROM w GROUP BY 1) SELECT token, n, row_number() OVER (ORDER BY token) - 1 AS id FROM c UNION ALL SELECT 'UNK', 0, (SELECT count(*) FROM c)""")
def vocabulary(spark, d):
    return sampling.vocabulary(_t(spark, d, "conversations").select(text.word_array(F.col("text")).alias("w")), "w")


@query("""SELECT conv_id, turn, n, text = swapped AS same, label FROM (SELECT conv_id, turn, text, text AS swapped, 0 AS label, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WHERE false) UNION ALL SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id), true, 0 FROM conversations""")
def unswapped_sentences(spark, d):
    c = _t(spark, d, "conversations")
    n = c.groupBy("conv_id").agg(F.count("*").alias("n"))
    out = sampling.swapped_sentences(c, "conv_id", "turn", "text", 0.0, 3).join(n, "conv_id")
    return out.select("conv_id", "turn", "n", (F.col("text") == F.col("swapped")).alias("same"), "label")


@query("""SELECT conv_id, count(*) AS n, count(*) > 1 AS all_moved FROM conversations GROUP BY 1""")
def swapped_sentences(spark, d):
    out = sampling.swapped_sentences(_t(spark, d, "conversations"), "conv_id", "turn", "text", 1.0, 3)
    return out.groupBy("conv_id").agg(F.count("*").alias("n"), (F.min("label") == 1).alias("all_moved"))


@query("""SELECT a.conv_id, a.turn, b.text AS before FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1""")
def sentence_lookup(spark, d):
    c = _t(spark, d, "conversations")
    asked = c.select("conv_id", "turn", (F.col("turn") - 1).alias("at"))
    return corpus.sentence_at(asked, c, "conv_id", "turn", "text", "at").select("conv_id", "turn", F.col("sentence").alias("before"))


@query(f"""SELECT round(avg(CAST({_HIT('text', 'the')} AS INT)), 6) AS hit_rate, round(avg(CASE WHEN {_HIT('text', 'the')} THEN CAST(lang = 'en' AS INT) END), 6) AS positive_rate FROM documents""")
def keyword_rates(spark, d):
    r = jobs.keyword_rates(_t(spark, d, "documents"), "text", ["the"], F.col("lang") == "en")
    return r.select(*[_R(c).alias(c) for c in ("hit_rate", "positive_rate")])


@query("""SELECT lang, doc_id, contains(' ' || lower(regexp_replace(text, '[^a-zA-Z0-9_]', ' ', 'g')) || ' ', ' the ') AS found FROM documents WHERE lang = 'en'""")
def delimited_names(spark, d):
    docs = _t(spark, d, "documents").where("lang = 'en'")
    ascii_only = F.regexp_replace("text", "[^a-zA-Z0-9_]", " ")
    return docs.select("lang", "doc_id", (F.size(text.keywords(ascii_only, ["the"], "delimited")) > 0).alias("found"))


# ---- evaluation ------------------------------------------------------------------------------------------------------

@query(f"""WITH {_LAB}, p AS (SELECT a.lang, avg(CASE WHEN a.n_chars > b.n_chars THEN 1.0 WHEN a.n_chars = b.n_chars THEN 0.5 ELSE 0.0 END) AS auc FROM lab a JOIN lab b ON a.lang = b.lang AND a.quality = 1 AND b.quality = 0 GROUP BY 1),
    m AS (SELECT avg(CASE WHEN a.n_chars > b.n_chars THEN 1.0 WHEN a.n_chars = b.n_chars THEN 0.5 ELSE 0.0 END) AS auc FROM lab a JOIN lab b ON a.quality = 1 AND b.quality = 0) SELECT round(avg(p.auc), 6) AS auc_macro, round(max(m.auc), 6) AS auc_micro FROM p, m""")
def auc_macro_micro(spark, d):
    return evalm.auc_macro_micro(_lab(spark, d), "lang", "quality", "n_chars").select(*[_R(c).alias(c) for c in ("auc_macro", "auc_micro")])


@query(f"""WITH {_LAB}, c AS (SELECT lang, n_chars AS threshold, count(*) FILTER (WHERE quality = 1) AS p, count(*) FILTER (WHERE quality = 0) AS n FROM lab GROUP BY 1, 2), r AS (SELECT lang, threshold, CAST(sum(p) OVER w AS BIGINT) AS tp, CAST(sum(n) OVER w AS BIGINT) AS fp, sum(p) OVER (PARTITION BY lang) AS a FROM c WINDOW w AS (PARTITION BY lang ORDER BY threshold DESC))
    SELECT lang, threshold, tp, fp, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN a > 0 THEN tp / a ELSE 0 END, 6) AS recall FROM r""")
def pr_curves(spark, d):
    return evalm.pr_curve(_lab(spark, d), "quality", "n_chars", ["lang"]).withColumns({c: _R(c) for c in ("precision", "recall")})


_CURVE = f"""WITH {_LAB}, c AS (SELECT n_chars AS t, count(*) FILTER (WHERE quality = 1) AS p, count(*) FILTER (WHERE quality = 0) AS n FROM lab GROUP BY 1), r AS (SELECT t, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER () AS a FROM c WINDOW w AS (ORDER BY t DESC)),
    q AS (SELECT t, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, tp / a AS recall FROM r)"""


@query(_CURVE + " SELECT max(t) AS threshold, round(arg_max(precision, t), 6) AS precision FROM q WHERE recall >= 0.9")
def precision_at_recall(spark, d):
    return evalm.precision_at_recall_by_score(_lab(spark, d), "quality", "n_chars", 0.9).select("threshold", _R("precision").alias("precision"))


@query(_CURVE + " SELECT min(t) AS threshold, round(arg_min(recall, t), 6) AS recall FROM q WHERE precision >= 0.5")
def recall_at_precision(spark, d):
    return evalm.recall_at_precision_by_score(_lab(spark, d), "quality", "n_chars", 0.5).select("threshold", _R("recall").alias("recall"))


@query(f"""WITH {_LAB}, m AS (SELECT lang, max(quality) AS quality, max(n_chars) AS n_chars FROM lab GROUP BY 1) SELECT * FROM m""")
def any_labels(spark, d):
    return evalm.any_label(_lab(spark, d), "lang", "quality", "n_chars")


@query(f"""WITH {_LAB}, b AS (SELECT CAST(least(floor(log10(greatest(n_chars, 1)) / 0.5), 9) AS INT) AS length_bin, quality, pred FROM lab), c AS (SELECT length_bin, count(*) FILTER (WHERE quality = 1 AND pred = 1) AS tp, count(*) FILTER (WHERE quality = 0 AND pred = 1) AS fp, count(*) FILTER (WHERE quality = 1 AND pred = 0) AS fn FROM b GROUP BY 1)
    SELECT length_bin, tp, fp, fn FROM c""")
def length_bins(spark, d):
    return evalm.by_length_bin(_lab(spark, d), "n_chars", "quality", "pred").select("length_bin", "tp", "fp", "fn")


@query(f"""WITH {_LAB}, c AS (SELECT lang, count(*) FILTER (WHERE quality = 1 AND pred = 1) AS tp, count(*) FILTER (WHERE quality = 0 AND pred = 1) AS fp, count(*) FILTER (WHERE quality = 1 AND pred = 0) AS fn FROM lab GROUP BY 1)
    SELECT round(avg(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END), 6) AS macro_precision, round(sum(tp) / (sum(tp) + sum(fp)), 6) AS micro_precision, round(avg(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END), 6) AS macro_recall, round(sum(tp) / (sum(tp) + sum(fn)), 6) AS micro_recall FROM c""")
def macro_micro(spark, d):
    m = evalm.macro_micro(evalm.multilabel(_lab(spark, d), "lang", "quality", "pred"))
    return m.select(*[_R(c).alias(c) for c in ("macro_precision", "micro_precision", "macro_recall", "micro_recall")])


@query("""SELECT doc_id, array_to_string([CAST(lang = 'de' OR source = 'de' AS INT), CAST(lang = 'src1' OR source = 'src1' AS INT)], ',') AS hot FROM documents""")
def multi_hot(spark, d):
    hot = evalm.multi_hot(F.array("lang", "source"), ["de", "src1"])
    return _t(spark, d, "documents").select("doc_id", F.array_join(hot.cast("array<string>"), ",").alias("hot"))


@query("""SELECT lang, source, count(*) AS n, count(*) FILTER (WHERE doc_id % 3 > 0) AS "natural", count(*) FILTER (WHERE doc_id % 3 = 0) AS synthetic, round(avg(CAST(doc_id % 3 > 0 AS INT)), 6) AS natural_share FROM documents GROUP BY 1, 2""")
def size_summary(spark, d):
    docs = _t(spark, d, "documents").withColumn("synthetic", F.col("doc_id") % 3 == 0)
    return evalm.size_summary(docs.select("lang", "source", "synthetic"), "lang", "source", "synthetic").withColumn("natural_share", _R("natural_share"))


@query("""WITH s AS (SELECT doc_id, greatest(quality, toxic) AS best FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL) SELECT doc_id, best FROM s WHERE best > 0.5 ORDER BY best DESC, doc_id LIMIT 20""")
def positive_scores(spark, d):
    l = _t(spark, d, "labels").where("quality is not null and toxic is not null").select("doc_id", F.array("quality", "toxic").alias("s"))
    return evalm.positive_scores(l, "s", 0.5, ["doc_id"], 20).select("doc_id", "best")


@query("SELECT source, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) >= 2 ORDER BY n DESC, source LIMIT 5")
def frequent_categories(spark, d):
    return evalm.frequent_categories(_t(spark, d, "documents"), "source", 5)


@query(f"""WITH {_LAB} SELECT quality AS a, toxic AS b, count(*) AS n FROM lab GROUP BY 1, 2""")
def crosstab(spark, d):
    return stats.contingency(_lab(spark, d), "quality", "toxic").select(F.col("quality").alias("a"), F.col("toxic").alias("b"), "n")


@query(f"""WITH {_LAB} SELECT doc_id, quality, 'false_positive' AS kind FROM (SELECT * FROM lab WHERE quality = 0 AND n_chars > 1500 ORDER BY doc_id LIMIT 15)""")
def review_list(spark, d):
    from tidemark.operators import scoring

    r = scoring.review_list(_lab(spark, d), "quality", "n_chars", 1500, "false_positive", ["doc_id"], 15)
    return r.select("doc_id", "quality", F.lit("false_positive").alias("kind"))


# ---- samples, sets, increments ---------------------------------------------------------------------------------------

@query("""SELECT doc_id FROM documents ORDER BY right(CAST(doc_id AS VARCHAR), 5), CAST(doc_id AS VARCHAR) LIMIT 30 OFFSET 10""")
def hashed_page(spark, d):
    return sampling.hashed_page(_t(spark, d, "documents").select("doc_id"), "doc_id", 30, 10)


@query("""SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'test' WHEN doc_id % 5 = 1 THEN 'val' ELSE 'train' END AS split FROM documents""")
def listed_split(spark, d):
    docs = _t(spark, d, "documents").select("doc_id")
    lists = docs.where("doc_id % 5 < 2").select("doc_id", F.when(F.col("doc_id") % 5 == 0, "test").otherwise("val").alias("split"))
    return sampling.listed_split(docs, "doc_id", lists, "train")


@query("""SELECT doc_id, CASE WHEN d.doc_id % 2 = 0 THEN lang ELSE CASE WHEN l.doc_id IS NOT NULL THEN 'q' || CAST(quality AS VARCHAR) END END AS lang FROM documents d LEFT JOIN labels l USING (doc_id)""")
def older_column(spark, d):
    now = _t(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("lang"))
    old = _t(spark, d, "labels").select("doc_id", F.concat(F.lit("q"), F.col("quality").cast("string")).alias("lang"))
    return sampling.older_column(now, old, "doc_id", "lang")


@query("""WITH a AS (SELECT DISTINCT doc_id FROM documents WHERE doc_id % 3 > 0), b AS (SELECT DISTINCT doc_id FROM labels) SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'first' WHEN a.doc_id IS NULL THEN 'second' ELSE 'both' END AS held FROM a FULL JOIN b ON a.doc_id = b.doc_id""")
def id_sets(spark, d):
    return sampling.id_sets(_t(spark, d, "documents").where("doc_id % 3 > 0"), _t(spark, d, "labels"), "doc_id")


@query("""SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS index FROM documents""")
def row_index(spark, d):
    return tables.row_index(_t(spark, d, "documents").select("doc_id"), "doc_id")


@query("SELECT event_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND event_id % 7 = 0)")
def unprocessed_some(spark, d):
    e = _t(spark, d, "events")
    return tables.anti_processed(e, e.where("event_type = 'error' and event_id % 7 = 0"), "user_id").select("event_id")


@query("""SELECT lang, n, examples FROM (SELECT lang, count(*) AS n, least(count(*), 3) AS examples FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY 1)""")
def null_feature_rows(spark, d):
    docs = _t(spark, d, "documents").join(_t(spark, d, "labels").select("doc_id", "quality").dropDuplicates(["doc_id"]), "doc_id", "left").join(_t(spark, d, "labels").select("doc_id").distinct().withColumn("known", F.lit(1)), "doc_id", "left")
    return quality.null_rows(docs, "known", ["lang"], 3)


@query("""WITH r AS (SELECT event_type AS method, user_id % 4 AS dataset FROM events WHERE NOT (event_type = 'signup' AND user_id % 4 = 1) GROUP BY 1, 2) SELECT method FROM r GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT dataset) FROM r)""")
def runs_in_every_dataset(spark, d):
    r = _t(spark, d, "events").where("not (event_type = 'signup' and user_id % 4 = 1)").select(F.col("event_type").alias("method"), (F.col("user_id") % 4).alias("dataset"))
    return history.runs_in_all(r, "method", "dataset")


@query("""SELECT event_type AS method, event_id % 3 + 1 AS number, max(value) AS accuracy FROM events WHERE value IS NOT NULL GROUP BY 1, 2""")
def prompt_sheets(spark, d):
    e = _t(spark, d, "events").where("value is not null").withColumn("slot", (F.col("event_id") % 3 + 1))
    wide = e.groupBy(F.col("event_type").alias("method")).agg(*[F.max(F.when(F.col("slot") == i, F.col("value"))).alias(f"Accuracy #{i}") for i in (1, 2, 3)])
    long = history.wide_to_long(wide, ["method"], r"Accuracy #(\d+)", "accuracy")
    return long.where("accuracy is not null").withColumns({"number": F.col("number").cast("long"), "accuracy": F.col("accuracy").cast("double")})
