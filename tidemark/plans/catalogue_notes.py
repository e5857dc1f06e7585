"""More registered queries: sections, chunks and phrases of notes, keyword tables, refreshed snapshots and patient rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import notes, text
from tidemark.operators import keywords, pooling
from tidemark.plans.catalogue import _K, _events, _t, query
from tidemark.sources import tables

# ---- sections and sentences ------------------------------------------------------------------------------------------

_NOTE = """note AS (SELECT doc_id, concat('Source: ', source, chr(10), 'Language (short):', chr(10), lang, chr(10), 'History of Words:', chr(10), text, chr(10), '--- ', chr(10), 'Plan:', chr(10), '1. see ', lang, chr(10), 'and more', chr(10), ' 2. rest', chr(10), chr(10),
    CASE WHEN doc_id % 3 = 0 THEN 'Disp:' ELSE 'Follow up:' END, chr(10), 'Return:', chr(10), 'in ', n_chars, ' days') AS note FROM documents)"""


def _notes(spark, d):
    lines = ["Source: {}", "Language (short):", "{}", "History of Words:", "{}", "--- ", "Plan:", "1. see {}", "and more", " 2. rest", "", "{}", "Return:", "in {} days"]
    fill = iter([F.col("source"), F.col("lang"), F.col("text"), F.col("lang"), F.when(F.col("doc_id") % 3 == 0, "Disp:").otherwise("Follow up:"), F.col("n_chars")])
    parts = [F.concat(F.lit(x.split("{}")[0]), next(fill), F.lit(x.split("{}")[1])) if "{}" in x else F.lit(x) for x in lines]
    return _t(spark, d, "documents").select("doc_id", F.concat_ws("\n", *parts).alias("note"))


_TITLE = lambda x: f"(ends_with({x}, ':') AND {x} <> 'Disp:' AND len(list_filter(list_filter(regexp_split_to_array(regexp_replace({x}[:-2], '[(][^)]*[)]', '', 'g'), '[ \\t]+'), lambda w: w <> ''), lambda w: NOT (w IN ('of', 'on', 'or') OR regexp_matches(w, '^\\p{{Lu}}')))) = 0)"
_SECTIONS = lambda source, column: f"""l AS (SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1) AS i FROM (SELECT doc_id, list_transform(regexp_split_to_array(regexp_replace({column}, '(-{{3,}}|_{{3,}})', chr(10) || '\\1' || chr(10), 'g'), chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13))) AS a FROM {source})),
    h AS (SELECT *, regexp_extract(line, '^(\\p{{Lu}}[^:]*:)[ \\t]', 1) AS head FROM l), k AS (SELECT doc_id, i, line, CASE WHEN line = '' THEN 'blank' WHEN regexp_matches(line, '^(-{{3,}}|_{{3,}})$') THEN 'rule' WHEN regexp_matches(line, '^[0-9]+[.]') THEN 'item' WHEN {_TITLE('line')} THEN 'title' WHEN head <> '' AND {_TITLE('head')} THEN 'inline' ELSE 'text' END AS kind FROM h),
    b AS (SELECT *, CASE WHEN kind <> 'blank' AND (kind IN ('title', 'inline', 'item', 'rule') OR coalesce(lag(kind) OVER (PARTITION BY doc_id ORDER BY i), 'blank') IN ('blank', 'rule', 'title')) THEN 1 ELSE 0 END AS fresh FROM k),
    g AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS part FROM b), p AS (SELECT doc_id, part, arg_min(kind, i) AS kind, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS body FROM g WHERE kind <> 'blank' GROUP BY 1, 2),
    w AS (SELECT *, lag(kind) OVER o = 'title' AND kind IN ('text', 'item') AND n = 1 AND coalesce(lead(kind) OVER o IN ('title', 'inline'), true) AS answers FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY part)),
    q AS (SELECT *, sum(CASE WHEN coalesce(answers, false) THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY part) - 1 AS section_index FROM w),
    sec AS (SELECT doc_id, CAST(section_index AS INT) AS section_index, CASE WHEN bool_or(coalesce(answers, false)) THEN 'answer' ELSE min(kind) END AS kind, string_agg(body, chr(10) ORDER BY part) AS section FROM q GROUP BY doc_id, section_index)"""  # noqa: E731


@query(f"""WITH {_NOTE}, {_SECTIONS('note', 'note')} SELECT doc_id, section_index, kind, section FROM sec""")
def note_sections(spark, d):
    return notes.sections(_notes(spark, d), "note").drop("note")


@query(f"""WITH {_SECTIONS('documents', 'text')}, c AS (SELECT *, CASE WHEN kind = 'text' THEN string_split(regexp_replace(section, '([.!?])\\s+([\\p{{Lu}}\\p{{Nd}}])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) ELSE [section] END AS a FROM sec)
    SELECT doc_id, section_index, kind, CAST(generate_subscripts(a, 1) - 1 AS INT) AS part_index, unnest(a) AS sentence FROM c""")
def note_sentences(spark, d):
    return notes.sentences(_t(spark, d, "documents").select("doc_id", "text"), "text").drop("text")


# ---- chunks and phrases ----------------------------------------------------------------------------------------------

_BLANKS = "[ \\t\\n\\x0b\\f\\r]+"
_WORDS = lambda x: f"list_filter(regexp_split_to_array({x}, '{_BLANKS}'), lambda w: w <> '')"
_LEVELS = f"""CASE WHEN len({_WORDS('text')}) <= 200 THEN [text] ELSE flatten(list_transform(string_split(text, chr(10) || chr(10)), lambda p: CASE WHEN len({_WORDS('p')}) <= 200 THEN [p] ELSE
    flatten(list_transform(string_split(p, chr(10)), lambda q: CASE WHEN len({_WORDS('q')}) <= 200 THEN [q] ELSE {_WORDS('q')} END)) END)) END"""


@query(f"""WITH RECURSIVE c AS (SELECT doc_id, list_filter(list_transform({_LEVELS}, lambda z: {{'p': trim(z, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'n': len({_WORDS('z')})}}), lambda z: z.n > 0) AS ps FROM documents),
    r AS (SELECT doc_id, ps, CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS done, '' AS now, CAST(0 AS BIGINT) AS n FROM c
        UNION ALL SELECT doc_id, ps, i + 1, CASE WHEN full_ THEN list_append(done, now) ELSE done END, CASE WHEN lead_ = '' THEN x.p ELSE lead_ || ' ' || x.p END, kept + x.n FROM (
            SELECT *, CASE WHEN full_ THEN CASE WHEN tail + x.n <= 200 THEN array_to_string({_WORDS('now')}[-tail:], ' ') ELSE '' END ELSE now END AS lead_, CASE WHEN full_ THEN CASE WHEN tail + x.n <= 200 THEN tail ELSE 0 END ELSE n END AS kept FROM (
                SELECT *, ps[i + 1] AS x, n > 0 AND n + ps[i + 1].n > 200 AS full_, least(n, 20) AS tail FROM r WHERE i < len(ps)))),
    o AS (SELECT doc_id, CASE WHEN n > 0 THEN list_append(done, now) ELSE done END AS a FROM r WHERE i = len(ps))
    SELECT doc_id, CAST(generate_subscripts(a, 1) - 1 AS INT) AS chunk_index, unnest(a) AS chunk FROM o""")
def separator_chunks(spark, d):
    return text.split_chunks(_t(spark, d, "documents").select("doc_id", "text"), "text").drop("text")


@query(f"""WITH w AS (SELECT doc_id, {_WORDS('text')} AS w FROM documents), h AS (SELECT doc_id, w, unnest(range(0, len(w))) AS i FROM w),
    p AS (SELECT doc_id, len(w) AS n, i, 0 AS id, 2 AS k FROM h WHERE regexp_matches(w[i + 1], '(?i)(^|[^\\p{{L}}\\p{{N}}_])of$') AND regexp_matches(w[i + 2], '(?i)^the($|[^\\p{{L}}\\p{{N}}_])')
        UNION ALL SELECT doc_id, len(w), i, 1, 1 FROM h WHERE regexp_matches(w[i + 1], '(?i)(^|[^\\p{{L}}\\p{{N}}_])que($|[^\\p{{L}}\\p{{N}}_])')),
    s AS (SELECT doc_id, id, greatest(i - 3, 0) AS a, least(i + k + 3, n) AS b FROM p), f AS (SELECT *, a > coalesce(max(b) OVER (PARTITION BY doc_id ORDER BY a, b, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS fresh FROM s),
    g AS (SELECT *, sum(CAST(fresh AS INT)) OVER (PARTITION BY doc_id ORDER BY a, b, id) AS part FROM f), z AS (SELECT doc_id, min(a) AS a, max(b) AS b, string_agg(DISTINCT CASE id WHEN 0 THEN 'of the' ELSE 'que' END, '|' ORDER BY CASE id WHEN 0 THEN 'of the' ELSE 'que' END) AS found FROM g GROUP BY doc_id, part)
    SELECT z.doc_id, CAST(a AS INT) AS start, CAST(b AS INT) AS "end", found, array_to_string(w.w[a + 1 : b], ' ') AS context FROM z JOIN w USING (doc_id)""")
def phrase_stretches(spark, d):
    got = text.phrases_in_context(_t(spark, d, "documents").select("doc_id", "text"), "text", ["of the", "que"], 3)
    return got.select("doc_id", "start", "end", F.array_join("found", "|").alias("found"), "context")


_KEYS = "k AS (SELECT DISTINCT k FROM (SELECT w[1] AS k FROM v UNION ALL SELECT w[3] || ' ' || w[4] FROM v UNION ALL SELECT w[2] || ', ' || w[3] FROM v) WHERE trim(k) <> '')"


def _keys(spark, d):
    w = text.word_array(F.col("text"))
    v = _t(spark, d, "benchmark").select(w.alias("w"))
    at = lambda i: F.get("w", F.lit(i))
    return v.select(F.explode(F.array(at(0), F.concat(at(2), F.lit(" "), at(3)), F.concat(at(1), F.lit(", "), at(2)))).alias("k"))


@query(f"""WITH v AS (SELECT {_WORDS('text')} AS w FROM benchmark), {_KEYS},
    f AS (SELECT doc_id, string_agg(k, '|' ORDER BY k) AS found FROM documents JOIN k ON CASE WHEN contains(lower(text), lower(k)) AND regexp_matches(k, '[\\p{{L}}\\p{{N}}_]') THEN regexp_matches(text, '(?i)(^|[^\\p{{L}}\\p{{N}}_])' || regexp_escape(k) || '($|[^\\p{{L}}\\p{{N}}_])') ELSE false END GROUP BY 1)
    SELECT doc_id, coalesce(found, '') AS found FROM documents LEFT JOIN f USING (doc_id)""")
def keyword_table(spark, d):
    got = keywords.keyword_table_hits(_t(spark, d, "documents").select("doc_id", "text"), "text", _keys(spark, d), "k")
    return got.select("doc_id", F.array_join("found", "|").alias("found"))


@query(f"""WITH v AS (SELECT {_WORDS('text')} AS w FROM benchmark), {_KEYS}, f AS (SELECT doc_id, string_agg(k, '|' ORDER BY k) AS found FROM documents JOIN k ON contains(lower(text), lower(k)) GROUP BY 1)
    SELECT doc_id, coalesce(found, '') AS found FROM documents LEFT JOIN f USING (doc_id)""")
def substring_table(spark, d):
    got = keywords.keyword_table_hits(_t(spark, d, "documents").select("doc_id", "text"), "text", _keys(spark, d), "k", "substring")
    return got.select("doc_id", F.array_join("found", "|").alias("found"))


# ---- snapshots and patient rows --------------------------------------------------------------------------------------

@query("""WITH f(feature, version) AS (VALUES ('view', 2), ('click', 1), ('error', 1), ('signup', 3)), s AS (SELECT 1 AS priority, user_id, event_type AS feature, CAST(max(event_id) AS VARCHAR) AS value, 1 AS version FROM events WHERE user_id % 3 = 0 AND event_type IN ('view', 'click', 'age_group', 'purchase') GROUP BY 2, 3
        UNION ALL SELECT 2, user_id, event_type, CAST(min(event_id) AS VARCHAR), 2 FROM events WHERE user_id % 2 = 0 GROUP BY 2, 3),
    m AS (SELECT user_id, feature, value, version FROM s JOIN (SELECT user_id, min(priority) AS priority FROM s GROUP BY 1) USING (user_id, priority)), kept AS (SELECT m.* FROM m LEFT JOIN f USING (feature) WHERE f.version IS NULL OR m.version >= f.version),
    todo AS (SELECT u.user_id, f.feature, f.version FROM (SELECT DISTINCT user_id FROM s) u JOIN f ON true LEFT JOIN (SELECT DISTINCT user_id, feature FROM kept) k ON k.user_id = u.user_id AND k.feature = f.feature WHERE k.user_id IS NULL),
    fresh AS (SELECT t.user_id, t.feature, c.value, t.version FROM todo t LEFT JOIN (SELECT user_id, event_type AS feature, CAST(count(*) AS VARCHAR) AS value FROM events GROUP BY 1, 2) c USING (user_id, feature)), a AS (SELECT user_id, CAST(20 + user_id % 50 AS VARCHAR) AS value FROM events WHERE user_id % 5 > 0 GROUP BY 1)
    SELECT * FROM kept UNION ALL SELECT * FROM fresh UNION ALL SELECT u.user_id, 'age', a.value, NULL FROM (SELECT DISTINCT user_id FROM s) u JOIN a USING (user_id)""")
def refreshed_snapshots(spark, d):
    e = _t(spark, d, "events").withColumnRenamed("event_type", "feature")
    one = lambda rows, fold, priority, version: rows.groupBy("user_id", "feature").agg(fold("event_id").cast("string").alias("value")).withColumns({"priority": F.lit(priority), "version": F.lit(version)})
    snapshots = one(e.where("user_id % 3 = 0 and feature in ('view', 'click', 'purchase')"), F.max, 1, 1).unionByName(one(e.where("user_id % 2 = 0"), F.min, 2, 2))
    versions = spark.createDataFrame([("view", 2), ("click", 1), ("error", 1), ("signup", 3)], "feature string, version int")
    counts = lambda todo: e.join(todo, ["user_id", "feature"]).groupBy("user_id", "feature").agg(F.count("*").cast("string").alias("value"))
    ages = e.where("user_id % 5 > 0").groupBy("user_id").agg((F.first("user_id") % 50 + 20).cast("string").alias("value"))
    return tables.refreshed(snapshots, versions, "user_id", "feature", "priority", "version", "value", counts, ages).select("user_id", "feature", "value", "version")


_TYPES = ["view", "click", "error", "purchase", "signup"]
_POOLED = {  # rule: what it needs, SQL over v (a number as text) and p (the position)
    "any": ((), "CAST(coalesce(bool_or(v = 'Yes'), false) AS VARCHAR)"), "max": ((), "coalesce(CAST(max(TRY_CAST(v AS BIGINT)) AS VARCHAR), 'F')"),
    "duration": ((), "CASE WHEN count(TRY_CAST(v AS BIGINT)) = 0 THEN 'F' ELSE CAST(coalesce(sum(DISTINCT CASE WHEN TRY_CAST(v AS BIGINT) > 0 THEN TRY_CAST(v AS BIGINT) END), 0) AS VARCHAR) END"),
    "first_present": ((["5", "1", "3"], "none"), "CASE WHEN bool_or(v = '5') THEN '5' WHEN bool_or(v = '1') THEN '1' WHEN bool_or(v = '3') THEN '3' ELSE 'none' END"),
    "ranked": (["2", "4", "6"], "coalesce(arg_max(v, array_position(['2', '4', '6'], v)) FILTER (WHERE v IN ('2', '4', '6')), arg_min(v, p))"), "spread": (None, "CAST(count(DISTINCT v) AS VARCHAR) || ':' || CAST(count(*) AS VARCHAR)"),
}
_REGISTRY = [{"feature": f"{t}_{i}", "rule": list(_POOLED)[(i + j) % 6], "how": _POOLED[list(_POOLED)[(i + j) % 6]][0], "default": "-"} for j, t in enumerate(_TYPES) for i in range(5)]


@query(f"""WITH r AS (SELECT user_id, event_type || '_' || CAST(event_id % 5 AS VARCHAR) AS feature, event_id AS p, CASE WHEN event_id % 11 = 0 THEN 'Yes' ELSE CAST({_K} % 8 AS VARCHAR) END AS v FROM events)
    SELECT user_id, {', '.join(f"coalesce((SELECT {_POOLED[x['rule']][1]} FROM r WHERE r.user_id = u.user_id AND feature = '{x['feature']}' HAVING count(*) > 0), '-') AS {x['feature']}" for x in _REGISTRY)} FROM (SELECT DISTINCT user_id FROM events) u""")
def patient_rows(spark, d):
    e = _events(spark, d)
    records = e.select("user_id", F.concat_ws("_", "event_type", (F.col("event_id") % 5).cast("string")).alias("feature"), F.col("event_id").alias("p"), F.when(F.col("event_id") % 11 == 0, "Yes").otherwise((F.col("k") % 8).cast("string")).alias("v"))
    spread = lambda pdf: f"{pdf['v'].nunique()}:{pdf['n'].sum()}"
    return pooling.patient_row(records, "user_id", "feature", "v", "p", _REGISTRY, {"spread": spread})
