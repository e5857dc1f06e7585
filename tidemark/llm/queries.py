"""One query for each operator, over its whole table with production parameters, and the SQL to compare with."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import align, bpe, compress, decontam, ego, eliasfano, langid, repair, simhash, substring, suffix, token_cache, warc
from .common import table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_substring_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_passages(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_cache.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.fingerprint_components(table(spark, sf_dir, "documents"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eliasfano.token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(table(spark, sf_dir, "documents"))


def op10_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ego.link_vectors(table(spark, sf_dir, "embeddings"))


def op11_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(repair.damage(table(spark, sf_dir, "conversations")), gone="_gone")


QUERIES = {f.__name__: f for f in (
    op1_warc, op2_decontaminate, op3_substring_chains, op4_token_counts, op5_simhash, op6_language, op7_token_files, op8_byte_bpe, op9_suffix_dedup, op10_embedding_links,
    op11_align, op12_quality, op13_repair,
)}

ORACLES = {
    "op1_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        d AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha1(h) AS payload_digest FROM p),
        m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN first END AS refers_to
        FROM m""",
    "op9_suffix_dedup": """
    WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
    w AS (SELECT doc_id, i, md5(h[2 * i - 1 : 2 * i + 398]) AS m FROM (SELECT doc_id, h, unnest(range(1, n - 198)) AS i FROM d WHERE n >= 200)),
    t AS (SELECT m FROM w GROUP BY m HAVING count(*) > 1), s AS (SELECT doc_id, i, i - 199 > coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -1000) + 1 AS fresh FROM w SEMI JOIN t USING (m)),
    g AS (SELECT doc_id, i, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM s), p AS (SELECT doc_id, k, min(i) AS a, max(i) + 199 AS b FROM g GROUP BY 1, 2),
    x AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM p),
    y AS (SELECT doc_id, sum(b - a + 1) AS n_removed, count(*) AS n_spans, max(b) AS last FROM x GROUP BY 1),
    z AS (SELECT x.doc_id, string_agg(h[2 * before + 1 : 2 * (a - 1)], '' ORDER BY a) AS kept FROM x JOIN d USING (doc_id) GROUP BY 1)
    SELECT d.doc_id, d.n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(CASE WHEN y.doc_id IS NULL THEN h ELSE coalesce(kept, '') || h[2 * last + 1 :] END)) AS kept_sha256
    FROM d LEFT JOIN y USING (doc_id) LEFT JOIN z USING (doc_id)""",
    "op10_embedding_links": """
    WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
    u AS (SELECT vec_id, label, x FROM v WHERE label IS NOT NULL AND x IS NOT NULL AND len(list_filter(x, lambda y: y IS NULL OR isnan(y) OR isinf(y))) = 0 AND len(list_filter(x, lambda y: y <> 0)) > 0),
    e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.93),
    r(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
    c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM e GROUP BY a)
    SELECT v.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, v.vec_id = c.component_id AS kept FROM v JOIN c ON c.a = v.vec_id LEFT JOIN n ON n.a = v.vec_id""",
    "op13_repair": """
    WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
    h AS (SELECT *, xor(list_reduce(list_transform(string_split(key, ''), lambda c: CAST(ascii(c) AS BIGINT)),
        lambda crc, byte: list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda x, i: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END), xor(crc, byte)), 4294967295), 4294967295) % 20 AS kind FROM k),
    d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
        FROM (SELECT *, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) FROM h WHERE kind <> 0)),
    n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
    f AS (SELECT *, left(role, 1) AS c, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2
        WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 3 ELSE 0 END AS fault, left(role, 1) || lead(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS pair FROM n),
    c AS (SELECT k.conv_id, coalesce(max(f.n), 0) AS n FROM (SELECT DISTINCT conv_id FROM conversations) k LEFT JOIN (SELECT conv_id, max(i) AS n FROM f GROUP BY 1) f ON f.conv_id IS NOT DISTINCT FROM k.conv_id GROUP BY 1),
    g AS (SELECT conv_id, n AS i, {'cost': 0, 'audit': '', 'turns': CAST([] AS VARCHAR[])} AS g0, {'cost': 4, 'audit': 'II', 'turns': ['user:', 'assistant:']} AS g1, {'cost': 2, 'audit': 'I', 'turns': ['assistant:']} AS g2, {'cost': 0, 'audit': '', 'turns': CAST([] AS VARCHAR[])} AS g3 FROM c
        UNION ALL
        SELECT conv_id, i - 1, least(h0, {'cost': 2 + u.cost, 'audit': 'I' || u.audit, 'turns': list_prepend('user:', u.turns)}), least(h1, {'cost': 2 + u.cost, 'audit': 'I' || u.audit, 'turns': list_prepend('user:', u.turns)}), u, least(h3, {'cost': 2 + h2.cost, 'audit': 'I' || h2.audit, 'turns': list_prepend('user:', h2.turns)})
        FROM (SELECT *, least(h2, {'cost': 2 + h3.cost, 'audit': 'I' || h3.audit, 'turns': list_prepend('assistant:', h3.turns)}) AS u FROM (
            SELECT g.conv_id, g.i,
                least({'cost': 3 + g0.cost, 'audit': 'D' || g0.audit, 'turns': g0.turns}, {'cost': 2 + more + g2.cost, 'audit': 'R' || g2.audit, 'turns': list_prepend('user:' || text, g2.turns)},
                    CASE c WHEN 's' THEN {'cost': more + g1.cost, 'audit': 'K' || g1.audit, 'turns': list_prepend(role || ':' || text, g1.turns)} WHEN 'u' THEN {'cost': more + g2.cost, 'audit': 'K' || g2.audit, 'turns': list_prepend(role || ':' || text, g2.turns)} ELSE none END) AS h0,
                least({'cost': 3 + g1.cost, 'audit': 'D' || g1.audit, 'turns': g1.turns}, {'cost': 2 + more + g2.cost, 'audit': 'R' || g2.audit, 'turns': list_prepend('user:' || text, g2.turns)},
                    CASE c WHEN 'u' THEN {'cost': more + g2.cost, 'audit': 'K' || g2.audit, 'turns': list_prepend(role || ':' || text, g2.turns)} ELSE none END) AS h1,
                least({'cost': 3 + g2.cost, 'audit': 'D' || g2.audit, 'turns': g2.turns}, {'cost': 2 + more + g3.cost, 'audit': 'R' || g3.audit, 'turns': list_prepend('assistant:' || text, g3.turns)},
                    CASE c WHEN 'a' THEN {'cost': more + g3.cost, 'audit': 'K' || g3.audit, 'turns': list_prepend(role || ':' || text, g3.turns)} ELSE none END) AS h2,
                least({'cost': 3 + g3.cost, 'audit': 'D' || g3.audit, 'turns': g3.turns}, {'cost': 2 + more + g2.cost, 'audit': 'R' || g2.audit, 'turns': list_prepend('user:' || text, g2.turns)},
                    CASE c WHEN 'u' THEN {'cost': more + g2.cost, 'audit': 'K' || g2.audit, 'turns': list_prepend(role || ':' || text, g2.turns)} ELSE none END) AS h3
            FROM g JOIN (SELECT *, CASE fault WHEN 0 THEN 0 WHEN 3 THEN 1 ELSE 1000000 END AS more, {'cost': 2000000, 'audit': '~', 'turns': CAST([] AS VARCHAR[])} AS none FROM f) f ON f.conv_id IS NOT DISTINCT FROM g.conv_id AND f.i = g.i))),
    s AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 1) AS blank, count_if(fault = 2) AS duplicate, count_if(fault = 3) AS truncated, count_if(pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY 1)
    SELECT g.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal,
        CAST(g0.cost AS BIGINT) AS cost, g0.audit AS audit, sha256(array_to_string(g0.turns, chr(10))) AS repaired_sha256
    FROM g LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM g.conv_id WHERE g.i = 0""",
}
