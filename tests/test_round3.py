"""Cases of the third round of findings: each failed before its change."""

from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.operators import evalm
from tidemark.plans import catalogue
from test_oracles import rows


def same_as_sql(spark, folder, name, tables):
    con = duckdb.connect()
    for table, frame in tables.items():
        frame.write.parquet(f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    got = catalogue.QUERIES[name](spark, str(folder))
    cursor = con.execute(catalogue.ORACLES[name])
    want = rows([c[0] for c in cursor.description], cursor.fetchall())
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == want
    assert want[1]


@pytest.mark.parametrize("name", ["km_curve", "logrank_test"])
def test_survival_times_of_half_thousands(spark, tmp_path, name):
    """0.5 and 2.5 thousand go to the even number, as in SQL."""
    balances = [500.0, 1500.0, 2500.0, -500.0, -1500.0, 4500.0, 3200.0, 700.0, 2400.0, 6500.0]
    people = [(i, f"n{i}", i // 3 % 5, b, "m") for i, b in enumerate(balances * 4)]
    same_as_sql(spark, tmp_path, name, {"customer": spark.createDataFrame(people, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string")})


def test_survival_of_a_null_time(spark, tmp_path):
    people = [(i, f"n{i}", 0, None if i < 3 else 1000.0 * (i % 4), "m") for i in range(20)]
    same_as_sql(spark, tmp_path, "km_curve", {"customer": spark.createDataFrame(people, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string")})


def test_spans_that_touch_by_parts_of_seconds(spark, tmp_path):
    """Starts are the nearest seconds: 3600.6 s behind a span's start is outside of it, 3600.4 s inside."""
    at = datetime(2024, 1, 1)
    given = [(1, 0.0, 1, "click"), (2, 3600.4, 1, "view"), (3, 3600.6, 1, "view"), (4, 0.0, 2, "error"), (5, -600.4, 2, "view"), (6, -600.6, 2, "view"), (7, 0.5, 3, "click"), (8, 3601.5, 3, "view"), (9, 3601.0, 3, "view")]
    events = [(i, at + timedelta(seconds=s), u, t, 1.0, '{"k": 1}') for i, s, u, t in given]
    same_as_sql(spark, tmp_path, "span_overlap", {"events": spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")})


@pytest.mark.parametrize("inclusive", [False, True])
def test_scores_at_thresholds(spark, inclusive):
    """A score that equals a threshold, or is next to it, is on the side that the comparison of both numbers gives."""
    import math

    scores = [s for t in range(101) for s in (t / 100, math.nextafter(t / 100, -1), math.nextafter(t / 100, 2))] + [-1.0, 3.0]
    frame = spark.createDataFrame([(i % 3 % 2, s) for i, s in enumerate(scores)], "y int, s double")
    passes = (lambda s, t: s >= t) if inclusive else (lambda s, t: s > t)
    want = {t / 100: tuple(sum(passes(s, t / 100) and i % 3 % 2 == y for i, s in enumerate(scores)) for y in (1, 0)) for t in range(1, 100)}
    assert {r.threshold: (r.tp, r.fp) for r in evalm.sweep(frame, "y", "s", inclusive=inclusive).collect()} == want


def test_patient_rows_of_many_entities(spark):
    """Groups that go on over batches are whole, and none is a call of its own."""
    from tidemark.operators import pooling

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = [(i if i else None, "odd", f"{v:02d}", 100 - v) for i in range(5) for v in range(1 + 4 * i)] + [(2**60 + 1, "odd", None, 1), (2**60 + 1, "even", "x", None)]
        long = spark.createDataFrame(rows, "id long, feature string, value string, pos long")
        own = {"joined": lambda pdf: ",".join(v or "-" for v in pdf["value"])}
        registry = [{"feature": f, "rule": "joined"} for f in ("odd", "even")]
        frame = pooling.patient_row(long, "id", "feature", "value", "pos", registry, own)
        got = {r.id: (r.odd, r.even) for r in frame.collect()}
        assert got == {i if i else None: (",".join(f"{v:02d}" for v in reversed(range(1 + 4 * i))), None) for i in range(5)} | {2**60 + 1: ("-", "x")}
        assert "FlatMapGroupsInPandas" not in frame._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_ties_of_any_number(spark, monkeypatch):
    """Sums over a time's deaths equal the sums term by term, also where they are cut into stretches; Spark steps over no death."""
    from pyspark.sql import functions as F

    from tidemark.operators import cox

    monkeypatch.setattr(cox, "TIES", 7)
    times = [(5.0, 2.0, 3), (9.0, 8.5, 1), (40.0, 30.0, 20), (3.0, 1.0, 4), (7.0, 7.0 - 1e-6, 7)]
    frame = spark.createDataFrame(times, "r double, e double, d long").coalesce(1)
    for row in frame.select("r", "e", "d", cox._tie_sums(F.col("r"), F.col("e"), F.col("d")).alias("x")).collect():
        terms = [(f, 1 / (row.r - f * row.e)) for f in (k / row.d for k in range(row.d))]
        want = [sum(g(f, s) for f, s in terms) for g in (lambda f, s: s, lambda f, s: f * s, lambda f, s: s * s, lambda f, s: f * s * s, lambda f, s: f * f * s * s)]
        assert list(row.x) == pytest.approx(want, rel=1e-12)


def test_ratios_that_end_in_a_half(spark, tmp_path):
    """3663 of 7040 is 0.5203125, whose sixth place SQL takes from the product with a million."""
    labels = spark.range(7040).select(F.col("id").alias("doc_id"), (F.col("id") < 3663).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    docs = labels.select("doc_id", F.lit("en").alias("lang"), F.lit(3000).cast("long").alias("n_chars"))
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    for table in ("labels", "documents"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    got = {r.threshold: (r.precision, r.recall, r.f1) for r in catalogue.threshold_sweep(spark, str(tmp_path)).collect()}
    want = con.execute(f"SELECT threshold, precision, recall, f1 FROM ({catalogue.ORACLES['threshold_sweep']})").fetchall()
    assert got == {t: tuple(x) for t, *x in want}
    assert got[0.25][0] == 0.520312


def test_every_pair_of_frequent_passages(spark):
    """Three documents of 17 or more hold four lines in a row, whose links all are frequent and first held by others; ``every`` finds the last ones' whole passage."""
    import numpy as np

    from tidemark.llm import substring

    rng = np.random.default_rng(3)
    text = lambda n: [f"w{i}" for i in rng.integers(0, 10**6, n)]
    lines = [text(24) for _ in range(4)]
    docs = [(10 * i + j, " ".join(text(60) + lines[j] + lines[j + 1] + text(60))) for i in range(20) for j in range(3)]
    docs += [(1000 + i, " ".join(text(60) + sum(lines, []) + text(60))) for i in range(3)]
    got = {(r.doc_id, r.source_id) for r in substring.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string"), every=True).collect() if r.end - r.start >= 90}
    assert got == {(1001, 1000), (1002, 1000)}


def test_crowded_hash_by_stretches(spark):
    """Windows under one hash that 400 different texts hold are marked by stretches: the result is the same, and few windows are dealt out."""
    import hashlib

    import numpy as np
    from tidemark.llm import suffix

    rng = np.random.default_rng(4)
    some = lambda n: bytes(rng.integers(97, 123, n, np.uint8))
    line = some(320)
    texts = [some(150) + line[i % 5 :] + some(150) for i in range(400)]
    got = {r.doc_id: (r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text binary").selectExpr("doc_id", "cast(text as string) text"), crowd=2).collect()}
    count = {}
    for t in texts:
        for i in range(len(t) - 199):
            count[t[i : i + 200]] = count.get(t[i : i + 200], 0) + 1
    for k, t in enumerate(texts):
        hit = np.zeros(len(t), bool)
        for i in range(len(t) - 199):
            if count[t[i : i + 200]] > 1:
                hit[i : i + 200] = True
        assert got[k] == (int(hit.sum()), int(hit[:1].sum() + (hit[1:] & ~hit[:-1]).sum()), hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~hit])).hexdigest())
    # stretches of a run cover its starts once, and those of equal windows hold the same bytes
    cores = {}
    for t in texts[:40]:
        for anchor, start, n in zip(*(x.tolist() for x in suffix.runs(t))):
            signed = anchor - (1 << 64) if anchor >> 63 else anchor
            cut = list(suffix.stretches(t[start : start + n + 199], signed))
            assert sorted(x for _, at, m in cut for x in range(at, at + m)) == list(range(n)) and max(m for _, _, m in cut) <= suffix.STRETCH
            for core, at, m in cut:
                for x in range(start + at, start + at + m):
                    assert core in t[x : x + 200] and cores.setdefault(t[x : x + 200], core) == core


def test_workers_give_memory_back(spark, monkeypatch):
    """Batches pass as they are, and free memory is given back once, after the last."""
    from tidemark.llm import bpe, common

    calls = []
    monkeypatch.setattr(common.gc, "collect", lambda: calls.append(1))
    work = common.emptied(lambda batches: (b + 1 for b in batches))
    seen = [(x, len(calls)) for x in work(iter([1, 2, 3]))]
    assert seen == [(2, 0), (3, 0), (4, 0)] and len(calls) == 1
    assert common.emptied(bpe._back).__name__ == "_back"


def test_no_word_of_a_text_is_moved_to_a_keyword(spark):
    """a small table of keywords goes to the texts; their words and strings aren't moved, and a phrase is compared in lower case."""
    import re

    from tidemark.operators import keywords

    rows = [(1, "Chest Pain, ab😀c"), (2, "is ſo and chest  pain"), (3, "ab"), (4, None), (5, ""), (6, "x is so")]
    frame = spark.createDataFrame(rows, "id int, t string")
    keys = ["chest pain", "b😀c", "😀", "ab", "is so", "st Pa"]
    dim = spark.createDataFrame([(k,) for k in keys], "keyword string")
    for mode, want in {"word": {1: ["ab", "chest pain"], 2: [], 3: ["ab"], 4: None, 5: [], 6: ["is so"]}, "substring": {1: ["ab", "b😀c", "chest pain", "st Pa", "😀"], 2: [], 3: ["ab"], 4: None, 5: [], 6: ["is so"]}}.items():
        found = keywords.keyword_table_hits(frame, "t", dim, "keyword", mode)
        assert not re.search(r"hashpartitioning\(gram", found._jdf.queryExecution().executedPlan().toString())
        assert {r.id: r.found for r in found.collect()} == want


def test_numbers_of_grams():
    """Each string of up to three characters has a number of its own."""
    from tidemark.operators.keywords import _gram_numbers

    for text in ("", "a", "ab", "\0a\0\0b", "x😀y\U0010ffffx😀y", "abcabc"):
        grams = {text[i : i + n] for n in (1, 2, 3) for i in range(len(text) - n + 1)}
        assert len(_gram_numbers(text, True)) == len(grams)
        assert len(_gram_numbers(text, False)) == len({g for g in grams if len(g) == min(3, len(text))})
        assert all(set(_gram_numbers(g, False)) <= set(_gram_numbers(text, True)) for g in grams)


def test_batches_of_whole_texts_come_in_parts(monkeypatch):
    """The pipeline: no function turns ten thousand whole texts into strings at once; rows and their order stay."""
    import pyarrow as pa

    from tidemark.llm import common

    monkeypatch.setattr(common, "BATCH_BYTES", 1000)
    schema = pa.schema([("id", pa.int64()), ("text", pa.string())])
    batches = [pa.RecordBatch.from_pydict({"id": list(range(n)), "text": [None if i % 7 == 0 else "é" * (5000 * (i == 3) + i) for i in range(n)]}, schema) for n in (0, 1, 50, 3)]
    parts = []

    def work(got):
        for b in got:
            parts.append(b)
            yield b

    out = pa.Table.from_batches(list(common.emptied(work)(iter(batches))))
    assert out.equals(pa.Table.from_batches(batches)) and max(b.num_rows for b in parts) < 50


def test_runs_of_letters_need_no_pattern(monkeypatch):
    """op7_token_files: only units that aren't a run of letters are split by the pattern; ids stay those of the library."""
    import numpy as np
    import public_tokenizers

    from tidemark.llm import units

    memo, seen, split = units.LibraryMemo(public_tokenizers.path("byte_bpe_50k.json")), [], units.words
    monkeypatch.setattr(units, "words", lambda u: seen.append(u) or split(u))
    texts = ["Zwölf Boxkämpfer jagen, don't we?\nñandú ǅ ªº x2 ٣ ʰ中文 naïve", " lead\t tab  two\n\n", "ⅷ 𝔘nicode a̐b ''s", None, ""]
    got = [np.frombuffer(x, "<u4").tolist() for x in memo.ids(texts)]
    assert got == [memo.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert seen and not any(u.strip().isalpha() for u in seen if u[1:])
