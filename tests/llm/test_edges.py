"""Very long texts, repeats, ties, answers, and what each archive record needs; pieces of long texts against the whole."""

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import common, decontam, langid, simhash, substring, suffix, warc
from tidemark.llm.common import free_name


def test_long_text_fingerprint():
    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 1 << 63, 100_000, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 100_000).astype(np.uint64)
    want = sum(1 << b for b in range(64) if 2 * int((hashes >> np.uint64(b) & np.uint64(1)).sum()) > len(hashes))
    assert simhash.majority(hashes) & (1 << 64) - 1 == want


def test_long_text_seeds():
    words = np.random.default_rng(2).integers(0, 1 << 63, 150_000, dtype=np.uint64)
    whole, at = substring.seeds(words)
    parts = {}
    for a in range(0, len(words) - 200, 50_000):
        h, p = substring.seeds(words[a : a + 50_200])
        parts |= {int(x) + a: int(y) for x, y in zip(p, h) if (x > 10 or a == 0) and (x < 50_150 or a + 50_200 >= len(words))}
    assert parts.items() <= dict(zip(at.tolist(), whole.tolist())).items() and len(at) > 150_000 / 4


def test_long_text_runs(monkeypatch):
    rng = np.random.default_rng(3)
    text = rng.integers(97, 101, 30_000).astype(np.uint8).tobytes()

    def by_start():
        anchors, first, n = suffix.runs(text)
        assert int(n.sum()) == len(text) - 199
        return [(int(a), int(s)) for a, f, k in zip(anchors, first, n) for s in range(int(f), int(f + k))]

    want = by_start()
    monkeypatch.setattr(suffix, "_PIECE", 4096)
    assert by_start() == want


def test_long_text_language():
    text = ("the quick brown fox and ñandú " * 120_000).encode()
    assert len(text) > 3 << 20
    short = langid.features(text[: 1 << 20])
    assert float(langid.features(text) @ short) > 0.999


def test_long_texts_and_repeats_decontaminate(spark):
    item = " ".join(f"w{i}" for i in range(40))
    filler = " ".join(f"x{i % 977}" for i in range(200_000))
    rows = [(1, filler + " " + item), (2, filler), (3, item), (3, item), (None, item), (4, None), (5, " ".join(item.split()[:30])), (6, " ".join(item.split()[:33]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(9, item, "w3 w4"), (9, item, "w3 w4"), (10, item, "nowhere"), (11, item, ""), (None, "other words entirely here", None), (12, None, "w1"), (13, "!?", "w1")], "item_id long, text string, answer string")
    got = decontam.contaminated(docs, bench)
    pairs = sorted(((r.doc_id, r.item_id) for r in got.collect()), key=str)
    hit = [1, 3, 3, 6, None]
    assert pairs == sorted([(d, i) for d in hit for i in (9, 10, 11)], key=str)
    answered = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench, answer_col="answer").collect()}
    assert answered == {(d, i) for d in hit for i in (9, 11)}
    in_parts = sorted(((r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench, part_bytes=64).collect()), key=str)
    assert in_parts == pairs  # a benchmark beyond the bound is searched in parts


def test_products_in_tiles():
    rng = np.random.default_rng(5)
    unit = lambda n: decontam._unit(rng.standard_normal((n, 6)))
    rows, q = unit(500), unit(9000)
    want = {(int(a), int(b)) for a, b in zip(*np.nonzero(q @ rows.T >= 0.9))}
    got = {(int(a), int(b)) for c, r in decontam._close(rows, q, 0.9, 10_000) for a, b in zip(c, r)}
    assert got == want


def test_odd_rows_of_passages(spark):
    rng = np.random.default_rng(6)
    text = lambda n: " ".join(f"v{i}" for i in rng.integers(0, 10**6, n))
    shared, long_text = text(60), text(70_000)
    rows = [(1, shared), (2, text(20) + " " + shared), (2, text(20) + " " + shared), (3, long_text + " " + shared), (4, long_text), (5, None), (6, "")]
    frame = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, doc int")
    passages = substring.repeated_passages(frame)
    got = {(r.doc_id, r.source_id) for r in passages.collect()}
    assert {(2, 1), (3, 1), (4, 3)} <= got
    cut = substring.remove_passages(frame, passages)
    assert cut.columns == frame.columns and cut.count() == len(rows) and cut.where("doc_id = 5 and text is null").count() == 1
    assert all(shared not in (r.text or "") for r in cut.where("doc_id in (2, 3)").collect())


def test_language_ties_and_clashes(spark):
    rows = [("en", f"the cat {i} sat") for i in range(30)] + [("fr", f"le chat {i} assis") for i in range(30)]
    frame = spark.createDataFrame([(i, *r, "mine", "yours", 1.0) for i, r in enumerate(rows)], "doc_id long, lang string, text string, _text string, lang_pred string, score double")
    model = langid.train(frame)
    out = langid.predict(frame, model, out=(free_name(frame, "lang_pred"), free_name(frame, "score")))
    assert set(frame.columns) < set(out.columns) and out.where("_text = 'mine' and lang_pred = 'yours' and score = 1").count() == 60
    assert out.where(F.col("_lang_pred") == F.col("lang")).count() > 55
    same = langid.LanguageModel(langid.train_machines(np.zeros((4, langid.BINS), np.float32), ["a", "b", "a", "b"]), {k: langid.train_pairs(np.zeros((1, langid.BINS), np.float32), [k]) for k in "ab"})
    assert same.predict([b"xyz"])[0][0] == "a"  # equal margins: the first by name


def test_archive_records_need_the_dictionary(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"<html><body class='main'>{i} {'navigation item ' * 60}</body></html>") for i in range(400)], "page_id long, html string")
    assert warc.archive(pages, f"file://{tmp_path}/w").count() == 400
    data = sorted(p for p in (tmp_path / "w").iterdir() if not p.name.startswith((".", "_")))[0].read_bytes()
    size = int.from_bytes(data[4:8], "little")
    body, rest = data[8 : 8 + size], data[8 + size :]
    if body[:4] == (0xFD2FB528).to_bytes(4, "little"):
        body = zstandard.decompress(body)
    with pytest.raises(zstandard.ZstdError):
        zstandard.ZstdDecompressor().decompressobj().decompress(rest)
    record = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(body)).decompressobj().decompress(rest)
    assert record.startswith(b"WARC/1.")


def test_results_outlive_a_pipeline(spark):
    """A result that somebody holds is still there after a pipeline has run in the session; what the pipeline wrote on the way is gone."""
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    held = simhash.fingerprint_components(docs)
    before = sorted(tuple(r) for r in held.collect())
    kept = set(common._written[spark.sparkContext.applicationId])
    assert corpus_pipeline.run(spark, folder).count() > 0
    assert sorted(tuple(r) for r in held.collect()) == before
    assert set(common._written[spark.sparkContext.applicationId]) <= kept  # a stage that was called before may have left tables, which go too
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("chunks_")]
