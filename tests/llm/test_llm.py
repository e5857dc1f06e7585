"""Each operator against brute force on small data, with nulls, empties, ties, repeats and clashing columns."""

import base64
import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import bpe, decontam, ego, eliasfano, induced, langid, simhash, substring, suffix, token_cache, warc
from tidemark.llm.common import components

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, key int, bits int, row int, doc string, label int, start int"


@pytest.fixture(scope="module")
def docs(spark):
    """The small table plus odd rows, with extra columns whose names clash with inner ones."""
    plain = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    odd = [
        (9001, None, "en", "x", 0), (9002, "", "en", "x", 0), (9003, " \n\t ", None, "x", 3), (None, "no id here", "en", "x", 10), (9004, "!!! ###", "de", None, 7),
        (9005, "a", "en", "x", 1), (9005, "a", "en", "x", 1), (9006, "é日本 don't 12  34\n\nx<|endoftext|>y", None, "x", 5),
        (9007, "word " * 3000, "en", "x", 15000), (9008, plain[0][1], "fr", "x", 1), (9009, "x" * 900, "en", "x", 1),
    ]
    rows = [r + ("i", 1, 2, 3, "d", 4, 5) for r in plain + odd]
    return spark.createDataFrame(rows, DOCS).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def rows_of(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def labels(edges, nodes):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(30)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    want = labels(edges, {x for e in edges for x in e})
    assert got == {k: v for k, v in want.items() if k in got} and {x for a, b in edges if a != b for x in (a, b)} == set(got)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_warc(spark, tmp_path):
    big, small = "<p>" + "q" * 1500 + "</p>", "s" * 999
    rows = [(1, big), (2, big), (3, small), (4, small), (5, None), (6, ""), (7, "é" * 500), (7, "é" * 500), (None, big), (8, big)]
    rows += [(100 + i, f"<html>{i} {'body ' * (50 + i)}</html>") for i in range(60)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, html string, payload string")
    got = sorted((tuple(r) for r in warc.archive(pages, f"file://{tmp_path}/w").collect()), key=str)
    top = {}
    for k, h in rows:
        top[h] = max(top.get(h, -1), -1 if k is None else k)
    want = []
    for k, h in rows:
        b = (h or "").encode()
        revisit = len(b) >= 1000 and top[h] != k
        want.append((k, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", top[h] if revisit else None))
    assert got == sorted(want, key=str)
    first = next((tmp_path / "w").iterdir()).read_bytes()
    assert first[:4] == (0x184D2A5D).to_bytes(4, "little")
    assert warc.archive(pages.where("false")).count() == 0


def test_token_counts(spark, docs, empty):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    want = Counter((k, len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False).ids), n > 512) for k, x in rows_of(docs))
    folder = token_cache.scratch(spark, "cache")
    assert Counter(map(tuple, token_cache.token_counts(docs, path, folder).collect())) == want
    stored = token_cache.read_cache(spark, folder).count()
    assert stored == len({x or "" for _, x in rows_of(docs)})
    assert Counter(map(tuple, token_cache.token_counts(docs, path, folder).collect())) == want
    assert token_cache.read_cache(spark, folder).count() == stored  # all were hits
    assert token_cache.token_counts(empty, path).count() == 0


def brute_print(text):
    ws = (text or "").encode().lower().split()
    sh = [b" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] or ([b" ".join(ws)] if ws else [])
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash(spark, docs, empty):
    rows = rows_of(docs)
    prints = {t: brute_print(t) for _, t in rows}
    values = sorted(set(prints.values()))
    comp = labels([(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if (a ^ b).bit_count() <= 2], values)
    low = defaultdict(lambda: 1 << 60)
    for k, t in rows:
        low[comp[prints[t]]] = min(low[comp[prints[t]]], 1 << 60 if k is None else k)
    want = Counter((k, f"{prints[t]:016x}", None if low[comp[prints[t]]] == 1 << 60 else low[comp[prints[t]]]) for k, t in rows)
    assert Counter(map(tuple, simhash.fingerprint_components(docs).collect())) == want
    assert simhash.fingerprint_components(empty).count() == 0


def test_simhash_crowded_bucket(spark, monkeypatch):
    rng = np.random.default_rng(1)
    base = 0x0123456789ABCDEF
    values = {base}
    while len(values) < 400:
        x = base
        for b in rng.integers(0, 64, rng.integers(1, 7)):
            x ^= 1 << int(b)
        values.add(x)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = simhash.near_fingerprints(spark.createDataFrame([(v,) for v in signed], "bits long")).collect()
    near = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 2
    assert all(near(a, b) for a, b in links)
    brute = [(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if near(a, b)]
    assert labels(links, signed) == labels(brute, signed) and len(links) < len(brute) + 400


def test_near_duplicates(spark, docs, monkeypatch):
    def sets(t):
        ws = (t or "").encode().lower().split()
        return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} or ({tuple(ws)} if ws else set())

    some = [(k, t) for k, t in rows_of(docs) if k is not None]
    base = some[3][1].split(" ")
    some += [(5000 + i, " ".join([*base[:i], "zzq", *base[i + 1 :]])) for i in range(60)]  # a tight group of near copies
    monkeypatch.setattr(simhash, "PIVOT", 5)
    got = dict(simhash.near_duplicates(spark.createDataFrame(some, "doc_id long, text string")).distinct().collect())
    s = {k: sets(t) for k, t in some}
    texts = dict(some)
    ids = sorted(s)
    edges = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if s[a] and s[b] and (texts[a] == texts[b] or len(s[a] & s[b]) >= 0.8 * len(s[a] | s[b]))]
    want = labels(edges, ids)
    missed = sum(got[a] != got[b] for a, b in edges)
    assert missed <= 0.02 * len(edges), (missed, len(edges))
    assert all(want[k] == want[c] for k, c in got.items())  # nothing is joined that brute force keeps apart
    kept = simhash.drop_near_duplicates(spark.createDataFrame(some, "doc_id long, text string"))
    assert kept.count() == len(set(got.values()))


def test_near_duplicates_by_band(spark):
    """Every pair of distinct texts at a similarity of 0.8 or more, in each band, on the real table and on texts with replaced words."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    rng = np.random.default_rng(8)
    for i in range(0, 400):
        ws = rows[i][1].split()
        for j in rng.integers(0, len(ws), max(1, round(len(ws) * rng.uniform(0.005, 0.025)))):
            ws[j] = f"zq{i}x{j}"
        rows.append((10**6 + i, " ".join(ws)))
    got = dict(simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    sets, where = {}, defaultdict(list)
    for k, t in rows:
        ws = t.lower().split()
        sets[k] = {" ".join(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))}
        for s in sets[k]:
            where[s].append(k)
    common = Counter((a, b) for ids in where.values() for i, a in enumerate(ids) for b in ids[i + 1 :])
    bands, edges = defaultdict(list), []
    for (a, b), c in common.items():
        s = c / (len(sets[a]) + len(sets[b]) - c)
        if s >= 0.8:
            bands[int(s * 20)].append(got[a] == got[b])
            edges.append((a, b))
    assert set(bands) >= {16, 17, 18, 19} and all(all(v) for v in bands.values()), {k: np.mean(v) for k, v in bands.items()}
    assert got == labels(edges, sorted(sets))


def test_language(spark, docs, empty):
    got = langid.identify(docs).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert all(by[k].lang_pred == "und" for k in (9001, 9002, 9003, 9004))
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.95
    assert langid.identify(empty).count() == 0
    assert {r.lang_pred for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_of_long_and_rare_rows(spark):
    """Heads in another language, nearly 200 languages, and one machine for each pair of a family."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(f"{a}{b}", f"{a}{b}{a} {b}{a}{a} " * 40) for a in letters[:15] for b in letters[:14] if a != b]
    rows += [(lang, "zz zz zz " * 460 + f"{word} {i} " * 2000) for lang, word in (("en", "the"), ("de", "der"), ("nl", "het")) for i in range(25)]
    model = langid.train(spark.createDataFrame(rows, "lang string, text string"))
    assert len(model.within["germanic"].pairs) >= 3 and sum(len(m.names) for m in model.within.values()) == len({r[0] for r in rows}) > 195
    texts = [b"the " * 50, b"der " * 50, b"het " * 50]
    assert [lang for lang, _ in model.predict(texts)] == ["en", "de", "nl"]


def test_elias_fano():
    rng = np.random.default_rng(2)
    for n, top in ((1, 0), (1, 5), (3, 0), (1000, 3), (5000, 10**9), (700, 511)):
        v = np.sort(rng.integers(0, top + 1, n))
        ef = eliasfano.EliasFano.of(v)
        assert (ef.select(np.arange(n)) == v).all()
        assert ef.bits <= n * (2 + max(0, np.log2((v[-1] + 1) / n))) * 1.2 + 2048


def test_token_files(spark, docs, empty):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    rows = sorted(rows_of(docs), key=lambda r: (r[0] is not None, r[0] or 0))
    want, at = [], 0
    for k, x in rows:
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((k, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    got = eliasfano.token_files(docs, path, file_bytes=100_000).collect()
    assert Counter(map(tuple, got)) == Counter(want)
    assert eliasfano.token_files(empty, path).count() == 0


def test_bpe(spark, docs, empty):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for k, x in rows_of(docs):
        ids = enc.encode_ordinary(x or "")
        want[k, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((x or "").encode()).hexdigest()] += 1
    assert Counter(map(tuple, bpe.encode_documents(docs, path).collect())) == want
    assert Counter(map(tuple, bpe.encode_documents(docs, path, chunk_bytes=5000).collect())) == want  # many chunks
    some = ["", "naïve", "aaaaaaaaaaaaaaaa", " Vertrauen", "日本語のテスト", "x" * 48, None]
    for r in bpe.encode_words(spark.createDataFrame([(w,) for w in some], "word string"), path).collect():
        assert r.word is None and r.ids is None or (r.ids == enc._encode_single_piece(r.word.encode()) if r.word else r.ids == []) and bytes(r.decoded).decode() == r.word
    assert bpe.encode_documents(empty, path).count() == 0
    assert bytes(bpe.decode_ids(spark.createDataFrame([(enc.encode_ordinary("naïve text"),)], "ids array<int>"), path).first().decoded).decode() == "naïve text"


def test_suffix(spark, docs, empty):
    def check(frame, **how):
        rows = [(k, (t or "").encode()) for k, t in rows_of(frame)]
        seen = Counter(t[i : i + 200] for _, t in rows for i in range(len(t) - 199))
        want = Counter()
        for k, t in rows:
            hit = np.zeros(len(t), bool)
            for i in range(len(t) - 199):
                if seen[t[i : i + 200]] > 1:
                    hit[i : i + 200] = True
            spans = int(hit[:1].sum() + (hit[1:] & ~hit[:-1]).sum())
            want[k, len(t), int(hit.sum()), spans, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~hit])).hexdigest()] += 1
        assert Counter(map(tuple, suffix.remove_repeats(frame, **how).collect())) == want

    check(docs)
    check(docs, crowd=1)  # everything by dealt windows
    assert suffix.remove_repeats(empty).count() == 0


def test_induced_order():
    """Order and common prefixes of all suffixes against sorting them, with queues in memory and on disk."""
    rng = np.random.default_rng(11)
    for trial in range(400):
        text = rng.integers(0, rng.integers(1, 6), rng.integers(1, 60)).astype(np.uint8)
        text = np.tile(text, 3) if trial % 3 == 0 else text
        text = text + np.uint8(250) if trial % 5 == 0 else text
        cap, raw = int(rng.choice([3, 5, 20, 200])), text.tobytes()
        order, shared = induced.suffix_order(text, cap, memory=int(rng.choice([1, 1000])))
        assert sorted(order.tolist()) == list(range(len(raw)))
        assert [raw[i : i + cap] for i in order] == [raw[i : i + cap] for i in sorted(range(len(raw)), key=lambda i: raw[i:])]
        for k in range(1, len(raw)):
            a, b = raw[order[k - 1] :][:cap], raw[order[k] :][:cap]
            assert shared[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").limit(150).collect()]
    base = rng.standard_normal(64)
    rows += [(5000 + i, (base + 0.15 * rng.standard_normal(64)).tolist(), 1) for i in range(120)]
    rows += [(6000, None, 1), (6001, [0.0] * 64, 1), (6002, [float("nan")] * 64, 1), (6003, [1.0] * 63 + [None], 1), (6004, base.tolist(), None), (6005, base.tolist(), 1), (6006, base.tolist(), 1), (6007, base.tolist(), 2), (6008, [1.0, 2.0], 1), (6009, [2.0, 4.0], 1), (6010, [], 1)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, unit string, node int")
    got = {r.vec_id: tuple(r)[1:] for r in ego.link_vectors(frame, block=16).collect()}
    vec = {}
    for k, v, lab in [tuple(r)[:3] for r in frame.collect()]:
        v = None if v is None or None in v or not len(v) else np.array(v, float)
        vec[k] = (None, lab) if v is None or not np.isfinite(v).all() or not v.any() or lab is None else (v / np.linalg.norm(v), lab)
    ids = sorted(vec)
    edges = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if vec[a][0] is not None and vec[b][0] is not None and vec[a][1] == vec[b][1] and len(vec[a][0]) == len(vec[b][0]) and vec[a][0] @ vec[b][0] >= 0.93]
    degree, comp = Counter(x for e in edges for x in e), labels(edges, ids)
    assert got == {k: (degree[k], comp[k], comp[k] == k) for k in ids}
    assert ego.link_vectors(frame.where("false")).count() == 0


def test_block_pairs(spark):
    """The joins of levels keep the pairs of the recursion in one process, and skip most of the possible ones."""
    import pandas as pd

    rng = np.random.default_rng(15)
    low = np.sort(rng.uniform(0, 40, (120, 2)), axis=0)
    boxes = pd.DataFrame({"label": 1, "block": np.arange(120) + (np.arange(120) // 50 << 20), "low": low.tolist(), "high": (low + rng.uniform(0, 1, (120, 2))).tolist()})
    want = ego.interval_pairs(boxes, 0.5)
    frame = spark.createDataFrame(boxes, "label int, block long, low array<double>, high array<double>")
    got = [(r.i, r.j) for r in ego.block_pairs(frame, 0.5, 2, fan=2, levels=3).collect()]
    assert sorted(got) == sorted(want) and len(want) < 0.2 * 120 * 121 / 2


def test_passages(spark, docs, empty):
    rng = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(3000)]
    text = lambda n: [vocabulary[i] for i in rng.integers(0, 3000, n)]
    shared, rows = text(70), []
    for i in range(40):
        p = list(shared)
        if i % 2:  # a few words changed, dropped or added
            p[20] = "changed"
            del p[45]
            p.insert(60, "added")
        rows.append((i, " ".join(text(100) + p + text(80))))
    rows += [(100 + i, " ".join(text(200))) for i in range(30)] + [(500, None), (501, ""), (None, " ".join(shared)), (502, " ".join(shared[:30]))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = substring.repeated_passages(frame).collect()
    assert {r.doc_id for r in got} == set(range(1, 40)) and {r.source_id for r in got} <= {0, 1}  # doc 1 is the first to have the changed words
    assert all(r.start <= 101 and r.end >= 168 and r.end - r.start < 76 for r in got)
    cut = {r.doc_id: r.text for r in substring.remove_passages(frame, substring.repeated_passages(frame)).collect()}
    assert cut[0] == rows[0][1] and cut[105] == rows[45][1] and cut[500] is None and len(cut[7].split()) <= 184
    assert substring.repeated_passages(empty).count() == 0 and substring.remove_passages(docs, substring.repeated_passages(docs)).columns == docs.columns


def test_passages_of_frequent_lines(spark):
    """Documents share four lines that others, before and between them, hold one at a time."""
    rng = np.random.default_rng(9)
    text = lambda n: [f"w{i}" for i in rng.integers(0, 10**6, n)]
    rows, pairs = [], set()
    for g in range(0, 2400, 100):
        lines = [text(20) for _ in range(3)]
        whole = lambda: " ".join(text(60) + [w for line in lines for w in [*line, *text(2)]] + text(60))  # noqa: E731, B023
        rows += [(g + at + i, " ".join(text(50) + line + text(50))) for at in (1, 20)[: 1 + g // 100 % 2] for i, line in enumerate(lines)] + [(g + 10, whole()), (g + 30, whole())]
        pairs.add((g + 30, g + 10))
    got = {(r.doc_id, r.source_id) for r in substring.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == pairs, pairs - got


def test_single_seeds_are_kept():
    pdf = substring.pd.DataFrame({"doc": [5, 5], "source": [1, 1], "pos": [100, 900], "src_pos": [700, 40]})
    batch = pa.RecordBatch.from_pandas(pdf)
    assert sorted(c for out in substring._chain_batches([batch]) for c in out.column("pos").to_pylist()) == [[100], [900]]


def test_ordered_chains_are_the_same():
    rng = np.random.default_rng(12)
    for _ in range(300):
        n = int(rng.integers(1, 30))
        pos, src = np.cumsum(rng.integers(1, 90, n)), np.cumsum(rng.integers(1, 90, n))
        cut = substring._ordered_chains(np.arange(n) == 0, pos, src).tolist()
        assert sorted(substring.chain(pos.tolist(), src.tolist())) == [list(range(a, b)) for a, b in zip(cut, [*cut[1:], n])]


def test_reach_is_where_alignment_ends():
    rng = np.random.default_rng(13)
    known = 0
    for _ in range(2000):
        a = rng.integers(1, 4 if rng.random() < 0.3 else 200, substring.CONTEXT).astype(np.uint8)
        b = a.copy()
        keep = int(rng.integers(0, 15))
        b[keep:] = rng.integers(1, 200, substring.CONTEXT - keep)
        b[: keep] = a[: keep]
        got = int(substring.reach(a[None], b[None])[0])
        more = lambda x: dict(enumerate([999, *x.tolist(), *rng.integers(1000, 10**6, 40).tolist()]))
        i, _, _ = substring._run(more(a), more(b), 0, 0, 1)
        known += got >= 0
        assert got < 0 or i == got
    assert known > 500


def test_best_run_of_parts():
    a = [f"s{i}" for i in range(55)]
    b = a[:27] + [f"in{i}" for i in range(8)] + a[27:]
    a, b = a + [f"x{i}" for i in range(35)] + a[:5], b + [f"y{i}" for i in range(35)] + a[:5]
    sides = dict(enumerate(a)), dict(enumerate(b))
    assert substring.align(*sides, [10, 40], [10, 48]) == [(0, 55, 0, 63, 55)]
    assert substring.align(*sides, [10, 40, 90], [10, 48, 98]) == [(0, 55, 0, 63, 55)]
    assert substring.align(*sides, [90], [98]) == []


def test_seeds_meet_at_the_least_similarity():
    rng = np.random.default_rng(10)
    words = lambda n: rng.integers(0, 1 << 63, n, dtype=np.uint64)
    for n, changed in ((50, 8), (50, 10), (60, 12)):
        met = 0
        for _ in range(300):
            p = words(n)
            q = p.copy()
            q[rng.choice(n, changed, replace=False)] = words(changed)
            one, two = (substring.seeds(np.concatenate([words(60), x, words(60)]))[0] for x in (p, q))
            met += bool(len(np.intersect1d(one, two)))
        assert met >= 297, (n, changed, met)


def test_chain_is_best():
    rng = np.random.default_rng(5)
    for _ in range(60):
        m = sorted({(int(a), int(b)) for a, b in rng.integers(0, 60, (12, 2))})
        pos, src = [a for a, _ in m], [b for _, b in m]
        best = [0.0] * len(m)
        for i in range(len(m)):
            best[i] = substring.WEIGHT + max([0.0, *(best[j] - substring.GAP * (pos[i] - pos[j] + src[i] - src[j]) for j in range(i) if pos[j] < pos[i] and src[j] < src[i])])
        top = substring.chain(pos, src)[0]
        score = substring.WEIGHT * len(top) - substring.GAP * sum(pos[b] - pos[a] + src[b] - src[a] for a, b in zip(top, top[1:]))
        assert abs(score - max(best)) < 1e-9


def test_decontamination(spark, docs, empty):
    sf = "/root/testdata/sf0.01"
    documents, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    items = {r.item_id: r.text for r in bench.collect()}
    texts = {r.doc_id: r.text for r in documents.collect()}
    ws = items[5].split(" ")
    para = "Completely other words stand here before it. " + " ".join([*ws[:6], "indeed", *ws[7:20], *ws[21:]]) + " and some more words behind it."
    more = spark.createDataFrame([(7001, para), (7002, None), (7003, "")], "doc_id long, text string")
    got = decontam.contaminated(documents.select("doc_id", "text").union(more), bench).collect()
    pairs = {(r.doc_id, r.item_id) for r in got}
    exact = {(d, i) for d, t in texts.items() for i, b in items.items() if b in t}
    assert exact <= pairs and (7001, 5) in pairs, exact - pairs
    clean = {d for d in texts if not any(d == x for x, _ in exact)}
    assert len({d for d, _ in pairs} & clean) <= 2
    assert decontam.contaminated(empty, bench).count() == 0 and decontam.contaminated(documents, bench.where("false")).count() == 0
    assert decontam.drop_contaminated(docs, bench).columns == docs.columns


def test_decontamination_of_every_length(spark):
    """Exact and paraphrased items of each length class, put into documents of the real table."""
    rng = np.random.default_rng(11)
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text.split() for r in documents.collect()}
    hosts = [k for k, ws in texts.items() if len(ws) > 120]
    items, rows, want = [], [], defaultdict(set)
    for i in range(400):
        n, changed = int(rng.integers(8, 90)), (0, 0.15, 0.2)[i % 3]
        ws = texts[hosts[i]][20 : 20 + n]
        items.append((i, " ".join(ws)))
        put = list(ws)
        for j in rng.choice(len(ws), int(changed * len(ws)), replace=False):
            put[j] = f"zq{i}"
        at = int(rng.integers(0, 100))
        host = texts[hosts[-1 - i]]
        rows.append((10**6 + i, " ".join([*host[:at], *put, *host[at:]])))
        want[changed, "short" if n < 21 else "middle" if n < 33 else "long"].add((10**6 + i, i))
    docs = documents.union(spark.createDataFrame(rows, "doc_id long, text string"))
    found = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    recall = {k: round(len(v & found) / len(v), 3) for k, v in want.items()}
    assert len(recall) == 9 and set(recall.values()) == {1.0}, recall


def test_longest_common_subsequence():
    rng = np.random.default_rng(6)
    for _ in range(40):
        a, b = ([bytes([97 + x]) for x in rng.integers(0, 4, rng.integers(0, 30))] for _ in range(2))
        dp = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                dp[i + 1][j + 1] = dp[i][j] + 1 if x == y else max(dp[i][j + 1], dp[i + 1][j])
        assert decontam.common_subsequence(a, b) == dp[-1][-1]


def test_pipeline(spark, docs, tmp_path):
    out = corpus_pipeline.run(spark, SF)
    ids = [r.doc_id for r in out.collect()]
    assert len(ids) == len(set(ids)) > 100 and "ids_sha256" in out.columns
    frame = docs
    for name, stage in corpus_pipeline.STAGES:  # odd rows and clashing columns; each stage is written before the next
        stage(spark, frame, SF).write.parquet(f"file://{tmp_path}/{name}")
        frame = spark.read.parquet(f"file://{tmp_path}/{name}")
        assert frame.columns == docs.columns or name == "encode"
        assert frame.where("doc_id = 0").count() == 1
    assert frame.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
