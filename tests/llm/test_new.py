"""Alignment, compression quality, conversation repair and repeated passages against brute force, with nulls, empties, ties, repeats and clashing columns."""

import hashlib
import heapq
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tidemark.llm import align, compress, queries, repair, substring

SF = "/root/testdata/sf0.001"
A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
ODD = [None, "", " ", "  a  b ", "a", " leading", "two\n\nlines \n x\t\ty ", "é日本 ½ don't 12  34 x<|endoftext|>y </s><unk><0x41>", "has ▁ itself", "nul\0 char", "end  ", "'s at first", "🙂🙂 ok", "　wide\xa0space\x85", "word " * 700]


def brute_alignment(rows):
    """(per row figures, Counter of links) straight from the contract, a token at a time."""
    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=B)
    letters = {c: b for b, c in align._byte_letters().items()}
    out, total = [], Counter()
    for row, text in rows:
        a, b, ends_a, ends_b = [], [], [], []
        if text:
            got_a, got_b = t.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
            bytes_a = [bytes(letters[c] for c in t.id_to_token(i)) for i in got_a]
            bytes_b = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in got_b]
            if b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
                a, b = got_a, got_b
                ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
        cuts = sorted(set(ends_a) & set(ends_b))
        groups, before = [], 0
        for cut in cuts:
            groups.append(",".join(str(i) for i, e in zip(a, ends_a) if before < e <= cut) + "|" + ",".join(str(i) for i, e in zip(b, ends_b) if before < e <= cut))
            before = cut
        at_b = dict(zip(ends_b, b))
        links = [(i, at_b[e]) for i, e in zip(a, ends_a) if e in at_b]
        total.update(links)
        out.append((row, len(a), len(b), len(cuts), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    best = {}
    for (_, b), n in total.items():
        best[b] = max(best.get(b, 0), n)
    return [(r, x, y, g, len(ls), sum(total[k] == best[k[1]] for k in ls), sum(total[k] for k in ls), sha) for r, x, y, g, ls, sha in out], total


@pytest.fixture(scope="module")
def texts(spark):
    plain = [(r["doc_id"], r["text"][:3000] if r["text"] else r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(120).collect()]
    return plain + [(10_000 + i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (None, "no id"), (10_001, "")]


@pytest.mark.parametrize("small", [False, True])
def test_alignment(spark, texts, monkeypatch, small):
    if small:  # many inversions of a block, bitmaps instead of lists
        monkeypatch.setattr(align, "HELD_LINKS", 500)
        monkeypatch.setattr(align, "MEMO_UNITS", 300)
    frame = spark.createDataFrame([(i, t, 1, 2, "x", 3, 4) for i, t in texts], "doc_id long, text string, id int, row int, pair string, block int, n_a int")
    aligned = align.Alignment(frame, A, B)
    got = [tuple(r) for r in aligned.documents().collect()]
    want, total = brute_alignment(texts)
    assert sorted(got, key=str) == sorted(want, key=str)
    counts = {(r["a"], r["b"]): r["n_links"] for r in aligned.pair_counts().collect()}
    assert counts == dict(total)
    docs = Counter()
    sp_docs = [brute_alignment([r])[1] for r in texts]
    for links in sp_docs:
        docs.update(set(links))
    assert {(r["a"], r["b"]): r["n_docs"] for r in aligned.pair_counts().collect()} == dict(docs)


def test_alignment_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    aligned = align.Alignment(empty, A, B)
    assert aligned.documents().count() == 0 and aligned.pair_counts().count() == 0


def test_containers_round_trip():
    rng = np.random.default_rng(1)
    keys = np.sort(np.concatenate([v << 16 | rng.choice(65536, n, replace=False) for v, n in ((3, 1), (9, 4095), (70_000, 4096), (70_001, 65536), (1 << 40, 17))])).astype(np.int64)
    values, bits = align.containers(keys)
    for cut in (bits, bits.slice(1, 3), pa.concat_arrays([bits.slice(4), bits.slice(0, 2)])):
        index, place = align.places(cut)
        assert len(index) == sum(len(x) // 2 if len(x) != 8192 else int(np.unpackbits(np.frombuffer(x, np.uint8)).sum()) for x in cut.to_pylist())
    index, place = align.places(bits)
    assert sorted((values[index] << 16 | place).tolist()) == keys.tolist()


def test_long_text_alignment(spark):
    rng = np.random.default_rng(2)
    long_text = " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, n)) for n in rng.integers(1, 9, 60_000)) + " " + "x" * 20_000
    rows = [(1, long_text), (2, long_text), (3, "x y z")]
    got = sorted(tuple(r) for r in align.align_documents(spark.createDataFrame(rows, "doc_id long, text string"), A, B).collect())
    assert got[0][1:6] == got[1][1:6] and got[0][7] == got[1][7]
    t = Tokenizer.from_file(A)
    sp = sentencepiece.SentencePieceProcessor(model_file=B)
    assert got[0][1:3] == (len(t.encode(" " + long_text, add_special_tokens=False).ids), len(sp.encode(long_text)))


def test_quality_accuracy(spark):
    """Held-out labels: at least 0.98 right, and clean documents stay."""
    folder = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r for r in queries.op12_quality(spark, folder).collect()}
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    assert len(got) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for i, r in got.items())
    truth = [(got[r["doc_id"]], r["quality"]) for r in labels.collect() if got[r["doc_id"]]["held_out"]]
    assert len(truth) > 900
    assert np.mean([r["predicted"] == q for r, q in truth]) > 0.98
    assert np.mean([r["predicted"] for r, q in truth if q == 1]) > 0.985
    assert abs(np.mean([r["score"] for r, _ in truth]) - np.mean([q for _, q in truth])) < 0.02  # calibrated as a whole


def test_quality_ignores_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    want = sorted(tuple(r) for r in compress.score_quality(docs, labels).collect())
    flipped = labels.withColumn("quality", compress.F.when(compress.held_out(), 1 - compress.F.col("quality")).otherwise(compress.F.col("quality")))
    assert sorted(tuple(r) for r in compress.score_quality(docs, flipped).collect()) == want


def test_quality_odd_rows(spark):
    rows = [(i, f"a calm line of words number {i} about rivers and hills", 1) for i in range(60)] + [(100 + i, f"BUY!!! NOW!!! {i} $$$ CHEAP!!!", 0) for i in range(60)]
    odd = [(500, None, None), (501, "", None), (None, "a calm line", None), (3, rows[3][1], None), (502, "x" * 3_000_000, None)]
    docs = spark.createDataFrame([(i, t, "l", "s", 9) for i, t, _ in rows + odd], "doc_id long, text string, label string, h string, quality int")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(None, 1), (7, None), (8, 5), (9, 0)], "doc_id long, quality int")
    got = compress.score_quality(docs, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == len(rows) + len(odd)
    by = {r["doc_id"]: r["score"] for r in got.collect()}
    assert by[500] == by[501] and all(0 <= s <= 1 for s in by.values())
    assert np.mean([by[i] for i in range(60)]) > np.mean([by[100 + i] for i in range(60)])
    assert compress.score_quality(docs, labels.where("quality = 1")).count() == docs.count()  # one class: a flat curve
    assert compress.score_quality(docs, labels.where("false")).select("score").distinct().count() == 1
    assert compress.score_quality(docs.where("false"), labels).count() == 0


def test_curve_parts_classes():
    x = np.array([-0.2, -0.1, 0.1, 0.2])
    slope, offset = compress.fit_curve(x, np.array([0, 0, 50, 50.0]), np.array([50, 50, 0, 0.0]))
    p = 1 / (1 + np.exp(-(slope * x + offset)))
    assert p[0] < p[1] < 0.1 and p[3] > p[2] > 0.9


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k == 0:
            continue
        row = (conv, turn, "user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text)
        out += [row] * (2 if k == 3 else 1)
    return out


def cheapest(rows):
    """(cost, audit, lines) over all edit sequences, least cost and then least audit first; the pattern is only checked at the end."""
    judged, seen = [], set()
    for role, text in rows:
        last = [c for c in text if c not in " \t\n\v\f\r"]
        fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[-1] not in ".!?" else ""
        seen.add((role, text))
        judged.append((role, text, fault))
    heap, done = [(0, "", 0, ())], set()
    while heap:
        cost, audit, i, lines = heapq.heappop(heap)
        shape = "".join(r[:1] or "?" for r, _ in lines)  # a role without an initial can't be kept
        if i == len(judged) and re.fullmatch("(s?(ua)+)?", shape):
            return cost, audit, lines, [f for _, _, f in judged]
        if (i, shape) in done or not re.match(r"^(s?(ua)*u?)$", shape):
            continue
        done.add((i, shape))
        for who in ("user", "assistant"):
            if len(lines) < 2 * len(judged) + 2:
                heapq.heappush(heap, (cost + 2, audit + "I", i, (*lines, (who, ""))))
        if i < len(judged):
            role, text, fault = judged[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, lines))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                heapq.heappush(heap, (cost + more, audit + "K", i + 1, (*lines, (role, text))))
                for who in ("user", "assistant"):
                    heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, (*lines, (who, text))))
    raise AssertionError


def brute_repair(rows, changed):
    out = []
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in changed if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        turns = [r[1] for r in mine if r[1] is not None]
        cost, audit, lines, found = cheapest([r[2:] for r in mine])
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, found.count("blank"), found.count("duplicate"), found.count("truncated"), illegal, cost, audit, digest))
    return sorted(out, key=str)


CONV = "conv_id long, turn long, role string, text string, key string, known int, fault int, gone int"


@pytest.mark.parametrize("held", [repair.HELD, 100])
def test_repair(spark, held):
    rng = np.random.default_rng(4)
    roles, lines = ["user", "assistant", "system", "user", "assistant", "tool", None, "unit", ""], ["One.", "Two", "Three!", "", " \t", None, "Four?\n", "One."]
    rows = [(c, int(t), str(roles[rng.integers(9)]) if rng.random() < 0.95 else None, lines[rng.integers(8)]) for c in range(150) for t in sorted(rng.integers(0, 9, rng.integers(1, 7)).tolist())]
    rows = [(c, t, None if r == "None" else r, x) for c, t, r, x in rows]
    rows += [(None, 1, "user", "Hi."), (None, None, "assistant", "Ho."), (900, None, "user", "a."), (900, None, "user", "a."), (901, None, None, None)]
    frame = spark.createDataFrame([(*r, "k", 1, 2, 3) for r in rows], CONV)
    got = sorted((tuple(r) for r in repair.repair(repair.damage(frame), gone="_gone", held=held).collect()), key=str)
    assert got == brute_repair(rows, damaged(rows))
    plain = sorted((tuple(r) for r in repair.repair(frame, held=held).collect()), key=str)
    same = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    assert plain == brute_repair(rows, same)


def test_repair_of_a_long_conversation(spark):
    """One conversation over many Arrow batches and spilled chunks: sound pairs with a blank row here and there."""
    n = 60_000
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"Line {i}.") for i in range(n)]
    rows[777], rows[-1] = (1, 777, "assistant", "  "), (1, n - 1, "assistant", "no end")
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    (got,) = repair.repair(frame, held=50_000).collect()
    assert (got["gaps"], got["blank"], got["duplicate"], got["truncated"], got["illegal"], got["cost"]) == (0, 1, 0, 1, 0, 6)
    assert len(got["audit"]) == n + 1 and got["audit"].count("D") == 1 and got["audit"].count("I") == 1
    lines = [f"{r}:{'' if i == 777 else t}" for i, (_, _, r, t) in enumerate(rows)]
    assert got["repaired_sha256"] == hashlib.sha256("\n".join(lines).encode()).hexdigest()
    assert repair.repair(frame.where("false")).count() == 0


@pytest.mark.parametrize("name", ["op13_repair"])
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("conversations",):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.01/{t}.parquet'")
    cursor = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in cursor.description]
    want = sorted(cursor.fetchall())
    got = sorted(tuple(r) for r in queries.QUERIES[name](spark, "/root/testdata/sf0.01").select(*columns).collect())
    assert got == want and len(got) > 50


@pytest.mark.parametrize(("holders", "changed"), [(0, 10), (6, 6), (6, 10), (20, 6), (20, 10)])
def test_changed_passages_of_frequent_lines(spark, holders, changed):
    """Pairs share 60 words of which some are replaced; each of their three lines is in other documents as well."""
    rng = np.random.default_rng(100 * holders + changed)
    text = lambda n: [f"w{i}" for i in rng.integers(0, 10**6, n)]
    rows, pairs, aligned = [], set(), set()
    for g in range(0, 100_000, 1000):
        lines = [text(20) for _ in range(3)]
        a = [w for line in lines for w in line]
        b = list(a)
        for k in rng.choice(60, changed, replace=False):
            b[k] = f"x{rng.integers(10**6)}"
        rows += [(g + 1 + 3 * h + i, " ".join(text(40) + line + text(40))) for h in range(holders) for i, line in enumerate(lines)]
        own, other = text(40) + a + text(40), text(40) + b + text(40)
        rows += [(g + 500, " ".join(own)), (g + 501, " ".join(other))]
        pairs.add((g + 501, g + 500))
        # what an aligner finds that sees every shared k-mer of this pair
        kmers = {tuple(own[i : i + substring.K]): i for i in range(len(own) - substring.K + 1)}
        at = [(j, kmers[k]) for j in range(len(other) - substring.K + 1) if (k := tuple(other[j : j + substring.K])) in kmers]
        if at and substring.align(dict(enumerate(other)), dict(enumerate(own)), *map(list, zip(*at))):
            aligned.add((g + 501, g + 500))
    got = {(r.doc_id, r.source_id) for r in substring.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got <= pairs and len(got & aligned) >= 0.9 * len(aligned) >= 81


def test_passages_of_copies(spark):
    """Copies get the passages of the first of them, and the whole text as a passage of it."""
    rng = np.random.default_rng(8)
    text = lambda n: " ".join(f"w{i}" for i in rng.integers(0, 10**6, n))
    shared, short = text(60), text(20)
    long = text(30) + " " + shared + " " + text(30)
    rows = [(1, shared), *((i, long) for i in (5, 6, 7, 7)), *((i, short) for i in (8, 9)), *((i, shared) for i in (10, 11)), (None, long)]
    got = sorted(tuple(r) for r in substring.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    part = lambda d: (d, 30, 90, 1, 0, 60, 60)
    assert got == sorted([*map(part, (5, 6, 7)), *((d, 0, 120, 5, 0, 120, 120) for d in (6, 7)), *((d, 0, 60, 1, 0, 60, 60) for d in (10, 11))])


def test_passages_against_all_pairs(spark):
    """Which texts of up to 300 words hold an earlier passage, against alignment from every shared k-mer of every pair."""
    pdf = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").where("size(split(text, ' ')) <= 300").toPandas()
    words = {d: t.lower().split() for d, t in zip(pdf["doc_id"], pdf["text"])}
    places, want = {}, set()
    for d in sorted(words):
        w = words[d]
        meets = {}
        for j in range(len(w) - substring.K + 1):
            for source, i in places.get(tuple(w[j : j + substring.K]), ()):
                meets.setdefault(source, []).append((j, i))
        for source, at in meets.items():
            own = dict(enumerate(w)), dict(enumerate(words[source]))
            if any(substring.align(*own, [at[k][0] for k in c], [at[k][1] for k in c]) for c in substring.chain(*map(list, zip(*at)))):
                want.add(d)
                break
        for j in range(len(w) - substring.K + 1):
            places.setdefault(tuple(w[j : j + substring.K]), []).append((d, j))
    got = {r.doc_id for r in substring.repeated_passages(spark.createDataFrame(pdf)).collect()}
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want) + 1


def test_hashes_of_words():
    """Equal words in any case have equal hashes, others have others, over the blocks of a long text too."""
    text = ("Alpha beta\tALPHA\x0b \xe9t\xe9 " * 30 + "x" * (substring.BLOCK + 9) + " beta " + "beta alpha " * 40_000).encode()
    words, seen = text.lower().split(), {}
    hashes = substring.word_hashes(text).tolist()
    assert len(hashes) == len(words) and all(seen.setdefault(w, h) == h for w, h in zip(words, hashes)) and len(set(seen.values())) == len(seen)
    assert not len(substring.word_hashes(None)) and not len(substring.word_hashes(b" \n"))


def test_passages_within_earlier_sources():
    """Sorted passages in batches of any size, against a comparison of each with all others of its document."""
    rng = np.random.default_rng(12)
    rows = sorted({(int(d), int(s), int(a), int(a + n)) for d, s, a, n in rng.integers(0, [12, 5, 30, 20], (300, 4))})
    want = [r for r in rows if not any(o[0] == r[0] and o[1] < r[1] and o[2] <= r[2] and o[3] >= r[3] for o in rows)]
    whole = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["doc_id", "source_id", "start", "end"])
    for size in (1, 7, 64, 1000):
        parts = [whole.slice(at, size) for at in range(0, len(rows), size)]
        got = [tuple(r.values()) for b in substring._first_batches(iter([whole.slice(0, 0), *parts])) for r in b.to_pylist()]
        assert got == want, size
