"""Shingles and seeds that many texts share: no bucket makes all its pairs, none is lost."""

from collections import Counter

import numpy as np
import pyarrow as pa

from tidemark.llm import simhash, substring


def _made(n, words, lines):
    """Texts of words of their own; every one holds one of a few lines."""
    own = [[f"w{k}x{j}" for j in range(words)] for k in range(n)]
    return [" ".join([*own[k], *(f"l{k % lines}w{j}" for j in range(12))]) for k in range(n)]


def test_spread_shingles_are_known_as_frequent(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TEXTS", 1)  # no two texts of a line are counted in one step
    texts = _made(120, 60, 5)
    table = simhash._frequent(spark.createDataFrame([(t,) for t in texts], "text string").repartition(40), 5, 0.8)
    got = dict(zip(table.column("shingle").to_pylist(), table.column("n").to_pylist()))
    lines = {h for k in range(5) for h in simhash.text_shingles(" ".join(f"l{k}w{j}" for j in range(12)).encode(), 5).tolist()}
    low = {h for h in lines if h < 0.25 * 2**64}
    assert low and {h & (1 << 64) - 1 for h in got} == low and set(got.values()) == {24}


def test_crowded_shingles_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CROWDED", 3)
    monkeypatch.setattr(simhash, "FREQUENT", 0)
    rng = np.random.default_rng(3)
    base = [f"b{j}" for j in range(150)]
    texts = []
    for k in range(60):  # near copies of one text, many of them just at the border
        ws = list(base)
        for j in rng.choice(150, rng.integers(0, 5), replace=False):
            ws[j] = f"c{k}x{j}"
        texts.append(" ".join(ws))
    rows = list(enumerate(dict.fromkeys(texts)))
    sets = {k: {tuple(t.split()[i : i + 5]) for i in range(146)} for k, t in rows}
    links = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    some = spark.createDataFrame(rows, "id long, text string")
    own = spark.createDataFrame([], "node long, component long")
    sizes = some.selectExpr("id", "text")
    found = {tuple(r) for r in simhash._across(sizes, sizes, own, 5, 0.8).collect()}
    assert links and links <= found and len(found) <= len(rows) * (len(rows) - 1) // 2


def test_packed_occurrences_meet_as_all_pairs(monkeypatch):
    """Packs of a few occurrences, ranges that overflow, seeds of up to hundreds of occurrences, repeats within a text: nothing is lost or made twice."""
    monkeypatch.setattr(substring, "PACK", 50)
    rng = np.random.default_rng(5)
    n = 3000
    seed = np.where(rng.random(n) < 0.3, rng.integers(0, 4, n), rng.integers(4, 900, n)) * 7919 - 2**62
    doc, pos = rng.integers(-20, 200, n), rng.integers(0, 1000, n).astype(np.int32)
    batches = [pa.RecordBatch.from_arrays([pa.array(x[at : at + 64]) for x in (seed, doc, pos, pos + 9)], ["seed", "doc", "pos", "end"]) for at in range(0, n, 64)]
    packs = [r for b in substring._packed(iter, 3)(batches) for r in b.to_pylist()]
    packs.sort(key=lambda r: r["part"])
    sent = pa.RecordBatch.from_pylist(packs, pa.schema([("part", pa.int64()), ("data", pa.binary())]))
    out = [r for b in substring._met_batches(iter([sent.slice(0, 7), sent.slice(7)])) for r in b.to_pylist()]
    by = {}
    for s, d, p in zip(seed.tolist(), doc.tolist(), pos.tolist()):
        by.setdefault(s, []).append((d, p))
    want = Counter((a, b) for held in by.values() if len(held) <= substring.HOLDERS for a in held for b in held if b[0] < a[0])
    often = Counter((s, *o) for s, held in by.items() if len(held) > substring.HOLDERS for o in held)
    assert want and often
    assert Counter(((r["doc"], r["pos"]), (r["source"], r["src_pos"])) for r in out if r["source"] is not None) == want
    assert Counter((r["seed"], r["doc"], r["pos"]) for r in out if r["source"] is None) == often
    assert all(r["end"] == r["pos"] + 9 for r in out)
