"""Packing, the source divergence audit and hard-negative mining against brute force and odd inputs."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vellumine.llm import divergence, hard_negatives, packing, registry
from vellumine.llm.token_counts import TOKENIZERS

MODEL = f"{TOKENIZERS}/word_bpe_49k.json"
SCHEMA = "doc_id long, text string, lang string, source string, h string, row string, k0 string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows and ids, clashing columns."""
    long = " ".join(f"word{i % 997}" for i in range(60_000))
    data = [(1, None, None, None, "x", "y", "z"), (2, "", "en", "s", "x", "y", "z"), (2, "", "en", "s", "x", "y", "z"), (3, "One line. Another!\n" * 3, "en", None, None, None, None)]
    data += [(3, "another text", None, "s", "x", "y", "z"), (None, "One <|endoftext|> line", "en", "s", "x", "y", "z"), (4, long, "en", "t", "x", "y", "z"), (5, " \n\t ", "en", "s", "x", "y", "z"), (6, "é日本。語 😀 ok é it's 3.14", "en", "s", "", "", ""), (7, "q" * 50_000, "xx", "s", "", "", "")]
    return spark.createDataFrame(data, SCHEMA)


def packed_well(pieces, texts, size=4096):
    """Each id of each document in one piece, sequences without gaps; padding and cuts."""
    model = Tokenizer.from_file(MODEL)
    want, got, sequences = Counter(), defaultdict(list), defaultdict(list)
    for doc_id, text in texts:
        want[doc_id, tuple(model.encode(text or "", add_special_tokens=False).ids + [2])] += 1
    for p in pieces:
        got[p.doc_id, p.doc_tokens].append(p)
        sequences[p.sequence_id].append(p)
        assert p.length > 0 and len(p.ids) == 4 * p.length
    found = Counter()
    for (doc_id, n), own in got.items():
        own.sort(key=lambda p: (p.sequence_id, p.offset))
        ids = [i for p in own for i in np.frombuffer(p.ids, "<u4").tolist()]
        at = 0
        for p in own:
            assert p.start == at % n
            at += p.length
        for a in range(0, len(ids), n):
            found[doc_id, tuple(ids[a : a + n])] += 1
    assert found == want
    padding = 0
    for own in sequences.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= size
        padding += (size - at) * (at & (at - 1) > 0)
    return padding, sequences


def test_pack(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    pieces = packing.pack(docs, MODEL).collect()
    padding, sequences = packed_well(pieces, [(r.doc_id, r.text) for r in docs.collect()])
    assert padding < 0.02 * sum(p.length for p in pieces)
    for own in sequences.values():  # the order is kept
        ids = [p.doc_id for p in sorted(own, key=lambda p: p.offset)]
        assert ids == sorted(ids)


def test_pack_odd(spark, odd):
    pieces = packing.pack(odd, MODEL).collect()
    packed_well(pieces, [(r.doc_id, r.text) for r in odd.collect()])
    small = packing.pack(odd, MODEL, size=64).collect()
    packed_well(small, [(r.doc_id, r.text) for r in odd.collect()], 64)
    assert packing.pack(odd.limit(0), MODEL).count() == 0


def test_pack_hot_key(spark):
    """A third of the rows share one order key: they are dealt out all the same."""
    texts = [(None if i % 3 == 0 else i, f"text {i} of its own.") for i in range(900)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = packing.pack(spark.createDataFrame(texts, "doc_id long, text string").repartition(6), MODEL).cache()
    assert got.withColumn("p", F.expr("sequence_id >> 36")).where("doc_id IS NULL").select("p").distinct().count() > 1
    packed_well(got.collect(), texts)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("seed", range(6))
def test_least_cost(seed):
    """The dynamic program against all cuts tried one after another."""
    rng = np.random.default_rng(seed)
    kinds = rng.choice([0, 1, 2], 700, p=[0.9, 0.07, 0.03]).astype(np.uint8)
    if seed == 5:
        kinds[:] = 0
    size, costs, per = 128, (3, 9), 2
    places, cost = packing.candidates(kinds, costs)
    assert places[0] == 0 and places[-1] == 700 and np.diff(places).max() <= packing.GRID
    f, _ = packing.least_cost(places, cost, size, per)
    best = [0]
    for j in range(1, len(places)):
        options = []
        for i in range(j):
            n = int(places[j] - places[i])
            if n <= size:
                options.append(best[i] + (0 if n & (n - 1) == 0 else size - n))
        best.append(min(options) + per + int(cost[j]))
    assert f == best
    ends = packing.windows(kinds, size, costs, per, True)
    n = np.diff(ends, prepend=0)
    paid = sum((0 if x & (x - 1) == 0 else size - x) + per for x in n.tolist()) + sum(int(cost[np.searchsorted(places, e)]) for e in ends)
    assert paid == best[-1] and ends[-1] == 700


def test_stretches(monkeypatch):
    """Windows of a stream cut stretch by stretch cover it as one does."""
    monkeypatch.setattr(packing, "STRETCH", 1000)
    rng = np.random.default_rng(1)
    packer, sizes = packing.Packer(256, (3, 9), 2, 0), rng.integers(1, 900, 60)
    out = []
    for i, n in enumerate(sizes.tolist()):
        kinds = rng.choice([0, 1], n, p=[0.9, 0.1]).astype(np.uint8)
        kinds[-1] = 2
        out += packer.add([i], np.full(n, i, np.int32), kinds, np.array([n]))
    out += packer.flush()
    rows = [r for b in out for r in b.to_pylist()]
    for i, n in enumerate(sizes.tolist()):
        own = [r for r in rows if r["doc_id"] == i]
        assert sum(r["length"] for r in own) == n and own[0]["start"] == 0
        assert all(set(np.frombuffer(r["ids"], "<u4").tolist()) == {i} for r in own)
    for s in {r["sequence_id"] for r in rows}:
        own = [r for r in rows if r["sequence_id"] == s]
        assert sum(r["length"] for r in own) <= 256 and own[0]["offset"] == 0


def test_pack_query(spark, sf):
    got = registry.op11_packing(spark, sf)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    model = Tokenizer.from_file(MODEL)
    for r in got.limit(40).collect():
        ids = np.array(model.encode(docs[r.doc_id] or "", add_special_tokens=False).ids + [2], "<u4")
        assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids)


TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_audit(rows, least, top):
    texts = [(r.lang or "", r.source or "", TERM.findall((r.text or "").translate(ASCII))) for r in rows]
    out = []
    for lang in {x[0] for x in texts}:
        own = [x for x in texts if x[0] == lang]
        kept = sorted(t for t, n in Counter(t for _, _, w in own for t in set(w)).items() if n >= least)
        by = {s: Counter(t for _, s2, w in own if s2 == s for t in w if t in set(kept)) for s in {x[1] for x in own}}
        every = sum(by.values(), Counter())

        def p(c):
            total = sum(c.values()) + 5 * len(kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 5) // total for t in kept}

        q, ps = p(every), {s: p(c) for s, c in by.items()}
        for s in by:
            pairs = sorted((-sum(abs(ps[s][t] - ps[o][t]) for t in kept), o.encode(), o) for o in by if o != s)
            out += [(lang, s, "pair", o, -v, i + 1) for i, (v, _, o) in enumerate(pairs)]
            terms = sorted((q[t] - ps[s][t], t.encode(), t) for t in kept if by[s][t] and ps[s][t] > q[t])[:top]
            out += [(lang, s, "term", t, -v, i + 1) for i, (v, _, t) in enumerate(terms)]
    return sorted(out)


@pytest.mark.parametrize(("least", "top"), [(30, 50), (2, 7)])
def test_audit(spark, sf, monkeypatch, least, top):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    if top == 7:
        monkeypatch.setattr(divergence, "CELL", 50)
        monkeypatch.setattr(divergence, "LEAVES", 900)
        monkeypatch.setattr(divergence, "COUNTERS", 2000)
        monkeypatch.setattr(divergence, "SLICE_BYTES", 3000)
        monkeypatch.setattr(divergence, "MATRIX", 64)
    assert sorted(map(tuple, divergence.audit(docs, least, top).collect())) == brute_audit(docs.collect(), least, top)


def test_audit_odd(odd):
    for least in (1, 3):
        assert sorted(map(tuple, divergence.audit(odd, least).collect())) == brute_audit(odd.collect(), least, 50)
    assert divergence.audit(odd.limit(0)).count() == 0


def test_trie():
    """Leaves come in byte order, whatever order they went in; shares are exact beyond a long's product."""
    rng = np.random.default_rng(2)
    words = [bytes(rng.integers(97, 100, rng.integers(0, 6)).tolist()) for _ in range(400)] + ["é日".encode(), "é".encode(), b"", b"a" * 3000]
    t, number = divergence.Trie(), {}
    for w in words:
        assert t.leaf(w, len(number)) == number.setdefault(w, len(number))
    assert list(t.walk()) == sorted(number.items())
    big = np.array([[10**13, 7]])
    assert divergence.shares(big, np.array([10**13 + 17])).tolist() == [[1 + 10**9 * (10**13 + 5) // (10**13 + 17), 1 + 10**9 * 12 // (10**13 + 17)]]


def brute_mine(rows, positives=5, negatives=5, share=80):
    good = []
    for n, r in enumerate(rows):
        if r[0] is None or r[1] is None or r[2] is None or any(x is None or not np.isfinite(x) for x in r[1]):
            continue
        good.append((r[0], [int(np.floor(256 * float(x))) for x in r[1]], r[2], n))
    out = []
    for a in good:
        if a[0] % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a[1], b[1])), b[0], b[3], b[2]) for b in good if b[3] != a[3] and len(b[1]) == len(a[1]))
        for p in [s for s in scored if s[3] == a[2]][:positives]:
            fits = [s for s in scored if s[3] != a[2] and share * -p[0] <= 100 * -s[0] <= 100 * -p[0]][:negatives]
            out += [(a[0], p[1], i + 1, s[1], -p[0], -s[0]) for i, s in enumerate(fits)]
    return sorted(out)


def mined(spark, rows, kind="float", **more):
    got = hard_negatives.mine(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int, row string, q string, cell int"), **more)
    return sorted(map(tuple, got.collect()))


@pytest.mark.parametrize("small", [False, True])
def test_mine(spark, monkeypatch, small):
    """Clusters, one very common vector and ties, in large and in small blocks and groups."""
    if small:
        for name, value in (("SAMPLE", 60), ("CELLS", 8), ("BLOCKS", 5), ("BLOCK", 90), ("GROUP", 3), ("LEAF", 7), ("ANCHOR_LEAF", 2)):
            monkeypatch.setattr(hard_negatives, name, value)
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(9, 6))
    points = np.round(centers[rng.integers(0, 9, 900)] + 0.1 * rng.normal(size=(900, 6)), 2)
    points[::3] = points[0]
    rows = [(i, p.astype(np.float32).tolist(), int(rng.integers(0, 4)), "x", "y", 1) for i, p in enumerate(points)]
    assert mined(spark, rows) == brute_mine(rows)


def test_mine_odd(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 1), (100, [0.0, 0.0], 1), (100, [0.0, 0.0], 1), (200, [], 1), (201, [], 1), (202, [], 2), (300, [-1.0, 0.5], 2), (400, [1.0], 1), (401, [2.0], 1), (402, [2.0], 2), (402, [1.7], 2)]
    rows += [(500, None, 1), (600, [1.0, None], 1), (700, [nan, 1.0], 1), (800, [inf, 1.0], 1), (900, [1.0, 2.0], None), (None, [1.0, 2.0], 1)]
    rows += [(i, [1.0 + i / 64, 2.0 - i / 97], i % 3) for i in range(1, 90)] + [(7, [1.0, 2.0], 2), (7, [1.0, 2.0], 2)]
    rows = [(*r, "x", None, 3) for r in rows]
    assert mined(spark, rows) == brute_mine(rows)
    assert mined(spark, rows[:0]) == [] and mined(spark, rows[11:17]) == []


def test_mine_large_components(spark):
    """Products beyond 2**53 are exact."""
    rng = np.random.default_rng(5)
    rows = [(i * 10, (rng.integers(1 << 20, 1 << 21, 3) / 1).tolist(), i % 3, "x", "y", 1) for i in range(80)]
    assert mined(spark, rows, "double") == brute_mine(rows)
    assert hard_negatives.products(np.array([[2.0**60, 1.0]]), np.array([[2.0**3, 5.0], [-(2.0**4), 0.0]])).tolist() == [[(1 << 63) - 1, hard_negatives.NO_SCORE + 1]]


def test_intervals():
    """No product of two nodes' points leaves their interval."""
    rng = np.random.default_rng(6)
    a, b = np.floor(rng.normal(size=(300, 5)) * 50), np.floor(rng.normal(size=(500, 5)) * 50 + 20)
    t, u = hard_negatives.tree(a, 16), hard_negatives.tree(b, 16)
    for i in range(len(t.first)):
        lo, hi = hard_negatives.intervals(t, i, u, list(range(len(u.first))))
        for j in range(len(u.first)):
            s = a[t.order[t.first[i] : t.last[i]]] @ b[u.order[u.first[j] : u.last[j]]].T
            assert lo[j] <= s.min() and s.max() <= hi[j]
