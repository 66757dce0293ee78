"""Repeated passages against a brute-force version over the chunks of each text alone, and recall by the length of a planted passage."""

from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from vellumine.llm import substring_dedup, words
from vellumine.llm.shared import keyed


def brute_repeats(rows, least=80):
    """{(doc_id, h): (spans, ids of the first copies)}: every pair of neighbouring chunks but its first one, and every text but its first copy."""
    places, copies, pieces = defaultdict(set), defaultdict(set), defaultdict(set)
    for r in rows:
        chunks = substring_dedup.Chunks(words.Texts(pa.array([r.text], pa.string())))
        d, at, n = chunks.digest.tolist(), chunks.point.tolist(), chunks.points.tolist()
        for i in range(len(d) - 1):
            places[d[i], d[i + 1]].add((r.doc_id is None, r.doc_id or 0, r.h, i, at[i], at[i] + n[i] + n[i + 1]))
        if r.text:
            copies[r.text].add((r.doc_id is None, r.doc_id or 0, r.h))
    for found in places.values():
        first = min(found)
        for p in found - {first}:
            pieces[None if p[0] else p[1], p[2]].add((p[4], p[5], None if first[0] else first[1], False))
    for text, found in copies.items():
        first = min(found)
        for p in found - {first}:
            pieces[None if p[0] else p[1], p[2]].add((0, len(text), None if first[0] else first[1], True))
    out = {}
    for key, own in pieces.items():
        spans = []
        for a, b, _, _ in sorted(own, key=lambda x: x[:2]):
            if spans and a <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], b)
            else:
                spans.append([a, b])
        spans = [tuple(s) for s in spans if any(w for _, _, _, w in own) or s[1] - s[0] >= least]
        if spans:
            out[key] = (spans, {f for _, _, f, _ in own})
    return out


def compared(docs):
    rows = keyed(docs).collect()
    got = {(r.doc_id, r.h): ([(x.a, x.b) for x in r.spans], set(r.first_ids)) for r in substring_dedup.repeats(keyed(docs)).collect()}
    want = brute_repeats(rows)
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(v[1] == {x for x in want[k][1] if x is not None} or v[1] == want[k][1] for k, v in got.items())
    return got


def test_against_brute_force(spark, sf):
    assert compared(spark.read.parquet(f"{sf}/documents.parquet"))


def test_odd_against_brute_force(spark):
    passage = "".join(chr(97 + int(x)) for x in np.random.default_rng(8).integers(0, 26, 600))
    rows = [(1, passage), (2, "é日本 " + passage), (2, "é日本 " + passage), (None, passage + " tail"), (3, None), (4, ""), (5, "no " * 700), (6, "yes " + "no " * 900), (7, "short"), (8, "short"), (None, "short")]
    assert compared(spark.createDataFrame(rows, "doc_id long, text string"))


@pytest.mark.parametrize(("n_words", "least"), [(20, 0.0), (30, 0.6), (40, 0.9), (55, 0.97), (100, 0.99)])
def test_recall_by_length(spark, n_words, least):
    """Share of planted passages of which most is found, by their length in words of six letters."""
    rng = np.random.default_rng(n_words)
    prose = lambda n: " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(n))
    rows, planted = [], {}
    for i in range(100):
        passage = prose(n_words)
        for k in (0, 1):
            front = prose(int(rng.integers(30, 60))) + " "
            rows.append((2 * i + k, front + passage + " " + prose(40)))
        planted[2 * i + 1] = (len(front), len(front) + len(passage))
    got = {r.doc_id: [(x.a, x.b) for x in r.spans] for r in substring_dedup.repeats(keyed(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    most = [sum(max(0, min(b, y) - max(a, x)) for x, y in got.get(i, [])) * 2 > b - a for i, (a, b) in planted.items()]
    assert np.mean(most) >= least
    assert all(i % 2 for i in got)  # first copies stay
    print(n_words, np.mean(most))
