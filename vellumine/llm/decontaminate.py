"""Benchmark decontamination by winnowing.

An item's windows are its runs of ``window`` words; an item of fewer words is
one window. For a window of L words, k-grams are hashed and the least hash of
each L - k + 1 consecutive ones is kept: two texts that share a window share
the kept hash at the same place in it. Documents' kept hashes are looked up
among the benchmark's; every hit is extended word by word to the longest
shared run, which counts if it holds a whole window.

A benchmark of bounded text is broadcast to the documents as an index. A
larger one stays a table of kept hashes: a bitmap of fixed size sifts the
documents' own, what passes is equality-joined with the table, and each pair
of a document and an item that meet is extended by itself.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumine.llm import words as W
from vellumine.llm.shared import RUNS, broadcast_if_small, joined, keyed, merged_runs, saved, table_bytes

#: Words of a k-gram where the window is that long.
GRAM = 6
#: Bytes of benchmark text up to which its index is broadcast, and bits of the bitmap beyond that.
BLOCK_BYTES, BITMAP = 4_000_000, 1 << 27
#: Low bits of a hash that are looked up before the hash itself.
SIEVE = W.U((1 << 20) - 1)


class Words:
    """The lower-cased words of some texts: spans, hashes and the text of each."""

    def __init__(self, texts: W.Texts):
        self.data = texts.lowered()
        self.start, self.end = W.spans(self.data, W.ALNUM)
        self.owner = texts.owner(self.start)
        self.hash = W.span_hashes(self.data, self.start, self.end)
        self.count = W.counts(self.owner, texts.n)
        self.first = np.cumsum(self.count) - self.count

    def spelled(self, a: int, b: int) -> list[bytes]:
        return [self.data[s:e].tobytes() for s, e in zip(self.start[a:b], self.end[a:b])]

    def kept(self, window: int) -> tuple[np.ndarray, np.ndarray]:
        """For each word that begins a window in its text: its number and the least hash of the window."""
        k = min(GRAM, window)
        starts = len(self.hash) - window + 1
        if starts <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        grams = W.run_hashes(self.hash, k)
        least = grams[:starts].copy()
        for j in range(1, window - k + 1):
            np.minimum(least, grams[j : j + starts], out=least)
        at = np.flatnonzero(self.owner[:starts] == self.owner[window - 1 :])
        self.grams = grams
        return at, least[at]


@dataclass
class Index:
    """The fingerprints of a block of items, by window length."""

    words: Words
    #: Of each text the ids of the items that have it.
    ids: list[list[str]]
    #: window: sorted hashes, the word of each, and a sieve of their low bits.
    by_window: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]


def index_of(items: pa.RecordBatch, window: int) -> Index:
    """Index of item texts (``items``, their ids; ``text``); a text without words has none."""
    words = Words(W.Texts(items.column("text")))
    length = np.minimum(words.count, window)
    by_window = {}
    for size in sorted(set(length[length > 0].tolist())):
        at, least = words.kept(size)
        mine = length[words.owner[at]] == size
        at, least, hashes, places = at[mine], least[mine], [], []
        for j in range(size - min(GRAM, size) + 1):  # every place of the least hash, ties too
            same = words.grams[at + j] == least
            hashes.append(least[same])
            places.append(at[same] + j)
        pairs = np.unique(np.stack([np.concatenate(hashes), np.concatenate(places).astype(np.uint64)], 1), axis=0)
        sieve = np.zeros(int(SIEVE) + 1, bool)
        sieve[(pairs[:, 0] & SIEVE).astype(np.int64)] = True
        by_window[size] = (pairs[:, 0], pairs[:, 1].astype(np.int64), sieve)
    return Index(words, items.column("items").to_pylist(), by_window)


def _run(doc: Words, p: int, items: Words, q: int) -> tuple[int, int]:
    """The longest run of equal words around word p of the documents and word q of the items."""
    d0, d1 = doc.first[doc.owner[p]], doc.first[doc.owner[p]] + doc.count[doc.owner[p]]
    i0, i1 = items.first[items.owner[q]], items.first[items.owner[q]] + items.count[items.owner[q]]
    back, on = min(p - d0, q - i0), min(d1 - p, i1 - q)
    left = doc.hash[p - back : p][::-1] != items.hash[q - back : q][::-1]
    right = doc.hash[p : p + on] != items.hash[q : q + on]
    return p - (int(left.argmax()) if left.any() else back), p + (int(right.argmax()) if right.any() else on)


def hits(texts: W.Texts, index: Index) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[set[str]]]:
    """Of each text: its word count, the runs of words that windows cover, and the items that occur."""
    doc, items = Words(texts), index.words
    runs: list[list[tuple[int, int]]] = [[] for _ in range(texts.n)]
    found: list[set[str]] = [set() for _ in range(texts.n)]
    for window, (hashes, places, sieve) in index.by_window.items():
        at, least = doc.kept(window)
        if not len(at):
            continue
        maybe = np.flatnonzero(sieve[(least & SIEVE).astype(np.int64)])
        low, high = np.searchsorted(hashes, least[maybe], "left"), np.searchsorted(hashes, least[maybe], "right")
        found_at = np.flatnonzero(high > low)
        maybe, low, high = maybe[found_at], low[found_at], high[found_at]
        # The first place of the least gram in each window; windows with the same one meet the same words.
        place = at[maybe].copy()
        for j in range(window - min(GRAM, window), -1, -1):
            same = doc.grams[at[maybe] + j] == least[maybe]
            place[same] = at[maybe][same] + j
        done: dict[tuple[int, int], int] = {}
        for k in np.flatnonzero(np.diff(place, prepend=-1)):
            p = int(place[k])
            for q in places[low[k] : high[k]].tolist():
                if done.get((int(doc.owner[p]), p - q), -1) > p:
                    continue
                a, b = _run(doc, p, items, q)
                done[int(doc.owner[p]), p - q] = b
                if b - a < window or doc.spelled(a, b) != items.spelled(a - p + q, b - p + q):
                    continue
                owner = int(doc.owner[p])
                runs[owner].append((a - int(doc.first[owner]), b - int(doc.first[owner])))
                found[owner].update(index.ids[int(items.owner[q])])
    return doc.count, runs, found


_RUNS_ARROW = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
_FOUND = f"doc_id long, h long, runs {RUNS}, items array<string>, n_words long"


def _found_rows(part: pa.RecordBatch, n, runs, found) -> pa.RecordBatch:
    runs = pa.array([[{"a": a, "b": b} for a, b in r] for r in runs], _RUNS_ARROW)
    return pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("h"), runs, pa.array([sorted(f) for f in found], pa.list_(pa.string())), pa.array(n)], ["doc_id", "h", "runs", "items", "n_words"])


def _by_broadcast(rows: DataFrame, texts: DataFrame, window: int) -> DataFrame:
    """(doc_id, h, runs, items, n_words) of each row of ``keyed``; ``texts`` holds BLOCK_BYTES of text at most."""
    block = texts.select("items", "text").toArrow().combine_chunks()
    sent = rows.sparkSession.sparkContext.broadcast(block.to_batches()[0].serialize().to_pybytes() if block.num_rows else None)
    schema = block.schema.serialize().to_pybytes()

    def of_batches(batches):
        index = None
        if sent.value is not None:
            index = index_of(pa.ipc.read_record_batch(pa.py_buffer(sent.value), pa.ipc.read_schema(pa.py_buffer(schema))), window)
        for batch in batches:
            for part in W.slices(batch, "text"):
                own = W.Texts(part.column("text"))
                yield _found_rows(part, *(hits(own, index) if index else (Words(own).count, [[]] * own.n, [set()] * own.n)))

    return rows.mapInArrow(of_batches, _FOUND)


def _keys(words: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The text number and a key of each distinct kept hash of the windows of that many words."""
    at, least = words.kept(window)
    pairs = np.unique(np.stack([words.owner[at].astype(np.uint64), W.mix(least + W.U(window))], 1), axis=0)
    return pairs[:, 0].astype(np.int64), np.ascontiguousarray(pairs[:, 1])


def _by_join(rows: DataFrame, texts: DataFrame, window: int) -> DataFrame:
    """As ``_by_broadcast``, for ``texts`` (a saved table) of any size."""

    def of_items(batches):
        for batch in batches:
            for part in W.slices(batch, "text"):
                words = Words(W.Texts(part.column("text")))
                length = np.minimum(words.count, window)
                for size in sorted(set(length[length > 0].tolist())):
                    owner, key = _keys(words, size)
                    owner, key = (x[length[owner] == size] for x in (owner, key))
                    yield pa.RecordBatch.from_arrays([part.column("g").take(pa.array(owner)), pa.array(key.view(np.int64)), pa.array(np.full(len(key), size, np.int32))], ["g", "key", "size"])

    prints = saved(texts.select("g", "text").mapInArrow(of_items, "g long, key long, size int"), "prints")
    bit = F.col("key").bitwiseAND(BITMAP - 1)
    maps = prints.groupBy(F.shiftright(bit, 15).alias("part")).agg(F.bitmap_construct_agg(bit.bitwiseAND(32767)).alias("bits"))
    sieve = np.zeros(BITMAP // 8, np.uint8)
    for r in maps.toLocalIterator():  # BITMAP / 32768 rows of 4 KB at most
        sieve[r["part"] * 4096 : (r["part"] + 1) * 4096] = np.frombuffer(r["bits"], np.uint8)
    sizes = [r["size"] for r in prints.select("size").distinct().collect()]  # ``window`` rows at most
    sent = rows.sparkSession.sparkContext.broadcast(sieve)

    def of_docs(batches):
        for batch in batches:
            for part in W.slices(batch, "text"):
                words = Words(W.Texts(part.column("text")))
                lists = [np.zeros(0, np.uint64)] * part.num_rows
                for size in sizes:
                    owner, key = _keys(words, size)
                    b = (key & W.U(BITMAP - 1)).astype(np.int64)
                    maybe = (sent.value[b >> 3] >> (b & 7).astype(np.uint8)) & 1 == 1
                    for k in np.unique(owner[maybe]).tolist():
                        lists[k] = np.concatenate([lists[k], key[maybe & (owner == k)]])
                keys = pa.array([x.view(np.int64) for x in lists], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("h"), pa.array(words.count), keys], ["doc_id", "h", "n_words", "keys"])

    sifted = saved(rows.mapInArrow(of_docs, "doc_id long, h long, n_words long, keys array<bigint>"), "sifted")
    met = sifted.select("doc_id", "h", F.explode("keys").alias("key")).join(prints.select("key", "g").distinct(), "key").select("doc_id", "h", "g").distinct()
    pairs = joined(rows, broadcast_if_small(saved(met, "met")), "inner").join(texts.select("g", "items", F.col("text").alias("item_text")), "g")

    def of_pairs(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                index = index_of(pa.RecordBatch.from_arrays([one.column("items"), one.column("item_text")], ["items", "text"]), window)
                yield _found_rows(one, *hits(W.Texts(one.column("text")), index))

    found = pairs.select("doc_id", "h", "text", "items", "item_text").mapInArrow(of_pairs, _FOUND).groupBy("doc_id", "h")
    found = found.agg(F.flatten(F.collect_list("runs")).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    found = saved(found.withColumnsRenamed({"doc_id": "i", "h": "g"}), "found")
    full = sifted.join(found, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("g")), "left")
    return full.select("doc_id", "h", F.coalesce("runs", F.array().cast(RUNS)).alias("runs"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), "n_words")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, percent: int = 5, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, h, n_words, runs, n_hit, items, contaminated) of each row of ``docs``.

    ``runs`` are the word ranges inside occurrences of windows, ``items`` the
    ids (as text, sorted) of items with such windows; a document is
    contaminated if they are at least ``percent`` in a hundred of its words.
    Null or empty text has no words and is clean; an item without words has
    no window; an item with a null id is listed as an empty string; items
    that share an id count once. Repeated rows get the same result each. An
    empty benchmark leaves every document clean.
    """
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.col(item_text).cast("string").alias("text")).where("text IS NOT NULL")
    texts = saved(items.groupBy("text").agg(F.collect_set("item").alias("items")).select(F.xxhash64("text").alias("g"), "text", "items"), "items")
    rows = keyed(docs, doc_id, text)
    found = _by_broadcast(rows, texts, window) if table_bytes(texts) <= BLOCK_BYTES else _by_join(rows, texts, window)
    found = found.withColumn("runs", merged_runs(F.col("runs")))
    n_hit = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["b"] - r["a"])
    return found.withColumn("n_hit", n_hit).select("doc_id", "h", "n_words", "runs", "n_hit", "items", ((F.col("n_hit") > 0) & (100 * F.col("n_hit") >= percent * F.col("n_words"))).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    bad = contamination(docs, benchmark, doc_id=doc_id, text=text, **settings).where("contaminated").select("doc_id", "h").distinct()
    return joined(docs, bad, "left_anti", doc_id, text)
