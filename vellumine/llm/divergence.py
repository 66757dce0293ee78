"""Source divergence audit by mergeable radix tries.

A task counts terms in a byte trie for each language. A leaf holds how often
its term occurs in each source and in how many of the language's documents;
the root, which stands for the empty term, counts the documents of the
sources. Tries are written as walks of their leaves in byte order, dealt by
prefix range and merged range by range: equal leaves meet and add up. A cell
is a run of neighbouring leaves. Walking it in UTF-8 order yields its part of
every pair's sum and its best candidates with ties in order; cells' parts are
then added up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellumine.llm import words as W
from vellumine.llm.shared import broadcast_if_small, saved

#: `[^\x00-\x40\x5B-\x60\x7B-\x7F]`, lower case.
LETTER = W._table(lambda b: 0x61 <= b <= 0x7A or b >= 0x80)
#: Bytes of text counted at a time; leaves, counters and bytes of terms after which a task writes its tries and begins anew; leaves of a merged cell; entries of a matrix.
SLICE_BYTES, LEAVES, COUNTERS, TERM_BYTES, CELL, MATRIX = 2 << 20, 500_000, 4_000_000, 32 << 20, 4096, 1 << 20
ROWS = pa.schema([("lang", pa.string()), ("term", pa.string()), ("docs", pa.int64()), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])
SQL_ROWS = "lang string, term string, docs long, sources array<string>, counts array<long>"


class Trie:
    """A radix tree over byte strings. A node is [label, children by first byte, number of the leaf that ends there]."""

    def __init__(self):
        self.root, self.size, self.number = [b"", {}, None], 0, {}

    def leaf(self, term: bytes, number: int) -> int:
        """The number of the term's leaf; a term that is not there gets a leaf with ``number``."""
        known = self.number.get(term)
        if known is not None:
            return known
        node, at = self.root, 0
        while at < len(term):
            child = node[1].get(term[at])
            if child is None:
                child = node[1][term[at]] = [term[at:], {}, None]
                at = len(term)
            elif term.startswith(child[0], at):
                at += len(child[0])
            else:
                label, k = child[0], 1
                while k < len(label) and at + k < len(term) and label[k] == term[at + k]:
                    k += 1
                child[0] = label[k:]
                child = node[1][term[at]] = [label[:k], {label[k]: child}, None]
                at += k
            node = child
        node[2] = self.number[term] = number
        self.size += len(term)
        return number

    def walk(self) -> Iterator[tuple[bytes, int]]:
        """Terms and their leaves' numbers in byte order, which is that of UTF-8."""
        open_ = [(b"", self.root)]
        while open_:
            before, (label, children, number) = open_.pop()
            term = before + label
            if number is not None:
                yield term, number
            open_ += [(term, children[b]) for b in sorted(children, reverse=True)]


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of the values of each."""
    order = np.argsort(keys, kind="stable")
    keys, first = keys[order], np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    return keys[first], np.add.reduceat(values[order], np.flatnonzero(first)) if len(keys) else values


class Tries:
    """The tries of a task, one for each language, and their leaves' counters."""

    def __init__(self):
        self.tries: dict[str, Trie] = {}
        self.sources: dict[str, int] = {}
        self.leaves = 0
        self.docs: list[tuple[np.ndarray, np.ndarray]] = []  # leaves and documents
        self.counts: list[tuple[np.ndarray, np.ndarray]] = []  # leaf << 32 | source, occurrences
        self.held = 0

    def _leaf(self, lang: str, term: bytes) -> int:
        number = self.tries.setdefault(lang, Trie()).leaf(term, self.leaves)
        self.leaves += number == self.leaves
        return number

    def _add(self, leaves, docs, keys, counts) -> None:
        self.docs.append((leaves, docs))
        self.counts.append((keys, counts))
        self.held += len(keys)
        if self.held > COUNTERS:
            for rows in (self.docs, self.counts):
                rows[:] = [summed(*(np.concatenate([r[k] for r in rows]) for k in (0, 1)))]
            self.held = len(self.counts[0][0])

    def count(self, texts: W.Texts, langs: list[str], sources: list[str]) -> None:
        """Count the terms of ``texts``; the root of a language counts its documents."""
        group = np.array([self.sources.setdefault(s, len(self.sources)) for s in sources], np.int64)
        roots = np.array([self._leaf(x, b"") for x in langs], np.int64)
        self._add(*summed(roots, np.ones_like(roots)), *summed(roots << 32 | group, np.ones_like(roots)))
        low = texts.lowered()
        start, end = W.spans(low, LETTER)
        if not len(start):
            return
        packed, cuts = low[W.looked_up(low, LETTER).view(bool)], np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(cuts), pa.py_buffer(packed)]).dictionary_encode()
        terms, k = coded.dictionary.to_pylist(), len(coded.dictionary)
        names = {x: i for i, x in enumerate(dict.fromkeys(langs))}
        name = np.array([names[x] for x in langs], np.int64)
        in_doc, n = np.unique(texts.owner(start) * k + coded.indices.to_numpy(), return_counts=True)
        doc, code = np.divmod(in_doc, k)
        distinct, at, docs = np.unique(name[doc] * k + code, return_inverse=True, return_counts=True)
        of = list(names)
        leaves = np.array([self._leaf(of[x // k], terms[x % k]) for x in distinct.tolist()], np.int64)
        self._add(leaves, docs, *summed(leaves[at] << 32 | group[doc], n))

    def full(self) -> bool:
        return self.leaves > LEAVES or self.held > COUNTERS or sum(t.size for t in self.tries.values()) > TERM_BYTES

    def rows(self) -> Iterator[pa.RecordBatch]:
        """The leaves of all tries as they are walked, with their documents and the counts of their sources."""
        if not self.leaves:
            return
        docs = np.zeros(self.leaves, np.int64)
        for leaves, n in self.docs:
            np.add.at(docs, leaves, n)
        key, n = summed(*(np.concatenate([c[k] for c in self.counts]) for k in (0, 1)))
        names, source = pa.array(list(self.sources), pa.string()), pa.array((key & 0xFFFFFFFF).astype(np.int32))
        first = np.searchsorted(key >> 32, np.arange(self.leaves + 1))
        for lang, trie in self.tries.items():
            walked = list(trie.walk())
            for a in range(0, len(walked), 8192):
                terms, order = zip(*walked[a : a + 8192])
                order = np.array(order)
                size = (first[order + 1] - first[order]).astype(np.int64)
                upto = np.cumsum(size)
                places = np.arange(upto[-1]) + np.repeat(first[order] - upto + size, size)
                offsets = pa.array(np.append(0, upto).astype(np.int32))
                lists = pa.ListArray.from_arrays(offsets, names.take(source.take(pa.array(places)))), pa.ListArray.from_arrays(offsets, pa.array(n[places]))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(terms), pa.string()), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(docs[order]), *lists], schema=ROWS)


def partial_tries(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """The leaves of the tries that tasks make of their documents; a term has a row for each trie that it is in."""
    rows = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])

    def count(batches):
        tries = Tries()
        for batch in batches:
            for part in W.slices(batch, "text", SLICE_BYTES):
                tries.count(W.Texts(part.column("text")), part.column("lang").to_pylist(), part.column("source").to_pylist())
                if tries.full():
                    yield from tries.rows()
                    tries = Tries()
        yield from tries.rows()
        del tries
        W.release()

    return rows.mapInArrow(count, SQL_ROWS)


def _merged(rows: pa.Table) -> pa.Table:
    """Rows in order of language and term, one for each: documents added up, and occurrences by source."""
    lang, term = (rows.column(c).combine_chunks() for c in ("lang", "term"))
    new = np.ones(len(term), bool)
    if len(term) > 1:
        new[1:] = pc.or_(pc.not_equal(term[1:], term[:-1]), pc.not_equal(lang[1:], lang[:-1])).to_numpy(zero_copy_only=False)
    first = np.flatnonzero(new)
    lists = rows.column("sources").combine_chunks()
    coded = lists.flatten().dictionary_encode()
    leaf = np.repeat(np.cumsum(new) - 1, np.diff(lists.offsets.to_numpy()))
    key, n = summed(leaf << 32 | coded.indices.to_numpy(), rows.column("counts").combine_chunks().flatten().to_numpy())
    offsets = pa.array(np.searchsorted(key >> 32, np.arange(len(first) + 1)).astype(np.int32))
    docs, at = np.add.reduceat(rows.column("docs").to_numpy(), first), pa.array(first)
    sources = coded.dictionary.take(pa.array(key & 0xFFFFFFFF))
    return pa.Table.from_arrays([lang.take(at), term.take(at), pa.array(docs), pa.ListArray.from_arrays(offsets, sources), pa.ListArray.from_arrays(offsets, pa.array(n))], schema=ROWS)


def merged_tries(parts: DataFrame, least: int) -> DataFrame:
    """The leaves of the merged tries with ``cell``, the number of the prefix range that a leaf is in: roots, and terms of at least ``least`` documents.

    Equal terms meet in one range and follow each other there, as walks are
    in byte order; only the last leaf of a batch waits for the next one.
    """

    def merge(batches):
        first, wait, n = TaskContext.get().partitionId() << 32, ROWS.empty_table(), 0
        for batch in batches:
            rows = _merged(pa.concat_tables([wait, pa.Table.from_batches([batch], ROWS)]))
            wait, rows = rows.slice(len(rows) - 1), rows.slice(0, len(rows) - 1)
            rows = kept(rows)
            yield from numbered(rows, first + n // CELL)
            n += len(rows)
        yield from numbered(kept(wait), first + n // CELL)

    def kept(rows):
        return rows.filter(pc.or_(pc.greater_equal(rows.column("docs"), least), pc.equal(rows.column("term"), "")))

    def numbered(rows, cell):
        return rows.append_column("cell", pa.array(np.full(len(rows), cell))).to_batches()

    return parts.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(merge, SQL_ROWS + ", cell long")


def shares(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 (count + 5) / total), exactly."""
    exact = counts.astype(object) if counts.size and counts.max() > 9_000_000_000 else counts
    return (1 + 1_000_000_000 * (exact + 5) // total).astype(np.int64)


def _audited(top: int):
    """What one cell adds: for each two sources the sum of differences over its terms, for each source its ``top`` candidates."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])

    def of_cell(leaves: pa.Table, groups: pa.Table) -> pa.Table:
        groups, leaves = groups.sort_by("source"), leaves.sort_by("term")
        lang, names = groups.column("g_lang")[0].as_py(), groups.column("source").to_pylist()
        v, lang_n = (groups.column(c)[0].as_py() for c in ("v", "lang_n"))
        total, n = groups.column("n").to_numpy() + 5 * v, len(names)
        terms, held = leaves.column("term").to_pylist(), leaves.column("counts").combine_chunks() if leaves.num_rows else None
        size = np.diff(held.offsets.to_numpy()) if held is not None else np.zeros(0, np.int64)
        row = np.repeat(np.arange(len(terms)), size)
        of = {s: i for i, s in enumerate(names)}
        col = np.array([of[s] for s in leaves.column("sources").combine_chunks().flatten().to_pylist()], np.int64) if held is not None else row
        count = held.flatten().to_numpy() if held is not None else row
        out = [[], [], [], []]

        def add(source, part, item, value):
            for a, b in zip(out, (source, part, item, value)):
                a.extend(b)

        for a in range(0, n, tile := max(1, MATRIX // n)):
            sums = np.zeros((min(tile, n - a), n), np.int64)
            for first in range(0, len(terms), step := max(1, MATRIX // n)):
                dense = np.zeros((min(step, len(terms) - first), n), np.int64)
                here = (row >= first) & (row < first + step)
                dense[row[here] - first, col[here]] = count[here]
                p = shares(dense, total)
                for i in range(len(sums)):
                    sums[i] += np.abs(p - p[:, a + i, None]).sum(axis=0)
            for i in range(len(sums)):
                others = [j for j in range(n) if j != a + i]
                add([names[a + i]] * len(others), ["pair"] * len(others), [names[j] for j in others], sums[i, others].tolist())
        if len(terms):
            of_lang = np.zeros(len(terms), object if len(count) and float(count.max()) * n > 2**62 else np.int64)
            np.add.at(of_lang, row, count)
            more = shares(count, total[col]) - shares(of_lang, np.int64(lang_n + 5 * v))[row]
            keep = (more > 0) & (count > 0)
            r, c, m = row[keep], col[keep], more[keep]
            order = np.lexsort((r, -m, c))
            r, c, m = r[order], c[order], m[order]
            best = np.arange(len(c)) - np.searchsorted(c, c) < top
            add([names[j] for j in c[best]], ["term"] * int(best.sum()), [terms[j] for j in r[best]], m[best].tolist())
        return pa.Table.from_arrays([pa.array([lang] * len(out[0]), pa.string()), *(pa.array(x, f.type) for x, f in zip(out, list(schema)[1:]))], schema=schema)

    return of_cell


def audit(docs: DataFrame, least: int = 30, top: int = 50, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank): how far the sources of a language are apart, and by which terms.

    Part ``pair``: each other source of the language, by the sum of the
    differences of their smoothed shares over the terms that at least
    ``least`` documents of the language hold. Part ``term``: the ``top``
    terms of which a source has more than its language. All arithmetic is
    exact; counts may pass 2**63 / 10**9.

    Null language, source and text count as empty; a group without terms is
    compared like any other; a language without kept terms has sums of 0;
    repeated rows count each. Other columns are not read. An empty table
    gives an empty result.
    """
    kept = saved(merged_tries(saved(partial_tries(docs, lang, source, text), "tries"), least), "leaves")
    counters = kept.select("lang", "term", F.inline(F.arrays_zip("sources", "counts")))
    totals = counters.groupBy("lang", F.col("sources").alias("source")).agg(F.sum(F.when(F.col("term") == "", 0).otherwise(F.col("counts"))).alias("n"))
    of_lang = kept.where("term <> ''").groupBy("lang").agg(F.count("*").alias("v"))
    summed = totals.groupBy("lang").agg(F.sum("n").alias("lang_n")).join(of_lang, "lang", "left").withColumn("v", F.coalesce("v", F.lit(0)))
    groups = saved(totals.join(summed, "lang"), "groups")
    cells = kept.select("lang", "cell").distinct().join(broadcast_if_small(groups), "lang").withColumnsRenamed({"lang": "g_lang", "cell": "g_cell"})
    leaves = kept.where("term <> ''").select("lang", "cell", "term", "sources", "counts")
    schema = "lang string, source string, part string, item string, value long"
    found = saved(leaves.groupBy("lang", "cell").cogroup(cells.groupBy("g_lang", "g_cell")).applyInArrow(_audited(top), schema), "audited")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    best = found.where("part = 'term'").withColumn("rank", rank).where(F.col("rank") <= top)
    return pairs.withColumn("rank", rank).unionByName(best).select("lang", "source", "part", "item", "value", "rank")
