"""Line deduplication by an exact set-similarity join.

A line is the set of its lower-cased words. Sets are classes: equal sets meet
by a hash and are compared once. The words of a set are ordered from rare to
common by a frequency table of fixed size; two sets with Jaccard similarity t
or more share a word in their prefixes (the first n - ceil(t n) + 1 words).
Prefixes meet by word; length, position and a bitmap (the Hamming distance of
two parity bitmaps never exceeds the sets' difference) discard pairs without
losing any that qualifies. What is left is verified on the words themselves.
A line goes if an earlier line matches it.

Words of a prefix that are frequent are no keys by themselves: beside a
frequent word sets meet by size class too and, unless they are large, by the
next word that they share, which is in the prefix of what follows the first.

One earlier match decides, so large groups of similar lines need not meet
pair by pair: at a key a set is paired with its nearest predecessors only,
its most promising pair is verified before its others, and just the sets that
this leaves undecided are compared with all others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumine.llm import words as W
from vellumine.llm.shared import broadcast_if_small, joined, keyed, saved, unused

U = W.U
#: Entries of the frequency table (a power of two); its size does not follow the vocabulary.
TABLE = 1 << 20
#: Bits of a word's hash beside the line's number in a sort key.
HASH_BITS = 44
_HASH_MASK = U((1 << HASH_BITS) - 1)


def _sorted(line: np.ndarray, value: np.ndarray, lines: int) -> tuple[np.ndarray, np.ndarray]:
    """Lines and values of HASH_BITS bits, sorted by line and value."""
    if lines >= 1 << (64 - HASH_BITS):  # over a million lines in one slice
        order = np.lexsort((value, line))
        return line[order], value[order]
    key = np.sort((line.astype(np.uint64) << U(HASH_BITS)) | value)
    return (key >> U(HASH_BITS)).astype(np.int64), key & _HASH_MASK


class Words:
    """The words of some texts: a hash of HASH_BITS bits and the line of each; where each line is."""

    def __init__(self, texts: W.Texts):
        data = texts.lowered()
        breaks = np.flatnonzero(data == 0x0A)
        begin = np.concatenate([[0], breaks[:-1] + 1]) if len(breaks) else breaks
        self.owner = texts.owner(begin)
        per = W.counts(self.owner, texts.n)
        self.number = np.arange(len(begin)) - (np.cumsum(per) - per)[self.owner]
        start, end = W.spans(data, W.NOT_BLANK)
        self.line = np.searchsorted(begin, start, side="right") - 1
        self.hash = W.span_hashes(data, start, end) & _HASH_MASK


class Lines:
    """The lines of some texts as sets of tokens, one entry per word of a set, rare words first.

    A token is a word's rarity before 32 bits of its own, the first of which
    says whether it is frequent.
    """

    def __init__(self, words: Words, rank: np.ndarray, often: np.ndarray):
        self.owner, self.number = words.owner, words.number
        entry = (words.hash & U(TABLE - 1)).astype(np.int64)
        token = (rank[entry] << U(32)) | (often[entry] << U(31)) | (W.mix(words.hash) & U(0x7FFFFFFF))
        line, token = _sorted(words.line, token, len(self.owner))
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (line[1:] != line[:-1])
        self.line, self.token = line[new], token[new]
        self.size = W.counts(self.line, len(self.owner))
        self.first = np.cumsum(self.size) - self.size


def _sums(values: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return total[first + size] - total[first]


#: Entries of the frequency table that are one row between tasks.
PART = 1 << 12


def _frequencies(rows: DataFrame) -> np.ndarray:
    """How many words of all lines fall in each entry of the table; tasks' tables are added up part by part."""

    def of_batches(batches):
        table, held = np.zeros(TABLE, np.int64), []
        for batch in batches:
            for part in W.slices(batch, "text"):
                held.append(Words(W.Texts(part.column("text"))).hash & U(TABLE - 1))
                if sum(map(len, held)) > TABLE:
                    table += np.bincount(np.concatenate(held).astype(np.int64), minlength=TABLE)
                    held = []
        table += np.bincount(np.concatenate([np.zeros(0, np.uint64), *held]).astype(np.int64), minlength=TABLE)
        for a in range(0, TABLE, PART):
            if table[a : a + PART].any():
                yield pa.RecordBatch.from_arrays([pa.array([a // PART], pa.int32()), pa.array([table[a : a + PART].tobytes()])], ["part", "counts"])
        del table, held
        W.release()

    def added(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, counts in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist()):
                sums[k] = sums.get(k, 0) + np.frombuffer(counts, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["part", "counts"])

    parts = rows.select("text").mapInArrow(of_batches, "part int, counts binary").repartition("part").mapInArrow(added, "part int, counts binary")
    table = np.zeros(TABLE, np.int64)
    for r in parts.collect():  # TABLE / PART rows at most
        table[r["part"] * PART : (r["part"] + 1) * PART] = np.frombuffer(r["counts"], np.int64)
    return table


#: Lines that hold a word from which on it is frequent, and words of a set up to which the next word is a key too.
FREQUENT, LARGE = 4096, 64


def _keys(token: np.ndarray, frequent: np.ndarray, place: np.ndarray, start: np.ndarray, n: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of sets' prefixes, place in the low 16 bits, and the number of each one's set.

    Tokens are given for all words, by set (``start``, ``n``) and rarity;
    ``length`` is that of the prefix. A word of a set of size class c meets
    those of c - 1 to c + 1; classes grow by a quarter.
    """
    slot = np.repeat(np.arange(len(n)), n)
    inside = np.flatnonzero(place < length[slot])
    rare = inside[~frequent[inside]]
    owners, keys, places = [slot[rare]], [W.mix(token[rare])], [place[rare]]
    often = inside[frequent[inside]]
    if len(often):
        size = np.floor(np.log(np.maximum(n, 1)) / np.log(1.25) + 1e-9).astype(np.int64)
        largest = int(np.floor(np.log(LARGE) / np.log(1.25)))
        for more in (0, 1):
            cell = size[slot[often]] + more
            base = W.mix(token[often] * U(0x9E3779B97F4A7C15) + cell.astype(np.uint64) + U(1))
            whole = cell > largest
            owners.append(slot[often][whole])
            keys.append(base[whole])
            places.append(place[often][whole])
            at, head = often[~whole], base[~whole]
            # The next shared word stands at one of the places up to the prefix's length.
            last = np.minimum(length[slot[at]], n[slot[at]] - 1)
            follow = np.maximum(last - place[at], 0)
            which = np.repeat(np.arange(len(at)), follow)
            step = np.arange(len(which)) - np.repeat(np.cumsum(follow) - follow, follow) + 1
            owners.append(slot[at][which])
            keys.append(W.mix(head[which] + token[at[which] + step] * U(0xC2B2AE3D27D4EB4F)))
            places.append(place[at][which])
    owner, key, at = (np.concatenate(x) for x in (owners, keys, places))
    order = np.argsort(owner, kind="stable")
    packed = (key & ~U(0xFFFF)) | np.minimum(at, 0xFFFF).astype(np.uint64)
    return packed[order], owner[order]


def _sets(rows: DataFrame, threshold: float, least: int) -> DataFrame:
    """(doc_id, h, line, class, set) of each line of at least ``least`` different words.

    ``set`` (n, bits0, bits1, keys) stands with a task's first line of a
    class only, in the order of lines.
    """
    table = _frequencies(rows)
    rank = np.minimum(np.log2(1.0 + table) * 100, 4095).astype(np.uint16)
    sent = rows.sparkSession.sparkContext.broadcast((rank, np.packbits(table > FREQUENT)))
    set_type = pa.struct([("n", pa.int32()), ("bits0", pa.int64()), ("bits1", pa.int64()), ("keys", pa.list_(pa.int64()))])

    def of_batches(batches):
        rank, often = sent.value  # rarity by table entry; whether it is frequent
        rank, often, seen = rank.astype(np.uint64), np.unpackbits(often).astype(np.uint64), np.zeros(0, np.uint64)  # seen: classes this task has shown
        for batch in batches:
            for part in W.slices(batch, "text"):
                lines = Lines(Words(W.Texts(part.column("text"))), rank, often)
                code = W.mix(_sums(W.mix(lines.token), lines.first, lines.size) + lines.size.astype(np.uint64))
                wide = np.flatnonzero(lines.size >= least)
                order = wide[np.argsort(code[wide], kind="stable")]
                sorted_code = code[order]
                new = np.ones(len(order), bool)
                new[1:] = sorted_code[1:] != sorted_code[:-1]
                at = np.searchsorted(seen, sorted_code)
                new &= np.append(seen, U(0))[at] != sorted_code if len(seen) else True
                seen = np.insert(seen, at[new], sorted_code[new])
                fresh = np.sort(order[new])
                full = np.zeros(len(code), bool)
                full[fresh] = True
                token = lines.token[full[lines.line]]
                n = lines.size[fresh]
                first = np.cumsum(n) - n
                length = n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1
                length[n < threshold * (n + 1) - 1e-9] = 0  # one more word is too many: only equal sets match
                own, place = token & U(0x7FFFFFFF), np.arange(len(token)) - np.repeat(first, n)
                keys, owner = _keys(own, (token >> U(31)) & U(1) == 1, place, first, n, length)
                low = own & U(64) == 0
                bit = U(1) << (own & U(63))
                bits = [np.bitwise_xor.reduceat(np.where(x, bit, U(0)), first) if len(first) else bit for x in (low, ~low)]
                offsets = np.concatenate([[0], np.cumsum(W.counts(owner, len(fresh)))]).astype(np.int32)
                made = [pa.array(n.astype(np.int32)), *[pa.array(x.view(np.int64)) for x in bits], pa.ListArray.from_arrays(offsets, keys.view(np.int64))]
                shown = pa.StructArray.from_arrays(made, fields=list(set_type))
                at = np.full(len(code), -1)
                at[fresh] = np.arange(len(fresh))
                at = at[wide]
                owner = pa.array(lines.owner[wide])
                columns = [part.column("doc_id").take(owner), part.column("h").take(owner), pa.array(lines.number[wide].astype(np.int32)), pa.array(code[wide].view(np.int64))]
                yield pa.RecordBatch.from_arrays([*columns, shown.take(pa.array(at, mask=at < 0))], ["doc_id", "h", "line", "class", "set"])
        del rank, often, seen
        W.release()

    ordered = rows.sortWithinPartitions(F.asc_nulls_last("doc_id"), "h")
    return ordered.mapInArrow(of_batches, "doc_id long, h long, line int, class long, set struct<n:int,bits0:bigint,bits1:bigint,keys:array<bigint>>")


def _place() -> Column:
    """A line's place in the order of all lines; rows without an id come last."""
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h", "line")


def _classes(sets: DataFrame) -> DataFrame:
    """(class, first, copies): each class with the place of its first line."""
    return sets.groupBy("class").agg(F.min(_place()).alias("first"), F.count("*").alias("copies"))


#: Earlier sets that a set is paired with at a key, and how far back it looks; what goes beyond is settled by ``_rest``.
NEAREST, BACK = 64, 4096
#: Entries that are paired at a time, with those that they look back to.
ENTRIES = 100_000


def _met(key, order, code, size, bits0, bits1, old: int, threshold: float, nearest: int, back: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a, b, apart) of sets at a key that pass the filters, b before a, and sets with pairs left out.

    Entries are sorted by key and order; the first ``old`` are not paired
    again. Of sets that share their order either may be the earlier one, so
    the pair is given both ways. A set that several tasks have shown has an
    entry of each; the first of them has its true order.
    """
    n, place, share = size >> 16, size & 0xFFFF, (1 - threshold) / (1 + threshold)
    taken, cut = np.zeros(len(key), np.int64), np.zeros(len(key), bool)
    left, right, bits, step, later = [], [], [], 1, np.arange(max(old, 1), len(key))
    while len(later := later[later >= step]) and len(later := later[key[later] == key[later - step]]):
        if step > back:
            cut[later] = True
            break
        before = later - step
        most = (n[later] + n[before]) * share + 1e-9
        fits = np.abs(n[later] - n[before]) <= most
        x, y, most = later[fits], before[fits], most[fits]
        fits = np.abs(place[x] - place[y]) <= most
        x, y, most = x[fits], y[fits], most[fits]
        apart = np.bitwise_count(bits0[x] ^ bits0[y]).astype(np.int64) + np.bitwise_count(bits1[x] ^ bits1[y])
        fits = (apart <= most) & (code[x] != code[y])
        if fits.any():
            x = x[fits]
            left.append(x)
            right.append(y[fits])
            bits.append(apart[fits])
            taken[x] += 1
            ended = taken[later] >= nearest
            cut[later[ended]] = True
            later = later[~ended]
        step += 1
    none = np.zeros(0, np.int64)
    x, y, apart = (np.concatenate([none, *z]) for z in (left, right, bits))
    same = order[x] == order[y]
    pairs = np.stack([np.concatenate([code[x], code[y[same]]]), np.concatenate([code[y], code[x[same]]]), np.concatenate([apart, apart[same]])], 1)
    ties = cut
    if cut.any():  # those of the same order may lack a pair as well
        run = np.cumsum((np.diff(key, prepend=key[:1] - 1) != 0) | (np.diff(order, prepend=order[:1] - 1) != 0))
        ties = np.isin(run, run[cut])
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    new = np.ones(len(pairs), bool)
    new[1:] = (pairs[1:, :2] != pairs[:-1, :2]).any(axis=1)
    return pairs[new], np.unique(code[ties])


def _entries(sets: DataFrame) -> DataFrame:
    """(key, order, class, size, bits0, bits1): the shown sets at their keys; size holds n and the place."""
    order = F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("order")
    each = sets.where("set IS NOT NULL").select("class", order, "set.n", "set.bits0", "set.bits1", F.explode("set.keys").alias("k"))
    size = F.shiftleft(F.col("n").cast("long"), 16).bitwiseOR(F.col("k").bitwiseAND(0xFFFF)).alias("size")
    return each.select(F.shiftright("k", 16).alias("key"), "order", "class", size, "bits0", "bits1")


def _candidates(sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b, apart) of classes to compare; with b null, a class of which pairs were left out."""
    names = ["key", "order", "class", "size", "bits0", "bits1"]
    side = _entries(sets).repartition("key").sortWithinPartitions("key", "order")
    nearest, back = NEAREST, BACK

    def of_batches(batches):
        def paired(held: list, waiting: list) -> tuple[list, pa.RecordBatch]:
            now = [np.concatenate([a, *x]) for a, x in zip(held, zip(*waiting))]
            pairs, cut = _met(*now[:4], *(x.view(np.uint64) for x in now[4:]), len(held[0]), threshold, nearest, back)
            none = np.arange(len(pairs) + len(cut)) >= len(pairs)
            columns = [np.concatenate([x, y]) for x, y in zip(pairs.T, (cut, cut, cut * 0))]
            # The last key may go on; what a later entry looks back to is kept.
            same = int(np.searchsorted(now[0], now[0][-1]))
            held = [x[max(same, len(x) - back - 1) :] for x in now]
            return held, pa.RecordBatch.from_arrays([pa.array(columns[0]), *(pa.array(c, mask=none) for c in columns[1:])], ["a", "b", "apart"])

        held, waiting = [np.zeros(0, np.int64)] * len(names), []
        for batch in batches:
            if batch.num_rows:
                waiting.append([batch.column(c).to_numpy(zero_copy_only=False) for c in names])
            if sum(len(x[0]) for x in waiting) >= ENTRIES:
                held, made = paired(held, waiting)
                waiting = []
                yield made
        if waiting:
            yield paired(held, waiting)[1]
        del held, waiting
        W.release()

    return side.mapInArrow(of_batches, "a long, b long, apart long").distinct()


def _rest(sets: DataFrame, open_: DataFrame, threshold: float) -> DataFrame:
    """(a, b): every pair that the filters leave for the classes of ``open_`` (class, until; a saved table) and those not after ``until``."""
    entries = _entries(sets)
    left = saved(entries.drop("order").join(broadcast_if_small(open_), "class").distinct(), "rest")
    left = left.select("key", "until", *[F.col(c).alias(f"{c}_a") for c in ("class", "size", "bits0", "bits1")])
    right = entries.select("key", "order", *[F.col(c).alias(f"{c}_b") for c in ("class", "size", "bits0", "bits1")])
    apart = F.bit_count(F.col("bits0_a").bitwiseXOR(F.col("bits0_b"))) + F.bit_count(F.col("bits1_a").bitwiseXOR(F.col("bits1_b")))
    n, place = ([f(F.col(f"size_{s}")) for s in "ab"] for f in (lambda x: F.shiftright(x, 16), lambda x: x.bitwiseAND(0xFFFF)))
    most = (n[0] + n[1]) * ((1 - threshold) / (1 + threshold)) + 1e-9
    near = (F.abs(n[0] - n[1]) <= most) & (F.abs(place[0] - place[1]) <= most) & (apart <= most)
    met = right.join(broadcast_if_small(left), "key").where((F.col("class_a") != F.col("class_b")) & (F.col("order") <= F.col("until")) & near)
    return met.select(F.col("class_a").alias("a"), F.col("class_b").alias("b")).distinct()


def _paired(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """(class, first) of the classes of ``pairs``; a saved table."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    return saved(classes.select("class", "first").join(wanted, "class"), "paired")


def _word_sets(paired: DataFrame, rows: DataFrame) -> DataFrame:
    """(class, words): the words, as 64-bit hashes, of each class of ``paired``, read from its first line; a saved table."""
    where = paired.groupBy("first.doc_id", "first.h").agg(F.collect_list(F.struct("first.line", "class")).alias("wanted"))
    where = saved(where.withColumnsRenamed({"doc_id": "vq_id", "h": "vq_h"}), "wanted")
    found = rows.join(broadcast_if_small(where), rows["doc_id"].eqNullSafe(where["vq_id"]) & (rows["h"] == where["vq_h"]))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

    def hashed(lines: Column):
        def of(w: Column) -> Column:
            words = F.filter(F.split(F.translate(F.get(lines, w["line"]), upper, lower), "[\\x20\\x09-\\x0D]+"), lambda x: x != "")
            return F.struct(w["class"].alias("class"), F.array_distinct(F.transform(words, lambda x: F.xxhash64(x))).alias("words"))

        return F.transform("wanted", of)

    each = found.select(F.explode(F.get(F.transform(F.array(F.split("text", "\n")), hashed), F.lit(0))).alias("x"))  # split once
    return saved(each.select("x.*").dropDuplicates(["class"]), "sets")


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs of classes whose words are similar enough."""
    both = pairs.select("a", "b").join(sets.withColumnsRenamed({"class": "a", "words": "wa"}), "a").join(sets.withColumnsRenamed({"class": "b", "words": "wb"}), "b")
    shared = F.size(F.array_intersect("wa", "wb"))
    return both.where(shared >= threshold * (F.size("wa") + F.size("wb") - shared) - 1e-9).select("a", "b")


def _earlier(links: DataFrame, firsts: DataFrame) -> DataFrame:
    """(class, near): of each class that matches an earlier one, the place of the earliest match known; a saved table."""
    ends = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    ends = ends.join(firsts.select(F.col("class").alias("b"), F.col("first").alias("near")), "b").join(firsts.select(F.col("class").alias("a"), "first"), "a")
    return saved(ends.where("near < first").groupBy(F.col("a").alias("class")).agg(F.min("near").alias("near")), "earlier")


def later_lines(rows: DataFrame, threshold: float = 0.8, least: int = 1) -> DataFrame:
    """(doc_id, h, lines): the numbers of the lines that go, for each row of ``keyed`` that loses any."""
    sets = saved(_sets(rows, threshold, least), "lines")
    classes = saved(_classes(sets), "classes")
    found = saved(_candidates(sets, threshold), "candidates")
    pairs = found.where("b IS NOT NULL")
    paired = _paired(pairs, classes)
    words, firsts = _word_sets(paired, rows), broadcast_if_small(paired)
    # A class is settled by an earlier match: the most alike by bitmap is tried first, then its others.
    best = pairs.groupBy("a").agg(F.min(F.struct("apart", "b")).alias("x")).select("a", "x.b")
    links = saved(_verified(best, words, threshold), "matches")
    earlier = _earlier(links, firsts)
    others = pairs.join(broadcast_if_small(earlier.select(F.col("class").alias("a"))), "a", "left_anti")
    more = saved(_verified(others, words, threshold), "more-matches")
    earlier = earlier.unionByName(_earlier(more, firsts))
    # One that has none, but pairs that were left out, meets all of them.
    until = F.coalesce("first.doc_id", F.lit((1 << 63) - 1)).alias("until")
    cut = saved(found.where("b IS NULL").select(F.col("a").alias("class")).join(earlier, "class", "left_anti"), "cut")
    if not cut.isEmpty():
        open_ = saved(classes.join(broadcast_if_small(cut), "class").select("class", until), "open")
        rest = saved(_rest(sets, open_, threshold), "rest-pairs")
        paired = _paired(rest, classes)
        met = saved(_verified(rest, _word_sets(paired, rows), threshold), "rest-matches")
        earlier = earlier.unionByName(_earlier(met, broadcast_if_small(paired)))
    near = saved(earlier.groupBy("class").agg(F.min("near").alias("near")), "near")
    bound = classes.join(broadcast_if_small(near), "class", "left").where((F.col("copies") > 1) | F.col("near").isNotNull())
    bound = saved(bound.select("class", F.least("first", F.coalesce("near", "first")).alias("bound")), "bounds")
    later = sets.select("doc_id", "h", "line", "class").join(broadcast_if_small(bound), "class").where(_place() > F.col("bound"))
    return later.groupBy("doc_id", "h").agg(F.array_sort(F.collect_set("line")).alias("lines"))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.8, least: int = 1) -> DataFrame:
    """``docs`` with matched later lines taken out of ``text``, and ``vq_lines_out``, how many those are.

    Lines are compared as sets of words and ordered by doc_id, text hash and
    line number, null ids last. A line goes if any earlier line of any
    document has a Jaccard similarity of ``threshold`` or more; lines of
    fewer than ``least`` different words always stay. Rows that share id and
    text are one row here: none is later than the other, and they stay
    alike. Null text stays null; a document that loses every line keeps its
    row with an empty text. All other columns stay, but one named
    ``vq_lines_out`` is replaced. An empty table stays empty.
    """
    lost = unused(docs, "vq_gone")
    gone = saved(later_lines(keyed(docs, doc_id, text), threshold, least), "later").withColumnRenamed("lines", lost)
    marked = joined(docs, broadcast_if_small(gone), "left", doc_id, text)
    out = F.array_join(F.filter(F.split(F.col(text), "\n"), lambda x, i: ~F.array_contains(lost, i)), "\n")
    kept = F.when(F.col(lost).isNull(), F.col(text)).otherwise(out)
    return marked.withColumn(text, kept).withColumn("vq_lines_out", F.coalesce(F.size(lost), F.lit(0)).cast("long")).drop(lost)
