"""SimHash near-duplicate detection by deletion-variant signatures.

A document's fingerprint is the bitwise majority of the XXH64 hashes of its
word shingles. Two fingerprints link when at most ``max_bits`` of 64 bits
differ. The fingerprint is cut into ``max_bits // 2 + 1`` segments, so that of
two linked fingerprints one segment differs by one bit at most; for every
segment the index holds each variant with one bit deleted. Linked
fingerprints share a variant: an equality join finds every link, and
``bit_count`` verifies it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumine.llm import words as W
from vellumine.llm.components import connected
from vellumine.llm.shared import joined, keyed, map_texts, saved, unused, with_known

U = np.uint64
_P1, _P2, _P3, _P4, _P5 = (
    U(0x9E3779B185EBCA87),
    U(0xC2B2AE3D27D4EB4F),
    U(0x165667B19E3779F9),
    U(0x85EBCA77C2B2AE63),
    U(0x27D4EB2F165667C5),
)


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << U(r)) | (x >> U(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * _P2, 31) * _P1


def xxh64(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of many byte spans of ``data`` at once.

    ``F.xxhash64`` gives the same, but each shingle would have to be a string
    of its own in Spark; here shingles are spans of one array.
    """
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    u64 = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    u32 = np.ndarray((len(data) + 1,), "<u4", padded, strides=(1,))
    length, at, seed64 = end - start, start.copy(), U(seed)
    h = np.full(len(start), seed64 + _P5, np.uint64)
    if len(long := np.flatnonzero(length >= 32)):
        seeds = np.array([seed64], np.uint64)
        acc = [np.repeat(x, len(long)) for x in (seeds + _P1 + _P2, seeds + _P2, seeds, seeds - _P1)]
        stripes, pos = length[long] // 32, start[long].copy()
        for step in range(int(stripes.max())):
            live = np.flatnonzero(stripes > step)
            for k in range(4):
                acc[k][live] = _round(acc[k][live], u64[pos[live] + 8 * k])
            pos[live] += 32
        merged = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
        for a in acc:
            merged = (merged ^ _round(np.zeros_like(a), a)) * _P1 + _P4
        h[long], at[long] = merged, pos
    h += length.astype(np.uint64)
    rest = end - at
    for step in range(3):
        if not len(live := np.flatnonzero(rest >= 8 * (step + 1))):
            break
        k = _round(np.zeros(len(live), np.uint64), u64[at[live] + 8 * step])
        h[live] = _rotl(h[live] ^ k, 27) * _P1 + _P4
    at, rest = at + rest // 8 * 8, rest % 8
    live = np.flatnonzero(rest >= 4)
    h[live] = _rotl(h[live] ^ (u32[at[live]].astype(np.uint64) * _P1), 23) * _P2 + _P3
    at[live] += 4
    rest[live] -= 4
    for step in range(3):
        live = np.flatnonzero(rest > step)
        h[live] = _rotl(h[live] ^ (padded[at[live] + step].astype(np.uint64) * _P5), 11) * _P1
    h ^= h >> U(33)
    h *= _P2
    h ^= h >> U(29)
    h *= _P3
    return h ^ (h >> U(32))


def shingles_of(texts: W.Texts, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The text number and the hash of each shingle, in order."""
    data = texts.lowered()
    start, end = W.spans(data, W.NOT_BLANK)
    owner = texts.owner(start)
    inside = W.NOT_BLANK[data]
    keep = inside.copy()
    keep[1:] |= inside[:-1]
    clean = np.where(inside, data, np.uint8(0x20))[keep]
    stop = np.cumsum(end - start + 1) - 1  # of each word in clean
    begin = stop - (end - start)
    per = W.counts(owner, texts.n)
    first = np.cumsum(per) - per
    # One shingle starts at each word but the last shingle - 1 of a text; a shorter text is one shingle.
    last_word = np.minimum(np.arange(len(start)) + shingle - 1, (first + per)[owner] - 1)
    wanted = (np.arange(len(start)) == first[owner]) | (np.arange(len(start)) + shingle <= (first + per)[owner])
    at = np.flatnonzero(wanted)
    return owner[at], xxh64(clean, begin[at], stop[last_word[at]])


def fingerprints_of(texts: W.Texts, shingle: int) -> np.ndarray:
    """The 64-bit fingerprint of each text; 0 for a text without words."""
    owner, h = shingles_of(texts, shingle)
    n = W.counts(owner, texts.n)
    out = np.zeros(texts.n, np.uint64)
    full = np.flatnonzero(n)
    if len(full):
        heads = (np.cumsum(n) - n)[full]
        for bit in range(64):
            ones = np.add.reduceat(((h >> U(bit)) & U(1)).astype(np.int64), heads)
            out[full] |= (2 * ones > n[full]).astype(np.uint64) << U(bit)
    return out


def fingerprints(rows: DataFrame, shingle: int = 4) -> DataFrame:
    """``rows`` with ``bits``, the fingerprint as a signed long, in place of ``text``."""
    return map_texts(rows, lambda texts: [fingerprints_of(texts, shingle).view(np.int64)], "bits long")


def _segments(max_bits: int) -> list[tuple[int, int]]:
    n = max_bits // 2 + 1
    cuts = [64 * k // n for k in range(n + 1)]
    return list(zip(cuts, cuts[1:]))


def _mask(a: int, b: int) -> int:
    """Bits a to b - 1, as a signed long."""
    m = (1 << b) - (1 << a)
    return m - (1 << 64) if m >> 63 else m


def variants(prints: DataFrame, max_bits: int = 4, blocks: int = 1) -> DataFrame:
    """(place, rest, more, bits): every segment of every fingerprint with one bit deleted.

    ``place`` is the deleted bit and ``rest`` the segment without it. With
    ``blocks`` over ``max_bits`` the bits outside the segment are cut into so
    many blocks and each variant is entered once for each block and its bits
    (``more``): two linked fingerprints share one of them, and chance
    meetings become rarer by the block's size.
    """
    bits, keys = F.col("bits"), []
    for a, b in _segments(max_bits):
        outside = [i for i in range(64) if not a <= i < b]
        cut = [outside[len(outside) * k // blocks : len(outside) * (k + 1) // blocks] for k in range(blocks)] if blocks > 1 else [[]]
        masks = [sum(1 << i for i in x) for x in cut]
        for place in range(a, b):
            for k, m in enumerate(masks):
                rest = bits.bitwiseAND(F.lit(_mask(a, b) & ~_mask(place, place + 1)))
                keys.append(F.struct(F.lit(place + 64 * k).cast("int").alias("place"), rest.alias("rest"), bits.bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("more")))
    return prints.select("bits", F.explode(F.array(*keys)).alias("k")).select("k.place", "k.rest", "k.more", "bits")


#: Fingerprints from which on the index also holds blocks: a variant then has 16 by chance.
MANY = 16 << 20


def links(prints: DataFrame, max_bits: int = 4, blocks: int | None = None) -> DataFrame:
    """(a, b): each pair of different fingerprints at most ``max_bits`` bits apart, a < b, once.

    ``prints`` has distinct ``bits``. A pair meets at several variants; the
    join keeps it at the first of them only. Both sides are shuffled: Spark
    guesses the index as small as the table of fingerprints, which it holds
    64 times, and would broadcast it through the driver.
    """
    if blocks is None:
        blocks = max_bits + 1 if prints.count() > MANY else 1
    index = variants(prints, max_bits, blocks)
    left, right = index.withColumnRenamed("bits", "a"), index.withColumnRenamed("bits", "b")
    x = F.col("a").bitwiseXOR(F.col("b"))
    first_place = F.lit(None).cast("int")
    for a, b in reversed(_segments(max_bits)):
        inside = x.bitwiseAND(F.lit(_mask(a, b)))
        low = F.shiftrightunsigned(inside, a)
        first_place = F.when(low == 0, F.lit(a)).when(F.bit_count(low) == 1, a + F.bit_count(low - 1)).otherwise(first_place)
    met = left.hint("merge").join(right.hint("merge"), ["place", "rest", "more"]).where((F.col("a") < F.col("b")) & (F.bit_count(x) <= max_bits))
    if blocks > 1:
        return met.select("a", "b").distinct()
    return met.where(F.col("place") == first_place).select("a", "b")


def components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (hex), component_id, n_links.

    ``component_id`` is the smallest doc_id of the documents that can be
    reached over links; ``n_links`` counts the different fingerprints linked
    to the row's own. Copies share a fingerprint and are never paired. A null
    or empty text has fingerprint zero; rows with a null doc_id get the least
    id of their component, null if it has none; repeated rows stay repeated.
    An empty table gives an empty result. No other column of ``docs`` is read.
    """
    prints = saved(fingerprints(keyed(docs, doc_id, text), shingle), "fingerprints")
    # One row for each fingerprint from here on; copies were counted in the tasks that made them.
    each = saved(prints.groupBy("bits").agg(F.count("*").alias("copies"), F.min("doc_id").alias("least")), "distinct")
    placed = each.join(_roots(each.select("bits"), max_bits), "bits", "left").withColumn("root", F.coalesce("root", "bits"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    known = saved(placed.join(least, "root").select("bits", "copies", "component_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "components")
    met = with_known(prints.select("doc_id", "bits"), known, "bits", "copies")
    return met.select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id", "n_links")


def _roots(bits: DataFrame, max_bits: int) -> DataFrame:
    """(bits, root, n_links) of each fingerprint that has links; root is the component's least fingerprint."""
    found = saved(links(bits, max_bits), "near")
    ends = found.select(F.explode(F.array("a", "b")).alias("bits")).groupBy("bits").agg(F.count("*").alias("n_links"))
    return connected(found).select(F.col("node").alias("bits"), "root").join(ends, "bits")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, max_bits: int = 4) -> DataFrame:
    """``docs`` with one row of each component: the one with the least doc_id.

    All columns stay. A null doc_id counts as larger than any other. Of rows
    that share the least id the one with the smaller text hash stays, and of
    rows that share id and text one. An empty table stays empty.
    """
    return first_of_each(docs, rooted(keyed(docs, doc_id, text), shingle, max_bits), doc_id, text)


def rooted(rows: DataFrame, shingle: int, max_bits: int) -> DataFrame:
    """(doc_id, h, root) of each row of ``keyed``; root names the component of the row's fingerprint."""
    prints = saved(fingerprints(rows, shingle), "fingerprints")
    each = saved(prints.groupBy("bits").agg(F.count("*").alias("copies")), "distinct")
    known = saved(each.join(_roots(each.select("bits"), max_bits), "bits", "left").select("bits", "copies", F.coalesce("root", "bits").alias("root")), "roots")
    return with_known(prints, known, "bits", "copies").select("doc_id", "h", "root")


def first_of_each(docs: DataFrame, rooted: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The first row of ``docs`` of each root of ``rooted`` (doc_id, h, root)."""
    first, n = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h"), unused(docs, "vq_n")
    kept = rooted.groupBy("root").agg(F.min(first).alias("first"), F.count("*").alias(n)).select("first.doc_id", "first.h", n)
    stay = joined(docs, kept, "inner", doc_id, text)
    alone = stay.where(F.col(n) == 1).drop(n)  # cannot be repeated: no second row has this root
    return alone.unionByName(_first_rows(stay.where(F.col(n) > 1).drop(n), doc_id, text))


def _first_rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Of the rows of ``docs`` that share id and text the one that is first as JSON; such rows are alike or differ elsewhere."""
    key = [F.col(doc_id).cast("long").alias("i"), F.xxhash64(F.col(text).cast("string")).alias("h")]
    row = F.struct("*")
    whole = docs.select(*key, row.alias("row"), F.to_json(row, {"ignoreNullFields": "false"}).alias("order")).groupBy("i", "h").agg(F.min_by("row", "order").alias("row"))
    return whole.select("row.*")
