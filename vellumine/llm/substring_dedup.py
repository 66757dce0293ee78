"""Substring deduplication by content-defined chunking.

A gear rolling hash runs over a text's bytes; a cut falls where the hash of
the bytes just before is the largest of its neighbourhood. Cuts depend on the
bytes around them only, so they return with a repeated passage wherever it
stands and whatever was inserted before it. Where a few bytes repeat on and
on, no hash is the largest; there cuts fall at fixed steps from where that
begins, and where it ends. Chunks are deduplicated by the
digest of a chunk and its successor; runs of repeated chunks are the repeated
passages, and all but the first of each goes.

Pass 1 counts 64-bit digests and keeps a bitmap of fixed size of those that
occur again; pass 2 lists the chunks that the bitmap lets through with their
places and settles them by 128-bit digest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumine.llm import words as W
from vellumine.llm.shared import RUNS, broadcast_if_small, joined, keyed, merged_runs, saved

U = W.U
#: Bytes that the gear hash sees, and how far around a cut its hash is the largest.
SIGHT = REACH = 16
#: Bits of the bitmap of repeated digests.
BITMAP = 1 << 27
_GEAR = np.random.default_rng(31).integers(0, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)
_LEAD = (np.arange(256) & 0xC0) != 0x80


def gear(data: np.ndarray) -> np.ndarray:
    """The gear hash of the SIGHT bytes up to each byte: sum of code << age, by doubling."""
    h, width = _GEAR[data], 1
    while width < SIGHT:
        nearer = h.copy()
        nearer[width:] += h[:-width] << np.uint32(width)
        h, width = nearer, 2 * width
    return h


def _highest(h: np.ndarray, n: int) -> np.ndarray:
    """The maximum of each n consecutive entries, n a power of two; zeros follow the end."""
    width = 1
    while width < n:
        out = h.copy()
        np.maximum(out[:-width], h[width:], out=out[:-width])
        h, width = out, 2 * width
    return h


#: A stretch with a period of up to SIGHT bytes counts from so many bytes on; bytes between its cuts.
STRETCH, STEP = 48, 64


def periodic_cuts(data: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places to cut in stretches that repeat 1 to SIGHT bytes: each STEP bytes from their start, and their end.

    Beside them each one's number in its stretch (0 for the ends), which is
    part of a chunk's digest: a stretch is no repeat of itself. ``start`` are
    the places where texts begin; no stretch crosses them.
    """
    taken, cuts, numbers = np.zeros(len(data), bool), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for period in range(1, min(SIGHT, len(data) - 1) + 1):
        same = np.zeros(len(data) - period + 2, bool)
        same[1:-1] = (data[period:] == data[:-period]) & ~taken[period:]
        head = (start[:, None] + np.arange(period)).ravel() - period
        same[1 + head[(head >= 0) & (head < len(data) - period)]] = False
        edge = np.flatnonzero(same[1:] != same[:-1])
        begin, end = edge[::2], edge[1::2]
        long = end - begin >= STRETCH
        for a, b in zip(begin[long].tolist(), end[long].tolist()):  # data[a:b + period] has the period
            taken[a : b + period] = True
            cuts.append(np.append(np.arange(a, b + period, STEP), b + period))
            numbers.append(np.append(np.arange(len(cuts[-1]) - 1), 0))
    return np.concatenate(cuts), np.concatenate(numbers)


class Chunks:
    """The chunks of some texts: bounds in bytes and code points, owner, number."""

    def __init__(self, texts: W.Texts):
        data, start = texts.data, texts.start
        h = gear(data)
        size = len(data)
        lead = _LEAD[data]
        # A cut before byte i goes by the bytes before it; those of another text never count.
        before = np.zeros(size, np.uint32)
        before[1:] = h[:-1]
        before[~lead] = 0
        head = start[:-1][:, None] + np.arange(SIGHT)
        before[np.minimum(head, np.maximum(start[1:, None] - 1, 0)).ravel()] = 0
        before[start[1:] - 1] = 0
        padded = np.concatenate([np.zeros(REACH, np.uint32), before, np.zeros(REACH + 1, np.uint32)])
        top = _highest(padded, REACH)
        left, right = top[:size], top[REACH + 1 : REACH + 1 + size]
        cut = np.flatnonzero((before > left) & (before >= right))
        full = np.flatnonzero(start[1:] - 1 > start[:-1])
        extra, number = periodic_cuts(data, start)
        extra, number = extra[extra < size], number[extra < size]
        while len(back := np.flatnonzero(~lead[extra])):  # to where a code point begins
            extra[back] -= 1
        inside = ~np.isin(extra, start[1:] - 1)
        extra, number = extra[inside], number[inside]
        self.begin = np.unique(np.concatenate([start[:-1][full], cut, extra]))
        self.owner = texts.owner(self.begin)
        last = np.ones(len(self.begin), bool)
        last[:-1] = self.owner[1:] != self.owner[:-1]
        self.end = np.empty_like(self.begin)
        self.end[:-1] = self.begin[1:]
        self.end[last] = start[1:][self.owner[last]] - 1
        self.last = last
        per = W.counts(self.owner, texts.n)
        self.number = np.arange(len(self.begin)) - (np.cumsum(per) - per)[self.owner]
        points = np.concatenate([[0], np.cumsum(lead)])
        self.point = points[self.begin] - points[start[:-1][self.owner]]
        self.points = points[self.end] - points[self.begin]
        self.digest = W.span_hashes(data, self.begin, self.end)
        at = np.searchsorted(self.begin, extra[number > 0])
        self.digest[at] = W.mix(self.digest[at] + number[number > 0].astype(np.uint64) * U(0xD6E8FEB86659FD93))

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Chunks that have a successor, and two digests of both."""
        at = np.flatnonzero(~self.last)
        a, b = self.digest[at], self.digest[at + 1]
        one = W.mix(a * U(0x9E3779B97F4A7C15) + b)
        return at, one, W.mix((a ^ U(0x5851F42D4C957F2D)) * U(0xD1342543DE82EF95) + W.mix(b))


def _repeated(rows: DataFrame) -> np.ndarray:
    """A bitmap of the digests that occur more than once, as bytes; summed up by Spark."""

    def of_batches(batches):
        for batch in batches:
            for part in W.slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([pa.array(Chunks(W.Texts(part.column("text"))).pairs()[1].view(np.int64))], ["digest"])

    again = rows.select("text").mapInArrow(of_batches, "digest long").groupBy("digest").count().where("count > 1")
    bit = F.col("digest").bitwiseAND(BITMAP - 1)
    word = F.shiftright(bit, 15)
    maps = again.groupBy(word.alias("part")).agg(F.bitmap_construct_agg(bit.bitwiseAND(32767)).alias("bits"))
    out = np.zeros(BITMAP // 8, np.uint8)
    for r in maps.toLocalIterator():  # BITMAP / 32768 rows of 4 KB at most
        out[r["part"] * 4096 : (r["part"] + 1) * 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def _occurrences(rows: DataFrame) -> DataFrame:
    """(doc_id, h, chunk, point, points, next, d0, d1) of the chunks whose digest may occur again."""
    sent = rows.sparkSession.sparkContext.broadcast(_repeated(rows))

    def of_batches(batches):
        bitmap = sent.value
        for batch in batches:
            for part in W.slices(batch, "text"):
                chunks = Chunks(W.Texts(part.column("text")))
                at, one, two = chunks.pairs()
                bit = (one & U(BITMAP - 1)).astype(np.int64)
                maybe = (bitmap[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
                at, owner = at[maybe], pa.array(chunks.owner[at[maybe]])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(owner), part.column("h").take(owner), pa.array(chunks.number[at]), pa.array(chunks.point[at]),
                        pa.array(chunks.points[at]), pa.array(chunks.points[at + 1]), pa.array(one[maybe].view(np.int64)), pa.array(two[maybe].view(np.int64)),
                    ],
                    ["doc_id", "h", "chunk", "point", "points", "next", "d0", "d1"],
                )

    return rows.mapInArrow(of_batches, "doc_id long, h long, chunk long, point long, points long, next long, d0 long, d1 long")


def _place() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h", "chunk")


def repeats(rows: DataFrame, least: int = 80) -> DataFrame:
    """(doc_id, h, spans, first_ids): the repeated passages of each row of ``keyed`` that has any.

    ``spans`` are (a, b) in code points, in order, each of ``least`` at least
    or the whole text; ``first_ids`` the ids of the documents that hold the
    first copies.
    """
    found = saved(_occurrences(rows), "chunks")
    firsts = found.groupBy("d0", "d1").agg(F.min(_place()).alias("first"), F.max(_place()).alias("last")).where("first < last").drop("last")
    firsts = saved(firsts, "firsts")
    later = found.join(broadcast_if_small(firsts), ["d0", "d1"]).where(_place() > F.col("first"))
    # A repeated digest covers its chunk and the next.
    pieces = later.select("doc_id", "h", F.col("point").alias("a"), (F.col("point") + F.col("points") + F.col("next")).alias("b"), F.col("first.doc_id").alias("first_id"), F.lit(False).alias("whole"))
    # Copies of a whole text, however short, are settled by its own digest.
    size = F.length("text").cast("long")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")
    texts = rows.where("text <> ''").select("h", "doc_id", size.alias("size"))
    first = texts.groupBy("h", "size").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first < last").select(F.col("h").alias("g"), F.col("size").alias("n"), "first")
    met = texts.join(broadcast_if_small(saved(first, "copies")), (F.col("h") == F.col("g")) & (F.col("size") == F.col("n"))).where(place > F.col("first"))
    copies = met.select("doc_id", "h", F.lit(0).cast("long").alias("a"), F.col("size").alias("b"), F.col("first.doc_id").alias("first_id"), F.lit(True).alias("whole"))
    each = pieces.unionByName(copies).groupBy("doc_id", "h")
    grouped = each.agg(F.collect_set(F.struct("a", "b")).alias("pieces"), F.array_sort(F.collect_set("first_id")).alias("first_ids"), F.max("whole").alias("whole"))
    spans = F.filter(merged_runs(F.col("pieces")), lambda x: F.col("whole") | (x["b"] - x["a"] >= least))
    return grouped.select("doc_id", "h", spans.alias("spans"), "first_ids").where("size(spans) > 0")


def dedup_substrings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 80) -> DataFrame:
    """``docs`` with repeated passages taken out of ``text``; vq_spans and vq_first_ids tell which.

    Of all copies of a passage the one in the row with the least doc_id (then
    text hash, then place; null ids last) stays. A passage is a run of
    repeated chunks of ``least`` code points or more, or a whole text of any
    length; a run begins and ends at a cut, so that a repeat may keep a few
    bytes at either end, and one of under about 150 bytes may be missed. Rows
    that share id and text are one row here and stay alike. Null text stays
    null; a text that goes whole leaves an empty one; both lists are empty
    where nothing went. All other columns stay, but those named ``vq_spans``
    and ``vq_first_ids`` are replaced. An empty table stays empty.
    """
    docs = docs.drop("vq_spans", "vq_first_ids")
    found = saved(repeats(keyed(docs, doc_id, text), least), "passages")
    marked = joined(docs, broadcast_if_small(found.withColumnsRenamed({"spans": "vq_spans", "first_ids": "vq_first_ids"})), "left", doc_id, text)
    whole = F.col(text)
    start = F.struct(F.lit("").alias("kept"), F.lit(0).cast("long").alias("at"))
    rest = F.aggregate("vq_spans", start, lambda s, x: F.struct(F.concat(s["kept"], whole.substr((s["at"] + 1).cast("int"), (x["a"] - s["at"]).cast("int"))).alias("kept"), x["b"].alias("at")))
    out = F.concat(rest["kept"], whole.substr((rest["at"] + 1).cast("int"), F.length(whole)))
    return marked.withColumns(
        {
            text: F.when(F.col("vq_spans").isNull(), whole).otherwise(out),
            "vq_spans": F.coalesce("vq_spans", F.array().cast(RUNS)),
            "vq_first_ids": F.coalesce("vq_first_ids", F.array().cast("array<bigint>")),
        }
    )
