"""Packing documents into sequences by order-preserving dynamic programming.

Documents in their order make one stream of token ids for each partition.
Windows of at most ``size`` ids cover it without gaps. They are cut at the
ends of documents (free) or sentences, and elsewhere only every GRID ids of a
stretch without such an end. The cuts minimise padding plus penalties: a
window is padded to ``size`` unless its length is a power of two, a cut costs
what it truncates. The padded transition takes the least of a sliding window
of costs, held by a monotone queue; the unpadded ones are the equal distances
of a power of two.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumine.llm import words as W

#: Ids that are cut at a time, so that a task's memory does not follow its partition.
STRETCH = 1 << 20
#: Ids between cuts that are possible where no sentence ends.
GRID = 64
#: Bytes of text encoded at a time; ids of cached words after which a worker begins a new cache.
SLICE_BYTES, CACHED = 2 << 20, 4 << 20
#: A word that ends a sentence; signs that end one inside a run without blanks.
ENDS, INNER = re.compile(r"[.!?…。！？][\"'”’»)\]]*$"), ("。", "！", "？")
#: The last signs of such a word.
CLOSES = frozenset(".!?…。！？\"'”’»)]")
#: Letters of ASCII.
LETTERS = W._table(lambda b: 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A)
#: What kind of cut the place after an id is.
PLAIN, SENTENCE, DOCUMENT = 0, 1, 2

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class Encoder:
    """Ids of texts, each distinct word of which is encoded once.

    For a tokenizer that joins nothing over ASCII white space, nor a run of
    letters with the sign behind it. Words are cut in both places, but not in
    front of a bar: that may be a special token's end.
    """

    def __init__(self, model: bytes, end_id: int):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.model, self.end_id = Tokenizer.from_str(model.decode()), end_id
        self.inner = np.array([i for sign in INNER for i in self.model.encode(sign, add_special_tokens=False).ids[-1:]], np.int32)
        self._forget()

    def _forget(self) -> None:
        self.known, self.starts, self.sizes, self.total = {b"\n": 0}, np.zeros(1, np.int32), np.ones(1, np.int32), 1
        self.flat, self.ends = np.array([self.end_id], np.int32), np.array([DOCUMENT], np.uint8)  # entry 0: a line end stands for a document's

    def _learn(self, new: list[bytes]) -> None:
        texts, ids, sizes = [w.decode() for w in new], [], []
        for found in self.model.encode_batch_fast(texts, add_special_tokens=False):
            own = found.ids
            ids += own
            sizes.append(len(own))
        self.known.update(zip(new, range(len(self.sizes), len(self.sizes) + len(new))))
        upto = self.total + np.cumsum(sizes)
        ids = np.array(ids, np.int32)
        kinds = np.isin(ids, self.inner).astype(np.uint8)
        ends = np.array([n > 0 and t[-1] in CLOSES and ENDS.search(t) is not None for n, t in zip(sizes, texts)])
        kinds[upto[ends] - 1 - self.total] = SENTENCE
        self.starts = np.concatenate([self.starts, (upto - sizes).astype(np.int32)])
        self.sizes = np.concatenate([self.sizes, np.array(sizes, np.int32)])
        self.flat, self.ends, self.total = np.concatenate([self.flat, ids]), np.concatenate([self.ends, kinds]), int(upto[-1])

    def encode(self, texts: W.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts in turn, each with its end; the kind of the place after each id; how many ids each text has."""
        if self.total > CACHED:
            self._forget()
        data, ends = texts.data, texts.start[1:] - 1
        inside, letter = W.looked_up(data, W.NOT_BLANK).view(bool).copy(), W.looked_up(data, LETTERS).view(bool)
        inside[ends] = True  # the line end behind each text is a word of its own
        cut = inside.copy()  # where a word begins
        cut[1:] &= ~inside[:-1] | (letter[:-1] & ~letter[1:] & (data[1:] < 0x80) & (data[1:] != 0x7C))
        cut[ends], cut[ends[:-1] + 1] = True, inside[ends[:-1] + 1]
        start = np.flatnonzero(cut)
        length = np.add.reduceat(inside, start, dtype=np.int64)
        cuts = np.concatenate([[0], np.cumsum(length)])
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(cuts), pa.py_buffer(data[inside])]).dictionary_encode()
        _, offsets, packed = coded.dictionary.buffers()
        upto = np.frombuffer(offsets, np.int64)[: len(coded.dictionary) + 1].tolist()
        packed, known = packed.to_pybytes(), self.known
        terms = [packed[a:b] for a, b in zip(upto, upto[1:])]
        numbers = [known.get(w, -1) for w in terms]
        if -1 in numbers:
            self._learn([w for w, k in zip(terms, numbers) if k < 0])
            numbers = [known[w] for w in terms]
        entry = np.array(numbers, np.int32)[coded.indices.to_numpy()]
        lines = np.cumsum(data == 10, dtype=np.int32)
        broken = lines[start[1:] - 1] > lines[start[:-1] + length[:-1] - 1]
        sizes = self.sizes[entry]
        upto = np.cumsum(sizes)  # a slice has fewer ids than bytes and ends
        places = np.arange(upto[-1], dtype=np.int32) + np.repeat(self.starts[entry] - (upto - sizes).astype(np.int32), sizes)
        ids, kinds = self.flat[places], self.ends[places]
        at_end = upto[:-1][broken & (sizes[:-1] > 0) & (entry[:-1] > 0)] - 1
        kinds[at_end] = np.maximum(kinds[at_end], SENTENCE)
        return ids, kinds, np.diff(upto[entry == 0], prepend=0)


_encoders: dict[int, Encoder] = {}


def _encoder(model: bytes, end_id: int) -> Encoder:
    """The encoder of a tokenizer's file, built once in a worker process."""
    key = hash((model, end_id))
    if key not in _encoders:
        _encoders[key] = Encoder(model, end_id)
    return _encoders[key]


def candidates(kinds: np.ndarray, costs: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Places of possible cuts, from 0 to the length of the stream, and what each costs; ``costs``: at a sentence's end, elsewhere."""
    natural = np.flatnonzero(kinds) + 1
    natural = np.concatenate([[0], natural, [len(kinds)]] if not len(natural) or natural[-1] != len(kinds) else [[0], natural])
    gap = np.diff(natural)
    more = (gap - 1) // GRID
    grid = np.repeat(natural[:-1], more) + GRID * (np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1)
    places = np.concatenate([natural, grid])
    cost = np.concatenate([np.where(np.append(DOCUMENT, kinds)[natural] == DOCUMENT, 0, costs[0]), np.full(len(grid), costs[1])])
    cost[len(natural) - 1] = 0  # the end of the stream
    order = np.argsort(places, kind="stable")
    return places[order], cost[order]


def least_cost(places: np.ndarray, cost: np.ndarray, size: int, per_window: int) -> tuple[list[int], list[int]]:
    """For each candidate the least cost of windows that end there, and the candidate before.

    A window from i to j costs ``per_window``, the cut at j and the padding.
    Padded: f(i) + size - (j - i), so the least f(i) + i among the i that are
    at most ``size`` back; a queue keeps those that can still be the least,
    rising. Unpadded: j - i is a power of two.
    """
    met_j, met_i = [], []
    for k in range(size.bit_length()):
        at = np.searchsorted(places, places - (1 << k))
        hit = np.flatnonzero((places >= 1 << k) & (places[np.minimum(at, len(places) - 1)] == places - (1 << k)))
        met_j.append(hit)
        met_i.append(at[hit])
    met_j, met_i = np.concatenate(met_j), np.concatenate(met_i)
    order = np.argsort(met_j, kind="stable")
    upto = np.searchsorted(met_j[order], np.arange(len(places) + 1)).tolist()
    exact, x, c = met_i[order].tolist(), places.tolist(), cost.tolist()
    f, g, back, queue = [0] * len(x), [0] * len(x), [0] * len(x), [0]
    head = 0
    for j in range(1, len(x)):
        p = x[j]
        while x[queue[head]] < p - size:
            head += 1
        i = queue[head]
        best = g[i] + size - p
        if upto[j] != upto[j + 1]:
            for e in exact[upto[j] : upto[j + 1]]:
                if f[e] < best:
                    best, i = f[e], e
        best += per_window + c[j]
        f[j], back[j] = best, i
        g[j] = value = best + p
        while len(queue) > head and g[queue[-1]] > value:
            queue.pop()
        queue.append(j)
    return f, back


def windows(kinds: np.ndarray, size: int, costs: tuple[int, int], per_window: int, final: bool) -> np.ndarray:
    """The ends of the windows of a stream; unless ``final``, up to its cheapest cut within the last ``size`` ids."""
    places, cost = candidates(kinds, costs)
    f, back = least_cost(places, cost, size, per_window)
    j = len(places) - 1
    if not final:
        j = min(range(int(np.searchsorted(places, len(kinds) - size)), len(places) - 1), key=lambda k: (f[k], -k))
    out = []
    while j:
        out.append(places[j])
        j = back[j]
    return np.array(out[::-1], np.int64)


class Packer:
    """Packs a stream of documents, a stretch at a time; yields batches of pieces."""

    def __init__(self, size: int, costs: tuple[int, int], per_window: int, first: int):
        self.size, self.costs, self.per_window, self.sequence = size, costs, per_window, first
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.docs: list[tuple[int | None, int, int]] = []  # doc_id, all its ids, how many of them went before
        self.n = 0

    def add(self, doc_ids: list, ids: np.ndarray, kinds: np.ndarray, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append((ids, kinds))
        self.docs += [(d, n, 0) for d, n in zip(doc_ids, sizes.tolist())]
        self.n += len(ids)
        if self.n >= STRETCH:
            yield from self.flush(False)

    def flush(self, final: bool = True) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        ids, kinds = (np.concatenate([h[k] for h in self.held]) for k in (0, 1))
        ends = windows(kinds, self.size, self.costs, self.per_window, final)
        left = np.array([n - before for _, n, before in self.docs], np.int64)
        doc_ends, total = np.cumsum(left), int(ends[-1])
        cuts = np.unique(np.concatenate([ends, doc_ends[doc_ends <= total]]))
        start = np.concatenate([[0], cuts[:-1]])
        doc, window = np.searchsorted(doc_ends, start, side="right"), np.searchsorted(ends, start, side="right")
        window_start, before = np.concatenate([[0], ends[:-1]]), np.array([b for _, _, b in self.docs], np.int64)
        columns = [
            [self.docs[d][0] for d in doc.tolist()],
            start - (doc_ends - left)[doc] + before[doc],
            cuts - start,
            None,
            np.array([n for _, n, _ in self.docs], np.int64)[doc],
            self.sequence + window,
            start - window_start[window],
        ]
        data, names = ids.astype("<u4"), [c.split()[0] for c in PIECES.split(", ")]
        for a in range(0, len(cuts), 4096):
            b = min(a + 4096, len(cuts))
            offsets = (4 * np.append(start[a:b], cuts[b - 1]) - 4 * start[a]).astype(np.int32)
            of_ids = pa.BinaryArray.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(offsets), pa.py_buffer(data[start[a] : cuts[b - 1]])])
            yield pa.RecordBatch.from_arrays([of_ids if c is None else pa.array(c[a:b], pa.int64()) for c in columns], names)
        self.sequence += len(ends)
        d = int(np.searchsorted(doc_ends, total, side="right"))
        self.held, self.n = [(ids[total:], kinds[total:])], len(ids) - total
        self.docs = self.docs[d:]
        if self.docs and (gone := total - int(doc_ends[d] - left[d])):
            self.docs[0] = (*self.docs[0][:2], self.docs[0][2] + gone)


def pack(
    docs: DataFrame,
    tokenizer: str,
    order: tuple[str, ...] = ("doc_id",),
    end_id: int = 2,
    size: int = 4096,
    sentence_cost: int = 16,
    inner_cost: int = 64,
    sequence_cost: int = 32,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """The pieces of all documents: doc_id, start (its document's ids before it), length, ids, doc_tokens, sequence_id, offset.

    ``ids`` are unsigned 32-bit numbers, little-endian. A document's ids are
    the tokenizer's without special ones, then ``end_id``; each stands in
    exactly one piece. Documents are dealt out by ranges of ``order`` and keep
    this order (nulls first) in and across the sequences of a range; rows that
    ``order`` does not tell apart follow in the order of their text's hash.
    Penalties count in ids of padding: a cut at a sentence's end costs
    ``sentence_cost``, elsewhere ``inner_cost``, a sequence ``sequence_cost``.
    Cuts are optimal in stretches of STRETCH ids, joined at a cheapest cut.

    Null and empty texts have the end's id alone; repeated rows are packed
    each; a long text goes over many sequences; a null id stays null. Other
    columns are not read. An empty table gives an empty result.
    """
    if not 1 <= GRID <= size < 1 << 24:
        raise ValueError("size has to be from 64 to 2**24 - 1")
    with open(tokenizer, "rb") as f:  # read on the driver, a vocabulary of fixed size
        sent = docs.sparkSession.sparkContext.broadcast(f.read())
    body = F.col(f"`{text}`").cast("string")
    keys = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(order)]
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), body.alias("text"), *keys, F.xxhash64(body).alias("h"), F.monotonically_increasing_id().alias("row"))
    by = [*(f"k{i}" for i in range(len(order))), "h", "row"]

    def of_batches(batches):
        encoder = _encoder(sent.value, end_id)
        packer = Packer(size, (sentence_cost, inner_cost), sequence_cost, TaskContext.get().partitionId() << 36)
        for batch in batches:
            for part in W.slices(batch, "text", SLICE_BYTES):
                yield from packer.add(part.column("doc_id").to_pylist(), *encoder.encode(W.Texts(part.column("text"))))
        yield from packer.flush()
        W.release()

    return rows.repartitionByRange(*by).sortWithinPartitions(*by).select("doc_id", "text").mapInArrow(of_batches, PIECES)
