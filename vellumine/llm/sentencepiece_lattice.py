"""SentencePiece encoding and decoding by a relational lattice of subwords.

Texts are cut into words where no piece of the vocabulary can cross. For the
distinct words of the corpus every substring of bounded length is exploded
and equality-joined to the piece table; the edges of a word are grouped and
folded by a higher-order aggregate into the word's pieces. Documents then
look their words up.

The fold follows the model's kind. A unigram model's is Viterbi: the path
with the highest sum of scores. The model file here is a BPE model, whose
encoder merges the best-ranked neighbours until none merge, and a best path
over its scores gives other pieces. So for it the fold applies merges: its
state holds the boundaries in the word as bits, and an edge over two symbols
clears the boundary between them.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.llm import words as W
from vellumine.llm.shared import joined, keyed, saved

#: The model file; read on the driver.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Stands for a space in pieces; a fixed value of the format.
SPACE = "▁"
#: Bytes of the words' pieces that are broadcast to the documents, those of the most frequent words.
HEAD_BYTES = 96_000_000
#: What an unknown character costs on a best path beside the least score; a fixed value of the format.
UNKNOWN_PENALTY = 10.0

#: Bytes of text and distinct words that a task works on at a time; they bound its memory.
SLICE_BYTES, TASK_WORDS = 500_000, 300_000

#: Times the usual number of partitions that the words are dealt out to.
FINER = 4

U = W.U


@dataclass(frozen=True)
class Model:
    """What encoding and decoding need of a model file."""

    #: (piece, id, rank, reopens, score) of the normal pieces. Rank 0 is merged first. ``reopens``: a
    #: better-ranked piece begins or ends with this one, so making it can open a better merge.
    pieces: list[tuple[str, int, int, bool, float]]
    #: The id of byte 0 (the other bytes follow), or None if the model has no byte pieces.
    first_byte: int | None
    unknown: int
    #: Whether the best path by scores is asked for (a unigram model) and not merges (BPE).
    unigram: bool

    @property
    def longest(self) -> int:
        return max(len(p[0]) for p in self.pieces)


def model_of(scored: list[tuple[str, int, float]], first_byte: int | None, unknown: int, unigram: bool) -> Model:
    """A model from (piece, id, score) of its normal pieces."""
    ranked = sorted(scored, key=lambda x: (-x[2], x[1]))
    rank = {p: k for k, (p, _, _) in enumerate(ranked)}
    reopens = set()
    for piece, k in rank.items():
        for cut in range(1, len(piece)):
            reopens.update(part for part in (piece[:cut], piece[cut:]) if rank.get(part, -1) > k)
    return Model([(p, i, rank[p], p in reopens, score) for p, i, score in ranked], first_byte, unknown, unigram)


@lru_cache(maxsize=4)
def load(path: str = MODEL, unigram: bool = False) -> Model:
    """The model of a file; ``unigram`` says of which kind it is."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    normal = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    byte = [i for i in ids if model.is_byte(i)]
    return model_of([(model.id_to_piece(i), i, model.get_score(i)) for i in normal], min(byte, default=None), model.unk_id(), unigram)


def piece_table(spark: SparkSession, model: Model) -> DataFrame:
    """(piece, id, rank, reopens, score): the model's normal pieces, a table of fixed size."""
    return spark.createDataFrame(model.pieces, "piece string, id int, rank int, reopens boolean, score double")


class Cutter:
    """Where words begin: between two characters that stand side by side in no piece."""

    def __init__(self, pieces: list[str]):
        pairs = {(ord(a), ord(b)) for p in pieces for a, b in zip(p, p[1:])}
        letters = sorted({c for pair in pairs for c in pair})
        self.kind = np.zeros(0x110000, np.uint32)
        self.kind[letters] = np.arange(1, len(letters) + 1)
        self.within = np.zeros((len(letters) + 1, len(letters) + 1), bool)
        a, b = np.array(sorted(pairs)).T
        self.within[self.kind[a], self.kind[b]] = True

    def words(self, texts: W.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Code points, with a space symbol before each text, and each word's start, end and text."""
        whole = np.frombuffer(texts.data.tobytes().decode().encode("utf-32-le"), np.uint32)
        lead = np.concatenate([[0], np.cumsum((texts.data & 0xC0) != 0x80)])
        bounds = lead[texts.start]
        points = np.concatenate([[0x20], whole[:-1]]).astype(np.uint32) if len(whole) else whole
        points[bounds[:-1]] = 0x20
        points = np.where(points == 0x20, np.uint32(ord(SPACE)), points)
        kind = self.kind[points]
        begins = np.ones(len(points), bool)
        if len(points):
            begins[1:] = ~self.within[kind[:-1], kind[1:]]
            begins[bounds[:-1]] = True
        start = np.flatnonzero(begins)
        end = np.append(start[1:], len(points))
        owner = np.searchsorted(bounds, start, side="right") - 1
        some = (np.diff(bounds) > 1)[owner] if texts.n else np.zeros(0, bool)  # an empty text has no words
        return points, start[some], end[some], owner[some]


_FACTORS = np.random.default_rng(5).integers(0, 1 << 63, 4, dtype=np.uint64) * U(2) + U(1)


def word_hashes(points: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of code points."""
    power, inverse = W._power_tables(len(points) + 1)
    total = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(W.mix(points.astype(np.uint64) + U(1)) * power[:-1], out=total[1:])
    return W.mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64) * _FACTORS[0])


def _spelled(points: np.ndarray, start: np.ndarray) -> pa.Array:
    """The spans of code points that begin at ``start`` and end where the next begins, the last at the end, as strings."""
    size = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
    offsets = np.concatenate([[0], np.cumsum(size, dtype=np.int32)]).astype(np.int32)
    text = points.tobytes().decode("utf-32-le").encode()
    return pa.StringArray.from_buffers(len(start), pa.py_buffer(np.append(offsets[start], offsets[-1]).tobytes()), pa.py_buffer(text))


def distinct_words(rows: DataFrame, model: Model) -> DataFrame:
    """(word, n, hash): the words of the corpus, how often they occur and their hash; counted in tasks, summed by Spark."""
    pieces = [p[0] for p in model.pieces]

    def of_batches(batches):
        cutter, held = Cutter(pieces), []
        for batch in batches:
            for part in W.slices(batch, "text", SLICE_BYTES):
                points, start, end, _ = cutter.words(W.Texts(part.column("text")))
                if not len(start):
                    continue
                hashes, first, n = np.unique(word_hashes(points, start, end), return_index=True, return_counts=True)
                held.append((hashes, n, _spans(points, start[first], end[first])))
                if sum(len(h[0]) for h in held) > TASK_WORDS:
                    held = [_summed(held)]
                    if len(held[0][0]) > TASK_WORDS // 2:  # Spark adds the parts up
                        yield _counts(held)
                        held = []
        yield _counts(held)
        del cutter, held
        W.release()

    counted = rows.select("text").mapInArrow(of_batches, "word string, n long, hash long")
    # Dealt out by hash, as the edges are grouped later; tasks have counted already. A word has some thirty edges, which
    # are sorted where it is: more partitions than usual keep what a task sorts in memory.
    parts = FINER * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return counted.repartition(parts, "hash").groupBy("hash", "word").agg(F.sum("n").alias("n"))


def _spans(points: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """Spans of code points, in any order, as strings."""
    order = np.argsort(start)
    edges = np.stack([start[order], end[order]], 1).ravel()  # spans and the gaps between them
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order)) * 2
    return _spelled(points, edges).take(pa.array(back))


def _summed(held: list) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    hashes, n = (np.concatenate([h[k] for h in held]) for k in (0, 1))
    hashes, first, back = np.unique(hashes, return_index=True, return_inverse=True)
    return hashes, np.bincount(back, weights=n).astype(np.int64), pa.concat_arrays([h[2] for h in held]).take(pa.array(first))


def _counts(held: list) -> pa.RecordBatch:
    hashes, n, words = _summed(held) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64), pa.array([], pa.string()))
    return pa.RecordBatch.from_arrays([words, pa.array(n), pa.array(hashes.view(np.int64))], ["word", "n", "hash"])


#: Characters whose boundaries are the bits of one long.
WINDOW = 60


def lattice(words: DataFrame, pieces: DataFrame, longest: int, by_end: bool = False) -> DataFrame:
    """(n, hash, size, edges) of ``words``: its characters, and the pieces inside it, an array of structs.

    s is a piece's place from 0 and e its end. A single character is an edge
    even if it is no piece; then id is null and ``raw`` its bytes in hex.
    Sorted by rank, then from the left, or else ``by_end``. Substrings are
    taken from parts of a word, so no row carries a long word; they never
    leave their partition: the piece table is broadcast and words are grouped
    where they are.
    """
    size, block = F.length("word"), F.lit(WINDOW)
    cut = F.transform(F.sequence(F.lit(0), size - 1, block), lambda a: F.struct(a.alias("a"), F.col("word").substr(a + 1, block + longest - 1).alias("part")))
    blocks = words.select("n", "hash", size.alias("size"), F.explode(F.when(size > 0, cut)).alias("b"))
    begins = F.sequence(F.lit(0), F.least(block, F.length("b.part")) - 1)
    places = F.transform(begins, lambda s: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("b.part") - s)), lambda m: F.struct(s.alias("s"), m.alias("m"))))
    parts = blocks.select("n", "hash", "size", "b", F.explode(F.flatten(places)).alias("x"))
    s = F.col("b.a") + F.col("x.s")
    parts = parts.select("n", "hash", "size", s.alias("s"), (s + F.col("x.m")).alias("e"), F.col("b.part").substr(F.col("x.s") + 1, F.col("x.m")).alias("piece"))
    edges = parts.join(F.broadcast(pieces), "piece", "left").where("id IS NOT NULL OR e = s + 1")
    order = ["e", "s"] if by_end else [F.coalesce("rank", F.lit(1 << 30)).alias("rank"), "s", "e"]
    raw = F.when(F.col("id").isNull(), F.hex(F.encode("piece", "UTF-8"))).alias("raw")
    edge = F.struct(*order, "id", "score" if by_end else "reopens", raw)
    return edges.groupBy("n", "hash", "size").agg(F.array_sort(F.collect_list(edge)).alias("edges"))


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), i)


def _merged(edges: Column, n: Column, at: Column) -> Column:
    """The boundaries left in n characters from place ``at`` when all merges are made; bit 0 is ``at``.

    ``edges`` are pieces of two characters or more inside, by rank. An edge
    merges two symbols if its ends are boundaries and one is between. A sweep
    over the edges by rank merges all it can, but stops where a merge opens a
    better-ranked one; the next sweep goes on from the best edge again.
    """

    def merges(flags: Column, e: Column) -> Column:
        a, b = _bit(e["s"] - at), _bit(e["e"] - at)
        return (flags.bitwiseAND(a.bitwiseOR(b)) == a.bitwiseOR(b)) & (F.bit_count(flags.bitwiseAND(b - a)) == 2)

    def sweep(s: Column, e: Column) -> Column:
        now = s["flags"].bitwiseAND(F.bitwise_not(_bit(e["e"] - at) - 2 * _bit(e["s"] - at)))
        stop = e["reopens"] & F.exists(edges, lambda b: (b["rank"] < e["rank"]) & merges(now, b))
        return F.when(~s["stop"] & merges(s["flags"], e), F.struct(now.alias("flags"), stop.alias("stop"))).otherwise(s)

    def again(s: Column, _: Column) -> Column:
        return F.when(s["stop"], F.aggregate(edges, F.struct(s["flags"].alias("flags"), F.lit(False).alias("stop")), sweep)).otherwise(s)

    # Every stop has an edge of its own that reopens, so there are no more sweeps than those and one.
    sweeps = F.sequence(F.lit(0), F.size(F.filter(edges, lambda e: e["reopens"])))
    none = F.struct((2 * _bit(n) - 1).alias("flags"), F.lit(True).alias("stop"))
    return F.aggregate(sweeps, none, again, lambda s: s["flags"])


def _kept(flags: Column, at: Column):
    """Whether an edge's ends are neighbours among the boundaries: the word's pieces."""

    def neighbours(e: Column) -> Column:
        a, b = _bit(e["s"] - at), _bit(e["e"] - at)
        return flags.bitwiseAND(2 * b - a) == a.bitwiseOR(b)

    return neighbours


def _path(e: Column) -> Column:
    return F.struct(e["s"].alias("s"), e["e"].alias("e"), e["id"].alias("id"), e["raw"].alias("raw"))


def _merges(e: Column) -> Column:
    return F.struct(e["rank"].alias("rank"), e["s"].alias("s"), e["e"].alias("e"), e["reopens"].alias("reopens"))


def _pieces_of_short(edges: Column, n: Column) -> Column:
    """The pieces, in order, of a word of up to WINDOW characters."""
    zero = F.lit(0)
    flags = _let(F.transform(F.filter(edges, lambda e: e["e"] > e["s"] + 1), _merges), lambda many: _merged(many, n, zero))
    return _let(flags, lambda f: F.array_sort(F.transform(F.filter(edges, _kept(f, zero)), _path)))


def _pieces_of_long(edges: Column, n: Column, longest: int) -> Column:
    """The pieces, in order, of a long word, merged window by window; null if that can't settle them.

    Of a window's pieces those that begin before about its middle stand; the
    next window begins where they end. No merge crossed that boundary, so the
    next window's first piece is the one seen here unless what follows the
    window changes it. If it is the same, each two neighbours of the whole
    are merged as they would be alone, and such a whole is what merging all
    of it gives.
    """
    half = WINDOW // 2
    path_type = "array<array<struct<s:int,e:int,id:int,raw:string>>>"

    def of_placed(placed: Column) -> Column:
        def count(s: Column, e: Column) -> Column:  # every half window begins with an edge
            now = F.when(F.floor(e["s"] / half) >= F.size(s["offsets"]), F.concat(s["offsets"], F.array(s["i"]))).otherwise(s["offsets"])
            return F.struct((s["i"] + 1).alias("i"), now.alias("offsets"))

        none = F.struct(F.lit(0).alias("i"), F.array().cast("array<int>").alias("offsets"))
        offsets = F.aggregate(placed, none, count, lambda s: F.concat(s["offsets"], F.array_repeat(s["i"], 4)))
        return _let(offsets, lambda o: windows(placed, o))

    def windows(placed: Column, offsets: Column) -> Column:
        def step(s: Column, _: Column) -> Column:
            at, size = s["at"], F.least(n - s["at"], F.lit(WINDOW))
            k = F.floor(at / half).cast("int")
            near = F.slice(placed, F.get(offsets, k) + 1, F.get(offsets, k + 3) - F.get(offsets, k))
            inside = F.filter(near, lambda e: (e["s"] >= at) & (e["e"] <= at + size))
            return _let(inside, lambda x: of_inside(s, x, at, size))

        def of_inside(s: Column, inside: Column, at: Column, size: Column) -> Column:
            flags = _let(F.array_sort(F.transform(F.filter(inside, lambda e: e["e"] > e["s"] + 1), _merges)), lambda many: _merged(many, size, at))
            path = _let(flags, lambda f: F.transform(F.filter(inside, _kept(f, at)), _path))
            return _let(path, lambda p: advanced(s, p, at, at + size >= n))

        def advanced(s: Column, path: Column, at: Column, last: Column) -> Column:
            fits = (s["expected"] == 0) | (F.get(path, F.lit(0))["e"] == s["expected"])
            stand = F.filter(path, lambda p: p["s"] <= at + half)
            follower = F.element_at(stand, -1)  # the next window begins with it
            made = [F.when(last, n).otherwise(follower["s"]), F.when(last, 0).otherwise(follower["e"]), fits, F.concat(s["out"], F.array(F.when(last, path).otherwise(F.slice(stand, F.lit(1), F.size(stand) - 1))))]
            return F.struct(*[m.alias(x) for m, x in zip(made, ("at", "expected", "fits", "out"))])

        start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("expected"), F.lit(True).alias("fits"), F.array().cast(path_type).alias("out"))
        steps = F.sequence(F.lit(0), F.floor(n / (half - longest + 1)).cast("int") + 1)
        go = F.aggregate(steps, start, lambda s, k: F.when((s["at"] < n) & s["fits"], step(s, k)).otherwise(s))
        return _let(go, lambda s: F.when(s["fits"] & (s["at"] >= n), F.flatten(s["out"])))

    place = lambda e: F.struct(*[e[x].alias(x) for x in ("s", "e", "rank", "id", "reopens", "raw")])
    return _let(F.array_sort(F.transform(edges, place)), of_placed)


def _pieces_of_whole(edges: Column, n: Column) -> Column:
    """The pieces, in order, of a word of any length, one best merge at a time; for what windows can't settle."""
    none = F.array_repeat(F.lit(True), n + 1)

    def within(b: Column, e: Column) -> Column:
        return F.size(F.filter(F.slice(b, e["s"] + 1, e["e"] - e["s"] + 1), lambda x: x))

    def merges(b: Column, e: Column) -> Column:
        return F.get(b, e["s"]) & F.get(b, e["e"]) & (within(b, e) == 3)

    def best(b: Column, _: Column) -> Column:
        first = F.filter(edges, lambda e: (e["e"] > e["s"] + 1) & merges(b, e))
        return _let(F.get(first, F.lit(0)), lambda e: F.when(e.isNull(), b).otherwise(F.transform(b, lambda x, i: x & ~((i > e["s"]) & (i < e["e"])))))

    left = F.aggregate(F.sequence(F.lit(1), n), none, best)
    return _let(left, lambda b: F.array_sort(F.transform(F.filter(edges, lambda e: F.get(b, e["s"]) & F.get(b, e["e"]) & (within(b, e) == 2)), _path)))


def _best_path(edges: Column, n: Column, longest: int, unknown: float) -> Column:
    """The pieces, in order, on the path with the highest sum of scores (Viterbi); of equal ones the first by end and place.

    ``edges`` are sorted by end. The state holds the best scores of the last
    ``longest`` places, and of each place the best piece that ends there.
    """
    path_type = "array<struct<s:int,e:int,id:int,raw:string>>"
    none = F.get(F.array().cast(path_type), F.lit(0))
    start = [F.array().cast("array<double>"), F.lit(0), F.lit(0.0), none, F.array().cast(path_type)]
    names = ("recent", "at", "best", "piece", "back")

    def add(s: Column, e: Column) -> Column:
        new = e["e"] > s["at"]
        more = F.concat(s["recent"], F.array(s["best"]))
        recent = F.when(new, F.slice(more, F.greatest(F.size(more) - longest, F.lit(0)) + 1, F.lit(longest))).otherwise(s["recent"])
        back = F.when(new & (s["at"] > 0), F.concat(s["back"], F.array(s["piece"]))).otherwise(s["back"])
        return _let(F.struct(recent.alias("recent"), back.alias("back")), lambda r: scored(s, e, new, r))

    def scored(s: Column, e: Column, new: Column, r: Column) -> Column:
        # ``recent`` ends with the score of the place before e's end.
        score = F.element_at(r["recent"], e["s"] - e["e"]) + F.coalesce(e["score"], F.lit(unknown))
        better = new | (score > s["best"])
        made = [r["recent"], e["e"], F.when(better, score).otherwise(s["best"]), F.when(better, _path(e)).otherwise(s["piece"]), r["back"]]
        return F.struct(*[m.alias(x) for m, x in zip(made, names)])

    first = F.struct(*[m.alias(x) for m, x in zip(start, names)])
    back = F.aggregate(edges, first, add, lambda s: F.concat(s["back"], F.array(s["piece"])))

    def walked(back: Column) -> Column:
        def step(s: Column, _: Column) -> Column:
            piece = F.get(back, s["at"] - 1)
            return F.when(s["at"] > 0, F.struct(piece["s"].alias("at"), F.concat(s["out"], F.array(piece)).alias("out"))).otherwise(s)

        end = F.struct(n.alias("at"), F.array().cast(path_type).alias("out"))
        return F.aggregate(back, end, step, lambda s: F.reverse(s["out"]))

    return _let(back, walked)


def folded(edges: DataFrame, model: Model) -> DataFrame:
    """``edges`` of ``lattice`` with ``ids`` in their place: each word's piece ids.

    A character that is no piece gives its bytes' pieces, or the unknown id if
    the model has none.
    """
    n, e = F.col("size"), F.col("edges")
    if model.unigram:
        pieces = _best_path(e, n, model.longest, min(p[4] for p in model.pieces) - UNKNOWN_PENALTY)
    else:
        long = F.coalesce(_pieces_of_long(e, n, model.longest), _pieces_of_whole(e, n)) if model.longest <= WINDOW // 2 else _pieces_of_whole(e, n)
        pieces = F.when(n <= WINDOW, _pieces_of_short(e, n)).otherwise(long)

    def ids(p: Column) -> Column:
        if model.first_byte is None:
            return F.array(F.coalesce(p["id"], F.lit(model.unknown)))
        raw = F.transform(F.sequence(F.lit(1), F.length(p["raw"]), F.lit(2)), lambda k: F.conv(p["raw"].substr(k, F.lit(2)), 16, 10).cast("int") + model.first_byte)
        return F.when(p["id"].isNotNull(), F.array(p["id"])).otherwise(raw)

    return edges.select("n", "hash", F.flatten(F.transform(pieces, ids)).alias("ids"))


def dictionary(rows: DataFrame, model: Model) -> DataFrame:
    """(n, hash, ids) of the distinct words of ``rows`` of ``keyed``; a saved table."""
    words = distinct_words(rows, model)
    return saved(folded(lattice(words, piece_table(rows.sparkSession, model), model.longest, model.unigram), model), "dictionary")


class Lookup:
    """Word hashes with their pieces, as arrays."""

    def __init__(self, got: pa.Table):
        hashes = got.column("hash").to_numpy().view(np.uint64)
        sizes = pc.list_value_length(got.column("ids")).to_numpy().astype(np.int32)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.size = sizes[order]
        self.first = (np.cumsum(sizes) - sizes)[order].astype(np.int32)
        self.ids = pc.list_flatten(got.column("ids")).to_numpy().astype(np.int32)
        if len(self.ids) and self.ids.max() < 1 << 16:
            self.ids = self.ids.astype(np.uint16)
        if len(hashes) and (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("two words share a hash of 64 bits")

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The entry of each hash, -1 where there is none."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)


def _head(words: DataFrame, most: int) -> tuple[DataFrame, bool]:
    """The most frequent words, with ``most`` bytes of pieces in all, and whether those are all words."""
    size = 16 + 4 * F.size("ids")
    steps = words.groupBy(F.least("n", F.lit(10_000)).alias("n")).agg(F.sum(size).alias("size")).orderBy(F.desc("n")).collect()  # 10,000 rows at most
    total, least = 0, None
    for r in steps:
        if total + r["size"] > most:
            break
        total, least = total + r["size"], r["n"]
    everything = least == (steps[-1]["n"] if steps else None)
    return words.where(F.col("n") >= F.lit(least)) if least is not None else words.limit(0), everything


def _gathered(first: np.ndarray, size: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The ids of the entries, one entry after another."""
    total = np.cumsum(size)
    if not len(total):
        return ids[:0]
    return ids[np.arange(total[-1]) - np.repeat(total - size - first, size)]


def encode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: Model | None = None, head_bytes: int = HEAD_BYTES) -> DataFrame:
    """(doc_id, h, ids) of each row of ``docs``: the piece ids of its whole text.

    With the model of MODEL (none given) the same ids as its own encoder's.
    Null and empty texts have none; characters outside the vocabulary become
    byte pieces; repeated rows are encoded each; an empty table gives an
    empty result. Of the words' pieces ``head_bytes``, those of the most
    frequent words, are broadcast; if there are more, documents are joined
    with the pieces of their rare words.
    """
    model = model or load()
    rows = keyed(docs, doc_id, text)
    words = dictionary(rows, model)
    head, everything = _head(words, head_bytes)
    lookup = Lookup(head.select("hash", "ids").toArrow())  # ``head_bytes`` at most
    sent = rows.sparkSession.sparkContext.broadcast(lookup)
    pieces = [p[0] for p in model.pieces]
    if not everything:
        rows = joined(rows, saved(_rare(rows, words, sent, pieces), "rare"), "left")
    columns = ["doc_id", "h", "ids"]

    def of_batches(batches):
        cutter, known = Cutter(pieces), sent.value
        for batch in batches:
            for part in W.slices(batch, "text", SLICE_BYTES):
                points, start, end, owner = cutter.words(W.Texts(part.column("text")))
                hashes, back = np.unique(word_hashes(points, start, end), return_inverse=True)
                at = known.find(hashes)
                first, size, ids = known.first[at].astype(np.int64), known.size[at].astype(np.int64), known.ids
                if len(missing := np.flatnonzero(at < 0)):
                    extra = Lookup(_rare_table(part))
                    at = extra.find(hashes[missing])
                    first[missing], size[missing] = extra.first[at] + len(ids), extra.size[at]
                    ids = np.concatenate([ids, extra.ids])
                out = _gathered(first[back], size[back], ids)
                per = np.bincount(owner, weights=size[back], minlength=part.num_rows).astype(np.int64)
                offsets = np.concatenate([[0], np.cumsum(per)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("h"), pa.ListArray.from_arrays(offsets, out.astype(np.int32))], columns)
        del cutter
        W.release()

    return rows.mapInArrow(of_batches, "doc_id long, h long, ids array<int>")


def _rare_table(part: pa.RecordBatch) -> pa.Table:
    """The distinct (hash, ids) that the rows' ``rare`` lists hold."""
    known = {x["hash"]: x["ids"] for row in part.column("rare").to_pylist() if row for x in row}
    return pa.table({"hash": pa.array(list(known), pa.int64()), "ids": pa.array(list(known.values()), pa.list_(pa.int32()))})


def _rare(rows: DataFrame, words: DataFrame, sent, pieces: list[str]) -> DataFrame:
    """(doc_id, h, rare): of each row, the words outside the broadcast ones with their ids."""

    def of_batches(batches):
        cutter, known = Cutter(pieces), sent.value
        for batch in batches:
            for part in W.slices(batch, "text", SLICE_BYTES):
                points, start, end, owner = cutter.words(W.Texts(part.column("text")))
                hashes = word_hashes(points, start, end)
                some, back = np.unique(hashes, return_inverse=True)
                out = np.flatnonzero((known.find(some) < 0)[back])
                pairs = np.unique(np.stack([owner[out].astype(np.uint64), hashes[out]], 1), axis=0)
                whose = pa.array(pairs[:, 0].astype(np.int64))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(whose), part.column("h").take(whose), pa.array(np.ascontiguousarray(pairs[:, 1]).view(np.int64))], ["doc_id", "h", "hash"])

    held = rows.mapInArrow(of_batches, "doc_id long, h long, hash long").distinct()
    return held.join(words.select("hash", "ids"), "hash").groupBy("doc_id", "h").agg(F.collect_list(F.struct("hash", "ids")).alias("rare"))


def decode(encoded: DataFrame, ids: str = "ids", model: Model | None = None) -> DataFrame:
    """``encoded`` with ``decoded``, the text of each row's piece ids, which replaces a column of that name.

    Each id is looked up in the piece table, a constant of the vocabulary's
    size; no row leaves its task. Null or empty ids give an empty text; ids
    that are no piece, null ones and control pieces give nothing. The space
    that encoding put in front goes. All other columns and repeated rows stay.
    """
    model = model or load()
    spelled = {i: p.replace(SPACE, " ").encode().hex() for p, i, _, _, _ in model.pieces}
    if model.first_byte is not None:
        spelled |= {model.first_byte + b: f"{b:02x}" for b in range(256)}
    table = F.split(F.lit(",".join(spelled.get(i, "") for i in range(max(spelled) + 1))), ",")
    text = F.decode(F.unhex(F.array_join(F.transform(ids, lambda i: F.get(table, i)), "")), "UTF-8")  # nulls are left out
    return encoded.withColumn("decoded", F.coalesce(F.regexp_replace(text, "^ ", ""), F.lit("")))
