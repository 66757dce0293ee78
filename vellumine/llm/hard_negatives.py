"""Hard-negative mining by dual-tree search over embeddings.

A search has anchors with one or more bands of scores each and finds the best
rows of every band. Trees stand over both sides. Their upper levels are the
cells of a routing tree, fitted on a bounded sample: balls around the cells
bound the inner products of two cells, and cells that cannot reach any band of
an anchor cell are never dealt out to it. The lower levels are trees that a
task builds over a block of rows and a group of anchors; intervals of the
inner product of two nodes, from their boxes and balls, prune whole groups of
anchors, and leaf pairs are scored exactly.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from vellumine.llm import words as W
from vellumine.llm.shared import saved, unused

#: Rows of the sample that the routing tree is fitted on and bounds begin with; cells at most.
SAMPLE, CELLS = 4096, 512
#: Rows of a block at most, and blocks at least; anchors of a group; rows of a leaf on either side.
BLOCK, BLOCKS, GROUP, LEAF, ANCHOR_LEAF = 16384, 64, 16384, 256, 64
#: Stands for no score; scores of a long begin above it.
NO_SCORE = 1 - (1 << 63)


def whole(vector: Column) -> Column:
    """``floor(256 * x)`` of each component; null if the vector or a component is, or one is not finite."""
    x = vector.cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v * 256) < math.inf))
    # from 2**44 on a double's 256-fold is whole, and may pass the long that floor returns
    return F.when(finite, F.transform(x, lambda v: F.when(F.abs(v) < 2.0**44, F.floor(v * 256).cast("double")).otherwise(v * 256)))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two matrices of whole numbers, exactly; what passes a long is held at its ends."""
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if bound < 2.0**53:
        return (a @ b.T).astype(np.int64)
    exact = np.array([[int(v) for v in r] for r in a], object).reshape(a.shape) @ np.array([[int(v) for v in r] for r in b], object).reshape(b.shape).T
    return np.clip(exact, NO_SCORE + 1, (1 << 63) - 1).astype(np.int64)


@dataclass
class Tree:
    """A tree over points, split at the median of the widest dimension: nodes in pre-order with boxes, balls, bounds of their points and children."""

    order: np.ndarray
    first: list[int]
    last: list[int]
    low: np.ndarray
    high: np.ndarray
    center: np.ndarray
    radius: np.ndarray
    children: list[tuple[int, int] | None]


def tree(points: np.ndarray, leaf: int) -> Tree:
    """The tree over ``points``, none of which are left out; leaves hold ``leaf`` at most."""
    order, first, last, low, high, center, radius, children = np.arange(len(points)), [], [], [], [], [], [], []

    def node(a: int, b: int) -> int:
        here, me = points[order[a:b]], len(first)
        first.append(a)
        last.append(b)
        lo, hi, mid = here.min(axis=0), here.max(axis=0), here.mean(axis=0)
        low.append(lo)
        high.append(hi)
        center.append(mid)
        radius.append(math.sqrt(((here - mid) ** 2).sum(axis=1).max()))
        children.append(None)
        if b - a > leaf:
            d = int(np.argmax(hi - lo)) if here.shape[1] else 0
            at = (b - a) // 2
            if here.shape[1]:
                order[a:b] = order[a:b][np.argpartition(here[:, d], at)]
            left = node(a, a + at)
            children[me] = (left, node(a + at, b))
        return me

    node(0, len(points))
    return Tree(order, first, last, np.array(low), np.array(high), np.array(center), np.array(radius), children)


def intervals(t: Tree, i: int, u: Tree, js: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the inner product of any point of node i of ``t`` with any of nodes js of ``u``."""
    al, ah, bl, bh = t.low[i], t.high[i], u.low[js], u.high[js]
    corners = np.stack([al * bl, al * bh, ah * bl, ah * bh])
    rounding = 1e-12 * np.abs(corners).max(axis=0).sum(axis=1)
    lo, hi = corners.min(axis=0).sum(axis=1) - rounding, corners.max(axis=0).sum(axis=1) + rounding
    middle = u.center[js] @ t.center[i]
    slack = np.linalg.norm(t.center[i]) * u.radius[js] + np.linalg.norm(u.center[js], axis=1) * t.radius[i] + t.radius[i] * u.radius[js]
    slack = slack * (1 + 1e-9) + np.abs(middle) * 1e-9 + 1
    return np.maximum(lo, middle - slack), np.minimum(hi, middle + slack)


@dataclass
class Side:
    """Rows of one side of a search: points, lengths of their vectors, labels, ids and row numbers."""

    points: np.ndarray
    dims: np.ndarray
    label: np.ndarray
    vec_id: np.ndarray
    row: np.ndarray

    def take(self, at: np.ndarray) -> Side:
        return Side(self.points[at], self.dims[at], self.label[at], self.vec_id[at], self.row[at])


def side(table: pa.Table, width: int) -> Side:
    vectors = table.column("q").combine_chunks()
    offsets = vectors.offsets.to_numpy()
    dims = np.diff(offsets)
    points = np.zeros((len(dims), width))
    points[np.arange(width) < dims[:, None]] = vectors.flatten().to_numpy()
    return Side(points, dims, *(table.column(c).to_numpy() for c in ("label", "vec_id", "row")))


def found(anchors: Side, low: np.ndarray, high: np.ndarray, rows: Side, same: bool, top: int) -> tuple[np.ndarray, ...]:
    """For each band (an anchor with the bounds of its scores) the best ``top`` of ``rows``: band, score, id, row.

    ``same``: rows of the anchor's label, else of other labels. An anchor does
    not meet itself, nor vectors of another length. ``low`` of a band rises
    with what it has found.
    """
    n, low = len(low), low.copy()
    score, vec_id, number = np.full((n, top), NO_SCORE), np.full((n, top), np.iinfo(np.int64).max), np.full((n, top), -1, np.int64)
    t, u = tree(anchors.points, ANCHOR_LEAF), tree(rows.points, LEAF)
    anchors, rows, place = anchors.take(t.order), rows.take(u.order), t.order

    def leaves(i: int, j: int) -> None:
        a, b = slice(t.first[i], t.last[i]), slice(u.first[j], u.last[j])
        s, own = products(anchors.points[a], rows.points[b]), place[a]
        ok = ((anchors.label[a, None] == rows.label[b]) == same) & (anchors.dims[a, None] == rows.dims[b]) & (anchors.row[a, None] != rows.row[b])
        ok &= (s >= low[own, None]) & (s <= high[own, None])
        hit = np.flatnonzero(ok.any(axis=1))
        if not len(hit):
            return
        to = own[hit]
        all_score = np.concatenate([score[to], np.where(ok[hit], s[hit], NO_SCORE)], axis=1)
        all_id = np.concatenate([vec_id[to], np.where(ok[hit], rows.vec_id[b], np.iinfo(np.int64).max)], axis=1)
        all_row = np.concatenate([number[to], np.where(ok[hit], rows.row[b], -1)], axis=1)
        order = np.lexsort((all_row, all_id, -all_score), axis=-1)[:, :top]
        score[to], vec_id[to], number[to] = (np.take_along_axis(x, order, axis=1) for x in (all_score, all_id, all_row))
        low[to] = np.where(number[to, -1] >= 0, np.maximum(low[to], score[to, -1]), low[to])

    def pairs(i: int, js: list[int]) -> None:
        """Node i of the anchors against nodes js of the rows, the most promising first."""
        lo, hi = intervals(t, i, u, js)
        own = place[t.first[i] : t.last[i]]
        for k in np.argsort(-hi).tolist():
            if hi[k] < low[own].min() or lo[k] > high[own].max():
                continue
            j = js[k]
            if t.children[i] is None and u.children[j] is None:
                leaves(i, j)
            elif u.children[j] is not None and (t.children[i] is None or u.last[j] - u.first[j] >= t.last[i] - t.first[i]):
                pairs(i, list(u.children[j]))
            else:
                for c in t.children[i]:
                    pairs(c, [j])

    pairs(0, [0])
    band, k = np.nonzero(number >= 0)
    return band, score[band, k], vec_id[band, k], number[band, k]


@dataclass
class Index:
    """All rows (row, vec_id, label, q, cell), saved; the sample; the cells' centers, radii and sizes."""

    rows: DataFrame
    sample: Side
    width: int
    centers: np.ndarray
    radii: np.ndarray
    counts: np.ndarray

    def pieces(self) -> np.ndarray:
        """How many blocks each cell is dealt out to."""
        size = min(BLOCK, max(1, math.ceil(self.counts.sum() / BLOCKS)))
        return np.maximum(1, -(-self.counts // size))


def index(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> Index:
    """Every valid row with its cell; the routing tree's leaves are cells, split on a sample of SAMPLE rows taken by hash."""
    q, i = whole(F.col(f"`{vector}`")), F.col(f"`{vec_id}`").cast("long")
    clean = vectors.select(F.monotonically_increasing_id().alias("row"), i.alias("vec_id"), F.col(f"`{label}`").cast("long").alias("label"), q.alias("q")).where("label IS NOT NULL AND q IS NOT NULL AND vec_id IS NOT NULL")
    clean = saved(clean, "vectors")
    width, n = clean.agg(F.coalesce(F.max(F.size("q")), F.lit(0)), F.count("*")).first()
    chosen = clean.orderBy(F.xxhash64("row")).limit(SAMPLE).toArrow()  # a documented bound
    sample = side(chosen, width)
    if not len(sample.row):
        return Index(clean.withColumn("cell", F.lit(0)), sample, width, np.zeros((1, width)), np.zeros(1), np.zeros(1, np.int64))
    t = tree(sample.points, math.ceil(len(sample.row) / min(CELLS, max(BLOCKS, n // BLOCK))))
    centers = np.array([t.center[i] for i, c in enumerate(t.children) if c is None])

    def route(batches):
        for batch in batches:
            points = side(pa.Table.from_batches([batch]), width).points
            cell, far = np.zeros(len(points), np.int64), np.zeros(len(points))
            for a in range(0, len(points), 4096):
                part = points[a : a + 4096]
                away = (part**2).sum(axis=1)[:, None] - 2 * part @ centers.T + (centers**2).sum(axis=1)
                cell[a : a + 4096] = away.argmin(axis=1)
                far[a : a + 4096] = np.sqrt(((part - centers[cell[a : a + 4096]]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(far)], [*batch.schema.names, "cell", "far"])
        W.release()

    rows = saved(clean.mapInArrow(route, StructType([*clean.schema.fields, StructField("cell", LongType()), StructField("far", DoubleType())])), "routed")
    radii, counts = np.zeros(len(centers)), np.zeros(len(centers), np.int64)
    for cell, far, n in rows.groupBy("cell").agg(F.max("far"), F.count("*")).collect():  # CELLS at most
        radii[cell], counts[cell] = far, n
    return Index(rows.drop("far"), sample, width, centers, radii, counts)


def search(at: Index, bands: DataFrame, same: bool, top: int) -> DataFrame:
    """(band, score, vec_id, row): the ``top`` rows of each of ``bands`` (band, row, vec_id, label, q, cell, low, high), best first by score, id and row.

    The bounds of a band begin with what the sample holds. Blocks are pieces
    of cells, groups pieces of the anchors' cells; a pair of cells whose balls
    cannot reach a band of the anchors' cell is not dealt out.
    """
    sample, width = at.sample, at.width
    bands = saved(bands, "bands")

    def begin(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            low = table.column("low").to_numpy().copy()
            if len(sample.row) and len(low):
                band, score, _, _ = found(side(table, width), low, table.column("high").to_numpy(), sample, same, top)
                of, n = np.unique(band, return_counts=True)
                worst = np.minimum.reduceat(score, np.cumsum(n) - n) if len(of) else score
                low[of] = np.where(n == top, np.maximum(low[of], worst), low[of])
            yield pa.RecordBatch.from_arrays([pa.array(low) if c == "low" else batch.column(c) for c in batch.schema.names], batch.schema.names)

    started = saved(bands.mapInArrow(begin, bands.schema), "started")
    reach = started.groupBy("cell").agg(F.min("low"), F.max("high"), F.count("*")).collect()  # CELLS at most
    pieces = at.pieces()
    norm, groups = np.linalg.norm(at.centers, axis=1), []  # of a group: its cells, pieces, anchors, cells that it meets
    for cell, low, high, n in sorted(reach):
        middle = at.centers @ at.centers[cell]
        slack = norm[cell] * at.radii + norm * at.radii[cell] + at.radii[cell] * at.radii
        slack = slack * (1 + 1e-9) + np.abs(middle) * 1e-9 + 1
        met = set(np.flatnonzero((middle + slack >= low) & (middle - slack <= high) & (at.counts > 0)).tolist())
        if groups and groups[-1][2] + n <= GROUP:
            groups[-1] = ([*groups[-1][0], cell], 1, groups[-1][2] + n, groups[-1][3] | met)
        else:
            groups.append(([cell], math.ceil(n / GROUP), n, met))
    first_group = np.concatenate([[0], np.cumsum([m for _, m, _, _ in groups])]).astype(int).tolist()
    first_block = np.concatenate([[0], np.cumsum(pieces)]).astype(int).tolist()
    a_rows = [(cell, g, m, [b for c in sorted(met) for b in range(first_block[c], first_block[c + 1])]) for g, (cells, m, _, met) in zip(first_group, groups) for cell in cells]
    meets = {c: [k for g, (_, m, _, met) in zip(first_group, groups) if c in met for k in range(g, g + m)] for c in range(len(pieces))}
    spark = bands.sparkSession
    a_cells = spark.createDataFrame(a_rows, "cell long, g0 long, many long, blocks array<int>")
    r_cells = spark.createDataFrame([(c, first_block[c], int(pieces[c]), gs) for c, gs in meets.items() if gs], "cell long, b0 long, pieces long, groups array<int>")
    group = (F.col("g0") + F.pmod(F.xxhash64("band"), "many")).cast("int")
    left = started.join(F.broadcast(a_cells), "cell").select("band", "row", "vec_id", "label", "q", "low", "high", group.alias("g"), F.explode("blocks").alias("b"))
    block = (F.col("b0") + F.pmod(F.xxhash64("row"), "pieces")).cast("int")
    right = at.rows.join(F.broadcast(r_cells), "cell").select("row", "vec_id", "label", "q", block.alias("b"), F.explode("groups").alias("g"))

    def of_pair(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        names = ["band", "score", "vec_id", "row"]
        if not anchors.num_rows or not rows.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in names})
        band, *more = found(side(anchors, width), anchors.column("low").to_numpy(), anchors.column("high").to_numpy(), side(rows, width), same, top)
        return pa.table(dict(zip(names, (anchors.column("band").to_numpy()[band], *more))))

    right = right.withColumnsRenamed({"b": "r_b", "g": "r_g"})
    met = left.groupBy("b", "g").cogroup(right.groupBy("r_b", "r_g")).applyInArrow(of_pair, "band long, score long, vec_id long, row long")
    place = F.row_number().over(Window.partitionBy("band").orderBy(F.desc("score"), "vec_id", "row"))
    return met.withColumn("place", place).where(F.col("place") <= top)


def mine(
    vectors: DataFrame,
    anchor: Callable[[Column], Column] = lambda i: i % 100 == 0,
    relabelled: Callable[[Column, Column], Column] | None = None,
    positives: int = 5,
    negatives: int = 5,
    share: int = 80,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and each of its best positives the best negatives.

    Scores are inner products of ``whole`` vectors. Positives are the
    ``positives`` best other rows of the anchor's label; negatives of one are
    the ``negatives`` best rows of other labels whose score is at least
    ``share`` percent of the positive's and not above it. Ties go to the
    smaller id. ``relabelled(id, label)`` may change labels first.

    Rows with a null id, label, vector or component, or one that is not
    finite, take no part; vectors of different lengths do not meet; rows that
    share an id are rows of their own; an anchor without positives or
    negatives has no rows. Other columns are not read. An empty table gives an
    empty result.
    """
    if relabelled:
        i, mark = F.col(f"`{vec_id}`").cast("long"), unused(vectors, "vq_label")
        vectors, label = vectors.withColumn(mark, relabelled(i, F.col(f"`{label}`").cast("long"))), mark
    at = index(vectors, vec_id, vector, label)
    anchors = at.rows.where(anchor(F.col("vec_id")))
    every = anchors.withColumns({"band": F.col("row"), "low": F.lit(NO_SCORE).cast("long") + 1, "high": F.lit((1 << 63) - 1)})
    near = saved(search(at, every, True, positives).select("band", F.col("score").alias("positive_score"), F.col("vec_id").alias("positive_id"), "place"), "positives")
    anchors = anchors.select(F.col("row"), F.col("vec_id").alias("anchor_id"), "label", "q", "cell")
    named = near.join(anchors.withColumnRenamed("row", "a_row"), F.col("band") == F.col("a_row")).withColumn("n_band", F.col("band") * positives + F.col("place") - 1)
    low = F.expr(f"(cast(positive_score AS decimal(38, 0)) * {share} + 99) div 100")  # the least n with share * p <= 100 * n
    bands = named.where("positive_score >= 0").select(F.col("n_band").alias("band"), F.col("a_row").alias("row"), F.col("anchor_id").alias("vec_id"), "label", "q", "cell", low.alias("low"), F.col("positive_score").alias("high"))
    far = search(at, bands, False, negatives).withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score", "place": "rank", "band": "n_band"})
    named = named.select("n_band", "anchor_id", "positive_id", "positive_score")
    return named.join(far, "n_band").select("anchor_id", "positive_id", F.col("rank").cast("int"), "negative_id", "positive_score", "negative_score")
