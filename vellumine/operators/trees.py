"""Trees from parent pointers: climbing by doubling, tables of contents, paths, counts below.

A round of ``climb`` doubles how far each node has looked up, so that a tree
of depth d takes log2(d) joins, and a chain of any length ends in as many
rounds as its length has bits. Cycles do not end: the number of rounds does.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructType

from vellumine.session import checkpointed


def climb(nodes: DataFrame, merge: dict[str, Callable[[Column, Column], Column]], key: str = "book_id", node: str = "node_id", up: str = "up", rounds: int | None = None) -> DataFrame:
    """``nodes`` (key, node, up, columns of ``merge``), each column merged with those of all nodes above it.

    ``merge`` has for each column a function of (own, above); above is null
    where the chain ends. ``up`` is null at the end but for nodes on or below
    a cycle, which stop after as many rounds as the largest tree has bits.
    Only nodes that others stand below climb by rounds, each a checkpoint; all
    then take in one join what their parent has found.
    """
    own = nodes.select(key, node, up, *merge)
    ups = own.where(F.col(up).isNotNull()).select(key, F.col(up).alias(node)).distinct()
    found = checkpointed(own.join(ups, [key, node], "left_semi"))
    if rounds is None:
        largest = found.groupBy(key).count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
        rounds = int(largest).bit_length()
    for _ in range(rounds):
        open_ = found.where(F.col(up).isNotNull())
        if open_.isEmpty():
            break
        found = checkpointed(found.where(F.col(up).isNull()).unionByName(_risen(open_, found, merge, key, node, up)))
    return _risen(own, found, merge, key, node, up)


def _risen(rows: DataFrame, found: DataFrame, merge: dict[str, Callable[[Column, Column], Column]], key: str, node: str, up: str) -> DataFrame:
    """``rows`` merged with what stands in ``found`` at their ``up``, and as far up as that has come."""
    # a row at the end of its chain is dealt out by itself, not with all others that have no ``up``
    at = F.coalesce(F.col(up), F.col(node))
    above_ = found.select(F.col(key).alias("vt_key"), F.col(node).alias("vt_node"), F.col(up).alias("vt_up"), *[F.col(c).alias(f"vt_{c}") for c in merge])
    met = rows.join(above_, (F.col(key) == F.col("vt_key")) & (at == F.col("vt_node")) & F.col(up).isNotNull(), "left")
    return met.select(key, node, F.col("vt_up").alias(up), *[f(F.col(c), F.col(f"vt_{c}")).alias(c) for c, f in merge.items()])


def above(nodes: DataFrame, key: str = "book_id", node: str = "node_id", parent: str = "parent_id") -> DataFrame:
    """(key, node, above): the nodes above each one, nearest first; for trees without cycles."""
    start = nodes.select(key, node, F.col(parent).alias("up"), F.when(F.col(parent).isNull(), F.array().cast("array<long>")).otherwise(F.array(F.col(parent).cast("long"))).alias("above"))
    longer = lambda own, more: F.concat(own, F.coalesce(more, F.array().cast("array<long>")))
    return climb(start, {"above": longer}, key, node).select(key, node, "above")


#: Points of a book that are put in order in one task; larger books climb by joins.
BOOK_POINTS = 1024


def rebuilt(points: DataFrame, key: str = "book_id", book_points: int = BOOK_POINTS) -> DataFrame:
    """``points`` (key, place, parent, ...) with ``under``, ``path`` and ``n_below``: a table of contents from parent places.

    A point with the parent -1 stands at the top, the others below their
    parent, in the order of places. Points that no top point leads to (their
    parent is missing, or they run in a circle) follow at the top, each with
    what is below it: of such a chain the point that comes first by place.
    ``under`` is the parent in the tree, ``path`` the ordinals from the top.
    Books of up to ``book_points`` points meet by one shuffle and are settled
    where they meet, the others by ``_climbed``.
    """
    book = Window.partitionBy(key).orderBy("place")
    counted = points.withColumns({"vt_n": F.count("*").over(book.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), "vt_i": F.row_number().over(book)})
    schema = StructType([*points.schema.fields]).add("under", points.schema["parent"].dataType).add("path", ArrayType(IntegerType())).add("n_below", LongType())
    small = counted.where(F.col("vt_n") <= book_points).sortWithinPartitions(key, "place").mapInArrow(_settled, schema)
    # keys alone, in the order that they come in, are shuffled smaller than counts of theirs: most books' points are few
    if points.select(key).repartition(key).groupBy(key).count().where(F.col("count") > book_points).isEmpty():
        return small
    return small.unionByName(_climbed(counted.where(F.col("vt_n") > book_points).drop("vt_n", "vt_i"), key))


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of whole books, in order, with where they stand; the book that a batch ends within waits for the next."""
    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch]).combine_chunks()
        ends = np.flatnonzero(rows["vt_i"].to_numpy() == rows["vt_n"].to_numpy())
        cut = int(ends[-1]) + 1 if ends.size else 0
        held = rows.slice(cut)
        if cut:
            yield from _placed(rows.slice(0, cut).combine_chunks()).to_batches()


def _placed(rows: pa.Table) -> pa.Table:
    nth, place = rows["vt_i"].to_numpy(), rows["place"].to_numpy()
    none = rows["parent"].is_null().to_numpy()
    parent = rows["parent"].fill_null(0).to_numpy()
    n, book = len(nth), np.cumsum(nth == 1) - 1
    # a book's rows are in the order of places: its parents are found by bisection, codes standing for places
    values, code = np.unique(np.concatenate([place, parent]), return_inverse=True)
    own, wanted = book * len(values) + code[:n], book * len(values) + code[n:]
    at = np.minimum(np.searchsorted(own, wanted), n - 1)
    up = np.where((own[at] == wanted) & ~none, at, -1)
    far, first, least = up.copy(), (parent == -1) & ~none, np.where(up >= 0, parent, np.iinfo(np.int64).max)
    for _ in range(int(nth.max()).bit_length()):
        on = np.flatnonzero(far >= 0)
        above_ = far[on]
        first[on], least[on], far[on] = first[on] | first[above_], np.minimum(least[on], least[above_]), far[above_]
    alone = least == np.iinfo(np.int64).max
    begins = ~first & (alone | (least >= place))
    first &= alone
    under = np.where(first | begins | none, -1, up)
    group, rank = np.where(under >= 0, under, -1 - book), np.where(none, 2, np.where(first, 0, 1))
    order = np.lexsort((np.arange(n), rank, group))
    new = np.r_[True, group[order][1:] != group[order][:-1]]
    ordinal = np.empty(n, dtype=np.int32)
    ordinal[order] = np.arange(n) - np.maximum.accumulate(np.where(new, np.arange(n), 0))
    depth, below = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    on, at = np.flatnonzero(under >= 0), under[under >= 0]
    while on.size:
        depth[on] += 1
        below += np.bincount(at, minlength=n)
        on, at = on[under[at] >= 0], under[at][under[at] >= 0]
    stops = np.r_[0, np.cumsum(depth + 1)].astype(np.int32)
    path = np.empty(stops[-1], dtype=np.int32)
    on, at, last = np.arange(n), np.arange(n), stops[1:] - 1
    while on.size:
        path[last[on]] = ordinal[at]
        last[on] -= 1
        more = under[at] >= 0
        on, at = on[more], under[at][more]
    kept = rows.drop_columns(["vt_n", "vt_i"])
    kept = kept.append_column("under", pa.array(parent, mask=under < 0).cast(rows["parent"].type))
    return kept.append_column("path", pa.ListArray.from_arrays(pa.array(stops), pa.array(path))).append_column("n_below", pa.array(below))


def _climbed(points: DataFrame, key: str) -> DataFrame:
    """``rebuilt`` for books of any size, by climbing."""
    known = points.select(key, F.col("place").alias("parent")).withColumn("there", F.lit(True))
    linked = points.select(key, "place", "parent").join(known, [key, "parent"], "left")
    start = linked.select(
        key,
        F.col("place").alias("node_id"),
        F.when(F.col("there"), F.col("parent")).alias("up"),
        F.when(F.col("there"), F.col("parent")).alias("least"),
        (F.col("parent") == -1).alias("top"),
    )
    climbed = climb(start, {"least": lambda own, more: F.least(own, more), "top": lambda own, more: F.coalesce(own | more, own)}, key)
    # a chain that ends at -1 is a top one; of the rest, what stands before all above it begins a tree
    begins = (~F.col("top")) & (F.col("least").isNull() | (F.col("least") >= F.col("node_id")))
    told = climbed.select(key, F.col("node_id").alias("place"), (F.col("top") & F.col("least").isNull()).alias("first"), begins.alias("begins"))
    placed = points.join(told, [key, "place"])
    tree = placed.withColumn("under", F.when(~F.col("first") & ~F.col("begins"), F.col("parent")))
    order = Window.partitionBy(key, "under").orderBy(F.desc("first"), "place")
    tree = tree.withColumn("ordinal", F.row_number().over(order) - 1).drop("first", "begins")
    return with_paths(tree, key)


def with_paths(tree: DataFrame, key: str = "book_id") -> DataFrame:
    """``tree`` (key, place, under, ordinal, ...) with ``path``, the ordinals from the top, and ``n_below``, how many points stand below; ``ordinal`` goes."""
    start = tree.select(key, F.col("place").alias("node_id"), F.col("under").alias("up"), F.array("ordinal").alias("path"))
    paths = climb(start, {"path": lambda own, more: F.concat(F.coalesce(more, F.array().cast("array<int>")), own)}, key).select(key, F.col("node_id").alias("place"), "path")
    over = F.explode(F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda n: F.slice("path", F.lit(1), n)))
    below = paths.where(F.size("path") > 1).select(key, over.alias("path")).groupBy(key, "path").agg(F.count("*").alias("n_below"))
    counted = paths.join(below, [key, "path"], "left").withColumn("n_below", F.coalesce("n_below", F.lit(0)))
    return tree.drop("ordinal").join(counted, [key, "place"])


def at_path(tree: DataFrame, wanted: DataFrame, key: str = "book_id") -> DataFrame:
    """``wanted`` (key, path, ...) with the place of the point there; null where there is none.

    The tree is always shuffled: what looks small to Spark, compressed, is
    many times larger in the table that a broadcast makes of it.
    """
    return wanted.join(tree.select(key, "path", "place").hint("merge"), [key, "path"], "left")
