"""Connected components of an edge table by alternating large-star and small-star.

Every round is a group-by and a join; the edges of a round are a table in the
shared folder, so nothing depends on one machine or on the driver's memory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumine.llm.shared import saved


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star round over edges (a, b) with a > b; each node's neighbours move to its least one."""
    if large:
        around = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        around = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = around.join(least, "u")
    if large:
        moved = moved.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        moved = moved.where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def connected(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, root): each node that has a link, with the least node it can reach.

    Links may be repeated, reversed or loops; null ends are ignored. A node
    with loops only is left out, like one without links.
    """
    x, y = F.col(a), F.col(b)
    edges = saved(
        links.where(x.isNotNull() & y.isNotNull() & (x != y)).select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct(),
        "links",
    )
    state = None
    for _ in range(most_rounds):
        edges = saved(_star(_star(edges, True), False), "stars")
        now = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if now == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        state = now
    raise RuntimeError(f"no fixed point after {most_rounds} rounds")


def united(a: DataFrame, b: DataFrame) -> DataFrame:
    """(doc_id, h, root) of each row of ``b``: the components that the links behind both ``a`` and ``b`` make together.

    Both tables have (doc_id, h, root) for the same rows. Components of the
    one and the other that share a row are linked; one of a single row links
    nothing.
    """
    i, h = F.col("doc_id").alias("i"), F.col("h").alias("k")
    x = a.select(i, h, F.concat(F.lit("a"), "root").alias("x")).distinct()
    y = b.select("doc_id", "h", F.concat(F.lit("b"), "root").alias("y"))
    met = saved(x.join(y, F.col("i").eqNullSafe(F.col("doc_id")) & (F.col("k") == F.col("h"))).select("doc_id", "h", "x", "y"), "both")
    several = lambda c: met.select("doc_id", "h", c).distinct().groupBy(c).agg(F.count("*").alias("n")).where("n > 1").select(c)
    xs, ys = saved(several("x"), "several"), saved(several("y"), "several")
    pairs = met.join(xs, "x", "left_semi").join(ys, "y", "left_semi").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
    roots = saved(connected(pairs), "roots")
    of = lambda c, r: roots.select(F.col("node").alias(c), F.col("root").alias(r))
    placed = met.join(of("x", "of_x"), "x", "left").join(of("y", "of_y"), "y", "left").join(xs.withColumn("several", F.lit(True)), "x", "left")
    return placed.select("doc_id", "h", F.coalesce("of_x", "of_y", F.when(F.col("several"), F.col("x")).otherwise(F.col("y"))).alias("root"))
