"""Registered queries: pages as pictures, and their sides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.operators import pages, reader
from vellumine.plans.text import read


def picture_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as pictures of six kinds: the size from their bytes, and their place in a viewport."""
    w, h = "w", "h"
    le = lambda x, n: F.expr("concat(" + ", ".join(f"lpad(hex(({x} div {256**k}) % 256), 2, '0')" for k in range(n)) + ")")
    be = lambda x, n: F.expr(f"lpad(hex({x}), {2 * n}, '0')")
    riff = lambda kind, *rest: F.concat(F.lit("5249464600000000" + "57454250" + kind + "00000000"), *rest)
    kind = F.col("p_partkey") % 6
    hexed = (
        F.when(F.col("p_partkey") % 25 == 0, F.lit("FFD8FFE00100"))
        .when(kind == 0, F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), be(w, 4), be(h, 4)))
        .when(kind == 1, F.concat(F.lit("474946383961"), le(w, 2), le(h, 2)))
        .when(kind == 2, riff("56503820", F.lit("0000009D012A"), le(w, 2), le(h, 2)))
        .when(kind == 3, riff("5650384C", F.lit("2F"), le("(w - 1 + (h - 1) * 16384)", 4)))
        .when(kind == 4, riff("56503858", F.lit("00000000"), le("(w - 1)", 3), le("(h - 1)", 3)))
        .otherwise(F.concat(F.lit("FFD8FFE00006FFC0FFDAFF01FFFFC2001108"), be(h, 2), be(w, 2), F.lit("03FFD9")))
    )
    part = read(spark, sf_dir, "part").selectExpr("p_partkey", "cast(if(p_partkey % 6 = 0 and p_partkey % 7 = 0, 40000, p_size * 20 + 1) as bigint) as w", "cast(p_partkey % 900 as bigint) + 1 as h")
    sized = part.select("p_partkey", pages.picture_size(F.unhex(hexed)).alias("s")).select("p_partkey", "s.*")
    k = F.col("p_partkey")
    mode = F.when(k % 3 == 0, "Fit").when(k % 3 == 1, "Fill").otherwise("ActualSize")
    put = pages.placed(F.col("width"), F.col("height"), (800.0, 600.0), mode, F.lit(1.25), (F.lit(5.0), F.lit(-3.0)))
    return sized.withColumn("p", put).select("p_partkey", "format", "width", "height", "reason", *[F.round(f"p.{c}", 4).alias(f"p_{c}") for c in ("x", "y", "width", "height")], "p.clipped")


PICTURE_LAYOUT = """WITH t AS (SELECT p_partkey, CASE WHEN p_partkey % 25 = 0 THEN 'jpeg' ELSE ['png', 'gif', 'webp', 'webp', 'webp', 'jpeg'][p_partkey % 6 + 1] END AS format, p_partkey % 25 = 0 AS broken, (p_partkey % 6 = 0 AND p_partkey % 7 = 0) AS huge, p_size * 20 + 1 AS w, p_partkey % 900 + 1 AS h FROM part),
s AS (SELECT *, CASE WHEN broken THEN 'undecodable' WHEN huge THEN 'invalid_geometry' END AS reason FROM t),
g AS (SELECT *, 1.25::DOUBLE * CASE p_partkey % 3 WHEN 0 THEN least(800.0::DOUBLE / w, 600.0::DOUBLE / h) WHEN 1 THEN greatest(800.0::DOUBLE / w, 600.0::DOUBLE / h) ELSE 1 END AS f FROM s),
p AS (SELECT *, w * f AS pw, h * f AS ph, (800 - w * f) / 2 + 5 AS x, (600 - h * f) / 2 - 3 AS y FROM g)
SELECT p_partkey, format, CASE WHEN reason IS NULL THEN w END::BIGINT AS width, CASE WHEN reason IS NULL THEN h END::BIGINT AS height, reason, CASE WHEN reason IS NULL THEN round(x, 4) END AS p_x, CASE WHEN reason IS NULL THEN round(y, 4) END AS p_y,
CASE WHEN reason IS NULL THEN round(pw, 4) END AS p_width, CASE WHEN reason IS NULL THEN round(ph, 4) END AS p_height, CASE WHEN reason IS NULL THEN x < 0 OR y < 0 OR x + pw > 800 OR y + ph > 600 END AS clipped FROM p"""


def page_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The side of every page of the conversations' spreads, and whether its marks exclude each other."""
    k = F.col("conv_id") + F.col("turn")
    marked = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(k % 11 == 0, "left").when(k % 11 == 5, "center").alias("side"), F.when(k % 3 == 0, "pair").when(k % 4 == 1, "single").alias("hint"))
    plain = marked.select("conv_id", "turn", F.lit(None).cast("string").alias("side"), (F.col("turn") % 9 == 8).alias("single"))
    each = reader.spreads(plain, "conv_id", "turn", "side", "single")
    members = F.when(F.col("second").isNull(), F.array("first")).otherwise(F.array("first", "second"))
    slots = each.select("conv_id", F.size(members).alias("members"), "first", "second", F.posexplode(members).alias("slot", "turn"))
    other = F.when(F.col("members") == 2, F.when(F.col("slot") == 0, F.col("second")).otherwise(F.col("first")))
    sides = marked.select("conv_id", F.col("turn").alias("other"), F.col("side").alias("sibling"))
    order = reader.neighbours(marked, "conv_id", "turn", "turn").select("conv_id", "turn", "index")
    met = slots.withColumn("other", other).join(sides, ["conv_id", "other"], "left").join(marked, ["conv_id", "turn"]).join(order, ["conv_id", "turn"])
    side = pages.effective_side(F.col("side"), F.col("sibling"), F.col("slot"), F.col("members"), F.col("index"), F.col("conv_id") % 2 == 1)
    return met.select("conv_id", "turn", side.alias("effective"), pages.in_conflict(F.col("side"), F.col("hint")).alias("conflict"))


PAGE_SIDES = """WITH t AS (SELECT conv_id, turn, turn % 9 = 8 OR row_number() OVER w = 1 AS alone, row_number() OVER w - 1 AS index, conv_id % 2 = 1 AS rtl, CASE (conv_id + turn) % 11 WHEN 0 THEN 'left' WHEN 5 THEN 'center' END AS side,
CASE WHEN (conv_id + turn) % 3 = 0 THEN 'pair' WHEN (conv_id + turn) % 4 = 1 THEN 'single' END AS hint FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
r AS (SELECT *, sum(alone::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM t), p AS (SELECT *, row_number() OVER (PARTITION BY conv_id, run, alone ORDER BY turn) - 1 AS n FROM r),
g AS (SELECT *, count(*) OVER q AS members, n % 2 AS slot, coalesce(lag(side) OVER (q ORDER BY turn), lead(side) OVER (q ORDER BY turn)) AS sibling FROM p WINDOW q AS (PARTITION BY conv_id, run, alone, n // 2))
SELECT conv_id, turn, coalesce(side, CASE WHEN members = 2 THEN coalesce(CASE sibling WHEN 'left' THEN 'right' WHEN 'right' THEN 'left' ELSE sibling END, CASE WHEN (slot = 0) <> rtl THEN 'left' ELSE 'right' END) WHEN index = 0 THEN CASE WHEN rtl THEN 'left' ELSE 'right' END ELSE 'center' END) AS effective,
coalesce((side = 'center' AND hint = 'pair') OR (side IN ('left', 'right') AND hint = 'single'), false) AS conflict FROM g"""

QUERIES = {f.__name__: f for f in (picture_layout, page_sides)}
SQL = {"picture_layout": PICTURE_LAYOUT, "page_sides": PAGE_SIDES}
