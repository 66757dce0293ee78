"""Reading order as queries: neighbours, spreads, geometry, name collisions, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def neighbours(pages: DataFrame, book: str, position: str, page: str, rtl: bool = False) -> DataFrame:
    """Each page with index, previous, next, first and last page of its book in reading order."""
    w = Window.partitionBy(book).orderBy(F.desc(position) if rtl else F.asc(position), page)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return pages.select(book, page, (F.row_number().over(w) - 1).alias("index"), F.lag(page).over(w).alias("previous"), F.lead(page).over(w).alias("next"), F.first(page).over(whole).alias("first"), F.last(page).over(whole).alias("last"))


def spreads(pages: DataFrame, book: str, position: str, side: str, single: str) -> DataFrame:
    """(book, first, second): the first page alone, then neighbours in pairs where they may.

    A page that is single or centred stands alone; two pages that declare the
    same side do not pair. A fold over the book's pages.
    """
    item = F.struct(F.col(position).alias("at"), F.col(side).alias("side"), F.coalesce(F.col(single), F.lit(False)).alias("single"))
    books = pages.groupBy(book).agg(F.array_sort(F.collect_list(item)).alias("pages"))
    start = F.struct(F.array().cast("array<struct<first:bigint,second:bigint>>").alias("out"), F.lit(None).cast("struct<at:bigint,side:string>").alias("held"), F.lit(0).alias("i"))

    def pair(first: Column, second: Column | None) -> Column:
        return F.array(F.struct(first.cast("long").alias("first"), (F.lit(None) if second is None else second).cast("long").alias("second")))

    def add(s: Column, p: Column) -> Column:
        alone = (s["i"] == 0) | p["single"] | F.coalesce(p["side"] == "center", F.lit(False))
        fits = s["held"].isNotNull() & ~alone & ~F.coalesce(s["held"]["side"] == p["side"], F.lit(False))
        flushed = F.when(s["held"].isNotNull(), F.concat(s["out"], pair(s["held"]["at"], None))).otherwise(s["out"])
        now = F.struct(p["at"].cast("long").alias("at"), p["side"].alias("side"))
        none = F.lit(None).cast("struct<at:bigint,side:string>")
        out = F.when(fits, F.concat(s["out"], pair(s["held"]["at"], p["at"]))).when(alone, F.concat(flushed, pair(p["at"], None))).otherwise(flushed)
        return F.struct(out.alias("out"), F.when(fits | alone, none).otherwise(now).alias("held"), (s["i"] + 1).alias("i"))

    folded = F.aggregate("pages", start, add, lambda s: F.when(s["held"].isNotNull(), F.concat(s["out"], pair(s["held"]["at"], None))).otherwise(s["out"]))
    return books.select(book, F.explode(folded).alias("s")).select(book, "s.first", "s.second")


def fitted(width: Column, height: Column, room: tuple[float, float], fill: bool = False) -> Column:
    """struct<scale, x, y>: a page in a viewport, whole and centred, or filling it; null without a size."""
    sx, sy = F.lit(room[0]) / width, F.lit(room[1]) / height
    scale = F.greatest(sx, sy) if fill else F.least(sx, sy)
    made = F.struct(scale.alias("scale"), ((room[0] - width * scale) / 2).alias("x"), ((room[1] - height * scale) / 2).alias("y"))
    return F.when((width > 0) & (height > 0), made)


def collision_free(names: DataFrame, path: str, order: str) -> DataFrame:
    """``names`` with ``output``: repeated paths get -1, -2 ... before the extension, in a given order."""
    place = F.row_number().over(Window.partitionBy(path).orderBy(order)) - 1
    numbered = F.concat(F.regexp_replace(path, r"(\.[^./]*)?$", ""), F.lit("-"), "place", F.regexp_extract(path, r"(\.[^./]*)$", 1))
    return names.withColumn("place", place).withColumn("output", F.when(F.col("place") == 0, F.col(path)).otherwise(numbered)).drop("place")


def retained(jobs: DataFrame, now: Column, finished: str = "finished_at", job: str = "job_id", hours: int = 24, most: int = 128) -> DataFrame:
    """Finished jobs that stay: younger than ``hours``, the latest ``most`` of them (a bounded top-k)."""
    return jobs.where(F.col(finished) > now - F.expr(f"INTERVAL {hours} HOURS")).orderBy(F.desc(finished), job).limit(most)
