"""Registered queries: books of several files, made of the pages by eights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.operators import bookfiles
from vellumine.plans.text import read


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(book_id, path, text): the pages as documents with images, for some books an index or a manifest that is right, short or wrong."""
    pages = read(spark, sf_dir, "pages").select(F.expr("page_id div 8").alias("book_id"), "page_id", F.format_string("text/p%06d.html", "page_id").alias("path"), "html")
    k = F.col("page_id").cast("string")
    body = F.concat("html", F.lit('<img src="../img/a'), k, F.lit('.png?v=1"><img src="//far/x.png"><img src="#top"><style>p{background:url(gone.gif)}</style>'))
    docs = pages.select("book_id", "path", body.alias("text"))
    images = pages.where("page_id % 2 = 0").select("book_id", F.concat(F.lit("img/a"), k, F.lit(".png")).alias("path"), F.lit(None).cast("string").alias("text"))
    extra = pages.where("page_id % 8 = 0").select("book_id", F.lit("img/unused.css").alias("path"), F.lit("p{}").alias("text"))
    down = F.reverse(F.array_sort(F.collect_list(F.struct("page_id", "path"))))
    books = pages.groupBy("book_id").agg(down.alias("d"))
    links = F.array_join(F.transform(F.filter("d", lambda x: x["page_id"] % 2 == 0), lambda x: F.concat(F.lit('<a href="'), x["path"], F.lit('#a"><a href="http://x/y.html"><a href="'), x["path"], F.lit('?b">'))), "")
    index = books.where("book_id % 4 = 1").select("book_id", F.lit("index.html").alias("path"), links.alias("text"))
    listed = F.array_join(F.transform(F.filter("d", lambda x: x["page_id"] % 3 != 0), lambda x: x["path"]), "\n")
    wrong = F.when(F.col("book_id") % 8 == 7, F.lit("\n../out.html\nnothing.html")).otherwise("")
    manifest = books.where("book_id % 4 >= 2").select("book_id", F.lit("manifest.txt").alias("path"), F.concat(F.lit("# order\n\n"), listed, wrong).alias("text"))
    return docs.unionByName(images).unionByName(extra).unionByName(index).unionByName(manifest)


def html_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the books in order, and how each book is ordered."""
    placed, told = bookfiles.ordered_documents(_files(spark, sf_dir))
    return told.join(placed, "book_id", "left").select("book_id", "order", "error", "path", "place")


_P = "p AS (SELECT page_id // 8 AS book_id, page_id, 'text/p' || lpad(page_id::VARCHAR, 6, '0') || '.html' AS path FROM pages)"
HTML_ORDER = f"""WITH {_P}, n AS (SELECT book_id, count(*) AS n, count(*) FILTER (WHERE page_id % 3 <> 0) AS listed FROM p GROUP BY 1),
r AS (SELECT book_id, path, CASE WHEN book_id % 4 = 1 AND page_id % 2 = 0 THEN -page_id WHEN book_id % 4 >= 2 AND page_id % 3 <> 0 THEN -page_id END AS rank FROM p UNION ALL SELECT book_id, 'index.html', -1e12 FROM n WHERE book_id % 4 = 1),
o AS (SELECT book_id, path, row_number() OVER (PARTITION BY book_id ORDER BY rank NULLS LAST, path) - 1 AS place FROM r)
SELECT n.book_id, CASE WHEN n.book_id % 8 = 7 THEN NULL WHEN n.book_id % 4 >= 2 THEN CASE WHEN listed < n THEN 'manifest_incomplete' ELSE 'manifest' END WHEN n.book_id % 4 = 1 THEN 'index_links' WHEN n < 2 THEN 'single' ELSE 'paths' END AS "order",
CASE WHEN n.book_id % 8 = 7 THEN 'unsafe_path:' || (listed + 3) END AS error, path, place::INTEGER AS place FROM n LEFT JOIN o ON o.book_id = n.book_id AND n.book_id % 8 <> 7"""


def html_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resources of the books, and references that were left."""
    files = _files(spark, sf_dir)
    placed, _ = bookfiles.ordered_documents(files)
    found, left = bookfiles.resources(files, placed)
    taken = found.select("book_id", F.when(F.col("referenced"), "referenced").otherwise("unused").alias("outcome"), "path")
    return taken.unionByName(left.select("book_id", F.col("reason").alias("outcome"), F.col("subject").alias("path")))


HTML_RESOURCES = f"""WITH {_P}, g AS (SELECT * FROM p WHERE book_id % 8 <> 7)
SELECT book_id, CASE WHEN book_id % 8 <> 7 THEN 'referenced' ELSE 'unused' END AS outcome, 'img/a' || page_id || '.png' AS path FROM p WHERE page_id % 2 = 0 UNION ALL SELECT book_id, 'unused', 'img/unused.css' FROM p WHERE page_id % 8 = 0
UNION ALL SELECT book_id, 'not_found', 'img/a' || page_id || '.png' FROM g WHERE page_id % 2 = 1 UNION ALL SELECT DISTINCT book_id, 'not_found', 'text/gone.gif' FROM g UNION ALL SELECT DISTINCT book_id, 'remote', '//far/x.png' FROM g"""

QUERIES = {f.__name__: f for f in (html_order, html_resources)}
SQL = {"html_order": HTML_ORDER, "html_resources": HTML_RESOURCES}
