"""Registered queries: validation and edits, over line items as the parts of books.

An order is a book, its lines are the documents; faults are put in by rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.operators import edits, links, styles, validation
from vellumine.plans.text import read, spread


#: Lines of a task where each says some twenty things of its book.
TASK_LINES = 100_000


def _tables(spark: SparkSession, sf_dir: str) -> validation.BookTables:
    line = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("book_id"), F.col("l_linenumber").cast("long").alias("n"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.col("l_returnflag").alias("flag"))
    # every table is made of lines that stand with their book: what they say is not shuffled
    line = line.repartition(max(spark.sparkContext.defaultParallelism, line.count() // TASK_LINES), "book_id")
    n, p, s = F.col("n"), F.col("p"), F.col("s")
    pages = F.concat(F.lit("c"), n + F.when(p % 4 == 0, 3).otherwise(0), F.lit(".xhtml"))
    node = F.explode(F.array(n * 10, n * 10 + F.when(p % 31 == 0, 0).otherwise(1))).alias("node_id")
    nodes = line.select("book_id", n.alias("document_id"), node, F.when(F.col("flag") == "R", "image").when(F.col("flag") == "A", "svg").otherwise("link").alias("kind"), (n % 5).alias("style_id"), F.when(s % 2 == 0, s % 8).alias("resource_id"), F.when(p % 7 == 0, "").otherwise("c1.xhtml").alias("href"))
    return validation.BookTables(
        resources=line.select("book_id", (n - 1).alias("position"), F.when(p % 17 == 0, 0).otherwise(n - 1).alias("resource_id"), F.when(F.col("flag") == "A", "font").otherwise("image").alias("kind")),
        fonts=line.where("p % 3 = 0").select("book_id", F.when(s % 10 == 0, " ").otherwise(F.concat(F.lit("Face "), s)).alias("family"), (s % 8).alias("resource_id")),
        anchors=line.select("book_id", n.alias("position"), F.when(p % 29 == 0, n + 100).otherwise(n).alias("document_id"), F.concat(F.lit("a"), s % 5).alias("name"), (n * 10 + p % 3).alias("node_id")),
        documents=line.select("book_id", n.alias("document_id"), F.concat(F.lit("c"), n, F.lit(".xhtml")).alias("href")),
        nodes=nodes.withColumn("position", F.col("node_id")),
        variants=line.where("p % 5 = 0").select("book_id", (n * 10).alias("node_id"), F.lit("kf7").alias("target"), (s % 6).alias("style_id")),
        styles=line.select("book_id").distinct().select("book_id", F.explode(F.array(*[F.lit(k).cast("long") for k in range(4)])).alias("style_id")),
        links=line.select("book_id", F.when(p % 3 == 0, "edge").when(p % 3 == 1, "navigation").otherwise("start").alias("origin"), F.when(s % 13 == 0, "mailto:x@y.z").otherwise(F.concat(pages, F.lit("#a"), s % 7)).alias("href")),
    )


def book_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every diagnostic of every book."""
    return validation.diagnostics(_tables(spark, sf_dir))


_FAULTS = """l AS (SELECT l_orderkey AS b, l_linenumber::BIGINT AS n, l_partkey AS p, l_suppkey AS s, l_returnflag AS flag FROM lineitem),
res AS (SELECT b, n - 1 AS position, CASE WHEN p % 17 = 0 THEN 0 ELSE n - 1 END AS id, CASE WHEN flag = 'A' THEN 'font' ELSE 'image' END AS kind FROM l),
fonts AS (SELECT b, CASE WHEN s % 10 = 0 THEN ' ' ELSE 'Face ' || s END AS family, s % 8 AS id FROM l WHERE p % 3 = 0),
anchors AS (SELECT b, n AS position, CASE WHEN p % 29 = 0 THEN n + 100 ELSE n END AS d, 'a' || (s % 5) AS name, n * 10 + p % 3 AS node FROM l),
docs AS (SELECT b, n AS d, 'c' || n || '.xhtml' AS href FROM l),
nodes AS (SELECT b, n AS d, unnest([n * 10, n * 10 + CASE WHEN p % 31 = 0 THEN 0 ELSE 1 END]) AS node, CASE flag WHEN 'R' THEN 'image' WHEN 'A' THEN 'svg' ELSE 'link' END AS kind, n % 5 AS style, CASE WHEN s % 2 = 0 THEN s % 8 END AS id, CASE WHEN p % 7 = 0 THEN '' ELSE 'c1.xhtml' END AS href FROM l),
links AS (SELECT b, CASE p % 3 WHEN 0 THEN 'edge' WHEN 1 THEN 'navigation' ELSE 'start' END AS origin, CASE WHEN s % 13 = 0 THEN 'mailto:x@y.z' ELSE 'c' || (n + CASE WHEN p % 4 = 0 THEN 3 ELSE 0 END) || '.xhtml#a' || (s % 7) END AS href FROM l),
faults AS (
SELECT b AS book_id, 'RES-0001' AS code, 'error' AS severity, id::VARCHAR AS subject FROM (SELECT *, row_number() OVER (PARTITION BY b, id ORDER BY position) AS k FROM res) WHERE k > 1 OR id <> position
UNION ALL SELECT b, 'FONT-0001', 'error', family FROM fonts f WHERE NOT EXISTS (SELECT 1 FROM res r WHERE r.b = f.b AND r.id = f.id AND kind = 'font')
UNION ALL SELECT b, 'FONT-0002', 'error', family FROM fonts WHERE trim(family) = ''
UNION ALL SELECT b, 'ANCHOR-0001', 'error', name FROM (SELECT *, row_number() OVER (PARTITION BY b, d, name ORDER BY position) AS k FROM anchors) WHERE k > 1
UNION ALL SELECT b, 'ANCHOR-0002', 'error', name FROM anchors a WHERE NOT EXISTS (SELECT 1 FROM docs x WHERE x.b = a.b AND x.d = a.d)
UNION ALL SELECT b, 'ANCHOR-0003', 'error', name FROM anchors a WHERE NOT EXISTS (SELECT 1 FROM nodes x WHERE x.b = a.b AND x.d = a.d AND x.node = a.node)
UNION ALL SELECT b, 'NODE-0001', 'error', node::VARCHAR FROM (SELECT *, row_number() OVER (PARTITION BY b, node) AS k FROM nodes) WHERE k > 1
UNION ALL SELECT b, 'STYLE-0001', 'error', node::VARCHAR FROM nodes WHERE style > 3
UNION ALL SELECT b, 'STYLE-0002', 'error', (n * 10) || ':kf7' FROM l WHERE p % 5 = 0 AND s % 6 > 3
UNION ALL SELECT b, CASE kind WHEN 'image' THEN 'RES-0002' ELSE 'RES-0003' END, 'error', node::VARCHAR FROM nodes x WHERE kind <> 'link' AND id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM res r WHERE r.b = x.b AND r.id = x.id)
UNION ALL SELECT b, 'LINK-0001', 'warning', node::VARCHAR FROM nodes WHERE kind = 'link' AND href = ''
UNION ALL SELECT b, CASE origin WHEN 'navigation' THEN 'NAV-0001' ELSE 'EDGE-0001' END, 'warning', href FROM links k WHERE (origin = 'navigation' OR href NOT LIKE 'mailto:%') AND NOT EXISTS (SELECT 1 FROM docs x WHERE x.b = k.b AND x.href = split_part(k.href, '#', 1))
UNION ALL SELECT b, 'EDGE-0002', 'warning', href FROM links k WHERE origin = 'edge' AND contains(href, '#') AND NOT EXISTS (SELECT 1 FROM anchors a WHERE a.b = k.b AND a.name = split_part(k.href, '#', 2)))"""
BOOK_FAULTS = f"WITH {_FAULTS} SELECT * FROM faults"


def book_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors and warnings of each book, and whether it is valid."""
    books = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("book_id"))
    return validation.verdicts(books, book_faults(spark, sf_dir))


BOOK_VERDICTS = f"""WITH {_FAULTS} SELECT o_orderkey AS book_id, count(*) FILTER (WHERE severity = 'error') AS n_errors, count(*) FILTER (WHERE severity = 'warning') AS n_warnings, count(*) FILTER (WHERE severity = 'error') = 0 AS is_valid
FROM orders LEFT JOIN faults ON book_id = o_orderkey GROUP BY 1"""


def edited_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as books: fields set, cleared under either name, and left alone."""
    c = read(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    books = c.select(k.alias("book_id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("series"), F.array("c_name").alias("authors"), F.array("c_mktsegment", F.lit("x")).alias("subjects"))
    clear = F.when(k % 5 == 0, F.array(F.lit("creators"), F.lit("title"))).when(k % 5 == 1, F.array(F.lit("series"), F.lit("nothing"))).otherwise(F.array().cast("array<string>"))
    plan = c.where("c_custkey % 3 <> 2").select(k.alias("book_id"), F.when(k % 3 == 0, F.concat(F.lit("New "), k)).alias("title"), F.when(k % 2 == 0, F.array(F.lit("A"), F.lit("B"))).alias("authors"), clear.alias("clear"))
    made = edits.edited_metadata(books, plan)
    return made.select("book_id", "title", "series", F.array_join("authors", ";").alias("authors"), F.array_join("subjects", ";").alias("subjects"))


EDITED_BOOKS = """WITH e AS (SELECT *, c_custkey AS k, c_custkey % 3 <> 2 AS has FROM customer)
SELECT k AS book_id, CASE WHEN has AND k % 5 = 0 THEN NULL WHEN has AND k % 3 = 0 THEN 'New ' || k ELSE c_name END AS title, CASE WHEN has AND k % 5 = 1 THEN NULL ELSE c_mktsegment END AS series,
CASE WHEN has AND k % 5 = 0 THEN '' WHEN has AND k % 2 = 0 THEN 'A;B' ELSE c_name END AS authors, c_mktsegment || ';x' AS subjects FROM e"""


def edited_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of books put in a new order: every line of an even part first, from the last; and relabelled."""
    line = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("book_id"), F.col("l_linenumber").cast("long").alias("n")).agg(F.min("l_partkey").alias("p"))
    docs = line.select("book_id", F.col("n").alias("document_id"), F.col("n").alias("position"), F.concat(F.lit("c"), "n").alias("href"), F.concat(F.lit("Part "), F.col("p") % 10).alias("label"))
    order = line.where("p % 2 = 0").select("book_id", (-F.col("n")).alias("place"), F.col("n").alias("document_id"))
    order = order.unionByName(line.where("p % 11 = 0").select("book_id", F.lit(99).cast("long").alias("place"), (F.col("n") + 50).alias("document_id")))
    renamed = F.array(*[F.struct(F.lit(old).alias("old"), F.lit(new).alias("new")) for old, new in (("c1", "First"), ("Part 3", "Third"))])
    labels = line.where("n = 1").select("book_id", F.inline(renamed))
    return edits.relabelled(edits.reordered(docs, order), labels).select("book_id", "document_id", "position", "label")


EDITED_ORDER = """WITH l AS (SELECT l_orderkey AS b, l_linenumber::BIGINT AS n, min(l_partkey) AS p FROM lineitem GROUP BY ALL)
SELECT b AS book_id, n AS document_id, row_number() OVER (PARTITION BY b ORDER BY p % 2, CASE WHEN p % 2 = 0 THEN -n ELSE n END) - 1 AS position,
CASE WHEN NOT one THEN 'Part ' || (p % 10) WHEN n = 1 THEN 'First' WHEN p % 10 = 3 THEN 'Third' ELSE 'Part ' || (p % 10) END AS label
FROM (SELECT *, bool_or(n = 1) OVER (PARTITION BY b) AS one FROM l)"""

def navigation_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where links of every kind lead in books whose documents and anchors may be there twice."""
    line = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("book_id"), F.col("l_linenumber").cast("long").alias("n"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"))
    n, p, s = F.col("n"), F.col("p"), F.col("s")
    path = F.concat(F.lit("c"), n, F.lit(".xhtml"))
    href = F.when(p % 11 == 0, " ").when(p % 11 == 1, "mailto:x").when(p % 11 == 2, "#a1").when(p % 11 == 3, "zz.xhtml#a").otherwise(F.concat(path, F.when(p % 3 == 0, "").otherwise(F.concat(F.lit("#a"), s % 5))))
    documents = line.select("book_id", n.alias("document_id"), path.alias("href"))
    anchors = line.select("book_id", n.alias("document_id"), F.concat(F.lit("a"), s % 5).alias("name"), (n * 10 + p % 3).alias("node_id"))
    nodes = line.select("book_id", n.alias("document_id"), F.explode(F.array(n * 10, n * 10 + 1)).alias("node_id"))
    made = links.navigation_targets(line.select("book_id", n.alias("n"), href.alias("href")), documents, anchors, nodes)
    return made.groupBy("book_id", "n", "href", "document_id", "node_id", "reason").agg(F.count("*").alias("n_points"))


NAVIGATION_TARGETS = """WITH l AS (SELECT l_orderkey AS b, l_linenumber::BIGINT AS n, l_partkey AS p, l_suppkey AS s FROM lineitem),
h AS (SELECT *, CASE p % 11 WHEN 0 THEN ' ' WHEN 1 THEN 'mailto:x' WHEN 2 THEN '#a1' WHEN 3 THEN 'zz.xhtml#a' ELSE 'c' || n || '.xhtml' || CASE WHEN p % 3 = 0 THEN '' ELSE '#a' || (s % 5) END END AS href FROM l),
d AS (SELECT b, n, count(*) AS docs FROM l GROUP BY ALL), a AS (SELECT b, n, 'a' || (s % 5) AS name, count(*) AS marks, min(n * 10 + p % 3) AS node FROM l WHERE p % 3 < 2 GROUP BY ALL),
r AS (SELECT h.b AS book_id, h.n, href, node, CASE WHEN p % 11 = 0 THEN 'empty_target' WHEN p % 11 = 1 THEN 'external_target' WHEN p % 11 = 2 THEN 'missing_document_context' WHEN p % 11 = 3 THEN 'document_not_found' WHEN docs > 1 THEN 'ambiguous_document'
  WHEN p % 3 = 0 THEN NULL WHEN marks IS NULL THEN 'anchor_not_found' WHEN marks > 1 THEN 'ambiguous_anchor' END AS reason, p % 3 = 0 AS plain FROM h JOIN d USING (b, n) LEFT JOIN a ON a.b = h.b AND a.n = h.n AND a.name = 'a' || (h.s % 5))
SELECT book_id, n, href, CASE WHEN reason IS NULL THEN n END AS document_id, CASE WHEN reason IS NULL AND NOT plain THEN node END AS node_id, reason, count(*) AS n_points FROM r GROUP BY ALL"""


_CSS = """@supports (display: grid) { p { color: red } } @keyframes k { from { top: 0 } } p.big::before, q { content: "}"; quotes: none } /* base { color: red } */ p { color: black; margin: 0  auto; --own: 1 } .big, #k7 { font-size: 2em; color: blue }
@media amzn-kf8 { p.big { color: green } } @media amzn-mobi { p { color: grey } } div > p.big.odd { font-weight: bold } * { line-height: 1.2 } @font-face { font-family: x } h1 { color: navy; color: teal }"""


def computed_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet's cascade over parts as elements, for one target."""
    part = spread(read(spark, sf_dir, "part"))
    k = F.col("p_partkey")
    classes = F.array_compact(F.array(F.when(k % 3 == 0, "big"), F.when(k % 2 == 1, "odd")))
    inline = F.when(k % 10 == 9, F.lit("color: white; MARGIN: 1px"))
    elements = part.select(F.lit(1).cast("long").alias("book_id"), k.alias("node_id"), F.when(k % 4 == 0, "h1").otherwise("p").alias("tag"), F.concat(F.lit("k"), k % 50).alias("id"), classes.alias("classes"), inline.alias("inline"))
    sheet = spark.range(1).select(F.lit(1).cast("long").alias("book_id"), F.lit(0).alias("position"), F.lit(_CSS).alias("css"))
    return styles.computed(elements, styles.rules(sheet, "kf8")).select("node_id", "property", "value")


COMPUTED_STYLES = """WITH e AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 4 = 0 THEN 'h1' ELSE 'p' END AS tag, p_partkey % 3 = 0 AS big, p_partkey % 2 = 1 AS odd, p_partkey % 50 = 7 AS seven, p_partkey % 10 = 9 AS own FROM part),
v AS (SELECT k AS node_id, unnest([{'p': 'color', 'v': CASE WHEN own THEN 'white' WHEN seven THEN 'blue' WHEN big AND tag = 'p' THEN 'green' WHEN big THEN 'blue' WHEN tag = 'p' THEN 'black' ELSE 'teal' END},
{'p': 'margin', 'v': CASE WHEN own THEN '1px' WHEN tag = 'p' THEN '0 auto' END}, {'p': 'font-size', 'v': CASE WHEN big OR seven THEN '2em' END}, {'p': 'font-weight', 'v': CASE WHEN tag = 'p' AND big AND odd THEN 'bold' END}, {'p': 'line-height', 'v': '1.2'},
{'p': 'content', 'v': CASE WHEN tag = 'p' AND big THEN '"}"' END}, {'p': 'quotes', 'v': CASE WHEN tag = 'p' AND big THEN 'none' END}]) AS x FROM e)
SELECT node_id, x.p AS property, x.v AS value FROM v WHERE x.v IS NOT NULL"""

_ALL = (book_faults, book_verdicts, edited_books, edited_order, navigation_targets, computed_styles)
QUERIES = {f.__name__: f for f in _ALL}
SQL = {name: globals()[name.upper()] for name in QUERIES}
