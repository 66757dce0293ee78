"""Registered queries: trees of books: contents from parent places, inherited styles, text and ruby, plans and lowered nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellumine.operators import compat, markup, projection, styles, trees
from vellumine.plans.text import read, spread


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(book_id, place, l_partkey): the orders' items in order, dealt out once by the name that later steps know the book by."""
    place = F.row_number().over(Window.partitionBy("book_id").orderBy("l_linenumber", "l_partkey")) - 1
    items = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("book_id"), "l_linenumber", "l_partkey")
    return items.select("book_id", place.cast("long").alias("place"), "l_partkey")


def contents_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of contents of the orders' items: parents from other columns, some missing, some in circles."""
    points = _items(spark, sf_dir).select("book_id", "place", (F.col("l_partkey") % 9 - 1).alias("parent"))
    made = trees.rebuilt(points)
    return made.select("book_id", "place", "parent", "under", F.array_join("path", ".").alias("path"), "n_below")


CONTENTS_TREE = """WITH RECURSIVE p AS (SELECT l_orderkey AS book_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS place, l_partkey % 9 - 1 AS parent FROM lineitem),
chain AS (SELECT book_id, place, parent AS at, 1 AS steps FROM p UNION ALL SELECT c.book_id, c.place, p.parent, steps + 1 FROM chain c JOIN p ON p.book_id = c.book_id AND p.place = c.at WHERE steps < 10),
told AS (SELECT c.book_id, c.place, bool_or(c.at = -1) AS topped, min(CASE WHEN q.place IS NOT NULL THEN c.at END) AS least FROM chain c LEFT JOIN p q ON q.book_id = c.book_id AND q.place = c.at GROUP BY ALL),
u AS (SELECT p.book_id, p.place, p.parent, p.parent = -1 AS first, CASE WHEN p.parent = -1 OR (NOT topped AND (least IS NULL OR least >= p.place)) THEN NULL ELSE p.parent END AS under FROM p JOIN told USING (book_id, place)),
o AS (SELECT *, row_number() OVER (PARTITION BY book_id, under ORDER BY first DESC, place) - 1 AS ordinal FROM u),
t AS (SELECT book_id, place, ordinal::VARCHAR AS path FROM o WHERE under IS NULL UNION ALL SELECT o.book_id, o.place, t.path || '.' || o.ordinal FROM t JOIN o ON o.book_id = t.book_id AND o.under = t.place)
SELECT o.book_id, o.place, o.parent, o.under, t.path, (SELECT count(*) FROM t b WHERE b.book_id = o.book_id AND starts_with(b.path, t.path || '.')) AS n_below FROM o JOIN t USING (book_id, place)"""


def contents_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points by their path, the first below each top point and one that is not there."""
    points = _items(spark, sf_dir).select("book_id", "place", F.when(F.col("place") > 2, F.lit(1)).otherwise(-1).cast("long").alias("parent"))
    # each book has one first point: no distinct ids are shuffled beside the points
    wanted = points.where("place = 0").select("book_id", F.explode(F.array(F.array(F.lit(1)), F.array(F.lit(1), F.lit(0)), F.array(F.lit(9)))).alias("path"))
    return trees.at_path(trees.rebuilt(points), wanted).select("book_id", F.array_join("path", ".").alias("path"), "place")


CONTENTS_LOOKUPS = """WITH p AS (SELECT l_orderkey AS book_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS place FROM lineitem),
b AS (SELECT book_id, max(CASE WHEN place = 1 THEN 1 END) AS second, min(CASE WHEN place > 2 THEN place END) AS below FROM p GROUP BY book_id)
SELECT book_id, path, CASE path WHEN '1' THEN second WHEN '1.0' THEN below END::BIGINT AS place FROM b, (VALUES ('1'), ('1.0'), ('9')) AS w(path)"""


def inherited_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many elements have which value of which property, where customers hold orders and orders hold items."""
    c, o, i = (read(spark, sf_dir, t) for t in ("customer", "orders", "lineitem"))
    long = lambda x: F.expr(x).cast("long")
    whole = c.select(long("c_custkey * 10").alias("node_id"), F.lit(None).cast("long").alias("parent_id"), F.lit("section").alias("tag"), F.expr("map('color', if(c_custkey % 4 = 0, concat('c', c_custkey % 3), null), 'text-align', if(c_custkey % 5 = 0, 'left', null), 'margin', '1px')").alias("own"))
    parts = o.select(long("o_orderkey * 10 + 1").alias("node_id"), long("o_custkey * 10").alias("parent_id"), F.expr("if(o_orderkey % 6 = 0, 'h1', 'div')").alias("tag"), F.expr("map('font-weight', if(o_orderkey % 5 = 0, 'w', null), 'color', if(o_orderkey % 7 = 0, 'o', null), 'margin', if(o_orderkey % 2 = 0, '2px', null))").alias("own"))
    i = i.withColumn("k", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")))
    items = i.select(long("(l_orderkey * 1000 + k) * 10 + 2").alias("node_id"), long("l_orderkey * 10 + 1").alias("parent_id"), F.expr("if(l_linenumber % 2 = 0, 'em', 'p')").alias("tag"), F.expr("map('color', if(l_linenumber = 3, 'l', null), 'display', if(l_linenumber = 2, 'none', null))").alias("own"))
    tree = whole.unionByName(parts).unionByName(items).withColumn("book_id", F.lit(1).cast("long"))
    return styles.inherited(tree).groupBy("property", "value").agg(F.count("*").alias("n"))


INHERITED_STYLES = """WITH c AS (SELECT c_custkey AS k, CASE WHEN k % 4 = 0 THEN 'c' || k % 3 END AS color, CASE WHEN k % 5 = 0 THEN 'left' END AS align FROM customer),
o AS (SELECT o_orderkey AS k, o_custkey AS up, CASE WHEN o_orderkey % 5 = 0 THEN 'w' END AS weight, CASE WHEN o_orderkey % 7 = 0 THEN 'o' END AS color FROM orders),
all_ AS (SELECT 'section' AS tag, color, align, NULL AS weight, '1px' AS margin, 'block' AS display FROM c
UNION ALL SELECT '', coalesce(o.color, c.color), align, weight, CASE WHEN o.k % 2 = 0 THEN '2px' END, 'block' FROM o JOIN c ON c.k = o.up
UNION ALL SELECT '', coalesce(CASE WHEN l_linenumber = 3 THEN 'l' END, o.color, c.color), align, weight, NULL, CASE WHEN l_linenumber = 2 THEN 'none' WHEN l_linenumber % 2 = 0 THEN 'inline' ELSE 'block' END FROM lineitem JOIN o ON o.k = l_orderkey JOIN c ON c.k = o.up),
v AS (SELECT unnest([{'p': 'color', 'v': coalesce(color, '#000000')}, {'p': 'text-align', 'v': align}, {'p': 'font-weight', 'v': coalesce(weight, 'normal')}, {'p': 'margin', 'v': margin}, {'p': 'display', 'v': display}, {'p': 'direction', 'v': 'ltr'},
{'p': 'font-size', 'v': '1em'}, {'p': 'font-style', 'v': 'normal'}, {'p': 'line-height', 'v': 'normal'}, {'p': 'visibility', 'v': 'visible'}, {'p': 'white-space', 'v': 'normal'}, {'p': 'writing-mode', 'v': 'horizontal-tb'}]) AS x FROM all_)
SELECT x.p AS property, x.v AS value, count(*) AS n FROM v WHERE x.v IS NOT NULL GROUP BY ALL"""


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small pages about the parts, with what targets differ in."""
    k, name = F.col("p_partkey").cast("string"), F.col("p_name")
    ruby = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("<ruby>ba"), k, F.lit("<rp>(</rp><rt>an<b>no</b></rt><rp>)</rp></ruby>"))).otherwise("")
    svg = F.when(F.col("p_size") % 3 == 0, '<svg aria-label="drawn"></svg>').when(F.col("p_size") % 3 == 1, "<svg></svg>").otherwise("")
    table = F.when(F.col("p_size") % 5 == 0, "<table><tr><td>c</td></tr></table>").otherwise("")
    html = F.concat(F.lit("<html><head><title>no</title></head><body><h1>"), name, F.lit("</h1><p>one "), ruby, F.lit(' two<br>three<a epub:type="footnote" href="#n">1</a></p><hr>'), svg, table, F.lit('<p>end <math alttext="x"><mi>x</mi></math></p><script>no</script></body></html>'))
    return spread(read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")).select(F.col("p_partkey").alias("page_id"), html.alias("html"))


def _flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection.whole_formulas(projection.with_kinds(markup.nodes(_marked(spark, sf_dir), spaced=True)))


def visible_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of the pages with and without regard to ruby, and their rubies."""
    return projection.reading_texts(_flow(spark, sf_dir))


VISIBLE_TEXTS = """WITH t AS (SELECT p_partkey AS page_id, CASE WHEN p_size % 2 = 0 THEN 'ba' || p_partkey END AS base,
p_name || chr(10) || 'one ' AS a, CASE WHEN p_size % 2 = 0 THEN ' two' ELSE 'two' END || chr(10) || 'three1' || chr(10) || chr(10) || CASE WHEN p_size % 3 = 0 THEN 'drawn' ELSE '' END || CASE WHEN p_size % 5 = 0 THEN 'c' ELSE '' END || 'end x' || chr(10) || chr(10) AS z FROM part)
SELECT page_id, a || coalesce(base || '(' || chr(10) || 'anno)' || chr(10), '') || z AS text, a || coalesce(base || 'anno', '') || z AS visible, base, CASE WHEN base IS NOT NULL THEN 'anno' END AS annotation FROM t"""


def _roled(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.when(F.col("tag") == "#text", "Text").otherwise(markup.role())
    return _flow(spark, sf_dir).withColumns({"role": role, "resource_kind": F.lit(None).cast("string")})


def compatibility_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the oldest target makes of the pages' nodes, counted by choice."""
    made = projection.planned(projection.requests(_roled(spark, sf_dir)), "KF7", "strict")
    by = ["feature", "source", "level", "quality", "fallback", "reason", F.array_join("alternatives", "; ").alias("alternatives"), "code", "severity", "allowed"]
    return made.groupBy(*by).agg(F.count("*").alias("n"))


_CHOICES = [
    ("Heading", "semantic heading", "Native", 0, "native target representation", "target natively expresses the semantic feature", "", "count(*)"),
    ("Text", "text content", "Native", 0, "native target representation", "target natively expresses the semantic feature", "", "sum(7 + 6 * (p_size % 2 = 0)::INT + (p_size % 5 = 0)::INT)"),
    ("PageBreak", "page break", "Native", 0, "native target representation", "target natively expresses the semantic feature", "", "sum(2)"),
    ("Footnote", "footnote relation", "Approximate", 2, "legacy linked note marker", "the target cannot retain every presentation detail, but a verified compatible form exists", "plain semantic text; note marker only", "count(*)"),
    ("Ruby", "ruby annotation", "Approximate", 2, "inline annotation approximation", "the target cannot retain every presentation detail, but a verified compatible form exists", "plain semantic text; base text only", "sum((p_size % 2 = 0)::INT)"),
    ("Math", "MathML expression", "Approximate", 2, "accessible mathematical text fallback", "the target cannot retain every presentation detail, but a verified compatible form exists", "plain semantic text; alt text only", "count(*)"),
    ("Image", "image", "Compatible", 1, "compatible target representation", "target representation differs internally but preserves reading meaning", "target-compatible visual approximation; semantic structural fallback; drop only as a last resort", "sum((p_size % 3 < 2)::INT)"),
    ("Svg", "inline SVG", "Approximate", 2, "accessible alt text fallback", "a deterministic rasterizer is not enabled, so the image meaning is retained through alt text", "deterministic raster image when a rasterizer is available; fallback image or alt text; drop only without readable fallback", "sum((p_size % 3 = 0)::INT)"),
    ("Svg", "inline SVG", "Approximate", 3, "deterministic accessible image placeholder", "the SVG has no alt text and a binary rasterizer is not enabled", "enable a future deterministic rasterizer; drop only without readable fallback", "sum((p_size % 3 = 1)::INT)"),
    ("ComplexTable", "table structure", "Flattenable", 3, "linearized rows and cells", "the target cannot express the original layout, so readable structure is retained", "simplified native layout; plain structured text", "sum(3 * (p_size % 5 = 0)::INT)"),
    ("SemanticStructure", "semantic structure", "Compatible", 1, "compatible target representation", "target representation differs internally but preserves reading meaning", "target-compatible visual approximation; semantic structural fallback; drop only as a last resort", "sum(1 + 4 * (p_size % 2 = 0)::INT)"),
]
COMPATIBILITY_ITEMS = " UNION ALL ".join(
    f"SELECT '{f}' AS feature, '{s}' AS source, '{level}' AS level, '{compat.OUTCOMES[r]}' AS quality, '{fb}' AS fallback, '{why}' AS reason, '{alt}' AS alternatives, '{'COMPAT-' + f.upper() + '-0001'}' AS code, 'Warning' AS severity, {'true' if r <= 1 else 'false'} AS allowed, ({n})::BIGINT AS n FROM part HAVING ({n}) > 0"
    for f, s, level, r, fb, why, alt, n in _CHOICES
)


def lowered_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages' nodes as the oldest target shows them, counted by kind, role, tag, text and link."""
    tree = _roled(spark, sf_dir).withColumnRenamed("page_id", "book_id").withColumns({"style_id": F.lit(0), "variants": F.array().cast("array<struct<target:string,style_id:int>>")})
    tabled = F.max((F.col("kind") == "Table") & (F.col("book_id") % 2 == 0)).over(Window.partitionBy("book_id"))
    return projection.lowered(tree, "KF7", tabled).groupBy("kind", "role", "tag", "text", "href").agg(F.count("*").alias("n"))


LOWERED_NODES = """WITH x AS (SELECT p_partkey, p_name, p_size % 2 = 0 AS ruby, p_size % 3 AS svg, p_size % 5 = 0 AS tabled, p_partkey % 2 = 0 AS even FROM part),
t AS (SELECT unnest([p_name, 'three', '1', 'end ']) AS text FROM x UNION ALL SELECT unnest(['one ', 'ba' || p_partkey, '(', 'an', 'no', ')', ' two']) FROM x WHERE ruby UNION ALL SELECT 'one two' FROM x WHERE NOT ruby UNION ALL SELECT 'c' FROM x WHERE tabled),
v AS (SELECT 'Text' AS kind, 'Text' AS role, '#text' AS tag, text, NULL AS href FROM t
UNION ALL SELECT kind, role, tag, NULL, NULL FROM x, (VALUES ('Section', 'Section', 'body'), ('Heading', 'Heading', 'h1'), ('Paragraph', 'Paragraph', 'p'), ('Paragraph', 'Paragraph', 'p'), ('PageBreak', 'PageBreak', 'hr')) AS t(kind, role, tag)
UNION ALL SELECT 'Text', 'PageBreak', 'br', chr(10), NULL FROM x
UNION ALL SELECT kind, role, tag, NULL, NULL FROM x, (VALUES ('GenericBlock', 'Generic', 'rp'), ('GenericBlock', 'Generic', 'rp'), ('GenericInline', 'Generic', 'rt'), ('Strong', 'Generic', 'b'), ('Inline', 'Ruby', 'ruby')) AS t(kind, role, tag) WHERE ruby
UNION ALL SELECT 'Text', 'Image', 'svg', CASE WHEN svg = 0 THEN 'drawn' ELSE '[SVG image]' END, NULL FROM x WHERE svg < 2
UNION ALL SELECT 'Text', 'Math', 'math', 'x', NULL FROM x UNION ALL SELECT 'Link', 'Footnote', 'a', NULL, '#n' FROM x
UNION ALL SELECT CASE WHEN even THEN 'GenericBlock' ELSE kind END, 'Table', CASE WHEN even THEN 'div' ELSE tag END, NULL, NULL FROM x, (VALUES ('Table', 'table'), ('TableRow', 'tr'), ('TableCell', 'td')) AS t(kind, tag) WHERE tabled)
SELECT kind, role, tag, text, href, count(*) AS n FROM v GROUP BY ALL"""


def lowered_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as books, their suppliers' styles as the oldest target keeps them, and the new id of each style."""
    s = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("book_id"), F.col("s_suppkey").alias("style_id"))
    k = F.col("style_id")
    family = F.when(k % 4 == 0, "Georgia, 'serif'").when(k % 4 == 1, 'Arial, "sans-serif", serif').otherwise("Fancy")
    each = F.array(F.struct(F.lit("font-family").alias("property"), family.alias("value")), F.struct(F.lit("position").alias("property"), (k % 2).cast("string").alias("value")), F.struct(F.lit("color").alias("property"), F.concat(F.lit("c"), k % 3).alias("value")))
    rows, ids = projection.lowered_styles(s.select("book_id", "style_id", F.inline(each)), "KF7")
    kept = rows.groupBy("book_id", "style_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "property", "value"))), ";").alias("style")).withColumnRenamed("style_id", "new_id")
    return ids.join(kept, ["book_id", "new_id"]).select("book_id", "style_id", "new_id", "style")


LOWERED_STYLES = """WITH s AS (SELECT s_nationkey AS book_id, s_suppkey AS style_id, 'color=c' || s_suppkey % 3 || ';font-family=' || CASE s_suppkey % 4 WHEN 0 THEN '''serif''' WHEN 1 THEN '"sans-serif"' ELSE 'serif' END AS style FROM supplier),
f AS (SELECT book_id, style, min(style_id) AS first FROM s GROUP BY ALL), d AS (SELECT book_id, style, dense_rank() OVER (PARTITION BY book_id ORDER BY first) - 1 AS new_id FROM f)
SELECT book_id, style_id, new_id::INTEGER AS new_id, style FROM s JOIN d USING (book_id, style)"""

_ALL = (contents_tree, contents_lookups, inherited_styles, visible_texts, compatibility_items, lowered_nodes, lowered_styles)
QUERIES = {f.__name__: f for f in _ALL}
SQL = {name: globals()[name.upper()] for name in QUERIES}
