"""Registered queries: FictionBook documents made of the customers. The SQL states what their parts have to give."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.operators import fb2
from vellumine.plans.text import read, spread
from vellumine.sources import xml


def _elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    document = F.expr(
        """concat('<?xml version="1.0"?><FictionBook xmlns:l="x"><description><title-info><genre>g', c_custkey % 3, '</genre><author><last-name>', c_name, '</last-name><first-name>A</first-name></author>',
        '<author><nickname>N</nickname></author><book-title> The\\n ', c_name, ' </book-title><annotation><p>x</p><p>y</p></annotation><keywords>k1, ,g0</keywords><date>d1</date><coverpage><image l:href="#c.png"/></coverpage>',
        '<lang>en</lang><sequence name="s" number="', c_custkey % 4, '.5"/></title-info>', if(c_custkey % 2 = 1, '<document-info><date>d2</date></document-info>', ''), '<publish-info><publisher>P</publisher><isbn>i', c_custkey, '</isbn></publish-info></description>',
        '<body><title><p>T</p></title><section id="s1"><title><p>S ', c_custkey, '</p></title><p id="p1">one <emphasis>two</emphasis> <a l:href="#n1">1</a><image l:href="#c.png"/>&amp;<code>a  b</code></p><empty-line/>',
        '<list><p>item</p></list><poem><stanza><v>line</v></stanza></poem><cite>bare text</cite><strange>odd</strange><annotation><p>no</p></annotation><image l:href="#no"/></section></body>',
        '<body name="Notes"><section id="n1"><p>note</p></section></body><binary id="c.png" content-type="image/PNG">aGVs\\nbG8=</binary><binary>x</binary><binary id="b">?</binary>', if(c_custkey % 10 = 9, '<open>', ''), '</FictionBook>')"""
    )
    books = spread(read(spark, sf_dir, "customer").select("c_custkey", "c_name")).select(F.col("c_custkey").alias("book_id"), document.alias("content"))
    return xml.elements(books)


def fb2_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the documents."""
    return fb2.nodes(_elements(spark, sf_dir)).drop("path")


_T = [
    (0, 0, "GenericInline", None, "p", None, None, None, None, None), (0, 1, "Text", None, None, "'T'", None, None, None, None), (0, 2, "Heading", 2, None, None, None, None, "Heading", None), (0, 3, "Section", None, None, None, None, None, "Section", None),
    (0, 4, "GenericInline", None, "p", None, None, None, None, None), (0, 5, "Text", None, None, "'S ' || c_custkey", None, None, None, None), (0, 6, "Heading", 2, None, None, None, None, "Heading", None), (0, 7, "Paragraph", None, None, None, None, None, "Paragraph", "p1"),
    (0, 8, "Text", None, None, "'one '", None, None, None, None), (0, 9, "Emphasis", None, None, None, None, None, "Emphasis", None), (0, 10, "Text", None, None, "'two'", None, None, None, None), (0, 11, "Text", None, None, "' '", None, None, None, None),
    (0, 12, "Footnote", None, None, None, "body-2.xhtml#n1", None, "Footnote", None), (0, 13, "Text", None, None, "'1'", None, None, None, None), (0, 15, "Image", None, None, None, None, 0, "Image", None), (0, 16, "Text", None, None, "'&'", None, None, None, None),
    (0, 17, "Code", None, None, None, None, None, None, None), (0, 18, "Text", None, None, "'a b'", None, None, None, None), (0, 19, "PageBreak", None, None, None, None, None, "SceneBreak", None), (0, 20, "Paragraph", None, None, None, None, None, "Paragraph", None),
    (0, 21, "Text", None, None, "'item'", None, None, None, None), (0, 22, "ListItem", None, None, None, None, None, "List", None), (0, 23, "UnorderedList", None, None, None, None, None, "List", None), (0, 24, "GenericBlock", None, "poem", None, None, None, "Poetry", None),
    (0, 25, "GenericBlock", None, "stanza", None, None, None, "Poetry", None), (0, 26, "GenericBlock", None, "verse", None, None, None, "Poetry", None), (0, 27, "Text", None, None, "'line'", None, None, None, None), (0, 28, "BlockQuote", None, None, None, None, None, "Quote", None),
    (0, 29, "Text", None, None, "'bare text'", None, None, None, None), (0, 30, "GenericBlock", None, "strange", None, None, None, "Generic", None), (0, 31, "Text", None, None, "'odd'", None, None, None, None), (0, 32, "GenericInline", None, "image", None, None, None, None, None),
    (1, 33, "Section", None, None, None, None, None, "Section", None), (1, 34, "Paragraph", None, None, None, None, None, "Paragraph", None), (1, 35, "Text", None, None, "'note'", None, None, None, None),
]


def _sql(x) -> str:
    return "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)


FB2_NODES = " UNION ALL ".join(
    f"SELECT c_custkey AS book_id, {b}::INTEGER AS body, {n}::BIGINT AS node_id, '{kind}' AS kind, {_sql(level)}::INTEGER AS level, {_sql(tag)}::VARCHAR AS tag, {text or 'NULL'}::VARCHAR AS text, {_sql(href)}::VARCHAR AS href, {_sql(res)}::INTEGER AS resource, {_sql(role)}::VARCHAR AS role, {_sql(anchor)}::VARCHAR AS anchor FROM customer WHERE c_custkey % 10 <> 9"
    for b, n, kind, level, tag, text, href, res, role, anchor in _T
)


def fb2_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of the documents, their binaries, and why some cannot be read."""
    elements = _elements(spark, sf_dir)
    # what a body holds is no part of the metadata, but for binaries and descriptions within one
    told = F.arrays_overlap("above", F.array(*[F.lit(t) for t in ("binary", "coverpage", "title-info", "publish-info", "document-info")]))
    elements = elements.where(~F.coalesce(F.get("above", F.lit(1)) == "body", F.lit(False)) | (F.col("tag") == "binary") | told)
    # dealt out by their book once; what is told of a book meets there, and no side goes through the driver
    elements = elements.drop("holds").repartition("book_id").persist()
    binaries = fb2.resources(elements).groupBy("book_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "resource_id", "name", "kind", F.col("size").cast("string"), "is_cover", "reason"))), "|").alias("binaries"))
    told = elements.groupBy("book_id").agg(F.max("reason").alias("reason"))
    made = fb2.metadata(elements).withColumns({c: F.array_join(c, "|") for c in ("authors", "translators", "subjects")})
    return told.join(made.hint("merge"), "book_id", "left").join(binaries.hint("merge"), "book_id", "left")


FB2_METADATA = """WITH c AS (SELECT *, c_custkey % 10 <> 9 AS good FROM customer)
SELECT c_custkey AS book_id, CASE WHEN NOT good THEN 'xml:mismatched tag' END AS reason, CASE WHEN good THEN 'The ' || c_name END AS title, CASE WHEN good THEN 'en' END AS language, CASE WHEN good THEN 'A ' || c_name || '|N' END AS authors, CASE WHEN good THEN '' END AS translators,
CASE WHEN good THEN 'x y' END AS description, CASE WHEN good THEN 'k1|g0' || CASE WHEN c_custkey % 3 > 0 THEN '|g' || c_custkey % 3 ELSE '' END END AS subjects, CASE WHEN good THEN CASE WHEN c_custkey % 2 = 1 THEN 'd2' ELSE 'd1' END END AS date, CASE WHEN good THEN 's' END AS series,
CASE WHEN good THEN (c_custkey % 4 + 0.5)::DOUBLE END AS series_index, CASE WHEN good THEN 'P' END AS publisher, CASE WHEN good THEN 'i' || c_custkey END AS isbn, CASE WHEN good THEN '0:c.png:Png:5:true|1:b:Unknown:false:invalid_base64' END AS binaries FROM c"""

QUERIES = {f.__name__: f for f in (fb2_nodes, fb2_metadata)}
SQL = {"fb2_nodes": FB2_NODES, "fb2_metadata": FB2_METADATA}
