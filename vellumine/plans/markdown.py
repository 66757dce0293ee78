"""Registered queries: Markdown books made of the conversations.

Every turn writes the same blocks, some of them only for some turns, so the
SQL states the nodes that these have to give and parses nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.operators import markdown as M
from vellumine.plans.text import read


def markdown_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, text): front matter, then for each turn a heading, text with marks, the turn's words as code, lists, tables, quotes, a rule, a footnote."""
    part = F.expr(
        r"""concat(repeat('#', int(1 + turn % 3)), ' Turn ', turn, ' *of* **', conv_id, '**\n\n',
        'See [item ', turn, '](items/', turn, '.html) and\n  `x = ', turn, '` here[^n', turn, '].\n',
        '```text\n', text, '\n```\n',
        if(turn % 2 = 0, concat('- a', turn, '\n  1. deep ', turn, '\n- b', turn, '\n'), ''),
        if(turn % 3 = 0, concat('| A | B |\n|---|---|\n| ', turn, ' | ~~x~~ |\n\n'), ''),
        if(turn % 3 = 1, concat('> said *', turn, '*\n> > deeper\n\n'), ''),
        if(turn % 4 = 3, '***\n', ''),
        '[^n', turn, ']: Note **', turn, '**\n')"""
    )
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", part.alias("part"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("turn", "part"))), lambda x: x["part"])
    front = F.expr(r"""concat('---\ntitle: "Conversation ', conv_id, '"\nAuthors: A', conv_id % 3, ', B, A', conv_id % 3, '\nno value\ncolor: red\nlang: en\nlang: de\nisbn:\nseries_index: ', conv_id % 7, '.5\n---\n')""")
    return turns.groupBy("conv_id").agg(F.concat(front, F.array_join(parts, "")).alias("text"))


def markdown_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the books."""
    made = M.nodes(markdown_books(spark, sf_dir), "conv_id")
    return made.select("conv_id", "node_id", "parent_id", "place", "kind", "level", "tag", "text", "href", "role")


def markdown_navigation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors and table of contents of the books."""
    return M.navigation(M.nodes(markdown_books(spark, sf_dir), "conv_id"), "conv_id")


def markdown_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Front matter of the books."""
    made = M.metadata(markdown_books(spark, sf_dir), "conv_id")
    return made.select("conv_id", "title", "language", F.array_join("authors", "|").alias("authors"), F.size("identifiers").cast("long").alias("n_identifiers"), "series_index", "n_without_value", "n_unknown", "is_open")


#: The nodes of a turn: place, when it is made, place of the parent, kind, text, link, and for which turns.
_NODES = (
    [(0, 0, None, "Heading", None, None, "true"), (1, 1, 0, "Text", "'Turn ' || turn || ' '", None, "true"), (2, 2, 0, "Emphasis", None, None, "true"), (3, 3, 2, "Text", "'of'", None, "true")]
    + [(4, 4, 0, "Text", "' '", None, "true"), (5, 5, 0, "Strong", None, None, "true"), (6, 6, 5, "Text", "conv_id::VARCHAR", None, "true"), (7, 7, None, "Paragraph", None, None, "true")]
    + [(8, 8, 7, "Text", "'See '", None, "true"), (9, 9, 7, "Link", None, "'items/' || turn || '.html'", "true"), (10, 10, 9, "Text", "'item ' || turn", None, "true"), (11, 11, 7, "Text", "' and '", None, "true")]
    + [(12, 12, 7, "Code", None, None, "true"), (13, 13, 12, "Text", "'x = ' || turn", None, "true"), (14, 14, 7, "Text", "' here'", None, "true"), (15, 15, 7, "Footnote", None, "'markdown.xhtml#fn-n' || turn", "true")]
    + [(16, 16, 15, "Text", "'n' || turn", None, "true"), (17, 17, 7, "Text", "'.'", None, "true"), (18, 18, None, "Preformatted", None, None, "true"), (19, 19, 18, "Text", "text", None, "true")]
    + [(20, 20, None, "UnorderedList", None, None, "turn % 2 = 0"), (21, 25, 20, "ListItem", None, None, "turn % 2 = 0"), (22, 21, 21, "Text", "'a' || turn", None, "turn % 2 = 0"), (23, 22, 21, "OrderedList", None, None, "turn % 2 = 0")]
    + [(24, 24, 23, "ListItem", None, None, "turn % 2 = 0"), (25, 23, 24, "Text", "'deep ' || turn", None, "turn % 2 = 0"), (26, 27, 20, "ListItem", None, None, "turn % 2 = 0"), (27, 26, 26, "Text", "'b' || turn", None, "turn % 2 = 0")]
    + [(30, 30, None, "Table", None, None, "turn % 3 = 0"), (31, 35, 30, "TableRow", None, None, "turn % 3 = 0"), (32, 32, 31, "TableCell", None, None, "turn % 3 = 0"), (33, 31, 32, "Text", "'A'", None, "turn % 3 = 0")]
    + [(34, 34, 31, "TableCell", None, None, "turn % 3 = 0"), (35, 33, 34, "Text", "'B'", None, "turn % 3 = 0"), (36, 41, 30, "TableRow", None, None, "turn % 3 = 0"), (37, 37, 36, "TableCell", None, None, "turn % 3 = 0")]
    + [(38, 36, 37, "Text", "turn::VARCHAR", None, "turn % 3 = 0"), (39, 40, 36, "TableCell", None, None, "turn % 3 = 0"), (40, 38, 39, "GenericInline", None, None, "turn % 3 = 0"), (41, 39, 40, "Text", "'x'", None, "turn % 3 = 0")]
    + [(50, 50, None, "BlockQuote", None, None, "turn % 3 = 1"), (51, 51, 50, "Paragraph", None, None, "turn % 3 = 1"), (52, 52, 51, "Text", "'said '", None, "turn % 3 = 1"), (53, 53, 51, "Emphasis", None, None, "turn % 3 = 1")]
    + [(54, 54, 53, "Text", "turn::VARCHAR", None, "turn % 3 = 1"), (55, 55, 50, "BlockQuote", None, None, "turn % 3 = 1"), (56, 56, 55, "Paragraph", None, None, "turn % 3 = 1"), (57, 57, 56, "Text", "'deeper'", None, "turn % 3 = 1")]
    + [(60, 60, None, "PageBreak", None, None, "turn % 4 = 3")]
)
_NOTES = [(0, 0, None, "GenericBlock", None, None, "true"), (1, 1, 0, "Text", "'Note '", None, "true"), (2, 2, 0, "Strong", None, None, "true"), (3, 3, 2, "Text", "turn::VARCHAR", None, "true")]


def _stated(nodes: list, behind: int) -> str:
    """The nodes of every turn; ``behind``: 1 for what follows all turns, in the order of the notes' names."""
    order = "'n' || turn" if behind else "lpad(turn::VARCHAR, 9, '0')"
    rows = (f"SELECT conv_id, {behind} AS behind, {order} AS part, {p} AS p, {a} AS a, {'NULL' if up is None else up}::INTEGER AS up, '{kind}' AS kind, turn, {text or 'NULL'}::VARCHAR AS text, {href or 'NULL'}::VARCHAR AS href FROM conversations WHERE {when}" for p, a, up, kind, text, href, when in nodes)
    return " UNION ALL ".join(rows)


_TREE = f"""stated AS ({_stated(_NODES, 0)} UNION ALL {_stated(_NOTES, 1)}),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY behind, part, a) - 1 AS node_id, row_number() OVER (PARTITION BY conv_id ORDER BY behind, part, p) - 1 AS place FROM stated)"""
_ROLE = "CASE n.kind WHEN 'BlockQuote' THEN 'Quote' WHEN 'OrderedList' THEN 'List' WHEN 'UnorderedList' THEN 'List' WHEN 'ListItem' THEN 'List' WHEN 'Preformatted' THEN 'Code' WHEN 'PageBreak' THEN 'SceneBreak' WHEN 'GenericBlock' THEN 'Footnote' WHEN 'Heading' THEN 'Heading' WHEN 'Paragraph' THEN 'Paragraph' WHEN 'Table' THEN 'Table' WHEN 'Link' THEN 'Link' WHEN 'Footnote' THEN 'Footnote' END"
MARKDOWN_NODES = f"""WITH {_TREE}
SELECT n.conv_id, n.node_id::INTEGER AS node_id, u.node_id::INTEGER AS parent_id, n.place::INTEGER AS place, n.kind, CASE WHEN n.kind = 'Heading' THEN 1 + n.turn % 3 END::INTEGER AS level,
CASE n.kind WHEN 'GenericBlock' THEN 'aside' WHEN 'GenericInline' THEN 's' END AS tag, n.text, n.href, {_ROLE} AS role
FROM numbered n LEFT JOIN numbered u ON u.conv_id = n.conv_id AND u.behind = n.behind AND u.part = n.part AND u.p = n.up"""
MARKDOWN_NAVIGATION = f"""WITH {_TREE}, heads AS (SELECT conv_id, node_id, 'Turn ' || turn || ' of ' || conv_id AS label, row_number() OVER (PARTITION BY conv_id ORDER BY place) - 1 AS n FROM numbered WHERE kind = 'Heading'),
titles AS (SELECT conv_id, label AS title FROM heads WHERE n = 0),
all_ AS (SELECT conv_id, 'md-heading-' || n AS anchor, node_id, label, true AS in_toc FROM heads UNION ALL SELECT conv_id, 'fn-n' || turn, node_id, NULL, false FROM numbered WHERE kind = 'GenericBlock')
SELECT conv_id, anchor, node_id::INTEGER AS node_id, label, in_toc, title FROM all_ JOIN titles USING (conv_id)"""
MARKDOWN_METADATA = """SELECT DISTINCT conv_id, 'Conversation ' || conv_id AS title, 'de' AS language, 'A' || conv_id % 3 || '|B' AS authors, 0::BIGINT AS n_identifiers, conv_id % 7 + 0.5::DOUBLE AS series_index, 1::BIGINT AS n_without_value, 1::BIGINT AS n_unknown, false AS is_open FROM conversations"""

QUERIES = {f.__name__: f for f in (markdown_nodes, markdown_navigation, markdown_metadata)}
SQL = {"markdown_nodes": MARKDOWN_NODES, "markdown_navigation": MARKDOWN_NAVIGATION, "markdown_metadata": MARKDOWN_METADATA}
