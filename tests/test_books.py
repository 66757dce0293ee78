"""Books: Markdown, style sheets, trees, plans for targets, several files, XML, pictures: stated cases and odd inputs."""

import pytest
from pyspark.sql import functions as F

from vellumine.operators import bookfiles, compat, fb2, markdown, markup, pages, projection, styles, trees
from vellumine.plans import books as plan_books
from vellumine.plans import fb2 as plan_fb2
from vellumine.plans import text as plan_text
from vellumine.plans import trees as plan_trees
from vellumine.sources import xml

SAMPLE = """---
title: "A Book"
author: Ann, Bob, Ann
nonsense
series_index: 2.5
color: red
---

# Head *one*

Some `code` and [a **link**](u/v) and
a line [^n1] ![pic](a.png) ![far](http://x/y.png) a * b.
[^n1]: no definition here
- break
  - nested
    1. deep
  * other
- last
1. one

> quote
> > inner
> ## in quote

| A | B |
|---|---|
x | y

```rust
# no head

```
***
<div>
<p>raw</p><script>bad</script>
[^n1]: Note *text*
[^01]: Second
~~s~~ ****x** __y__
"""


def outline(rows):
    """Kinds with texts, indented by depth, in order of place."""
    by = {r.node_id: r for r in rows}
    depth = lambda r: 0 if r.parent_id is None else 1 + depth(by[r.parent_id])
    return [f"{'.' * depth(r)}{r.kind}{':' + r.text if r.text is not None else ''}" for r in sorted(rows, key=lambda r: r.place)]


@pytest.fixture(scope="module")
def books(spark):
    return spark.createDataFrame([(1, SAMPLE), (2, None), (3, ""), (4, "---\nopen"), (5, "```\nnever closed"), (6, " \r\n\t\n")], "book_id long, text string")


@pytest.fixture(scope="module")
def tree(spark, books):
    images = spark.createDataFrame([(1, "a.png")], "book_id long, path string")
    return markdown.nodes(books, images=images).collect()


def test_markdown(tree):
    got = outline([r for r in tree if r.book_id == 1])
    assert got[: got.index("Preformatted")] == [
        "Heading", ".Text:Head ", ".Emphasis", "..Text:one",
        "Paragraph", ".Text:Some ", ".Code", "..Text:code", ".Text: and ", ".Link", "..Text:a ", "..Strong", "...Text:link", ".Text: and a line ", ".Footnote", "..Text:n1",
        ".Text: ", ".Image", ".Text: ", ".GenericInline", ".Text: a * b. ", ".Footnote", "..Text:n1", ".Text:: no definition here",
        "UnorderedList", ".ListItem", "..Text:break", "..UnorderedList", "...ListItem", "....Text:nested", "....OrderedList", ".....ListItem", "......Text:deep", "...ListItem", "....Text:other", ".ListItem", "..Text:last",
        "OrderedList", ".ListItem", "..Text:one", "BlockQuote", ".Paragraph", "..Text:quote", ".BlockQuote", "..Paragraph", "...Text:inner", ".Heading", "..Text:in quote",
        "Table", ".TableRow", "..TableCell", "...Text:A", "..TableCell", "...Text:B", ".TableRow", "..TableCell", "...Text:x", "..TableCell", "...Text:y",
    ]
    assert got[got.index("Preformatted") :] == [
        "Preformatted", ".Text:# no head\n", "PageBreak", "GenericBlock", ".Text:raw", "Paragraph", ".GenericInline", "..Text:s", ".Text: *", ".Strong", "..Text:*x", ".Text: ", ".Strong", "..Text:y",
        "GenericBlock", ".Text:Second", "GenericBlock", ".Text:Note ", ".Emphasis", "..Text:text",
    ]
    assert outline([r for r in tree if r.book_id == 4]) == ["PageBreak", "Paragraph", ".Text:open"]
    assert outline([r for r in tree if r.book_id == 5]) == ["Preformatted", ".Text:never closed"]
    assert {r.book_id for r in tree} == {1, 4, 5}


def test_markdown_ids(tree):
    """Ids are dense, in the order in which nodes are made: an item after what it holds, a heading before."""
    own = [r for r in tree if r.book_id == 1]
    assert sorted(r.node_id for r in own) == list(range(len(own))) == sorted(r.place for r in own)
    for r in own:
        below = [c.node_id for c in own if c.parent_id == r.node_id]
        assert all((c < r.node_id) == (r.kind in ("ListItem", "TableRow", "TableCell")) for c in below)


def test_markdown_navigation(books):
    got = {(r.anchor, r.label, r.title) for r in markdown.navigation(markdown.nodes(books)).where("book_id = 1").collect()}
    assert got == {("md-heading-0", "Head one", "Head one"), ("md-heading-1", "in quote", "Head one"), ("fn-n1", None, "Head one"), ("fn-01", None, "Head one")}


def test_markdown_metadata(books):
    got = {r.book_id: r for r in markdown.metadata(books).collect()}
    assert (got[1].title, got[1].authors, got[1].series_index, got[1].n_without_value, got[1].n_unknown) == ("A Book", ["Ann", "Bob"], 2.5, 1, 1)
    assert got[4].is_open and not got[1].is_open and got[2].title is None


@pytest.mark.parametrize(
    ("css", "want"),
    [
        ("@supports (a) { p { color: red } } q { top: 1 }", ["q"]),
        ("@keyframes k { from { top: 0 } to { top: 1 } } q{top:1}", ["q"]),
        ('p { content: "}"; top: 1 } q{top:1}', ["p", "q"]),
        ("p { content: '{'; } /* q { } */ r{top:1}", ["p", "r"]),
        ("@media screen { @media amzn-kf8 { a{top:1} } @supports (x) { b{top:1} } c{top:1} } d{top:1}", ["a", "c", "d"]),
        ("@media amzn-mobi { a{top:1} }\n@media speech { b{top:1} }", []),
        ("a{top:1} b { never closed", ["a"]),
        ("", []),
    ],
)
def test_sheets(spark, css, want):
    sheet = spark.createDataFrame([(1, 0, css)], "book_id long, position int, css string")
    assert [r.selector for r in styles.rules(sheet, "kf8").orderBy("place").collect()] == want


def test_long_sheet(spark):
    css = "@media screen {" + "".join(f'p.c{i} {{ content: "}}"; top: {i} }}\n' for i in range(4000)) + "}"
    assert styles.rules(spark.createDataFrame([(1, 0, css)], "book_id long, position int, css string"), "kf8").count() == 4000


def test_resolved_styles(spark):
    nodes = spark.createDataFrame([(1, 0, None, "h1"), (1, 1, 0, "em"), (1, 2, 1, "p"), (1, 3, 2, "b"), (2, 0, None, "p")], "book_id long, node_id long, parent_id long, tag string")
    declared = spark.createDataFrame([(1, 1, "color", "red"), (1, 2, "margin", "1px"), (1, 3, "color", "blue")], "book_id long, node_id long, property string, value string")
    got = {(r.book_id, r.node_id, r.property): r.value for r in styles.resolved(nodes.join(trees.above(nodes), ["book_id", "node_id"]), declared).collect()}
    assert [got[1, n, "color"] for n in range(4)] == ["#000000", "red", "red", "blue"]
    assert [got[1, n, "font-weight"] for n in range(4)] == ["bold"] * 4 and got[2, 0, "font-weight"] == "normal"  # the outermost element's default passes down
    assert [got[1, n, "display"] for n in range(4)] == ["block", "inline", "block", "inline"]
    assert got[1, 2, "margin"] == "1px" and (1, 3, "margin") not in got


def brute_contents(parents):
    """Children of the top in order, each with those below it; then what was not reached, in order."""
    done, out = set(), {}

    def under(parent, path):
        n = 0
        for i, p in enumerate(parents):
            if p == parent and i not in done:
                done.add(i)
                out[i] = [*path, n]
                n += 1
                under(i, out[i])
        if parent == -1:
            for i in range(len(parents)):
                if i not in done:
                    done.add(i)
                    out[i] = [n]
                    n += 1
                    under(i, out[i])

    under(-1, [])
    return out


@pytest.mark.parametrize("parents", [[-1, 0, 1, 2, 3, 4, 5, 6, 7], [1, 2, 0, -1, 3, 0], [0], [9, 0, 4, 4, 2, -1, 5], [3, 3, 3, 7, 2], [], [5, 4, 3, 2, 1, 0], [1, 0, 3, 2, -1]])
def test_contents(spark, parents):
    points = spark.createDataFrame([(1, i, p) for i, p in enumerate(parents)], "book_id long, place long, parent long")
    got = {r.place: (r.path, r.n_below) for r in trees.rebuilt(points).collect()}
    want = brute_contents(parents)
    assert {i: p for i, (p, _) in got.items()} == want
    assert all(n == sum(q[: len(p)] == p and q != p for q in want.values()) for p, n in got.values())


def test_ruby(spark):
    html = "<body><p>x<ruby>a<rp>(</rp><rt>b<ruby>c<rt>d</rt></ruby></rt><rp>)</rp></ruby>y</p><pre>z</pre></body>"
    tree = projection.with_kinds(markup.nodes(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string"), spaced=True)).persist()
    assert {(r.base, r.annotation) for r in projection.ruby(tree).collect()} == {("a", "bcd"), ("c", "d")}
    assert [r.text for r in projection.visible_text(tree).collect()] == ["xabcdy\nz\n\n"]
    assert [r.text for r in projection.text_content(tree).collect()] == ["xa(\nbcd)\ny\nz\n\n"]


def test_choices(spark):
    """Targets' outcomes by level, text and options."""
    rows = [("Svg", "Approximate", True, False, False), ("Svg", "Approximate", False, True, False), ("Svg", "Unsupported", False, True, False), ("VerticalWriting", "Unsupported", False, False, False)]
    rows += [("Poetry", "Unsupported", False, False, False), ("Ruby", "Unsupported", False, True, False), ("ComplexTable", "Flattenable", False, False, True), ("EmbeddedFont", "Native", False, False, False), ("FixedLayout", "Unsupported", False, False, True)]
    asked = spark.createDataFrame(rows, "feature string, level string, bare boolean, readable boolean, structural boolean")
    columns = [F.col(c) for c in asked.columns]
    ranks = lambda **o: [r.c.rank for r in asked.select(compat.choice(*columns, **o).alias("c")).collect()]
    assert ranks() == [3, 2, 3, 2, 4, 2, 3, 0, 3]
    assert ranks(strip_fonts=True) == [3, 2, 3, 2, 4, 2, 3, 2, 3]
    assert ranks(rasterize=True) == [3, 2, 3, 2, 2, 2, 3, 0, 3]


def test_variants_and_fonts(spark):
    variants = spark.createDataFrame([([("Legacy", 7), ("Kf7", 3)],), ([("Generic", 1)],), ([],)], "v array<struct<target:string,style_id:int>>")
    take = lambda t: [r[0] for r in variants.select(projection.preferred_variant(F.col("v"), t)["style_id"]).collect()]
    assert take("KF7") == [3, None, None] and take("EPUB3") == [None, 1, None]
    files = spark.createDataFrame([(1, 0, "Png"), (1, 1, "Font"), (1, 2, "Svg")], "book_id long, resource_id int, kind string")
    assert {(r.resource_id, r.new_id) for r in projection.without_fonts(files).collect()} == {(0, 0), (2, 1)}


def test_file_orders(spark):
    rows = [(1, "b.html", ""), (1, "a.html", ""), (2, "manifest.txt", "# x\n b.html \n\na.html"), (2, "a.html", ""), (2, "b.html", ""), (3, "manifest.txt", "a.html\na.html"), (3, "a.html", ""), (4, "manifest.txt", "# none"), (4, "a.html", "")]
    rows += [(5, "manifest.txt", "c.html"), (5, "a.html", ""), (6, "sub/INDEX.HTM", '<a href="../z.html"><a href="y.html#f"><a href="../../out.html">'), (6, "z.html", ""), (6, "sub/y.html", ""), (6, "a.html", None), (7, "x.txt", "")]
    placed, told = bookfiles.ordered_documents(spark.createDataFrame(rows, "book_id long, path string, text string"))
    order = {}
    for r in placed.orderBy("book_id", "place").collect():
        order.setdefault(r.book_id, []).append(r.path)
    assert order == {1: ["a.html", "b.html"], 2: ["b.html", "a.html"], 6: ["sub/INDEX.HTM", "z.html", "sub/y.html", "a.html"]}
    assert {r.book_id: (r.order, r.error) for r in told.collect()} == {1: ("paths", None), 2: ("manifest", None), 3: (None, "duplicate_document:2"), 4: (None, "empty_manifest"), 5: (None, "missing_document:1"), 6: ("index_links", None), 7: ("single", None)}


def test_xml(spark):
    bomb = '<!DOCTYPE x [<!ENTITY a "b">]><x>&a;</x>'
    rows = [(1, "<a:X b:C='1'>t<y/>u</a:X>"), (2, "<a>"), (3, None), (4, bomb), (5, "<a>" + "<b/>" * 60 + "</a>")]
    got = xml.elements(spark.createDataFrame(rows, "book_id int, content string"), most=50).collect()
    assert [(r.path, r.tag, r.above, r.attrs, r.text) for r in got if r.book_id == 1] == [([0], "x", [], {"c": "1"}, None), ([0, 0], "#text", ["x"], None, "t"), ([0, 1], "y", ["x"], {}, None), ([0, 2], "#text", ["x"], None, "u")]
    assert {r.book_id: r.reason for r in got if r.reason} == {2: "xml:no element found", 3: "xml:no element found", 4: "declares_entities", 5: "too_many_nodes"}


def test_fb2_lines(spark):
    """A holder of nothing but text or left-out parts is read as a line; codes and images hold nothing."""
    text = "<FictionBook><body><epigraph>bare <strong>s</strong></epigraph><cite><annotation><p>x</p></annotation>t</cite><section><annotation><p>gone</p></annotation><code>c <b>d</b></code><p><code>e  <b>f</b></code></p></section></body></FictionBook>"
    got = fb2.nodes(xml.elements(spark.createDataFrame([(1, text), (2, "<x/>")], "book_id int, content string"))).orderBy("node_id").collect()
    assert [(r.kind, r.tag, r.text) for r in got] == [
        ("BlockQuote", None, None), ("GenericBlock", "strong", None), ("Text", None, "s"), ("BlockQuote", None, None), ("GenericInline", "annotation", None), ("GenericInline", "p", None), ("Text", None, "x"), ("Text", None, "t"), ("Section", None, None), ("GenericBlock", "code", None), ("Text", None, "c "), ("GenericInline", "b", None), ("Text", None, "d"),
        ("Paragraph", None, None), ("Code", None, None), ("Text", None, "e f"),
    ]
    assert [r.node_id for r in got] == list(range(len(got)))


def test_pictures(spark):
    jpeg = "FFD8FFE00006FFC0FFDAFF01FFFFC2001108000A001403FFD9"
    rows = ["89504E470D0A1A0A0000000D494844520000000500000007", "89504E470D0A1A0A0000000D49484452000000050000", "47494638396105000700", "524946460000000057454250565038580000000000000000040000060000", jpeg, "FFD8FFD9", "FFD8FFE0", "FFD8", "", None, "0001", "89504E470D0A1A0A0000000D494844520000000000000007"]
    got = spark.createDataFrame([(x,) for x in rows], "x string").select(pages.picture_size(F.unhex("x")).alias("s")).select("s.*").collect()
    size = lambda f, w, h: (f, w, h, None)
    lost = lambda f, r="undecodable": (f, None, None, r)
    want = [size("png", 5, 7), lost("png"), size("gif", 5, 7), size("webp", 5, 7), size("jpeg", 20, 10), lost("jpeg"), lost("jpeg"), lost("jpeg"), lost(None), lost(None), lost(None), lost("png", "invalid_geometry")]
    assert [tuple(r) for r in got] == want


def test_small_files_become_many_tasks(spark, tmp_path):
    """A file of few bytes is one task; the documents that its rows become are dealt out by their number."""
    spark.range(25_000).selectExpr("id as p_partkey", "'n' as p_name", "cast(id % 50 as int) as p_size").coalesce(1).write.parquet(f"file://{tmp_path}/part.parquet")
    spark.range(25_000).selectExpr("id as c_custkey", "'n' as c_name").coalesce(1).write.parquet(f"file://{tmp_path}/customer.parquet")
    for made in (plan_trees._marked(spark, f"file://{tmp_path}"), plan_fb2._elements(spark, f"file://{tmp_path}")):
        assert made.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_trees_are_parsed_once(spark, sf):
    """The pages are parsed once and never joined with themselves: what is above a node is told by the order of the page's rows."""
    for query in (plan_trees.lowered_nodes, plan_trees.compatibility_items):
        plan = query(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInPandas") == 1 and "p_partkey" in plan


def test_leaves_do_not_climb_by_rounds(spark, monkeypatch):
    """A book of 400 leaves below a chain of 5: rounds hold the chain alone, and styles are those of ``resolved``."""
    chain = [(1, k, k - 1 if k else None, "h2" if not k else "div", {"color": f"c{k}"} if k % 3 == 1 else {"margin": "1px"}) for k in range(5)]
    leaves = [(1, 10 + k, k % 5, "em", {"color": None, "text-align": "left"} if k % 2 else {"display": "none", "font-weight": "w"}) for k in range(400)]
    nodes = spark.createDataFrame([*chain, *leaves], "book_id long, node_id long, parent_id long, tag string, own map<string,string>")
    declared = nodes.select("book_id", "node_id", F.explode("own").alias("property", "value")).where("value IS NOT NULL")
    want = styles.resolved(nodes.join(trees.above(nodes), ["book_id", "node_id"]), declared).collect()
    held, keep = [], trees.checkpointed

    def counted(df):
        held.append(df.count())
        return keep(df)

    monkeypatch.setattr(trees, "checkpointed", counted)
    got = styles.inherited(nodes).collect()
    as_set = lambda rows: sorted((r.node_id, r.property, r.value) for r in rows)
    assert as_set(got) == as_set(want)
    assert held and max(held) == 5


def test_contents_by_book_and_by_climbing(spark, monkeypatch):
    """Small books are settled in one shuffle, without climbing; larger ones come out as by the same rules. Batches end within books."""
    rows = [(b, p, (p * 7 + b * 13) % (b % 9 + 2) - 1 if (p + b) % 11 else None) for b in range(300) for p in range(b % 14 + 1)]
    rows += [(1000, p, p - 1) for p in range(60)] + [(1001, p, (p + 1) % 40) for p in range(40)] + [(1002, 5, 99), (1002, 9, 5), (1002, -3, 9)]
    points = spark.createDataFrame(rows, "book_id long, place long, parent long")
    key = lambda t: (t[0], t[1], str(t[2:]))
    told = lambda df: sorted(((r.book_id, r.place, r.under, tuple(r.path), r.n_below) for r in df.collect()), key=key)
    want = told(trees.rebuilt(points, book_points=0))
    assert told(trees.rebuilt(points, book_points=6)) == want
    monkeypatch.setattr(trees, "checkpointed", lambda df: pytest.fail("a small book climbs"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        assert told(trees.rebuilt(points)) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_lookups_do_not_climb(spark, sf, monkeypatch):
    """Paths of small books are found without a round of climbing."""
    monkeypatch.setattr(trees, "checkpointed", lambda df: pytest.fail("a small book climbs"))
    found = plan_trees.contents_lookups(spark, sf).collect()
    assert {r.path for r in found if r.place is not None} == {"1", "1.0"}


def test_elements_are_dealt_out(spark, sf, monkeypatch):
    """Elements go to tasks by their number, not by the file that they come from, before rules meet them."""
    held = []
    monkeypatch.setattr(plan_text, "TASK_ROWS", 10)
    monkeypatch.setattr(styles, "computed", lambda elements, sheet: held.append(elements) or elements.selectExpr("node_id", "tag AS property", "id AS value"))
    plan_books.computed_styles(spark, sf)
    assert held[0].rdd.getNumPartitions() == held[0].count() // 10


def test_styles_of_books_are_made_once_a_book(spark, sf):
    """Books are told apart before each gets its styles, so that no line makes rows that are dropped again."""
    plan = plan_books._tables(spark, sf).styles._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Aggregate")
