"""Column functions and operators on small fixtures."""

from pyspark.sql import functions as F

from vellumine.functions import text as T
from vellumine.operators import changes, linkage, links, markup, reader, search, styles, text_structure
from vellumine.operators import catalogue
from vellumine.sources import files


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_numbers(spark):
    cases = {"12": 12, "０12": 12, "XIV": 14, "iv": 4, "seven": 7, "十二": 12, "一百零五": 105, "二〇二四": 2024, "三万五千": 35000, "": None, "abc": None}
    rows = spark.createDataFrame(list(cases.items()), "s string, n int").withColumn("got", T.number(F.col("s"))).collect()
    assert {r.s: r.got for r in rows} == cases


def test_whitespace_and_lines(spark):
    assert one(spark, T.collapse(F.lit(" a　\u0085 b\t"))) == "a b"
    assert one(spark, T.collapse(F.lit(" 　"))) is None
    assert one(spark, T.lines(T.normal_newlines(F.lit("﻿a\r\nb\rc d\n")))) == ["a", "b", "c", "d"]
    assert one(spark, T.lines(F.lit(""))) == []
    assert one(spark, T.ordered_distinct(F.array(*[F.lit(x) for x in ("b", "", "a", "b")]))) == ["b", "a"]
    assert one(spark, T.append_unique(F.array(F.lit("Ab")), F.array(F.lit("aB"), F.lit("c")))) == ["Ab", "c"]


def test_tags_and_paths(spark):
    assert one(spark, T.language_tag(F.lit("ZH_hant-tw"))) == "zh-Hant-TW"
    assert [one(spark, T.safe_path(F.lit(p))) for p in ("a/./b", "/a", "a/../b", "", "a\\b")] == ["a/b", None, None, None, "a/b"]


def test_natural_order(spark):
    names = ["10", "2", "02", "1", "002", "a2", "A10", "a1"]
    got = [r.s for r in spark.createDataFrame([(n,) for n in names], "s string").orderBy(T.natural_key(F.col("s"))).collect()]
    assert got == ["1", "002", "02", "2", "10", "a1", "a2", "A10"]


def test_cjk_headings(spark):
    text = "第一卷 起\n\n第十二章 風\n\n正文。\n\n番外 一\n\n序章\n\nあとがき"
    rows = text_structure.headings(spark.createDataFrame([(1, text)], "doc_id long, text string"), novel=True).orderBy("line").collect()
    assert [(r.kind, r.number, r.volume_line) for r in rows] == [("Volume", 1, None), ("Chapter", 12, 0), ("Supplement", 1, 0), ("Prologue", None, 0), ("Afterword", None, 0)]


def test_paragraphs_join_cjk_without_space(spark):
    docs = spark.createDataFrame([(1, "ab\ncd\n\n中文\n字")], "doc_id long, text string")
    assert [r.text for r in text_structure.paragraphs(docs).orderBy("paragraph").collect()] == ["ab cd", "中文字"]


def test_metadata_guess(spark):
    rows = [("《书》作者：某人.txt", ""), ("Title [Author].txt", ""), ("A - B.txt", "Title: X\nAuthor: Y"), ("plain.txt", None)]
    made = text_structure.metadata_guess(spark.createDataFrame(rows, "name string, text string"), "name").collect()
    assert [(r.title, r.author) for r in made] == [("书", "某人"), ("Title", "Author"), ("X", "Y"), ("plain", None)]


def test_tree(spark):
    pages = spark.createDataFrame([(1, "<html><h1 id=a>Big <b>news</b></h1><p>x<br>y<a href='#z'>l</a><p id=a></html>"), (2, None)], "page_id long, html string")
    tree = markup.nodes(pages)
    assert {r.page_id: r.title for r in markup.first_heading(tree).collect()} == {1: "Big news"}
    assert {r.page_id: r.text for r in markup.text_of(tree).collect()} == {1: "Big news x y l"}
    assert sorted((r.code, r.subject) for r in markup.integrity(tree).collect()) == [("ANCHOR-REPEATED", "a"), ("LINK-DANGLING", "z")]


def test_references_end_with_a_semicolon(spark):
    pages = spark.createDataFrame([(1, "<h1>a&amp b&amp;&amp c&lt;d &nosuch; &#65; &#66</h1><p>x & y &copyz &amp;lt;</p>")], "page_id long, html string")
    tree = markup.nodes(pages)
    assert [r.title for r in markup.first_heading(tree).collect()] == ["a&amp b&&amp c<d &nosuch; A &#66"]
    assert [r.text for r in markup.text_of(tree).collect()] == ["a&amp b&&amp c<d &nosuch; A &#66 x & y &copyz &lt;"]


def test_nodes_come_in_small_frames():
    pages = [(k, "<p>x</p>" * 1000) for k in range(20)]
    sizes = [len(f) for f in markup._frames(pages)]
    assert sum(sizes) == 20 * 2000 and max(sizes) <= markup.FRAME_ROWS


def test_spreads(spark):
    pages = [(1, i, side, single) for i, (side, single) in enumerate([(None, False), ("left", False), ("right", False), ("left", False), ("left", False), (None, True), (None, False)])]
    rows = reader.spreads(spark.createDataFrame(pages, "b int, at long, side string, single boolean"), "b", "at", "side", "single").collect()
    assert sorted((r.first, r.second) for r in rows) == [(0, None), (1, 2), (3, None), (4, None), (5, None), (6, None)]


def test_scan_and_next_snapshot(spark):
    kept = "path string, size long, mtime long, hash string"
    old = [(1, "a", 1, 0, "h1", "present"), (2, "b", 1, 0, "h2", "present"), (3, "c", 1, 0, "h3", "present"), (4, "m", 1, 0, "h4", "missing"), (5, "x", 1, 0, "h5", "present"), (6, "g", 1, 0, "h1", "present")]
    new = [("a", 1, 0, "h1", True), ("b", 2, 1, "h9", True), ("d", 1, 0, "h3", True), ("d2", 1, 0, "h3", True), ("e", 1, 0, "h1", True), ("f", 1, 0, "h7", True), ("f2", 1, 0, "h7", True)]
    # A file equal to a modified one's new content is a copy; one equal to its old content is new.
    new += [("k", 1, 0, "h9", True), ("l", 1, 0, "h2", True), ("n", 1, 0, "h4", True), ("x", 2, 1, "h8", False), ("y", 1, 0, "h6", False)]
    old, new = spark.createDataFrame(old, "id long, path string, size long, mtime long, hash string, state string"), spark.createDataFrame(new, kept + ", ok boolean")
    got = {r.path: (r.action, r.old_path, r.id) for r in changes.classify(old, new).collect()}
    assert got == {
        "a": ("unchanged", None, 1), "b": ("modified", None, 2), "d": ("moved", "c", 3), "d2": ("duplicate", None, None), "e": ("duplicate", None, None), "f": ("new", None, None), "f2": ("duplicate", None, None),
        "k": ("duplicate", None, None), "l": ("new", None, None), "n": ("moved", "m", 4), "x": ("failed", None, 5), "y": ("failed", None, None), "g": ("missing", None, 6),
    }
    after = {r.path: (r.id, r.state, r.hash) for r in changes.next_snapshot(old, new).collect()}
    assert after["d"] == (3, "present", "h3") and after["n"] == (4, "present", "h4") and after["x"] == (5, "error", "h8") and after["g"] == (6, "missing", "h1") and after["e"] == (None, "duplicate", "h1")
    assert not {"c", "m", "y"} & after.keys() and len(after) == 12


def test_imported_modes(spark):
    text = "Chapter 1\n\nOne line\nwrapped here\n  indented\nlast\n\n字\n字"
    df = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")

    def nodes(**settings):
        return [(r.node_id, r.document, r.line, r.kind, r.text) for r in text_structure.imported(df, novel=True, **settings).orderBy("node_id").collect()]

    head = (0, 0, 0, "heading", "Chapter 1")
    assert nodes(requested="blank_line") == [head, (1, 0, 2, "paragraph", "One line wrapped here indented last"), (2, 0, 7, "paragraph", "字字")]
    assert nodes(requested="indented") == [head, (1, 0, 2, "paragraph", "One line wrapped here"), (2, 0, 4, "paragraph", "indented last"), (3, 0, 7, "paragraph", "字字")]
    assert [x[3:] for x in nodes(requested="every_line")] == [("heading", "Chapter 1"), *[("paragraph", x) for x in ("One line", "wrapped here", "  indented", "last", "字", "字")]]
    assert [x[1] for x in nodes(requested="blank_line", document_bytes=40)] == [0, 1, 2]


def test_hrefs_and_css(spark):
    cases = [("t/a.xhtml", "b.xhtml#x", "t/b.xhtml#x"), ("t/a.xhtml", "#x", "t/a.xhtml#x"), ("t/a.xhtml", "../c%20d.xhtml", "c d.xhtml"), ("a.xhtml", "../x", None), ("a.xhtml", "http://x/y", "http://x/y"), ("t/a.xhtml", "//h/x", "//h/x"), ("t/a.xhtml", "./u/.././v+w.xhtml", "t/v+w.xhtml")]
    df = spark.createDataFrame([(i, d, h) for i, (d, h, _) in enumerate(cases)], "i int, d string, h string")
    assert {r.i: r.x for r in df.select("i", links.resolved(F.col("d"), F.col("h")).alias("x")).collect()} == {i: x for i, (_, _, x) in enumerate(cases)}
    css = "a, b > c.x#y:hover { Color : red ; color: BLUE;; bad } @media print { p { margin:0 } } @media (amzn-kf8) { p { margin:1 } } @page { margin: 3 } /* open"
    sheet = spark.createDataFrame([(1, 0, css)], "book_id long, position int, css string")
    got = [(r.selector, r.tag, r.ids, r.classes, tuple(r.specificity), [tuple(d) for d in r.declarations]) for r in styles.rules(sheet, "kf7").orderBy("place").collect()]
    blue = [("color", "BLUE")]
    assert got == [("a", "a", [], [], (0, 0, 1), blue), ("b > c.x#y:hover", "c", ["y"], ["x"], (1, 1, 4), blue), ("p", "p", [], [], (0, 0, 1), [("margin", "0")])]


def test_heading_scores(spark):
    """Points of each rule, written out."""
    text = "Chapter 1\n\nChapter 2\ntext\nPart 3\n\nBook 4\n\n第三章 風\n\n第四回\n\nChapter 9"
    rows = text_structure.headings(spark.createDataFrame([(1, text)], "doc_id long, text string"), novel=True).collect()
    # 55 for a number, 12 short, 8 at line 0, 14 after a blank line, 8 before one, 15 in sequence, 18 off it.
    assert {r.line: r.score for r in rows} == {0: 83, 2: 96, 4: 75, 6: 89, 8: 89, 10: 89, 12: 89}
    assert [r.detector for r in sorted(rows, key=lambda r: r.line)] == ["english_chapter_detector"] * 2 + ["english_part_detector", "english_book_detector", "cjk_explicit_chapter", "chinese_novel_hui", "english_chapter_detector"]


def test_catalogue_writes(spark):
    dim = spark.createDataFrame([(1, "x")], "id long, name string")
    made = catalogue.with_new_names(dim, spark.createDataFrame([("y",), ("x",), ("z",), ("y",), (None,)], "name string")).collect()
    assert sorted(r.name for r in made) == ["x", "y", "z"] and sorted(r.id for r in made) == [1, 2, 3]
    up = catalogue.upsert(dim, spark.createDataFrame([(1, "new"), (2, "two")], "id long, name string"), ["id"]).collect()
    assert sorted((r.id, r.name) for r in up) == [(1, "new"), (2, "two")]


def test_search(spark):
    docs = spark.createDataFrame([(1, "of the of THE"), (2, "of-the x"), (3, "off the"), (4, None)], "doc_id long, text string")
    assert {r.doc_id: r.n_hits for r in search.phrase(docs, "Of the").collect()} == {1: 2, 2: 1}
    assert search.phrase(docs, " ").count() == 0
    assert {r.doc_id for r in search.bm25(docs, ["the"]).collect()} == {1, 2, 3}


def test_linkage(spark):
    t = F.split(F.lit("a b c d"), " ")
    assert one(spark, linkage.is_subsequence(F.split(F.lit("a c d"), " "), t)) is True
    assert one(spark, linkage.is_subsequence(F.split(F.lit("c a"), " "), t)) is False


def test_files(spark, tmp_path):
    (tmp_path / "x.txt").write_text("héllo", encoding="utf-8")
    (tmp_path / "y.epub").write_bytes(b"PK\x03\x04" + bytes(26) + b"mimetypeapplication/epub+zip")
    (tmp_path / "z.txt").write_bytes("これは日本語のテキストです。ひらがなとカタカナ".encode("shift_jis"))
    (tmp_path / "n.bin").write_bytes(b"\x00\x01\x02\x03\x04")
    found = files.files(spark, f"file://{tmp_path}").withColumn("name", F.regexp_extract("path", "([^/]+)$", 1))
    assert {r.name: r.f for r in found.select("name", files.detected_format(F.col("path"), F.col("content")).alias("f")).collect()} == {"x.txt": "text", "y.epub": "epub", "z.txt": "text", "n.bin": "unsupported"}
    got = {r.name: (r.encoding, r.text) for r in files.decoded(found.select("name", "content")).collect()}
    assert got["x.txt"] == ("utf-8", "héllo") and got["z.txt"][0] == "shift_jis" and got["n.bin"] == (None, None)


def test_short_texts_without_marks(spark):
    texts = ["a", "ab", "abc", "é", "abcd"]
    rows = [(n, t.encode(code)) for n, t in enumerate(texts) for code in ("utf-16-le", "utf-16-be")]
    got = [(r.n, r.encoding, r.text) for r in files.decoded(spark.createDataFrame(rows, "n int, content binary")).collect()]
    assert sorted(got) == sorted((n, code, t) for n, t in enumerate(texts) for code in ("utf-16-le", "utf-16-be"))
    odd = [(1, b"\0"), (2, b"\0\0"), (3, b"a\0\0"), (4, b"ab")]
    assert [(r.n, r.text) for r in files.decoded(spark.createDataFrame(odd, "n int, content binary")).orderBy("n").collect()] == [(1, None), (2, None), (3, None), (4, "ab")]
