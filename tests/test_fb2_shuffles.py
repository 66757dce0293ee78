from vellumine.operators import fb2
from vellumine.plans import fb2 as plans
from vellumine.sources import xml


def test_metadata_pass_no_driver(spark, sf):
    """The customers' file says nothing of the size of the documents made of it: no side of a join is broadcast by it."""
    assert "Broadcast" not in plans.fb2_metadata(spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_metadata_of_odd_documents(spark):
    """Names of several parts, repeated and empty ones; fields given twice; covers and binaries that are met by their ids."""
    text = """<F><description><title-info><author><last-name>L</last-name><first-name>F</first-name><first-name>G</first-name></author><author><nickname> </nickname></author><translator><nickname>T</nickname></translator>
    <book-title> </book-title><book-title>B <b>bold</b></book-title><genre>g</genre><genre>g</genre><coverpage><image href="##y"/><image href="#x"/></coverpage></title-info><document-info><author><nickname>D</nickname></author></document-info></description>
    <body/><binary id="x">QQ==</binary><binary id="y">Q<z/>Q==</binary><binary id="x"/></F>"""
    elements = xml.elements(spark.createDataFrame([(1, text), (2, "<x/>")], "book_id int, content string")).persist()
    got = fb2.metadata(elements).collect()
    assert [(r.book_id, r.title, r.authors, r.translators, r.subjects, r.date) for r in got] == [(1, None, ["F L", "D"], ["T"], ["g"], None)]
    assert [(r.resource_id, r.name, r.size, r.is_cover, r.reason) for r in fb2.resources(elements).orderBy("resource_id").collect()] == [(0, "x", 1, False, None), (1, "y", None, True, "invalid_base64"), (2, "x", 0, False, None)]


def test_nodes_are_shuffled_once(spark, sf):
    """Documents are dealt out, then their elements by the book: no join, no broadcast, read once."""
    plan = plans.fb2_nodes(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Broadcast" not in plan and plan.count("Exchange hashpartitioning") == 1 and plan.count("MapInPandas") == 1


def test_nodes_of_odd_documents(spark):
    """Notes in two bodies and by type, repeated ids of binaries, codes of several texts, holders of nothing."""
    text = """<F><body><section><list>bare <a l:href="#n2" xmlns:l="x">w</a></list><p><a href="#n1">1</a><a href="#q" type="NOTE">2</a><a href="u">3</a><code> a<b>b </b>
    <code>c</code></code><image href="#i"/><image/></p><poem><stanza/><v id="v">x</v></poem></section></body>
    <body name="notes"><section id="n1"><p>t</p></section><annotation id="n2"/></body><body name="NOTES"><cite id="n3"><code>k<i>l</i></code></cite></body><binary id="i"/><binary id="i"/></F>"""
    got = fb2.nodes(xml.elements(spark.createDataFrame([(1, text), (None, text)], "book_id int, content string"))).orderBy("node_id").collect()
    told = [[(r.body, r.node_id, r.kind, r.tag, r.text, r.href, r.resource) for r in got if r.book_id == k] for k in (1, None)]
    assert told[0] == told[1]
    assert [(t[4], t[5]) for t in told[0] if t[2] in ("Link", "Footnote") or t[4]] == [("w", None), (None, "body-3.xhtml#n1"), ("1", None), (None, "body-3.xhtml#q"), ("2", None), (None, "u"), ("3", None), ("a b c", None), ("x", None), ("t", None), ("k", None), ("l", None)]
    assert [(t[2], t[3], t[6]) for t in told[0] if t[3] == "image" or t[2] == "Image"] == [("Image", None, 0), ("GenericInline", "image", None)]
