from pyspark.sql import functions as F

from vellumine.operators import markup, projection
from vellumine.plans import trees


def test_texts_are_read_once(spark, sf):
    """Pages are dealt out, then their nodes by the page: parsed once, no join, no broadcast."""
    plan = trees.visible_texts(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Broadcast" not in plan and "InMemoryTableScan" not in plan
    assert plan.count("MapInPandas") == 1 and plan.count("Exchange hashpartitioning") == 1


def test_texts_of_odd_pages(spark):
    """Rubies in rubies, in their annotations, empty, without base, with drawings and blocks: as the operators that join tell them."""
    inner = "<ruby>i<rt>j</rt></ruby>"
    pages = ["", None, "<ruby></ruby>", "<p><ruby><rt></rt></ruby></p>", f"<p>a<ruby>b{inner}c<rp>(</rp><rt>d{inner}e</rt><rp>)</rp></ruby>f</p>", "<ruby><rb>b<img alt='x'><hr></rb><RT><p>q</p></RT></ruby>tail<ruby>z<rt>y</rt></ruby>", "<rt>no</rt><div><rp>p</rp></div>", f"{inner}{inner}", "<body><section><ruby><span>s<rt>not mine</rt></span><rt>r</rt></ruby></section></body>"]
    tree = projection.whole_formulas(projection.with_kinds(markup.nodes(spark.createDataFrame(list(enumerate(pages)), "page_id long, html string"), spaced=True))).persist()
    rubies = projection.ruby(tree).groupBy("page_id").agg(F.max("base").alias("base"), F.max("annotation").alias("annotation"))
    want = projection.text_content(tree).join(projection.visible_text(tree).withColumnRenamed("text", "visible"), "page_id").join(rubies, "page_id", "left").select("page_id", "text", "visible", "base", "annotation")
    assert sorted(projection.reading_texts(tree).collect()) == sorted(want.collect())
