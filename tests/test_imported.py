from vellumine.operators import text_structure


def test_an_import_stays_in_its_row(spark):
    """A document is read once, in its row: no join, shuffle or window; rows that share a key, or have none, are told apart."""
    text = "Chapter 1\n\nOne\n\nChapter 2\n\nPart 1\n\ntext\nPrologue\nmore\n\nChapter 9"
    df = spark.createDataFrame([(1, text), (None, "Chapter 1\n\nalone"), (2, "a\n\nb"), (2, "c")], "doc_id long, text string")
    made = text_structure.imported(df, novel=True)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in ("Join", "Exchange", "Window") if x in plan]
    rows = made.collect()
    heads = {(r.line, r.text, r.level, r.confidence) for r in rows if r.doc_id == 1 and r.kind == "heading"}
    found = text_structure.headings(df.where("doc_id = 1"), novel=True).collect()
    assert heads == {(r.line, r.title, r.level, "StronglyInferred" if r.score >= 85 else "Heuristic") for r in found} and heads
    assert [(r.node_id, r.text) for r in rows if r.doc_id is None] == [(0, "Chapter 1"), (1, "alone")]
    assert sorted((r.node_id, r.text) for r in rows if r.doc_id == 2) == [(0, "a"), (0, "c"), (1, "b")]
