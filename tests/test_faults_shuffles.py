from vellumine.operators import validation
from vellumine.plans import books


def test_claims_are_not_shuffled(spark, sf):
    """Lines are dealt out by their book, as many times as there are tables made of them; what they say, and whether it holds, is told there."""
    for query, joins in ((books.book_faults, 0), (books.book_verdicts, 1)):
        plan = query(spark, sf)._jdf.queryExecution().executedPlan().toString().splitlines()
        dealt = [x for x in plan if "Exchange" in x]
        assert sum("hashpartitioning(book_id" in x and "REPARTITION_BY_NUM" in x for x in dealt) == 10 and len(dealt) == 10 + joins
        assert sum("Join" in x for x in plan) == joins


def test_nodes_stand_where_their_document_does(spark):
    """A node of a document that is not there, or of none, places no anchor; repeated documents place it once."""
    table = lambda rows, schema: spark.createDataFrame(rows, f"book_id long, {schema}")
    made = validation.BookTables(
        resources=table([], "position long, resource_id long, kind string"),
        fonts=table([(1, "　", None)], "family string, resource_id long"),
        anchors=table([(1, 0, 1, "a", 10), (1, 1, 2, "b", 20), (2, 0, 1, "c", 10), (1, 2, None, "d", 30)], "position long, document_id long, name string, node_id long"),
        documents=table([(1, 1, "x"), (1, 1, "y"), (1, None, "z")], "document_id long, href string"),
        nodes=table([(1, 0, 1, 10, "link", None, None, ""), (1, 1, 2, 20, "p", None, None, None), (2, 0, 1, 10, "p", None, None, None), (1, 2, None, 30, "footnote", None, None, "u")], "position long, document_id long, node_id long, kind string, style_id long, resource_id long, href string"),
        variants=table([], "node_id long, target string, style_id long"),
        styles=table([], "style_id long"),
        links=table([], "origin string, href string"),
    )
    got = sorted((r.book_id, r.code, r.severity, r.subject) for r in validation.diagnostics(made).collect() if not r.code.startswith("STYLE"))
    assert got == [
        (1, "ANCHOR-0002", "error", "b"), (1, "ANCHOR-0002", "error", "d"), (1, "ANCHOR-0003", "error", "b"), (1, "ANCHOR-0003", "error", "d"), (1, "FONT-0001", "error", "　"), (1, "FONT-0002", "error", "　"), (1, "LINK-0001", "warning", "10"),
        (2, "ANCHOR-0002", "error", "c"), (2, "ANCHOR-0003", "error", "c"),
    ]
