from vellumine.operators import catalogue
from vellumine.plans.catalogue import tables


def test_relations_are_dealt_out_by_the_number_of_books(spark, sf):
    """As many tasks as the books call for meet relations and titles, not as many as cores."""
    c = tables(spark, sf)
    made = catalogue.titled_relations(c, 9 * catalogue.TASK_BOOKS)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert any("hashpartitioning(book_id" in x and ", 9), REPARTITION_BY_NUM" in x for x in plan.splitlines())
    assert made.count() == catalogue.relations(c).count()
    assert made.where("title IS NULL").isEmpty() and made.columns == ["book_id", "kind", "secondary", "value", "title"]
