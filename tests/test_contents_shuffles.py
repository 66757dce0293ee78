from vellumine.plans import trees


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_contents_are_shuffled_once(spark, sf):
    """Places and trees are made where one shuffle by book brings the points together."""
    assert _exchanges(trees.contents_tree(spark, sf)) == 1
    # points twice (Spark reuses the one for the other), tree and wanted paths; no broadcast however small the tree
    assert _exchanges(trees.contents_lookups(spark, sf)) == 4
