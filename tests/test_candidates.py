"""Requests for metadata: refusals, routes and query strings, and candidates with odd fields."""

from pyspark.sql import functions as F

from vellumine.operators import candidates

SCHEMA = "request_id long, query string, isbn string, identifier string, title string, author string, locale string, max_results int"


def test_requests(spark):
    rows = [
        (1, "q", " 97 8 ", "i", "t", "a", None, None),
        (2, "q", " ", "i/d+*~é", "t", None, None, 99),
        (3, "q", None, None, " T ", "A&B", None, 0),
        (4, " free text ", None, None, None, " ", None, 3),
        (5, " ", None, "", None, None, None, None),
        (6, "x" * 513, None, None, None, None, None, None),
        (7, "é" * 256, None, None, None, None, None, None),
        (8, "q", None, None, None, None, "e\nn", None),
        (9, None, None, None, None, "only", None, None),
    ]
    got = spark.createDataFrame(rows, SCHEMA).select("request_id", candidates.fault().alias("f"), candidates.route().alias("r"), candidates.parameters().alias("p")).orderBy("request_id").collect()
    assert [r.f for r in got] == [None, None, None, None, "empty", "too_long", None, "control_characters", None]
    assert [r.r for r in got[:4]] == ["isbn", "identifier", "fields", "text"] and got[8].r == "fields"
    assert [r.p for r in got[:4]] == ["limit=10&isbn=97%208", "limit=20&q=i%2Fd%2B%2A~%C3%A9", "limit=1&title=T&author=A%26B", "limit=3&q=free%20text"]
    assert got[8].p == "limit=10&author=only"


def test_clean(spark):
    row = spark.range(1).select(candidates.clean_list(F.array(*[F.lit(x) for x in (" a ", "", "b\x07", "c" * 9, "d", "e")], F.lit(None)), 2, 8).alias("l"), candidates.clean_text(F.lit(None), 8).alias("n")).first()
    assert row.l == ["a", "d"] and row.n is None


def test_candidates(spark):
    records = [(1, "The  Book", ["Ann B"], ["1"], ["x"]), (2, "the book", ["Bob", "ann  b"], ["1", "1"], None), (3, None, None, ["1"], ["x", "x"]), (4, "the book", ["Ann B"] * 40, [], [])]
    records = spark.createDataFrame(records, "record_id long, title string, authors array<string>, isbns array<string>, identifiers array<string>")
    rows = [(1, "", "1", None, None, None, None, None), (2, "", None, "x", None, None, None, None), (3, "", None, None, "THE BOOK", None, None, 2), (4, "", None, None, "the book", " ANN b", None, None), (5, "the book", None, None, None, None, None, None), (6, "", None, None, None, "Bob", None, None), (7, "", None, None, None, None, None, None), (8, "no such", None, None, None, None, None, None)]
    got = {}
    for r in candidates.candidates(spark.createDataFrame(rows, SCHEMA), records).orderBy("request_id", "place").collect():
        got.setdefault(r.request_id, []).append((r.record_id, r.confidence))
    assert got == {
        1: [(1, 0.52), (2, 0.52), (3, 0.4)],
        2: [(1, 0.52), (3, 0.4)],
        3: [(1, 0.92), (2, 0.92)],
        4: [(1, 0.98), (2, 0.98), (4, 0.98)],
        5: [(1, 0.92), (2, 0.92), (4, 0.92)],
        6: [(2, 0.58)],
    }
    assert candidates.candidates(spark.createDataFrame([], SCHEMA), records).count() == 0


def test_alike_requests_and_records_do_not_meet_pair_by_pair(spark):
    """20,000 requests against 20,000 records of one title: 400 million pairs, which no plan may form."""
    records = spark.range(20_000).selectExpr("id as record_id", "if(id % 2 = 0, 'The Book', ' the  BOOK') as title", "array(concat('a', id % 2)) as authors", "array('1') as isbns", "cast(null as array<string>) as identifiers")
    asked = spark.range(20_000).selectExpr("id as request_id", "'the book' as query", "cast(null as string) as isbn", "cast(null as string) as identifier", "cast(null as string) as title", "if(id = 7, 'A1', null) as author", "'en' as locale", "cast(id % 25 as int) as max_results")
    asked = asked.withColumn("isbn", F.when(F.col("request_id") == 7, "1"))
    made = candidates.candidates(asked, records).persist()
    most = {k: min(max(k % 25, 1), 20) for k in range(20_000)}
    assert made.count() == sum(most.values())
    assert [(r.record_id, r.confidence) for r in made.where("request_id = 19999").orderBy("place").collect()] == [(n, 0.92) for n in range(most[19_999])]
    assert [(r.record_id, r.confidence) for r in made.where("request_id = 7").orderBy("place").collect()] == [(2 * n + 1, 0.98) for n in range(7)]
    made.unpersist()
