"""Requests for metadata: which are valid, how each is routed, and the candidates that a table of records has for it.

A request takes the first route that it has a field for: ISBN, identifier,
title and author, free text. Records offer a key for each route, so that one
equality join by route and key finds all candidates. Requests that ask the
same are one question, and of records that no question tells apart only the
first can be among the results, so that the work follows the records and the
questions, not their pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumine.functions.text import collapse, utrim
from vellumine.operators import linkage

#: Bytes of a request's field, results of a request and results unless it says how many; fixed values.
MAX_BYTES, MAX_RESULTS, RESULTS = 512, 20, 10
FIELDS = ("query", "isbn", "identifier", "title", "author")
_CONTROL = r"\p{Cc}"


def filled(x: str) -> Column:
    """A field without white space around it; null if nothing is left."""
    return F.nullif(utrim(F.coalesce(F.col(x), F.lit(""))), F.lit(""))


def fault() -> Column:
    """Why a request is refused: nothing asked, a field too long, or control characters in one; null if it is not."""
    fields = [F.coalesce(F.col(f), F.lit("")) for f in (*FIELDS, "locale")]
    asked = F.coalesce(*[filled(f) for f in FIELDS])
    long, control = F.lit(False), F.lit(False)
    for f in fields:
        long, control = long | (F.octet_length(f) > MAX_BYTES), control | f.rlike(_CONTROL)
    return F.when(asked.isNull(), "empty").when(long, "too_long").when(control, "control_characters")


def result_limit(x: Column) -> Column:
    return F.least(F.greatest(F.coalesce(x, F.lit(RESULTS)), F.lit(1)), F.lit(MAX_RESULTS))


def encoded(x: Column) -> Column:
    """``x`` as part of a query string: all bytes but letters, digits and -_.~ as percent signs."""
    out = F.url_encode(x)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def route() -> Column:
    return F.when(filled("isbn").isNotNull(), "isbn").when(filled("identifier").isNotNull(), "identifier").when(F.coalesce(filled("title"), filled("author")).isNotNull(), "fields").otherwise("text")


def parameters() -> Column:
    """The query string of a request: the limit, then what its route asks."""
    one = lambda name, value: F.concat(F.lit(f"{name}="), encoded(value))
    fields = F.array_compact(F.array(*[F.when(filled(f).isNotNull(), one(f, filled(f))) for f in ("title", "author")]))
    asked = F.when(route() == "isbn", F.array(one("isbn", filled("isbn")))).when(route() == "identifier", F.array(one("q", filled("identifier")))).when(route() == "fields", fields).otherwise(F.array(one("q", F.coalesce(filled("query"), F.lit("")))))
    return F.array_join(F.concat(F.array(F.concat(F.lit("limit="), result_limit(F.col("max_results")))), asked), "&")


def clean_text(x: Column, most: int) -> Column:
    """A record's text without white space around it; null if it is empty, longer than ``most`` bytes, or has control characters."""
    trimmed = utrim(x)
    return F.when((trimmed != "") & (F.octet_length(trimmed) <= most) & ~trimmed.rlike(_CONTROL), trimmed)


def clean_list(x: Column, items: int, most: int) -> Column:
    """The first ``items`` clean texts of a list."""
    return F.slice(F.filter(F.transform(F.coalesce(x, F.array().cast("array<string>")), lambda v: clean_text(v, most)), lambda v: v.isNotNull()), 1, items)


def normal(x: Column) -> Column:
    return F.coalesce(F.lower(collapse(x)), F.lit(""))


def candidates(requests: DataFrame, records: DataFrame, key: str = "request_id") -> DataFrame:
    """(key, place, record_id, confidence): the best records of each valid request, at most as many as it asks for.

    ``requests`` has (key, query, isbn, identifier, title, author, locale,
    max_results), ``records`` (record_id, title, authors, isbns, identifiers).
    A record fits an ISBN or identifier that it has, and a title, an author or
    both, or a free text that is its title, white space and case aside. Ties
    go to the smaller id.
    """
    clean = records.select("record_id", clean_text(F.col("title"), 512).alias("r_title"), clean_list(F.col("authors"), 32, 256).alias("r_authors"), clean_list(F.col("isbns"), 32, 64).alias("isbns"), "identifiers")
    title, authors = normal(F.col("r_title")), F.array_distinct(F.transform("r_authors", normal))

    def offer(name: str, keys: Column) -> Column:
        return F.transform(keys, lambda k: F.struct(F.lit(name).alias("route"), k.alias("at")))

    pair = F.transform(authors, lambda a: F.concat(title, F.lit("\n"), a))
    offers = F.concat(offer("isbn", F.array_distinct("isbns")), offer("identifier", F.array_distinct(F.coalesce("identifiers", F.array().cast("array<string>")))), offer("title", F.array(title)), offer("author", authors), offer("both", pair))
    told = ["untitled", "found", "writers"]  # all of a record that its confidence depends on
    offered = clean.select("record_id", F.col("r_title").isNull().alias("untitled"), title.alias("found"), F.array_sort(authors).alias("writers"), F.inline(offers))
    among = F.row_number().over(Window.partitionBy("route", "at", *told).orderBy("record_id"))
    offered = offered.withColumn("among", among).where(F.col("among") <= MAX_RESULTS)
    t, a = filled("title"), filled("author")
    by = F.when(route() != "fields", F.when(route() == "text", "title").otherwise(route())).when(t.isNull(), "author").when(a.isNull(), "title").otherwise("both")
    at = F.when(route() == "isbn", filled("isbn")).when(route() == "identifier", filled("identifier")).when(route() == "text", normal(filled("query"))).when(by == "author", normal(a)).when(by == "title", normal(t)).otherwise(F.concat(normal(t), F.lit("\n"), normal(a)))
    question = ["route", "at", "wanted", "named", "writer"]
    asked = requests.where(fault().isNull()).select(
        key, by.alias("route"), at.alias("at"), normal(F.coalesce(t, F.col("query"))).alias("wanted"), F.col("author").isNotNull().alias("named"), normal(F.col("author")).alias("writer"), result_limit(F.col("max_results")).alias("most")
    )
    met = asked.groupBy(*question).agg(F.max("most").alias("most")).join(offered, ["route", "at"])
    wanted, found = F.col("wanted"), F.col("found")
    base = F.when(wanted == found, linkage.EQUAL).when((wanted != "") & (F.contains(wanted, found) | F.contains(found, wanted)), linkage.INSIDE).otherwise(linkage.OTHER)
    same = F.col("named") & F.coalesce(F.array_contains("writers", F.col("writer")), F.lit(False))
    sure = F.when(F.col("untitled"), linkage.UNASKED).otherwise(F.least(base + F.when(same, linkage.AUTHOR).otherwise(0.0), F.lit(linkage.CAP)))
    place = F.row_number().over(Window.partitionBy(*question).orderBy(F.desc("confidence"), "record_id"))
    ranked = met.withColumn("confidence", F.round(sure, 6)).withColumn("place", place).where((F.col("place") <= MAX_RESULTS) & (F.col("place") <= F.col("most")))
    answers = ranked.groupBy(*question).agg(F.array_sort(F.collect_list(F.struct("place", "record_id", "confidence"))).alias("answers"))
    return asked.join(answers, question).select(key, F.inline(F.slice("answers", F.lit(1), F.col("most"))))
