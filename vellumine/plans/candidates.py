"""Registered queries: requests of the customers for their orders' records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.operators import candidates
from vellumine.plans.text import read


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").selectExpr(
        "c_custkey as request_id",
        "if(c_custkey % 5 in (3, 4), concat(' title ', c_custkey % 40, ' '), '') as query",
        "if(c_custkey % 5 = 0, concat(' ', c_custkey % 90), '  ') as isbn",
        "if(c_custkey % 5 = 1, concat('id*', c_custkey % 70), null) as identifier",
        "if(c_custkey % 5 = 2, concat('TITLE  ', c_custkey % 40), null) as title",
        "if(c_custkey % 10 in (2, 3), concat('customer  ', c_custkey % 30, '~é'), null) as author",
        "if(c_custkey % 50 = 9, char(7), 'en') as locale",
        "if(c_custkey % 3 = 0, null, cast(c_custkey % 30 - 3 as int)) as max_results",
    )


def request_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each customer's request is routed, and which are refused."""
    return _requests(spark, sf_dir).select("request_id", candidates.fault().alias("fault"), candidates.route().alias("route"), candidates.parameters().alias("parameters"))


_LIMIT = "least(greatest(CASE WHEN k % 3 = 0 THEN 10 ELSE k % 30 - 3 END, 1), 20)"
_ROUTE = "CASE WHEN k % 5 = 0 THEN 'isbn' WHEN k % 5 = 1 THEN 'identifier' WHEN k % 5 = 2 OR k % 10 = 3 THEN 'fields' ELSE 'text' END"
_R = "r AS (SELECT c_custkey AS k FROM customer)"
REQUEST_ROUTES = f"""WITH {_R} SELECT k AS request_id, CASE WHEN k % 50 = 9 THEN 'control_characters' END AS fault, {_ROUTE} AS route, 'limit=' || {_LIMIT} || CASE {_ROUTE} WHEN 'isbn' THEN '&isbn=' || k % 90 WHEN 'identifier' THEN '&q=id%2A' || k % 70
WHEN 'fields' THEN CASE WHEN k % 5 = 2 THEN '&title=TITLE%20%20' || k % 40 ELSE '' END || CASE WHEN k % 10 IN (2, 3) THEN '&author=customer%20%20' || k % 30 || '~%C3%A9' ELSE '' END ELSE '&q=title%20' || k % 40 END AS parameters FROM r"""


def request_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of the orders' records for each request."""
    records = read(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as record_id", "if(o_orderkey % 17 = 0, ' ', concat('Title ', o_orderkey % 40)) as title", "array(concat(' Customer ', o_orderkey % 30, '~É'), 'x') as authors", "array(cast(o_orderkey % 90 as string), char(1)) as isbns", "array(concat('id*', o_orderkey % 70)) as identifiers"
    )
    return candidates.candidates(_requests(spark, sf_dir), records).withColumn("place", F.col("place").cast("long"))


REQUEST_CANDIDATES = f"""WITH {_R}, q AS (SELECT k, {_ROUTE} AS route, {_LIMIT} AS most, CASE WHEN k % 5 IN (2, 3, 4) THEN k % 40 END AS t, CASE WHEN k % 10 IN (2, 3) THEN k % 30 END AS a FROM r WHERE k % 50 <> 9),
d AS (SELECT o_orderkey AS o, CASE WHEN o_orderkey % 17 <> 0 THEN o_orderkey % 40 END AS t, o_orderkey % 30 AS a FROM orders),
m AS (SELECT q.*, o, d.t AS dt, d.a AS da FROM q JOIN d ON q.route = 'isbn' AND o % 90 = k % 90 UNION ALL SELECT q.*, o, d.t, d.a FROM q JOIN d ON q.route = 'identifier' AND o % 70 = k % 70
UNION ALL SELECT q.*, o, d.t, d.a FROM q JOIN d ON q.route = 'text' AND d.t = q.t UNION ALL SELECT q.*, o, d.t, d.a FROM q JOIN d ON q.route = 'fields' AND k % 5 = 2 AND d.t = q.t AND (q.a IS NULL OR q.a = d.a) UNION ALL SELECT q.*, o, d.t, d.a FROM q JOIN d ON q.route = 'fields' AND k % 5 = 3 AND q.a = d.a),
c AS (SELECT k, o, most, round(CASE WHEN dt IS NULL THEN 0.40 ELSE CASE WHEN t IS NULL THEN 0.52 WHEN t = dt THEN 0.92 WHEN contains('title ' || t, 'title ' || dt) OR contains('title ' || dt, 'title ' || t) THEN 0.76 ELSE 0.52 END + CASE WHEN a = da THEN 0.06 ELSE 0 END END::DOUBLE, 6) AS confidence FROM m)
SELECT k AS request_id, place, o AS record_id, confidence FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY confidence DESC, o) AS place FROM c) WHERE place <= most"""

QUERIES = {f.__name__: f for f in (request_routes, request_candidates)}
SQL = {"request_routes": REQUEST_ROUTES, "request_candidates": REQUEST_CANDIDATES}
