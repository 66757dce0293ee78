"""Registered queries: streams over events, run to their end, and file formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.plans.text import read
from vellumine.sources import files
from vellumine.streaming import jobs


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by day and type (the batch form of the stream)."""
    made = jobs.event_windows(read(spark, sf_dir, "events"))
    return made.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


EVENT_WINDOWS = "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"


def job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as jobs: the latest event, and whether it ends them."""
    events = read(spark, sf_dir, "events").withColumn("state", F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise("running"))
    made = jobs.latest_states(events, "user_id")
    return made.select("user_id", "state", "n_events", "ended")


JOB_STATES = """SELECT user_id, state, n_events, state IN ('completed', 'failed') AS ended FROM (SELECT user_id, count(*) AS n_events,
CASE arg_max(event_type, (ts, event_id)) WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'running' END AS state FROM events GROUP BY 1)"""


def format_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats detected from bytes of pages and documents under misleading names."""
    pages = read(spark, sf_dir, "pages").select(F.lit("a.bin").alias("path"), F.encode("html", "UTF-8").alias("content"))
    docs = read(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 2 == 0, "b.txt").otherwise("b.md").alias("path"), F.encode("text", "UTF-8").alias("content"))
    return pages.unionByName(docs).groupBy(files.detected_format(F.col("path"), F.col("content")).alias("format")).agg(F.count("*").alias("n"))


FORMAT_COUNTS = r"""SELECT format, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(lower(left(html, 512)), '^\s*(?:<!doctype html|<html|<head|<body)') THEN 'html' ELSE 'unsupported' END AS format FROM pages
UNION ALL SELECT CASE WHEN doc_id % 2 = 1 THEN 'markdown' WHEN regexp_matches(lower(left(text, 512)), '^\s*(?:<!doctype html|<html|<head|<body)') THEN 'html' ELSE 'text' END FROM documents) GROUP BY format"""


def decoded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents encoded one way or another and decoded again, which gives them back."""
    docs = read(spark, sf_dir, "documents")
    k = F.col("doc_id") % 3
    data = F.when(k == 0, F.encode("text", "UTF-16LE")).when(k == 1, F.encode("text", "UTF-8")).otherwise(F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "UTF-8")))
    made = files.decoded(docs.select("doc_id", F.sha2("text", 256).alias("wanted"), data.alias("content")))
    return made.select("doc_id", "encoding", (F.sha2("text", 256) == F.col("wanted")).alias("same"))


DECODED_TEXTS = "SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND text <> '' THEN 'utf-16-le' ELSE 'utf-8' END AS encoding, true AS same FROM documents"


_ALL = (event_windows, job_states, format_counts, decoded_texts)
QUERIES = {f.__name__: f for f in _ALL}
SQL = {name: globals()[name.upper()] for name in QUERIES if name.upper() in globals()}
