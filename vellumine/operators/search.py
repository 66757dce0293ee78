"""Full-text search: an inverted index by DataFrame, BM25 and phrases."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumine.session import checkpointed

#: A token: letters and digits, lower-cased.
TOKEN = r"[\p{L}\p{N}]+"
EDGE = r"[\p{L}\p{N}]"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def _whole(first: str, rest: str = rf"(?!{EDGE})") -> str:
    """The pattern of a token, by its letters first: what stands before it is looked at only where they are found."""
    return rf"{first}(?<!{EDGE}{first}){rest}"


def bm25(docs: DataFrame, terms: list[str], key: str = "doc_id", text: str = "text", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(key, score) of documents with any of the terms, larger is better.

    One scan counts lengths and the terms' occurrences inside each row, which
    are kept as a checkpoint; only
    two aggregates (document count and mean length, the terms' document
    frequencies) leave it, both of fixed size.
    """
    terms = sorted({t.lower() for t in terms})
    low = F.lower(F.coalesce(text, F.lit("")))
    counts = [F.regexp_count(low, F.lit(_whole(term))).alias(f"tf{i}") for i, term in enumerate(terms)]
    # counted once and kept: a few bytes a row, which the statistics and the scores both read
    rows = checkpointed(docs.select(key, F.regexp_count(low, F.lit(TOKEN + "+")).alias("n"), *counts))
    s = rows.agg(F.count("*").alias("docs"), F.avg("n").alias("mean"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))]).first()
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf = F.col(f"tf{i}")
        idf = F.log((F.lit(s["docs"]) - s[f"df{i}"] + 0.5) / (s[f"df{i}"] + 0.5) + 1)
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("n") / (s["mean"] or 1.0)))
    return rows.where(" OR ".join(f"tf{i} > 0" for i in range(len(terms)))).select(key, score.alias("score"))


def phrase(docs: DataFrame, query: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_hits): documents that hold the query's tokens in a row; an empty query finds nothing."""
    wanted = "".join(c if c.isalnum() else " " for c in query.lower()).split()
    if not wanted:
        return docs.select(key, F.lit(0).alias("n_hits")).limit(0)
    edge, gap = r"[\p{L}\p{N}]", r"[^\p{L}\p{N}]+"
    rest = rf"(?={gap}{gap.join(wanted[1:])}(?!{edge}))" if len(wanted) > 1 else rf"(?!{edge})"
    hits = F.regexp_count(F.lower(text), F.lit(_whole(wanted[0], rest)))
    return docs.where(F.contains(F.lower(text), F.lit(wanted[0]))).select(key, hits.alias("n_hits")).where("n_hits > 0")


def ranked_phrase(rows: DataFrame, query: str, fields: list[str], key: str = "book_id", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(key, rank): rows that hold the query's tokens in a row in one of ``fields``, the best rank (bm25 below zero) least.

    The phrase is one term: its hits in all fields are its frequency, a row's
    length are the tokens of all fields. One pass counts; the number of rows,
    of hits and the mean length are all that leaves it.
    """
    wanted = "".join(c if c.isalnum() else " " for c in query.lower()).split()
    if not wanted:
        return rows.select(key, F.lit(0.0).alias("rank")).limit(0)
    gap = r"[^\p{L}\p{N}]+"
    rest = rf"(?={gap}{gap.join(wanted[1:])}(?!{EDGE}))" if len(wanted) > 1 else rf"(?!{EDGE})"
    text = [F.lower(F.coalesce(f, F.lit(""))) for f in fields]
    hits = sum((F.regexp_count(t, F.lit(_whole(wanted[0], rest))) for t in text), F.lit(0))
    size = sum((F.regexp_count(t, F.lit(TOKEN + "+")) for t in text), F.lit(0))
    counted = checkpointed(rows.select(key, hits.alias("f"), size.alias("d")))
    s = counted.agg(F.count("*").alias("n"), F.count_if(F.col("f") > 0).alias("hit"), F.avg("d").alias("mean")).first()
    idf = max(math.log((s["n"] - s["hit"] + 0.5) / (s["hit"] + 0.5)), 1e-6)
    f = F.col("f")
    rank = -idf * f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("d") / (s["mean"] or 1.0)))
    return counted.where("f > 0").select(key, rank.alias("rank"))


def index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(token, key, positions): the inverted index, for many queries over one corpus."""
    each = docs.select(key, F.posexplode(tokens(F.coalesce(text, F.lit("")))).alias("position", "token"))
    return each.groupBy("token", key).agg(F.array_sort(F.collect_list("position")).alias("positions"))
