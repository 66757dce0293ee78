"""Corpus pipeline over ``documents``: rules, lines, near duplicates, benchmarks, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept. All but the last return the columns of their input.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.llm import components, decontaminate, line_dedup, near_copies, quality_rules, sentencepiece_lattice, simhash
from vellumine.llm.shared import keyed, read, shared_folder


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules; the others go.

    Null and empty texts have no words and go; a null language or source is a
    group of its own; rows that repeat one another pass or go together. All
    columns stay, whatever their names. An empty table stays empty.
    """
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier line matches; ``n_chars`` follows the text.

    Every row stays: one that loses all its lines has an empty text, a null
    text stays null. Null ids count as last; rows that share id and text are
    one. Other columns stay, but for ``vq_lines_out``, which a document may
    not bring along. An empty table stays empty.
    """
    kept = line_dedup.dedup_lines(docs).drop("vq_lines_out")
    return kept.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else kept


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates.

    Links are those of ``op5_simhash``: fingerprints at most four bits apart,
    found by one-bit deletion variants. Texts that are alike by 0.8 over
    shingles of five words, most of which fingerprints tell apart, add theirs.

    The one with the least id stays, of those that share it the one with the
    smaller text hash, of rows that repeat one another one. Texts without
    words, null ones too, are alike. All columns stay. An empty table stays
    empty.
    """
    rows = keyed(docs)
    near = components.united(simhash.rooted(rows, shingle=4, max_bits=4), near_copies.rooted(rows, shingle=5, threshold=0.8))
    return simhash.first_of_each(docs, near, "doc_id", "text")


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by ``benchmark``.

    Null and empty texts are clean; rows that repeat one another stay or go
    together. All columns stay. An empty table stays empty.
    """
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256): the piece ids of what is left, and a digest of the text that they decode to.

    Null and empty texts have no ids; repeated rows are encoded each. Other
    columns are left out: this is the last stage. An empty table gives an
    empty result.
    """
    decoded = sentencepiece_lattice.decode(sentencepiece_lattice.encode(docs))
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


#: Name and function of each stage, in order.
STAGES = [("rules", rules), ("lines", lines), ("near_duplicates", near_duplicates), ("benchmarks", benchmarks), ("pieces", pieces)]

#: SQL cannot express the stages (robust estimates, XXH64, subword merges).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``, each written and read again."""
    docs = read(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark).rstrip('/')}/vq-pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        made = stage(spark, docs, sf_dir)
        made.write.parquet(f"{folder}/{name}")
        docs = spark.read.schema(made.schema).parquet(f"{folder}/{name}")
    return docs
