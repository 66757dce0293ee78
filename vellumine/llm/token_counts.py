"""Token counts by an exact length histogram.

Documents are aggregated by encoded length; suffix sums over the histogram
answer totals, quantiles and truncated totals for every context limit without
reading a document again.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellumine.llm import words as W
from vellumine.llm.shared import keyed, map_texts

#: Folder of the vocabulary files and the one that is used.
TOKENIZERS = "/opt/tokenizers"
RANKS = "byte_bpe_50k.tiktoken"
#: The pattern that splits text before merges; a fixed value of that vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Lengths in a block of the suffix sums.
BLOCK = 1024

_encodings: dict[int, object] = {}


def _encoding(ranks: bytes):
    """The encoding of a rank file, built once in a worker process."""
    import tiktoken

    key = hash(ranks)
    if key not in _encodings:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        _encodings[key] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})
    return _encodings[key]


def token_lengths(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", folder: str = TOKENIZERS, ranks: str = RANKS) -> DataFrame:
    """(doc_id, h, n_tokens) of each row of ``docs``; special tokens' strings count as ordinary text."""
    with open(f"{folder}/{ranks}", "rb") as f:  # read on the driver, a vocabulary of fixed size
        sent = docs.sparkSession.sparkContext.broadcast(f.read())

    def lengths(texts: W.Texts) -> list[np.ndarray]:
        encode = _encoding(sent.value).encode_ordinary
        whole, at = texts.data.tobytes(), texts.start
        return [np.array([len(encode(whole[a : b - 1].decode())) for a, b in zip(at, at[1:])], np.int64)]

    return map_texts(keyed(docs, doc_id, text), lengths, "n_tokens long")


def histogram(lengths: DataFrame, limits: Iterable[int] = ()) -> DataFrame:
    """One row for each length that occurs and each of ``limits``, as a context limit.

    length; n_docs of that length; docs_at_least and tokens_at_least (of
    documents that long or longer); docs_below and tokens_below; truncated
    total (tokens if every document were cut at the limit); share_within (of
    documents that fit). Sums are exact. No documents give the limits alone,
    with zeros and a null share.
    """
    spark = lengths.sparkSession
    counts = lengths.groupBy(F.col("n_tokens").alias("length")).agg(F.count("*").alias("n_docs"))
    asked = spark.createDataFrame([(int(x),) for x in sorted(set(limits))], "length long").select("length", F.lit(0).cast("long").alias("n_docs"))
    counts = counts.unionByName(asked).groupBy("length").agg(F.sum("n_docs").alias("n_docs"))
    return suffix_sums(counts)


def suffix_sums(counts: DataFrame) -> DataFrame:
    """The histogram's answers from (length, n_docs), summed in two levels: in blocks of lengths, then over blocks."""
    counts = counts.withColumn("block", F.floor(F.col("length") / BLOCK)).withColumn("tokens", F.col("length") * F.col("n_docs"))
    blocks = counts.groupBy("block").agg(F.sum("n_docs").alias("block_docs"), F.sum("tokens").alias("block_tokens"))
    longer = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)  # a row for BLOCK lengths
    everything = Window.partitionBy(F.lit(1))
    later = blocks.select(
        "block",
        *[F.coalesce(F.sum(f"block_{c}").over(longer), F.lit(0)).alias(f"later_{c}") for c in ("docs", "tokens")],
        *[F.sum(f"block_{c}").over(everything).alias(f"all_{c}") for c in ("docs", "tokens")],
    )
    within = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    summed = counts.join(later, "block").select(
        "length",
        "n_docs",
        (F.sum("n_docs").over(within) + F.col("later_docs")).alias("docs_at_least"),
        (F.sum("tokens").over(within) + F.col("later_tokens")).alias("tokens_at_least"),
        "all_docs",
        "all_tokens",
    )
    below = F.col("all_tokens") - F.col("tokens_at_least")
    return summed.select(
        "length",
        "n_docs",
        "docs_at_least",
        "tokens_at_least",
        (F.col("all_docs") - F.col("docs_at_least")).alias("docs_below"),
        below.alias("tokens_below"),
        (below + F.col("length") * F.col("docs_at_least")).alias("truncated_total"),
        F.when(F.col("all_docs") > 0, (F.col("all_docs") - F.col("docs_at_least") + F.col("n_docs")) / F.col("all_docs")).alias("share_within"),
    )


def quantile(answers: DataFrame, share: float) -> DataFrame:
    """(length): the least length within which at least ``share`` of the documents fit."""
    return answers.where((F.col("share_within") >= share) & (F.col("n_docs") > 0)).agg(F.min("length").alias("length"))


def token_histogram(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", limits: Iterable[int] = (512, 1024, 2048, 4096, 8192, 32768), **tokenizer) -> DataFrame:
    """``histogram`` of the token lengths of ``docs``.

    Null text has no tokens (length 0), as has an empty one; repeated rows
    count each; texts are encoded whole.
    """
    return histogram(token_lengths(docs, doc_id, text, **tokenizer), limits)
