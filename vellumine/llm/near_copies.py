"""Near copies by the exact similarity of word shingles.

Two documents link when the Jaccard similarity of their shingle sets is
``threshold`` or more. Fingerprints of 64 bits do not reach so far: at 0.8 two
of them differ by about 9 bits, where too many segments would be needed. So
candidates come from BANDS bands of ROWS least hashes; a pair at 0.8 shares none
with a probability of 1e-7, one that is more alike with a smaller one. Each
candidate is verified on the sets before it links.

Equal sets are a class and are never compared. At a band the classes are
compared with the least of them only, and just the pairs that this leaves in
different components are compared with each other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumine.llm import words as W
from vellumine.llm.components import connected
from vellumine.llm.shared import broadcast_if_small, keyed, map_texts, saved
from vellumine.llm.simhash import first_of_each, shingles_of

U = np.uint64
BANDS, ROWS = 40, 5
_rng = np.random.default_rng(20240611)
_ODD = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * U(2) + U(1)
_ADD = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
#: Least hashes of which a bit is kept, and bits of two sets that may differ: at 0.8 more do with a probability of 1e-6 at most.
BITS, MOST_BITS = 126, 32


def _sets(texts: W.Texts, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, by text and hash, and how many each has."""
    owner, h = shingles_of(texts, shingle)
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])
    return owner[new], h[new], W.counts(owner[new], texts.n)


def _lists(n: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(values.view(np.int64)))


def _signed(texts: W.Texts, shingle: int) -> list:
    """Class, size, two bitmaps and band keys of each text's set; an empty set has no keys."""
    owner, h, n = _sets(texts, shingle)
    full = np.flatnonzero(n)
    heads = (np.cumsum(n) - n)[full]
    code, bits, keys = np.zeros(texts.n, np.uint64), np.zeros((2, texts.n), np.uint64), np.zeros((len(full), BANDS), np.uint64)
    if len(full):
        code[full] = W.mix(np.add.reduceat(W.mix(h), heads) + n[full].astype(np.uint64))
        for band in range(BANDS):
            key = np.full(len(full), U(band + 1))
            for k in range(band * ROWS, (band + 1) * ROWS):
                least = W.mix(np.minimum.reduceat(h * _ODD[k] + _ADD[k], heads))
                key = W.mix(key * U(0x9E3779B97F4A7C15) + least)
                if k < BITS:
                    bits[k % 2, full] |= (least >> U(63)) << U(k // 2)
            keys[:, band] = key
    return [code.view(np.int64), n, bits[0].view(np.int64), bits[1].view(np.int64), _lists(np.where(n > 0, BANDS, 0), keys.ravel())]


def _may_match(threshold: float):
    """Length and bitmap filter of the classes a and b of a pair."""
    apart = F.bit_count(F.col("bits0_a").bitwiseXOR(F.col("bits0_b"))) + F.bit_count(F.col("bits1_a").bitwiseXOR(F.col("bits1_b")))
    return (F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b") - 1e-9) & (apart <= MOST_BITS)


def _as(classes: DataFrame, side: str, *more: str) -> DataFrame:
    names = ["code", "n", "bits0", "bits1", *more]
    return classes.select(*[F.col(c).alias(side if c == "code" else f"{c}_{side}") for c in names])


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of classes whose sets are similar enough."""
    both = pairs.join(sets.select(F.col("code").alias("a"), F.col("grams").alias("ga")), "a").join(sets.select(F.col("code").alias("b"), F.col("grams").alias("gb")), "b")
    shared = F.size(F.array_intersect("ga", "gb"))
    return both.where(shared >= threshold * (F.size("ga") + F.size("gb") - shared) - 1e-9).select("a", "b")


def _grams(rows: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(code, grams): the set of each class of ``wanted`` (code, vq_id, vq_h), from the text of one row."""
    found = rows.join(broadcast_if_small(wanted), rows["doc_id"].eqNullSafe(wanted["vq_id"]) & (rows["h"] == wanted["vq_h"]))

    def of_texts(texts):
        _, h, n = _sets(texts, shingle)
        return [_lists(n, h)]

    return map_texts(found.select("code", "text"), of_texts, "grams array<bigint>").dropDuplicates(["code"])


def links(rows: DataFrame, signed: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """(a, b): verified pairs of classes that join all classes which verified pairs join."""
    classes = saved(signed.groupBy("code").agg(F.min(F.struct("doc_id", "h")).alias("row"), *[F.first(c).alias(c) for c in ("n", "bits0", "bits1")], F.first("keys").alias("keys")), "classes")
    bands = classes.select("code", F.explode("keys").alias("key"))
    hubs = saved(bands.groupBy("key").agg(F.min("code").alias("hub"), F.count("*").alias("many")).where("many > 1").drop("many"), "hubs")
    members = saved(bands.join(broadcast_if_small(hubs), "key"), "members")
    pairs = members.where("code <> hub").select(F.col("code").alias("a"), F.col("hub").alias("b")).distinct()
    met = saved(pairs.join(_as(classes, "a"), "a").join(_as(classes, "b"), "b").where(_may_match(threshold)).select("a", "b"), "pairs")
    wanted = members.select("code").distinct().join(classes, "code").select("code", F.col("row.doc_id").alias("vq_id"), F.col("row.h").alias("vq_h"))
    sets = saved(_grams(rows, saved(wanted, "wanted"), shingle), "sets")
    near = saved(_verified(met, sets, threshold), "near")
    # Classes of a band that are in different components may still link, to others than the least.
    roots = connected(near).withColumnRenamed("node", "code")
    placed = saved(members.join(saved(roots, "roots"), "code", "left").withColumn("root", F.coalesce("root", "code")), "placed")
    several = placed.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("key")
    open_ = placed.join(broadcast_if_small(saved(several, "several")), "key").join(classes.select("code", "n", "bits0", "bits1"), "code")
    open_ = saved(open_, "open")
    if open_.isEmpty():
        return near
    a, b = _as(open_, "a", "key", "hub", "root"), _as(open_, "b", "key", "hub", "root")
    met = a.join(b, F.col("key_a") == F.col("key_b")).where((F.col("a") < F.col("b")) & (F.col("a") != F.col("hub_a")) & (F.col("root_a") != F.col("root_b")) & _may_match(threshold))
    return near.unionByName(saved(_verified(saved(met.select("a", "b").distinct(), "pairs"), sets, threshold), "near"))


def rooted(rows: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """(doc_id, h, root) of each row of ``keyed``; root names the component of the row's set."""
    fields = "code long,n long,bits0 long,bits1 long,keys array<bigint>"
    signed = saved(map_texts(rows, lambda texts: _signed(texts, shingle), fields), "signed")
    roots = saved(connected(links(rows, signed, shingle, threshold)), "roots").withColumnRenamed("node", "code")
    return signed.select("doc_id", "h", "code").join(roots, "code", "left").select("doc_id", "h", F.coalesce("root", "code").alias("root"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """``docs`` with one row of each component of similar texts: the one with the least doc_id.

    A text of fewer words than ``shingle`` is one shingle; texts without words
    are alike. All columns stay. A null doc_id counts as larger than any
    other. Of rows that share the least id the one with the smaller text hash
    stays, and of rows that share id and text one. An empty table stays empty.
    """
    return first_of_each(docs, rooted(keyed(docs, doc_id, text), shingle, threshold), doc_id, text)
