"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

Random Fourier features approximate a Gaussian kernel over standardised
document statistics. Each partition sums its share of the normal equations;
Spark adds the shares and the driver solves one system of fixed size. The raw
scores are calibrated by isotonic regression over a histogram of fixed size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumine.llm.quality_rules import STATS, counted, transformed
from vellumine.llm.shared import keyed, saved

#: Statistics that a score depends on.
INPUTS = (*STATS, "digits", "lines")
#: Bins of the calibration histogram, over raw scores from -0.5 to 1.5.
BINS = 2000


def crc_fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


@dataclass
class Model:
    """A fitted classifier; all its arrays have a size fixed by parameters."""

    mean: np.ndarray
    spread: np.ndarray
    frequency: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    levels: tuple[np.ndarray, np.ndarray]

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -6, 6) @ self.frequency + self.phase
        return np.concatenate([np.cos(z) * np.sqrt(2 / len(self.phase)), np.ones((len(x), 1))], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), *self.levels), 0.0, 1.0)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in INPUTS], axis=1)


def statistics(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, h, INPUTS) of each row of ``docs``."""
    made = counted(keyed(docs, doc_id, text))
    digits = F.sqrt(F.col("n_digits") / (F.col("n_chars_all") + 1)).alias("digits")
    lines = F.log((F.col("n_lines") + 1) / (F.col("n_words") + 1)).alias("lines")
    return made.select("doc_id", "h", *transformed(), digits, lines)


def _isotonic(bins: np.ndarray, total: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over occupied bins; centres and levels of the blocks."""
    blocks: list[list[float]] = []  # weight, sum of labels, sum of centre * weight
    for centre, s, w in zip(bins, total, n):
        blocks.append([w, s, centre * w])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return np.array([b[2] / b[0] for b in blocks]), np.array([b[1] / b[0] for b in blocks])


def fit(rows: DataFrame, features: int = 128, width: float = 3.0, ridge: float = 1e-3, seed: int = 7) -> Model | None:
    """A model of ``label`` (0 to 1) from INPUTS; rows with ``calibrate`` only shape the calibration.

    None if there are no rows to fit. All rows are used: sums by partition,
    never the rows themselves, reach the driver.
    """
    d, size = len(INPUTS), features + 1
    train = rows.where("NOT calibrate")
    moments = train.agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m_{c}") for c in INPUTS], *[F.stddev_pop(c).alias(f"s_{c}") for c in INPUTS]).first()
    if not moments["n"]:
        return None
    rng = np.random.default_rng(seed)
    spread = np.array([moments[f"s_{c}"] for c in INPUTS])
    model = Model(
        np.array([moments[f"m_{c}"] for c in INPUTS]), np.where(spread > 1e-9, spread, 1.0),
        rng.normal(size=(d, features)) / width, rng.uniform(0, 2 * np.pi, features), np.zeros(size), (np.array([0.0, 1.0]), np.array([0.0, 1.0])),
    )
    upper = np.triu_indices(size)

    def shares(batches):
        gram, right = np.zeros((size, size)), np.zeros(size)
        for batch in batches:
            z = model.features(_matrix(batch))
            gram += z.T @ z
            right += z.T @ batch.column("label").to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(upper[0]) + size, dtype=np.int32)), pa.array(np.concatenate([gram[upper], right]))], ["place", "share"])

    summed = train.mapInArrow(shares, "place int, share double").groupBy("place").agg(F.sum("share").alias("share")).toPandas().sort_values("place")["share"].to_numpy()
    gram = np.zeros((size, size))
    gram[upper] = summed[: len(upper[0])]
    gram += np.triu(gram, 1).T
    penalty = np.full(size, ridge * moments["n"])
    penalty[-1] = 0.0
    model.weights = np.linalg.solve(gram + np.diag(penalty) + 1e-9 * np.eye(size), summed[len(upper[0]) :])
    held = _apply(rows.where("calibrate"), model.raw, "raw", ["label"])
    bin_no = F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor((F.col("raw") + 0.5) * (BINS / 2)))).cast("int")
    histogram = held.groupBy(bin_no.alias("bin")).agg(F.sum("label").alias("y"), F.count("*").alias("n")).toPandas().sort_values("bin")
    if len(histogram):
        model.levels = _isotonic(histogram["bin"].to_numpy() * 2 / BINS - 0.5 + 1 / BINS, histogram["y"].to_numpy(float), histogram["n"].to_numpy(float))
    return model


def _apply(rows: DataFrame, score, name: str, carry: list[str]) -> DataFrame:
    def of_batches(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), pa.array(score(_matrix(batch)), pa.float64())], [*carry, name])

    schema = rows.select(*carry).schema.add(name, "double")
    return rows.mapInArrow(of_batches, schema)


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of ``docs``.

    Learns from the rows of ``labels`` whose id has a crc32 fold from 1 to 4
    (1 to 3 fit, 4 calibrates); several labels of one id are averaged, null
    labels and ids are left out. Scores depend on the text alone: null counts
    as empty and repeated texts score alike. Without any label to learn from
    every score is 0.5. A null id is not held out. An empty table gives an
    empty result.
    """
    stats = saved(statistics(docs, doc_id, text), "statistics")
    marks = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("double").alias("label")).where("doc_id IS NOT NULL AND label IS NOT NULL")
    marks = marks.where(crc_fold(F.col("doc_id")) != 0).groupBy("doc_id").agg(F.avg("label").alias("label"))
    model = fit(saved(stats.join(marks, "doc_id").withColumn("calibrate", crc_fold(F.col("doc_id")) == 4), "train"))
    if model is None:
        scored = stats.select("doc_id", F.lit(0.5).alias("score"))
    else:
        scored = _apply(stats, model.score, "score", ["doc_id"])
    held_out = F.coalesce(crc_fold(F.col("doc_id")) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
