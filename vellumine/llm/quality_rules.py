"""Quality rules: hard text rules, then robust multivariate outliers.

Each document's statistics are transformed to be roughly normal. For every
language and source the minimum-covariance-determinant estimate of centre and
scatter is found by concentration steps; a document whose squared Mahalanobis
distance is beyond the cutoff is rejected.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumine.llm import words as W
from vellumine.llm.shared import joined, keyed, map_texts, saved

_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_DIGIT = np.isin(np.arange(256), list(b"0123456789"))
#: Bytes that begin a code point.
_LEAD = (np.arange(256) & 0xC0) != 0x80
_LETTER = np.array([chr(b).isalpha() if b < 0x80 else True for b in range(256)])
_STOP = np.isin(np.arange(256), list(b".!?"))

#: The counts that ``count_texts`` gives, all long.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars_all", "n_digits", "n_letters", "n_distinct", "n_lines", "n_stops")
#: The transformed statistics and the resolution of each: a spread that is always allowed for,
#: so that a statistic that is the same in most texts (no symbols) has no zero scatter.
STATS = {"word_length": 0.05, "symbols": 0.03, "letters": 0.1, "repeats": 0.2, "variety": 0.05, "length": 0.2, "stops": 0.15}
#: Share of a group that the estimate rests on, and what makes its scatter consistent for a normal sample
#: of d = 7 statistics: 0.75 / P(chi-square of d + 2 <= q) with q the 0.75 quantile of chi-square of d.
CORE, CONSISTENCY = 0.75, 1.33
#: Texts a statistic from which on a group has an estimate of its own. In a smaller one the distance of a text
#: outside the core says more of the sample than of the text: by Hotelling's law with 11 texts one clean text
#: in a hundred is beyond the cutoff.
TEXTS_A_STATISTIC = 4
#: The distance at which a text is rejected. A normal sample of seven has one in a thousand beyond 4.9; clean
#: texts have longer tails, and those that the rule is for lie far beyond 10.
CUTOFF = 10.0


def count_texts(texts: W.Texts) -> list[np.ndarray]:
    """The COUNTS of each text."""
    data, n = texts.data, texts.n
    start, end = W.spans(data, W.NOT_BLANK)
    owner = texts.owner(start)
    n_words = W.counts(owner, n)

    def total(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return sums[texts.start[1:]] - sums[texts.start[:-1]]

    word_chars = total(W.NOT_BLANK[data] & _LEAD[data])
    # Lines: a text ends with the newline that Texts adds.
    breaks = np.flatnonzero(data == 0x0A)
    line_start = np.concatenate([[0], breaks[:-1] + 1]) if len(breaks) else breaks
    line_owner = texts.owner(line_start)
    words_before = np.searchsorted(start, np.concatenate([line_start, [len(data)]]))
    wordy = np.diff(words_before) > 0
    key = W.mix(W.span_hashes(data, line_start, breaks) + line_owner.astype(np.uint64) * W.U(0x9E3779B97F4A7C15))[wordy]
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(key), bool)
    again[order[1:]] = key[order[1:]] == key[order[:-1]]
    n_dup = W.counts(line_owner[wordy][again], n)
    # 3-word windows that occur twice or more in their text.
    words = W.span_hashes(data, start, end)
    window = W.run_hashes(words, 3)
    own = owner[: len(window)]
    valid = owner[2:] == own if len(window) else np.zeros(0, bool)
    key = W.mix(window + own.astype(np.uint64) * W.U(0x9E3779B97F4A7C15))
    key[~valid] = np.arange(int((~valid).sum()), dtype=np.uint64)
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(key), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    twice &= valid
    covered = np.zeros(len(start), bool)
    at = np.flatnonzero(twice)
    for j in range(3):
        covered[at + j] = True
    n_repeat = W.counts(owner[covered], n)
    key = W.mix(words + owner.astype(np.uint64) * W.U(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    fresh = np.ones(len(order), bool)
    fresh[1:] = key[order[1:]] != key[order[:-1]]
    n_distinct = W.counts(owner[order[fresh]], n)
    return [
        n_words, word_chars, total(_SYMBOL[data]), n_dup, n_repeat, total(_LEAD[data]) - 1, total(_DIGIT[data]),
        total(_LETTER[data] & _LEAD[data]), n_distinct, W.counts(line_owner[wordy], n), total(_STOP[data]),
    ]


def counted(rows: DataFrame) -> DataFrame:
    """``rows`` with the COUNTS of ``text`` in its place."""
    return map_texts(rows, count_texts, ",".join(f"{c} long" for c in COUNTS))


def transformed() -> list[Column]:
    """The STATS of a counted text."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    chars = F.col("n_chars_all") + 1
    other = F.greatest(F.col("word_chars") - F.col("n_digits") - F.col("n_letters"), F.lit(0)) + 1
    made = {
        "word_length": F.log((F.col("word_chars") + 1) / (n + 1)),
        "symbols": F.sqrt(F.col("n_symbols") / chars),
        "letters": F.log((F.col("n_letters") + 1) / other),
        "repeats": F.sqrt(F.col("n_repeat_words") / n),
        "variety": F.log(F.greatest(F.col("n_distinct"), F.lit(1)) / n),
        "length": F.log(n),
        "stops": F.log((F.col("n_stops") + 1) / (n + 1)),
    }
    return [made[s].alias(s) for s in STATS]


def base_failed() -> Column:
    """The hard rules: under 50 words, or over half of the words in repeated 3-word windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _pools(stats: DataFrame, least: int) -> DataFrame:
    """(lang, source, pool): the group whose estimate a language and source use.

    A group of fewer than ``least`` texts is pooled with the small groups of
    its language, a small language pool with all such; a last pool that is
    still small has no estimate (pool null).
    """
    sizes = stats.where("NOT base_failed").groupBy("lang", "source").agg(F.count("*").alias("n"))
    sizes = sizes.withColumn("small", F.col("n") < least)
    by_lang = sizes.where("small").groupBy(F.col("lang").alias("l")).agg(F.sum("n").alias("n_lang"))
    level = F.when(~F.col("small"), 0).when(F.col("n_lang") >= least, 1).otherwise(2)
    put = sizes.join(by_lang, F.col("lang").eqNullSafe(F.col("l")), "left").withColumn("level", level)
    last = put.where("level = 2").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    name = F.when(F.col("level") == 0, F.to_json(F.struct("level", "lang", "source"))).when(F.col("level") == 1, F.to_json(F.struct("level", "lang"))).when(F.lit(last >= least), F.lit("all"))
    return put.select("lang", "source", name.alias("pool"))


def _start(stats: DataFrame) -> DataFrame:
    """(pool, mean, inverse): medians and quartile spreads."""
    quartiles = stats.groupBy("pool").agg(*[F.percentile_approx(s, [0.25, 0.5, 0.75], 1000).alias(s) for s in STATS])

    def rows(frames):
        for f in frames:
            q = np.array([np.stack(f[s].to_list()) for s in STATS]) if len(f) else np.zeros((len(STATS), 0, 3))
            spread = np.maximum((q[:, :, 2] - q[:, :, 0]) / 1.349, np.array(list(STATS.values()))[:, None])
            yield pd.DataFrame({"pool": f["pool"], "mean": list(q[:, :, 1].T), "inverse": [np.diag(1 / s**2).ravel() for s in spread.T]})

    return quartiles.mapInPandas(rows, "pool string, mean array<double>, inverse array<double>")


def _distance(mean: str = "mean", inverse: str = "inverse") -> Column:
    """Squared Mahalanobis distance from the pool's estimate."""
    d = len(STATS)
    off = [F.col(s) - F.col(mean)[i] for i, s in enumerate(STATS)]
    return sum((off[i] * off[j] * F.col(inverse)[i * d + j] * (1 if i == j else 2) for i in range(d) for j in range(i, d)), F.lit(0.0))


#: Bands of the squared distance to a factor of two.
BANDS = 8


def _concentrated(stats: DataFrame, fit: DataFrame) -> DataFrame:
    """One concentration step: mean and scatter of the CORE of each pool that lies nearest.

    Moments are summed by pool and distance band, so a pool of any size is
    pre-aggregated; the core is the bands up to the one that fills it.
    """
    d, names = len(STATS), list(STATS)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    band = F.floor(F.log2(F.col("distance") + 1e-6) * BANDS).cast("int")
    sums = [F.count("*").alias("n"), *[F.sum(s).alias(f"s{i}") for i, s in enumerate(names)], *[F.sum(F.col(names[i]) * F.col(names[j])).alias(f"p{i}_{j}") for i, j in pairs]]
    by_band = stats.join(fit, "pool").withColumn("distance", _distance()).groupBy("pool", band.alias("band")).agg(*sums)
    w = Window.partitionBy("pool")
    below = F.sum("n").over(w.orderBy("band").rowsBetween(Window.unboundedPreceding, -1))
    core = by_band.withColumn("below", F.coalesce(below, F.lit(0))).withColumn("all", F.sum("n").over(w)).where(F.col("below") < CORE * F.col("all"))
    moments = core.groupBy("pool").agg(*[F.sum(c).alias(c) for c in by_band.columns if c not in ("pool", "band")])

    def rows(frames):
        for f in frames:
            out = []
            for r in f.to_dict("records"):
                mean = np.array([r[f"s{i}"] for i in range(d)]) / r["n"]
                scatter = np.zeros((d, d))
                for i, j in pairs:
                    scatter[i, j] = scatter[j, i] = r[f"p{i}_{j}"] / r["n"] - mean[i] * mean[j]
                scatter = scatter * CONSISTENCY + np.diag(np.array(list(STATS.values())) ** 2)
                out.append({"pool": r["pool"], "mean": mean, "inverse": np.linalg.inv(scatter).ravel()})
            yield pd.DataFrame(out, columns=["pool", "mean", "inverse"])

    return moments.mapInPandas(rows, "pool string, mean array<double>, inverse array<double>")


def rate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", cutoff: float = CUTOFF, least: int = TEXTS_A_STATISTIC * len(STATS), steps: int = 5) -> DataFrame:
    """(doc_id, h, COUNTS, base_failed, distance, kept, pool) of each row of ``docs``.

    ``distance`` is the Mahalanobis distance from the robust estimate of the
    row's language and source, over texts that pass the hard rules; a row is
    kept if it passes them and its distance is ``cutoff`` at most. Groups of
    fewer than ``least`` such texts are pooled (``pool`` names the estimate
    that a row used); without a pool of that size the distance is null and
    the hard rules decide alone. Null text counts as
    empty (fails), null language or source as a group of its own. Repeated
    rows get the same verdict each; an empty table gives an empty result.
    """
    t = F.col(text).cast("string")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(t).alias("h"), F.col(lang).cast("string").alias("lang"), F.col(source).cast("string").alias("source"), t.alias("text"))
    stats = saved(counted(rows).withColumn("base_failed", base_failed()).select("*", *transformed()), "statistics")
    pools = _pools(stats, least).withColumnsRenamed({"lang": "l", "source": "s"})
    put = stats.join(pools, F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s")), "left").drop("l", "s")
    put = saved(put, "pooled")
    fitted = put.where("NOT base_failed AND pool IS NOT NULL")
    fit = saved(_start(fitted), "start")
    for _ in range(steps):
        fit = saved(_concentrated(fitted, fit), "step")
    rated = put.join(fit, "pool", "left").withColumn("distance", F.when(~F.col("base_failed"), F.sqrt(_distance())))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= cutoff, F.lit(True))
    return rated.select("doc_id", "h", *COUNTS, "base_failed", "distance", kept.alias("kept"), "pool")


def keep_good(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """The rows of ``docs`` that ``rate`` keeps, with all their columns."""
    good = rate(docs, doc_id, text, **settings).where("kept").select("doc_id", "h").distinct()
    return joined(docs, good, "left_semi", doc_id, text)
