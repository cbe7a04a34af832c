"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the distinct hashed character 4-, 5- and 6-grams of the lower-cased whole text.
Each feature f carries the log ratio of its smoothed document rates in the two classes,
r_f = log((n1+1)/(N1+2)) - log((n0+1)/(N0+2)); ratios within `min_z` standard errors of zero
become zero. A logistic regression on the presence vector scaled by r gives the score.

It is fitted on a bounded sample: at most `max_toxic` toxic and `max_clean` other labelled
texts of the training fold, the first by a hash of doc_id. Texts and feature lists stay on executors: every L-BFGS
step broadcasts the weights and gets one summed slope a task. The fitted table has a fixed size
(2**20 floats) and is broadcast; every row is scored by its whole text.

Edge cases: null and empty texts get the score of a text without features; without labels of
both classes every score is 0; repeated labels of a document count once, toxic if any says so;
rows with a null doc_id are never learned from; extra columns, clashing names among them, are ignored
and kept by `keep_clean`. Labels, lang, source and doc_id never enter a score.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, written

BITS = 20
GRAMS = (4, 5, 6)
MAX_TOXIC, MAX_CLEAN = 4000, 8000
MIN_Z, RIDGE = 3.0, 1e-4
STEPS = 12  # stopping early regularises as well
THRESHOLD = 0.7
ROWS_PER_TASK, ROWS_PER_BATCH = 1000, 200


class Model(NamedTuple):
    bias: float
    weights: np.ndarray  # float32, 2**BITS


def fold(doc_id: Column) -> Column:
    """crc32 of the doc_id as text, mod 3; 1 is held out."""
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3


class Grams:
    """Distinct hashed n-grams of texts; the scratch table is reused between texts."""

    def __init__(self):
        self.mark = np.zeros(1 << BITS, np.int32)

    def __call__(self, text: str | None) -> np.ndarray:
        # a text begins and ends with a space, so that n-grams see word borders
        a = np.frombuffer(f" {text or ''} ".lower().encode("utf-32-le", "replace"), np.uint32)
        h = a * np.uint32(0x9E3779B1)
        out, run = [], h
        for n in range(2, GRAMS[-1] + 1):
            run = (run[:-1] ^ (run[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + h[n - 1 :]
            if n in GRAMS:
                out.append((run * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BITS))
            if len(run) < 2:
                break
        idx = np.concatenate(out) if out else np.zeros(0, np.uint32)
        at = np.arange(len(idx), dtype=np.int32)
        self.mark[idx] = at
        return idx[self.mark[idx] == at].astype(np.int32)


def picked(labels: DataFrame, max_toxic: int, max_clean: int) -> DataFrame:
    """(doc_id, toxic) of the bounded training sample, the first of each class by a hash."""
    known = labels.where(F.col("toxic").isNotNull() & (fold(F.col("doc_id")) != 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    toxic, clean = known.where("toxic = 1"), known.where("toxic <> 1")
    return written(toxic.orderBy(*order).limit(max_toxic).unionByName(clean.orderBy(*order).limit(max_clean)).select("doc_id", F.col("toxic").cast("int").alias("toxic")))


def sampled(docs: DataFrame, labels: DataFrame, max_toxic: int, max_clean: int) -> DataFrame:
    """(text, toxic) of the sample, written once and dealt evenly over a number of tasks that the bound fixes."""
    # at most max_toxic + max_clean (doc_id, label) rows are broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(picked(labels, max_toxic, max_clean)), "doc_id").select("text", "toxic")
    return written(rows.repartition(-(-(max_toxic + max_clean) // ROWS_PER_TASK)))


def log_ratios(sample: DataFrame, n0: int, n1: int, min_z: float) -> np.ndarray:
    """By n-gram, the log ratio of its document rates in the classes, 0 where it tells nothing; 2**BITS numbers.
    Counts are summed on executors, a range of n-grams at a time; the driver gets the ratios."""
    size = 1 << 17

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, got, some = Grams(), np.zeros((2, 1 << BITS), np.uint32), False
        for pdf in batches:
            for toxic, text in zip(pdf.toxic, pdf.text):
                got[toxic][of(text)] += 1
                some = True
        if some:
            at = range(0, 1 << BITS, size)
            yield pd.DataFrame({"part": range(len(at)), "counts": [zlib.compress(got[:, i : i + size].tobytes(), 1) for i in at]})

    def ratio(pdf: pd.DataFrame) -> pd.DataFrame:
        in0, in1 = np.sum([np.frombuffer(zlib.decompress(c), np.uint32) for c in pdf.counts], axis=0, dtype=np.int64).reshape(2, -1)
        r = np.log((in1 + 1) / (n1 + 2)) - np.log((in0 + 1) / (n0 + 2))
        error = np.sqrt(1 / (in1 + 1) - 1 / (n1 + 2) + 1 / (in0 + 1) - 1 / (n0 + 2))
        r[np.abs(r) < min_z * error] = 0
        return pd.DataFrame({"part": [pdf.part.iloc[0]], "ratios": [r.astype(np.float32).tobytes()]})

    with small_batches(sample.sparkSession, ROWS_PER_BATCH):
        got = sample.mapInPandas(count, "part int, counts binary").groupBy("part").applyInPandas(ratio, "part int, ratios binary").collect()
    return np.concatenate([np.frombuffer(r.ratios, np.float32) for r in sorted(got, key=lambda r: r.part)])


def minimised(loss, x: np.ndarray, steps: int, memory: int = 8) -> np.ndarray:
    """L-BFGS: x after `steps` evaluations of loss(x) -> (value, slope), or when no step improves it."""
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    value, slope = loss(x)
    rate = 1.0
    for _ in range(steps - 1):
        d, back = slope.copy(), []
        for s, y in reversed(pairs):
            a = s @ d / (s @ y)
            back.append(a)
            d -= a * y
        d *= pairs[-1][0] @ pairs[-1][1] / (pairs[-1][1] @ pairs[-1][1]) if pairs else 1 / max(1e-12, np.abs(slope).sum())
        for (s, y), a in zip(pairs, reversed(back)):
            d += s * (a - y @ d / (s @ y))
        new = x - rate * d
        new_value, new_slope = loss(new)
        if new_value > value - 1e-4 * rate * (slope @ d):
            rate /= 4
            if rate < 1e-6:
                break
            continue
        s, y = new - x, new_slope - slope
        if s @ y > 1e-10:
            pairs = [*pairs[1 - memory :], (s, y)]
        x, value, slope, rate = new, new_value, new_slope, 1.0
    return x


def fit(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN, min_z: float = MIN_Z, steps: int = STEPS, ridge: float = RIDGE) -> Model:
    spark = docs.sparkSession
    sample = sampled(docs, labels, max_toxic, max_clean)
    held = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = held.get(0, 0), held.get(1, 0)
    weights = np.zeros(1 << BITS, np.float32)
    if not n1 or not n0:
        return Model(-np.inf, weights)
    ratio = log_ratios(sample, n0, n1, min_z)
    used = np.flatnonzero(ratio)
    if not len(used):
        return Model(float(np.log(n1 / n0)), weights)
    telling = spark.sparkContext.broadcast(ratio != 0)  # 2**BITS flags

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, column = Grams(), (np.cumsum(telling.value) - 1).astype(np.int32)
        for pdf in batches:
            yield pd.DataFrame({"toxic": pdf.toxic, "features": [column[g[telling.value[g]]].tobytes() for g in map(of, pdf.text)]})

    with small_batches(spark, ROWS_PER_BATCH):
        rows = written(sample.mapInPandas(features, "toxic int, features binary"))
    r, n = ratio[used].astype(np.float64), n0 + n1

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        """Mean log loss and its slope at weights x[:-1] and bias x[-1]; each task adds up its rows."""
        sent = spark.sparkContext.broadcast(((r * x[:-1]).astype(np.float32), float(x[-1])))

        def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            (scaled, b), value, offset = sent.value, 0.0, 0.0
            slope = np.zeros(len(scaled), np.float32)
            for pdf in batches:
                for toxic, f in zip(pdf.toxic, pdf.features):
                    at, sign = np.frombuffer(f, np.int32), 1.0 if toxic else -1.0
                    z = sign * (b + float(scaled[at].sum(dtype=np.float64)))
                    value += np.logaddexp(0.0, -z)
                    miss = -sign / (1 + np.exp(min(z, 500.0)))
                    slope[at] += miss
                    offset += miss
            yield pd.DataFrame({"value": [value], "offset": [offset], "slope": [slope.tobytes()]})

        value, offset, slope = 0.0, 0.0, np.zeros(len(r))
        for part in rows.mapInPandas(partial, "value double, offset double, slope binary").collect():
            value, offset = value + part.value, offset + part.offset
            slope += np.frombuffer(part.slope, np.float32)
        sent.destroy()
        return value / n + ridge / 2 * float(x[:-1] @ x[:-1]), np.append(r * slope / n + ridge * x[:-1], offset / n)

    with small_batches(spark, ROWS_PER_BATCH):
        x = minimised(loss, np.append(np.zeros(len(used)), np.log(n1 / n0)), steps)
    weights[used] = x[:-1] * r
    return Model(float(x[-1]), weights)


def scorer(model: Model, spark: SparkSession):
    """A column function: the score of a text, taken whole."""
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        grams, (bias, weights) = Grams(), sent.value
        for texts in batches:
            z = np.array([bias + weights[grams(t)].sum(dtype=np.float64) for t in texts], np.float64)
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -500, 500))) if np.isfinite(bias) else np.zeros(len(texts)))

    return of


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    scored = docs.select("doc_id", scorer(fit(docs, labels), docs.sparkSession)("text").alias("score"))
    return scored.select(
        "doc_id", F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that are not predicted toxic, all columns as they are."""
    return docs.where(scorer(fit(docs, labels), docs.sparkSession)("text") < threshold)
