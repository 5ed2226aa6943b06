"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text's features are the character n-grams that occur in it (lower case,
hashed to a fixed number of buckets, presence only).  Spark counts, over all
training rows, in how many texts of either class each bucket occurs; the log
ratio of the two smoothed frequencies scales the feature.  The buckets that
tell the classes apart best, a fixed number of them however many rows are
labelled, enter a logistic regression, fitted on a sample of training rows
whose size is a parameter.  Scoring is one pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from microstar.llm import common
from microstar.llm.hashing import mix, seeds

_U = np.uint64


@dataclass(frozen=True)
class Settings:
    sizes: tuple[int, ...] = (4, 5)   # characters of an n-gram
    bits: int = 18                    # 2**bits buckets
    smoothing: float = 1.0
    features: int = 1024              # buckets that enter the regression: those with the largest chi-squared
    sample_rows: int = 10_000         # training rows the regression is fitted on, at most
    penalty: float = 1.0              # of squared weights (on scaled features)
    rounds: int = 300


@dataclass
class Model:
    """``weights[bucket]`` adds to the log odds of a text that has the bucket."""

    settings: Settings
    weights: np.ndarray
    intercept: float


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text divides by 5."""
    return F.crc32(doc_id.cast("string")) % 5 == 0


def grams(texts: list[str], settings: Settings, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, bucket) pairs of a list of texts; only ``wanted`` buckets if given."""
    padded = [f" {t.lower()} " for t in texts]
    points = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, padded), dtype=np.int64, count=len(padded))
    owner = np.repeat(np.arange(len(padded), dtype=np.uint64), lengths)
    found = []
    for size in settings.sizes:
        n = len(points) - size + 1
        if n <= 0:
            continue
        total = np.zeros(n, dtype=np.uint64)
        for k, factor in enumerate(seeds(size, size)):
            total += points[k:k + n] * factor
        bucket = mix(total) >> _U(64 - settings.bits)
        inside = owner[:n] == owner[size - 1:]
        if wanted is not None:
            inside &= wanted[bucket]
        at = np.flatnonzero(inside)
        found.append((owner[at] << _U(settings.bits)) | bucket[at])
    pairs = np.unique(np.concatenate(found)) if found else np.empty(0, np.uint64)
    return (pairs >> _U(settings.bits)).astype(np.int64), (pairs & _U((1 << settings.bits) - 1)).astype(np.int64)


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, toxic) of labelled rows that are not held out; one label per id (the largest)."""
    marked = (labels.select(F.col("doc_id"), F.col("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)")
              .where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    # labels grow with the documents, so they are never broadcast, however few they are today
    return (docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
            .where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).join(marked.hint("merge"), "doc_id"))


def bucket_counts(rows: DataFrame, settings: Settings) -> DataFrame:
    """(bucket, toxic, n): in how many rows of each class a bucket occurs; bucket -1 counts rows.

    Counted inside each task first, so a task sends two rows a bucket at most.
    """
    n_buckets = 1 << settings.bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, n_buckets + 1), dtype=np.int64)
        for whole in batches:
            for batch in common.slices(whole, "text", 1 << 20):
                toxic = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
                text, bucket = grams(common.texts(batch.column(0)), settings)
                counts += np.bincount(toxic[text] * (n_buckets + 1) + bucket,
                                      minlength=2 * (n_buckets + 1)).reshape(2, -1)
                counts[:, -1] += np.bincount(toxic, minlength=2)
        side, bucket = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.where(bucket == n_buckets, -1, bucket)), pa.array(side), pa.array(counts[side, bucket])],
            ["bucket", "toxic", "n"])

    return (rows.select("text", "toxic").mapInArrow(run, "bucket long, toxic long, n long")
            .groupBy("bucket", "toxic").agg(F.sum("n").alias("n")))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          settings: Settings = Settings()) -> Model:
    """Learn from the labelled rows of ``docs`` that are not held out.

    Without rows of both classes the model has no weights and its intercept
    gives the smoothed share of toxic rows.
    """
    rows = training_rows(docs, labels, id_col, text_col)
    counts = np.zeros((2, (1 << settings.bits) + 1))
    for r in bucket_counts(rows, settings).toPandas().itertuples(index=False):  # bounded by the number of buckets
        counts[r.toxic, r.bucket] = r.n
    totals, seen = counts[:, -1], counts[:, :-1]
    a = settings.smoothing
    ratio = np.log((seen[1] + a) / (totals[1] + 2 * a)) - np.log((seen[0] + a) / (totals[0] + 2 * a))
    chi2 = _chi2(seen, totals)
    best = np.argsort(-chi2, kind="stable")[:settings.features]  # of equal ones the smaller buckets
    chosen = np.sort(best[chi2[best] > 0])
    wanted = np.zeros(1 << settings.bits, dtype=bool)
    wanted[chosen] = True
    texts, buckets, toxic = _sample(rows, settings, wanted)
    place = np.zeros(1 << settings.bits, dtype=np.int64)
    place[chosen] = np.arange(len(chosen))
    weights = np.zeros(1 << settings.bits)
    fitted, intercept = logistic(texts, place[buckets], ratio[chosen], toxic, settings)
    weights[chosen] = fitted * ratio[chosen]
    return Model(settings, weights, intercept)


def _chi2(seen: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Chi-squared of presence against class for every bucket."""
    n = totals.sum()
    has = seen.sum(axis=0)
    difference = seen[1] * (totals[0] - seen[0]) - seen[0] * (totals[1] - seen[1])
    scale = has * (n - has) * totals[0] * totals[1]
    return np.divide(difference ** 2 * n, scale, out=np.zeros_like(scale), where=scale > 0)


def _sample(rows: DataFrame, settings: Settings, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chosen buckets of at most ``sample_rows`` training rows, picked by a hash of the id."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.slices(whole, "text", 1 << 20):
                text, bucket = grams(common.texts(batch.column(1)), settings, wanted)
                ends = np.searchsorted(text, np.arange(batch.num_rows + 1))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(bucket, pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).cast(pa.int64()), batch.column(2).cast(pa.int64()), lists],
                    ["order", "toxic", "buckets"])

    total = rows.count()
    share = min(1.0, 1.2 * settings.sample_rows / max(total, 1))
    order = F.xxhash64(F.col("doc_id").cast("string"))
    picked = rows.withColumn("order", order)
    if share < 1.0:  # hash below a bound: a share a little over the sample, then the smallest hashes
        picked = picked.where(F.col("order") < int(-(1 << 63) + share * 2.0 ** 64))
    got = (picked.select("order", "text", "toxic").mapInArrow(run, "order long, toxic long, buckets array<int>")
           .orderBy("order").limit(settings.sample_rows).toPandas())
    lengths = got.buckets.map(len).to_numpy(dtype=np.int64)
    buckets = np.concatenate([np.asarray(b, dtype=np.int64) for b in got.buckets]) if lengths.sum() else np.empty(0, np.int64)
    return np.repeat(np.arange(len(got)), lengths), buckets, got.toxic.to_numpy(dtype=np.float64)


def logistic(rows: np.ndarray, columns: np.ndarray, scale: np.ndarray, labels: np.ndarray,
             settings: Settings) -> tuple[np.ndarray, float]:
    """Weights and intercept of a ridge-penalised logistic regression (accelerated gradient descent).

    ``rows``/``columns`` list the features that are present, each worth
    ``scale[column]``.
    """
    n, width = len(labels), len(scale)
    prior = (labels.sum() + 1) / (n + 2)
    intercept = float(np.log(prior / (1 - prior)))
    weights = np.zeros(width)
    if not len(rows) or labels.min() == labels.max():
        return weights, intercept
    value = scale[columns]
    # a bound on the curvature: largest squared row norm, by power iteration on the features
    v = np.ones(width) / np.sqrt(width)
    for _ in range(12):
        u = np.bincount(rows, weights=value * v[columns], minlength=n)
        v = np.bincount(columns, weights=value * u[rows], minlength=width)
        top = np.linalg.norm(v)
        v /= top
    step = 1.0 / (0.25 * (1.1 * top + n) + settings.penalty)
    ahead, ahead0, t = weights.copy(), intercept, 1.0
    for _ in range(settings.rounds):
        odds = np.bincount(rows, weights=value * ahead[columns], minlength=n) + ahead0
        error = 1 / (1 + np.exp(-np.clip(odds, -35, 35))) - labels
        new = ahead - step * (np.bincount(columns, weights=value * error[rows], minlength=width) + settings.penalty * ahead)
        new0 = ahead0 - step * error.sum()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, ahead0 = new + (t - 1) / t2 * (new - weights), new0 + (t - 1) / t2 * (new0 - intercept)
        weights, intercept, t = new, float(new0), t2
    return weights, intercept


def score_texts(texts: list[str], model: Model) -> np.ndarray:
    """Probability that each text is toxic."""
    text, bucket = grams(texts, model.settings, model.weights != 0)
    odds = np.bincount(text, weights=model.weights[bucket], minlength=len(texts)) + model.intercept
    return 1 / (1 + np.exp(-np.clip(odds, -35, 35)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every whole text.

    One row per input row.  Null and empty texts have no n-grams and get the
    intercept's score.  ``held_out`` is false for null ids.  Other columns
    are not read.  An empty table gives an empty result.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.slices(whole, "text", 1 << 20):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(score_texts(common.texts(batch.column(1)), model))], ["doc_id", "score"])

    scored = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {id_type}, score double")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Rows of ``docs``, all columns, whose whole text scores under 0.5; null texts count as empty."""
    @F.pandas_udf("double")
    def scored(column):
        import pandas as pd

        out, part, held = [], [], 0
        for t in column:
            part.append(t or "")
            held += len(part[-1])
            if held > 1 << 20:
                out.append(score_texts(part, model))
                part, held = [], 0
        return pd.Series(np.concatenate([*out, score_texts(part, model)]) if part or out else [], dtype="float64")

    return docs.where(scored(F.col(text_col)) < 0.5)
