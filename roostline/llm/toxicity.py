"""Toxicity by non-negative positive-unlabelled learning.

The model learns from confirmed toxic documents and from unlabelled text only; no
document has to be known as clean. The risk of a linear scorer f with class prior π is
π·E₊[l(f)] + max(0, E_u[l(-f)] - π·E₊[l(-f)]): what unlabelled text costs as negative,
less the share that the prior says is positive. Where that difference falls below zero the
step goes back up, which keeps a flexible model from calling everything unlabelled clean.

Fitted in numpy on the driver on at most ``MOST_POSITIVE`` confirmed and
``MOST_UNLABELLED`` other documents of the train fold, drawn by hash (the documented bound
of the sample); π is the share of toxic ones among all labels of that fold. The weights
(one float a bucket) go to the tasks, which score whole texts in a narrow pass.

Defined results: null and empty texts have no features and get the score of the bias;
without confirmed documents every score is 0; a null doc_id counts as held out; rows are
scored one by one, so ties and repeated rows do not matter; repeated labels count once.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from roostline.llm import batches, features

MOST_POSITIVE = 2_000
MOST_UNLABELLED = 5_000
THRESHOLD = 0.5
SEED = 10


class Model(NamedTuple):
    weights: np.ndarray  # of log(1 + count), by bucket
    bias: float


def evidence(positive: np.ndarray, n_positive: int, unlabelled: np.ndarray, n_unlabelled: int, least_docs: int = 3, least: float = 0.7) -> np.ndarray:
    """Scale of each bucket: how much commoner it is in toxic documents, as a log ratio; else 0."""
    ratio = np.log((positive + 0.5) / (n_positive + 1)) - np.log((unlabelled + 0.5) / (n_unlabelled + 1))
    return np.where((positive >= least_docs) & (ratio > least), ratio, 0.0)


def fit_nnpu(positive: features.Sample, unlabelled: features.Sample, prior: float, bits: int, rounds: int = 150, rate: float = 0.05, l2: float = 5e-4) -> Model:
    """Minimise the non-negative risk with logistic losses and Adam steps."""
    buckets = 1 << bits
    df = [np.bincount(s.bucket, minlength=buckets) for s in (positive, unlabelled)]
    scale = evidence(df[0], positive.n, df[1], unlabelled.n)
    columns = np.flatnonzero(scale)
    place = np.zeros(buckets, np.int64)
    place[columns] = np.arange(len(columns))
    row, col, x = [], [], []
    for s, base in ((positive, 0), (unlabelled, positive.n)):
        used = scale[s.bucket] != 0
        row.append(s.row[used] + base)
        col.append(place[s.bucket[used]])
        x.append(np.log1p(s.count[used]) * scale[s.bucket[used]])
    row, col, x = np.concatenate(row), np.concatenate(col), np.concatenate(x)
    n, n_p, n_u = positive.n + unlabelled.n, positive.n, unlabelled.n
    is_p = np.arange(n) < n_p
    w = np.zeros(len(columns) + 1)
    w[-1] = np.log(prior / (1 - prior))
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, rounds + 1):
        f = np.bincount(row, x * w[col], minlength=n) + w[-1]
        s = 1 / (1 + np.exp(-np.clip(f, -30, 30)))
        as_negative = -np.log1p(-np.minimum(s, 1 - 1e-12))
        negative_risk = as_negative[~is_p].sum() / n_u - prior * as_negative[is_p].sum() / n_p
        d_negative = np.where(is_p, -prior * s / n_p, s / n_u)
        d = d_negative + np.where(is_p, prior * (s - 1) / n_p, 0.0) if negative_risk >= 0 else -d_negative
        gradient = np.append(np.bincount(col, x * d[row], minlength=len(columns)) + l2 * w[:-1], d.sum())
        first, second = 0.9 * first + 0.1 * gradient, 0.99 * second + 0.01 * gradient**2
        w -= rate * first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    weights = np.zeros(buckets, np.float32)
    weights[columns] = w[:-1] * scale[columns]
    return Model(weights, float(w[-1]))


def train(documents: DataFrame, labels: DataFrame, most_positive: int = MOST_POSITIVE, most_unlabelled: int = MOST_UNLABELLED, seed: int = SEED) -> Model | None:
    """The model of the train fold; None without confirmed toxic documents."""
    fold = labels.where(features.train_fold(F.col("doc_id")) & F.col("toxic").isNotNull())
    share = fold.agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    if not share:
        return None
    docs = documents.select("doc_id", "text")
    positive = features.labelled(docs, labels, "toxic", 1, most_positive, seed)
    every = docs.where(features.train_fold(F.col("doc_id"))).select("doc_id").distinct()
    ids = every.orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id").limit(most_unlabelled)
    unlabelled = features.one_each(docs, ids)
    p, u = (features.Sample(features.table(d).select("result").toArrow()) for d in (positive, unlabelled))
    if not p.n or not u.n:
        return None
    return fit_nnpu(p, u, min(max(share, 1e-3), 0.9), features.BUCKET_BITS)


def scored(documents: DataFrame, model: Model | None) -> DataFrame:
    """Columns ``row`` (all of ``documents``) and ``result.score``."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def produce(parts):
        m = shared.value
        for part in parts:
            if m is None:
                yield part, [np.zeros(part.num_rows)]
                continue
            w = batches.words(part.column("text"))
            text, bucket, count = features.hashed(w, used=m.weights != 0)
            f = np.bincount(text, np.log1p(count) * m.weights[bucket], minlength=part.num_rows) + m.bias
            yield part, [1 / (1 + np.exp(-np.clip(f, -500, 500)))]

    return batches.with_results(documents, "text", StructType([StructField("score", DoubleType())]), produce)


def without_toxic(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``documents`` that score below ``threshold``, all columns kept."""
    return scored(documents, train(documents, labels)).where(F.col("result.score") < threshold).select("row.*")


def digest(found: DataFrame, threshold: float) -> DataFrame:
    """The columns of a scoring query."""
    held_out = ~F.coalesce(features.train_fold(F.col("row.doc_id")), F.lit(False))
    score = F.col("result.score")
    return found.select("row.doc_id", held_out.alias("held_out"), score.alias("score"), (score >= threshold).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: how likely each document is toxic."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return digest(scored(documents, model), THRESHOLD)
