"""Quality by a factorisation machine over hashed words, structure and metadata.

y = b + Σ w_i x_i + Σ_{i<j} ⟨v_i, v_j⟩ x_i x_j, where the pairs are summed in linear time
as ½ Σ_f [(Σ v_if x_i)² - Σ v_if² x_i²]. Inputs are hashed words (log counts, scaled by
the root of their number), structure statistics and the stored length as metadata.

Fitted in numpy on the driver on at most ``MOST`` documents per label of the train fold,
drawn by hash (the documented bound of the sample), weighted back to the share each label
has in the fold; every document is scored, whole, in a narrow pass.

Defined results: a null or empty text has no words and is scored by its structure; with
one label only, or none, every score is the share of label 1, or 0; a null doc_id counts
as held out; rows are scored one by one, so ties and repeated rows do not matter; repeated
labels count once; a missing or null stored length is taken from the text.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from roostline.llm import batches, features, toxicity

MOST = 2_000
THRESHOLD = 0.3
BITS = 15
RANK = 4
SEED = 7


class Model(NamedTuple):
    """``words`` and ``pairs`` by bucket; ``about`` and ``about_pairs`` by structure statistic."""

    bias: float
    words: np.ndarray
    pairs: np.ndarray
    about: np.ndarray
    about_pairs: np.ndarray
    mean: np.ndarray
    scale: np.ndarray


def scaled(about: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((about - mean) / scale, -6, 6)


def values(text: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
    """Input of each (text, bucket): the log count over the root of the text's buckets."""
    return np.log1p(count) / np.sqrt(np.maximum(np.bincount(text, minlength=n), 1))[text]


def forward(m: Model, text: np.ndarray, bucket: np.ndarray, x: np.ndarray, z: np.ndarray, n: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The machine's output per text and Σ v x of each factor."""
    y = m.bias + np.bincount(text, x * m.words[bucket], minlength=n) + z @ m.about
    sums = []
    for f in range(m.pairs.shape[1]):
        vx = m.pairs[bucket, f] * x
        s = np.bincount(text, vx, minlength=n) + z @ m.about_pairs[:, f]
        y = y + 0.5 * (s**2 - np.bincount(text, vx**2, minlength=n) - (z**2) @ (m.about_pairs[:, f] ** 2))
        sums.append(s)
    return y, sums


def fit_machine(samples: list[features.Sample], share: float, bits: int = BITS, rank: int = RANK, rounds: int = 120, rate: float = 0.03, l2: float = 3e-4, seed: int = SEED) -> Model:
    """Logistic loss, Adam steps; ``samples`` are those of label 0 and 1."""
    text = np.concatenate([samples[0].row, samples[1].row + samples[0].n])
    bucket, count = (np.concatenate([getattr(s, k) for s in samples]) for k in ("bucket", "count"))
    about = np.concatenate([s.structure for s in samples])
    n, label = len(about), np.repeat([0.0, 1.0], [samples[0].n, samples[1].n])
    weight = np.where(label == 1, share / samples[1].n, (1 - share) / samples[0].n)
    x, mean, scale = values(text, count, n), about.mean(0), about.std(0) + 1e-6
    z = scaled(about, mean, scale)
    columns, at = np.unique(bucket, return_inverse=True)
    rng = np.random.default_rng(seed)
    shapes = [(), (len(columns),), (len(columns), rank), (z.shape[1],), (z.shape[1], rank)]
    p = [np.zeros(s) if len(s) < 2 else rng.normal(0, 0.05, s) for s in shapes]
    p[0] = np.array(np.log(share / (1 - share)))
    first, second = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes]
    for step in range(1, rounds + 1):
        m = Model(float(p[0]), p[1], p[2], p[3], p[4], mean, scale)
        y, sums = forward(m, text, at, x, z, n)
        d = weight * (1 / (1 + np.exp(-np.clip(y, -30, 30))) - label)
        dx = d[text] * x
        g = [np.array(d.sum()), np.bincount(at, dx, minlength=len(columns)), np.empty(shapes[2]), z.T @ d, np.empty(shapes[4])]
        square = np.bincount(at, dx * x, minlength=len(columns))
        z_square = (z**2).T @ d
        for f, s in enumerate(sums):
            g[2][:, f] = np.bincount(at, dx * s[text], minlength=len(columns)) - p[2][:, f] * square
            g[4][:, f] = z.T @ (d * s) - p[4][:, f] * z_square
        for i in range(5):
            g[i] = g[i] + (l2 * p[i] if i else 0.0)
            first[i], second[i] = 0.9 * first[i] + 0.1 * g[i], 0.99 * second[i] + 0.01 * g[i] ** 2
            p[i] = p[i] - rate * first[i] / (1 - 0.9**step) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-8)
    words, pairs = np.zeros(1 << bits), np.zeros((1 << bits, rank))
    words[columns], pairs[columns] = p[1], p[2]
    return Model(float(p[0]), words, pairs, p[3], p[4], mean, scale)


def train(documents: DataFrame, labels: DataFrame, most: int = MOST, seed: int = SEED) -> Model | float:
    """The model of the train fold, or the constant score where one label is missing."""
    fold = labels.where(features.train_fold(F.col("doc_id")) & F.col("quality").isNotNull())
    share = fold.agg(F.avg(F.col("quality").cast("double"))).first()[0]
    if not share or share >= 1:
        return float(share or 0.0)
    samples = []
    for value in (0, 1):
        drawn = features.labelled(documents, labels, "quality", value, most, seed)
        samples.append(features.Sample(features.table(drawn, BITS, ()).select("result").toArrow()))
    if not samples[0].n or not samples[1].n:
        return float(share)
    return fit_machine(samples, share)


def scored(documents: DataFrame, model: Model | float) -> DataFrame:
    """Columns ``row`` (all of ``documents``) and ``result.score``."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def produce(parts):
        m = shared.value
        for part in parts:
            if isinstance(m, float):
                yield part, [np.full(part.num_rows, m)]
                continue
            _, (text, bucket, count), about = features.of_part(part, BITS, ())
            y, _ = forward(m, text, bucket, values(text, count, part.num_rows), scaled(about, m.mean, m.scale), part.num_rows)
            yield part, [1 / (1 + np.exp(-np.clip(y, -500, 500)))]

    return batches.with_results(documents, "text", StructType([StructField("score", DoubleType())]), produce)


def inputs(documents: DataFrame) -> DataFrame:
    """The columns the model may see, and the id."""
    return documents.select("doc_id", "text", *[F.col("n_chars").cast("long").alias("n_chars") for c in documents.columns if c == "n_chars"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: how likely each document is of good quality."""
    documents = inputs(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    model = train(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.digest(scored(documents, model), THRESHOLD)
