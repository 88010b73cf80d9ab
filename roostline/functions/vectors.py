"""Cosine distance in double precision, one Arrow batch at a time.

Spark has no vector functions; measured on 384 dimensions, an Arrow batch product costs
about a sixth of the same sum written with higher-order functions.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roostline import config


def matrix(lists: pa.Array) -> np.ndarray:
    """A list array without NULLs as rows of doubles."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(lists), -1) if len(lists) else flat.reshape(0, 0)


def distances(cosines: np.ndarray) -> np.ndarray:
    """``1 - cos`` at the precision distances are compared with."""
    # Adding zero turns a rounded minus zero into zero.
    return np.round(1.0 - cosines, config.DISTANCE_DECIMALS) + 0.0


def _with_nulls(valid: np.ndarray, values: np.ndarray) -> pa.Array:
    out = np.zeros(len(valid), dtype=np.float64)
    out[valid] = values
    return pa.array(out, mask=~valid)


def distance_to(vector: Column, query: Sequence[float]) -> Column:
    """Cosine distance of a vector column to one query vector; NULL vectors stay NULL."""
    unit = np.asarray(query, dtype=np.float64)
    unit = unit / np.linalg.norm(unit)

    @F.arrow_udf(T.DoubleType())
    def distance(vectors: pa.Array) -> pa.Array:
        valid = np.array(vectors.is_valid())
        rows = matrix(vectors.filter(pa.array(valid)))
        if not len(rows):
            return _with_nulls(valid, [])
        return _with_nulls(valid, distances(rows @ unit / np.linalg.norm(rows, axis=1)))

    return distance(vector)
