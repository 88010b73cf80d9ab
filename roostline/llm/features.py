"""Features of texts for the classifiers: hashed words and word beginnings, and structure.

All are functions of the text alone, made for a batch of texts at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, IntegerType, StructField, StructType

from roostline.llm import batches

BUCKET_BITS = 18
# Lengths in bytes of the word beginnings; stems recur where whole words are rare.
STEMS = (4, 6, 8)
STRUCTURE = (
    "log_bytes", "log_words", "upper", "digit", "symbol", "space", "beyond_ascii", "word_bytes",
    "distinct", "repeated", "lines", "line_distinct", "ends", "commas", "log_n_chars",
)
_KIND = np.zeros(256, np.uint8)  # 1 upper, 2 digit, 3 symbol, 4 space, 5 beyond ASCII, 6 sentence end, 7 comma
_KIND[0x21:0x80] = 3
_KIND[ord("A") : ord("Z") + 1] = 1
_KIND[ord("a") : ord("z") + 1] = 0
_KIND[ord("0") : ord("9") + 1] = 2
_KIND[0x80:] = 5
_KIND[[9, 10, 11, 12, 13, 32]] = 4
_KIND[[ord("."), ord("!"), ord("?")]] = 6
_KIND[ord(",")] = 7


def counted(text: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, key) in order, and how often each stands."""
    if not len(key):
        return text[:0], key[:0], np.zeros(0, np.int64)
    both = np.sort((text.astype(np.int64) << 32) | key.astype(np.int64))
    first = np.concatenate([[True], both[1:] != both[:-1]])
    at = np.flatnonzero(first)
    return both[at] >> 32, both[at] & 0xFFFFFFFF, np.diff(np.append(at, len(both)))


def hashed(
    w: batches.Words, bits: int = BUCKET_BITS, stems: tuple[int, ...] = STEMS, used: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, count) of the words and word beginnings of each text; only ``used`` buckets."""
    text, mask = w.text, np.uint64((1 << bits) - 1)
    keys, texts = [], []
    for size in (0, *stems):
        if size:
            long = w.end - w.start > size
            part, of = w._replace(start=w.start[long], end=w.start[long] + size), text[long]
        else:
            part, of = w, text
        key = (batches.mix(batches.hashes(part) + np.uint64(size)) & mask).astype(np.int64)
        if used is not None:
            hit = used[key]
            key, of = key[hit], of[hit]
        keys.append(key)
        texts.append(of)
    return counted(np.concatenate(texts), np.concatenate(keys))


def structure(raw: np.ndarray, w: batches.Words, n_chars: np.ndarray | None = None) -> np.ndarray:
    """One row of ``STRUCTURE`` values per text; ``n_chars`` is the stored length, NaN unknown."""
    n, size = len(w.offsets) - 1, np.diff(w.offsets)
    words = np.diff(w.first)
    kind = _KIND[raw]
    sums = {k: batches.per_text((kind == k).astype(np.int64), w.offsets) for k in range(1, 8)}
    share = lambda x, of: x / np.maximum(of, 1)
    h = (batches.hashes(w) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    t, _, count = counted(w.text, h)
    distinct = np.bincount(t, minlength=n)
    same = np.zeros(len(h), np.int64)
    if len(h):
        same[1:] = h[1:] == h[:-1]
        same[w.first[:-1][w.first[:-1] < len(h)]] = 0
    # Whether a line break follows: lines are compared by their first 16 and last bytes' words.
    breaks = np.flatnonzero(raw == 10)
    lines = 1 + np.diff(np.searchsorted(breaks, w.offsets))
    after = np.searchsorted(w.start, breaks + 1)
    after = np.minimum(after, max(len(h) - 1, 0))
    lt, _, _ = counted(np.searchsorted(w.offsets, breaks, side="right") - 1, h[after] if len(h) else np.zeros(len(breaks), np.int64))
    line_kinds = np.bincount(lt, minlength=n)
    stored = np.full(n, np.nan) if n_chars is None else n_chars.astype(np.float64)
    stored = np.where(np.isnan(stored) | (stored < 0), size - sums[5] / 2, stored)
    columns = [
        np.log1p(size), np.log1p(words), share(sums[1], size), share(sums[2], size), share(sums[3], size), share(sums[4], size),
        share(sums[5], size), share(size - sums[4], words), share(distinct, words), share(batches.per_text(same, w.first), words),
        share(lines, words), share(line_kinds, lines), share(sums[6], words), share(sums[7], words), np.log1p(stored),
    ]
    return np.stack(columns, 1) if n else np.zeros((0, len(STRUCTURE)))


ROW = StructType(
    [
        StructField("bucket", ArrayType(IntegerType())),
        StructField("count", ArrayType(IntegerType())),
        StructField("structure", ArrayType(FloatType())),
    ]
)


def lists(values: np.ndarray, first: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values, kind))


def of_part(part: pa.RecordBatch, bits: int, stems: tuple[int, ...]):
    """Words, hashed features and structure of the texts of an Arrow slice."""
    raw, _ = batches.utf8(part.column("text"))
    w = batches.words(part.column("text"))
    chars = part.column("n_chars").cast(pa.float64()).to_numpy(zero_copy_only=False) if "n_chars" in part.schema.names else None
    return w, hashed(w, bits, stems), structure(raw, w, chars)


def table(documents: DataFrame, bits: int = BUCKET_BITS, stems: tuple[int, ...] = STEMS) -> DataFrame:
    """Columns ``row`` and ``result`` (``ROW``) of ``documents``."""

    def produce(parts):
        for part in parts:
            w, (text, bucket, count), about = of_part(part, bits, stems)
            first = np.searchsorted(text, np.arange(part.num_rows + 1))
            width = np.arange(part.num_rows + 1) * about.shape[1]
            yield part, [lists(bucket, first, pa.int32()), lists(count, first, pa.int32()), lists(about.astype(np.float32).ravel(), width, pa.float32())]

    return batches.with_results(documents, "text", ROW, produce)


class Sample:
    """Features of the few rows a model is fitted on, as flat arrays."""

    def __init__(self, rows: pa.Table):
        result = rows["result"].combine_chunks()
        result = result if isinstance(result, pa.StructArray) else result.chunk(0)
        bucket, count, about = (result.field(i) for i in range(3))
        self.n = len(result)
        self.size = np.diff(bucket.offsets.to_numpy())
        self.row = np.repeat(np.arange(self.n), self.size)
        self.bucket = bucket.flatten().to_numpy().astype(np.int64)
        self.count = count.flatten().to_numpy().astype(np.int64)
        self.structure = about.flatten().to_numpy().reshape(self.n, -1).astype(np.float64)


def train_fold(doc_id) -> F.Column:
    """Whether labels of this document may be learned from; the fold rule of the contract."""
    return F.pmod(F.crc32(F.encode(doc_id.cast("string"), "utf-8")), F.lit(5)) != 0


def one_each(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """One row for each of ``ids``, a table of bounded size; the text of least hash if an id has several.

    However many rows an id has, no more than the number of ids leave the tasks.
    """
    rows = documents.join(F.broadcast(ids), "doc_id", "left_semi")
    about = [c for c in ("n_chars",) if c in documents.columns]
    least = F.min(F.struct(F.xxhash64("text").alias("_hash"), *about, "text")).alias("least")
    return rows.groupBy("doc_id").agg(least).select("doc_id", "least.text", *[f"least.{c}" for c in about])


def labelled(documents: DataFrame, labels: DataFrame, name: str, value: int, most: int, seed: int) -> DataFrame:
    """At most ``most`` documents of the train fold whose label ``name`` is ``value``.

    The ids are drawn by hash, so the draw is the same on every run; ``most`` bounds them,
    which is why they may be sent to every task.
    """
    drawn = labels.where((F.col(name) == value) & train_fold(F.col("doc_id"))).select("doc_id").distinct()
    return one_each(documents, drawn.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(most))
