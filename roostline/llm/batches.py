"""Arrow batches of texts as flat numpy arrays: words, word hashes and counts for many texts at once.

A word is a maximal run of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z became a-z.
Every such class covers whole UTF-8 sequences, so words can be found on bytes. A null
text is an empty one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

# Bytes of text that are handled at once; about forty bytes of memory each.
PIECE_BYTES = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, dtype=bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True


class Words(NamedTuple):
    """Words of several texts, in order: ``first[i]:first[i + 1]`` are those of text ``i``."""

    low: np.ndarray  # lower-cased bytes of all texts
    offsets: np.ndarray  # where each text starts, and the end
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def text(self) -> np.ndarray:
        """The text each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of ``texts`` and the offsets of each; null as empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def edges(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of true values that does not cross an offset."""
    n = len(inside)
    starts, ends = inside.copy(), inside.copy()
    if n:
        starts[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        cut = offsets[:-1][offsets[:-1] < n]
        starts[cut] = inside[cut]
        cut = cut[cut > 0] - 1
        ends[cut] = inside[cut]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def words(texts: pa.Array) -> Words:
    raw, offsets = utf8(texts)
    low = _LOWER[raw]
    start, end = edges(_WORD[low], offsets)
    return Words(low, offsets, start, end, np.searchsorted(start, offsets))


@cache
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    out = []
    for base in (BASE, inverse):
        p = np.full(1 << bits, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashes(w: Words) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial over its bytes, then mixed."""
    n = len(w.low)
    power, inverse = _powers(max(10, int(n).bit_length()))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((w.low.astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
    return mix((sums[w.end] - sums[w.start]) * inverse[w.start] + (w.end - w.start).astype(np.uint64))


def hash_of(word: str) -> int:
    """The hash of one lower-cased word."""
    return int(hashes(words(pa.array([word], pa.string())))[0])


def per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between neighbouring positions of ``first``."""
    sums = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return sums[first[1:]] - sums[first[:-1]]


def pieces(batch: pa.RecordBatch, size: np.ndarray, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` of at most ``most`` bytes of text each, but one row at least."""
    total, begin = np.cumsum(size), 0
    while begin < len(size):
        before = total[begin - 1] if begin else 0
        stop = max(begin + 1, int(np.searchsorted(total, before + most, side="right")))
        yield batch.slice(begin, stop - begin)
        begin = stop


def with_results(
    df: DataFrame,
    text: str,
    fields: StructType,
    produce: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[pa.RecordBatch, list]]],
    most: int = PIECE_BYTES,
) -> DataFrame:
    """Columns ``row`` (all of ``df``) and ``result`` (``fields``) of a narrow Arrow pass.

    ``produce`` gets slices of bounded text size and yields each with the lists or arrays
    of its result columns. Both are structs, so no column name can clash.
    """
    names = [f.name for f in fields]
    types = [to_arrow_type(f.dataType) for f in fields]

    def run(batches):
        def sliced():
            for batch in batches:
                rows = batch.column(0)
                inner = pa.RecordBatch.from_arrays(rows.flatten(), names=[rows.type.field(i).name for i in range(rows.type.num_fields)])
                _, at = utf8(inner.column(inner.schema.get_field_index(text)))
                yield from pieces(inner, np.diff(at), most)

        for part, columns in produce(sliced()):
            made = [c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            made = [c if c.type == t else c.cast(t) for c, t in zip(made, types, strict=True)]
            row = pa.StructArray.from_arrays(part.columns, fields=list(part.schema))
            result = pa.StructArray.from_arrays(made, fields=[pa.field(n, t) for n, t in zip(names, types, strict=True)])
            yield pa.RecordBatch.from_arrays([row, result], names=["row", "result"])

    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    schema = StructType([StructField("row", packed.schema["row"].dataType), StructField("result", fields)])
    return packed.mapInArrow(run, schema)


def unpacked(df: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns of ``row`` next to all results."""
    return df.select(*[f"row.{c}" for c in keep], "result.*")
