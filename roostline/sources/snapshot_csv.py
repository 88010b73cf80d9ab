"""Snapshot files: header-named CSV, plain or gzip, every cell read as text."""

from __future__ import annotations

from collections.abc import Iterable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roostline import config
from roostline.errors import LoadError
from roostline.session import spread

# Bytes are read one-to-one as Latin-1 and decoded per column afterwards: the CSV reader
# itself would replace malformed UTF-8 without a trace.
_BYTES = "ISO-8859-1"
FILE_POSITION = "file_pos"
BAD_ENCODING = "bad_encoding"


def _reader(spark: SparkSession):
    return (
        spark.read.option("header", True)
        .option("multiLine", True)
        .option("escape", '"')
        .option("encoding", _BYTES)
        .option("maxCharsPerColumn", config.MAX_CSV_FIELD_CHARS)
        .option("ignoreCorruptFiles", False)
        .option("ignoreMissingFiles", False)
        .option("mode", "PERMISSIVE")
    )


def missing_columns(header: Iterable[str] | None, required: Iterable[str]) -> list[str]:
    """The required columns a header lacks, sorted; an empty file lacks them all."""
    return sorted(set(required) - set(header or ()))


def read_snapshot_csv(spark: SparkSession, path: str, required: Iterable[str]) -> DataFrame:
    """All rows of ``path`` (a file, folder or glob) as text, in a known file order.

    Adds ``file_pos``, which sorts rows as the files hold them, and ``bad_encoding``,
    true where some cell is not UTF-8. Nothing is judged before the header holds every
    required column.
    """
    try:
        raw_header = _reader(spark).csv(path).columns
    except (PySparkException, Py4JJavaError) as exc:
        raise LoadError(f"{path} could not be read: {exc}") from exc
    header = [name.encode(_BYTES).decode("utf-8", "replace") for name in raw_header]
    absent = missing_columns(header, required)
    if absent:
        raise LoadError(f"{path} has no {', '.join(absent)} column")

    schema = T.StructType([T.StructField(name, T.StringType()) for name in raw_header])
    # A folder of parts has to share one header; a part that differs stops the read.
    rows = _reader(spark).schema(schema).option("enforceSchema", False).csv(path)
    position = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    cells = {name: F.col("_cells").getField(raw) for name, raw in zip(header, raw_header)}
    packed = rows.select(F.struct(*[F.col(f"`{raw}`") for raw in raw_header]).alias("_cells"), position.alias(FILE_POSITION))
    packed = spread(packed, FILE_POSITION, parts=len(rows.inputFiles()))
    # A line break cannot belong to a longer sequence, so the joined row is valid if all
    # cells are. A row of ASCII needs neither the check nor the decoding.
    joined = F.concat_ws("\n", *cells.values())
    judged = packed.withColumn("_ascii", F.octet_length(joined) == F.char_length(joined)).withColumn(
        BAD_ENCODING, F.when(F.col("_ascii"), F.lit(False)).otherwise(~F.is_valid_utf8(_decoded(joined)))
    )
    return judged.select(
        *[F.when(F.col("_ascii"), c).otherwise(_decoded(c)).alias(n) for n, c in cells.items() if n in set(required)],
        BAD_ENCODING,
        FILE_POSITION,
    )


def _decoded(cell: Column) -> Column:
    """The bytes of a cell as text, valid or not."""
    return F.encode(cell, _BYTES).cast("string")
