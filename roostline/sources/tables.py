"""Stored tables: schemas, scans, and versions that appear all at once."""

from __future__ import annotations

import itertools
import json
import os
import re
import shutil
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from datetime import UTC, date, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roostline.errors import LoadError
from roostline.session import create_once, exists, local_path, local_working_folder, setting, subfolders, without_folder

LISTINGS = T.StructType(
    [
        T.StructField("id", T.IntegerType(), False),
        T.StructField("source_listing_id", T.LongType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("description", T.StringType()),
        T.StructField("neighbourhood_id", T.IntegerType(), False),
        T.StructField("room_type_id", T.ShortType(), False),
        T.StructField("property_type_id", T.ShortType(), False),
        T.StructField("latitude", T.DoubleType(), False),
        T.StructField("longitude", T.DoubleType(), False),
        T.StructField("price_gbp", T.FloatType()),
        T.StructField("accommodates", T.ShortType(), False),
        T.StructField("bedrooms", T.ShortType()),
        T.StructField("beds", T.ShortType()),
        T.StructField("bathrooms", T.FloatType()),
        T.StructField("minimum_nights", T.IntegerType(), False),
        T.StructField("rating", T.FloatType()),
        T.StructField("location_score", T.FloatType()),
        T.StructField("cleanliness_score", T.FloatType()),
        T.StructField("number_of_reviews", T.IntegerType(), False),
        T.StructField("instant_bookable", T.BooleanType()),
        T.StructField("host_is_superhost", T.BooleanType()),
        T.StructField("amenities", T.ArrayType(T.StringType()), False),
        T.StructField("doc_text", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
    ]
)
REVIEWS = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("listing_id", T.IntegerType(), False),
        T.StructField("date", T.DateType(), False),
        T.StructField("comments", T.StringType(), False),
    ]
)
NEIGHBOURHOODS = T.StructType(
    [T.StructField("id", T.IntegerType(), False), T.StructField("name", T.StringType(), False)]
)
ROOM_TYPES = T.StructType(
    [T.StructField("id", T.ShortType(), False), T.StructField("name", T.StringType(), False)]
)
PROPERTY_TYPES = ROOM_TYPES
AMENITIES = T.StructType(
    [
        T.StructField("id", T.IntegerType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("is_indexed", T.BooleanType(), False),
    ]
)
DATA_SNAPSHOT = T.StructType(
    [
        T.StructField("snapshot_date", T.DateType(), False),
        T.StructField("city", T.StringType(), False),
        T.StructField("listing_count", T.LongType(), False),
        T.StructField("review_count", T.LongType(), False),
        T.StructField("loaded_at", T.TimestampType(), False),
    ]
)
SCHEMAS: Mapping[str, T.StructType] = {
    "neighbourhoods": NEIGHBOURHOODS,
    "room_types": ROOM_TYPES,
    "property_types": PROPERTY_TYPES,
    "amenities": AMENITIES,
    "listings": LISTINGS,
    "reviews": REVIEWS,
    "data_snapshot": DATA_SNAPSHOT,
}


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the columns of ``schema``, in its order and types."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def scan(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A stored table, restricted to the named columns at the scan."""
    table = spark.read.parquet(path)
    return table.select(*columns) if columns else table


def required_snapshot_date(raw: str | None) -> date:
    """The release date a load has to state, because ids mean nothing without it."""
    if not raw:
        raise LoadError("the snapshot date is not set")
    try:
        return date.fromisoformat(raw)
    except ValueError as exc:
        raise LoadError(f"the snapshot date {raw!r} is not an ISO date") from exc


class SnapshotStore:
    """Versions of the snapshot tables below one folder.

    A version is a small file that names a folder for each table. Tables are written first,
    each to a folder of its own; the file is created last, whole, and only if no other
    writer has taken its number. A job that dies earlier, or comes second, changes nothing
    for readers. Tables that a version does not write are those of the version it was made
    from, named and not copied, so folders have to stay while a version names them.
    """

    _VERSION = (
        "version long, folder string, tables map<string,string>, snapshot_date date, city string, "
        "listing_count long, review_count long, loaded_at timestamp"
    )

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root.rstrip("/")

    def _path(self, version: int) -> str:
        return f"{self.root}/published/{version:012d}.json"

    def _rows(self, version: int) -> DataFrame:
        return self.spark.read.schema(self._VERSION).json(self._path(version))

    def newest(self) -> Row | None:
        """The current version; None before any load."""
        names = [n.removesuffix(".json") for n in subfolders(self.spark, f"{self.root}/published")]
        versions = [int(n) for n in names if n.isdigit()]
        return self._rows(max(versions)).first() if versions else None

    def begin(self) -> str:
        """The folder of a new, still invisible version."""
        return f"{self.root}/versions/{uuid.uuid4().hex}"

    def write(self, folder: str, table: str, df: DataFrame) -> None:
        df.write.mode("errorifexists").parquet(f"{folder}/{table}")

    def publish(
        self,
        folder: str,
        *,
        snapshot_date: date,
        city: str,
        listings: int,
        reviews: int,
        base: Row | None,
    ) -> None:
        """Make a finished version the current one.

        ``base`` is the version it was made from (None: none). The new version takes the
        number after it; if another one has that number, this one stays invisible and the
        job fails, because its ids and rows are those of an older state.
        """
        version = base["version"] + 1 if base else 1
        written = {t: f"{folder}/{t}" for t in subfolders(self.spark, folder)}
        says = {
            "version": version,
            "folder": folder,
            "tables": (base["tables"] if base else {}) | written,
            "snapshot_date": snapshot_date.isoformat(),
            "city": city,
            "listing_count": listings,
            "review_count": reviews,
            "loaded_at": datetime.now(UTC).isoformat(),
        }
        if not create_once(self.spark, self._path(version), json.dumps(says)):
            raise LoadError("another version was published since this one was begun")

    def table(
        self, name: str, columns: Sequence[str] | None = None, at: Row | None = None
    ) -> DataFrame:
        """A table of the current version; empty with the right schema before any load.

        ``at`` is a row of :meth:`newest`: tables read at the same row belong together,
        whatever is published in between.
        """
        newest = at or self.newest()
        if newest is None:
            empty = self.spark.createDataFrame([], SCHEMAS[name])
            return empty.select(*columns) if columns else empty
        if name == "data_snapshot":
            return conform(self._rows(newest["version"]), DATA_SNAPSHOT)
        return scan(self.spark, newest["tables"][name], columns)

    def provenance(self) -> DataFrame:
        """Which release the current tables came from: one row."""
        return self.table("data_snapshot")


def write_trace(steps: DataFrame, path: str) -> None:
    """Run steps as JSON lines, one folder per run, made anew if the job is repeated.

    A folder holds one file, or one per million steps of a longer run, so that no task
    writes a run of any length alone. On a local file system the tasks write the files
    themselves: Hadoop starts four processes there for each file it creates.
    """
    folder = local_path(steps.sparkSession, path)
    spread = F.floor(F.col("step_index") / 1_000_000)
    apart = steps.repartition("run_id", spread)
    if folder is None:
        apart.write.partitionBy("run_id").mode("overwrite").option("partitionOverwriteMode", "dynamic").json(path)
        return
    rest = [c for c in steps.columns if c != "run_id"]
    lines = apart.select(F.col("run_id").cast("string").alias("run"), F.to_json(F.struct(*rest)).alias("line"))
    with local_working_folder(folder) as drafts:
        # One row a task: the folder of the attempt that succeeded.
        done = lines.sortWithinPartitions("run").mapInArrow(_run_files(drafts), "folder string").collect()
        _publish_runs([r["folder"] for r in done], folder)


def _run_folder(run: str | None) -> str:
    """The folder name that Spark gives a run."""
    if not run:
        return "run_id=__HIVE_DEFAULT_PARTITION__"
    return "run_id=" + re.sub(r"""[\x01-\x1f\x7f"#%'*/:=?\\{\[\]^]""", lambda c: f"%{ord(c[0]):02X}", run)


def _run_files(drafts: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function of an Arrow pass over (run, line), sorted by run: a file for each run, in a folder of the attempt."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = uuid.uuid4().hex
        out, last = None, None
        try:
            for batch in batches:
                runs, lines = (c.to_pylist() for c in batch.columns)
                at = 0
                for run, rows in itertools.groupby(runs):
                    stop = at + len(list(rows))
                    into = f"{drafts}/{name}/{_run_folder(run)}"
                    if into != last:
                        if out:
                            out.close()
                        os.makedirs(into, exist_ok=True)
                        # A run without a name and one whose name is empty share a folder.
                        out, last = open(f"{into}/part-{name}.json", "a", encoding="utf-8", newline=""), into
                    out.write("\n".join(lines[at:stop]) + "\n")
                    at = stop
        finally:
            if out:
                out.close()
        if out:
            yield pa.RecordBatch.from_pydict({"folder": [f"{drafts}/{name}"]})

    return write


def _publish_runs(drafts: Sequence[str], folder: str) -> None:
    """Give the runs of all ``drafts`` their place below ``folder``, instead of what was there."""
    placed = set()
    for draft in drafts:
        for run in os.listdir(draft):
            into = f"{folder}/{run}"
            if run not in placed:
                placed.add(run)
                try:
                    os.rename(f"{draft}/{run}", into)  # fails on a folder with files
                    continue
                except OSError:
                    shutil.rmtree(into)
                    os.rename(f"{draft}/{run}", into)
            else:
                for file in os.listdir(f"{draft}/{run}"):
                    os.rename(f"{draft}/{run}/{file}", f"{into}/{file}")


def read_trace(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The steps of all runs that ``write_trace`` wrote.

    The folders are listed by a few tasks for each core: by default it would be 10,000 tasks.
    """
    with setting(spark, "spark.sql.sources.parallelPartitionDiscovery.parallelism", 8 * spark.sparkContext.defaultParallelism):
        return spark.read.schema(schema).json(path)


class PackedTraces:
    """Steps of many runs in files of bounded size, with an index from run to file.

    The steps of a batch are sorted by run and step before they are cut into files, so a run
    is a stretch of rows in one file, or in a few if it is long; the index says which and
    from which row on. A batch is seen once its index is written; writing it again replaces
    it. A million runs make as many files as their bytes need.
    """

    MOST_ROWS = 1_000_000

    def __init__(self, spark: SparkSession, root: str, most_rows: int = MOST_ROWS) -> None:
        self.spark = spark
        self.root = root.rstrip("/")
        self.most_rows = most_rows

    def write(self, steps: DataFrame, batch: str) -> None:
        """Add the steps of one batch (``run_id``, ``step_index`` and any other columns)."""
        into = f"{self.root}/index/batch={batch}"
        before = self._folders(into) if exists(self.spark, into) else []
        folder = f"{self.root}/steps/{uuid.uuid4().hex}"
        ordered = steps.repartitionByRange("run_id", "step_index").sortWithinPartitions("run_id", "step_index")
        ordered.write.option("maxRecordsPerFile", self.most_rows).parquet(folder)
        stretches = (
            self.spark.read.parquet(folder)
            .groupBy("run_id", F.col("_metadata.file_name").alias("file"))
            .agg(F.min("_metadata.row_index").alias("first_row"), F.min("step_index").alias("first_step"), F.count("*").alias("steps"))
            .withColumn("folder", F.lit(folder))
        )
        # Sorted, so that a look-up reads one row group of each batch.
        stretches.repartitionByRange("run_id").sortWithinPartitions("run_id").write.mode("overwrite").parquet(into)
        for old in before:
            without_folder(self.spark, old)

    def _folders(self, index: str) -> list[str]:
        # One folder a batch.
        return [r["folder"] for r in self.spark.read.parquet(index).select("folder").distinct().collect()]

    def index(self) -> DataFrame:
        """(run_id, file, first_row, first_step, steps, folder, batch): one row per run and file."""
        return self.spark.read.parquet(f"{self.root}/index")

    def steps(self) -> DataFrame:
        """The steps of all batches."""
        return self.spark.read.parquet(*self._folders(f"{self.root}/index"))

    def replay(self, run_id) -> DataFrame:
        """The steps of one run in order, from the files that hold it; empty for an unknown run."""
        held = self.index().where(F.col("run_id") == run_id).select("folder", "file").distinct().collect()
        files = [f"{r['folder']}/{r['file']}" for r in held]
        steps = self.spark.read.parquet(*files) if files else self.steps().limit(0)
        return steps.where(F.col("run_id") == run_id).orderBy("step_index")
