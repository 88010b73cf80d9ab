"""Session settings and the shared working folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def session(app: str = "roostline", master: str | None = None, **options: str) -> SparkSession:
    """A session with the settings the jobs are written for."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        # Methods beyond this size are not compiled by the JVM; Spark then splits them instead.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
    )
    if master:
        builder = builder.master(master)
    for key, value in options.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as ``spark.checkpoint.dir`` names it.

    Only a local session may fall back to a temporary folder: on a cluster that
    folder would exist on one machine and vanish with it.
    """
    sc = spark.sparkContext
    folder = sc.getCheckpointDir()
    if folder:
        return folder
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="roostline-")
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir() or folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def stable(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder, so a lost executor re-reads instead of re-deriving."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def _files(spark: SparkSession, path: str):
    """The file system of ``path``, and the path as it knows it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    files, target = _files(spark, path)
    return files.exists(target)


def subfolders(spark: SparkSession, path: str) -> list[str]:
    """The names of what lies below ``path``; none if it does not exist."""
    files, target = _files(spark, path)
    return [status.getPath().getName() for status in files.listStatus(target)] if files.exists(target) else []


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file, whole; False if its name is taken, however many try at once.

    A local file gets its name by a link, which fails on a name in use; HDFS and ABFS do not
    move a file onto another. Elsewhere (object stores) the file is created with "fail if it
    exists" and appears as it is closed; S3 needs Hadoop's conditional writes for that.
    """
    files, target = _files(spark, path)
    files.mkdirs(target.getParent())
    kind = files.getScheme()
    if kind == "file":
        name = Path(target.toUri().getPath())
        draft = name.with_name(f".{name.name}.{uuid.uuid4().hex}")
        try:
            draft.write_text(text, encoding="utf-8")
            os.link(draft, name)
        except FileExistsError:
            return False
        finally:
            draft.unlink(missing_ok=True)
        return True
    moved = kind in ("hdfs", "viewfs", "abfs", "abfss")
    made = spark._jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}.{uuid.uuid4().hex}") if moved else target
    try:
        out = files.create(made, False)
        out.write(bytearray(text.encode()))
        out.close()
        if moved and not files.rename(made, target):
            files.delete(made, False)
            return False
    except Py4JJavaError as exc:
        if exc.java_exception.getClass().getSimpleName() in ("FileAlreadyExistsException", "RemoteFileChangedException"):
            return False
        raise
    return True


def local_path(spark: SparkSession, path: str) -> str | None:
    """``path`` as a name that Python can open, if it lies on a local (or mounted) file system."""
    files, target = _files(spark, path)
    return files.makeQualified(target).toUri().getPath() if files.getScheme() == "file" else None


@contextmanager
def setting(spark: SparkSession, key: str, value) -> Iterator[None]:
    """A setting of the session for as long as the block runs."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(value))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


@contextmanager
def local_working_folder(folder: str) -> Iterator[str]:
    """A fresh folder inside a local ``folder`` that no reader sees, removed at the end however the work went."""
    path = f"{folder}/.draft-{uuid.uuid4().hex}"
    os.makedirs(path)
    try:
        yield path
    finally:
        shutil.rmtree(path)


def without_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that is no longer read."""
    files, target = _files(spark, path)
    files.delete(target, True)


@contextmanager
def working_folder(spark: SparkSession, name: str) -> Iterator[str]:
    """A fresh path below the shared folder, removed at the end however the work went."""
    path = scratch_path(spark, name)
    try:
        yield path
    finally:
        without_folder(spark, path)


def stored(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """``df`` as a columnar table in the shared folder: computed once, read column by column.

    With ``folder`` the table goes there and lives as long as it does.
    """
    path = f"{folder}/{name}" if folder else scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def spread(df: DataFrame, key: str, parts: int | None = None) -> DataFrame:
    """``df`` over enough tasks for work that weighs more than its bytes suggest.

    ``parts`` is how many tasks read it now; nothing moves if those are enough. The
    partition count is given, so that it is not merged down to the size of the data.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df if parts is not None and parts >= tasks else df.repartition(tasks, key)
