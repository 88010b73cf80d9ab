"""Bringing a new snapshot together with the stored one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roostline import config
from roostline.functions.ids import with_dense_ids

SOURCE_KEY = "source_listing_id"
# The inputs of the embedded document: when one changes, the derived columns are stale.
DOCUMENT_INPUTS = (
    "name",
    "description",
    "neighbourhood_id",
    "room_type_id",
    "property_type_id",
    "amenities",
)
DERIVED = ("doc_text", "embedding")


def first_per_key(rows: DataFrame, key: str | Sequence[str], order: Column | str) -> DataFrame:
    """The earliest row of every key.

    The rank limit is applied before the exchange too, so a key repeated millions of
    times sends one row per task.
    """
    keys = [key] if isinstance(key, str) else list(key)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return rows.withColumn("_place", place).where("_place = 1").drop("_place")


def duplicate_count(rows: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """``staged``, ``distinct_keys`` and ``duplicated`` row counts: one row."""
    keys = [key] if isinstance(key, str) else list(key)
    per_key = rows.groupBy(*keys).agg(F.count("*").alias("rows"))
    return per_key.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("staged"), F.count("*").alias("distinct_keys")
    ).withColumn("duplicated", F.col("staged") - F.col("distinct_keys"))


def changed(left: str, right: str, columns: Sequence[str]) -> Column:
    """Whether any of the columns differs between two aliases, NULLs being equal."""
    before = F.struct(*[F.col(f"{left}.{c}") for c in columns])
    after = F.struct(*[F.col(f"{right}.{c}") for c in columns])
    return ~before.eqNullSafe(after)


def merge_known(
    stored: DataFrame,
    staged: DataFrame,
    rejected_ids: DataFrame,
    key: str = SOURCE_KEY,
    document_inputs: Sequence[str] = DOCUMENT_INPUTS,
    derived: Sequence[str] = DERIVED,
) -> DataFrame:
    """Stored rows after the merge: updated, kept although refused, or gone.

    A stored row keeps its id. It takes the staged attributes if the file has it, stays
    as it is if the file has it but it was refused, and is dropped otherwise. Derived
    columns are emptied where an input of theirs changed.
    """
    attributes = [c for c in staged.columns if c != key]
    refused = rejected_ids.select(key).where(F.col(key).isNotNull()).distinct()
    joined = (
        stored.alias("o")
        .join(staged.withColumn("_staged", F.lit(True)).alias("n"), key, "left")
        .join(refused.withColumn("_refused", F.lit(True)), key, "left")
        .where("_staged or _refused")
    )
    stale = F.col("_staged") & changed("o", "n", document_inputs)
    columns = []
    for name in stored.columns:
        old = F.col(f"o.{name}")
        if name == key:
            columns.append(F.col(key))
        elif name in derived:
            columns.append(F.when(~F.coalesce(stale, F.lit(False)), old).alias(name))
        elif name in attributes:
            columns.append(F.when(F.col("_staged"), F.col(f"n.{name}")).otherwise(old).alias(name))
        else:
            columns.append(old.alias(name))
    return joined.select(*columns)


def new_rows(stored: DataFrame, staged: DataFrame, key: str = SOURCE_KEY) -> DataFrame:
    """Staged rows whose key is not stored yet."""
    return staged.join(stored.select(key), key, "left_anti")


def merge_snapshot(
    stored: DataFrame,
    staged: DataFrame,
    rejected_ids: DataFrame,
    key: str = SOURCE_KEY,
    document_inputs: Sequence[str] = DOCUMENT_INPUTS,
    derived: Sequence[str] = DERIVED,
) -> DataFrame:
    """The stored table after a load of ``staged`` (one row per key)."""
    top = stored.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).first()["top"]
    id_type = dict(stored.dtypes)["id"]
    added = with_dense_ids(new_rows(stored, staged, key), key, start=top, id_type=id_type)
    for name in stored.columns:
        if name not in added.columns:
            added = added.withColumn(name, F.lit(None).cast(stored.schema[name].dataType))
    known = merge_known(stored, staged, rejected_ids, key, document_inputs, derived)
    return known.unionByName(added.select(*stored.columns))


def departed(
    stored: DataFrame, staged: DataFrame, rejected_ids: DataFrame, key: str = SOURCE_KEY
) -> DataFrame:
    """Stored rows the file no longer holds at all; refused rows do not count as gone."""
    return stored.join(staged.select(key), key, "left_anti").join(
        rejected_ids.select(key), key, "left_anti"
    )


def newest_children(
    children: DataFrame,
    keep: int = config.MAX_REVIEWS_PER_LISTING,
    key: str = SOURCE_KEY,
    date: str = "date",
    position: str = "file_pos",
) -> DataFrame:
    """At most ``keep`` rows per key, newest first and later file position first."""
    if keep < 0:
        raise ValueError(f"keep must not be negative, got {keep}")
    newest_first = Window.partitionBy(key).orderBy(F.desc(date), F.desc(position))
    return (
        children.withColumn("recency", F.row_number().over(newest_first))
        .where(F.col("recency") <= keep)
    )


def attach_children(children: DataFrame, listings: DataFrame, key: str = SOURCE_KEY) -> DataFrame:
    """Children of stored listings, carrying the listing's own id."""
    parents = listings.select(key, F.col("id").alias("listing_id"))
    return children.join(parents, key).drop(key)


def orphan_count(children: DataFrame, listings: DataFrame, key: str = SOURCE_KEY) -> DataFrame:
    """How many child rows name a listing that is not stored.

    Children are counted per key first, so a key with very many rows joins as one row.
    """
    per_key = children.groupBy(key).agg(F.count("*").alias("rows"))
    orphans = per_key.join(listings.select(key), key, "left_anti")
    return orphans.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("orphans"))


def cascade(children: DataFrame, listings: DataFrame) -> DataFrame:
    """Children whose listing still exists."""
    return children.join(listings.select(F.col("id").alias("listing_id")), "listing_id", "left_semi")
