"""Lookup dimensions: distinct names, stable ids, rare values, canonical spellings."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roostline import config
from roostline.errors import GroundingError
from roostline.functions.ids import with_dense_ids


def names_of(rows: DataFrame, column: str | Column) -> DataFrame:
    """The distinct values of one column, as ``name``."""
    col = F.col(column) if isinstance(column, str) else column
    return rows.select(col.alias("name")).where(F.col("name").isNotNull()).distinct()


def dimension_names(listings: DataFrame) -> DataFrame:
    """``(field, name)`` of all four dimensions in one pass over accepted rows."""
    def entry(field: str, name: Column) -> Column:
        return F.struct(F.lit(field).alias("field"), name.alias("name"))

    single = F.array(
        entry("neighbourhoods", F.col("neighbourhood")),
        entry("room_types", F.col("room_type")),
        entry("property_types", F.col("property_type")),
    )
    pairs = F.concat(single, F.transform("amenities", lambda a: entry("amenities", a)))
    return listings.select(F.inline(pairs)).distinct()


def extend_dimension(existing: DataFrame, names: DataFrame, id_type: str = "int") -> DataFrame:
    """``existing`` unchanged plus a new id for every name it does not hold yet.

    Ids and flags of known names never move and names are never removed.
    """
    top = existing.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).first()["top"]
    fresh = names.select("name").distinct().join(existing.select("name"), "name", "left_anti")
    numbered = with_dense_ids(fresh, "name", start=top, id_type=id_type)
    if "is_indexed" in existing.columns:
        numbered = numbered.withColumn("is_indexed", F.lit(False))
    return existing.unionByName(numbered.select(*existing.columns))


def type_counts(listings: DataFrame, column: str = "property_type") -> DataFrame:
    """Rows per value, repeated source ids included."""
    return listings.groupBy(F.col(column).alias("name")).agg(F.count("*").alias("listings"))


def type_mapping(
    counts: DataFrame, min_listings: int = config.MIN_PROPERTY_TYPE_LISTINGS
) -> DataFrame:
    """``(name, collapsed)``: a value keeps its name if it is common enough."""
    kept = F.when(F.col("listings") >= min_listings, F.col("name"))
    return counts.select(
        "name", F.coalesce(kept, F.lit(config.OTHER_PROPERTY_TYPE)).alias("collapsed"), "listings"
    )


def collapse_rare(
    listings: DataFrame,
    column: str = "property_type",
    min_listings: int = config.MIN_PROPERTY_TYPE_LISTINGS,
) -> DataFrame:
    """``listings`` with rare values of ``column`` replaced by the catch-all."""
    mapping = type_mapping(type_counts(listings, column), min_listings)
    renamed = mapping.select(F.col("name").alias(column), "collapsed")
    return (
        listings.join(renamed, column, "left")
        .withColumn(column, F.col("collapsed"))
        .drop("collapsed")
    )


def spelling_counts(names: DataFrame) -> DataFrame:
    """``(key, spelling, uses)`` from rows of ``(key, spelling)``."""
    return names.groupBy("key", "spelling").agg(F.count("*").alias("uses"))


def canonical_spellings(counts: DataFrame) -> DataFrame:
    """``(key, canonical)``: the most used spelling, the smaller one on a tie."""
    best = F.min_by("spelling", F.struct(-F.col("uses"), F.col("spelling")))
    return counts.groupBy("key").agg(best.alias("canonical"))


def respellings(counts: DataFrame) -> DataFrame:
    """``(spelling, canonical)`` only for spellings that lose to another one."""
    joined = counts.join(canonical_spellings(counts), "key")
    return joined.where(F.col("spelling") != F.col("canonical")).select("spelling", "canonical")


# Spellings that are dealt with inside the rows. Any other is at most one in so many entries,
# so none of them is a hot key.
HOT_SPELLINGS = 32


def hot_spellings(uses: DataFrame, losers: DataFrame, most: int = HOT_SPELLINGS) -> dict[str, str]:
    """The ``most`` used spellings of ``uses`` (spelling, uses), each with what replaces it."""
    summed = uses.groupBy("spelling").agg(F.sum("uses").alias("uses"))
    top = summed.orderBy(F.desc("uses"), "spelling").limit(most).join(losers, "spelling", "left")
    # ``most`` rows come to the driver.
    return {r["spelling"]: r["canonical"] or r["spelling"] for r in top.collect()}


def cold_entries(rows: DataFrame, key: str, hot: Mapping[str, str], column: str = "amenities") -> DataFrame:
    """``(key, spelling)`` of the list entries that no hot spelling covers."""
    return rows.select(key, F.explode(F.filter(column, lambda a: ~a.isin(*hot)) if hot else column).alias("spelling"))


def rewrite_spellings(
    rows: DataFrame, key: str, losers: DataFrame, column: str = "amenities", uses: DataFrame | None = None
) -> DataFrame:
    """Each list with losing spellings replaced, order kept.

    The hottest spellings are found first, from ``uses`` where they are counted already,
    and replaced inside their rows. Of the rest only rows that hold a losing spelling
    travel: their replacements come back as one small list per row and the lists
    themselves never leave their rows. Entries are looked up in hash tables, a batch of
    rows at a time, so that a long list costs no more per entry than a short one.
    """
    if uses is None:
        uses = rows.select(F.explode(column).alias("spelling")).groupBy("spelling").agg(F.count("*").alias("uses"))
    hot = hot_spellings(uses, losers)
    changes = (
        cold_entries(rows, key, hot, column)
        .join(losers, "spelling")
        .groupBy(key)
        .agg(F.collect_set(F.struct("spelling", "canonical")).alias("_swap"))
    )
    known = {spelling: canonical for spelling, canonical in hot.items() if spelling != canonical}
    touched = F.lit(True) if known else F.col("_swap").isNotNull()
    return (
        rows.join(changes, key, "left")
        .withColumn(column, F.coalesce(_swapped_by(known)(F.when(touched, F.col(column)), "_swap"), F.col(column)))
        .drop("_swap")
    )


def _swapped_by(known: Mapping[str, str]) -> Callable[[Column, str], Column]:
    """Lists with each entry replaced as ``known`` or the row's ``(spelling, canonical)`` pairs say."""

    def looked_up(entries: pa.Array, table: Mapping[str, str]) -> pa.Array:
        places = pc.index_in(entries, value_set=pa.array(table.keys(), entries.type))
        return pa.array(table.values(), entries.type).take(places)

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def swapped(lists: pa.Array, swaps: pa.Array) -> pa.Array:
        entries = lists.flatten()
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        # A spelling has one canonical form, so the pairs of a batch are one table. It is for the
        # rows that were given pairs.
        spelling, canonical = swaps.flatten().flatten()
        pairs = dict(zip(spelling.to_pylist(), canonical.to_pylist()))
        given = pa.array(np.repeat(swaps.is_valid().to_numpy(zero_copy_only=False), sizes))
        own = pc.if_else(given, looked_up(entries, pairs), pa.scalar(None, entries.type))
        out = pc.coalesce(looked_up(entries, known), own, entries)
        offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
        return pa.ListArray.from_arrays(offsets, out, mask=lists.is_null())

    return swapped


def encode_dimension(rows: DataFrame, dimension: DataFrame, column: str, id_column: str) -> DataFrame:
    """Replace a text dimension by the id the lookup table gives it."""
    lookup = dimension.select(F.col("name").alias(column), F.col("id").alias(id_column))
    return rows.join(lookup, column).drop(column)


def amenity_ranking(listings: DataFrame) -> DataFrame:
    """Listings per amenity."""
    return (
        listings.select(F.explode("amenities").alias("name"))
        .groupBy("name")
        .agg(F.count("*").alias("listings"))
    )


def select_indexed(
    listings: DataFrame, budget: int = config.INDEXED_AMENITY_BUDGET
) -> DataFrame:
    """Specified behaviour: the amenities that get a boolean column, by listing count."""
    return amenity_ranking(listings).orderBy(F.desc("listings"), "name").limit(budget)


def indexed_column(amenity: str) -> str:
    """The column name of an indexed amenity."""
    letters = "".join(ch if ch.isalnum() else "_" for ch in amenity.lower())
    return f"has_{letters.strip('_')}"


def one_hot(listings: DataFrame, amenities: Sequence[str]) -> DataFrame:
    """Specified behaviour: one boolean column per selected amenity."""
    if len(amenities) > config.INDEXED_AMENITY_BUDGET:
        raise ValueError(f"at most {config.INDEXED_AMENITY_BUDGET} amenities get a column")
    columns = {indexed_column(a): F.array_contains("amenities", a) for a in amenities}
    if len(columns) < len(set(amenities)):
        raise ValueError("two amenities would share a column name")
    return listings.withColumns(columns)


def vocabulary(
    neighbourhoods: DataFrame,
    room_types: DataFrame,
    property_types: DataFrame,
    amenities: DataFrame,
) -> DataFrame:
    """``(field, name, id)`` of every name a request may use.

    The catch-all property type and amenities without a column are left out.
    """
    parts = (
        ("neighbourhoods", neighbourhoods),
        ("room_types", room_types),
        ("property_types", property_types.where(F.col("name") != config.OTHER_PROPERTY_TYPE)),
        ("amenities", amenities.where("is_indexed")),
    )
    named = [
        table.select(F.lit(field).alias("field"), "name", F.col("id").cast("int").alias("id"))
        for field, table in parts
    ]
    out = named[0]
    for part in named[1:]:
        out = out.unionByName(part)
    return out.orderBy("field", "name")


def require_vocabulary(snapshot: DataFrame, neighbourhoods: DataFrame) -> None:
    """Refuse to resolve names against nothing."""
    if snapshot.isEmpty():
        raise GroundingError("no snapshot was published to look names up in")
    if neighbourhoods.isEmpty():
        raise GroundingError("the published version has no neighbourhoods")


