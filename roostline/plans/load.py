"""One load: snapshot files in, a complete new version of every table out."""

from __future__ import annotations

import time
from dataclasses import dataclass
from datetime import date

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from roostline import config
from roostline.errors import LoadError
from roostline.functions.ids import with_dense_ids
from roostline.operators import ingest, reconcile, vocabulary
from roostline.session import stored, working_folder
from roostline.sources import tables
from roostline.sources.snapshot_csv import BAD_ENCODING, FILE_POSITION, read_snapshot_csv
from roostline.sources.tables import SnapshotStore


@dataclass(frozen=True)
class LoadReport:
    """What one load did."""

    snapshot_date: date
    city: str
    listings_seen: int
    listings_loaded: int
    listings_rejected: int
    listings_duplicated: int
    listings_removed: int
    listing_rejections: tuple[tuple[str, int], ...]
    reviews_seen: int
    reviews_rejected: int
    reviews_without_listing: int
    reviews_kept: int
    neighbourhoods: int
    room_types: int
    property_types: int
    property_types_collapsed: int
    amenities: int
    elapsed_s: float

    def as_row(self, spark: SparkSession) -> DataFrame:
        """The report as a one-row table."""
        values = {
            name: F.array(*[F.struct(F.lit(f).alias("field"), F.lit(n).alias("rows")) for f, n in value])
            if name == "listing_rejections"
            else F.lit(value)
            for name, value in self.__dict__.items()
        }
        return spark.range(1).select(*[col.alias(name) for name, col in values.items()])


def _stage(raw: DataFrame, parse, name: str, path: str, work: str) -> DataFrame:
    """Typed rows of one file set, written once and read by everything that follows."""
    seen = Observation(name)
    rows = raw.observe(
        seen, F.count("*").alias("rows"), F.count_if(F.col(BAD_ENCODING)).alias("broken")
    )
    try:
        typed = stored(parse(rows), name, work)
    except (PySparkException, Py4JJavaError) as exc:
        raise LoadError(f"{path} could not be read: {exc}") from exc
    if seen.get["broken"]:
        raise LoadError(f"{path} holds {seen.get['broken']} rows that are not UTF-8")
    return typed


def _describe(reasons: tuple[tuple[str, int], ...]) -> str:
    return ", ".join(f"{field}: {count}" for field, count in reasons) or "no reasons"


def load_snapshot(
    spark: SparkSession,
    store: SnapshotStore,
    *,
    listings_csv: str,
    reviews_csv: str,
    snapshot_date: str | None,
    city: str,
    max_reviews_per_listing: int = config.MAX_REVIEWS_PER_LISTING,
    min_property_type_listings: int = config.MIN_PROPERTY_TYPE_LISTINGS,
) -> LoadReport:
    """Load both files as a new version; what was published before stays until the end.

    Intermediate tables go when the load ends, however it ends.
    """
    release = tables.required_snapshot_date(snapshot_date)
    with working_folder(spark, "load") as work:
        return _load(
            spark, store, work, listings_csv, reviews_csv, release, city,
            max_reviews_per_listing, min_property_type_listings,
        )


def _load(
    spark: SparkSession,
    store: SnapshotStore,
    work: str,
    listings_csv: str,
    reviews_csv: str,
    release: date,
    city: str,
    max_reviews_per_listing: int,
    min_property_type_listings: int,
) -> LoadReport:
    started = time.monotonic()
    raw_listings = read_snapshot_csv(spark, listings_csv, config.LISTING_SOURCE_COLUMNS)
    raw_reviews = read_snapshot_csv(spark, reviews_csv, config.REVIEW_SOURCE_COLUMNS)

    parsed = _stage(raw_listings, ingest.parse_listings, "listings", listings_csv, work)
    counts = ingest.row_counts(parsed).first()
    reasons = tuple((r["field"], r["rows"]) for r in ingest.rejection_summary(parsed).collect())
    if not counts["accepted"]:
        raise LoadError(
            f"{counts['seen']} listing rows read and none could be stored ({_describe(reasons)})"
        )
    reviews = _stage(raw_reviews, ingest.parse_reviews, "reviews", reviews_csv, work)
    review_counts = ingest.row_counts(reviews).first()

    folder = store.begin()
    before = store.newest()
    accepted = ingest.accepted(parsed)
    refused = ingest.rejected(parsed).select("source_listing_id")

    # Lookup tables, written first so that their sizes are known to the joins below.
    type_counts = stored(vocabulary.type_counts(accepted), "types", work)
    mapping = vocabulary.type_mapping(type_counts, min_property_type_listings)
    names = accepted.select(F.explode("amenity_names").alias("a")).select(
        F.col("a.key").alias("key"), F.col("a.name").alias("spelling")
    )
    spellings = stored(vocabulary.spelling_counts(names), "spellings", work)
    sources = {
        "neighbourhoods": vocabulary.names_of(accepted, "neighbourhood"),
        "room_types": vocabulary.names_of(accepted, "room_type"),
        "property_types": vocabulary.names_of(mapping, "collapsed"),
        "amenities": vocabulary.names_of(vocabulary.canonical_spellings(spellings), "canonical"),
    }
    dims: dict[str, DataFrame] = {}
    sizes: dict[str, int] = {}
    for table, found in sources.items():
        schema = tables.SCHEMAS[table]
        extended = vocabulary.extend_dimension(
            store.table(table, at=before), found, schema["id"].dataType.simpleString()
        )
        store.write(folder, table, tables.conform(extended, schema))
        dims[table] = spark.read.parquet(f"{folder}/{table}")
        sizes[table] = found.count()

    # One row per source id, in stored form.
    deduplicated = reconcile.first_per_key(accepted, "source_listing_id", FILE_POSITION)
    listed = deduplicated.withColumn("amenities", F.transform("amenity_names", lambda a: a["name"])).drop(
        "amenity_names", FILE_POSITION
    )
    respelled = vocabulary.rewrite_spellings(
        listed, "source_listing_id", vocabulary.respellings(spellings), uses=spellings
    )
    collapsed = mapping.select(F.col("name").alias("property_type"), "collapsed")
    staged = respelled.join(collapsed, "property_type").withColumn("property_type", F.col("collapsed"))
    staged = staged.drop("collapsed")
    for table, column in (
        ("neighbourhoods", "neighbourhood"),
        ("room_types", "room_type"),
        ("property_types", "property_type"),
    ):
        staged = vocabulary.encode_dimension(staged, dims[table], column, f"{column}_id")
    staged = stored(staged, "staged", work)

    previous = store.table("listings", tables.LISTINGS.names, at=before)
    merged = reconcile.merge_snapshot(previous, staged, refused)
    store.write(folder, "listings", tables.conform(merged, tables.LISTINGS))
    listings = spark.read.parquet(f"{folder}/listings")
    removed = reconcile.departed(previous, staged, refused).count()
    loaded = staged.count()

    children = ingest.accepted(reviews)
    orphans = reconcile.orphan_count(children, listings).first()["orphans"]
    newest = reconcile.newest_children(children, max_reviews_per_listing)
    kept = reconcile.attach_children(newest, listings)
    place = F.struct("listing_id", F.col("recency"))
    numbered = with_dense_ids(kept.withColumn("_place", place), "_place", id_type="bigint")
    store.write(folder, "reviews", tables.conform(numbered, tables.REVIEWS))
    kept_rows = spark.read.parquet(f"{folder}/reviews").count()

    store.publish(folder, snapshot_date=release, city=city, listings=loaded, reviews=kept_rows, base=before)
    rare = type_counts.agg(
        F.count_if(F.col("listings") < min_property_type_listings).alias("rare")
    ).first()["rare"]
    return LoadReport(
        snapshot_date=release,
        city=city,
        listings_seen=counts["seen"],
        listings_loaded=loaded,
        listings_rejected=counts["rejected"],
        listings_duplicated=counts["accepted"] - loaded,
        listings_removed=removed,
        listing_rejections=reasons,
        reviews_seen=review_counts["seen"],
        reviews_rejected=review_counts["rejected"],
        reviews_without_listing=orphans,
        reviews_kept=kept_rows,
        neighbourhoods=sizes["neighbourhoods"],
        room_types=sizes["room_types"],
        property_types=sizes["property_types"],
        property_types_collapsed=rare,
        amenities=sizes["amenities"],
        elapsed_s=time.monotonic() - started,
    )
