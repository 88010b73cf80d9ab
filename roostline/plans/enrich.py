"""What a loaded version still lacks: document vectors and amenity columns. Specified behaviour.

Each plan publishes a new version made from the current one; it writes only the tables it
changes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from roostline import config
from roostline.errors import LoadError
from roostline.operators import documents, vocabulary
from roostline.session import stored, working_folder
from roostline.sources import tables
from roostline.sources.tables import SnapshotStore

_DIMENSIONS = (
    ("neighbourhoods", "neighbourhood"),
    ("room_types", "room_type"),
    ("property_types", "property_type"),
)


def _current(store: SnapshotStore) -> Row:
    newest = store.newest()
    if newest is None:
        raise LoadError("nothing was published yet")
    return newest


def _publish(store: SnapshotStore, base: Row, changed: dict[str, DataFrame]) -> None:
    folder = store.begin()
    for name, df in changed.items():
        store.write(folder, name, df)
    store.publish(
        folder,
        snapshot_date=base["snapshot_date"],
        city=base["city"],
        listings=base["listing_count"],
        reviews=base["review_count"],
        base=base,
    )


def embed(
    spark: SparkSession,
    store: SnapshotStore,
    load: Callable[[], documents.Embedder],
    width: int = config.EMBEDDING_WIDTH,
) -> Row:
    """Give every listing without a vector its document and vector; the coverage afterwards.

    Listings that have a vector keep it and their text, so an interrupted or repeated run
    does only what is missing. Vectors are made once, written, and joined back by id.
    """
    base = _current(store)
    listings = store.table("listings", at=base)
    todo = listings.where(F.col("embedding").isNull())
    named = todo.drop("doc_text")
    for table, column in _DIMENSIONS:
        lookup = store.table(table, at=base).select(F.col("id").alias(f"{column}_id"), F.col("name").alias(f"_{column}"))
        named = named.join(lookup, f"{column}_id").withColumnRenamed(f"_{column}", column)
    reviews = store.table("reviews", at=base).join(
        todo.select(F.col("id").alias("listing_id")), "listing_id", "left_semi"
    )
    with working_folder(spark, "embed") as work:
        texts = documents.documents(named, documents.excerpts(reviews))
        texts = stored(texts.withColumn("embedding", F.lit(None).cast("array<float>")), "texts", work)
        vectors = documents.fill_embeddings(texts, load, width)
        made = texts.drop("embedding").join(vectors, "id")
        made = stored(made.select("id", F.col("doc_text").alias("_text"), F.col("embedding").alias("_vector")), "vectors", work)
        filled = listings.join(made, "id", "left").withColumns(
            {"doc_text": F.coalesce("_text", "doc_text"), "embedding": F.coalesce("embedding", "_vector")}
        )
        _publish(store, base, {"listings": filled.select(*listings.columns)})
    return documents.embedding_coverage(store.table("listings"), width).first()


def index_amenities(
    spark: SparkSession, store: SnapshotStore, budget: int = config.INDEXED_AMENITY_BUDGET
) -> list[str]:
    """Flag the most frequent amenities and give the listings a boolean column for each.

    A load keeps the flags and drops the columns; run this after it. Returns the names,
    ``budget`` at most.
    """
    base = _current(store)
    listings = store.table("listings", tables.LISTINGS.names, at=base)
    chosen = [r["name"] for r in vocabulary.select_indexed(listings, budget).collect()]
    flagged = store.table("amenities", at=base).withColumn("is_indexed", F.col("name").isin(chosen))
    _publish(
        store,
        base,
        {"listings": vocabulary.one_hot(listings, chosen), "amenities": tables.conform(flagged, tables.AMENITIES)},
    )
    return sorted(chosen)
