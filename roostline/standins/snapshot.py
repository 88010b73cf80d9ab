"""Checks of vocabulary and reconciliation (C and D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from roostline.errors import LoadError
from roostline.operators import reconcile, vocabulary
from roostline.plans.load import load_snapshot
from roostline.session import scratch_path, stable
from roostline.sources.tables import SnapshotStore
from roostline.standins import relations as r
from roostline.standins.ingest import ACCEPTED_REVIEWS_SQL, ACCEPTED_SQL, JUDGED_REVIEWS_SQL, JUDGED_SQL

_L = f"WITH l AS ({r.LISTINGS_SQL}) "


def _words(spark, sf, name):
    return r.table(spark, sf, name).select(F.explode(F.split("text", " ")).alias("name")).where("name <> ''")


def dimension_names(spark, sf):
    return vocabulary.dimension_names(r.listings(spark, sf, vectors=False))


def stable_ids(spark, sf):
    old = _words(spark, sf, "benchmark").distinct()
    empty = spark.createDataFrame([], "id int, name string")
    existing = vocabulary.extend_dimension(empty, old)
    return vocabulary.extend_dimension(existing, _words(spark, sf, "documents"))


def rare_types(spark, sf):
    customers = r.table(spark, sf, "customer").select(
        "c_custkey", F.concat(F.lit("Nation "), "c_nationkey").alias("property_type")
    )
    return vocabulary.collapse_rare(customers)


def _spellings(spark, sf):
    words = _words(spark, sf, "documents")
    return vocabulary.spelling_counts(words.select(F.lower("name").alias("key"), F.col("name").alias("spelling")))


def canonical(spark, sf):
    return vocabulary.canonical_spellings(_spellings(spark, sf))


def rewrite(spark, sf):
    docs = r.table(spark, sf, "documents").select(
        "doc_id", F.filter(F.split("text", " "), lambda w: w != "").alias("amenities")
    )
    spellings = stable(_spellings(spark, sf))
    out = vocabulary.rewrite_spellings(docs, "doc_id", vocabulary.respellings(spellings), uses=spellings)
    return out.select("doc_id", F.md5(F.array_join("amenities", " ")).alias("digest"))


_CANON_SQL = (
    "SELECT key, spelling AS canonical FROM (SELECT key, spelling, row_number() OVER (PARTITION BY key "
    "ORDER BY uses DESC, spelling) AS place FROM (SELECT lower(name) AS key, name AS spelling, count(*) AS uses "
    "FROM (SELECT unnest(string_split(text, ' ')) AS name FROM documents) WHERE name <> '' GROUP BY 1, 2)) WHERE place = 1"
)


def encoded(spark, sf):
    rows = r.listings(spark, sf, vectors=False).select("id", "neighbourhood", "room_type", "property_type")
    empty = spark.createDataFrame([], "id int, name string")
    for column in ("neighbourhood", "room_type", "property_type"):
        dim = vocabulary.extend_dimension(empty, vocabulary.names_of(rows, column))
        rows = vocabulary.encode_dimension(rows, dim, column, f"{column}_id")
    return rows


def indexed(spark, sf):
    return vocabulary.select_indexed(r.listings(spark, sf, vectors=False))


def one_hot(spark, sf):
    wide = vocabulary.one_hot(r.listings(spark, sf, vectors=False), ["ring", "red", "widget"])
    return wide.select("id", "has_ring", "has_red", "has_widget")


def names(spark, sf):
    rows = r.listings(spark, sf, vectors=False)
    empty = spark.createDataFrame([], "id int, name string")
    neighbourhoods = vocabulary.extend_dimension(empty, vocabulary.names_of(rows, "neighbourhood"))
    rooms = vocabulary.extend_dimension(empty, vocabulary.names_of(rows, "room_type"))
    types = vocabulary.type_mapping(vocabulary.type_counts(rows), 40)
    kinds = vocabulary.extend_dimension(empty, vocabulary.names_of(types, "collapsed"))
    flags = spark.createDataFrame([], "id int, name string, is_indexed boolean")
    every = vocabulary.extend_dimension(flags, vocabulary.names_of(vocabulary.amenity_ranking(rows), "name"))
    chosen = vocabulary.select_indexed(rows, 5).select("name", F.lit(True).alias("_chosen"))
    amenities = every.join(chosen, "name", "left").withColumn("is_indexed", F.coalesce("_chosen", "is_indexed"))
    return vocabulary.vocabulary(neighbourhoods, rooms, kinds, amenities)


_LINE = ("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


def first_wins(spark, sf):
    lines = r.table(spark, sf, "lineitem")
    once = reconcile.first_per_key(lines, ["l_orderkey", "l_linenumber"], F.struct(*_LINE))
    return once.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


def duplicates(spark, sf):
    return reconcile.duplicate_count(r.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


def _customer_states(spark, sf):
    """An old and a new state of the customers, and the keys refused in between."""
    customers = r.table(spark, sf, "customer")
    stored = customers.where("c_custkey % 5 <> 0").select(
        F.col("c_custkey").cast("int").alias("id"), F.col("c_custkey").alias("source_listing_id"),
        F.col("c_name").alias("name"), F.col("c_mktsegment").alias("description"),
        F.col("c_acctbal").alias("price_gbp"), F.col("c_name").alias("doc_text"),
    )
    staged = customers.where("c_custkey % 7 <> 0").select(
        F.col("c_custkey").alias("source_listing_id"),
        F.when(F.col("c_custkey") % 3 == 0, F.concat("c_name", F.lit(" new"))).otherwise(F.col("c_name")).alias("name"),
        F.col("c_mktsegment").alias("description"), (F.col("c_acctbal") + 1).alias("price_gbp"),
    )
    refused = customers.where("c_custkey % 35 = 7").select(F.col("c_custkey").alias("source_listing_id"))
    return stored, staged, refused


def merged(spark, sf):
    stored, staged, refused = _customer_states(spark, sf)
    return reconcile.merge_snapshot(stored, staged, refused, document_inputs=("name", "description"), derived=("doc_text",))


_NEW_NAME = "CASE WHEN c_custkey % 3 = 0 THEN concat(c_name, ' new') ELSE c_name END"
_MERGED_SQL = f"""
SELECT CAST(c_custkey AS INT) AS id, c_custkey AS source_listing_id, {_NEW_NAME} AS name, c_mktsegment AS description,
  c_acctbal + 1 AS price_gbp, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_name END AS doc_text
FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 7 <> 0
UNION ALL SELECT CAST(c_custkey AS INT), c_custkey, c_name, c_mktsegment, c_acctbal, c_name
FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 35 = 7
UNION ALL SELECT CAST((SELECT max(c_custkey) FROM customer WHERE c_custkey % 5 <> 0) + row_number() OVER (ORDER BY c_custkey) AS INT),
  c_custkey, {_NEW_NAME}, c_mktsegment, c_acctbal + 1, NULL
FROM customer WHERE c_custkey % 5 = 0 AND c_custkey % 7 <> 0
"""


def gone(spark, sf):
    return reconcile.departed(*_customer_states(spark, sf)).select("id", "name")


def newest(spark, sf):
    return reconcile.newest_children(r.reviews(spark, sf)).select("source_listing_id", "file_pos", "recency")


def attached(spark, sf):
    kept = reconcile.newest_children(r.reviews(spark, sf), 3)
    return reconcile.attach_children(kept, r.listings(spark, sf, vectors=False)).select("listing_id", "file_pos")


def orphans(spark, sf):
    # Listings are parts, reviews name customers: some have no listing.
    reviews = r.table(spark, sf, "orders").select((F.col("o_custkey") * 2).alias("source_listing_id"))
    return reconcile.orphan_count(reviews, r.listings(spark, sf, vectors=False))


def cascaded(spark, sf):
    reviews = r.table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") * 2).cast("int").alias("listing_id"))
    return reconcile.cascade(reviews, r.listings(spark, sf, vectors=False)).select("o_orderkey", "listing_id")


# Rows of one gzip part: a part is written and read by one task.
_PART_ROWS = 200_000


def _write_csv(df, path):
    # Gzip parts in file order, as a snapshot arrives: one, or several of a bounded size.
    parts = max(1, -(-df.count() // _PART_ROWS))
    ordered = df.repartitionByRange(parts, "file_pos").sortWithinPartitions("file_pos").drop("file_pos")
    ordered.write.option("header", True).option("escape", '"').option("compression", "gzip").option(
        "ignoreLeadingWhiteSpace", False
    ).option("ignoreTrailingWhiteSpace", False).csv(path)
    return path


def load_report(spark, sf):
    """orders and events written as snapshot files, loaded end to end, and the report of it."""
    root = scratch_path(spark, "load")
    listings = _write_csv(r.raw_listings(spark, sf), f"{root}/listings")
    reviews = _write_csv(r.raw_reviews(spark, sf), f"{root}/reviews")
    report = load_snapshot(
        spark, SnapshotStore(spark, f"{root}/store"), listings_csv=listings, reviews_csv=reviews,
        snapshot_date="2026-01-02", city="Testville",
    )
    return report.as_row(spark).drop("snapshot_date", "elapsed_s", "listing_rejections").select(
        *[F.col(c).cast("long").alias(c) for c in (
            "listings_seen", "listings_loaded", "listings_rejected", "listings_duplicated", "listings_removed",
            "reviews_seen", "reviews_rejected", "reviews_without_listing", "reviews_kept", "neighbourhoods",
            "room_types", "property_types", "property_types_collapsed", "amenities",
        )]
    )


def refused_load(spark, sf):
    """Orders as a snapshot file in which no price can be read: what the load says, and what it published."""
    root = scratch_path(spark, "refused")
    listings = _write_csv(r.raw_listings(spark, sf).withColumn("price", F.lit("free")), f"{root}/listings")
    reviews = _write_csv(r.raw_reviews(spark, sf), f"{root}/reviews")
    store = SnapshotStore(spark, f"{root}/store")
    said = "no error"
    try:
        load_snapshot(
            spark, store, listings_csv=listings, reviews_csv=reviews, snapshot_date="2026-01-02", city="Testville"
        )
    except LoadError as refusal:
        said = str(refusal).split(" (")[0]
    return store.table("listings").agg(F.lit(said).alias("said"), F.count("*").alias("listings"))


_REPORT_SQL = f"""
WITH a AS ({ACCEPTED_SQL}), j AS (SELECT field FROM ({JUDGED_SQL})), rj AS (SELECT field FROM ({JUDGED_REVIEWS_SQL})),
 ra AS ({ACCEPTED_REVIEWS_SQL}), t AS (SELECT property_type, count(*) AS n FROM a GROUP BY 1),
 am AS (SELECT DISTINCT lower(x) AS k FROM (SELECT unnest(string_split(amenities, '|')) AS x FROM a WHERE amenities <> '')),
 per AS (SELECT source_listing_id, count(*) AS n FROM ra GROUP BY 1)
SELECT (SELECT count(*) FROM j) AS listings_seen, (SELECT count(DISTINCT source_listing_id) FROM a) AS listings_loaded,
 (SELECT count(field) FROM j) AS listings_rejected,
 (SELECT count(*) - count(DISTINCT source_listing_id) FROM a) AS listings_duplicated, CAST(0 AS BIGINT) AS listings_removed,
 (SELECT count(*) FROM rj) AS reviews_seen, (SELECT count(field) FROM rj) AS reviews_rejected,
 (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM per WHERE source_listing_id NOT IN (SELECT source_listing_id FROM a)) AS reviews_without_listing,
 (SELECT CAST(coalesce(sum(least(n, 5)), 0) AS BIGINT) FROM per WHERE source_listing_id IN (SELECT source_listing_id FROM a)) AS reviews_kept,
 (SELECT count(DISTINCT neighbourhood) FROM a) AS neighbourhoods, (SELECT count(DISTINCT room_type) FROM a) AS room_types,
 (SELECT count(DISTINCT CASE WHEN n >= 50 THEN property_type ELSE 'Other' END) FROM t) AS property_types,
 (SELECT count(*) FROM t WHERE n < 50) AS property_types_collapsed, (SELECT count(*) FROM am) AS amenities
"""

_DOC_WORDS = "SELECT unnest(string_split(text, ' ')) AS name FROM {t}"
_TYPES = "SELECT CASE WHEN count(*) >= 40 THEN property_type ELSE 'Other' END AS name FROM l GROUP BY property_type"
_AM = "SELECT name, count(*) AS n FROM (SELECT unnest(amenities) AS name FROM l) GROUP BY 1"
QUERIES = {
    "A9_refused_load": (
        refused_load,
        "SELECT concat(count(*), ' listing rows read and none could be stored') AS said, CAST(0 AS BIGINT) AS listings FROM orders",
    ),
    "C1_dimension_names": (
        dimension_names,
        _L + "SELECT DISTINCT 'neighbourhoods' AS field, neighbourhood AS name FROM l UNION SELECT 'room_types', room_type FROM l "
        "UNION SELECT 'property_types', property_type FROM l UNION SELECT 'amenities', unnest(amenities) FROM l",
    ),
    "C2_stable_ids": (
        stable_ids,
        f"WITH o AS (SELECT DISTINCT name FROM ({_DOC_WORDS.format(t='benchmark')}) WHERE name <> ''), "
        f"d AS (SELECT DISTINCT name FROM ({_DOC_WORDS.format(t='documents')}) WHERE name <> '' AND name NOT IN (SELECT name FROM o)) "
        "SELECT CAST(row_number() OVER (ORDER BY name) AS INT) AS id, name FROM o UNION ALL "
        "SELECT CAST((SELECT count(*) FROM o) + row_number() OVER (ORDER BY name) AS INT), name FROM d",
    ),
    "C3_rare_collapse": (
        rare_types,
        "SELECT c_custkey, CASE WHEN count(*) OVER (PARTITION BY c_nationkey) >= 50 THEN concat('Nation ', c_nationkey) "
        "ELSE 'Other' END AS property_type FROM customer",
    ),
    "C4_canonical_spelling": (canonical, _CANON_SQL),
    "C5_canonical_rewrite": (
        rewrite,
        f"WITH c AS ({_CANON_SQL}), w AS (SELECT doc_id, unnest(list_filter(string_split(text, ' '), lambda x: x <> '')) AS name, "
        "generate_subscripts(list_filter(string_split(text, ' '), lambda x: x <> ''), 1) AS pos FROM documents) "
        "SELECT d.doc_id, md5(coalesce(t, '')) AS digest FROM documents d LEFT JOIN (SELECT doc_id, string_agg(canonical, ' ' ORDER BY pos) AS t "
        "FROM w JOIN c ON lower(name) = key GROUP BY doc_id) x ON d.doc_id = x.doc_id",
    ),
    "C6_foreign_keys": (
        encoded,
        _L + "SELECT id, CAST(dense_rank() OVER (ORDER BY neighbourhood) AS INT) AS neighbourhood_id, "
        "CAST(dense_rank() OVER (ORDER BY room_type) AS INT) AS room_type_id, "
        "CAST(dense_rank() OVER (ORDER BY property_type) AS INT) AS property_type_id FROM l",
    ),
    "C7_indexed_amenities": (
        indexed,
        _L + f"SELECT name, n AS listings FROM ({_AM}) ORDER BY n DESC, name LIMIT 15",
    ),
    "C8_one_hot": (
        one_hot,
        _L + "SELECT id, list_contains(amenities, 'ring') AS has_ring, list_contains(amenities, 'red') AS has_red, "
        "list_contains(amenities, 'widget') AS has_widget FROM l",
    ),
    "C9_vocabulary": (
        names,
        _L + "SELECT 'neighbourhoods' AS field, name, CAST(row_number() OVER (ORDER BY name) AS INT) AS id FROM (SELECT DISTINCT neighbourhood AS name FROM l) "
        "UNION ALL SELECT 'room_types', name, CAST(row_number() OVER (ORDER BY name) AS INT) FROM (SELECT DISTINCT room_type AS name FROM l) "
        f"UNION ALL SELECT * FROM (SELECT 'property_types', name, CAST(row_number() OVER (ORDER BY name) AS INT) FROM (SELECT DISTINCT name FROM ({_TYPES}))) x WHERE name <> 'Other' "
        f"UNION ALL SELECT * FROM (SELECT 'amenities', name, CAST(row_number() OVER (ORDER BY name) AS INT) FROM ({_AM})) y "
        f"WHERE name IN (SELECT name FROM ({_AM}) ORDER BY n DESC, name LIMIT 5)",
    ),
    "D1_first_wins": (
        first_wins,
        "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber "
        f"ORDER BY {', '.join(_LINE)}) AS place FROM lineitem) WHERE place = 1",
    ),
    "D1_duplicate_count": (
        duplicates,
        "SELECT CAST(sum(n) AS BIGINT) AS staged, count(*) AS distinct_keys, CAST(sum(n) - count(*) AS BIGINT) AS duplicated "
        "FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)",
    ),
    "D2_D3_snapshot_merge": (merged, _MERGED_SQL),
    "D4_departed": (
        gone,
        "SELECT CAST(c_custkey AS INT) AS id, c_name AS name FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 7 = 0 AND c_custkey % 35 <> 7",
    ),
    "D5_newest_children": (
        newest,
        "SELECT * FROM (SELECT source_listing_id, file_pos, CAST(row_number() OVER (PARTITION BY source_listing_id ORDER BY date DESC, file_pos DESC) AS INT) AS recency "
        f"FROM ({r.REVIEWS_SQL})) WHERE recency <= 5",
    ),
    "D6_child_join": (
        attached,
        _L + "SELECT l.id AS listing_id, file_pos FROM (SELECT *, row_number() OVER (PARTITION BY source_listing_id ORDER BY date DESC, file_pos DESC) AS place "
        f"FROM ({r.REVIEWS_SQL})) v JOIN l ON l.source_listing_id = v.source_listing_id WHERE place <= 3",
    ),
    "D7_orphan_count": (
        orphans,
        "SELECT count(*) AS orphans FROM orders WHERE o_custkey * 2 NOT IN (SELECT p_partkey FROM part)",
    ),
    "D8_cascade": (
        cascaded,
        "SELECT o_orderkey, CAST(o_custkey * 2 AS INT) AS listing_id FROM orders WHERE o_custkey * 2 IN (SELECT p_partkey + 1 FROM part)",
    ),
    "D9_load_report": (load_report, _REPORT_SQL),
}
