"""Checks of sources, contracts and typed ingest (A and B)."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from roostline.errors import LoadError
from roostline.functions import rules
from roostline.operators import audit, ingest
from roostline.session import scratch_path, spread, stored
from roostline.sources import tables
from roostline.sources.snapshot_csv import read_snapshot_csv
from roostline.sources.tables import SnapshotStore
from roostline.standins import relations as r

# --- Rules as the checking engine writes them -------------------------------------------


def _int(col: str, low: int = -(2**63), high: int = 2**63 - 1) -> tuple[str, str]:
    value = (
        f"CASE WHEN regexp_full_match(trim({col}), '[+-]?[0-9]+') "
        f"AND try_cast(trim({col}) AS BIGINT) BETWEEN {low} AND {high} THEN try_cast(trim({col}) AS BIGINT) END"
    )
    return value, f"(trim(coalesce({col}, '')) <> '' AND ({value}) IS NULL)"


def _float(col: str) -> tuple[str, str]:
    value = (
        f"CASE WHEN regexp_full_match(trim({col}), '[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([eE][+-]?[0-9]+)?') "
        f"THEN try_cast(trim({col}) AS DOUBLE) END"
    )
    return value, f"(trim(coalesce({col}, '')) <> '' AND ({value}) IS NULL)"


def _price(col: str) -> tuple[str, str]:
    value, bad = _float(f"regexp_replace({col}, '[$£€, ]', '', 'g')")
    bad = f"(trim({col}) <> '' AND (({value}) IS NULL OR ({value}) < 0))"
    return value, bad


def _bath(col: str) -> tuple[str, str]:
    text = f"regexp_replace(lower(trim({col})), ' +', ' ', 'g')"
    value = (
        f"CASE WHEN regexp_full_match({text}, '(shared |private )?half-bath') THEN 0.5 "
        f"WHEN regexp_full_match({text}, '[0-9]+(\\.[0-9]+)? (shared |private )?baths?') "
        f"THEN try_cast(split_part({text}, ' ', 1) AS DOUBLE) END"
    )
    return f"CAST({value} AS DOUBLE)", f"(trim({col}) <> '' AND ({value}) IS NULL)"


def _flag(col: str) -> tuple[str, str]:
    value = (
        f"CASE WHEN lower(trim({col})) IN ('t', 'true') THEN true "
        f"WHEN lower(trim({col})) IN ('f', 'false') THEN false END"
    )
    return value, f"(trim({col}) <> '' AND ({value}) IS NULL)"


def _date(col: str) -> tuple[str, str]:
    value = (
        f"CASE WHEN regexp_full_match(trim({col}), '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') "
        f"THEN try_cast(trim({col}) AS DATE) END"
    )
    return value, f"(({value}) IS NULL)"


def _text(col: str) -> tuple[str, str]:
    return f"nullif(trim({col}), '')", "false"


def _required(rule: tuple[str, str]) -> tuple[str, str]:
    return rule[0], f"({rule[1]} OR ({rule[0]}) IS NULL)"


# A list of strings and nothing else; every list of the stand-in that parses is one.
_LIST_OK = "(json_valid(amenities) AND starts_with(trim(amenities), '['))"
_NAMES_SQL = (
    "CASE WHEN trim(amenities) = '' THEN '' ELSE (SELECT string_agg(name, '|' ORDER BY pos) FROM ("
    "SELECT min_by(trim(regexp_replace(n, ' +', ' ', 'g')), pos) AS name, min(pos) AS pos FROM ("
    "SELECT unnest(regexp_extract_all(amenities, '\"([^\"]*)\"', 1)) AS n, "
    "generate_subscripts(regexp_extract_all(amenities, '\"([^\"]*)\"', 1), 1) AS pos) "
    "GROUP BY lower(trim(regexp_replace(n, ' +', ' ', 'g'))))) END"
)


def _ranged(rule: tuple[str, str], low) -> tuple[str, str]:
    return rule[0], f"({rule[1]} OR ({rule[0]}) < {low})"


_LAT, _LON = _required(_float("latitude")), _required(_float("longitude"))
_BATHS, _BATH_N = _bath("bathrooms_text"), _float("bathrooms")
_SMALL = (-32768, 32767)
_LISTING_RULES = [
    ("id", "source_listing_id", _required(_int("id"))),
    ("name", "name", _required(_text("name"))),
    ("neighbourhood_cleansed", "neighbourhood", _required(_text("neighbourhood_cleansed"))),
    ("room_type", "room_type", _required(_text("room_type"))),
    ("property_type", "property_type", _required(_text("property_type"))),
    ("latitude", None, _LAT),
    ("longitude", None, _LON),
    ("latitude", "latitude", (_LAT[0], f"({_LAT[0]}) NOT BETWEEN -90 AND 90")),
    ("longitude", "longitude", (_LON[0], f"({_LON[0]}) NOT BETWEEN -180 AND 180")),
    ("accommodates", "accommodates", _ranged(_required(_int("accommodates", *_SMALL)), 1)),
    ("minimum_nights", "minimum_nights", _ranged(_required(_int("minimum_nights")), 1)),
    ("number_of_reviews", "number_of_reviews", _ranged(_required(_int("number_of_reviews")), 0)),
    ("bathrooms_text", None, _BATHS),
    (
        "bathrooms",
        "bathrooms",
        (f"coalesce({_BATHS[0]}, {_BATH_N[0]})", f"(({_BATHS[0]}) IS NULL AND {_BATH_N[1]})"),
    ),
    ("description", "description", _text("description")),
    ("price", "price_gbp", _price("price")),
    ("bedrooms", "bedrooms", _int("bedrooms", *_SMALL)),
    ("beds", "beds", _int("beds", *_SMALL)),
    ("review_scores_rating", "rating", _float("review_scores_rating")),
    ("review_scores_location", "location_score", _float("review_scores_location")),
    ("review_scores_cleanliness", "cleanliness_score", _float("review_scores_cleanliness")),
    ("instant_bookable", "instant_bookable", _flag("instant_bookable")),
    ("host_is_superhost", "host_is_superhost", _flag("host_is_superhost")),
    ("amenities", "amenities", (_NAMES_SQL, f"(trim(amenities) <> '' AND NOT {_LIST_OK})")),
]
_FLOATS = ("bathrooms", "price_gbp", "rating", "location_score", "cleanliness_score")
_REASON = "CASE " + " ".join(f"WHEN {bad} THEN '{f}'" for f, _, (_, bad) in _LISTING_RULES) + " END"
JUDGED_SQL = f"SELECT *, {_REASON} AS field, {_int('id')[0]} AS readable_id FROM ({r.RAW_LISTINGS_SQL})"
_INTS = {"accommodates": "SMALLINT", "bedrooms": "SMALLINT", "beds": "SMALLINT", "minimum_nights": "INTEGER", "number_of_reviews": "INTEGER"}


def _stored_form(out: str, value: str) -> str:
    if out in _FLOATS:
        return f"round(CAST(CAST({value} AS FLOAT) AS DOUBLE), 4)"
    return f"CAST({value} AS {_INTS[out]})" if out in _INTS else value


ACCEPTED_SQL = (
    "SELECT file_pos, "
    + ", ".join(
        f"{_stored_form(out, value)} AS {out}"
        for _, out, (value, _) in _LISTING_RULES
        if out
    )
    + f" FROM ({JUDGED_SQL}) WHERE field IS NULL"
)
_REVIEW_RULES = [
    ("comments", "comments", _required(_text("comments"))),
    ("listing_id", "source_listing_id", _required(_int("listing_id"))),
    ("date", "date", _date("date")),
]
_REVIEW_REASON = "CASE " + " ".join(f"WHEN {bad} THEN '{f}'" for f, _, (_, bad) in _REVIEW_RULES) + " END"
JUDGED_REVIEWS_SQL = f"SELECT *, {_REVIEW_REASON} AS field FROM ({r.RAW_REVIEWS_SQL})"
ACCEPTED_REVIEWS_SQL = (
    "SELECT file_pos, "
    + ", ".join(f"{value} AS {out}" for _, out, (value, _) in _REVIEW_RULES)
    + f" FROM ({JUDGED_REVIEWS_SQL}) WHERE field IS NULL"
)

# --- Queries ----------------------------------------------------------------------------


def csv_scan(spark, sf):
    """documents written as gzip CSV parts and read back through the snapshot reader."""
    path = scratch_path(spark, "csv")
    source = r.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "lang", "text")
    source.write.option("header", True).option("escape", '"').option("quoteAll", True).option(
        "compression", "gzip"
    ).csv(path)
    rows = read_snapshot_csv(spark, path, ("doc_id", "lang", "text"))
    return rows.select(
        F.col("doc_id").cast("long").alias("doc_id"), "lang", F.md5("text").alias("digest"), "bad_encoding"
    )


def header_contract(spark, sf):
    """customer as a CSV file, read under contracts it keeps and one it breaks: the refusal, or the rows."""
    path = scratch_path(spark, "header")
    r.table(spark, sf, "customer").write.option("header", True).csv(path)
    told = []
    for name, required in (("kept", ["c_name", "c_custkey"]), ("broken", ["c_phone", "c_name", "c_address"])):
        try:
            rows = read_snapshot_csv(spark, path, required).agg(F.lit("").alias("said"), F.count("*").alias("rows"))
        except LoadError as refusal:
            said = str(refusal).removeprefix(f"{path} ")
            rows = spark.range(1).select(F.lit(said).alias("said"), F.lit(0).cast("long").alias("rows"))
        told.append(rows.withColumn("contract", F.lit(name)))
    return told[0].unionByName(told[1])


def other_ranges(spark, sf):
    """Which ranged fields besides the latitude refuse a row."""
    checks = {
        "longitude": rules.within(rules.required(rules.finite_number(F.col("longitude"))), -180.0, 180.0),
        "accommodates": rules.within(rules.required(rules.whole_number(F.col("accommodates"), _SMALL)), 1),
        "minimum_nights": rules.within(rules.required(rules.whole_number(F.col("minimum_nights"))), 1),
        "number_of_reviews": rules.within(rules.required(rules.whole_number(F.col("number_of_reviews"))), 0),
    }
    read = r.raw_listings(spark, sf).select("file_pos", *[rule.value.alias(name) for name, rule in checks.items()])
    bad = [F.coalesce(rule.bad(F.col(name)), F.lit(False)).alias(f"{name}_bad") for name, rule in checks.items()]
    return read.select("file_pos", *bad)


def contract(spark, sf):
    rules_ = {
        k: v
        for k, v in audit.listing_rules(tables.LISTINGS).items()
        if k not in ("doc_text_present", "embedding_present", "amenities_are_names")
    }
    rules_["price_is_known"] = F.col("price_gbp").isNull()
    return audit.contract_violations(r.listings(spark, sf, vectors=False), rules_)


_PRESENT = [f.name for f in tables.LISTINGS.fields if not f.nullable]
_CONTRACT_SQL = " UNION ALL ".join(
    f"SELECT '{name}' AS rule, CAST(count(*) FILTER (WHERE {bad}) AS BIGINT) AS rows FROM l"
    for name, bad in [
        ("latitude_in_range", "latitude NOT BETWEEN -90 AND 90"),
        ("longitude_in_range", "longitude NOT BETWEEN -180 AND 180"),
        ("price_not_negative", "price_gbp < 0"),
        ("accommodates_positive", "accommodates <= 0"),
        ("minimum_nights_at_least_one", "minimum_nights < 1"),
        ("review_count_not_negative", "number_of_reviews < 0"),
        *[(f"{c}_present", f"{c} IS NULL") for c in _PRESENT],
        ("price_is_known", "price_gbp IS NULL"),
    ]
)


def repeated_keys(spark, sf):
    lines = r.table(spark, sf, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("line")
    )
    return audit.repeated_keys(lines, "line")


def personal_values(spark, sf):
    return audit.personal_values(r.table(spark, sf, "documents"), ["text", "source"], ["@", "the ", "http", "+49"])


_PERSONAL_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{p}' AS probe, count(*) AS rows FROM documents WHERE contains({c}, '{p}') HAVING count(*) > 0"
    for c in ("text", "source")
    for p in ("@", "the ", "http", "+49")
)


def table_scan(spark, sf):
    return tables.scan(spark, f"{sf}/lineitem.parquet", ["l_orderkey", "l_linenumber", "l_quantity"])


def published_version(spark, sf):
    """orders published twice as reviews of a store, then once more unchanged; a reader sees the second ones."""
    store = SnapshotStore(spark, scratch_path(spark, "store"))
    orders = r.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("int").alias("listing_id"),
        F.col("o_orderdate").cast("date").alias("date"), F.col("o_orderstatus").alias("comments"),
    )
    said = dict(snapshot_date=date(2026, 1, 2), city="Testville", listings=7)
    for part in (orders.where("comments = 'F'"), orders):
        folder = store.begin()
        store.write(folder, "reviews", part)
        store.publish(folder, **said, reviews=part.count(), base=store.newest())
    # A version that writes nothing names the tables of the one before.
    store.publish(store.begin(), **said, reviews=store.newest()["review_count"], base=store.newest())
    unfinished = store.begin()
    store.write(unfinished, "reviews", orders.limit(0))
    return store


def publish(spark, sf):
    return published_version(spark, sf).table("reviews", ["id", "listing_id", "comments"])


def provenance(spark, sf):
    return published_version(spark, sf).provenance().select(
        F.col("snapshot_date").cast("string").alias("snapshot_date"), "city", "listing_count", "review_count"
    )


def trace_sink(spark, sf):
    path = scratch_path(spark, "trace")
    steps = r.steps(spark, sf).select("run_id", "step_index", "kind", "name", "args", "output")
    tables.write_trace(steps, path)
    return tables.read_trace(spark, path, "step_index long, kind string, name string, args string, output string, run_id long")


_TRACE = ("run_id", "step_index", "kind", "name", "args", "output")


def _packed(spark, sf):
    """All steps as two batches, the first written twice: repeating a batch replaces it."""
    packed = tables.PackedTraces(spark, scratch_path(spark, "packed"), most_rows=5_000)
    steps = r.steps(spark, sf).select(*_TRACE)
    for batch in ("tool_call", "tool_call", "other"):
        packed.write(steps.where(F.col("kind").eqNullSafe("tool_call") == (batch == "tool_call")), batch)
    return packed


def packed_steps(spark, sf):
    return _packed(spark, sf).steps().select(*_TRACE)


def packed_index(spark, sf):
    """Per batch and run: its steps and the first of them, as the index has them."""
    return _packed(spark, sf).index().groupBy("batch", "run_id").agg(
        F.sum("steps").alias("steps"), F.min("first_step").alias("first_step")
    )


def packed_replay(spark, sf):
    packed = _packed(spark, sf)
    busiest = packed.index().groupBy("run_id").agg(F.sum("steps").alias("n")).orderBy(F.desc("n"), "run_id").first()["run_id"]
    return packed.replay(busiest).select(*_TRACE)


def _judged(spark, sf):
    return stored(ingest.parse_listings(spread(r.raw_listings(spark, sf), "file_pos")), "judged")


def _names(col="amenity_names"):
    return F.array_join(F.transform(col, lambda a: a["name"]), "|")


def accepted(spark, sf):
    rows = ingest.accepted(_judged(spark, sf))
    rounded = {c: F.round(F.col(c).cast("double"), 4) for c in _FLOATS}
    return rows.withColumns(rounded | {"amenities": _names()}).drop("amenity_names").select(
        "file_pos", *[out for _, out, _ in _LISTING_RULES if out]
    )


def rejected(spark, sf):
    return ingest.rejected(_judged(spark, sf)).groupBy("field", "source_listing_id").agg(
        F.count("*").alias("rows")
    )


def privacy(spark, sf):
    """Which columns of a file with host identity survive parsing, and for how many rows."""
    kept = ingest.accepted(_judged(spark, sf))
    shown = ",".join(sorted(c for c in kept.columns if c != "file_pos"))
    return kept.agg(F.lit(shown).alias("kept_columns"), F.count("*").alias("rows"))


def rule(source, column, make, cast=None):
    def run(spark, sf):
        df = getattr(r, source)(spark, sf)
        parsed = make(F.col(column))
        read = df.withColumn("_value", parsed.value)
        bad = F.coalesce(parsed.bad(F.col("_value")), F.lit(False))
        value = F.col("_value").cast(cast) if cast else F.col("_value")
        return read.select("file_pos", value.alias("value"), bad.alias("bad"))

    return run


def rule_sql(source, pair):
    return f"SELECT file_pos, {pair[0]} AS value, coalesce({pair[1]}, false) AS bad FROM ({source})"


def summary(spark, sf):
    return ingest.rejection_summary(_judged(spark, sf))


def counts(spark, sf):
    return ingest.row_counts(_judged(spark, sf))


def accepted_reviews(spark, sf):
    return ingest.accepted(ingest.parse_reviews(r.raw_reviews(spark, sf)))


def amenity_rule(spark, sf):
    parsed = rules.name_list(r.raw_listings(spark, sf), "amenities", "names")
    return parsed.select("file_pos", _names("names").alias("value"), F.col("names").isNull().alias("bad"))


_L = f"WITH l AS ({r.LISTINGS_SQL}) "
_RAW = r.RAW_LISTINGS_SQL
_ORDERS_SQL = "SELECT o_orderkey AS id, CAST(o_custkey AS INT) AS listing_id, o_orderstatus AS comments FROM orders"
QUERIES = {
    "A1_csv_scan": (csv_scan, "SELECT doc_id, lang, md5(text) AS digest, false AS bad_encoding FROM documents"),
    "A2_header_contract": (
        header_contract,
        "SELECT 'kept' AS contract, '' AS said, count(*) AS rows FROM customer "
        "UNION ALL SELECT 'broken', 'has no c_address, c_phone column', 0",
    ),
    "A3_contract_violations": (contract, _L + _CONTRACT_SQL),
    "A3_repeated_keys": (
        repeated_keys,
        "SELECT concat(l_orderkey, '-', l_linenumber) AS line, count(*) AS rows FROM lineitem "
        "GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1",
    ),
    "A4_privacy_reduction": (
        privacy,
        "SELECT '"
        + ",".join(sorted([o for _, o, _ in _LISTING_RULES if o and o != "amenities"] + ["amenity_names"]))
        + f"' AS kept_columns, count(*) AS rows FROM ({JUDGED_SQL}) WHERE field IS NULL",
    ),
    "A5_personal_values": (personal_values, _PERSONAL_SQL),
    "A6_table_scan": (table_scan, "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem"),
    "A7_published_version": (publish, _ORDERS_SQL),
    "A8_provenance": (
        provenance,
        "SELECT '2026-01-02' AS snapshot_date, 'Testville' AS city, CAST(7 AS BIGINT) AS listing_count, "
        "count(*) AS review_count FROM orders",
    ),
    "A10_trace_sink": (
        trace_sink,
        f"SELECT step_index, kind, name, args, output, run_id FROM ({r.STEPS_SQL})",
    ),
    "A10_packed_steps": (packed_steps, f"SELECT {', '.join(_TRACE)} FROM ({r.STEPS_SQL})"),
    "A10_packed_index": (
        packed_index,
        "SELECT CASE kind WHEN 'tool_call' THEN 'tool_call' ELSE 'other' END AS batch, run_id, count(*) AS steps, "
        f"min(step_index) AS first_step FROM ({r.STEPS_SQL}) GROUP BY 1, 2",
    ),
    "A10_packed_replay": (
        packed_replay,
        f"WITH s AS ({r.STEPS_SQL}) SELECT {', '.join(_TRACE)} FROM s "
        "WHERE run_id = (SELECT run_id FROM s GROUP BY 1 ORDER BY count(*) DESC, run_id LIMIT 1)",
    ),
    "B0_accepted_listings": (accepted, ACCEPTED_SQL),
    "B0_rejected_listings": (
        rejected,
        f"SELECT field, readable_id AS source_listing_id, count(*) AS rows FROM ({JUDGED_SQL}) "
        "WHERE field IS NOT NULL GROUP BY 1, 2",
    ),
    "B1_price": (rule("raw_listings", "price", rules.price), rule_sql(_RAW, _price("price"))),
    "B2_bathrooms": (
        rule("raw_listings", "bathrooms_text", rules.bath_count),
        rule_sql(_RAW, _bath("bathrooms_text")),
    ),
    "B3_boolean": (rule("raw_listings", "instant_bookable", rules.flag), rule_sql(_RAW, _flag("instant_bookable"))),
    "B4_bounded_integer": (
        rule("raw_listings", "accommodates", lambda c: rules.whole_number(c, _SMALL)),
        rule_sql(_RAW, _int("accommodates", *_SMALL)),
    ),
    "B5_finite_float": (
        rule("raw_listings", "review_scores_rating", rules.finite_number),
        rule_sql(_RAW, _float("review_scores_rating")),
    ),
    "B6_iso_date": (
        rule("raw_reviews", "date", rules.iso_date, "string"),
        rule_sql(r.RAW_REVIEWS_SQL, (f"CAST({_date('date')[0]} AS VARCHAR)", _date("date")[1])),
    ),
    "B7_text": (rule("raw_listings", "name", rules.words), rule_sql(_RAW, _text("name"))),
    "B8_amenity_list": (
        amenity_rule,
        f"SELECT file_pos, CASE WHEN trim(amenities) = '' OR {_LIST_OK} THEN {_NAMES_SQL} END AS value, "
        f"(trim(amenities) <> '' AND NOT {_LIST_OK}) AS bad FROM ({_RAW})",
    ),
    "B9_domain_ranges": (
        rule("raw_listings", "latitude", lambda c: rules.within(rules.required(rules.finite_number(c)), -90.0, 90.0)),
        rule_sql(_RAW, (_LAT[0], f"({_LAT[1]} OR ({_LAT[0]}) NOT BETWEEN -90 AND 90)")),
    ),
    "B9_other_ranges": (
        other_ranges,
        f"SELECT file_pos, coalesce({_LON[1]} OR ({_LON[0]}) NOT BETWEEN -180 AND 180, false) AS longitude_bad, "
        + ", ".join(
            f"coalesce({_ranged(_required(_int(c, *fits)), low)[1]}, false) AS {c}_bad"
            for c, low, fits in (("accommodates", 1, _SMALL), ("minimum_nights", 1, ()), ("number_of_reviews", 0, ()))
        )
        + f" FROM ({_RAW})",
    ),
    "B10_review_rows": (accepted_reviews, ACCEPTED_REVIEWS_SQL),
    "B11_rejection_summary": (
        summary,
        f"SELECT field, count(*) AS rows FROM ({JUDGED_SQL}) WHERE field IS NOT NULL GROUP BY 1 "
        "ORDER BY rows DESC, field LIMIT 5",
    ),
    "B12_row_counts": (
        counts,
        f"SELECT count(*) AS seen, count(field) AS rejected, count(*) - count(field) AS accepted FROM ({JUDGED_SQL})",
    ),
}
