"""Typed ingest: text rows to accepted and rejected rows in one pass."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roostline import config
from roostline.functions import rules
from roostline.functions.rules import Parsed
from roostline.functions.text import distinct_names
from roostline.sources.snapshot_csv import FILE_POSITION

REJECTED_FIELD = "rejected_field"
READABLE_ID = "readable_id"

_Rule = tuple[str, str | None, Parsed]  # a value of None is read by a step of its own


def _listing_rules() -> Sequence[_Rule]:
    """``(reported column, output name, rule)`` in the order that decides the report."""
    c = F.col
    wide = config.FLOAT4_MAX
    latitude = rules.required(rules.finite_number(c("latitude")))
    longitude = rules.required(rules.finite_number(c("longitude")))
    worded = rules.bath_count(c("bathrooms_text"))
    counted = rules.finite_number(c("bathrooms"), wide)
    either = Parsed(
        F.coalesce(F.col("_bathrooms_text"), counted.value),
        lambda v: F.col("_bathrooms_text").isNull() & counted.bad(v),
    )
    return (
        ("id", "source_listing_id", rules.required(rules.whole_number(c("id")))),
        ("name", "name", rules.required(rules.words(c("name")))),
        (
            "neighbourhood_cleansed",
            "neighbourhood",
            rules.required(rules.words(c("neighbourhood_cleansed"))),
        ),
        ("room_type", "room_type", rules.required(rules.words(c("room_type")))),
        ("property_type", "property_type", rules.required(rules.words(c("property_type")))),
        ("latitude", "latitude", latitude),
        ("longitude", "longitude", longitude),
        ("latitude", None, rules.within(latitude, -90.0, 90.0)),
        ("longitude", None, rules.within(longitude, -180.0, 180.0)),
        (
            "accommodates",
            "accommodates",
            rules.within(
                rules.required(rules.whole_number(c("accommodates"), config.INT2_RANGE)), 1
            ),
        ),
        (
            "minimum_nights",
            "minimum_nights",
            rules.within(
                rules.required(rules.whole_number(c("minimum_nights"), config.INT4_RANGE)), 1
            ),
        ),
        (
            "number_of_reviews",
            "number_of_reviews",
            rules.within(
                rules.required(rules.whole_number(c("number_of_reviews"), config.INT4_RANGE)), 0
            ),
        ),
        ("bathrooms_text", "_bathrooms_text", worded),
        ("bathrooms", "bathrooms", either),
        ("description", "description", rules.words(c("description"))),
        ("price", "price_gbp", rules.price(c("price"))),
        ("bedrooms", "bedrooms", rules.whole_number(c("bedrooms"), config.INT2_RANGE)),
        ("beds", "beds", rules.whole_number(c("beds"), config.INT2_RANGE)),
        ("review_scores_rating", "rating", rules.finite_number(c("review_scores_rating"), wide)),
        (
            "review_scores_location",
            "location_score",
            rules.finite_number(c("review_scores_location"), wide),
        ),
        (
            "review_scores_cleanliness",
            "cleanliness_score",
            rules.finite_number(c("review_scores_cleanliness"), wide),
        ),
        ("instant_bookable", "instant_bookable", rules.flag(c("instant_bookable"))),
        ("host_is_superhost", "host_is_superhost", rules.flag(c("host_is_superhost"))),
        ("amenities", "amenity_names", Parsed(None, lambda v: v.isNull())),
    )


def _review_rules() -> Sequence[_Rule]:
    c = F.col
    return (
        ("comments", "comments", rules.required(rules.words(c("comments")))),
        ("listing_id", "source_listing_id", rules.required(rules.whole_number(c("listing_id")))),
        ("date", "date", rules.iso_date(c("date"))),
    )


LISTING_TYPES = {
    "accommodates": "smallint",
    "minimum_nights": "int",
    "number_of_reviews": "int",
    "bathrooms": "float",
    "price_gbp": "float",
    "bedrooms": "smallint",
    "beds": "smallint",
    "rating": "float",
    "location_score": "float",
    "cleanliness_score": "float",
}


def _judge(
    raw: DataFrame,
    ruleset: Sequence[_Rule],
    id_rule: Parsed,
    between: Sequence[Callable[[DataFrame], DataFrame]] = (),
) -> DataFrame:
    """Values, with a step of ``between`` after each share of them, then verdicts.

    Spark does not compile list functions together with their neighbours, so such steps cut the
    work into several methods. All rules in one go beyond 8,000 bytes, which the JVM interprets.
    """
    carried = [name for name in (FILE_POSITION, "bad_encoding") if name in raw.columns]
    # Values first, each in a column of its own; the verdicts then read those columns.
    kept = {field: out for field, out, _ in ruleset if out}
    steps = raw.withColumn("_id", id_rule.value)
    steps = steps.withColumns({out: rule.value for _, out, rule in ruleset if out and out[0] == "_"})
    values = [(f"_v_{out}", rule.value) for _, out, rule in ruleset if out and out[0] != "_" and rule.value is not None]
    share = -(-len(values) // max(1, len(between)))
    for i, step in enumerate(between or (lambda steps: steps,)):
        steps = step(steps.withColumns(dict(values[i * share : (i + 1) * share])))
    where = lambda out: F.col(out if out[0] == "_" else f"_v_{out}")
    # The first rule that refuses names the rejection.
    reason = F.coalesce(
        *[F.when(rule.bad(where(kept[field])), F.lit(field)) for field, _, rule in ruleset]
    )
    values = [
        (where(out).cast(LISTING_TYPES[out]) if out in LISTING_TYPES else where(out)).alias(out)
        for _, out, _ in ruleset
        if out and out[0] != "_"
    ]
    return steps.select(*values, reason.alias(REJECTED_FIELD), F.col("_id").alias(READABLE_ID), *carried)


def parse_listings(raw: DataFrame) -> DataFrame:
    """Every listing row with typed values, and the column that refused it, if any.

    Only the listed columns survive: host identity has no name in the output. Store the
    result before splitting it: a filter on the verdict would otherwise be moved below
    the parsing and parse every row a second time.
    """
    between = (
        lambda steps: rules.listed_strings(steps, "amenities", "_strings"),
        lambda steps: distinct_names(steps, "_strings", "_v_amenity_names"),
    )
    return _judge(raw, _listing_rules(), rules.whole_number(F.col("id")), between)


def parse_reviews(raw: DataFrame) -> DataFrame:
    """Every review row as listing id, date and text; reviewer and review ids are not read."""
    return _judge(raw, _review_rules(), rules.whole_number(F.col("listing_id")))


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col(REJECTED_FIELD).isNull()).drop(
        REJECTED_FIELD, READABLE_ID, "bad_encoding"
    )


def rejected(parsed: DataFrame) -> DataFrame:
    """Refused rows as the column to blame and, where readable, the source id."""
    return parsed.where(F.col(REJECTED_FIELD).isNotNull()).select(
        F.col(REJECTED_FIELD).alias("field"), F.col(READABLE_ID).alias("source_listing_id")
    )


def rejection_summary(parsed: DataFrame, limit: int = 5) -> DataFrame:
    """The columns that refused most rows."""
    return (
        rejected(parsed)
        .groupBy("field")
        .agg(F.count("*").alias("rows"))
        .orderBy(F.desc("rows"), "field")
        .limit(limit)
    )


def row_counts(parsed: DataFrame) -> DataFrame:
    """Rows seen, rejected and accepted: one row."""
    refused = F.col(REJECTED_FIELD).isNotNull()
    return parsed.agg(
        F.count("*").alias("seen"),
        F.count_if(refused).alias("rejected"),
        F.count_if(~refused).alias("accepted"),
    )
