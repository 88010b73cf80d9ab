"""Recorded response bodies to validated filter sets.

Input is ``responses(request_id, attempt, body, stop_reason)``. Names are resolved
against ``vocabulary(field, name, id)``; a name that is not in it is reported and never
becomes a filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roostline import config
from roostline.functions.rules import DECIMAL
from roostline.functions.text import stripped
from roostline.operators import filters
from roostline.session import spread, stored

NAME_FIELDS = ("neighbourhoods", "room_types", "property_types", "amenities")
_NUMBERS = ("min_price", "max_price", "min_bathrooms", "min_rating", "min_location_score")
_WHOLE = (
    "min_accommodates",
    "min_bedrooms",
    "min_beds",
    "max_minimum_nights",
    "min_reviews",
)
_FLAGS = ("instant_bookable", "host_is_superhost")
BODY_FIELDS = (
    "neighbourhoods",
    "room_types",
    "property_types",
    "min_price",
    "max_price",
    "min_accommodates",
    "min_bedrooms",
    "min_beds",
    "min_bathrooms",
    "max_minimum_nights",
    "min_rating",
    "min_location_score",
    "min_reviews",
    "instant_bookable",
    "host_is_superhost",
    "amenities",
    "semantic_query",
    "unsupported_constraints",
)
REASONS = {
    "neighbourhoods": "not a known neighbourhood",
    "room_types": "not a known room type",
    "property_types": "not a known property type",
    "amenities": "there is no filter for this amenity",
}
# Outcomes that are worth a second attempt: the body was wrong, not the call.
RETRIED = ("blank", "not_json", "not_object", "invalid")
_TRUE = ("true", "t", "yes", "y", "on", "1")
_FALSE = ("false", "f", "no", "n", "off", "0")


def decode(responses: DataFrame) -> DataFrame:
    """``responses`` with ``json`` and ``outcome``: what kind of body each one is.

    ``object`` bodies go on to validation; every other outcome is final.
    """
    # Taking a body apart weighs far more than its bytes: few files are spread over more tasks.
    responses = spread(responses, "request_id", parts=len(responses.inputFiles()))
    json = F.try_parse_json("body")
    shape = F.schema_of_variant(json)
    stop = F.col("stop_reason")
    outcome = (
        F.when(stop == "refusal", "refused")
        .when(stop == "max_tokens", "truncated")
        .when(stop == "error", "transport")
        .when(F.col("body").isNull(), "empty")
        .when(stripped(F.col("body")) == "", "blank")
        .when(json.isNull(), "not_json")
        .when(shape.startswith("OBJECT"), "object")
        .otherwise("not_object")
    )
    out = responses.withColumn("outcome", outcome)
    return out.withColumn("json", F.when(F.col("outcome") == "object", json))


def _part(field: str) -> Column:
    return F.col(f"_part_{field}")


def _kind(field: str) -> Column:
    """The JSON type of a field; NULL where it is absent."""
    return F.col(f"_kind_{field}")


def _with_parts(decoded: DataFrame) -> DataFrame:
    """Every field and its JSON type as columns, so that a body is taken apart once."""
    parts = decoded.withColumns(
        {f"_part_{f}": F.try_variant_get("json", f"$.{f}", "variant") for f in BODY_FIELDS}
    )
    return parts.withColumns({f"_kind_{f}": F.schema_of_variant(_part(f)) for f in BODY_FIELDS})


def _read_list(field: str) -> Column:
    kind = _kind(field)
    value = F.when(kind.isin("ARRAY<STRING>", "ARRAY<VOID>"), F.try_variant_get(_part(field), "$", "array<string>"))
    return F.when(kind.isNull(), F.array().cast("array<string>")).otherwise(value)


def _read_scalar(field: str) -> Column:
    kind = _kind(field)
    text = F.lower(stripped(F.try_variant_get(_part(field), "$", "string")))
    if field in _FLAGS:
        value = F.when(text.isin(*_TRUE), F.lit(True)).when(text.isin(*_FALSE), F.lit(False))
    else:
        number = F.when(text == "true", F.lit(1.0)).when(text == "false", F.lit(0.0))
        written = F.when(text.rlike(DECIMAL), text.try_cast("double"))
        value = F.when(kind == "BOOLEAN", number).otherwise(written)
        if field in _WHOLE:
            value = F.when(value == F.floor(value), value).try_cast("int")
    nested = kind.startswith("ARRAY") | kind.startswith("OBJECT")
    return F.when(~nested & (kind != "VOID"), value)


def validate(decoded: DataFrame) -> DataFrame:
    """Typed body fields and ``problems``: the fields that break the schema, in order.

    Unknown fields are problems too. Bounds are checked later, on the filter set. Store
    the result before filtering it, or the filter takes every body apart a second time.
    """
    names = BODY_FIELDS[:-2]
    steps = _with_parts(decoded)
    kind = _kind("unsupported_constraints")
    asks = F.try_variant_get(
        _part("unsupported_constraints"), "$", "array<struct<constraint:string,reason:string>>"
    )
    well_formed = kind.isin("ARRAY<VOID>", "ARRAY<OBJECT<constraint: STRING, reason: STRING>>")
    steps = steps.withColumns(
        {f: _read_list(f) if f in NAME_FIELDS else _read_scalar(f) for f in names}
        | {
            "semantic_query": F.when(
                _kind("semantic_query") == "STRING",
                stripped(F.try_variant_get(_part("semantic_query"), "$", "string")),
            ),
            "reported": F.when(well_formed, asks),
        }
    )

    def wrong(field: str) -> Column:
        if field in NAME_FIELDS:
            return F.col(field).isNull() | F.exists(field, lambda n: n.isNull())
        return _kind(field).isNotNull() & (_kind(field) != "VOID") & F.col(field).isNull()

    no_ask = F.exists("reported", lambda a: a.isNull() | a["constraint"].isNull() | a["reason"].isNull())
    checks = [(f, wrong(f)) for f in names] + [
        ("semantic_query", F.coalesce(F.col("semantic_query"), F.lit("")) == ""),
        ("unsupported_constraints", F.col("reported").isNull() | no_ask),
    ]
    extra = F.array_sort(
        F.array_except(F.json_object_keys("body"), F.array(*[F.lit(f) for f in BODY_FIELDS]))
    )
    named = F.array_compact(F.array(*[F.when(bad, F.lit(field)) for field, bad in checks]))
    is_object = F.col("outcome") == "object"
    out = steps.withColumn("problems", F.when(is_object, F.concat(named, extra)))
    broken = is_object & (F.size("problems") > 0)
    dropped = [f"{p}{f}" for p in ("_part_", "_kind_") for f in BODY_FIELDS]
    return out.withColumn("outcome", F.when(broken, "invalid").otherwise(F.col("outcome"))).drop("json", *dropped)


def named_values(valid: DataFrame) -> DataFrame:
    """``(request_id, attempt, pos, field, name)``: every name a body uses, in order."""
    def tagged(field: str) -> Column:
        return F.transform(field, lambda n: F.struct(F.lit(field).alias("field"), n.alias("name")))

    lists = [tagged(f) for f in NAME_FIELDS]
    return valid.select(
        "request_id", "attempt", F.posexplode(F.flatten(F.array(*lists))).alias("pos", "entry")
    ).select("request_id", "attempt", "pos", "entry.field", "entry.name")


def resolve(names: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``names`` with the id the vocabulary gives them; exact spelling, NULL if unknown."""
    return names.join(vocabulary.select("field", "name", "id"), ["field", "name"], "left")


def ungrounded(resolved: DataFrame) -> DataFrame:
    """``(request_id, attempt, field, name, pos)``: unknown names, once each."""
    return (
        resolved.where(F.col("id").isNull())
        .groupBy("request_id", "attempt", "field", "name")
        .agg(F.min("pos").alias("pos"))
    )


def _mentions(reported: Column, name: Column) -> Column:
    """Whether some reported constraint holds ``name`` as a whole word, case ignored."""
    quoted = F.replace(name, F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    pattern = F.concat(F.lit("(?iuU)(?<!\\w)\\Q"), quoted, F.lit("\\E(?!\\w)"))
    return F.exists(reported, lambda c: F.regexp_like(c["constraint"], pattern))


def ground(responses: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Every attempt as its outcome, filter set, unknown names and unsupported asks.

    ``unsupported`` lists the body's own asks first, then unknown names it did not
    already mention.
    """
    # Read twice below: once for its names, once for everything else.
    checked = stored(validate(decode(responses)), "bodies")
    usable = checked.where(F.col("outcome") == "object")
    resolved = resolve(named_values(usable), vocabulary)
    of = lambda field: F.when(
        (F.col("field") == field) & F.col("id").isNotNull(),
        F.col("name") if field == "amenities" else F.col("id"),
    )
    unknown = F.when(F.col("id").isNull(), F.struct("pos", "field", "name"))
    per_attempt = resolved.groupBy("request_id", "attempt").agg(
        F.array_sort(F.collect_set(of("neighbourhoods"))).alias("neighbourhood_ids"),
        F.array_sort(F.collect_set(of("room_types"))).alias("room_type_ids"),
        F.array_sort(F.collect_set(of("property_types"))).alias("property_type_ids"),
        F.array_sort(F.collect_set(of("amenities"))).alias("_amenities"),
        F.array_sort(F.collect_list(unknown)).alias("_unknown"),
    )
    joined = checked.join(per_attempt, ["request_id", "attempt"], "left")
    no_ids, no_names = F.array().cast("array<int>"), F.array().cast("array<string>")
    seen = F.transform(
        F.coalesce("_unknown", F.array().cast("array<struct<pos:int,field:string,name:string>>")),
        lambda u: F.struct(u["field"].alias("field"), u["name"].alias("name")),
    )
    reason = F.create_map(*[F.lit(x) for pair in REASONS.items() for x in pair])
    moved = F.transform(
        F.filter("ungrounded", lambda u: ~_mentions(F.col("reported"), u["name"])),
        lambda u: F.struct(u["name"].alias("constraint"), F.element_at(reason, u["field"]).alias("reason")),
    )
    out = (
        joined.withColumns(
            {f: F.coalesce(F.col(f), no_ids) for f in filters.ANY_OF}
            | {
                "amenities": F.coalesce(F.col("_amenities"), no_names),
                "near": F.lit(None).cast("struct<latitude:double,longitude:double,radius_km:double>"),
                # ``array_distinct`` keeps the first of equal entries: first-seen order.
                "ungrounded": F.array_distinct(seen),
            }
        )
        .drop("_amenities", "_unknown", "neighbourhoods", "room_types", "property_types")
        .withColumn("unsupported", F.concat("reported", moved))
    )
    bounds = F.when(F.col("outcome") == "object", filters.problems())
    out = out.withColumn("_bounds", bounds)
    final = (
        F.when(F.size("_bounds") > 0, "invalid")
        .when(F.col("outcome") == "object", "valid")
        .otherwise(F.col("outcome"))
    )
    problems = F.when(F.size("_bounds") > 0, F.col("_bounds")).otherwise(F.col("problems"))
    return out.withColumns({"outcome": final, "problems": problems}).drop("_bounds", "reported")


def settle(attempts: DataFrame, most: int = config.MAX_PARSE_ATTEMPTS) -> DataFrame:
    """One row per request: ``parsed`` with its first valid attempt, or ``failed``.

    A failed request has no filter set; it never turns into an empty one.
    """
    tried = attempts.where(F.col("attempt") <= most)
    valid = F.col("outcome") == "valid"
    return (
        tried.groupBy("request_id")
        .agg(
            F.count("*").alias("attempts"),
            F.min(F.when(valid, F.col("attempt"))).alias("accepted_attempt"),
            F.max_by("outcome", "attempt").alias("last_outcome"),
        )
        .withColumn(
            "status", F.when(F.col("accepted_attempt").isNotNull(), "parsed").otherwise("failed")
        )
    )


def filter_sets(attempts: DataFrame, most: int = config.MAX_PARSE_ATTEMPTS) -> DataFrame:
    """The canonical filter sets of the requests that were parsed."""
    accepted = settle(attempts, most).where("status = 'parsed'")
    winners = accepted.select("request_id", F.col("accepted_attempt").alias("attempt"))
    chosen = attempts.join(winners, ["request_id", "attempt"], "left_semi")
    return filters.canonical(chosen.select("request_id", *filters.FIELDS, "semantic_query"))


def outcome_counts(attempts: DataFrame) -> DataFrame:
    """Attempts per outcome and whether such an outcome is tried again."""
    return (
        attempts.groupBy("outcome")
        .agg(F.count("*").alias("attempts"))
        .withColumn("retried", F.col("outcome").isin(*RETRIED))
    )
