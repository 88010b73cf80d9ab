"""The seventeen filter fields: validation, predicates, counts and reports.

A filter is used in two shapes. One request is a mapping and becomes literals that reach
the scan. Many requests are rows of a ``filter_sets`` table and are matched in one job.
Both read the same table of fields.
"""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roostline import config
from roostline.errors import InvalidFilterError, UnknownFieldError
from roostline.functions import geometry
from roostline.functions.geometry import box_around, within_box
from roostline.functions.quantiles import exact_percentiles
from roostline.functions.text import stripped
from roostline.session import spread, stable

FILTER_SETS = (
    "request_id string, neighbourhood_ids array<int>, room_type_ids array<int>, "
    "property_type_ids array<int>, min_price double, max_price double, min_accommodates int, "
    "min_bedrooms int, min_beds int, min_bathrooms double, max_minimum_nights int, "
    "min_rating double, min_location_score double, min_reviews int, instant_bookable boolean, "
    "host_is_superhost boolean, amenities array<string>, "
    "near struct<latitude:double,longitude:double,radius_km:double>"
)

# Filter field -> listing column, any of whose values qualifies.
ANY_OF: Mapping[str, str] = {
    "neighbourhood_ids": "neighbourhood_id",
    "room_type_ids": "room_type_id",
    "property_type_ids": "property_type_id",
}
# Filter field -> (listing column, comparison of the column with the bound).
BOUNDS: Mapping[str, tuple[str, Callable]] = {
    "min_price": ("price_gbp", operator.ge),
    "max_price": ("price_gbp", operator.le),
    "min_accommodates": ("accommodates", operator.ge),
    "min_bedrooms": ("bedrooms", operator.ge),
    "min_beds": ("beds", operator.ge),
    "min_bathrooms": ("bathrooms", operator.ge),
    "max_minimum_nights": ("minimum_nights", operator.le),
    "min_rating": ("rating", operator.ge),
    "min_location_score": ("location_score", operator.ge),
    "min_reviews": ("number_of_reviews", operator.ge),
    "instant_bookable": ("instant_bookable", operator.eq),
    "host_is_superhost": ("host_is_superhost", operator.eq),
}
FIELDS = (*ANY_OF, *BOUNDS, "amenities", "near")
# Columns that may be NULL: comparing one drops the rows that lack it.
NULLABLE = (
    "price_gbp",
    "instant_bookable",
    "bedrooms",
    "beds",
    "bathrooms",
    "rating",
    "location_score",
    "host_is_superhost",
)
# Columns a statistic may be asked for.
STATISTIC_COLUMNS = (
    "price_gbp",
    "accommodates",
    "bedrooms",
    "beds",
    "bathrooms",
    "minimum_nights",
    "rating",
    "location_score",
    "number_of_reviews",
    "latitude",
    "longitude",
)
# (field, lowest, highest) of the numeric bounds; None is open.
_RANGES = (
    ("min_price", 0, None),
    ("max_price", 0, None),
    ("min_accommodates", 1, None),
    ("min_bedrooms", 0, None),
    ("min_beds", 0, None),
    ("min_bathrooms", 0, None),
    ("max_minimum_nights", 1, None),
    ("min_rating", 0, config.MAX_RATING),
    ("min_location_score", 0, config.MAX_RATING),
    ("min_reviews", 0, None),
)


# --- Filter sets as rows -----------------------------------------------------


def filter_sets(spark: SparkSession, requests: Mapping[str, Mapping]) -> DataFrame:
    """A ``filter_sets`` table from ``{request_id: {field: value}}``."""
    names = [part.split(":")[0].split()[0] for part in FILTER_SETS.split(", ")]
    rows = []
    for request_id, given in requests.items():
        unknown = sorted(set(given) - set(FIELDS))
        if unknown:
            raise UnknownFieldError(f"no such filter: {', '.join(unknown)}")
        row = {"request_id": request_id, **given}
        values = []
        for name in names:
            value = row.get(name)
            if name in ("neighbourhood_ids", "room_type_ids", "property_type_ids", "amenities"):
                value = list(value or ())
            elif name == "near" and value is not None:
                value = tuple(float(value[k]) for k in ("latitude", "longitude", "radius_km"))
            elif isinstance(value, int) and not isinstance(value, bool) and name in (
                "min_price",
                "max_price",
                "min_bathrooms",
                "min_rating",
                "min_location_score",
            ):
                value = float(value)
            values.append(value)
        rows.append(tuple(values))
    return spark.createDataFrame(rows, FILTER_SETS)


def problems() -> Column:
    """The fields of a filter set that break a rule, in field order."""
    c = F.col
    checks: list[tuple[str, Column]] = []
    for field in ANY_OF:
        checks.append((field, F.exists(field, lambda i: i.isNull() | (i < 1))))
    for field, low, high in _RANGES:
        bad = (c(field) < low) | F.isnan(c(field).cast("double"))
        checks.append((field, bad if high is None else bad | (c(field) > high)))
    checks.append(("amenities", F.exists("amenities", lambda a: stripped(a) == "")))
    near = c("near")
    inside = (
        near["latitude"].between(-90.0, 90.0)
        & near["longitude"].between(-180.0, 180.0)
        & (near["radius_km"] > 0)
        & (near["radius_km"] <= config.MAX_RADIUS_KM)
    )
    checks.append(("near", near.isNotNull() & ~F.coalesce(inside, F.lit(False))))
    named = F.array_compact(F.array(*[F.when(bad, F.lit(field)) for field, bad in checks]))
    empty_window = F.coalesce(c("min_price") > c("max_price"), F.lit(False))
    # The two prices are only compared once both are valid on their own.
    return F.when(
        (F.size(named) == 0) & empty_window, F.array(F.lit("price_range"))
    ).otherwise(named)


def validate(sets: DataFrame) -> DataFrame:
    """``sets`` with ``problems``: empty for a usable filter set."""
    return sets.withColumn("problems", problems())


def canonical(sets: DataFrame) -> DataFrame:
    """Set-valued fields sorted without repeats, and a ``filter_key`` equal for equal filters."""
    out = sets
    for field in ANY_OF:
        ids = F.coalesce(F.col(field), F.array().cast("array<int>"))
        out = out.withColumn(field, F.array_sort(F.array_distinct(ids)))
    names = F.coalesce(F.col("amenities"), F.array().cast("array<string>"))
    out = out.withColumn(
        "amenities", F.array_sort(F.array_distinct(F.transform(names, stripped)))
    )
    return out.withColumn("filter_key", F.sha2(F.to_json(F.struct(*FIELDS)), 256))


def is_empty() -> Column:
    """Whether a canonical filter set constrains nothing."""
    sets = [F.size(f) == 0 for f in (*ANY_OF, "amenities")]
    scalars = [F.col(f).isNull() for f in (*BOUNDS, "near")]
    return functools.reduce(operator.and_, [*sets, *scalars])


def null_excluding(value: Callable[[str], Column] = F.col) -> Column:
    """The nullable columns a filter set compares, sorted."""
    used = [
        F.when(value(field).isNotNull(), F.lit(column))
        for field, (column, _) in BOUNDS.items()
        if column in NULLABLE
    ]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*used))))


def checked(given: Mapping) -> dict:
    """One request in canonical form: sets sorted without repeats, names trimmed, no open field.

    Refuses what ``problems`` reports for a table of requests, with the fields named.
    """
    unknown = sorted(set(given) - set(FIELDS))
    if unknown:
        raise UnknownFieldError(f"no such filter: {', '.join(unknown)}")
    out = {field: value for field, value in given.items() if value is not None}
    bad = [f for f in ANY_OF if any(i is None or i < 1 for i in out.get(f, ()))]
    for field, low, high in _RANGES:
        value = out.get(field, low)
        if not low <= value <= (math.inf if high is None else high):
            bad.append(field)
    names = [name.strip() for name in out.get("amenities", ())]
    if not all(names):
        bad.append("amenities")
    if "near" in out:
        latitude, longitude, radius = (out["near"][k] for k in ("latitude", "longitude", "radius_km"))
        if not (abs(latitude) <= 90 and abs(longitude) <= 180 and 0 < radius <= config.MAX_RADIUS_KM):
            bad.append("near")
    if not bad and out.get("min_price", 0) > out.get("max_price", math.inf):
        bad.append("price_range")
    if bad:
        raise InvalidFilterError(f"not a usable filter: {', '.join(bad)}")
    sets = {f: sorted(set(out[f])) for f in ANY_OF if f in out} | ({"amenities": sorted(set(names))} if names else {})
    return {f: v for f, v in (out | sets).items() if v not in ([], ())}


# --- Predicates --------------------------------------------------------------


def conditions(
    given: Mapping, indexed_amenities: Mapping[str, str] | None = None
) -> list[tuple[str, Column]]:
    """``(field, predicate)`` of one request, checked, in a fixed order, for the fields it sets."""
    given = checked(given)
    terms: list[tuple[str, Column]] = []
    for field, column in ANY_OF.items():
        ids = given.get(field, [])
        if len(ids) == 1:
            terms.append((field, F.col(column) == ids[0]))
        elif ids:
            terms.append((field, F.col(column).isin(ids)))
    for field, (column, compare) in BOUNDS.items():
        if given.get(field) is not None:
            terms.append((field, compare(F.col(column), F.lit(given[field]))))
    near = given.get("near")
    if near is not None:
        box = box_around(*(F.lit(float(near[k])) for k in ("latitude", "longitude", "radius_km")))
        terms.append(("near", within_box(F.col("latitude"), F.col("longitude"), box)))
    columns = indexed_amenities or {}
    for amenity in given.get("amenities", []):
        if amenity in columns:
            terms.append(("amenities", F.col(columns[amenity])))
        else:
            terms.append(("amenities", F.array_contains("amenities", amenity)))
    return terms


def where(
    listings: DataFrame, given: Mapping, indexed_amenities: Mapping[str, str] | None = None
) -> DataFrame:
    """Listings that satisfy every condition of one request; all of them for an empty one."""
    terms = [predicate for _, predicate in conditions(given, indexed_amenities)]
    return listings.where(functools.reduce(operator.and_, terms)) if terms else listings


def count_matches(listings: DataFrame, given: Mapping) -> DataFrame:
    """How many listings one request matches: one row."""
    return where(listings, given).agg(F.count("*").alias("matches"))


def null_losses(listings: DataFrame) -> DataFrame:
    """``(column, rows)``: listings that any comparison on a nullable column drops."""
    counted = listings.agg(
        F.count("*").alias("_all"), *[F.count(c).alias(c) for c in NULLABLE]
    )
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("column"), (F.col("_all") - F.col(c)).alias("rows_lost"))
            for c in NULLABLE
        ]
    )
    return counted.select(F.inline(pairs))


def null_report(sets: DataFrame, listings: DataFrame) -> DataFrame:
    """Per request and nullable column it compares: how many listings lack that column."""
    applied = sets.select("request_id", F.explode(null_excluding()).alias("column"))
    # Eight rows, one per nullable column.
    return applied.join(F.broadcast(null_losses(listings)), "column")


# --- Many filter sets against all listings -----------------------------------


# In a batch both sides of every comparison are filled in, so that a comparison is one
# machine instruction: an absent floor is minus infinity, and so is a missing value under
# a floor; an absent ceiling is NaN, which sorts above everything, and so is a missing
# value under a ceiling. A missing value thus passes exactly where no bound is set.
_FLOOR, _CEILING = float("-inf"), float("nan")
_ANY, _UNKNOWN = -1, 2


def _filled(column: Column, compare: Callable, absent_flag: int) -> Column:
    if compare is operator.eq:
        return F.coalesce(column.cast("int"), F.lit(absent_flag))
    return F.coalesce(column.cast("double"), F.lit(_FLOOR if compare is operator.ge else _CEILING))


def _listing_side(listings: DataFrame) -> DataFrame:
    """Listings with their values as the batch comparisons read them."""
    sides = {
        f"_at_{field}": _filled(F.col(column), compare, _UNKNOWN)
        for field, (column, compare) in BOUNDS.items()
    }
    ids = {f"_{c}": F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in ANY_OF.values()}
    place = {f"_{c}": F.coalesce(F.col(c), F.lit(0.0)) for c in ("latitude", "longitude")}
    return listings.withColumns(sides | ids | place)


def _request_side(sets: DataFrame) -> DataFrame:
    """Filter sets with their bounds as the batch comparisons read them."""
    near = F.col("near")
    box = box_around(near["latitude"], near["longitude"], near["radius_km"])
    out = sets.withColumns(
        {f: F.array_distinct(F.coalesce(F.col(f), F.array().cast("array<int>"))) for f in ANY_OF}
        | {"amenities": F.coalesce(F.col("amenities"), F.array().cast("array<string>"))}
    )
    bounds = {f"_at_{f}": _filled(F.col(f), compare, _ANY) for f, (_, compare) in BOUNDS.items()}
    edges = {
        name: F.coalesce(edge, F.lit(absent))
        for name, edge, absent in (
            ("_south", box.south, _FLOOR),
            ("_north", box.north, -_FLOOR),
            ("_west", box.west, _FLOOR),
            ("_east", box.east, -_FLOOR),
        )
    }
    opens = {f"_open_{f}": F.size(f) == 0 for f in (*ANY_OF, "amenities")}
    return out.withColumns(bounds | edges | opens)


def _pair_terms() -> list[tuple[str, Column]]:
    """``(field, holds)`` for a listing ``l`` and a filter set ``f``, cheapest terms first."""
    terms = []
    for field, (_, compare) in BOUNDS.items():
        asked, have = F.col(f"f._at_{field}"), F.col(f"l._at_{field}")
        holds = compare(have, asked)
        terms.append((field, (asked == _ANY) | holds if compare is operator.eq else holds))
    latitude, longitude = F.col("l._latitude"), F.col("l._longitude")
    in_box = (
        (latitude >= F.col("f._south"))
        & (latitude <= F.col("f._north"))
        & (longitude >= F.col("f._west"))
        & (longitude <= F.col("f._east"))
    )
    terms.append(("near", in_box))
    for field, column in ANY_OF.items():
        inside = F.array_contains(F.col(f"f.{field}"), F.col(f"l._{column}"))
        terms.append((field, F.col(f"f._open_{field}") | inside))
    missing = F.array_except(F.col("f.amenities"), F.col("l.amenities"))
    terms.append(("amenities", F.col("f._open_amenities") | (F.size(missing) == 0)))
    return terms


# What a request can be joined on, the most selective first. A request's shape is the number
# of the first of these it names, or 0 if it names none.
_SHAPES = {1: "neighbourhood_ids", 4: "near", 5: "amenities", 2: "property_type_ids", 3: "room_type_ids"}
# Pieces of one listing value when requests are shuffled: a value that a third of all
# listings share becomes pieces of about one percent.
_SLICES = 32
# Filter sets that are worth joining one by one.
JOINED_SETS = 64
# Wanted amenities that are worth naming to the listings; beyond it they send all of theirs.
_NAMED_AMENITIES = 256


def amenity_counts(listings: DataFrame, sets: DataFrame) -> DataFrame:
    """``(amenity, n)`` of the amenities that some filter set asks for."""
    wanted = sets.select(F.explode("amenities").alias("amenity")).distinct()
    held = listings.select(F.explode(F.array_distinct("amenities")).alias("amenity"))
    return held.join(wanted, "amenity").groupBy("amenity").agg(F.count("*").alias("n"))


def _rarest(sets: DataFrame, counts: DataFrame) -> DataFrame:
    """``(amenities, _rarest)``: of each list that is asked for, the amenity fewest listings have."""
    asked = sets.select("amenities", F.explode("amenities").alias("amenity")).distinct().join(counts, "amenity", "left")
    least = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "amenity"))
    return asked.groupBy("amenities").agg(least["amenity"].alias("_rarest"))


def _keyed(sets: DataFrame, rarest: DataFrame | None = None) -> DataFrame:
    """Filter sets repeated per value they are joined on, with ``_shape``, ``_key`` and ``_level``.

    A request that pins an any-of field only meets the listings with one of its values, one
    with an area box those in the grid cells it touches, one with amenities those that have
    the rarest of them (``rarest``, or the first in order). A request that pins nothing has
    the key 0 of shape 0, which every listing carries.
    """
    sides = _request_side(sets)
    named = {s: F.col("near").isNotNull() if f == "near" else F.size(f) > 0 for s, f in _SHAPES.items()}
    first = F.coalesce(*[F.when(is_named, F.lit(s)) for s, is_named in named.items()], F.lit(0))
    if rarest is None:
        sides = sides.withColumn("_rarest", F.array_min("amenities"))
    else:
        sides = sides.join(rarest, "amenities", "left")
    box = [F.when(~F.col(c).isin(_FLOOR, -_FLOOR), F.col(c)) for c in ("_south", "_north", "_west", "_east")]
    level = geometry.grid_level(*box)
    keys = F.when(F.col("_shape") == 0, F.array(F.lit(0).cast("long")))
    for shape, field in _SHAPES.items():
        if field == "near":
            values = geometry.grid_cells_of_box(*box, F.col("_level"))
        elif field == "amenities":
            values = F.array(F.xxhash64("_rarest"))
        else:
            values = F.col(field).cast("array<long>")
        keys = keys.when(F.col("_shape") == shape, values)
    met = sides.withColumn("_shape", first)
    met = met.withColumn("_level", F.when(F.col("_shape") == 4, level))
    return met.withColumn("_key", F.explode(keys)).drop("_rarest")


def _listing_keys(shape: int, keyed: DataFrame, levels: Sequence[int]) -> Column:
    """The keys of a listing in one shape, as an array of whole numbers."""
    field = _SHAPES.get(shape)
    if field == "near":
        return F.array(*[geometry.grid_cell(F.col("_latitude"), F.col("_longitude"), F.lit(level)) for level in levels])
    if field == "amenities":
        held = F.transform(F.array_distinct("amenities"), lambda a: F.xxhash64(a))
        wanted = keyed.where(F.col("_shape") == shape).select("_key").distinct().limit(_NAMED_AMENITIES + 1).collect()
        if len(wanted) <= _NAMED_AMENITIES:
            held = F.array_intersect(held, F.array(*[F.lit(w["_key"]) for w in wanted]).cast("array<long>"))
        return F.coalesce(held, F.array().cast("array<long>"))
    return F.array((F.col(f"_{ANY_OF[field]}") if field else F.lit(0)).cast("long"))


def _joined(
    listings: DataFrame, keyed: DataFrame, condition: Column, row_bytes: int = 256
) -> DataFrame:
    # At most six rows: how many requests there are of each shape, and which grids they use.
    sizes = keyed.groupBy("_shape").agg(F.count("*").alias("n"), F.collect_set("_level").alias("levels")).collect()
    levels = sorted(level for r in sizes for level in r["levels"])
    most = min(config.BROADCAST_MAX_ROWS, config.BROADCAST_MAX_BYTES // row_bytes)
    small = sum(r["n"] for r in sizes) <= most
    # Requests that fit on every executor meet the listings where those are read. Others
    # are shuffled, and the listings of one value are cut into slices.
    tasks = int(listings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slices = {shape: 1 if small else _SLICES if shape else max(tasks, _SLICES) for shape in [r["_shape"] for r in sizes] or [0]}

    def placed(shape: int, count: int) -> Column:
        piece = F.pmod(F.xxhash64("id"), F.lit(count)).cast("int").alias("_slice")
        return F.transform(
            _listing_keys(shape, keyed, levels),
            lambda key: F.struct(F.lit(shape).alias("_shape"), key.alias("_key"), piece),
        )

    keys = [placed(shape, count) for shape, count in slices.items()]
    # Each listing meets many requests: few files are first spread over more tasks.
    rows = spread(listings, "id", parts=len(listings.inputFiles()))
    left = _listing_side(rows).select("*", F.inline(F.concat(*keys))).alias("l")
    copies = F.lit(0)
    for shape, count in slices.items():
        copies = F.when(F.col("_shape") == shape, count - 1).otherwise(copies)
    right = keyed.withColumn("_slice", F.explode(F.sequence(F.lit(0), copies)))
    same = [F.col(f"l.{c}") == F.col(f"f.{c}") for c in ("_shape", "_key", "_slice")]
    right = (F.broadcast(right) if small else right).alias("f")
    return left.join(right, functools.reduce(operator.and_, [*same, condition]))


def match(
    listings: DataFrame,
    sets: DataFrame,
    columns: Sequence[str] = ("id",),
    carry: Sequence[str] = (),
    row_bytes: int = 256,
) -> DataFrame:
    """``(request_id, *carry, *columns)`` for every listing a filter set matches.

    ``row_bytes`` is the size of one filter set with what it carries; it decides how many
    of them may be sent to every executor. More than ``JOINED_SETS`` filter sets are matched
    with bitmaps if only numbers are told of a listing; others by a join on what they pin.
    """
    # Lists of wide columns cost more to take apart than the join does.
    narrow = all(isinstance(listings.schema[c].dataType, T.NumericType) for c in columns)
    if narrow and sets.count() > JOINED_SETS:
        from roostline.operators import pairs  # reads this module's table of fields

        return pairs.matched(listings, sets, columns, carry)
    every = functools.reduce(operator.and_, [holds for _, holds in _pair_terms()])
    # Read by the size check and the join, and with the amenities' counts behind it: kept once.
    keyed = stable(_keyed(sets, _rarest(sets, amenity_counts(listings, sets))))
    pairs = _joined(listings, keyed, every, row_bytes)
    return pairs.select(
        "f.request_id", *[F.col(f"f.{c}") for c in carry], *[F.col(f"l.{c}") for c in columns]
    )


# Values of an any-of field that a group of filter sets names between them; beyond it the
# group is open in that field.
_NAMED_VALUES = 64


def loosest(sets: DataFrame, key: str) -> DataFrame:
    """One filter set per ``key``, which is its ``request_id``: a listing that matches any set of the key matches it.

    Amenities and area boxes are seldom the same in a whole group and are left open.
    """
    every = lambda c: F.count_if(c) == F.count("*")
    out = {}
    for field in ANY_OF:
        ids = F.array_distinct(F.flatten(F.collect_set(field)))
        usable = every(F.size(field) > 0) & (F.size(ids) <= _NAMED_VALUES)
        out[field] = F.when(usable, ids).otherwise(F.array().cast("array<int>"))
    for field, (_, compare) in BOUNDS.items():
        low, high = F.min(field), F.max(field)
        bound = low if compare is operator.ge else high if compare is operator.le else F.when(low == high, low)
        out[field] = F.when(every(F.col(field).isNotNull()), bound)
    grouped = sets.groupBy(F.col(key).alias("request_id")).agg(*[c.alias(f) for f, c in out.items()])
    return grouped.withColumns(
        {"amenities": F.array().cast("array<string>"), "near": F.lit(None).cast(sets.schema["near"].dataType)}
    )


def keep_matching(pairs: DataFrame, listings: DataFrame, sets: DataFrame) -> DataFrame:
    """The ``(request_id, id, …)`` rows whose listing satisfies the request's filters."""
    joined = (
        pairs.alias("p")
        .join(_listing_side(listings).alias("l"), F.col("p.id") == F.col("l.id"))
        .join(_request_side(sets).alias("f"), F.col("p.request_id") == F.col("f.request_id"))
    )
    every = functools.reduce(operator.and_, [holds for _, holds in _pair_terms()])
    return joined.where(every).select(*[F.col(f"p.{c}") for c in pairs.columns])


def _once(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every different filter once, with its key as ``request_id``; and the key of each request.

    A ``filter_key`` that ``canonical`` gave is taken as it is.
    """
    keyed = sets if "filter_key" in sets.columns else canonical(sets)
    # Read by several jobs: computed once, and its plan is cut off from theirs.
    keyed = stable(keyed.select("request_id", "filter_key", *FIELDS))
    different = keyed.select(F.col("filter_key").alias("request_id"), *FIELDS).dropDuplicates(["request_id"])
    return different, keyed.select("request_id", "filter_key")


def field_stats(listings: DataFrame, field: str, given: Mapping | None = None) -> DataFrame:
    """Specified behaviour: min, max, exact median and non-null count under one filter set."""
    if field not in STATISTIC_COLUMNS:
        raise UnknownFieldError(f"{field!r} is not a filterable column")
    rows = where(listings, given or {}).select(F.col(field).cast("double").alias("value"))
    ends = rows.agg(
        F.min("value").alias("min"), F.max("value").alias("max"), F.count("value").alias("non_null")
    )
    middle = exact_percentiles(rows, [], "value", {"median": 0.5})
    return ends.withColumn("median", middle.select("median").scalar()).select(
        F.lit(field).alias("field"), "min", "max", "median", "non_null"
    )

