"""Relaxation of thin requests, as rounds of whole-table jobs. All of it is specified behaviour.

How far a bound moves is a choice of this library (``config.RELAX_STEP``): numeric bounds
move by that share, set-valued and yes/no conditions are dropped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roostline import config
from roostline.operators import counting, filters
from roostline.session import stable

# A request that cannot seat its party is not an answer, so this bound never moves.
FIXED = ("min_accommodates",)
LOOSENABLE = tuple(f for f in filters.FIELDS if f not in FIXED)
# Which condition goes first when no single one of them is what keeps listings out.
_FALLBACK = tuple(f for f in (*filters.BOUNDS, "amenities", "near", *filters.ANY_OF) if f not in FIXED)
_WHOLE = ("min_bedrooms", "min_beds", "max_minimum_nights", "min_reviews")


def constraint_cost(listings: DataFrame, sets: DataFrame) -> DataFrame:
    """``(request_id, field, rows)``: listings kept out by this condition alone."""
    return counting.leave_one_out(listings, sets)


def thin_requests(
    listings: DataFrame, sets: DataFrame, threshold: int = config.THIN_RESULT_THRESHOLD
) -> DataFrame:
    """``(request_id, matches)`` of requests with fewer results than ``threshold``."""
    return counting.count_per_request(listings, sets).where(F.col("matches") < threshold)


def most_restrictive(costs: DataFrame) -> DataFrame:
    """``(request_id, field, rows)``: per request the condition that keeps out most."""
    worst = F.max_by(F.struct("field", "rows"), F.struct("rows", F.col("field")))
    top = costs.where(~F.col("field").isin(*FIXED)).groupBy("request_id").agg(worst.alias("w"))
    return top.select("request_id", "w.field", "w.rows")


def _is_set(field: str) -> Column:
    if field in (*filters.ANY_OF, "amenities"):
        return F.size(field) > 0
    return F.col(field).isNotNull()


def _loosened(field: str, step: float) -> Column:
    bound = F.col(field)
    if field in filters.ANY_OF:
        return F.array().cast("array<int>")
    if field == "amenities":
        return F.array().cast("array<string>")
    if field == "near":
        radius = bound["radius_km"] * (1 + step)
        wider = F.struct(
            bound["latitude"].alias("latitude"),
            bound["longitude"].alias("longitude"),
            radius.alias("radius_km"),
        )
        return F.when(radius <= config.MAX_RADIUS_KM, wider)
    if field in ("instant_bookable", "host_is_superhost"):
        return F.lit(None).cast("boolean")
    if field.startswith("max_"):
        moved = bound * (1 + step)
        return F.ceil(moved).cast("int") if field in _WHOLE else moved
    moved = bound * (1 - step)
    if field in _WHOLE:
        # A bound of zero still drops unknown values, so it is cleared instead.
        return F.when(F.floor(moved) > 0, F.floor(moved).cast("int"))
    return F.when(moved > 0, moved)


def loosen(sets: DataFrame, picks: DataFrame, step: float = config.RELAX_STEP) -> DataFrame:
    """``sets`` with the picked field of each request moved by one step."""
    chosen = sets.join(picks.select("request_id", F.col("field").alias("_picked")), "request_id")
    moved = {f: F.when(F.col("_picked") == f, _loosened(f, step)).otherwise(F.col(f)) for f in LOOSENABLE}
    return chosen.withColumns(moved).drop("_picked")


def relax(
    listings: DataFrame,
    sets: DataFrame,
    *,
    threshold: int = config.THIN_RESULT_THRESHOLD,
    rounds: int = config.MAX_RELAXATIONS,
    step: float = config.RELAX_STEP,
) -> DataFrame:
    """Filter sets after at most ``rounds`` loosenings of the requests that stay thin.

    Adds ``rounds_used`` and ``matches``. ``rounds=0`` is the control without any loop.
    The number of jobs depends on ``rounds`` alone, not on the requests.
    """
    current = filters.canonical(sets).drop("filter_key").withColumn("rounds_used", F.lit(0))
    current = stable(current.join(counting.count_per_request(listings, current), "request_id"))
    for _ in range(rounds):
        thin = current.where(F.col("matches") < threshold).drop("matches")
        if thin.isEmpty():
            break
        fallback = F.coalesce(*[F.when(_is_set(f), F.lit(f)) for f in _FALLBACK])
        worst = most_restrictive(constraint_cost(listings, thin))
        picks = (
            thin.select("request_id", fallback.alias("_fallback"))
            .join(worst, "request_id", "left")
            .select("request_id", F.coalesce("field", "_fallback").alias("field"))
            .where(F.col("field").isNotNull())
        )
        moved = stable(loosen(thin, picks, step).withColumn("rounds_used", F.col("rounds_used") + 1))
        # Only what moved is counted again.
        counted = moved.join(counting.count_per_request(listings, moved), "request_id")
        kept = current.join(moved.select("request_id"), "request_id", "left_anti")
        current = stable(kept.unionByName(counted))
    return current


def party_violations(original: DataFrame, relaxed: DataFrame) -> DataFrame:
    """Requests whose relaxed form would seat fewer guests than asked for."""
    floors = original.select("request_id", F.col("min_accommodates").alias("asked"))
    joined = relaxed.select("request_id", F.col("min_accommodates").alias("offered")).join(
        floors, "request_id"
    )
    lowered = F.col("asked").isNotNull() & (
        F.col("offered").isNull() | (F.col("offered") < F.col("asked"))
    )
    return joined.where(lowered).select("request_id", "asked", "offered")


def audit(
    original: DataFrame,
    relaxed: DataFrame,
    threshold: int = config.THIN_RESULT_THRESHOLD,
    fields: Sequence[str] = LOOSENABLE,
) -> DataFrame:
    """Per request: which fields moved, and whether it still has too few results."""
    before = filters.canonical(original).alias("a")
    joined = before.join(relaxed.alias("b"), "request_id")
    moved = F.array_compact(
        F.array(
            *[
                F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), F.lit(f))
                for f in fields
            ]
        )
    )
    return joined.select(
        "request_id",
        moved.alias("changed_fields"),
        F.col("b.rounds_used").alias("rounds_used"),
        F.col("b.matches").alias("matches"),
        (F.col("b.matches") < threshold).alias("unsatisfied"),
    )


def thin_share(counts: DataFrame, threshold: int = config.THIN_RESULT_THRESHOLD) -> DataFrame:
    """How many requests are thin, beside how many there are."""
    return counts.agg(
        F.count("*").alias("requests"), F.count_if(F.col("matches") < threshold).alias("thin")
    )


