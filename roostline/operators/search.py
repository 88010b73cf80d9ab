"""Ranked retrieval: exact filtered top-k, disjunction branches, baselines and look-ups.

Every ranking is by distance, then id. Listings without a vector are never ranked.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roostline import config
from roostline.functions.text import without_names
from roostline.functions.vectors import distance_to, distances, matrix
from roostline.operators import counting, filters
from roostline.operators.reconcile import newest_children
from roostline.session import stable

# What a ranked row shows without a second look-up: no large text.
RESULT_COLUMNS = (
    "id",
    "source_listing_id",
    "name",
    "neighbourhood_id",
    "room_type_id",
    "property_type_id",
    "latitude",
    "longitude",
    "price_gbp",
    "accommodates",
    "bedrooms",
    "beds",
    "bathrooms",
    "minimum_nights",
    "rating",
    "location_score",
    "number_of_reviews",
    "instant_bookable",
    "host_is_superhost",
)


def check_arguments(
    *,
    limit: int,
    cap: int = config.FANOUT_CAP,
    query: Sequence[float] | None = None,
    columns: Sequence[str] = RESULT_COLUMNS,
    width: int | None = None,
) -> None:
    """Refuse a search that could not return anything useful."""
    if limit < 1:
        raise ValueError(f"limit must be at least 1, got {limit}")
    if cap < 1:
        raise ValueError(f"the branch cap must be at least 1, got {cap}")
    if query is not None and not len(query):
        raise ValueError("an empty query vector ranks no listing")
    if query is not None and width is not None and len(query) != width:
        raise ValueError(f"the query vector has {len(query)} values, the listings have {width}")
    if not columns:
        raise ValueError("a result with no columns was asked for")


def check_pool(pool: int, bound: int = config.POOL_BOUND) -> int:
    """A pool above the bound would be cut short without notice, so it is an error."""
    if pool < 1:
        raise ValueError(f"the candidate pool must be at least 1, got {pool}")
    if pool > bound:
        raise ValueError(f"candidate pool {pool} exceeds the bound {bound}")
    return pool


def argument_problems(
    limit: Column, cap: Column, pool: Column, query: Column, width: int, bound: int = config.POOL_BOUND
) -> Column:
    """What ``check_arguments`` and ``check_pool`` would refuse, named, for a table of searches.

    A missing number or vector is refused as well; usable arguments give an empty array.
    """
    known = F.size(query) > 0
    checks = (
        ("limit", F.coalesce(limit < 1, F.lit(True))),
        ("cap", F.coalesce(cap < 1, F.lit(True))),
        ("pool", F.coalesce(~pool.between(1, bound), F.lit(True))),
        ("query", ~F.coalesce(known, F.lit(False))),
        ("width", known & (F.size(query) != width)),
    )
    return F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks]))


def ranked(listings: DataFrame, query: Sequence[float], columns: Sequence[str]) -> DataFrame:
    """Listings with a vector and their distance to ``query``."""
    return listings.where(F.col("embedding").isNotNull()).select(
        *columns, distance_to(F.col("embedding"), query).alias("distance")
    )


def top_k(
    listings: DataFrame,
    given: Mapping,
    query: Sequence[float],
    limit: int,
    columns: Sequence[str] = RESULT_COLUMNS,
) -> DataFrame:
    """The ``limit`` nearest listings that satisfy every filter, exactly.

    The filter runs first, at the scan where it can, so only survivors pay for a distance.
    """
    check_arguments(limit=limit, query=query, columns=columns)
    return ranked(filters.where(listings, given), query, columns).orderBy("distance", "id").limit(limit)


def candidates(
    listings: DataFrame,
    given: Mapping,
    query: Sequence[float],
    pool: int = config.CANDIDATE_POOL,
    bound: int = config.POOL_BOUND,
) -> DataFrame:
    """The candidate pool of one request, never larger than the bound."""
    return top_k(listings, given, query, check_pool(pool, bound))


# --- Many requests -----------------------------------------------------------


def branches(sets: DataFrame, cap: int = config.FANOUT_CAP) -> DataFrame:
    """One row per branch of each request, with ``branch`` and the plan report columns.

    A branch pins one value of every any-of field that has several. A request that asks
    for more than ``cap`` branches stays one row with its any-of sets as they are.
    """
    check_arguments(limit=1, cap=cap)
    out = filters.canonical(sets)
    wide = [F.greatest(F.size(f), F.lit(1)).cast("long") for f in filters.ANY_OF]
    out = out.withColumn("requested_branches", functools.reduce(operator.mul, wide))
    out = out.withColumn("capped", F.col("requested_branches") > cap)
    for field in filters.ANY_OF:
        pinned = (F.size(field) > 1) & ~F.col("capped")
        out = out.withColumn(
            field,
            F.explode(
                F.when(pinned, F.transform(field, lambda v: F.array(v))).otherwise(
                    F.array(F.col(field))
                )
            ),
        )
    pinned_ids = F.transform(
        F.array(*filters.ANY_OF),
        lambda ids: F.when(F.size(ids) == 1, F.get(ids, F.lit(0)).cast("string")).otherwise("*"),
    )
    return out.withColumn("branch", F.array_join(pinned_ids, "/"))


def plan_report(
    sets: DataFrame,
    cap: int = config.FANOUT_CAP,
    indexed_amenities: Sequence[str] = (),
) -> DataFrame:
    """How each request is expressed: branches, cap, and which columns weaken or drop rows."""
    check_arguments(limit=1, cap=cap)
    out = filters.canonical(sets)
    wide = [F.greatest(F.size(f), F.lit(1)).cast("long") for f in filters.ANY_OF]
    requested = functools.reduce(operator.mul, wide)
    capped = requested > cap
    indexed = F.array(*[F.lit(a) for a in indexed_amenities]).cast("array<string>")
    late = F.array_compact(
        F.array(
            F.when(F.size(F.array_except("amenities", indexed)) > 0, F.lit("amenities")),
            *[
                F.when(capped & (F.size(field) > 1), F.lit(column))
                for field, column in filters.ANY_OF.items()
            ],
        )
    )
    return out.select(
        "request_id",
        requested.alias("requested_branches"),
        F.lit(cap).alias("cap"),
        capped.alias("capped"),
        F.when(capped, F.lit(1)).otherwise(requested).cast("long").alias("queries"),
        F.array_sort(late).alias("post_filter_columns"),
        filters.null_excluding().alias("null_excluding_columns"),
        filters.is_empty().alias("unconstrained"),
    )


def best_per(pairs: DataFrame, keys: Sequence[str], limit: int) -> DataFrame:
    """The nearest ``limit`` rows per key, ranked; each task sends at most that many per key."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("distance", "id"))
    return pairs.withColumn("place", place).where(F.col("place") <= limit)


def _in_blocks(requests: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, int]:
    """``requests`` with ``_block`` and a ``_number`` within it, and how many blocks there are."""
    held = stable(requests)
    blocks = max(1, -(-held.count() // config.QUERY_BLOCK))
    # A block holds about QUERY_BLOCK rows, so this window is small.
    order = Window.partitionBy("_block").orderBy(*keys)
    out = held.withColumn("_block", F.pmod(F.xxhash64(*keys), F.lit(blocks)).cast("int"))
    # Lists of these numbers are most of what moves, and nearly always small ones. A request
    # that is repeated very often makes a larger block.
    most = out.groupBy("_block").count().agg(F.max("count")).first()[0] or 0
    number = (F.row_number().over(order) - 1).cast("short" if most < 2**15 else "int")
    return out.withColumn("_number", number), blocks


def _with_vector(listings: DataFrame) -> DataFrame:
    return listings.where(F.col("embedding").isNotNull())


def _block_product(
    vectors: DataFrame,
    requests: DataFrame,
    listings: int,
    blocks: int,
    found: Callable[[pa.Table, pa.Table], tuple[np.ndarray, dict[str, pa.Array]]],
    keys: Sequence[str],
    result: str,
) -> DataFrame:
    """``found`` on every block of requests beside every slice of its listings.

    ``vectors`` holds ``id``, ``embedding`` and the ``_block`` it meets, out of ``listings``
    rows. Both sides are shuffled to ``(block, slice)``; a group has a bounded number of
    rows on either side, and the plan is the same for any number of requests. ``found``
    returns which request each of its rows belongs to, and the columns of ``result``.
    """
    spark = vectors.sparkSession
    # Small groups only where there are too few for the cores.
    groups = min(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)
    slices = max(-(-listings // config.LISTING_SLICE), -(-groups // blocks))
    left = vectors.withColumn("_slice", F.pmod(F.xxhash64("id"), F.lit(slices)).cast("int"))
    right = requests.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    # Both sides may stem from the same requests; new columns tell them apart.
    left, right = left.toDF(*left.columns), right.toDF(*right.columns)
    names = list(keys)

    def group(part: pa.Table, asked: pa.Table) -> pa.Table:
        request, columns = found(part, asked)
        carried = {k: asked.column(k).combine_chunks().take(pa.array(request)) for k in names}
        return pa.table(carried | columns)

    types = ", ".join(f"{k} {requests.schema[k].dataType.simpleString()}" for k in names)
    return (
        left.groupBy("_block", "_slice")
        .cogroup(right.groupBy("_block", "_slice"))
        .applyInArrow(group, f"{types}, {result}")
    )


# Cosines that differ by no more than this may be equal as distances.
_SLACK = 2 * 10.0**-config.DISTANCE_DECIMALS


def _units(vectors: pa.ChunkedArray) -> np.ndarray:
    """Vectors of length one; NaN where there is no direction."""
    rows = matrix(vectors.combine_chunks())
    with np.errstate(invalid="ignore", divide="ignore"):
        return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _tiles(part: pa.Table, asked: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(ids, cosines)`` of a group, some listings at a time.

    A vector without a direction has cosine NaN.
    """
    if not part.num_rows or not asked.num_rows:
        return
    units = _units(asked.column("query"))
    with np.errstate(invalid="ignore", divide="ignore"):
        for start in range(0, part.num_rows, config.DISTANCE_TILE):
            tile = part.slice(start, config.DISTANCE_TILE).combine_chunks()
            rows = matrix(tile.column("embedding").combine_chunks())
            cosines = rows @ units.T
            cosines /= np.linalg.norm(rows, axis=1, keepdims=True)
            yield tile.column("id").to_numpy(), cosines


def _far(cosines: np.ndarray) -> np.ndarray:
    """Distances; what has no direction is infinitely far from everything."""
    far = distances(cosines)
    far[np.isnan(far)] = np.inf
    return far


def _best(kept: list[tuple[np.ndarray, ...]], limit: int) -> tuple[np.ndarray, ...]:
    """The nearest ``limit`` of each request, ties by id."""
    request, distance, ids = (np.concatenate(c) for c in zip(*kept))
    order = np.lexsort((ids, distance, request))
    request, distance, ids = request[order], distance[order], ids[order]
    first = np.arange(len(request)) - np.searchsorted(request, request) < limit
    return request[first], distance[first], ids[first]


def _bounded(bound: np.ndarray, best: tuple[np.ndarray, ...], limit: int) -> np.ndarray:
    """The cosine below which nothing is among a request's nearest, from the nearest so far."""
    request, distance, _ = best
    last = np.searchsorted(request, np.arange(len(bound))) + limit - 1
    full = np.searchsorted(request, np.arange(len(bound)), side="right") > last
    bound[full] = np.fmax(bound[full], 1 - distance[last[full]] - _SLACK)
    return bound


def _told(best: tuple[np.ndarray, ...]) -> tuple[np.ndarray, dict[str, pa.Array]]:
    request, distance, ids = best
    distance = np.where(np.isinf(distance), np.nan, distance)
    return request, {"id": pa.array(ids, pa.int64()), "distance": pa.array(distance)}


_NONE = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))


def _nearest_in(limit: int) -> Callable[[pa.Table, pa.Table], tuple[np.ndarray, dict[str, pa.Array]]]:
    """The ``limit`` nearest listings of each request of a group, filters ignored."""

    def found(part: pa.Table, asked: pa.Table) -> tuple[np.ndarray, dict[str, pa.Array]]:
        # What is below a request's bound is not among its nearest.
        bound, kept = np.full(asked.num_rows, -np.inf), [_NONE]
        for tile, (ids, cosines) in enumerate(_tiles(part, asked), 1):
            if tile == 1 and len(ids) >= limit:
                away = np.where(np.isnan(cosines), np.inf, -cosines)
                bound = -np.partition(away, limit - 1, axis=0)[limit - 1] - _SLACK
            row, request = np.nonzero(~(cosines < bound))
            kept.append((request, _far(cosines[row, request]), ids[row]))
            if tile & (tile - 1) == 0:
                # After 1, 2, 4, ... tiles the bounds are taken from what was found.
                kept = [_best(kept, limit)]
                bound = _bounded(bound, kept[0], limit)
        return _told(_best(kept, limit))

    return found


# Pairs kept of a group before they are cut to the nearest of each request, and pairs whose
# distance is computed at once.
_KEPT = 1 << 20
_EXACT = 1 << 14


def nearest_matching(limit: int) -> Callable[[pa.Table, pa.Table], tuple[np.ndarray, dict[str, pa.Array]]]:
    """The ``limit`` nearest listings of each request of a group that match its filters.

    Requests with ``cells`` are compared with the listings of those. Matches come from bitmaps
    of the whole group. Single precision tells which pairs cannot be among the nearest; the
    others get their distance in double precision.
    """

    def found(part: pa.Table, asked: pa.Table) -> tuple[np.ndarray, dict[str, pa.Array]]:
        kept = [_NONE]
        if part.num_rows and asked.num_rows:
            part, place, visited = _visited(part, asked)
            ids, matches, units = part.column("id").to_numpy(), counting.packed_matcher(asked)(part), _units(asked.column("query"))
            single, rounding = units.astype(np.float32), (units.shape[1] + 4) * 2.0**-23
            # What is below a request's bound is not among its nearest.
            bound, pending = np.full(asked.num_rows, -np.inf), 0
            for tile, (start, stop) in enumerate(_runs(place, visited.mean() > 0.5), 1):
                inside = visited[:, place[start] : place[stop - 1] + 1]
                sel = np.flatnonzero(inside.any(axis=1))
                if not len(sel):
                    continue
                rows = _units(part.column("embedding").slice(start, stop - start))
                close = ~(single[sel] @ rows.astype(np.float32).T < (bound[sel, None] - rounding).astype(np.float32))
                bits = np.unpackbits(matches[sel, start // 8 : -(-stop // 8)], axis=1)
                close &= bits[:, start % 8 : start % 8 + stop - start].view(bool)
                if inside.shape[1] > 1:
                    close &= inside[sel][:, place[start:stop] - place[start]]
                request, row = np.divmod(np.flatnonzero(close), stop - start)
                request = sel[request]
                cosines = np.empty(len(row))
                for at in range(0, len(row), _EXACT):
                    these = slice(at, at + _EXACT)
                    cosines[these] = np.einsum("ij,ij->i", units[request[these]], rows[row[these]])
                kept.append((request, _far(cosines), ids[start:stop][row]))
                pending += len(row)
                if tile & (tile - 1) == 0 or pending > _KEPT:
                    kept, pending = [_best(kept, limit)], 0
                    bound = _bounded(bound, kept[0], limit)
        return _told(_best(kept, limit))

    return found


def _visited(part: pa.Table, asked: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """Listings in the order of their cells, the number of each one's cell, and which request visits which of these."""
    if "cells" not in asked.column_names:
        return part.combine_chunks(), np.zeros(part.num_rows, np.int64), np.ones((asked.num_rows, 1), bool)
    part = part.sort_by("cell").combine_chunks()
    names, place = np.unique(part.column("cell").to_numpy(), return_inverse=True)
    lists = asked.column("cells").combine_chunks()
    named, who = lists.flatten().to_numpy(), np.repeat(np.arange(asked.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
    at = np.minimum(np.searchsorted(names, named), len(names) - 1)
    here = names[at] == named
    visited = np.zeros((asked.num_rows, len(names)), bool)
    visited[who[here], at[here]] = True
    return part, place, visited


def _runs(place: np.ndarray, joined: bool) -> Iterator[tuple[int, int]]:
    """Start and end of tiles of rows sorted by ``place``: across cells if ``joined``, else within them."""
    start = 0
    for end in [len(place)] if joined else [*(np.flatnonzero(np.diff(place)) + 1), len(place)]:
        for at in range(start, end, config.DISTANCE_TILE):
            yield at, min(end, at + config.DISTANCE_TILE)
        start = end


def _no_later(part: pa.Table, asked: pa.Table) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """How many listings of a group rank no later than each request's mark."""
    cut, cut_id = (asked.column(c).to_numpy() for c in ("distance", "id"))
    count = np.zeros(asked.num_rows, np.int64)
    for ids, cosines in _tiles(part, asked):
        closer = cosines > 1 - cut + _SLACK
        count += closer.sum(axis=0)
        # Only those about as far as the mark are compared exactly.
        row, request = np.nonzero((cosines > 1 - cut - _SLACK) & ~closer)
        far = _far(cosines[row, request])
        before = (far < cut[request]) | ((far == cut[request]) & (ids[row] <= cut_id[request]))
        count += np.bincount(request[before], minlength=len(count))
    return np.arange(asked.num_rows), {"position": pa.array(count)}


def _every_vector(listings: DataFrame, blocks: int) -> DataFrame:
    """Every listing with a vector, for each block of requests."""
    found = _with_vector(listings)
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    return found.select(F.col("id").cast("long").alias("id"), "embedding", every.alias("_block"))


def _ranked_matches(
    listings: DataFrame, requests: DataFrame, limit: int, carry: Sequence[str] = ()
) -> DataFrame:
    """The nearest ``limit`` matching listings per ``(request_id, *carry)``, ranked.

    A listing with a vector goes to the blocks of requests that some filter of theirs leaves
    open to it, by the loosest filter of the block. Inside a group every filter is checked with
    bitmaps beside the distances, so that no pair of a request and a listing leaves it that
    is not among the request's nearest there.
    """
    keys = ["request_id", *carry]
    listings = _with_vector(listings).where(F.col("id").isNotNull())
    asked, blocks = _in_blocks(requests, keys)
    told = ("embedding", *counting.LISTING_COLUMNS)
    met = filters.match(listings.select("id", *told), filters.loosest(asked, "_block"), ("id", *told))
    vectors = met.select(F.col("id").cast("long").alias("id"), *told, F.col("request_id").alias("_block"))
    sides = filters._request_side(asked).select(*keys, "query", "_block", *counting.FILTER_COLUMNS)
    found = _block_product(
        vectors, sides, listings.count(), blocks, nearest_matching(limit), keys, "id long, distance double"
    )
    return best_per(found.withColumn("id", F.col("id").cast(listings.schema["id"].dataType)), keys, limit)


def batch_top_k(listings: DataFrame, requests: DataFrame, limit: int) -> DataFrame:
    """The exact ``limit`` nearest matching listings of every request."""
    check_arguments(limit=limit)
    return _ranked_matches(listings, requests, limit)


def branch_top_k(
    listings: DataFrame, requests: DataFrame, limit: int, cap: int = config.FANOUT_CAP
) -> DataFrame:
    """The nearest ``limit`` listings of every branch of every request."""
    check_arguments(limit=limit, cap=cap)
    return _ranked_matches(listings, branches(requests, cap), limit, ("branch",))


def merge_branches(per_branch: DataFrame, limit: int) -> DataFrame:
    """Specified behaviour: one list per request, nearest first, each listing once."""
    # Branches pin values a listing has one of, so a repeat carries the same distance.
    once = per_branch.groupBy("request_id", "id").agg(F.min("distance").alias("distance"))
    return best_per(once, ["request_id"], limit)


def nearest(listings: DataFrame, queries: DataFrame, pool: int) -> DataFrame:
    """``(request_id, id, distance, place)``: the ``pool`` nearest listings, filters ignored.

    Each group of requests and listings keeps the best ``pool`` rows per request, so only
    those are ranked across groups.
    """
    check_arguments(limit=pool)
    asked, blocks = _in_blocks(queries.select("request_id", "query"), ["request_id"])
    found = _block_product(
        _every_vector(listings, blocks),
        asked.drop("_number"),
        _with_vector(listings).count(),
        blocks,
        _nearest_in(pool),
        ["request_id"],
        "id long, distance double",
    )
    return best_per(found, ["request_id"], pool)


# --- Baselines (specified behaviour) -----------------------------------------


def post_filter_top_k(
    listings: DataFrame,
    requests: DataFrame,
    limit: int,
    pool: int = config.CANDIDATE_POOL,
    pools: DataFrame | None = None,
) -> DataFrame:
    """Nearest ``pool`` listings first, filters afterwards: few may survive.

    ``pools`` are the nearest listings of every request where they are known already, as
    from an index of cells.
    """
    near = (nearest(listings, requests, pool) if pools is None else pools).select("request_id", "id", "distance")
    # Only the pools are checked against the filters, not all listings.
    kept = filters.keep_matching(near, listings.drop("embedding"), requests.drop("query"))
    return best_per(kept, ["request_id"], limit)


def widening_top_k(
    listings: DataFrame, requests: DataFrame, limit: int, step: int = config.CANDIDATE_POOL
) -> DataFrame:
    """Widen the pool by ``step`` until ``limit`` listings match or all are ranked.

    The pool that is needed ends at the position of the last wanted match among all
    listings, so that position is counted instead of ranking everything.
    """
    matches = stable(batch_top_k(listings, requests, limit))
    last = matches.groupBy("request_id").agg(
        F.max(F.struct("place", "distance", "id")).alias("_last")
    )
    total = listings.where(F.col("embedding").isNotNull()).count()
    reached = requests.select("request_id", "query").join(
        last.where(F.col("_last.place") == limit), "request_id"
    )
    positions = closer_or_equal(listings, reached.select("request_id", "query", "_last.distance", "_last.id"))
    pools = requests.select("request_id").join(positions, "request_id", "left").select(
        "request_id",
        F.least(
            F.coalesce(F.ceil(F.col("position") / step) * step, F.lit(total)), F.lit(total)
        ).cast("long").alias("pool_used"),
    )
    return matches.join(pools, "request_id")


def closer_or_equal(listings: DataFrame, marks: DataFrame) -> DataFrame:
    """``(request_id, position)``: listings ranked no later than a request's mark."""
    asked, blocks = _in_blocks(marks, ["request_id"])
    found = _block_product(
        _every_vector(listings, blocks),
        asked.drop("_number"),
        _with_vector(listings).count(),
        blocks,
        _no_later,
        ["request_id"],
        "position long",
    )
    return found.groupBy("request_id").agg(F.sum("position").alias("position"))


# --- Look-ups (specified behaviour) ------------------------------------------


def get_listings(
    listings: DataFrame,
    ids: Sequence[int],
    neighbourhoods: DataFrame,
    room_types: DataFrame,
    property_types: DataFrame,
) -> DataFrame:
    """The stored fields of the cited listings, with dimension names for ids."""
    out = listings.where(F.col("id").isin(list(ids))).drop("embedding")
    return decode_dimensions(out, neighbourhoods, room_types, property_types)


def decode_dimensions(
    listings: DataFrame, neighbourhoods: DataFrame, room_types: DataFrame, property_types: DataFrame
) -> DataFrame:
    for table, name in (
        (neighbourhoods, "neighbourhood"),
        (room_types, "room_type"),
        (property_types, "property_type"),
    ):
        lookup = table.select(F.col("id").alias(f"{name}_id"), F.col("name").alias(name))
        listings = listings.join(lookup, f"{name}_id", "left")
    return listings


def get_reviews(reviews: DataFrame, ids: Sequence[int], limit: int) -> DataFrame:
    """The newest reviews of the cited listings, probable names removed."""
    check_arguments(limit=limit)
    cited = reviews.where(F.col("listing_id").isin(list(ids)))
    newest = newest_children(cited, limit, key="listing_id", date="date", position="id")
    return newest.withColumn("comments", without_names(F.col("comments")))


