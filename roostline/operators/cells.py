"""Filter-first approximate search: vectors in stored cells that know what their listings can match.

``build`` clusters the vectors with a distributed k-means and stores the listings by cell.
Beside each cell stand the least and greatest value of every filter column, the ids of its
dimensions and which common amenities occur in it. A table of requests first drops the
cells no listing of which can match, then visits the nearest of the others, and filters
and compares only the listings in those. How many listings have to be visited is measured
when the index is built, by how many a request wants of how many match in the cells left;
few matches mean that all cells left are visited, which is exact. A request that still finds fewer than it
wants is searched exactly. Specified behaviour: what is found satisfies every condition
and carries its true distance; only the membership of the top is approximate.

The same cells give exact pools without filters (``nearest``): no vector of a cell is closer
in angle than the cell's centre is, less the widest angle within the cell. A request
compares itself with its nearest cells, which bounds its pool, and then with those cells
that could still reach into it.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roostline import config
from roostline.functions.vectors import distances, matrix
from roostline.operators import counting, filters, search
from roostline.session import scratch_path, stable

# Sent to every task with each search: at most so many cells, ids of a dimension, amenities.
CELLS_MAX = 4096
IDS_MAX = 512
AMENITIES_MAX = config.INDEXED_AMENITY_BUDGET
# Vectors a cell that the clustering looks at; every vector is stored whatever the number.
FIT_PER_CELL = 256
ROUNDS = 10
# The visits are measured with so many of the vectors as queries, for one to SPAN times the
# wanted number of neighbours, so that TARGET of them are found.
TRIALS = 128
SPAN = 64
TARGET = 0.985
# Listings on which the selectivity of a request is estimated, and the fewest matches there
# that are taken as an estimate.
SAMPLE = 20_000
SAMPLE_LEAST = 20
SEED = 7


class Index(NamedTuple):
    rows: DataFrame  # listings with a vector that has a direction, by ``cell``
    vectors: int
    centres: np.ndarray
    cells: list  # one row a cell, in order
    amenities: tuple[str, ...]
    visits: tuple[tuple[float, float], ...]  # share of the listings wanted, share to visit


def _unit(rows: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore"):
        return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _placed(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """``rows`` with the ``cell`` of the nearest centre and the cosine to it."""

    @F.arrow_udf(T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("_cosine", T.DoubleType())]))
    def place(vectors: pa.Array) -> pa.Array:
        cosines = _unit(matrix(vectors)) @ centres.T
        cell = np.argmax(cosines, axis=1)
        return pa.StructArray.from_arrays([pa.array(cell.astype(np.int32)), pa.array(cosines[np.arange(len(cell)), cell])], ["cell", "_cosine"])

    return rows.withColumn("_place", place("embedding")).select(*rows.columns, "_place.*")


def _centres(rows: DataFrame, cells: int, total: int) -> np.ndarray:
    """Unit centres of at most ``cells`` clusters, fitted on about FIT_PER_CELL vectors each."""
    some = rows if total <= cells * FIT_PER_CELL else rows.where(F.pmod(F.xxhash64("id"), F.lit(total)) < cells * FIT_PER_CELL)
    # Each round reads them, so all cores take part however few files they come from.
    some = some.select("embedding").repartition(rows.sparkSession.sparkContext.defaultParallelism)
    points = stable(some.select(array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features")))
    model = KMeans(k=cells, seed=SEED, maxIter=ROUNDS, distanceMeasure="cosine").fit(points)
    return _unit(np.array(model.clusterCenters()))


def _summaries(rows: DataFrame, amenities: tuple[str, ...]) -> list:
    """What the listings of each cell can match; one row a cell comes to the driver."""
    sides = filters._listing_side(rows)
    ends = []
    for column in {c: None for c, _ in filters.BOUNDS.values()}:
        value = F.col(column).cast("int" if column in ("instant_bookable", "host_is_superhost") else "double").cast("double")
        ends += [F.min(value).alias(f"low_{column}"), F.max(value).alias(f"high_{column}")]
    places = [f(f"_{c}").alias(f"{n}_{c}") for c in ("latitude", "longitude") for n, f in (("low", F.min), ("high", F.max))]
    # More ids than IDS_MAX say nothing: such a cell is not ruled out by that dimension.
    sets = [F.collect_set(f"_{c}").alias(c) for c in filters.ANY_OF.values()]
    known = [F.max(F.array_contains("amenities", a)).alias(f"amenity_{i}") for i, a in enumerate(amenities)]
    out = sides.groupBy("cell").agg(F.count("*").alias("rows"), F.min("_cosine").alias("widest"), *ends, *places, *sets, *known)
    short = {c: F.when(F.size(c) <= IDS_MAX, F.col(c)) for c in filters.ANY_OF.values()}
    return out.withColumns(short).orderBy("cell").collect()


def _common_amenities(rows: DataFrame) -> tuple[str, ...]:
    counted = rows.select(F.explode("amenities").alias("name")).groupBy("name").count()
    return tuple(r["name"] for r in counted.orderBy(F.desc("count"), "name").limit(AMENITIES_MAX).collect() if r["name"] is not None)


def build(listings: DataFrame, limit: int = 10, cells: int | None = None) -> Index:
    """Cells of all vectors of ``listings``, stored in the shared folder."""
    spark = listings.sparkSession
    norm = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    rows = listings.where(F.col("embedding").isNotNull() & (norm > 0) & (norm < float("inf")))
    total = rows.count()
    if not total:
        return Index(rows.withColumn("cell", F.lit(0)), 0, np.zeros((0, 0)), [], (), ())
    wanted = cells or round(total**0.5)
    if min(wanted, total) > 1:
        centres = _centres(rows, min(wanted, total, CELLS_MAX), total)
    else:
        centres = _unit(np.array([rows.select("embedding").first()[0]], np.float64))
    placed = _placed(rows, centres)
    path = scratch_path(spark, "cells")
    # A range split keeps a cell in few files and cuts one that many vectors fall into.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed.repartitionByRange(tasks, "cell", "id").write.partitionBy("cell").parquet(path)
    rows = spark.read.parquet(path)
    amenities = _common_amenities(rows)
    summaries = _summaries(rows, amenities)
    index = Index(rows.drop("_cosine"), total, centres[[r["cell"] for r in summaries]], summaries, amenities, ())
    return index._replace(visits=_measured(index, limit))


def _measured(index: Index, limit: int) -> tuple[tuple[float, float], ...]:
    """For growing shares of the listings: the share to visit, nearest cells first, to find TARGET of them."""
    queries = index.rows.where(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(index.vectors)) < TRIALS)
    asked = stable(queries.select(F.col("id").cast("string").alias("request_id"), F.col("embedding").alias("query")))
    # A few hundred queries' neighbours with their cells: bounded by TRIALS, limit and SPAN.
    found = search.nearest(index.rows, asked, min(limit * SPAN, index.vectors)).join(index.rows.select("id", "cell"), "id")
    rows = found.select("request_id", "place", "cell").toPandas()
    vectors = {r["request_id"]: r["query"] for r in asked.collect()}
    if rows.empty:
        return ()
    sizes = np.array([r["rows"] for r in index.cells])
    number = {r["cell"]: i for i, r in enumerate(index.cells)}
    shares = []
    for name, group in rows.groupby("request_id"):
        order = np.argsort(-(index.centres @ _unit(np.array([vectors[name]], np.float64))[0]), kind="stable")
        visited = np.empty(len(sizes))
        visited[order] = np.cumsum(sizes[order]) / sizes.sum()
        shares.append((group["place"].to_numpy(), visited[[number[c] for c in group["cell"]]]))
    place, share = (np.concatenate(x) for x in zip(*shares))
    out, top = [], limit
    while top <= limit * SPAN:
        out.append((min(1.0, top / index.vectors), float(np.quantile(share[place <= top], TARGET))))
        top *= 2
    return tuple(out)


def visit_share(index: Index, wanted: float) -> float:
    """The share of the listings to visit for the nearest ``wanted`` share of them."""
    for upto, share in index.visits:
        if wanted <= upto:
            return share
    return 1.0


# --- Which cells a request visits ---------------------------------------------------


def _possible(index: Index, part: pa.RecordBatch) -> np.ndarray:
    """Requests by cells: whether some listing of the cell may match, as far as its summary tells."""
    # NaN is the greatest number of a column, and stands for an end that no listing of the cell has.
    end = lambda value: np.nan if value is None else np.inf if value != value else value
    ends = {c: np.array([end(r[c]) for r in index.cells], float) for c in index.cells[0].__fields__ if c.startswith(("low_", "high_"))}
    column = lambda name: part.column(part.schema.get_field_index(name))
    ok = np.ones((part.num_rows, len(index.cells)), bool)
    for field, (name, compare) in filters.BOUNDS.items():
        asked = column(field).cast(pa.float64()).to_numpy(zero_copy_only=False)[:, None]
        high, low = compare(ends[f"high_{name}"], asked), compare(ends[f"low_{name}"], asked)
        if compare is operator.eq:
            high = low = (ends[f"low_{name}"] <= asked) & (asked <= ends[f"high_{name}"])
        ok &= np.isnan(asked) | (high if compare is operator.ge else low)
    for axis, low, high in (("latitude", "_south", "_north"), ("longitude", "_west", "_east")):
        ok &= (ends[f"high_{axis}"] >= column(low).to_numpy()[:, None]) & (ends[f"low_{axis}"] <= column(high).to_numpy()[:, None])
    for field, name in filters.ANY_OF.items():
        place = {value: k for k, value in enumerate(dict.fromkeys(v for r in index.cells for v in r[name] or ()))}
        holds = np.zeros((len(place) + 1, len(index.cells)), bool)  # the last row: an id that no cell is known for
        for k, r in enumerate(index.cells):
            holds[[place[v] for v in r[name] or ()], k] = True
        holds[:, [r[name] is None for r in index.cells]] = True
        for i, ids in enumerate(column(field).to_pylist()):
            if ids:
                ok[i] &= holds[[place.get(v, -1) for v in ids]].any(axis=0)
    has = {a: np.array([bool(r[f"amenity_{k}"]) for r in index.cells]) for k, a in enumerate(index.amenities)}
    for i, names in enumerate(column("amenities").to_pylist()):
        for name in names or ():
            if name in has:
                ok[i] &= has[name]
    return ok


def _visits(index: Index, limit: int = 10):
    """The function of an Arrow pass: the cells each request visits, nearest first.

    Without a ``share`` it follows from the ``matches`` of the request: of the listings in
    the cells its filters leave, as many of the nearest as hold ``limit`` matches on average.
    """
    centres, sizes = index.centres, np.array([r["rows"] for r in index.cells])
    numbers = np.array([r["cell"] for r in index.cells])
    small, everything = index._replace(rows=None), index.vectors

    def run(parts: Iterator[pa.RecordBatch]):
        for part in parts:
            ok = _possible(small, part)
            near = np.nan_to_num(_unit(matrix(part.column("query"))) @ centres.T, nan=-2.0)
            share = part.column("share").cast(pa.float64()).to_numpy(zero_copy_only=False)
            matches = part.column("matches").to_numpy(zero_copy_only=False) if "matches" in part.schema.names else None
            chosen, left = [], []
            for i in range(part.num_rows):
                order = np.argsort(-near[i], kind="stable")
                order = order[ok[i][order]]
                run_ = np.cumsum(sizes[order])
                total = int(run_[-1]) if len(order) else 0
                visited = visit_share(small, limit * total / matches[i] / everything) if share[i] != share[i] else share[i]
                stop = int(np.searchsorted(run_, visited * everything - 1e-9)) + 1
                chosen.append(numbers[order[:stop]].astype(np.int32))
                left.append((len(order), total, int(run_[min(stop, len(order)) - 1]) if len(order) else 0))
            ends = np.cumsum([0, *map(len, chosen)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*chosen, np.zeros(0, np.int32)])))
            columns = [part.column("request_id"), lists, *(pa.array([x[j] for x in left], pa.int64()) for j in range(3))]
            yield pa.RecordBatch.from_arrays(columns, names=["request_id", "cells", "possible_cells", "possible_rows", "visited_rows"])

    return run


VISITS = "request_id string, cells array<int>, possible_cells long, possible_rows long, visited_rows long"


def _wanted_share(index: Index, requests: DataFrame, limit: int) -> DataFrame:
    """``(request_id, share, matches)``: listings a request visits, as a part of all of them.

    The number of matches is estimated on a sample of the listings; where too few match
    there, everything possible is visited. The other shares are NULL: they depend on the cells
    a request's filters leave.
    """
    sample = index.rows.drop("embedding", "cell")
    if index.vectors > SAMPLE:
        sample = sample.where(F.pmod(F.xxhash64("id", F.lit(2)), F.lit(index.vectors)) < SAMPLE)
    # A few rows for a task for each core: every task tells a number for each filter.
    sample = stable(sample.repartition(sample.sparkSession.sparkContext.defaultParallelism))
    drawn = max(1, sample.count())
    counted = counting.count_per_request(sample, requests.drop("query"), spread_out=True)
    least = SAMPLE_LEAST if drawn < index.vectors else 0
    enough = F.col("matches") > least
    return counted.select("request_id", F.when(~enough, F.lit(1.0)).alias("share"), (F.col("matches") * (index.vectors / drawn)).alias("matches"))


def plan(index: Index, requests: DataFrame, limit: int) -> DataFrame:
    """``(request_id, cells, possible_cells, possible_rows, visited_rows)`` of every request."""
    shares = _wanted_share(index, requests, limit)
    asked = filters._request_side(requests).join(shares, "request_id")
    edges = ["_south", "_north", "_west", "_east"]
    asked = asked.select("request_id", "query", "share", "matches", *filters.ANY_OF, *filters.BOUNDS, "amenities", *edges)
    return asked.mapInArrow(_visits(index, limit), VISITS)


# --- Search -------------------------------------------------------------------------


def top_k(index: Index, requests: DataFrame, limit: int) -> DataFrame:
    """``(request_id, id, distance, place)``: near matching listings of every request.

    ``requests`` are filter sets with a ``query`` vector. Who would get fewer than ``limit``
    from the visited cells is compared with every match instead.
    """
    search.check_arguments(limit=limit)
    requests = stable(filters.canonical(requests))
    if not index.vectors:
        return search.batch_top_k(index.rows.drop("cell"), requests, limit)
    visits = stable(plan(index, requests, limit).select("request_id", "cells", (F.col("visited_rows") < F.col("possible_rows")).alias("cut")))
    found = stable(_visited_top_k(index, requests, visits.drop("cut"), limit))
    full = found.where(F.col("place") == limit).select("request_id")
    # Who visited every cell that may hold a match has them all.
    again = visits.where("cut").select("request_id").distinct().join(full, "request_id", "left_anti")
    if again.isEmpty():
        return found
    rest = requests.join(again, "request_id", "left_semi")
    return found.join(again, "request_id", "left_anti").unionByName(search.batch_top_k(index.rows.drop("cell"), rest, limit))


def _visited_top_k(index: Index, requests: DataFrame, visits: DataFrame, limit: int) -> DataFrame:
    """The nearest ``limit`` matching listings in the cells that each request visits.

    Runs of cells meet blocks of requests, as for exact pools. Filters are checked with
    bitmaps inside a group, so that no pair of a request and a listing leaves it that is not
    among the request's nearest there.
    """
    spark = requests.sparkSession
    asked, blocks = search._in_blocks(requests.join(visits, "request_id"), ["request_id"])
    # A few groups for each core, each as large as its bounds allow.
    share = -(-index.vectors * blocks // (8 * spark.sparkContext.defaultParallelism))
    part_of, pieces, parts = _parts(index, min(config.LISTING_SLICE, max(config.DISTANCE_TILE, share)))
    part = lambda cell: F.get(part_of, cell)
    named = stable(asked.select("_block", F.explode("cells").alias("_cell")).distinct())
    met = [r["_cell"] for r in named.select("_cell").distinct().collect()]
    # Cells that no request visits are not read, and a listing is sent to the blocks that visit its cell.
    rows = index.rows.where(F.col("id").isNotNull())
    rows = rows if len(met) == len(index.cells) else rows.where(F.col("cell").isin(met))
    named = F.broadcast(named) if blocks * len(met) <= config.BROADCAST_MAX_ROWS else named
    vectors = (
        rows.select(F.col("id").cast("long").alias("id"), "embedding", "cell", *counting.LISTING_COLUMNS)
        .join(named, F.col("cell") == F.col("_cell"))
        .withColumn("_part", part(F.col("cell")))
        .withColumn("_piece", F.pmod(F.xxhash64("id"), F.get(pieces, F.col("_part"))).cast("int"))
    )
    sides = (
        filters._request_side(asked)
        .withColumn("_part", F.explode(F.array_distinct(F.transform("cells", part))))
        .withColumn("cells", F.filter("cells", lambda c: part(c) == F.col("_part")))
        .withColumn("_piece", F.explode(F.sequence(F.lit(0), F.get(pieces, F.col("_part")) - 1)))
    )
    placed = (F.col("_part") + F.col("_piece") * parts).alias("_slice")
    left = vectors.select("id", "embedding", "cell", *counting.LISTING_COLUMNS, "_block", placed)
    right = sides.select("request_id", "query", "cells", "_block", *counting.FILTER_COLUMNS, placed)
    # Both sides may stem from the same rows; new columns tell them apart.
    left, right = left.toDF(*left.columns), right.toDF(*right.columns)
    kind = requests.schema["request_id"].dataType.simpleString()
    grouped = left.groupBy("_block", "_slice").cogroup(right.groupBy("_block", "_slice"))
    nearest_in = search.nearest_matching(limit)

    def group(part: pa.Table, asked: pa.Table) -> pa.Table:
        request, columns = nearest_in(part, asked)
        return pa.table({"request_id": asked.column("request_id").combine_chunks().take(pa.array(request))} | columns)

    found = grouped.applyInArrow(group, f"request_id {kind}, id long, distance double")
    return search.best_per(found.withColumn("id", F.col("id").cast(index.rows.schema["id"].dataType)), ["request_id"], limit)


# --- Exact pools --------------------------------------------------------------------

# Radians by which a bound is widened, as cosines near one carry few digits of the angle.
SLACK = 1e-6


def _reaching(index: Index, pool: int):
    """The function of an Arrow pass: the cells a request has to be compared with.

    Without a ``bound`` those are its nearest that hold ``pool`` vectors, with one all that
    may hold a vector no farther than that.
    """
    centres, sizes = index.centres, np.array([r["rows"] for r in index.cells])
    numbers = np.array([r["cell"] for r in index.cells], np.int32)
    widest = np.arccos(np.clip([r["widest"] for r in index.cells], -1.0, 1.0))

    def run(parts: Iterator[pa.RecordBatch]):
        for part in parts:
            angle = np.arccos(np.clip(_unit(matrix(part.column("query"))) @ centres.T, -1.0, 1.0))
            chosen = []
            for row, bound in zip(angle, part.column("bound").to_pylist()):
                if bound is None:
                    order = np.argsort(row, kind="stable")
                    chosen.append(numbers[order[: int(np.searchsorted(np.cumsum(sizes[order]), pool)) + 1]].tolist())
                else:
                    chosen.append(numbers[row - widest <= np.arccos(np.clip(1.0 - bound, -1.0, 1.0)) + SLACK].tolist())
            columns = [part.column("request_id"), part.column("query"), part.column("bound"), pa.array(chosen, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["request_id", "query", "bound", "cells"])

    return run


def _asked_cells(index: Index, asked: DataFrame, pool: int) -> DataFrame:
    """``(request_id, query, bound, cells)`` of ``asked`` (request_id, query, bound)."""
    types = f"request_id {asked.schema['request_id'].dataType.simpleString()}, query {asked.schema['query'].dataType.simpleString()}, bound double, cells array<int>"
    return asked.select("request_id", "query", "bound").mapInArrow(_reaching(index, pool), types)


def _parts(index: Index, most: int) -> tuple[Column, Column, int]:
    """The part of a ``cell`` and the pieces of a ``_part``, and how many parts there are.

    A part is a run of cells with ``most`` vectors; a cell that has more is a part of its own, in
    pieces.
    """
    part_of, pieces, held = [0] * (max(r["cell"] for r in index.cells) + 1), [], 0
    for r in index.cells:
        if not pieces or held + r["rows"] > most:
            pieces.append(1)
            held = 0
        held += r["rows"]
        part_of[r["cell"]] = len(pieces) - 1
        pieces[-1] = -(-held // most)
    listed = lambda numbers: F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<int>")
    return listed(part_of), listed(pieces), len(pieces)


def _nearest_by_cell(pool: int):
    """The nearest ``pool`` vectors of each request of a group, in the cells it names.

    Requests are compared cell by cell with those that name the cell, and nothing farther than
    a request's ``bound`` is kept.
    """

    def group(part: pa.Table, asked: pa.Table) -> pa.Table:
        kept = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))]
        if part.num_rows and asked.num_rows:
            units = _unit(matrix(asked.column("query").combine_chunks()))
            bound = asked.column("bound").to_numpy().astype(float)
            # The same distance may be rounded otherwise in a product of another shape.
            bound = np.where(np.isnan(bound), np.inf, bound + 2 * 10.0**-config.DISTANCE_DECIMALS)
            lists = asked.column("cells").combine_chunks()
            names = lists.flatten().to_numpy()
            by_cell = np.argsort(names, kind="stable")
            names, askers = names[by_cell], np.repeat(np.arange(asked.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))[by_cell]
            part = part.sort_by("cell").combine_chunks()
            cells, ids = part.column("cell").to_numpy(), part.column("id").to_numpy()
            for start in _starts(cells):
                stop = min(np.searchsorted(cells, cells[start], "right"), start + config.DISTANCE_TILE)
                sel = askers[np.searchsorted(names, cells[start]) : np.searchsorted(names, cells[start], "right")]
                if not len(sel):
                    continue
                rows = matrix(part.column("embedding").slice(start, stop - start).combine_chunks())
                far = distances(_unit(rows) @ units[sel].T)
                far[np.isnan(far)] = np.inf
                if len(far) >= pool:
                    bound[sel] = np.minimum(bound[sel], np.partition(far, pool - 1, axis=0)[pool - 1])
                row, request = np.nonzero(far <= bound[sel])
                kept.append((sel[request], far[row, request], ids[start:stop][row]))
        request, distance, ids = (np.concatenate(c) for c in zip(*kept))
        order = np.lexsort((ids, distance, request))
        request, distance, ids = request[order], distance[order], ids[order]
        first = np.arange(len(request)) - np.searchsorted(request, request) < pool
        distance = np.where(np.isinf(distance), np.nan, distance)
        named = asked.column("request_id").combine_chunks().take(pa.array(request[first]))
        return pa.table({"request_id": named, "id": pa.array(ids[first], pa.int64()), "distance": pa.array(distance[first])})

    return group


def _starts(cells: np.ndarray) -> Iterator[int]:
    """Where each tile of each run of equal ``cells`` begins."""
    for first in np.unique(cells, return_index=True)[1]:
        yield from range(int(first), int(np.searchsorted(cells, cells[first], "right")), config.DISTANCE_TILE)


def _pools(index: Index, asked: DataFrame, pool: int) -> DataFrame:
    """The nearest ``pool`` vectors of the ``cells`` of each request, none beyond its ``bound``.

    Runs of cells meet blocks of requests. A request is sent once to each run it names a cell
    of, and to every piece of a cell that is cut.
    """
    part_of, pieces, parts = _parts(index, config.LISTING_SLICE)
    blocks = max(1, -(-asked.count() // config.QUERY_BLOCK))
    part = lambda cell: F.get(part_of, cell)
    sides = (
        asked.withColumn("_block", F.pmod(F.xxhash64("request_id"), F.lit(blocks)).cast("int"))
        .withColumn("_part", F.explode(F.array_distinct(F.transform("cells", part))))
        .withColumn("cells", F.filter("cells", lambda c: part(c) == F.col("_part")))
        .withColumn("_piece", F.explode(F.sequence(F.lit(0), F.get(pieces, F.col("_part")) - 1)))
    )
    vectors = (
        index.rows.select(F.col("id").cast("long").alias("id"), "embedding", "cell")
        .withColumn("_part", part(F.col("cell")))
        .withColumn("_piece", F.pmod(F.xxhash64("id"), F.get(pieces, F.col("_part"))).cast("int"))
        .withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    )
    placed = (F.col("_part") + F.col("_piece") * parts).alias("_slice")
    left = vectors.select("id", "embedding", "cell", "_block", placed)
    right = sides.select("request_id", "query", "bound", "cells", "_block", placed)
    # Both sides may stem from the same rows; new columns tell them apart.
    left, right = left.toDF(*left.columns), right.toDF(*right.columns)
    kind = asked.schema["request_id"].dataType.simpleString()
    met = left.groupBy("_block", "_slice").cogroup(right.groupBy("_block", "_slice"))
    found = met.applyInArrow(_nearest_by_cell(pool), f"request_id {kind}, id long, distance double")
    return search.best_per(found, ["request_id"], pool)


def nearest(index: Index, queries: DataFrame, pool: int) -> DataFrame:
    """``(request_id, id, distance, place)``: the exact ``pool`` nearest vectors, filters ignored.

    What ``search.nearest`` returns for queries with a direction, a query without one has no
    rows; cells that cannot reach into a request's pool are not compared with it.
    """
    search.check_arguments(limit=pool)
    if pool > index.vectors:
        raise ValueError(f"a pool of {pool} is more than the {index.vectors} vectors of the index")
    visits, _ = _exact_visits(index, queries, pool)
    return _pools(index, visits, pool)


def _exact_visits(index: Index, queries: DataFrame, pool: int) -> tuple[DataFrame, DataFrame]:
    """The cells of each request for the first comparison and for the exact one."""
    asked = stable(queries.select("request_id", "query"))
    first = stable(_asked_cells(index, asked.withColumn("bound", F.lit(None).cast("double")), pool))
    bounds = _pools(index, first, pool).groupBy("request_id").agg(F.max("distance").alias("bound"))
    exact = stable(_asked_cells(index, asked.join(bounds, "request_id"), pool))
    return exact, first


def skipped(index: Index, queries: DataFrame, pool: int) -> DataFrame:
    """``(request_id, compared, skipped)``: vectors the exact pool of a request looks at, and leaves out."""
    exact, _ = _exact_visits(index, queries, pool)
    sizes = F.create_map(*[x for r in index.cells for x in (F.lit(r["cell"]), F.lit(r["rows"]))])
    compared = F.aggregate("cells", F.lit(0).cast("long"), lambda s, c: s + F.element_at(sizes, c))
    return exact.select("request_id", compared.alias("compared"), (F.lit(index.vectors) - compared).alias("skipped"))
