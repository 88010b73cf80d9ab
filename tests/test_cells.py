"""The cell index: clustered vectors, cells ruled out by filters, exact way for few matches."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_filters import COLUMNS, make_listings, make_requests, matching

from roostline.operators import cells, counting, evaluation, filters, search

WIDTH, GROUPS = 16, 25


def clustered(count=3000):
    rng, noise = random.Random(11), np.random.default_rng(5)
    around = noise.normal(size=(GROUPS, WIDTH))
    out = []
    for i, r in enumerate(make_listings(count)):
        group = rng.randrange(GROUPS)
        vector = (around[group] + 0.15 * noise.normal(size=WIDTH)).tolist()
        r = {**r, "neighbourhood_id": group + 1, "price_gbp": float(50 * (group % 5) + rng.randint(0, 20))}
        out.append({**r, "embedding": None if i % 40 == 0 else [0.0] * WIDTH if i % 40 == 1 else vector})
    return out


@pytest.fixture(scope="module")
def rows():
    return clustered()


@pytest.fixture(scope="module")
def listings(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("clustered") / "l")
    spark.createDataFrame([tuple(r.values()) for r in rows], COLUMNS + ", embedding array<float>").write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def index(listings):
    return cells.build(listings, 5)


@pytest.fixture(scope="module")
def wanted():
    return {**make_requests(20), "none": {"min_price": 10_000.0}, "few": {"neighbourhood_ids": [3], "min_reviews": 48}, "west": {"near": {"latitude": 51.5, "longitude": -0.4, "radius_km": 6.0}}}


@pytest.fixture(scope="module")
def requests(spark, rows, wanted):
    vectors = [(name, rows[37 * i % 3000 + 2]["embedding"] or [1.0] * WIDTH) for i, name in enumerate(wanted)]
    sets = filters.canonical(filters.filter_sets(spark, wanted))
    return sets.join(spark.createDataFrame(vectors, "request_id string, query array<float>"), "request_id").checkpoint()


def test_every_vector_with_a_direction_is_in_one_cell(index, rows):
    stored = {r["id"]: r["cell"] for r in index.rows.select("id", "cell").collect()}
    assert set(stored) == {r["id"] for r in rows if r["embedding"] and any(r["embedding"])} and len(stored) == index.vectors
    assert sum(c["rows"] for c in index.cells) == index.vectors and index.centres.shape == (len(index.cells), WIDTH)
    assert [s for _, s in index.visits] == sorted(s for _, s in index.visits)


def test_no_cell_with_a_match_is_ruled_out(spark, index, rows, requests, wanted):
    asked = filters._request_side(requests).withColumn("share", F.lit(1.0))
    asked = asked.select("request_id", "query", "share", *filters.ANY_OF, *filters.BOUNDS, "amenities", "_south", "_north", "_west", "_east")
    visits = {r["request_id"]: r for r in asked.mapInArrow(cells._visits(index), cells.VISITS).collect()}
    cell = {r["id"]: r["cell"] for r in index.rows.select("id", "cell").collect()}
    for name, given in wanted.items():
        needed = {cell[i] for i in matching(rows, given) if i in cell}
        assert needed <= set(visits[name]["cells"]), name
        assert visits[name]["visited_rows"] == visits[name]["possible_rows"]
    # Groups of one neighbourhood or price lie in few cells; the others are skipped.
    assert visits["few"]["possible_rows"] < index.vectors / 5 and visits["none"]["possible_cells"] == 0


def test_near_listings_are_found_in_few_cells(index, listings, rows, requests, wanted):
    got = cells.top_k(index, requests, 5)
    exact = search.batch_top_k(listings, requests, 5)
    for r in got.collect():
        assert r["id"] in matching(rows, wanted[r["request_id"]])
    count = lambda df: {r["request_id"]: r["count"] for r in df.groupBy("request_id").count().collect()}
    assert count(got) == count(exact) and "none" not in count(got)
    assert evaluation.mean_metric(evaluation.recall_at_k(got, exact, 5), "recall").first()["mean_recall"] >= 0.95
    told = {(r["request_id"], r["id"]): r["distance"] for r in exact.collect()}
    assert all(told.get((r["request_id"], r["id"]), r["distance"]) == r["distance"] for r in got.where("NOT isnan(distance)").collect())
    plan = {r["request_id"]: r for r in cells.plan(index, requests, 5).collect()}
    assert plan["everything"]["visited_rows"] < index.vectors / 4


def test_exact_pools_skip_far_cells(index, listings, requests):
    asked = requests.where("exists(query, x -> x <> 0)")
    assert asked.count() < requests.count()
    got = cells.nearest(index, requests, 12)
    plain = search.nearest(listings, asked, 12)
    show = lambda df: sorted((r["request_id"], r["place"], r["id"], r["distance"]) for r in df.collect())
    assert show(got) == show(plain)
    told = cells.skipped(index, asked, 12).agg(F.sum("compared").alias("c"), F.sum("skipped").alias("s"), F.min("compared").alias("least")).first()
    assert told["c"] + told["s"] == index.vectors * asked.count() and told["least"] >= 12
    assert told["s"] > 0.5 * (told["c"] + told["s"])
    with pytest.raises(ValueError, match="more than"):
        cells.nearest(index, asked, index.vectors + 1)


def test_small_and_empty_tables(spark, listings, requests):
    one = listings.where("id = 2")
    assert {r["id"] for r in cells.top_k(cells.build(one), requests, 3).collect()} == {2}
    assert cells.top_k(cells.build(listings.limit(0)), requests, 3).isEmpty()
    with pytest.raises(ValueError, match="limit"):
        cells.top_k(cells.build(one), requests, 0)


def test_pools_of_parts_and_pieces_are_exact(monkeypatch, index, listings, requests):
    show = lambda df: sorted((r["request_id"], r["place"], r["id"], r["distance"]) for r in df.collect())
    want = show(search.nearest(listings, requests.where("exists(query, x -> x <> 0)"), 20))
    monkeypatch.setattr(cells.config, "QUERY_BLOCK", 2)
    # Cells in several parts, and the larger ones in pieces.
    monkeypatch.setattr(cells.config, "LISTING_SLICE", 20)
    monkeypatch.setattr(cells.config, "DISTANCE_TILE", 7)
    assert show(cells.nearest(index, requests, 20)) == want


def test_nothing_beyond_a_known_bound_leaves_a_group():
    part = pa.table({"id": pa.array(range(40), pa.int64()), "embedding": [[1.0, i / 10] for i in range(40)], "cell": pa.array([0] * 20 + [1] * 20, pa.int32())})
    asked = pa.table({"request_id": ["a", "b"], "query": [[1.0, 0.0]] * 2, "bound": pa.array([0.005, None], pa.float64()), "cells": pa.array([[0, 1], [1]], pa.list_(pa.int32()))})
    got = cells._nearest_by_cell(5)(part, asked).to_pydict()
    assert [i for r, i in zip(got["request_id"], got["id"]) if r == "a"] == [0, 1]
    assert [i for r, i in zip(got["request_id"], got["id"]) if r == "b"] == [20, 21, 22, 23, 24]


def test_visited_cells_in_parts_and_pieces(monkeypatch, index, requests):
    show = lambda df: sorted((r["request_id"], r["place"], r["id"], r["distance"]) for r in df.where("NOT isnan(distance)").collect())
    want = show(cells.top_k(index, requests, 5))
    for name, value in (("QUERY_BLOCK", 2), ("LISTING_SLICE", 20), ("DISTANCE_TILE", 7)):
        monkeypatch.setattr(cells.config, name, value)
    assert show(cells.top_k(index, requests, 5)) == want


def test_who_visited_all_that_can_match_is_not_searched_again(monkeypatch, index, listings, requests):
    few = requests.where("request_id IN ('few', 'none')")
    want = sorted((r["request_id"], r["id"], r["distance"]) for r in search.batch_top_k(listings, few, 50).where("NOT isnan(distance)").collect())
    assert 0 < len(want) < 50
    monkeypatch.setattr(cells, "_wanted_share", lambda index, requests, limit: requests.select("request_id", F.lit(1.0).alias("share"), F.lit(1.0).alias("matches")))
    monkeypatch.setattr(search, "batch_top_k", lambda *a: pytest.fail("searched again"))
    got = cells.top_k(index, few, 50)
    assert sorted((r["request_id"], r["id"], r["distance"]) for r in got.collect()) == want


def test_no_row_for_a_pair_leaves_a_group(index, requests):
    visits = cells.plan(index, requests, 5).select("request_id", "cells")
    plan = cells._visited_top_k(index, requests, visits, 5)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "collect_list" not in plan


def test_cells_of_odd_values_are_not_ruled_out(spark):
    sides = [(i, 1.0 if i < 20 else -1.0, float("nan") if i < 20 else 10.0, None if i < 20 else 3) for i in range(40)]
    held = {r["id"]: r for r in make_listings(40)}
    rows = [tuple({**r, "price_gbp": p, "neighbourhood_id": n}.values()) + ([x, 0.01 * i],) for (i, x, p, n), r in zip(sides, held.values())]
    index = cells.build(spark.createDataFrame(rows, COLUMNS + ", embedding array<float>"), 5, cells=2)
    wanted = {"price": {"min_price": 100.0}, "place": {"neighbourhood_ids": [0]}}
    sets = filters.canonical(filters.filter_sets(spark, wanted)).withColumn("query", F.array(F.lit(1.0), F.lit(0.0)).cast("array<float>"))
    exact = search.batch_top_k(index.rows.drop("cell"), sets, 30)
    assert exact.groupBy("request_id").count().where("count = 20").count() == 2
    show = lambda df: sorted((r["request_id"], r["place"], r["id"]) for r in df.collect())
    assert show(cells.top_k(index, sets, 30)) == show(exact)


def test_single_precision_loses_no_neighbour():
    rng = np.random.default_rng(3)
    near = np.array([1.0, 0.0]) + 1e-4 * rng.normal(size=(3000, 2))
    part = pa.table({"id": pa.array(range(3000), pa.int64()), "embedding": near.tolist(), "cell": pa.array(np.arange(3000) % 7, pa.int32())})
    names = {c: pa.nulls(3000, pa.list_(pa.string()) if c == "amenities" else pa.float64()) for c in counting.LISTING_COLUMNS}
    none = {c: pa.nulls(2, pa.list_(pa.string())) for c in counting.FILTER_COLUMNS if not c.startswith("_")}
    edges = {c: pa.array([0.0, 0.0]) for c in counting.FILTER_COLUMNS if c.startswith("_")}
    asked = pa.table({"request_id": ["a", "b"], "query": [[1.0, 0.0], [1.0, 1e-4]], **none, **edges})
    part = pa.table({**{c: part.column(c) for c in part.column_names}, **names})
    request, told = search.nearest_matching(40)(part, asked)
    for i, query in enumerate(((1.0, 0.0), (1.0, 1e-4))):
        far = np.round(1 - near @ query / np.linalg.norm(near, axis=1) / np.linalg.norm(query), 9) + 0.0
        want = sorted(zip(far.tolist(), range(3000)))[:40]
        assert [j for r, j in zip(request, told["id"].to_pylist()) if r == i] == [j for _, j in want]


def test_filters_that_rule_out_no_cell_visit_more(spark, index):
    # A fifth of every cell matches, so the nearest five matches are among the nearest 25.
    wanted = {"all": {}, "fifth": {"min_reviews": 40}}
    near = index.rows.first()["embedding"]
    sets = filters.canonical(filters.filter_sets(spark, wanted)).withColumn("query", F.array(*map(F.lit, near)).cast("array<float>"))
    plan = {r["request_id"]: r for r in cells.plan(index, sets, 5).collect()}
    matches = index.rows.where("number_of_reviews >= 40").count()
    assert plan["fifth"]["possible_rows"] == index.vectors > 3 * matches > 0
    asked = cells.visit_share(index, 5 / matches) * index.vectors
    assert plan["fifth"]["visited_rows"] >= asked - 1e-6 and plan["all"]["visited_rows"] <= plan["fifth"]["visited_rows"]
