"""Ranking against numpy on a table of 2,000 eight-dimensional vectors."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from roostline import config
from roostline.operators import evaluation, filters, search

SCHEMA = (
    "id int, source_listing_id long, name string, neighbourhood_id int, room_type_id smallint, property_type_id smallint, latitude double, "
    "longitude double, price_gbp float, accommodates smallint, bedrooms smallint, beds smallint, bathrooms float, "
    "minimum_nights int, rating float, location_score float, number_of_reviews int, instant_bookable boolean, "
    "host_is_superhost boolean, amenities array<string>, embedding array<float>"
)


def row(g):
    vector = [(math.sin(0.7 * g + d) + 1) / 2 for d in range(1, 9)] if g % 50 else None
    return (
        g, g, f"n{g}", g % 33 + 1, g % 3 + 1, 1, 51.0, 0.0, float(40 + g % 400), g % 6 + 1, None, None, None, 1,
        None if g % 7 == 0 else 3.0 + (g % 20) / 10, None, 0, None, None, ["wifi"] if g % 2 == 0 else [], vector,
    )


@pytest.fixture(scope="module")
def rows():
    return [row(g) for g in range(1, 2001)]


@pytest.fixture(scope="module")
def listings(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("vectors") / "v")
    spark.createDataFrame(rows, SCHEMA).repartition(4, "id").write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def requests(spark):
    wanted = {
        "a": ({"max_price": 200.0, "min_accommodates": 2, "amenities": ["wifi"]}, 1),
        "b": ({"neighbourhood_ids": [3, 4], "room_type_ids": [1, 2]}, 7),
        "c": ({"neighbourhood_ids": [1, 2, 3], "room_type_ids": [1, 2]}, 12),
        "d": ({}, 33),
        "e": ({"min_rating": 4.8, "max_price": 60.0}, 41),
        "f": ({"min_accommodates": 9}, 5),
    }
    sets = filters.canonical(filters.filter_sets(spark, {k: g for k, (g, _) in wanted.items()}))
    vectors = spark.createDataFrame([(k, row(g)[-1]) for k, (_, g) in wanted.items()], "request_id string, query array<float>")
    return sets.join(vectors, "request_id")


WANTED = {
    "a": lambda r: r[8] <= 200 and r[9] >= 2 and r[19] == ["wifi"],
    "b": lambda r: r[3] in (3, 4) and r[4] in (1, 2),
    "c": lambda r: r[3] in (1, 2, 3) and r[4] in (1, 2),
    "d": lambda r: True,
    "e": lambda r: r[14] is not None and np.float32(r[14]) >= 4.8 and r[8] <= 60,
    "f": lambda r: False,
}
QUERY = {"a": 1, "b": 7, "c": 12, "d": 33, "e": 41, "f": 5}


def exact(rows, name, k=None, keep=None):
    q = np.array(row(QUERY[name])[-1], dtype=np.float32).astype(float)
    out = []
    for r in rows:
        if r[-1] is not None and (keep or WANTED[name])(r):
            v = np.array(r[-1], dtype=np.float32).astype(float)
            out.append((round(1 - v @ q / np.linalg.norm(v) / np.linalg.norm(q), config.DISTANCE_DECIMALS) + 0.0, r[0]))
    return [i for _, i in sorted(out)[:k]]


def ids(df, name, *keys):
    picked = [r for r in df.collect() if r["request_id"] == name]
    return [r["id"] for r in sorted(picked, key=lambda r: (*[r[k] for k in keys], r["place"]))]


def test_single_search(listings, rows):
    given = {"max_price": 200.0, "min_accommodates": 2, "amenities": ["wifi"]}
    got = search.top_k(listings, given, row(1)[-1], 10)
    assert got.columns == [*search.RESULT_COLUMNS, "distance"]
    assert [r["id"] for r in got.collect()] == exact(rows, "a", 10)


def test_single_search_plan(listings):
    plan = search.top_k(listings, {"max_price": 200.0}, row(1)[-1], 10, ("id",))._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
    assert "LessThanOrEqual(price_gbp,200.0)" in plan and "IsNotNull(embedding)" in plan


def test_batch_search(listings, rows, requests):
    out = search.batch_top_k(listings, requests, 10)
    for name in WANTED:
        assert ids(out, name) == exact(rows, name, 10), name


def test_batch_search_with_too_many_requests_to_broadcast(monkeypatch, listings, rows, requests):
    monkeypatch.setattr(config, "BROADCAST_MAX_ROWS", 0)
    out = search.batch_top_k(listings, requests, 4)
    for name in WANTED:
        assert ids(out, name) == exact(rows, name, 4), name


def test_batch_plan_limits_before_the_exchange(listings, requests):
    plan = search.batch_top_k(listings, requests, 10)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert "BroadcastHashJoin" in plan and "NestedLoop" not in plan and "Cartesian" not in plan
    # No vector meets another outside the block product.
    assert "ArrowEvalPython" not in plan and plan.count("FlatMapCoGroupsInArrow") == 1


def test_plans_do_not_grow_with_the_requests(monkeypatch, listings, requests):
    size = lambda: len(search.nearest(listings, requests, 5)._jdf.queryExecution().executedPlan().toString().splitlines())
    few = size()
    monkeypatch.setattr(config, "QUERY_BLOCK", 1)
    assert size() == few


def test_batch_search_in_small_blocks_and_tiles(monkeypatch, listings, rows, requests):
    for name, value in (("QUERY_BLOCK", 2), ("LISTING_SLICE", 300), ("DISTANCE_TILE", 7)):
        monkeypatch.setattr(config, name, value)
    out = search.batch_top_k(listings, requests, 10)
    for name in WANTED:
        assert ids(out, name) == exact(rows, name, 10), name


def test_branches_and_merge(listings, rows, requests):
    per_branch = search.branch_top_k(listings, requests, 3).cache()
    seen = {}
    for r in per_branch.collect():
        seen.setdefault((r["request_id"], r["branch"]), []).append((r["place"], r["id"]))
    for room in (1, 2):
        for place in (3, 4):
            want = exact(rows, "b", 3, lambda r: r[3] == place and r[4] == room)
            assert [i for _, i in sorted(seen.get(("b", f"{place}/{room}/*"), []))] == want
    # Six branches are above the cap of four: one any-of query.
    assert [i for _, i in sorted(seen[("c", "*/*/*")])] == exact(rows, "c", 3)
    merged = search.merge_branches(per_branch, 3)
    assert ids(merged, "b") == exact(rows, "b", 3)


def test_plan_report(spark, requests):
    out = {r["request_id"]: r for r in search.plan_report(requests, indexed_amenities=["wifi"]).collect()}
    b, c, e = out["b"], out["c"], out["e"]
    assert (b["requested_branches"], b["capped"], b["queries"], b["post_filter_columns"]) == (4, False, 4, [])
    assert (c["requested_branches"], c["capped"], c["queries"]) == (6, True, 1)
    assert c["post_filter_columns"] == ["neighbourhood_id", "room_type_id"]
    assert e["null_excluding_columns"] == ["price_gbp", "rating"]
    assert out["a"]["post_filter_columns"] == [] and out["d"]["unconstrained"]
    plain = {r["request_id"]: r for r in search.plan_report(requests).collect()}
    assert plain["a"]["post_filter_columns"] == ["amenities"]


@pytest.mark.parametrize("block", [512, 2])
def test_nearest_in_blocks(monkeypatch, listings, rows, requests, block):
    monkeypatch.setattr(config, "QUERY_BLOCK", block)
    out = search.nearest(listings, requests, 25)
    for name in WANTED:
        assert ids(out, name) == exact(rows, name, 25, lambda r: True), name


def test_post_filter_finds_fewer(listings, rows, requests):
    out = search.post_filter_top_k(listings, requests, 10, 50)
    by_id = {r[0]: r for r in rows}
    for name in WANTED:
        pool = exact(rows, name, 50, lambda r: True)
        assert ids(out, name) == [i for i in pool if WANTED[name](by_id[i])][:10], name
    recall = {r["request_id"]: r for r in evaluation.recall_at_k(out, search.batch_top_k(listings, requests, 10)).collect()}
    assert recall["d"]["recall"] == 1.0 and recall["e"]["recall"] < 1.0 and "f" not in recall


def test_widening_reports_its_pool(listings, rows, requests):
    out = search.widening_top_k(listings, requests, 10, 100)
    pools = {r["request_id"]: r["pool_used"] for r in out.collect()}
    ranked = sum(r[-1] is not None for r in rows)
    for name in "abcde":
        assert ids(out, name) == exact(rows, name, 10), name
        everything = exact(rows, name, None, lambda r: True)
        found = exact(rows, name, 10)
        if len(found) < 10:
            assert pools[name] == ranked
        else:
            place = everything.index(found[-1]) + 1
            assert pools[name] == min(ranked, math.ceil(place / 100) * 100), name


def test_guards(listings):
    with pytest.raises(ValueError, match="limit"):
        search.top_k(listings, {}, [1.0] * 8, 0)
    with pytest.raises(ValueError, match="empty"):
        search.top_k(listings, {}, [], 5)
    with pytest.raises(ValueError, match="no columns"):
        search.top_k(listings, {}, [1.0] * 8, 5, ())
    with pytest.raises(ValueError, match="cap"):
        search.check_arguments(limit=1, cap=0)
    with pytest.raises(ValueError, match="width|values"):
        search.check_arguments(limit=1, query=[1.0], width=8)
    with pytest.raises(ValueError, match="exceeds the bound"):
        search.candidates(listings, {}, [1.0] * 8, 101)


def test_details_and_reviews(spark, listings):
    names = spark.createDataFrame([(n, f"n{n}") for n in range(1, 40)], "id int, name string")
    row_ = search.get_listings(listings, [5], names, names, names).first()
    assert (row_["neighbourhood"], row_["room_type"], row_["property_type"]) == ("n6", "n3", "n1")
    assert "embedding" not in row_.asDict()
    reviews = spark.createDataFrame(
        [(1, 5, "2024-01-01", "old"), (2, 5, "2024-02-01", "Thanks to Maria, it was fine"), (3, 6, "2024-03-01", "other")],
        "id long, listing_id int, date string, comments string",
    )
    assert [r["comments"] for r in search.get_reviews(reviews, [5], 1).collect()] == ["Thanks to [name], it was fine"]


def test_listings_without_a_vector_are_not_matched(monkeypatch, listings, requests):
    met = []
    match = search.filters.match
    monkeypatch.setattr(search.filters, "match", lambda rows, *more: met.append(rows.count()) or match(rows, *more))
    bare = listings.withColumn("id", F.col("id") + 10_000_000).withColumn("embedding", F.lit(None).cast(listings.schema["embedding"].dataType))
    want = sorted(search.batch_top_k(listings, requests, 5).collect())
    assert sorted(search.batch_top_k(listings.unionByName(bare), requests, 5).collect()) == want
    assert met[1] == met[0] < listings.unionByName(bare).count()


def test_no_pair_of_a_request_and_a_listing_is_shuffled(monkeypatch, listings, requests):
    met = []
    match = search.filters.match
    monkeypatch.setattr(search.filters, "match", lambda rows, sets, *more: met.append(match(rows, sets, *more)) or met[-1])
    plan = search.batch_top_k(listings, requests, 10)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan
    # All requests are one block: each listing with a vector meets it once.
    assert met[0].count() == listings.where("embedding IS NOT NULL").count()


def test_a_block_meets_only_what_some_filter_of_its_leaves_open(spark, listings, rows):
    vectors = spark.createDataFrame([("a", row(1)[-1]), ("b", row(7)[-1])], "request_id string, query array<float>")
    given = {
        "a": {"neighbourhood_ids": [3], "max_price": 90.0, "min_accommodates": 2},
        "b": {"neighbourhood_ids": [4, 3], "max_price": 200.0, "min_accommodates": 4, "min_rating": 4.0},
    }
    sets = filters.filter_sets(spark, given).join(vectors, "request_id").withColumn("block", F.lit(0))
    one = filters.loosest(sets, "block").first()
    assert (sorted(one["neighbourhood_ids"]), one["max_price"], one["min_accommodates"], one["min_rating"]) == ([3, 4], 200.0, 2, None)
    out = search.batch_top_k(listings, sets.drop("block"), 10)
    keep = {
        "a": lambda r: r[3] == 3 and r[8] <= 90 and r[9] >= 2,
        "b": lambda r: r[3] in (3, 4) and r[8] <= 200 and r[9] >= 4 and r[14] is not None and np.float32(r[14]) >= 4,
    }
    for name in keep:
        assert ids(out, name) == exact(rows, name, 10, keep[name]) != [], name
    too_many = sets.withColumn("neighbourhood_ids", F.sequence(F.lit(1), F.lit(filters._NAMED_VALUES + 1)))
    assert filters.loosest(too_many, "block").first()["neighbourhood_ids"] == []


def test_equal_and_missing_directions_keep_their_order(monkeypatch, spark, rows, tmp_path):
    """Many equal vectors and some of length zero: ties go by id, zeros come last."""
    schema, same = SCHEMA, row(1)[-1]
    flat = [(*r[:-1], same if r[0] % 3 else [0.0] * 8) for r in rows[:120]]
    path = str(tmp_path / "flat")
    spark.createDataFrame(flat, schema).write.parquet(path)
    sets = filters.filter_sets(spark, {"a": {}}).join(spark.createDataFrame([("a", same)], "request_id string, query array<float>"), "request_id")
    monkeypatch.setattr(config, "DISTANCE_TILE", 16)
    order = sorted(r[0] for r in flat if r[0] % 3) + sorted(r[0] for r in flat if not r[0] % 3)
    for limit in (10, 90):
        found = search.batch_top_k(spark.read.parquet(path), sets, limit)
        assert ids(found, "a") == order[:limit], limit
        assert ids(search.nearest(spark.read.parquet(path), sets, limit), "a") == order[:limit], limit
