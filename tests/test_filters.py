"""Predicates, batch matching and counting against a plain Python reading of the rules."""

import math
import random

import pytest
from pyspark.sql import functions as F

from roostline import config
from roostline.errors import InvalidFilterError, UnknownFieldError
from roostline.functions import geometry
from roostline.functions.geometry import box_around
from roostline.operators import counting, filters, pairs, relax

COLUMNS = (
    "id int, source_listing_id long, neighbourhood_id int, room_type_id smallint, property_type_id smallint, latitude double, "
    "longitude double, price_gbp float, accommodates smallint, bedrooms smallint, beds smallint, bathrooms float, "
    "minimum_nights int, rating float, location_score float, number_of_reviews int, instant_bookable boolean, "
    "host_is_superhost boolean, amenities array<string>"
)
NAMES = [part.strip().split()[0] for part in COLUMNS.split(", ")]


def make_listings(count=300, seed=3):
    rng = random.Random(seed)
    maybe = lambda v: None if rng.random() < 0.25 else v
    return [
        dict(zip(NAMES, (
            i, 1000 + i, rng.choice([1, 1, 1, 1, 2, 3, 4]), rng.randint(1, 3), rng.randint(1, 3), 51 + rng.random(), rng.random() - 0.5,
            maybe(float(rng.randint(4, 40) * 10)), rng.randint(1, 6), maybe(rng.randint(0, 3)), maybe(rng.randint(0, 4)),
            maybe(rng.randint(0, 6) / 2), rng.randint(1, 20), maybe(rng.randint(6, 10) / 2), maybe(rng.randint(6, 10) / 2),
            rng.randint(0, 50), maybe(rng.random() < 0.5), maybe(rng.random() < 0.5),
            rng.sample(["wifi", "pool", "desk", "crib"], rng.randint(0, 4)),
        )))
        for i in range(count)
    ]


def make_requests(count=40, seed=5):
    rng = random.Random(seed)
    some = {
        "neighbourhood_ids": lambda: rng.sample([1, 2, 3, 4, 9], rng.randint(1, 3)), "room_type_ids": lambda: rng.sample([1, 2, 3], 2),
        "property_type_ids": lambda: [2], "min_price": lambda: 60.0, "max_price": lambda: float(rng.choice([90, 150, 300])),
        "min_accommodates": lambda: rng.randint(1, 5), "min_bedrooms": lambda: rng.randint(0, 2), "min_beds": lambda: 0,
        "min_bathrooms": lambda: 0.5, "max_minimum_nights": lambda: 9, "min_rating": lambda: 3.5, "min_location_score": lambda: 4.0,
        "min_reviews": lambda: 10, "instant_bookable": lambda: False, "host_is_superhost": lambda: True,
        "amenities": lambda: rng.sample(["wifi", "pool", "desk"], rng.randint(1, 2)),
        "near": lambda: {"latitude": 51.5, "longitude": 0.0, "radius_km": float(rng.choice([10, 40]))},
    }
    out = {"everything": {}}
    for i, field in enumerate(some):
        out[f"only-{field}"] = {field: some[field]()}
    for i in range(count):
        out[f"r{i}"] = {f: make() for f, make in some.items() if rng.random() < 0.22}
    return out


def holds(row, field, value):
    if field in filters.ANY_OF:
        return row[filters.ANY_OF[field]] in value
    if field == "amenities":
        return set(value) <= set(row["amenities"])
    if field == "near":
        reach = value["radius_km"] / 111.0
        if not value["latitude"] - reach <= row["latitude"] <= value["latitude"] + reach:
            return False
        width = value["radius_km"] / (111.0 * math.cos(math.radians(abs(value["latitude"]) + reach)))
        return value["longitude"] - width <= row["longitude"] <= value["longitude"] + width
    column, compare = filters.BOUNDS[field]
    return row[column] is not None and compare(row[column], value)


def matching(rows, given):
    return {r["id"] for r in rows if all(holds(r, f, v) for f, v in given.items())}


@pytest.fixture(scope="module")
def rows():
    return make_listings()


@pytest.fixture(scope="module")
def listings(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("listings") / "l")
    spark.createDataFrame([tuple(r.values()) for r in rows], COLUMNS).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def requests():
    return make_requests()


@pytest.fixture(scope="module")
def sets(spark, requests):
    return filters.canonical(filters.filter_sets(spark, requests))


def test_every_field_is_mapped_once(spark):
    assert len(filters.FIELDS) == 17 and len(set(filters.FIELDS)) == 17
    assert {f.split()[0] for f in filters.FILTER_SETS.split(", ") if ":" not in f or "near" in f} >= set(filters.FIELDS)
    assert {f for f, _ in filters._pair_terms()} == set(filters.FIELDS)


def test_single_requests(listings, rows, requests):
    for name, given in list(requests.items())[:26]:
        got = {r["id"] for r in filters.where(listings, given).select("id").collect()}
        assert got == matching(rows, given), name


def test_zero_and_false_are_filters(listings, rows):
    for given in ({"min_bedrooms": 0}, {"instant_bookable": False}, {"min_price": 0.0}):
        count = filters.count_matches(listings, given).first()["matches"]
        assert count == len(matching(rows, given)) < len(rows)


def test_unknown_field_is_refused(listings):
    with pytest.raises(UnknownFieldError):
        filters.where(listings, {"colour": "red"})


def test_indexed_amenity_uses_its_column(listings):
    wide = listings.withColumn("has_wifi", F.array_contains("amenities", "wifi"))
    terms = filters.conditions({"amenities": ["wifi", "pool"]}, {"wifi": "has_wifi"})
    assert len(terms) == 2
    given = {"amenities": ["wifi", "pool"]}
    assert filters.where(wide, given, {"wifi": "has_wifi"}).count() == filters.where(listings, given).count()


@pytest.mark.parametrize("small", [True, False])
def test_batch_match_both_ways(monkeypatch, listings, rows, sets, requests, small):
    if not small:
        monkeypatch.setattr(config, "BROADCAST_MAX_ROWS", 0)
    got = {}
    for r in filters.match(listings, sets).collect():
        got.setdefault(r["request_id"], []).append(r["id"])
    for name, given in requests.items():
        assert sorted(got.get(name, [])) == sorted(matching(rows, given)), name


@pytest.mark.parametrize("small", [True, False])
def test_counts(monkeypatch, listings, rows, sets, requests, small):
    if not small:
        monkeypatch.setattr(config, "BROADCAST_MAX_ROWS", 0)
    got = {r["request_id"]: r["matches"] for r in counting.count_per_request(listings, sets).collect()}
    assert got == {name: len(matching(rows, given)) for name, given in requests.items()}


def test_a_shared_filter_is_matched_once(spark, listings):
    sets = filters.filter_sets(spark, {"a": {"room_type_ids": [2, 1]}, "b": {"room_type_ids": [1, 2, 2]}, "c": {}})
    different, _ = filters._once(sets)
    assert different.count() == 2
    got = {r["request_id"]: r["matches"] for r in counting.count_per_request(listings, sets).collect()}
    assert got["a"] == got["b"] == filters.where(listings, {"room_type_ids": [1, 2]}).count() and got["c"] == listings.count()


def test_requests_meet_only_the_values_they_pin(spark):
    sets = filters.filter_sets(spark, {"a": {"neighbourhood_ids": [4, 9], "room_type_ids": [1]}, "b": {"room_type_ids": [2]}, "c": {}})
    keys = {(r["request_id"], r["_shape"], r["_key"]) for r in filters._keyed(sets).collect()}
    assert keys == {("a", 1, 4), ("a", 1, 9), ("b", 3, 2), ("c", 0, 0)}


def test_boxes_and_amenities_are_joined_on(spark, listings, rows):
    near = {"latitude": 51.5, "longitude": 0.0, "radius_km": 2.0}
    wanted = {"a": {"amenities": ["wifi", "crib", "pool"]}, "b": {"near": near, "amenities": ["wifi"]}, "c": {"room_type_ids": [1], "amenities": ["nowhere", "wifi"]}}
    sets = filters.canonical(filters.filter_sets(spark, wanted))
    counts = {r["amenity"]: r["n"] for r in filters.amenity_counts(listings, sets).collect()}
    assert counts == {a: sum(a in r["amenities"] for r in rows) for a in ("wifi", "crib", "pool")}
    rarest = {tuple(r["amenities"]): r["_rarest"] for r in filters._rarest(sets, filters.amenity_counts(listings, sets)).collect()}
    assert rarest == {("crib", "pool", "wifi"): min(counts, key=lambda a: (counts[a], a)), ("wifi",): "wifi", ("nowhere", "wifi"): "nowhere"}
    shapes = {r["request_id"]: r["_shape"] for r in filters._keyed(sets).collect()}
    assert shapes == {"a": 5, "b": 4, "c": 5}
    got = {}
    for r in filters.match(listings, sets).collect():
        got.setdefault(r["request_id"], []).append(r["id"])
    assert {n: sorted(got.get(n, [])) for n in wanted} == {n: sorted(matching(rows, g)) for n, g in wanted.items()}


def test_open_requests_alone_meet_every_listing(spark, listings):
    pinned = filters.filter_sets(spark, {"a": {"amenities": ["wifi"]}, "b": {"near": {"latitude": 51.5, "longitude": 0.0, "radius_km": 9.0}}, "c": {"property_type_ids": [1]}})
    assert filters._keyed(pinned).where("_shape = 0").isEmpty()
    plan = filters.match(listings, pinned)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_counts_make_no_pairs(listings, sets):
    for counted in (counting.count_per_request(listings, sets), counting.leave_one_out(listings, sets)):
        plan = counted._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "NestedLoop" not in plan and "Generate" not in plan


def test_filters_are_counted_in_blocks(monkeypatch, listings, rows, sets, requests):
    monkeypatch.setattr(counting, "BLOCK_FILTERS", 7)
    got = {r["request_id"]: r["matches"] for r in counting.count_per_request(listings, sets).collect()}
    assert got == {name: len(matching(rows, given)) for name, given in requests.items()}


PLACES = [(lat, lon) for lat in (-90.0, -89.99, -45.0, 0.0, 51.5, 89.2, 90.0) for lon in (-180.0, -179.9, -90.0, 0.0, 0.05, 179.95, 180.0)]


@pytest.mark.parametrize("near", [(51.5, 0.0, 4.0), (51.5, 0.0, 200.0), (89.0, 30.0, 150.0), (-89.5, 0.0, 80.0), (0.0, 179.9, 60.0), (-45.0, -179.99, 5.0), (0.0, 0.0, 0.001), (90.0, 0.0, 1.0), (51.5, -90.0, 199.0)])
def test_a_box_touches_the_cells_of_all_its_places(spark, near):
    sets = filters.filter_sets(spark, {"a": {"near": dict(zip(("latitude", "longitude", "radius_km"), near))}})
    keyed = filters._keyed(sets).collect()
    assert 1 <= len(keyed) <= 18 and len({r["_level"] for r in keyed}) == 1 and len({r["_key"] for r in keyed}) == len(keyed)
    side, level = keyed[0], keyed[0]["_level"]
    rng = random.Random(3)
    around = [(near[0] + rng.uniform(-2, 2), near[1] + rng.uniform(-4, 4)) for _ in range(200)]
    points = spark.createDataFrame([*PLACES, *around, (side["_south"], near[1]), (side["_north"], near[1])], "latitude double, longitude double")
    cell = geometry.grid_cell(F.col("latitude"), F.col("longitude"), F.lit(level))
    inside = points.where(F.col("latitude").between(side["_south"], side["_north"]) & F.col("longitude").between(side["_west"], side["_east"]))
    found = {r["cell"] for r in inside.select(cell.alias("cell")).collect()}
    assert found and found <= {r["_key"] for r in keyed}


def test_an_open_request_meets_listings_without_a_neighbourhood(spark, listings):
    lost = listings.withColumn("neighbourhood_id", F.lit(None).cast("int"))
    sets = filters.filter_sets(spark, {"a": {}, "b": {"neighbourhood_ids": [1]}})
    got = {r["request_id"]: r["matches"] for r in counting.count_per_request(lost, sets).collect()}
    assert got == {"a": listings.count(), "b": 0}


def test_leave_one_out(listings, rows, sets, requests):
    got = {(r["request_id"], r["field"]): r["rows"] for r in counting.leave_one_out(listings, sets).collect()}
    for name, given in requests.items():
        for field in given:
            others = {k: v for k, v in given.items() if k != field}
            want = len(matching(rows, others)) - len(matching(rows, given))
            assert got.get((name, field), 0) == want, (name, field)


def test_null_report(spark, listings, rows):
    sets = filters.canonical(filters.filter_sets(spark, {"a": {"min_price": 1.0, "max_price": 2.0, "min_reviews": 1}, "b": {"min_rating": 0.0}, "c": {}}))
    got = {(r["request_id"], r["column"]): r["rows_lost"] for r in filters.null_report(sets, listings).collect()}
    missing = lambda c: sum(r[c] is None for r in rows)
    assert got == {("a", "price_gbp"): missing("price_gbp"), ("b", "rating"): missing("rating")}


@pytest.mark.parametrize(
    "given, want",
    [
        ({}, []), ({"min_price": 0.0, "min_rating": 5.0}, []), ({"min_price": -1.0}, ["min_price"]),
        ({"min_accommodates": 0}, ["min_accommodates"]), ({"max_minimum_nights": 0}, ["max_minimum_nights"]),
        ({"min_rating": 5.1}, ["min_rating"]), ({"min_location_score": float("nan")}, ["min_location_score"]),
        ({"room_type_ids": [1, 0]}, ["room_type_ids"]), ({"amenities": ["a", " "]}, ["amenities"]),
        ({"min_price": 9.0, "max_price": 8.0}, ["price_range"]), ({"min_price": -9.0, "max_price": -10.0}, ["min_price", "max_price"]),
        ({"near": {"latitude": 91.0, "longitude": 0.0, "radius_km": 1.0}}, ["near"]),
        ({"near": {"latitude": 9.0, "longitude": 0.0, "radius_km": 0.0}}, ["near"]),
        ({"near": {"latitude": 9.0, "longitude": 0.0, "radius_km": 200.0}}, []),
        ({"near": {"latitude": 9.0, "longitude": 0.0, "radius_km": 200.5}}, ["near"]),
    ],
)
def test_validation(spark, given, want):
    assert filters.validate(filters.filter_sets(spark, {"r": given})).first()["problems"] == want
    # One request is held to the same rules.
    if want:
        with pytest.raises(InvalidFilterError, match=", ".join(want)):
            filters.checked(given)
    else:
        assert filters.checked(given) == given


def test_a_single_request_is_made_canonical(listings):
    assert filters.checked({"room_type_ids": [2, 1, 2], "amenities": [" wifi ", "wifi"], "min_beds": None, "neighbourhood_ids": []}) == {
        "room_type_ids": [1, 2], "amenities": ["wifi"],
    }
    assert filters.where(listings, {"amenities": [" wifi "]}).count() == filters.where(listings, {"amenities": ["wifi"]}).count() > 0
    with pytest.raises(InvalidFilterError, match="price_range"):
        filters.where(listings, {"min_price": 300, "max_price": 100})


def test_canonical_sets_compare_equal(spark):
    sets = {
        "a": {"room_type_ids": [2, 1, 2], "amenities": ["pool", " wifi"]},
        "b": {"room_type_ids": [1, 2], "amenities": ["wifi", "pool", "wifi"]},
        "c": {"room_type_ids": [1, 2], "amenities": ["wifi", "pool"], "min_beds": 0},
        "d": {},
    }
    out = {r["request_id"]: r for r in filters.canonical(filters.filter_sets(spark, sets)).withColumn("empty", filters.is_empty()).collect()}
    assert out["a"]["filter_key"] == out["b"]["filter_key"] != out["c"]["filter_key"]
    assert out["a"]["amenities"] == ["pool", "wifi"]
    assert [out[k]["empty"] for k in "abcd"] == [False, False, False, True]


def test_statistics(listings, rows):
    row = filters.field_stats(listings, "price_gbp", {"min_accommodates": 3}).first()
    prices = sorted(r["price_gbp"] for r in rows if r["accommodates"] >= 3 and r["price_gbp"] is not None)
    middle = (prices[(len(prices) - 1) // 2] + prices[len(prices) // 2]) / 2
    assert (row["min"], row["max"], row["median"], row["non_null"]) == (prices[0], prices[-1], middle, len(prices))
    with pytest.raises(UnknownFieldError):
        filters.field_stats(listings, "name; drop table", {})


def haversine(a, b, c, d):
    p, q = math.radians(a), math.radians(c)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(d - b) / 2) ** 2
    # The radius that makes a degree of latitude 111 km.
    return 2 * (111.0 * 180 / math.pi) * math.asin(math.sqrt(h))


@pytest.mark.parametrize("latitude", [0.0, 25.0, 51.5, 60.0, -33.9, 88.0])
@pytest.mark.parametrize("radius", [0.5, 10.0, 50.0])
def test_box_holds_the_circle(spark, latitude, radius):
    box = box_around(F.lit(latitude), F.lit(10.0), F.lit(radius))
    south, north, west, east = spark.range(1).select(*[c.alias(n) for n, c in box._asdict().items()]).first()
    for step in range(360):
        angle = math.radians(step)
        lat = latitude + math.cos(angle) * radius / 111.0 * 0.9999
        for lon in (10.0 + k / 400 * 6 * (radius / 50 + 0.1) * (1 if angle < math.pi else -1) for k in range(40)):
            if abs(lat) <= 90 and haversine(latitude, 10.0, lat, lon) <= radius:
                assert south <= lat <= north and (west is None or west <= lon <= east)


@pytest.mark.parametrize("near", [(89.9, 0.0, 50.0), (-89.9, 0.0, 50.0), (51.0, 179.9, 20.0), (51.0, -179.9, 20.0), (90.0, 0.0, 1.0)])
def test_box_without_longitude_bounds(spark, near):
    box = box_around(*(F.lit(v) for v in near))
    row = spark.range(1).select(box.south.alias("s"), box.north.alias("n"), box.west.alias("w"), box.east.alias("e")).first()
    assert row["w"] is None and row["e"] is None and -90 <= row["s"] < row["n"] <= 90


def test_filters_reach_the_scan(listings):
    plan = filters.where(listings, {"max_price": 90.0, "neighbourhood_ids": [1, 2], "min_accommodates": 2}).select("id")._jdf.queryExecution().toString()
    pushed = next(line for line in plan.splitlines() if "PushedFilters" in line)
    assert "In(neighbourhood_id" in pushed and "accommodates" in pushed and "price_gbp" in pushed
    assert "description" not in pushed.split("ReadSchema")[-1] and "amenities" not in pushed.split("ReadSchema")[-1]


def test_relaxation(spark, listings, rows):
    wanted = {
        "fine": {"min_accommodates": 1},
        "dear": {"min_accommodates": 4, "max_price": 45.0, "room_type_ids": [1, 2, 3]},
        "never": {"min_accommodates": 7},
    }
    original = filters.filter_sets(spark, wanted)
    out = {r["request_id"]: r for r in relax.relax(listings, original).collect()}
    assert out["fine"]["rounds_used"] == 0 and out["never"]["rounds_used"] == 0
    assert out["never"]["min_accommodates"] == 7 and out["dear"]["min_accommodates"] == 4
    assert 1 <= out["dear"]["rounds_used"] <= config.MAX_RELAXATIONS
    assert out["dear"]["max_price"] > 45.0 and out["dear"]["matches"] >= filters.where(listings, wanted["dear"]).count()
    still = {r["request_id"]: r["rounds_used"] for r in relax.relax(listings, original, rounds=0).collect()}
    assert set(still.values()) == {0}


def test_loosening_clears_instead_of_zeroing(spark):
    given = {"a": {"min_beds": 1, "min_reviews": 20, "max_minimum_nights": 3, "near": {"latitude": 1.0, "longitude": 1.0, "radius_km": 190.0}}}
    sets = filters.canonical(filters.filter_sets(spark, given))
    loosen = lambda f: relax.loosen(sets, spark.createDataFrame([("a", f)], "request_id string, field string")).first()
    assert loosen("min_beds")["min_beds"] is None
    assert loosen("min_reviews")["min_reviews"] == 17
    assert loosen("max_minimum_nights")["max_minimum_nights"] == 4
    assert loosen("near")["near"] is None


def pairs_of(frame):
    return sorted(tuple(str(v) for v in row) for row in frame.collect())


def test_many_filter_sets_are_matched_without_a_join(monkeypatch, spark, listings, rows):
    monkeypatch.setattr(counting, "BLOCK_FILTERS", 50)
    monkeypatch.setattr(pairs, "CHUNK_FILTERS", 7)
    monkeypatch.setattr(pairs, "PAIRS_AT_ONCE", 500)
    given = make_requests(100, seed=8)
    sets = filters.canonical(filters.filter_sets(spark, given)).withColumn("more", F.length("request_id"))
    found = filters.match(listings, sets)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan and "Cartesian" not in plan
    want = [(name, row) for name, asked in given.items() for row in rows if row["id"] in matching(rows, asked)]
    assert pairs_of(found) == sorted((name, str(row["id"])) for name, row in want)
    for columns, joined in ((("id", "price_gbp"), False), (("id", "price_gbp", "amenities"), True)):
        more = filters.match(listings, sets, columns, ("more",))
        assert ("Join" in more._jdf.queryExecution().executedPlan().toString()) == joined
        assert more.columns == ["request_id", "more", *columns]
        assert pairs_of(more) == sorted((name, str(len(name)), *(str(row[c]) for c in columns)) for name, row in want)


def test_bitmaps_and_join_agree_on_odd_rows(monkeypatch, spark):
    nan, inf = math.nan, math.inf
    rng = random.Random(4)
    number = lambda *more: rng.choice([None, nan, inf, -inf, 0.0, -0.0, 2.5, 4.0, *more])
    whole = lambda: rng.choice([None, 0, 1, 2, 3])
    names = lambda: rng.choice([None, [], [None], ["a"], ["a", "a", None], ["b", "a"], ["b", ""]])
    ids = lambda: rng.choice([None, [], [0], [1, 1, None], [None], [2, 3]])
    flag = lambda: rng.choice([None, True, False])
    odd = [
        (rng.choice([None, i, i // 2]), i, whole(), whole(), whole(), number(51.0, 90.0, 95.0), number(-181.0, 0.5), number(), whole(), whole(), whole(),
         number(), whole(), number(), number(), whole(), flag(), flag(), names())
        for i in range(120)
    ]
    seldom = lambda make: make() if rng.random() < 0.2 else None
    near = lambda: (rng.choice([None, 51.0, 89.9]), rng.choice([None, 0.0]), rng.choice([None, 10.0, 190.0]))
    asked = [
        (rng.choice([None, "x", f"r{i}"]), *(seldom(ids) for _ in filters.ANY_OF), seldom(number), seldom(number), seldom(whole), seldom(whole), seldom(whole),
         seldom(number), seldom(whole), seldom(number), seldom(number), seldom(whole), seldom(flag), seldom(flag), seldom(names), seldom(near))
        for i in range(200)
    ]
    listings = spark.createDataFrame(odd, COLUMNS)
    sets = spark.createDataFrame(asked, filters.FILTER_SETS)
    for some in (sets, filters.canonical(sets)):
        found = {}
        for most in (64, 1000):
            monkeypatch.setattr(filters, "JOINED_SETS", most)
            found[most] = pairs_of(filters.match(listings, some, ("id", "source_listing_id")))
        assert len(found[64]) > 1000 and found[64] == found[1000]
