"""Recorded bodies to filter sets."""

import json

import pytest
from pyspark.sql import functions as F

from roostline.errors import GroundingError
from roostline.operators import evaluation, grounding, vocabulary

VOCABULARY = [
    ("neighbourhoods", "Canalside", 1), ("neighbourhoods", "Hilltop", 2), ("neighbourhoods", "Old Quay", 3),
    ("room_types", "Entire place", 1), ("room_types", "Private room", 2),
    ("property_types", "Whole flat", 1), ("property_types", "Boat", 2),
    ("amenities", "Wifi", 1), ("amenities", "Garden", 2),
]


def body(**fields):
    return json.dumps({"semantic_query": "a quiet flat", "unsupported_constraints": [], **fields})


def asks(*names):
    return [{"constraint": n, "reason": "cannot"} for n in names]


@pytest.fixture(scope="module")
def names(spark):
    return spark.createDataFrame(VOCABULARY, "field string, name string, id int")


@pytest.fixture(scope="module")
def run(spark, names):
    def go(rows):
        full = [(r + ("end_turn",))[:4] for r in rows]
        df = spark.createDataFrame(full, "request_id string, attempt int, body string, stop_reason string")
        return grounding.ground(df, names).cache()

    return go


CASES = {
    "blank": ("  ", "blank", None),
    "prose": ("Sure! Here you go", "not_json", None),
    "cut": ('{"semantic_query": "x', "not_json", None),
    "list": ("[1]", "not_object", None),
    "number": ("3", "not_object", None),
    "good": (body(), "valid", []),
    "null is absent": (body(min_price=None, instant_bookable=None), "valid", []),
    "lax": (body(min_price="200", min_beds=2.0, host_is_superhost="true", min_reviews="3"), "valid", []),
    "extra": (body(colour="red", zeal=1), "invalid", ["colour", "zeal"]),
    "no query": (json.dumps({"unsupported_constraints": []}), "invalid", ["semantic_query"]),
    "no asks": (json.dumps({"semantic_query": "x"}), "invalid", ["unsupported_constraints"]),
    "blank query": (body(semantic_query="  "), "invalid", ["semantic_query"]),
    "query type": (body(semantic_query=3), "invalid", ["semantic_query"]),
    "types": (body(neighbourhoods="Hilltop", min_beds=1.5, max_price="dear", instant_bookable=7), "invalid", ["neighbourhoods", "max_price", "min_beds", "instant_bookable"]),
    "list of numbers": (body(amenities=["Wifi", 1]), "invalid", ["amenities"]),
    "null list": (body(room_types=None), "invalid", ["room_types"]),
    "ask shape": (body(unsupported_constraints=[{"constraint": "x"}]), "invalid", ["unsupported_constraints"]),
    "ask extra": (body(unsupported_constraints=[{"constraint": "x", "reason": "y", "z": "w"}]), "invalid", ["unsupported_constraints"]),
    "bound": (body(min_rating=6), "invalid", ["min_rating"]),
    "window": (body(min_price=9, max_price=8), "invalid", ["price_range"]),
}


def test_outcomes(run):
    out = {r["request_id"]: r for r in run([(k, 1, text) for k, (text, _, _) in CASES.items()]).collect()}
    for name, (_, outcome, problems) in CASES.items():
        assert (out[name]["outcome"], out[name]["problems"]) == (outcome, problems), name
    lax = out["lax"]
    assert (lax["min_price"], lax["min_beds"], lax["host_is_superhost"], lax["min_reviews"]) == (200.0, 2, True, 3)


def test_stop_reasons(run):
    rows = [("a", 1, body(), "refusal"), ("b", 1, body()[:9], "max_tokens"), ("c", 1, None, "end_turn"), ("d", 1, None, "error")]
    out = {r["request_id"]: r["outcome"] for r in run(rows).collect()}
    assert out == {"a": "refused", "b": "truncated", "c": "empty", "d": "transport"}


def test_names_resolve_exactly(run):
    text = body(neighbourhoods=["Old Quay", "Canalside", "hilltop", "Atlantis", "Atlantis"], room_types=["Private room"], property_types=["Other"], amenities=["Garden", "Pool"])
    r = run([("a", 1, text)]).first()
    assert (r["neighbourhood_ids"], r["room_type_ids"], r["property_type_ids"], r["amenities"]) == ([1, 3], [2], [], ["Garden"])
    assert [tuple(u) for u in r["ungrounded"]] == [
        ("neighbourhoods", "hilltop"), ("neighbourhoods", "Atlantis"), ("property_types", "Other"), ("amenities", "Pool")
    ]
    assert [u["constraint"] for u in r["unsupported"]] == ["hilltop", "Atlantis", "Other", "Pool"]


@pytest.mark.parametrize(
    "name, reported, added",
    [
        ("Atlantis", ["somewhere in ATLANTIS please"], []),
        ("AC", ["a parking space"], ["AC"]),
        ("AC", ["with a.c. or AC"], []),
        ("TV (cable)", ["needs tv (cable)"], []),
        ("TV (cable)", ["needs tv"], ["TV (cable)"]),
        ("C++ desk", ["a c++ desk!"], []),
        ("\\Eodd.*", ["anything"], ["\\Eodd.*"]),
        ("Café", ["a CAFÉ nearby"], []),
        ("Pool", ["Poolé"], ["Pool"]),
    ],
)
def test_whole_word_rule(run, name, reported, added):
    r = run([("a", 1, body(amenities=[name], unsupported_constraints=asks(*reported)))]).first()
    assert [u["constraint"] for u in r["unsupported"]] == reported + added


def test_attempts(spark, run):
    rows = [
        ("first", 1, body(max_price=90)), ("second", 1, "nope"), ("second", 2, body(max_price=80)),
        ("both", 1, body(max_price=70)), ("both", 2, body(max_price=60)), ("never", 1, ""), ("never", 2, "nope"),
        ("late", 1, "x"), ("late", 2, "x"), ("late", 3, body()), ("refused", 1, None, "refusal"),
    ]
    out = run(rows)
    got = {r["request_id"]: (r["status"], r["accepted_attempt"], r["last_outcome"]) for r in grounding.settle(out).collect()}
    assert got == {
        "first": ("parsed", 1, "valid"), "second": ("parsed", 2, "valid"), "both": ("parsed", 1, "valid"),
        "never": ("failed", None, "not_json"), "late": ("failed", None, "not_json"), "refused": ("failed", None, "refused"),
    }
    sets = {r["request_id"]: r["max_price"] for r in grounding.filter_sets(out).collect()}
    assert sets == {"first": 90.0, "second": 80.0, "both": 70.0}
    classes = {r["outcome"]: (r["attempts"], r["retried"]) for r in grounding.outcome_counts(out).collect()}
    assert classes["not_json"] == (4, True) and classes["refused"] == (1, False) and classes["blank"] == (1, True)
    share = evaluation.first_attempt_failures(out).first()
    assert (share["requests"], share["invalid"]) == (6, 3)


def test_vocabulary_guard(spark):
    some = spark.createDataFrame([(1, "x")], "id int, name string")
    vocabulary.require_vocabulary(some, some)
    with pytest.raises(GroundingError, match="no snapshot"):
        vocabulary.require_vocabulary(some.where("false"), some)
    with pytest.raises(GroundingError, match="neighbourhoods"):
        vocabulary.require_vocabulary(some, some.where(F.lit(False)))


def test_bodies_to_ranked_listings(spark, run, names):
    from test_search import SCHEMA, row

    from roostline.plans.search import answer

    listings = spark.createDataFrame([row(g) for g in range(1, 200)], SCHEMA)
    rows = [
        ("a", 1, body(neighbourhoods=["Canalside", "Hilltop"], max_price=150), "end_turn"),
        ("b", 1, "nope", "end_turn"),
        ("b", 2, body(amenities=["Wifi"], min_rating=9), "end_turn"),
    ]
    df = spark.createDataFrame(rows, "request_id string, attempt int, body string, stop_reason string")
    query = F.array(*[F.lit(v) for v in row(7)[-1]]).cast("array<float>")
    out = answer(df, names, listings, lambda sets: sets.withColumn("query", query), 3).collect()
    assert {r["request_id"] for r in out} == {"a"} and [r["place"] for r in sorted(out, key=lambda r: r["place"])] == [1, 2, 3]
    places = {r["id"]: r["neighbourhood_id"] for r in listings.collect()}
    assert all(places[r["id"]] in (1, 2) for r in out)


def test_bodies_of_one_file_are_taken_apart_by_many_tasks(spark, tmp_path):
    rows = [(f"r{i}", 1, '{"semantic_query": "x"}', "end_turn") for i in range(200)]
    spark.createDataFrame(rows, "request_id string, attempt int, body string, stop_reason string").coalesce(1).write.parquet(str(tmp_path / "b"))
    decoded = grounding.decode(spark.read.parquet(str(tmp_path / "b")))
    assert decoded.select(F.spark_partition_id()).distinct().count() > 1
