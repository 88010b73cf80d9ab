"""Rule tables: one input text, one expected value or a refusal."""

import datetime

import pytest
from pyspark.sql import functions as F
from snapshot_files import berth, note

from roostline import config
from roostline.functions import rules
from roostline.operators import ingest
from roostline.sources.snapshot_csv import missing_columns

BAD = object()
SMALL = config.INT2_RANGE
TABLES = {
    "price": (
        rules.price,
        [
            ("$1,250.00", 1250.0), ("£80.5", 80.5), ("  $75.00  ", 75.0), ("€1 200", 1200.0), ("", None),
            ("   ", None), (None, None), ("$0.00", 0.0), ("free", BAD), ("$", BAD), ("1.2.3", BAD),
            ("$-5.00", BAD), ("9" * 41, BAD), ("nan", BAD), ("inf", BAD), ("1e400", BAD), ("\xa0", None),
        ],
    ),
    "bath": (
        rules.bath_count,
        [
            ("1.5 baths", 1.5), ("2 shared baths", 2.0), ("1 private bath", 1.0), ("Half-bath", 0.5),
            ("Shared half-bath", 0.5), ("1  bath", 1.0), ("\t0 baths ", 0.0), ("", None), (None, None),
            ("one bath", BAD), ("bath", BAD), ("1 bathroom", BAD), ("1.5", BAD),
        ],
    ),
    "flag": (
        rules.flag,
        [("t", True), ("f", False), ("T", True), ("TRUE", True), ("false", False), (" ", None), ("yes", BAD), ("1", BAD)],
    ),
    "small": (
        lambda c: rules.whole_number(c, SMALL),
        [
            ("32767", 32767), ("-32768", -32768), ("+7", 7), (" 3 ", 3), ("1_000", 1000), ("", None),
            ("40000", BAD), ("-40000", BAD), ("99999999999", BAD), ("1.0", BAD), ("x", BAD),
        ],
    ),
    "wide": (
        rules.whole_number,
        [("9223372036854775807", 2**63 - 1), ("9223372036854775808", BAD), ("-9223372036854775808", -(2**63))],
    ),
    "number": (
        lambda c: rules.finite_number(c, config.FLOAT4_MAX),
        [
            ("4.80", 4.8), (".5", 0.5), ("5.", 5.0), ("-1e3", -1000.0), ("", None), ("1.5d", BAD),
            ("nan", BAD), ("inf", BAD), ("-inf", BAD), ("Infinity", BAD), ("1e39", BAD),
        ],
    ),
    "date": (
        rules.iso_date,
        [
            ("2010-03-21", datetime.date(2010, 3, 21)), ("20100321", datetime.date(2010, 3, 21)), ("", BAD), (None, BAD),
            ("21/03/2010", BAD), ("March 2010", BAD), ("2010-3-1", BAD), ("2010-02-30", BAD), ("0000-01-01", BAD),
        ],
    ),
    "words": (
        rules.words,
        [("  a b\t", "a b"), ("\x1c x  ", "x"), ("", None), (None, None), ("a\x00b", BAD)],
    ),
}


@pytest.mark.parametrize("name", TABLES)
def test_rule(spark, name):
    make, cases = TABLES[name]
    df = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(cases)], "i int, x string")
    rule = make(F.col("x"))
    read = df.withColumn("v", rule.value)
    rows = read.select("i", "v", rule.bad(F.col("v")).alias("bad")).orderBy("i").collect()
    for (text, want), row in zip(cases, rows):
        assert row["bad"] == (want is BAD), text
        if want is not BAD:
            assert row["v"] == want, text


@pytest.mark.parametrize(
    "text, want",
    [
        ('["Wifi", "Kitchen"]', ["Wifi", "Kitchen"]),
        ('["Kitchen", "Wifi", "KITCHEN"]', ["Kitchen", "Wifi"]),
        ('["Hot  tub", " Hot\\ttub"]', ["Hot tub"]),
        ('["Caf\\u00e9", "CAFE\\u0301", "Stra\\u00dfe", "STRASSE"]', ["Café", "Straße"]),
        ('["\\uff37ifi", ""]', ["Wifi"]),
        ("", []), (None, []), ("[]", []), ('["", " "]', []),
        ("not json", None), ("{", None), ('{"a": 1}', None), ('["a", 3]', None), ("[null]", None),
        ('["a", null]', None), ('["a\\u0000"]', None), ('"a"', None), ('[["a"]]', None),
    ],
)
def test_name_list(spark, text, want):
    row = rules.name_list(spark.createDataFrame([(text,)], "x string"), "x", "out").first()
    assert (row["out"] if row["out"] is None else [a["name"] for a in row["out"]]) == want


def parse(spark, rows, fn):
    header = list(rows[0])
    schema = ", ".join(f"`{h}` string" for h in header)
    return fn(spark.createDataFrame([tuple(r[h] for h in header) for r in rows], schema))


def test_first_failing_column_is_reported(spark):
    broken = [
        ("id", {}), ("name", {"name": " "}), ("neighbourhood_cleansed", {"neighbourhood_cleansed": ""}),
        ("room_type", {"room_type": ""}), ("property_type", {"property_type": ""}), ("latitude", {"latitude": "x"}),
        ("longitude", {"longitude": ""}), ("latitude", {"latitude": "90.01"}), ("longitude", {"longitude": "-180.5"}),
        ("accommodates", {"accommodates": "0"}), ("minimum_nights", {"minimum_nights": "0"}),
        ("number_of_reviews", {"number_of_reviews": "-1"}), ("bathrooms_text", {"bathrooms_text": "some"}),
        ("bathrooms", {"bathrooms_text": "", "bathrooms": "x"}), ("description", {"description": "\x00a"}),
        ("price", {"price": "free"}), ("bedrooms", {"bedrooms": "1.5"}), ("beds", {"beds": "x"}),
        ("review_scores_rating", {"review_scores_rating": "nan"}),
        ("review_scores_location", {"review_scores_location": "x"}),
        ("review_scores_cleanliness", {"review_scores_cleanliness": "x"}),
        ("instant_bookable", {"instant_bookable": "maybe"}), ("host_is_superhost", {"host_is_superhost": "2"}),
        ("amenities", {"amenities": "["}),
    ]
    rows = [berth(i, **({"id": "x"} if field == "id" else change)) for i, (field, change) in enumerate(broken)]
    out = parse(spark, rows, ingest.parse_listings).collect()
    assert [r["rejected_field"] for r in out] == [field for field, _ in broken]
    assert out[0]["readable_id"] is None and out[1]["readable_id"] == 13
    # With every column broken, the first one in the fixed order is blamed.
    for i in range(len(broken) - 1):
        later = {k: v for field, change in broken[i + 1:] for k, v in change.items()}
        merged = berth(5, **{**later, **broken[i][1]})
        if broken[i][0] in ("id", "latitude", "longitude", "bathrooms_text", "bathrooms"):
            continue
        assert parse(spark, [merged], ingest.parse_listings).first()["rejected_field"] == broken[i][0]


def test_negative_bedrooms_are_accepted(spark):
    row = parse(spark, [berth(1, bedrooms="-2", beds="")], ingest.parse_listings).first()
    assert row["rejected_field"] is None and row["bedrooms"] == -2 and row["beds"] is None


def test_number_fills_in_for_blank_bath_text(spark):
    row = parse(spark, [berth(1, bathrooms_text=" ", bathrooms="2.5")], ingest.parse_listings).first()
    assert row["bathrooms"] == 2.5


def test_review_rules_in_order(spark):
    rows = [note(1, 0, date="bad", comments=""), note(1, 0, listing_id="x", date="bad"), note(1, 0, date="bad"), note(1, 0)]
    out = parse(spark, rows, ingest.parse_reviews)
    assert [r["rejected_field"] for r in out.collect()] == ["comments", "listing_id", "date", None]
    assert set(ingest.accepted(out).columns) == {"comments", "source_listing_id", "date"}


def test_no_personal_column_survives(spark):
    parsed = parse(spark, [berth(1)], ingest.parse_listings)
    assert not set(parsed.columns) & set(config.PERSONAL_COLUMNS)


def test_missing_columns():
    assert missing_columns(["a", "b", "x"], ["b", "c", "a"]) == ["c"]
    assert missing_columns(None, ["b", "a"]) == ["a", "b"]


def test_no_compiled_method_of_the_listing_rules_is_too_large(spark):
    """The JVM interprets a method beyond 8,000 bytes, at several times the cost."""
    huge = spark.conf.get("spark.sql.codegen.hugeMethodLimit")
    names = config.LISTING_SOURCE_COLUMNS
    raw = spark.createDataFrame([("1",) * len(names)], ", ".join(f"{c} string" for c in names))
    try:
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", "65535")
        stages = ingest.parse_listings(raw.localCheckpoint())._jdf.queryExecution().debug().codegenToSeq()
        sizes = [stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())]
    finally:
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", huge)
    assert len(sizes) >= 3 and 0 < max(sizes) < 8000
