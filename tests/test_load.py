import gzip
from concurrent.futures import ThreadPoolExecutor
from datetime import date

import pytest
from pyspark.sql import functions as F
from snapshot_files import (
    HEADER, NOTE_HEADER, ROWS, TRACE, berth, berths, kept_notes, note, notes, refused, source_id, write_csv,
)

from roostline.errors import LoadError
from roostline.operators import audit, search, vocabulary
from roostline.operators.documents import hashing_embedder
from roostline.plans.enrich import embed, index_amenities
from roostline.plans.load import load_snapshot
from roostline.session import shared_folder
from roostline.sources import tables
from roostline.sources.snapshot_csv import read_snapshot_csv
from roostline.sources.tables import SnapshotStore
from roostline.standins import snapshot

STORED = [n for n in range(ROWS) if not refused(n)]


def run(spark, folder, root, listings=None, reviews=None, **options):
    store = SnapshotStore(spark, str(root))
    report = load_snapshot(
        spark,
        store,
        listings_csv=write_csv(folder / "berths.csv.gz", HEADER, berths() if listings is None else listings),
        reviews_csv=write_csv(folder / "notes.csv.gz", NOTE_HEADER, notes() if reviews is None else reviews),
        snapshot_date="2026-01-02",
        city="Lockport",
        max_reviews_per_listing=options.pop("keep", 2),
        **options,
    )
    return store, report


@pytest.fixture(scope="module")
def loaded(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("files")
    return run(spark, folder, tmp_path_factory.mktemp("store") / "s")


def by_source(store):
    return {r["source_listing_id"]: r for r in store.table("listings").collect()}


def test_report(loaded):
    _, r = loaded
    bad = ROWS - len(STORED)
    assert (r.listings_seen, r.listings_loaded, r.listings_rejected) == (ROWS, len(STORED), bad)
    assert (r.listings_duplicated, r.listings_removed) == (0, 0)
    assert r.listing_rejections == (("minimum_nights", bad),)
    # Each refused listing has one review, and two belong to a listing no file has.
    assert (r.reviews_seen, r.reviews_rejected, r.reviews_without_listing) == (len(notes()), 0, bad + 2)
    assert r.reviews_kept == kept_notes(2)
    assert (r.neighbourhoods, r.room_types, r.property_types, r.property_types_collapsed) == (3, 2, 2, 2)
    assert r.amenities == 3


def test_report_is_a_row(spark, loaded):
    row = loaded[1].as_row(spark).first()
    assert row["listings_loaded"] == len(STORED) and row["listing_rejections"][0]["field"] == "minimum_nights"


def test_every_row_as_its_rule_says(loaded):
    rows = by_source(loaded[0])
    assert sorted(rows) == [source_id(n) for n in STORED]
    for place, n in enumerate(STORED, 1):
        row = rows[source_id(n)]
        assert row["id"] == place
        assert row["price_gbp"] == (None, 2000 + n + 0.25, n, 0)[n % 4]
        assert row["bathrooms"] == (3, 0.5, n % 7, 2.5)[n % 4]
        assert row["bedrooms"] == (n % 3 or None) and row["description"] == (f"Deck {n % 4}, facing the lock" if n % 6 else None)
        assert row["instant_bookable"] is (True, False, None)[n % 3]
        assert row["host_is_superhost"] is (True if n % 2 else None)
        assert row["rating"] == (3 + n % 8 / 4 if n % 5 else None)
        # Half the rows write Sauna, so that spelling replaces the others.
        assert row["amenities"] == ["Sauna", "Stove"] + ["Oar rack"] * (n % 5 == 0)


def test_lookup_tables(loaded):
    store = loaded[0]
    names = {
        t: [r["name"] for r in store.table(t).orderBy("id").collect()]
        for t in ("neighbourhoods", "room_types", "property_types", "amenities")
    }
    assert names == {
        "neighbourhoods": ["Harbour", "Mill", "Quarry"], "room_types": ["Bunk", "Cabin"],
        "property_types": ["Houseboat", "Other"], "amenities": ["Oar rack", "Sauna", "Stove"],
    }
    rare = store.table("listings").where("property_type_id = 2").select("source_listing_id").collect()
    assert sorted(r[0] for r in rare) == [source_id(n) for n in range(0, ROWS, 12)]


def test_newest_reviews_and_ties(loaded):
    store = loaded[0]
    ids = store.table("listings").select(F.col("id").alias("listing_id"), "source_listing_id")
    found = {}
    for r in store.table("reviews").join(ids, "listing_id").orderBy("id").collect():
        found.setdefault(r["source_listing_id"], []).append(r["comments"])
    # Newest first; on a shared day the later row of the file counts as newer.
    want = {
        source_id(n): [f'Stay {i} on {n},\nthey said "{i}".' for i in range(n % 4)][::-1][:2] for n in STORED if n % 4
    }
    assert found == want


def test_provenance_and_contract(loaded):
    store = loaded[0]
    row = store.provenance().first()
    assert (row["city"], row["listing_count"], row["review_count"]) == ("Lockport", len(STORED), kept_notes(2))
    for name, schema in tables.SCHEMAS.items():
        assert audit.schema_differences(store.table(name), schema) == []
    rules = audit.listing_rules(tables.LISTINGS)
    broken = audit.contract_violations(store.table("listings"), rules).where("rows > 0")
    assert broken.collect() == []
    assert audit.repeated_keys(store.table("listings"), "source_listing_id").collect() == []


def test_no_personal_data(loaded):
    every = {name: loaded[0].table(name) for name in tables.SCHEMAS}
    assert audit.personal_columns(every) == []
    for name, table in every.items():
        text = [c for c, kind in table.dtypes if kind == "string"]
        if text:
            assert audit.personal_values(table, text, [TRACE]).isEmpty(), name
    # Review bodies are stored as they are; only the reviewer's own columns are gone.
    assert not audit.personal_values(every["reviews"], ["comments"], ["they said"]).isEmpty()


def names_to_use(store):
    tables_ = (store.table(t) for t in ("neighbourhoods", "room_types", "property_types", "amenities"))
    return [(r["field"], r["name"]) for r in vocabulary.vocabulary(*tables_).collect()]


def test_vocabulary_leaves_out_the_catch_all(loaded):
    assert names_to_use(loaded[0]) == [
        ("neighbourhoods", "Harbour"), ("neighbourhoods", "Mill"), ("neighbourhoods", "Quarry"),
        ("property_types", "Houseboat"), ("room_types", "Bunk"), ("room_types", "Cabin"),
    ]


def test_load_leaves_no_folder_behind(spark, tmp_path):
    from pathlib import Path

    shared = Path(shared_folder(spark).removeprefix("file:"))
    before = {p.name for p in shared.iterdir()}
    run(spark, tmp_path, tmp_path / "s")
    assert not [p for p in shared.iterdir() if p.name not in before and p.name.startswith("load-")]


def test_embed_and_index_then_search_then_reload(spark, tmp_path):
    store, _ = run(spark, tmp_path, tmp_path / "s")
    covered = embed(spark, store, hashing_embedder())
    assert (covered["listings"], covered["missing"], covered["wrong_width"]) == (len(STORED), 0, 0)
    assert index_amenities(spark, store, budget=2) == ["Sauna", "Stove"]
    assert [n for f, n in names_to_use(store) if f == "amenities"] == ["Sauna", "Stove"]
    listings = store.table("listings")
    assert listings.where("has_sauna and has_stove").count() == len(STORED)
    texts = {r["source_listing_id"]: r["doc_text"] for r in listings.collect()}
    assert texts[source_id(1)].startswith("Berth 1\nDeck 1, facing the lock\nHarbour\nBunk, Houseboat\nAmenities: Sauna, Stove")
    assert "Stay 0 on 1" in texts[source_id(1)]
    vector = listings.where(F.col("source_listing_id") == source_id(8)).first()["embedding"]
    best = search.top_k(listings, {"min_accommodates": 4, "amenities": ["Sauna"]}, vector, 3)
    assert best.first()["distance"] == pytest.approx(0, abs=1e-6) and best.count() == 3

    # A changed file: one name, one price, one row refused, one gone, one new and repeated.
    changed = berths(5)
    changed[0] = berth(0, name="Renamed")
    changed[2] = berth(2, price="$20.00")
    changed[3] = berth(3, accommodates="0")
    changed += [berth(ROWS), berth(ROWS, name="A later repeat")]
    before = by_source(store)
    store, report = run(spark, tmp_path, tmp_path / "s", changed)
    after = by_source(store)
    assert (report.listings_removed, report.listings_duplicated, report.listings_rejected) == (1, 1, 4)
    assert set(after) == set(before) - {source_id(5)} | {source_id(ROWS)}
    assert all(after[k]["id"] == before[k]["id"] for k in after if k in before)
    assert after[source_id(ROWS)]["id"] == len(STORED) + 1 and after[source_id(ROWS)]["name"] == f"Berth {ROWS}"
    # A renamed listing loses its vector, a cheaper one keeps it, a refused one stays whole.
    assert after[source_id(0)]["embedding"] is None and after[source_id(0)]["doc_text"] is None
    assert after[source_id(2)]["embedding"] == before[source_id(2)]["embedding"]
    assert after[source_id(2)]["price_gbp"] == 20.0 and after[source_id(3)]["accommodates"] == 4
    assert [n for f, n in names_to_use(store) if f == "amenities"] == ["Sauna", "Stove"]
    # The next run fills only what is missing.
    assert embed(spark, store, hashing_embedder())["missing"] == 0
    again = by_source(store)
    assert again[source_id(2)]["embedding"] == before[source_id(2)]["embedding"]
    assert again[source_id(0)]["doc_text"].startswith("Renamed")


def test_embed_needs_a_load(spark, tmp_path):
    with pytest.raises(LoadError, match="nothing was published"):
        embed(spark, SnapshotStore(spark, str(tmp_path / "s")), hashing_embedder())


def test_reload_of_the_same_file_changes_nothing(spark, tmp_path):
    store, first = run(spark, tmp_path, tmp_path / "s")
    before = [tuple(r) for r in store.table("listings").orderBy("id").collect()]
    store, second = run(spark, tmp_path, tmp_path / "s")
    assert [tuple(r) for r in store.table("listings").orderBy("id").collect()] == before
    assert second.reviews_kept == first.reviews_kept


def test_two_writers_on_one_version(spark, tmp_path):
    store, _ = run(spark, tmp_path, tmp_path / "s")
    base = store.newest()
    say = dict(snapshot_date=base["snapshot_date"], city="Lockport", listings=1, reviews=1, base=base)
    store.publish(store.begin(), **say)
    winner = store.newest()
    with pytest.raises(LoadError, match="another version"):
        store.publish(store.begin(), **say)
    assert store.newest() == winner and winner["version"] == base["version"] + 1


def test_of_many_writers_at_once_one_is_seen(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "s"))
    say = dict(snapshot_date=date(2026, 1, 2), city="Lockport", listings=0, reviews=0, base=None)
    folders = [store.begin() for _ in range(8)]

    def won(folder):
        try:
            store.publish(folder, **say)
        except LoadError:
            return False
        return True

    with ThreadPoolExecutor(8) as pool:
        wins = list(pool.map(won, folders))
    assert wins.count(True) == 1 and store.newest()["folder"] == folders[wins.index(True)]
    assert [p.name for p in (tmp_path / "s" / "published").iterdir()] == ["000000000001.json"]


def test_plans_after_a_load_write_only_what_they_change(spark, tmp_path):
    store, _ = run(spark, tmp_path, tmp_path / "s")
    loaded = store.newest()["tables"]
    embed(spark, store, hashing_embedder())
    embedded = store.newest()["tables"]
    assert {t for t in loaded if loaded[t] != embedded[t]} == {"listings"}
    index_amenities(spark, store, budget=2)
    indexed = store.newest()["tables"]
    assert {t for t in loaded if embedded[t] != indexed[t]} == {"listings", "amenities"}
    assert store.table("reviews").count() == store.newest()["review_count"]


@pytest.mark.parametrize("keep", [0, 1, 9])
def test_review_cap(spark, tmp_path, keep):
    _, report = run(spark, tmp_path, tmp_path / "s", keep=keep)
    assert report.reviews_kept == kept_notes(keep)


def test_bad_rows_are_counted_not_fatal(spark, tmp_path):
    rows = [
        berth(0), berth(1, name="has a \x00 byte"), berth(2, accommodates="99999999999"),
        berth(3, id="12345678901234567890"), berth(9),
    ]
    reviews = [note(1, 0, listing_id="9" * 20), note(1, 1, date="May"), note(1, 2, comments=" "), note(0, 0)]
    _, report = run(spark, tmp_path, tmp_path / "s", rows, reviews)
    assert dict(report.listing_rejections) == {"name": 1, "accommodates": 1, "id": 1, "minimum_nights": 1}
    assert (report.listings_loaded, report.reviews_rejected, report.reviews_kept) == (1, 3, 1)


class TestFailedLoads:
    """Whatever goes wrong, the version published before stays readable."""

    @pytest.fixture(autouse=True)
    def first(self, loaded):
        self.store = loaded[0]
        self.root = loaded[0].root
        yield
        assert self.store.provenance().first()["listing_count"] == len(STORED)
        assert self.store.table("listings").count() == len(STORED)

    def load(self, spark, **files):
        return load_snapshot(spark, self.store, snapshot_date=files.pop("date", "2026-01-02"), city="T", **files)

    def good(self, folder):
        return (
            write_csv(folder / "l.csv.gz", HEADER, berths()),
            write_csv(folder / "r.csv.gz", NOTE_HEADER, notes()),
        )

    def test_only_bad_rows(self, spark, tmp_path):
        _, reviews = self.good(tmp_path)
        bad = write_csv(tmp_path / "b.csv.gz", HEADER, [berth(1, room_type=""), berth(2, price="free")])
        with pytest.raises(LoadError, match="price: 1, room_type: 1"):
            self.load(spark, listings_csv=bad, reviews_csv=reviews)

    def test_renamed_column(self, spark, tmp_path):
        listings, _ = self.good(tmp_path)
        header = ["when" if h == "date" else h for h in NOTE_HEADER]
        rows = [{("when" if k == "date" else k): v for k, v in r.items()} for r in notes()]
        with pytest.raises(LoadError, match="no date column"):
            self.load(spark, listings_csv=listings, reviews_csv=write_csv(tmp_path / "x.csv", header, rows))

    def test_empty_and_missing_files(self, spark, tmp_path):
        _, reviews = self.good(tmp_path)
        (tmp_path / "empty.csv").write_text("")
        with pytest.raises(LoadError, match="accommodates, amenities"):
            self.load(spark, listings_csv=str(tmp_path / "empty.csv"), reviews_csv=reviews)
        with pytest.raises(LoadError, match="could not be read"):
            self.load(spark, listings_csv=str(tmp_path / "nowhere.csv"), reviews_csv=reviews)

    def test_truncated_gzip(self, spark, tmp_path):
        listings, _ = self.good(tmp_path)
        rows = [note(1, n) for n in range(20_000)]
        whole = open(write_csv(tmp_path / "w.csv.gz", NOTE_HEADER, rows), "rb").read()
        (tmp_path / "cut.csv.gz").write_bytes(whole[: len(whole) // 2])
        with pytest.raises(LoadError, match="could not be read"):
            self.load(spark, listings_csv=listings, reviews_csv=str(tmp_path / "cut.csv.gz"))

    def test_not_utf8(self, spark, tmp_path):
        listings, _ = self.good(tmp_path)
        rows = [note(1, 0, comments="caf\xe9")]
        bad = write_csv(tmp_path / "latin.csv.gz", NOTE_HEADER, rows, encoding="latin-1")
        with pytest.raises(LoadError, match="not UTF-8"):
            self.load(spark, listings_csv=listings, reviews_csv=bad)

    @pytest.mark.parametrize("date", [None, "", "01/02/2026"])
    def test_snapshot_date(self, spark, tmp_path, date):
        listings, reviews = self.good(tmp_path)
        with pytest.raises(LoadError, match="snapshot date"):
            self.load(spark, listings_csv=listings, reviews_csv=reviews, date=date)


def test_accents_survive(spark, tmp_path):
    rows = berths() + [berth(700, name="Café 中文", amenities='["Caf\\u00e9 corner", "CAFÉ CORNER"]')]
    store, _ = run(spark, tmp_path, tmp_path / "s", rows)
    row = by_source(store)[source_id(700)]
    assert row["name"] == "Café 中文" and row["amenities"] == ["Café corner"]


def test_several_parts_keep_file_order(spark, tmp_path):
    parts = tmp_path / "parts"
    parts.mkdir()
    write_csv(parts / "a.csv.gz", HEADER, [berth(1, name="first")] + [berth(n) for n in range(10, 30)])
    write_csv(parts / "b.csv.gz", HEADER, [berth(1, name="second")] + [berth(n) for n in range(40, 60)])
    store = SnapshotStore(spark, str(tmp_path / "s"))
    reviews = write_csv(tmp_path / "r.csv", NOTE_HEADER, notes())
    report = load_snapshot(
        spark, store, listings_csv=str(parts), reviews_csv=reviews, snapshot_date="2026-01-02", city="T"
    )
    assert report.listings_duplicated == 1
    assert by_source(store)[source_id(1)]["name"] == "first"


def test_gzip_is_what_it_says(tmp_path):
    path = write_csv(tmp_path / "l.csv.gz", HEADER, [berth(1)])
    assert gzip.open(path, "rt").readline().startswith("id,")


def test_snapshot_files_are_written_in_parts_that_keep_the_order(monkeypatch, spark, tmp_path):
    monkeypatch.setattr(snapshot, "_PART_ROWS", 100)
    rows = spark.range(950).select(F.col("id").alias("file_pos"), F.col("id").cast("string").alias("a")).repartition(7, "a")
    path = snapshot._write_csv(rows, str(tmp_path / "csv"))
    assert len(list((tmp_path / "csv").glob("*.csv.gz"))) > 5
    back = read_snapshot_csv(spark, path, ("a",)).orderBy("file_pos").collect()
    assert [int(r["a"]) for r in back] == list(range(950))
