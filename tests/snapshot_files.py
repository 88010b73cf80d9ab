"""A made-up snapshot: every cell follows from the number of its row by a rule below."""

import csv
import gzip
import json

from roostline import config

ROWS = 84
TRACE = "owner-7f3a"  # what every personal column holds
_OF_REVIEWS = ("reviewer_id", "reviewer_name")


def source_id(n):
    return 10 * n + 3


def refused(n):
    return n % 28 == 9


_CELLS = {
    "id": source_id,
    "name": lambda n: f"Berth {n}",
    "description": lambda n: f"Deck {n % 4}, facing the lock" if n % 6 else "",
    "neighbourhood_cleansed": lambda n: ("Mill", "Harbour", "Quarry")[n % 3],
    "room_type": lambda n: ("Cabin", "Bunk")[n % 2],
    "property_type": lambda n: "Houseboat" if n % 12 else f"Barge {n // 12 % 2}",
    "latitude": lambda n: 40 + n / 100,
    "longitude": lambda n: 5 - n / 100,
    "price": lambda n: ("", f"€2,{n:03d}.25", f" {n} ", "$0")[n % 4],
    "accommodates": lambda n: n % 5 + 1,
    "bedrooms": lambda n: n % 3 or "",
    "beds": lambda n: n % 4,
    "bathrooms": lambda n: n % 7,
    "bathrooms_text": lambda n: ("3 baths", "half-bath", "", "2.5 shared baths")[n % 4],
    "minimum_nights": lambda n: "soon" if refused(n) else n % 3 + 1,
    "number_of_reviews": lambda n: n,
    "review_scores_rating": lambda n: 3 + n % 8 / 4 if n % 5 else "",
    "review_scores_location": lambda n: 2.5,
    "review_scores_cleanliness": lambda n: n % 6,
    "instant_bookable": lambda n: ("t", "F", "")[n % 3],
    "host_is_superhost": lambda n: "true" if n % 2 else "",
    "amenities": lambda n: json.dumps([("Sauna", "SAUNA", "Sauna", "sauna")[n % 4], "Stove", "stove"] + ["Oar   rack"] * (n % 5 == 0)),
}
_NOTE = {
    "listing_id": lambda n, i: source_id(n),
    "date": lambda n, i: f"2025-06-{1 + i * (n % 2):02d}",
    "comments": lambda n, i: f'Stay {i} on {n},\nthey said "{i}".',
}
HEADER = [*_CELLS, *(c for c in config.PERSONAL_COLUMNS if c not in _OF_REVIEWS), "unread"]
NOTE_HEADER = [*_NOTE, *_OF_REVIEWS]


def berth(n, **changes):
    """Row ``n`` of the listings, with some cells changed."""
    return {c: str(changes[c]) if c in changes else str(_CELLS[c](n)) if c in _CELLS else TRACE for c in HEADER}


def note(n, i, **changes):
    """Review ``i`` of listing ``n``; those of an even listing share their day."""
    return {c: str(changes[c]) if c in changes else str(_NOTE[c](n, i)) if c in _NOTE else TRACE for c in NOTE_HEADER}


def berths(*left_out):
    return [berth(n) for n in range(ROWS) if n not in left_out]


def notes():
    """``n % 4`` reviews of every listing, and two of a listing no file has."""
    return [note(n, i) for n in range(ROWS) for i in range(n % 4)] + [note(0, i, listing_id=4) for i in (0, 1)]


def kept_notes(keep):
    """How many reviews a load with that cap stores."""
    return sum(min(n % 4, keep) for n in range(ROWS) if not refused(n))


def write_csv(path, header, rows, encoding="utf-8"):
    opener = gzip.open if str(path).endswith(".gz") else open
    with opener(path, "wt", encoding=encoding, newline="") as handle:
        writer = csv.DictWriter(handle, header)
        writer.writeheader()
        writer.writerows(rows)
    return str(path)
