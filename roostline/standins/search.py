"""Checks of filters, search and relaxation (E, F and G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from roostline import config
from roostline.operators import cells, counting, evaluation, filters, relax, search
from roostline.session import stable
from roostline.standins import relations as r

_L = f"WITH l AS ({r.LISTINGS_SQL}), f AS ({r.filter_sets_sql()}), q AS ({r.REQUESTS_SQL}) "
_T = r.TERMS_SQL


def _one(given, *columns):
    def run(spark, sf):
        return filters.where(r.listings(spark, sf, vectors=False), given).select("id", *columns)

    return run


def _one_sql(predicate, *columns):
    return _L + f"SELECT {', '.join(('id', *columns))} FROM l WHERE {predicate}"


def _sets(spark, sf, source="supplier"):
    return filters.canonical(r.filter_sets(spark, sf, source))


def empty_sets(spark, sf):
    return _sets(spark, sf, "customer").select("request_id", filters.is_empty().alias("is_empty"))


_EMPTY_SQL = " AND ".join(
    [f"len({f}) = 0" for f in (*filters.ANY_OF, "amenities")]
    + [f"{f} IS NULL" for f in (*filters.BOUNDS, "near_lat")]
)


def null_report(spark, sf):
    return filters.null_report(_sets(spark, sf, "customer"), r.listings(spark, sf, vectors=False))


_NULL_SQL = _L + "SELECT DISTINCT request_id, \"column\", rows_lost FROM (" + " UNION ALL ".join(
    f"SELECT request_id, '{column}' AS \"column\", (SELECT count(*) - count({column}) FROM l) AS rows_lost "
    f"FROM ({r.filter_sets_sql('customer')}) WHERE {field} IS NOT NULL"
    for field, (column, _) in filters.BOUNDS.items()
    if column in filters.NULLABLE
) + ")"


def validation(spark, sf):
    """Filter sets with bounds that some customers' balances push out of range."""
    sets = r.filter_sets(spark, sf, "customer").join(
        r.table(spark, sf, "customer").select(
            F.concat(F.lit("r"), "c_custkey").alias("request_id"), "c_acctbal", "c_nationkey"
        ),
        "request_id",
    )
    shaken = sets.withColumns(
        {
            "min_price": F.col("c_acctbal"),
            "min_rating": F.when(F.col("c_acctbal") > 3000, F.col("c_acctbal") / 1500),
            "room_type_ids": F.array(F.col("c_nationkey")),
            "amenities": F.when(F.col("c_nationkey") == 3, F.array(F.lit("  "))).otherwise(F.col("amenities")),
        }
    )
    return filters.validate(shaken).select("request_id", F.array_join("problems", ",").alias("problems"))


_VALIDATION_SQL = f"""
SELECT request_id, CASE WHEN named = '' AND c_acctbal > max_price THEN 'price_range' ELSE named END AS problems FROM (
SELECT request_id, c_acctbal, max_price, concat_ws(',', CASE WHEN c_nationkey < 1 THEN 'room_type_ids' END,
 CASE WHEN c_acctbal < 0 THEN 'min_price' END, CASE WHEN c_acctbal > 3000 AND c_acctbal / 1500 > 5 THEN 'min_rating' END,
 CASE WHEN c_nationkey = 3 THEN 'amenities' END) AS named
FROM ({r.filter_sets_sql('customer')}) s JOIN customer ON request_id = concat('r', c_custkey))
"""


def canonical_sets(spark, sf):
    """Repeated filter sets, told by their key; set-valued fields sorted and without repeats."""
    sets = _sets(spark, sf, "customer")
    joined = {f: F.array_join(f, ",") for f in (*filters.ANY_OF, "amenities")}
    sizes = sets.groupBy("filter_key").agg(F.count("*").alias("same"))
    return sets.join(sizes, "filter_key").withColumns(joined).select("request_id", *joined, "same")


_LISTS = (*filters.ANY_OF, "amenities")
_CANON = {f: f"array_to_string(list_sort(list_distinct({f})), ',')" for f in _LISTS}
_CANONICAL_SQL = (
    "SELECT request_id, " + ", ".join(f"{f}_c AS {f}" for f in _LISTS) + ", count(*) OVER (PARTITION BY "
    + ", ".join([f"{f}_c" for f in _LISTS] + [*filters.BOUNDS, "near_lat", "near_lon", "near_km"])
    + ") AS same FROM (SELECT *, " + ", ".join(f"{v} AS {f}_c" for f, v in _CANON.items())
    + f" FROM ({r.filter_sets_sql('customer')}))"
)


def counts(spark, sf):
    return counting.count_per_request(r.listings(spark, sf, vectors=False), _sets(spark, sf, "customer"))


_COUNTS_SQL = (
    f"WITH l AS ({r.LISTINGS_SQL}), f AS ({r.filter_sets_sql('customer')}) "
    f"SELECT request_id, count(l.id) AS matches FROM f LEFT JOIN l ON {r.MATCH_SQL} GROUP BY 1"
)


def stats(spark, sf):
    out = None
    for field in ("price_gbp", "rating", "minimum_nights"):
        one = filters.field_stats(r.listings(spark, sf, vectors=False), field, {"min_accommodates": 3})
        out = one if out is None else out.unionByName(one)
    return out


_STATS_SQL = _L + " UNION ALL ".join(
    f"SELECT '{c}' AS field, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, CAST(median({c}) AS DOUBLE) AS median, "
    f"count({c}) AS non_null FROM l WHERE accommodates >= 3"
    for c in ("price_gbp", "rating", "minimum_nights")
)


def matches(spark, sf):
    return filters.match(r.listings(spark, sf, vectors=False), _sets(spark, sf))


# --- Search -----------------------------------------------------------------------------

_FLAGSHIP = {"max_price": 980.0, "min_accommodates": 2, "neighbourhood_ids": [2, 17, 5, 9]}
_FLAGSHIP_SQL = "price_gbp <= 980 AND accommodates >= 2 AND neighbourhood_id IN (2, 17, 5, 9)"


def _query(spark, sf):
    # One request's vector is a parameter of the query, not data.
    return r.table(spark, sf, "embeddings").where("vec_id = 1").select("embedding").first()[0]


def flagship(spark, sf):
    return search.top_k(r.listings(spark, sf), _FLAGSHIP, _query(spark, sf), 10, ("id", "name", "price_gbp"))


def distances(spark, sf):
    return search.ranked(r.listings(spark, sf), _query(spark, sf), ("id",))


_D = f"round(1 - list_cosine_similarity(CAST({{a}} AS DOUBLE[]), CAST({{b}} AS DOUBLE[])), {config.DISTANCE_DECIMALS})"
_D1 = _D.format(a="l.embedding", b="(SELECT embedding FROM embeddings WHERE vec_id = 1)")
_DQ = _D.format(a="l.embedding", b="q.query")
_MATCH_Q = r.MATCH_SQL.replace("f.", "q.")


def pool(spark, sf):
    return search.candidates(r.listings(spark, sf), {"min_accommodates": 2}, _query(spark, sf))


def guards(spark, sf):
    """Every customer's search arguments: a vector of full, of shorter and of no length among them."""
    vectors = r.table(spark, sf, "embeddings").select(F.col("vec_id").alias("c_custkey"), "embedding")
    asked = r.table(spark, sf, "customer").join(vectors, "c_custkey", "left")
    width = F.when(F.col("c_custkey") % 6 == 1, 3).when(F.col("c_custkey") % 6 == 2, 0).otherwise(F.size("embedding"))
    named = search.argument_problems(
        F.col("c_custkey") % 4, F.col("c_nationkey") % 5 - 1, F.col("c_custkey") % 130, F.slice("embedding", F.lit(1), width), 64
    )
    return asked.select("c_custkey", F.array_join(named, ",").alias("problems"))


_GUARDS_SQL = """
WITH a AS (SELECT c_custkey, c_nationkey, CASE c_custkey % 6 WHEN 1 THEN embedding[1:3] WHEN 2 THEN embedding[1:0] ELSE embedding END AS query
FROM customer LEFT JOIN embeddings ON c_custkey = vec_id)
SELECT c_custkey, concat_ws(',', CASE WHEN c_custkey % 4 < 1 THEN 'limit' END, CASE WHEN c_nationkey % 5 - 1 < 1 THEN 'cap' END,
 CASE WHEN c_custkey % 130 NOT BETWEEN 1 AND 100 THEN 'pool' END, CASE WHEN coalesce(len(query), 0) = 0 THEN 'query' END,
 CASE WHEN len(query) > 0 AND len(query) <> 64 THEN 'width' END) AS problems FROM a
"""


def batch(spark, sf):
    return search.batch_top_k(r.listings(spark, sf), r.requests(spark, sf), 5)


_PAIRS_SQL = f"SELECT q.request_id, CAST(l.id AS INT) AS id, {_DQ} AS distance FROM q JOIN l ON {_MATCH_Q} WHERE l.embedding IS NOT NULL"


def _best(sql, keys, k):
    return (
        f"SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY {keys} ORDER BY distance, id) AS INT) AS place "
        f"FROM ({sql})) WHERE place <= {k}"
    )


def per_branch(spark, sf):
    return search.branch_top_k(r.listings(spark, sf), r.requests(spark, sf), 3)


_BRANCH_COUNT = " * ".join(f"greatest(len(list_distinct(q.{f})), 1)" for f in filters.ANY_OF)
_PIN = " || '/' || ".join(
    f"CASE WHEN len(list_distinct(q.{f})) = 1 THEN CAST(q.{f}[1] AS VARCHAR) "
    f"WHEN len(q.{f}) > 0 AND {_BRANCH_COUNT} <= {config.FANOUT_CAP} THEN CAST(l.{c} AS VARCHAR) ELSE '*' END"
    for f, c in filters.ANY_OF.items()
)
_BRANCH_SQL = f"SELECT q.request_id, {_PIN} AS branch, CAST(l.id AS INT) AS id, {_DQ} AS distance FROM q JOIN l ON {_MATCH_Q} WHERE l.embedding IS NOT NULL"


def merged(spark, sf):
    return search.merge_branches(per_branch(spark, sf), 3)


def plan(spark, sf):
    out = search.plan_report(r.filter_sets(spark, sf, "customer"), indexed_amenities=("ring",))
    return out.withColumns({c: F.array_join(c, ",") for c in ("post_filter_columns", "null_excluding_columns")})


_REQ = " * ".join(f"greatest(len(list_distinct({f})), 1)" for f in filters.ANY_OF)
_LATE = "list_filter([CASE WHEN len(list_filter(amenities, lambda a: a <> 'ring')) > 0 THEN 'amenities' END, " + ", ".join(
    f"CASE WHEN {_REQ} > {config.FANOUT_CAP} AND len(list_distinct({f})) > 1 THEN '{c}' END" for f, c in filters.ANY_OF.items()
) + "], lambda x: x IS NOT NULL)"
_NULLS = "list_filter([" + ", ".join(
    f"CASE WHEN {f} IS NOT NULL THEN '{c}' END" for f, (c, _) in filters.BOUNDS.items() if c in filters.NULLABLE
) + "], lambda x: x IS NOT NULL)"
_PLAN_SQL = (
    f"SELECT request_id, CAST({_REQ} AS BIGINT) AS requested_branches, CAST({config.FANOUT_CAP} AS INT) AS cap, {_REQ} > {config.FANOUT_CAP} AS capped, "
    f"CAST(CASE WHEN {_REQ} > {config.FANOUT_CAP} THEN 1 ELSE {_REQ} END AS BIGINT) AS queries, array_to_string(list_sort({_LATE}), ',') AS post_filter_columns, "
    f"array_to_string(list_sort(list_distinct({_NULLS})), ',') AS null_excluding_columns, {_EMPTY_SQL} AS unconstrained "
    f"FROM ({r.filter_sets_sql('customer')})"
)


def post_filter(spark, sf):
    return search.post_filter_top_k(r.listings(spark, sf), r.requests(spark, sf), 5, 50)


def post_filter_of_cells(spark, sf):
    """The same, with the pools from stored cells that leave out what cannot reach into them."""
    listings, asked = r.listings(spark, sf), r.requests(spark, sf)
    pools = cells.nearest(cells.build(listings, 5), asked, 50)
    return search.post_filter_top_k(listings, asked, 5, 50, pools)


_NEAR_SQL = f"SELECT q.request_id, CAST(l.id AS BIGINT) AS id, {_DQ} AS distance, {_MATCH_Q} AS ok FROM q, l WHERE l.embedding IS NOT NULL"
_POST_SQL = (
    "SELECT * FROM (SELECT request_id, id, distance, CAST(row_number() OVER (PARTITION BY request_id ORDER BY distance, id) AS INT) AS place "
    f"FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY distance, id) AS rank FROM ({_NEAR_SQL})) WHERE rank <= 50 AND ok) WHERE place <= 5"
)


def widening(spark, sf):
    return search.widening_top_k(r.listings(spark, sf), r.requests(spark, sf), 5, 50)


_WIDE_SQL = (
    f"w AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY distance, id) AS rank, count(*) OVER (PARTITION BY request_id) AS total FROM ({_NEAR_SQL})), "
    "m AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY distance, id) AS place FROM w WHERE ok) "
    "SELECT request_id, CAST(id AS INT) AS id, distance, CAST(place AS INT) AS place, CAST(least(coalesce(max(CASE WHEN place = 5 THEN ceil(rank / 50.0) * 50 END) OVER (PARTITION BY request_id), total), total) AS BIGINT) AS pool_used "
    "FROM m WHERE place <= 5"
)


def _approximate(spark, sf):
    listings, asked = r.listings(spark, sf), r.requests(spark, sf)
    found = cells.top_k(cells.build(listings, 5), asked, 5)
    return listings, asked, stable(found)


def approximate(spark, sf):
    """Per request: how many the cells found, and how many of them break a filter or misstate a distance."""
    listings, asked, found = _approximate(spark, sf)
    matching = filters.keep_matching(found, listings.drop("embedding"), asked.drop("query")).select("request_id", "id", F.lit(True).alias("matches"))
    pairs = found.join(asked.select("request_id", "query"), "request_id").join(listings.select("id", "embedding"), "id")
    dot, left, right = (
        F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
        for a, b in (("embedding", "query"), ("embedding", "embedding"), ("query", "query"))
    )
    off = F.abs(1 - dot / F.sqrt(left * right) - F.col("distance")) > 1e-8
    told = pairs.withColumn("off", off).join(matching, ["request_id", "id"], "left")
    wrong = F.count_if(F.col("matches").isNull() | F.col("off"))
    return told.groupBy("request_id").agg(F.count("*").alias("found"), wrong.alias("wrong"))


def approximate_recall(spark, sf):
    """Whether the cells reach nine tenths of the exact top five, over all requests with a match."""
    listings, asked, found = _approximate(spark, sf)
    recall = evaluation.recall_at_k(found, search.batch_top_k(listings, asked, 5), 5)
    return recall.agg(F.count("*").alias("requests"), (F.avg("recall") >= 0.9).alias("reached"))


def _names(spark, sf):
    part = r.table(spark, sf, "part")
    places = part.selectExpr("CAST(substr(p_brand, 7) AS INT) AS id", "p_brand AS name").distinct()
    numbers = part.selectExpr("CAST(p_size % 7 + 1 AS INT) AS id").distinct()
    named = numbers.withColumn("name", F.concat(F.lit("kind "), "id"))
    return places, named, named


_CITED = ("id", "name", "neighbourhood", "room_type", "property_type", "price_gbp")


def _coded(spark, sf):
    return r.listings(spark, sf).drop("neighbourhood", "room_type", "property_type")


def cited(spark, sf):
    """Every listing with its dimension names, as a citation shows it."""
    return search.decode_dimensions(_coded(spark, sf), *_names(spark, sf)).select(*_CITED)


def looked_up(spark, sf):
    """The listings that the twenty largest orders cite by id, and an id no listing has."""
    top = r.table(spark, sf, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)
    ids = [row[0] for row in top.select(F.col("o_orderkey") % 1000 + 1).collect()]
    return search.get_listings(_coded(spark, sf), [*ids, -1], *_names(spark, sf)).select(*_CITED)


def shown_reviews(spark, sf):
    reviews = r.table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.lit(1).alias("listing_id"), F.col("n_chars").alias("date"),
        F.concat(F.lit("Thanks to Maria, "), "text").alias("comments"),
    )
    return search.get_reviews(reviews, [1], 20).select("id", F.md5("comments").alias("digest"))


_NAMED = (
    r"regexp_replace(regexp_replace({c}, '\b((?i:hosted by|stayed with|thank you|thanks to|thanks|our hosts?|the hosts?|your hosts?|my hosts?|met|dear|hi|hello)[ ,]+)"
    r"(\p{Lu}\p{Ll}+)\b', '\1[name]', 'g'), "
    r"'\b(\p{Lu}\p{Ll}+)( (?:was|is|were|has been) (?:a|an|the|our|such a)[a-z ]{0,40}\bhosts?\b)', '[name]\2', 'g')"
)


def scrubbed_sql(column: str) -> str:
    return _NAMED.replace("{c}", column)


# --- Relaxation -------------------------------------------------------------------------


def cost(spark, sf):
    return relax.constraint_cost(r.listings(spark, sf, vectors=False), _sets(spark, sf))


def _cost_sql(listings="l", sets="f"):
    parts = []
    for field, term in _T.items():
        others = " AND ".join(t for name, t in _T.items() if name != field)
        parts.append(f"SELECT f.request_id, '{field}' AS field, count(*) AS rows FROM {sets} f JOIN {listings} l ON NOT {term} AND {others} GROUP BY 1")
    return " UNION ALL ".join(parts)


def thin(spark, sf):
    return relax.thin_requests(r.listings(spark, sf, vectors=False), _sets(spark, sf, "customer"))


def _relaxed(spark, sf, rounds=config.MAX_RELAXATIONS):
    return relax.relax(r.listings(spark, sf, vectors=False), _sets(spark, sf), rounds=rounds)


def relaxed(spark, sf):
    return _relaxed(spark, sf).select(
        "request_id", "rounds_used", "matches", "min_price", "max_price", "min_accommodates", "min_rating"
    )


def _moved_sql(field):
    """One loosening of a field, as SQL; the near fields go together."""
    more, less = f"CAST({1 + config.RELAX_STEP} AS DOUBLE)", f"CAST({1 - config.RELAX_STEP} AS DOUBLE)"
    if field in filters.ANY_OF:
        return "CAST([] AS INTEGER[])"
    if field == "amenities":
        return "CAST([] AS VARCHAR[])"
    if field in ("instant_bookable", "host_is_superhost"):
        return "NULL"
    whole = field in ("min_bedrooms", "min_beds", "max_minimum_nights", "min_reviews")
    if field.startswith("max_"):
        return f"CAST(ceil({field} * {more}) AS INTEGER)" if whole else f"{field} * {more}"
    moved = f"floor({field} * {less})" if whole else f"{field} * {less}"
    return f"CASE WHEN {moved} > 0 THEN {f'CAST({moved} AS INTEGER)' if whole else moved} END"


def _relaxed_sql(rounds):
    """The rounds written one after another: counts, the worst condition of the thin requests, its loosening."""
    lists = (*filters.ANY_OF, "amenities")
    is_set = {f: f"len({f}) > 0" if f in lists else "near_lat IS NOT NULL" if f == "near" else f"{f} IS NOT NULL" for f in filters.FIELDS}
    order = [f for f in (*filters.BOUNDS, "amenities", "near", *filters.ANY_OF) if f != "min_accommodates"]
    fallback = "CASE " + " ".join(f"WHEN {is_set[f]} THEN '{f}'" for f in order) + " END"
    kept = f"near_km * CAST({1 + config.RELAX_STEP} AS DOUBLE) <= {config.MAX_RADIUS_KM}"
    columns = [f"CASE WHEN picked = '{f}' THEN {_moved_sql(f)} ELSE {f} END AS {f}" for f in order if f != "near"]
    columns += [f"CASE WHEN picked = 'near' AND NOT {kept} THEN NULL ELSE {c} END AS {c}" for c in ("near_lat", "near_lon")]
    columns.append(f"CASE WHEN picked = 'near' THEN CASE WHEN {kept} THEN near_km * CAST({1 + config.RELAX_STEP} AS DOUBLE) END ELSE near_km END AS near_km")
    steps = [f"l AS ({r.LISTINGS_SQL}), f0 AS (SELECT *, 0 AS rounds_used FROM ({r.filter_sets_sql()}))"]
    for i in range(rounds + 1):
        steps.append(f"m{i} AS (SELECT f.request_id, count(l.id) AS matches FROM f{i} f LEFT JOIN l ON {r.MATCH_SQL} GROUP BY 1)")
        if i < rounds:
            steps += [
                f"t{i} AS (SELECT f{i}.* FROM f{i} JOIN m{i} USING (request_id) WHERE matches < {config.THIN_RESULT_THRESHOLD})",
                f"k{i} AS ({_cost_sql('l', f't{i}')})",
                f"p{i} AS (SELECT request_id, arg_max(field, struct_pack(a := rows, b := field)) AS worst FROM k{i} WHERE field <> 'min_accommodates' GROUP BY 1)",
                f"q{i} AS (SELECT request_id, coalesce(worst, {fallback}) AS picked FROM t{i} LEFT JOIN p{i} USING (request_id))",
                f"f{i + 1} AS (SELECT request_id, min_accommodates, {', '.join(columns)}, rounds_used + CASE WHEN picked IS NULL THEN 0 ELSE 1 END AS rounds_used FROM f{i} LEFT JOIN q{i} USING (request_id))",
            ]
    shown = "request_id, CAST(rounds_used AS INT) AS rounds_used, matches, min_price, max_price, min_accommodates, min_rating"
    return f"WITH {', '.join(steps)} SELECT {shown} FROM f{rounds} JOIN m{rounds} USING (request_id)"


def unrelaxed(spark, sf):
    return _relaxed(spark, sf, 0).select("request_id", "rounds_used", "matches")


def party_floor(spark, sf):
    original = _sets(spark, sf, "customer")
    lowered = original.withColumn("min_accommodates", F.col("min_accommodates") - F.col("max_minimum_nights") + 6)
    return relax.party_violations(original, lowered)


def audit(spark, sf):
    """What one round of loosening a fixed field changes in every filter set."""
    sets = _sets(spark, sf, "customer")
    picks = sets.select("request_id", F.lit("max_price").alias("field"))
    moved = relax.loosen(sets.drop("filter_key"), picks).withColumn("rounds_used", F.lit(1))
    counted = counting.count_per_request(r.listings(spark, sf, vectors=False), moved)
    out = relax.audit(sets, moved.join(counted, "request_id"))
    return out.withColumn("changed_fields", F.array_join("changed_fields", ","))


_AUDIT_SQL = (
    f"WITH l AS ({r.LISTINGS_SQL}), f AS (SELECT * REPLACE (max_price * (1 + CAST({config.RELAX_STEP} AS DOUBLE)) AS max_price) FROM ({r.filter_sets_sql('customer')})) "
    "SELECT request_id, CASE WHEN max(max_price) IS NULL THEN '' ELSE 'max_price' END AS changed_fields, CAST(1 AS INT) AS rounds_used, count(l.id) AS matches, "
    f"count(l.id) < 5 AS unsatisfied FROM f LEFT JOIN l ON {r.MATCH_SQL} GROUP BY request_id"
)

_HITS_SQL = f"SELECT f.request_id, l.id FROM f JOIN l ON {r.MATCH_SQL}"
_BOX = {"near": {"latitude": 51.5, "longitude": -0.1, "radius_km": 8.0}}
_LAT_REACH = 8.0 / config.KM_PER_DEGREE_LATITUDE
_BOX_SQL = (
    f"latitude BETWEEN 51.5 - {_LAT_REACH} AND 51.5 + {_LAT_REACH} AND longitude BETWEEN -0.1 - 8.0 / (111.0 * cos(radians(51.5 + {_LAT_REACH}))) "
    f"AND -0.1 + 8.0 / (111.0 * cos(radians(51.5 + {_LAT_REACH})))"
)
QUERIES = {
    "E1_price_range": (_one({"min_price": 920.0, "max_price": 960.5}, "price_gbp"), _one_sql("price_gbp >= 920 AND price_gbp <= 960.5", "price_gbp")),
    "E2_capacity_floors": (
        _one({"min_accommodates": 3, "min_bedrooms": 1, "min_beds": 0, "min_bathrooms": 0.5}),
        _one_sql("accommodates >= 3 AND bedrooms >= 1 AND beds >= 0 AND bathrooms >= 0.5"),
    ),
    "E3_stay_length": (_one({"max_minimum_nights": 5}, "minimum_nights"), _one_sql("minimum_nights <= 5", "minimum_nights")),
    "E4_quality_floors": (
        _one({"min_rating": 3.5, "min_location_score": 3.2, "min_reviews": 30}),
        _one_sql("rating >= 3.5 AND location_score >= 3.2 AND number_of_reviews >= 30"),
    ),
    "E5_boolean_equality": (
        _one({"instant_bookable": False, "host_is_superhost": True}),
        _one_sql("instant_bookable = false AND host_is_superhost = true"),
    ),
    "E6_any_of": (
        _one({"neighbourhood_ids": [3, 11, 24], "room_type_ids": [2], "property_type_ids": [1, 5]}),
        _one_sql("neighbourhood_id IN (3, 11, 24) AND room_type_id = 2 AND property_type_id IN (1, 5)"),
    ),
    "E7_all_amenities": (_one({"amenities": ["ring", "red"]}, "name"), _one_sql("list_has_all(amenities, ['ring', 'red'])", "name")),
    "E8_area_box": (_one(_BOX, "latitude", "longitude"), _one_sql(_BOX_SQL, "latitude", "longitude")),
    "E9_conjunction": (
        _one({**_FLAGSHIP, **_BOX, "min_reviews": 20, "amenities": ["ring"]}),
        _one_sql(f"{_FLAGSHIP_SQL} AND {_BOX_SQL} AND number_of_reviews >= 20 AND list_contains(amenities, 'ring')"),
    ),
    "E9_empty_filter_sets": (empty_sets, f"SELECT request_id, ({_EMPTY_SQL}) AS is_empty FROM ({r.filter_sets_sql('customer')})"),
    "E10_null_report": (null_report, _NULL_SQL),
    "E11_validation": (validation, _VALIDATION_SQL),
    "E12_canonical_sets": (canonical_sets, _CANONICAL_SQL),
    "E13_count_matches": (counts, _COUNTS_SQL),
    "E14_field_stats": (stats, _STATS_SQL),
    "E15_batch_match": (matches, _L + _HITS_SQL),
    "F1_cosine_distance": (distances, _L + f"SELECT id, {_D1} AS distance FROM l WHERE embedding IS NOT NULL"),
    "F2_filtered_top_k": (
        flagship,
        _L + f"SELECT id, name, price_gbp, {_D1} AS distance FROM l WHERE {_FLAGSHIP_SQL} AND embedding IS NOT NULL ORDER BY distance, id LIMIT 10",
    ),
    "F3_branch_top_k": (per_branch, _L + _best(_BRANCH_SQL, "request_id, branch", 3)),
    "F4_branch_merge": (merged, _L + _best(f"SELECT request_id, id, distance FROM ({_best(_BRANCH_SQL, 'request_id, branch', 3)})", "request_id", 3)),
    "F5_plan_report": (plan, _PLAN_SQL),
    "F6_argument_guards": (guards, _GUARDS_SQL),
    "F7_batch_top_k": (batch, _L + _best(_PAIRS_SQL, "request_id", 5)),
    "F8_post_filter": (post_filter, _L + _POST_SQL),
    "F8_pools_of_cells": (post_filter_of_cells, _L + _POST_SQL),
    "F9_widening": (widening, _L[:-1] + ", " + _WIDE_SQL),
    "F10_candidate_pool": (
        pool,
        _L + f"SELECT {', '.join(search.RESULT_COLUMNS)}, {_D1} AS distance FROM l WHERE accommodates >= 2 AND embedding IS NOT NULL ORDER BY distance, id LIMIT 100",
    ),
    "F11_approximate": (approximate, _L + f"SELECT request_id, least(count(*), 5) AS found, CAST(0 AS BIGINT) AS wrong FROM ({_PAIRS_SQL}) GROUP BY 1"),
    "F11_recall": (approximate_recall, _L + f"SELECT count(DISTINCT request_id) AS requests, true AS reached FROM ({_PAIRS_SQL})"),
    "F12_listing_details": (
        cited,
        _L + "SELECT id, name, neighbourhood, concat('kind ', room_type_id) AS room_type, concat('kind ', property_type_id) AS property_type, price_gbp FROM l",
    ),
    "F12_cited_by_id": (
        looked_up,
        _L + "SELECT id, name, neighbourhood, concat('kind ', room_type_id) AS room_type, concat('kind ', property_type_id) AS property_type, price_gbp FROM l "
        "WHERE id IN (SELECT o_orderkey % 1000 + 1 FROM (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20))",
    ),
    "F13_shown_reviews": (
        shown_reviews,
        f"SELECT doc_id AS id, md5({scrubbed_sql(chr(39) + 'Thanks to Maria, ' + chr(39) + ' || text')}) AS digest FROM documents ORDER BY n_chars DESC, doc_id DESC LIMIT 20",
    ),
    "G1_constraint_cost": (cost, _L + _cost_sql()),
    "G2_thin_requests": (
        thin,
        f"WITH l AS ({r.LISTINGS_SQL}), f AS ({r.filter_sets_sql('customer')}) "
        f"SELECT request_id, count(l.id) AS matches FROM f LEFT JOIN l ON {r.MATCH_SQL} GROUP BY 1 HAVING count(l.id) < 5",
    ),
    "G3_relaxation": (relaxed, _relaxed_sql(config.MAX_RELAXATIONS)),
    "G3_without_relaxation": (
        unrelaxed,
        _L + f"SELECT request_id, CAST(0 AS INT) AS rounds_used, count(l.id) AS matches FROM f LEFT JOIN l ON {r.MATCH_SQL} GROUP BY 1",
    ),
    "G4_party_floor": (
        party_floor,
        "SELECT request_id, min_accommodates AS asked, CAST(min_accommodates - max_minimum_nights + 6 AS INT) AS offered "
        f"FROM ({r.filter_sets_sql('customer')}) WHERE min_accommodates IS NOT NULL AND (max_minimum_nights IS NULL OR min_accommodates - max_minimum_nights + 6 < min_accommodates)",
    ),
    "G5_relaxation_audit": (audit, _AUDIT_SQL),
}
