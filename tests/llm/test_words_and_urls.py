"""Ranked search, spelling variants and URL filters against plain versions, on awkward tables."""

import collections
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from small import LOWER, documents, prose, rows, words

from roostline.llm import ranked_search, spelling, url_filter

ITEMS = [(1, prose(9, 30)), (2, "one two ONE"), (3, None), (4, ""), (None, prose(4, 12)), (1, prose(9, 30)), (1, "straße one"), (5, "A line"), (6, "nowhere")]


def brute_search(docs, items, top):
    counts = [(i, collections.Counter(words(t))) for i, t in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    n_docs, n_terms = len(counts), sum(n for _, _, n in counts)
    df = collections.Counter(t for _, c, _ in counts for t in c)
    out = []
    for item in {i for i, _ in items}:
        terms = {t for i, text in items if i == item for t in words(text)}
        scored = []
        for doc, c, n in counts:
            m = 10 + (90 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms & set(c))
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scored)[:top])]
    return sorted(map(str, out))


@pytest.mark.parametrize("top, block_bytes", [(10, 1 << 22), (3, 40)])
def test_ranked_search_is_that_of_brute_force(spark, top, block_bytes):
    items = spark.createDataFrame([(*x, i, "z") for i, x in enumerate(ITEMS)], "item_id long, text string, doc_id int, score string")
    got = ranked_search.search(documents(spark).repartition(3), items, top, block_bytes)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(str(tuple(r)) for r in got.collect()) == brute_search([r[:2] for r in rows()], ITEMS, top)


def test_ranked_search_of_empty_tables(spark):
    none, items = documents(spark, []), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert ranked_search.search(none, items).isEmpty()
    assert ranked_search.search(documents(spark), items.limit(0)).isEmpty()


@pytest.mark.parametrize("seed", range(8))
def test_nra_resolves_members_ties_and_scores(seed):
    rng = np.random.default_rng(seed)
    n, top = 3000, 7
    full = np.zeros((12, n), np.int64)
    lists = []
    for i in range(12):
        docs = rng.permutation(n)[: rng.integers(0, n)]
        full[i, docs] = rng.integers(1, 4 if seed % 2 else 10**6, len(docs))
        docs = docs[np.argsort(-full[i, docs], kind="stable")]
        lists.append((docs, full[i, docs]))
    score = full.sum(0)
    last = np.sort(score)[-top]
    for floor in (1, int(last) + 5):
        found, exact = ranked_search.nra(lists, n, top, floor)
        assert dict(zip(found.tolist(), exact.tolist())) == {i: s for i, s in enumerate(score.tolist()) if s >= max(last, floor)}
    few, _ = ranked_search.nra([(np.array([4, 2]), np.array([9, 3]))], 5, top)
    assert few.tolist() == [2, 4] and len(ranked_search.nra([], 5, top)[0]) == 0


def test_shards_of_a_task_hand_their_best_on():
    texts = ["a b c", "a b", "c", "a a b", "x", "b c", None, "a b c"]
    queries = ranked_search.queries_of(pa.array(["a b", "c", ""]), np.arange(3), 3)
    corpus = ranked_search.Corpus(7, 15, ranked_search.weights_of(7, np.full(len(queries.alphabet), 4)))
    got = []
    shard = ranked_search._Shard(queries, corpus, 2)
    for i, t in enumerate(texts):  # every document a shard
        shard.add(pa.array([100 - i]), pa.array([t], pa.string()))
        got += [r for b in shard.results() for r in b.to_pylist()]
    whole = ranked_search._Shard(queries, corpus, 2)
    whole.add(pa.array([100 - i for i in range(8)]), pa.array(texts, pa.string()))
    want = [r for b in whole.results() for r in b.to_pylist()]
    best = lambda found: [sorted(((-r["score"], r["doc_id"]) for r in found if r["item"] == i))[:2] for i in range(3)]
    assert best(got) == best(want) and len(want) == 4


RUN = re.compile("[A-Za-z\u00c0-\u00ff]+")


def brute_words(docs, min_chars=5, min_count=3):
    out = collections.Counter()
    for i, t in docs:
        for run in RUN.findall(t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            out[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    return {w: n for w, n in out.items() if len(w) >= min_chars and n >= min_count}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(counts):
    near = {w: [v for v in counts if one_apart(w, v)] for w in counts}
    form = {w: min(near[w], key=lambda v: (-counts[v], v)) for w in counts if near[w]}
    form = {w: v for w, v in form.items() if counts[v] >= 2 * counts[w]}
    out = {}
    for w in counts:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, counts[w], len(near[w]), counts[form[w]] if w in form else None)
    return out


def spelled():
    base = ["aaaaaa", "aaaaa", "aabaa", "école", "ecole", "écoles", "éÿécole", "kitten", "kittten", "kittens", "sitten", "mitten", "mittens", "Zürich", "zürich", "zurich"]
    texts = [(" ".join(base[i:] * (i % 5 + 1)) + f" x{i} ×÷aaaa–aaaaa") for i in range(len(base))]
    chain = ["abcdefgh"[:5] + "x" * k for k in range(1, 5)]
    texts.append(" ".join(w + " " for k, w in enumerate(chain) for _ in range(3 * 3**k)))
    words_ = " ".join(prose(500 + i % 7, 60) for i in range(30))
    return [*rows(), *[(1000 + i, t, *[None] * 8) for i, t in enumerate([*texts, words_, "ab" * 3000 + " kitten" * 2])]]


def test_spelling_variants_are_those_of_brute_force(spark):
    data = spelled()
    counts = brute_words([r[:2] for r in data])
    want = brute_variants(counts)
    got = spelling.variants(documents(spark, data)).collect()
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == want and len(got) == len(want)
    assert max(len({k for k in want if want[k][1] == r}) for r in {v[1] for v in want.values()}) > 3
    assert spelling.variants(documents(spark, [])).isEmpty()


def test_checksums_are_those_of_zlib():
    texts = ["word", "", "é", "x" * 300, "y" * 64, "z" * 65]
    raw = [t.encode() for t in texts]
    end = np.cumsum([len(r) for r in raw])
    before = np.array([zlib.crc32(b"7:"), 0, 5, zlib.crc32(b":"), 1, 2], np.uint32)
    got = spelling.checksums(before, np.frombuffer(b"".join(raw), np.uint8), end - [len(r) for r in raw], end)
    assert got.tolist() == [zlib.crc32(r, int(b)) for r, b in zip(raw, before)]


def test_the_scan_keeps_the_ranges_it_is_given(spark):
    plan = spelling.near_words(spark.createDataFrame([("words", 3)], "word string, n long"))._jdf.queryExecution().toString()
    assert plan.count("Exchange hashpartitioning(prefix") == 0 and "rangepartitioning(prefix" in plan


URLS = [
    "http://a.example.net/en/1", "http://a.example.net/de/1", "https://EXAMPLE.net/en/", "http://example.com/de/x?y#z", "http://badexample.com/de/", "http://x.org/fr/",
    "http://x.org/en/", "ftp://u@w.co.uk:80/p", "net/", None, "", "http://net", "http://10.0.0.1/a", "http://x.net?q://z/", "a://b://c/d", "HTTP://Ünï.DE/Ä", "://", "http://x.net\n/de/",
]


def brute_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest)[0]
    return host.translate(LOWER), re.split("[?#]", rest[len(host) :])[0]


def brute_rule(host, path):
    fit = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else (None, None)


def page(i, url, text):
    return (i, url, None if text is None else f"<p>menu</p><article><h1>Head</h1><p>{text}</p></article>", "x", True)


PAGES = "page_id long, url string, html string, host string, bad boolean"


def test_urls_are_judged_by_rules_then_by_reputation(spark):
    texts = {i: prose(700 + i, 15) for i in range(60)}
    docs = [(i, t.replace(" ", ", ") + "!", "en", "s", 1, 1, 0.1, 1, "n", "r") for i, t in texts.items()] + [(None, texts[3], *[None] * 8), (200, None, *[None] * 8)]
    marks = [(i, 0 if i < 20 else 1, 0) for i in range(40)] + [(40, None, 1), (41, None, None), (None, 0, 1), (25, 1, 0), (200, 0, 0)]
    pages = [page(i, u, None) for i, u in enumerate(URLS)]
    pages += [page(100 + i, f"http://spam.example.com/{i}", texts[i % 20]) for i in range(60)]
    pages += [page(200 + i, f"http://good{i % 3}.example.com/{i}", texts[20 + i % 20]) for i in range(90)]
    pages += [page(300, "http://one.example.com/", texts[0]), page(None, "http://spam.example.com/en/", ""), page(302, "http://spam.example.com/de/", texts[50])]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    table = spark.createDataFrame(pages, PAGES)
    outcomes = url_filter.text_outcomes(documents(spark, docs), labels)
    found = {r.host: r for r in url_filter.reputations(table, outcomes).collect()}
    assert set(found) == {brute_parts(p[1])[0] for p in pages}
    assert (found["spam.example.com"].n, found["spam.example.com"].bad) == (60, 60) and found["good0.example.com"].bad == 0
    assert [h for h, r in found.items() if r.blocked] == ["spam.example.com"] and found["one.example.com"].n == 1
    got = url_filter.judged(table, url_filter.reputations(table, outcomes)).collect()
    want = []
    for p in pages:
        host, path = brute_parts(p[1])
        rule, said = brute_rule(host, path)
        want.append((p[0], host, path, rule, said or ("block" if host == "spam.example.com" else "allow")))
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))


def test_posterior_bounds_are_those_of_the_beta_distribution(spark):
    cases = [(1.0, 1.0), (2.0, 5.0), (61.0, 2.0), (0.3, 0.9), (400.0, 1600.0)]
    frame = spark.createDataFrame(cases, "a double, b double")
    for r in frame.select("a", "b", url_filter.lower_bound(frame.a, frame.b).alias("x")).collect():
        z = np.linspace(-60, 60, 400_001)
        weight = -r.a * np.logaddexp(0, -z) - r.b * np.logaddexp(0, z)
        weight = np.exp(weight - weight.max())
        share = np.cumsum(weight) / weight.sum()
        exact = 1 / (1 + math.exp(-z[np.searchsorted(share, 0.05)]))
        assert abs(r.x - exact) < 0.01 + 0.05 * exact


def test_domains_and_suffixes(spark):
    hosts = {"a.b.example.com": ("example.com", "com"), "x.co.uk": ("x.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "u@w.x.de:80": ("x.de", "de"), "10.0.0.1:8": ("10.0.0.1", "10.0.0.1"), "host": ("host", "host"), "": ("", ""), "x.y.com.": ("y.com", "com")}
    frame = spark.createDataFrame([(h,) for h in hosts], "host string")
    domain, suffix = url_filter.domain_and_suffix(frame.host)
    assert {r.host: (r.d, r.s) for r in frame.select("host", domain.alias("d"), suffix.alias("s")).collect()} == hosts


def test_url_filter_of_empty_tables_and_plans_without_python(spark):
    none = spark.createDataFrame([], PAGES)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    outcomes = url_filter.text_outcomes(documents(spark), labels)
    assert url_filter.judged(none, url_filter.reputations(none, outcomes)).isEmpty()
    table = spark.createDataFrame([page(i, u, "text") for i, u in enumerate(URLS)], PAGES)
    judged = url_filter.judged(table, url_filter.reputations(table, outcomes))
    assert not re.search("Python|Arrow|Pandas", judged._jdf.queryExecution().toString()) and judged.count() == len(URLS)
