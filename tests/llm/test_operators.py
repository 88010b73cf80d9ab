"""Each operator against a plain version, on awkward tables and on empty ones."""

import collections
import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from small import documents, labels, prose, rows, words

from roostline.llm import (
    batches, decontaminate, features, fm_index, html_text, kd_shards, license_scan, line_dedup, mixing, near_dup, nearest, quality, toxicity,
)


def test_words_of_a_batch_are_those_of_the_pattern():
    texts = [r[1] for r in rows()]
    w = batches.words(pa.array(texts, pa.string()))
    got = [[w.low[s:e].tobytes().decode() for s, e in zip(w.start[a:b], w.end[a:b])] for a, b in zip(w.first[:-1], w.first[1:])]
    assert got == [words(t) for t in texts]
    h = batches.hashes(w)
    flat = [x for t in got for x in t]
    assert len(set(h.tolist())) == len(set(flat)) == len(set(zip(flat, h.tolist())))


@pytest.mark.parametrize("seed", range(6))
def test_fm_index_finds_and_locates_all(seed):
    rng = np.random.default_rng(seed)
    tokens = np.append(rng.integers(0, 4, 400), 0)
    tokens[100:180] = tokens[:80]
    index = fm_index.FMIndex(tokens, 3, sample=8)
    phrases = np.array([[a, b, c] for a in (1, 2, 3) for b in (1, 2, 3) for c in (0, 1, 2, 3)])
    low, high = index.search(phrases, (phrases > 0).sum(1))
    for p, a, b in zip(phrases, low, high):
        p = p[p > 0]
        want = [i for i in range(len(tokens) - len(p) + 1) if (tokens[i : i + len(p)] == p).all()]
        assert sorted(index.locate(np.arange(a, max(a, b))).tolist()) == want


BENCHMARK = [(1, prose(9, 30)), (2, "one two"), (3, None), (4, ""), (None, prose(4, 12)), (1, prose(9, 30)), (50, "nowhere " * 12)]


def brute_hits(text, items):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        v = words(t)
        size = min(10, len(v))
        for p in range(len(v) - size + 1 if size else 0):
            for q in range(len(w) - size + 1):
                if w[q : q + size] == v[p : p + size]:
                    hit.update(range(q, q + size))
                    found |= {str(item)} if item is not None else set()
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block_bytes", [1 << 24, 60])
def test_decontamination_is_that_of_brute_force(spark, block_bytes):
    bench = spark.createDataFrame(BENCHMARK, "item_id long, text string")
    got = decontaminate.contaminated(documents(spark), bench, block_bytes=block_bytes).collect()
    assert len(got) == len(rows())
    for r in got:
        n, hit, items = brute_hits(r.row.text, BENCHMARK)
        assert (r.result.n_words, r.result.n_hit, r.result["items"]) == (n, hit, items)
    clean = {r.doc_id: r for r in decontaminate.without_spans(documents(spark), bench, block_bytes=block_bytes).collect()}
    assert words(clean[13].text) == words(prose(3, 40)) and clean[13].n_chars == len(clean[13].text)
    assert clean[4].text == prose(1, 6000) and clean[1].text is None and clean[10].text == ""


def test_line_dedup_is_that_of_brute_force(spark):
    docs = documents(spark)
    key = lambda line: line.strip(line_dedup.SPACES).translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    distinct = {(r[0], r[1] or "") for r in rows()}
    for least in (2, 10):
        count = collections.Counter(k for _, t in distinct for k in {key(x) for x in t.split("\n")} if k)
        joined = line_dedup.with_bitmaps(docs, line_dedup.keep_bitmaps(docs, least))
        for r in joined.collect():
            kept, n = line_dedup.kept_lines(r.text, r.keep)
            lines = (r.text or "").split("\n")
            assert kept == [x for x in lines if count[key(x)] < least] and n == len(lines)
    first = line_dedup.with_bitmaps(docs, line_dedup.keep_bitmaps(docs, 10, keep_first=True)).where("doc_id >= 100").collect()
    assert sum("common line" in line_dedup.kept_lines(r.text, r.keep)[0] for r in first) == 1


@pytest.mark.parametrize("parts", [1, 3, 40])
@pytest.mark.parametrize("batch", ["1", "7", "10000"])
def test_lines_are_judged_alike_however_they_are_cut(spark, parts, batch):
    lines = ["every one", "some", "few", "", "one here", " SOME "]
    texts = [(i % 60 if i % 9 else None, "\n".join(lines[k] for k in range(6) if (i % 60) % (k * k + 1) == 0)) for i in range(180)]
    docs = spark.createDataFrame([*texts, (7, None), (8, None)], "doc_id long, text string").repartition(4)
    distinct = {(d, t or "") for d, t in [*texts, (7, None), (8, None)]}
    keys = lambda t: [x.strip(line_dedup.SPACES).lower() for x in t.split("\n")]
    count = collections.Counter(k for _, t in distinct for k in set(keys(t)) if k)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    try:
        for (k, _), v in zip(before.items(), (str(parts), batch)):
            spark.conf.set(k, v)
        for least in (1, 3, 25):
            got = line_dedup.keep_bitmaps(docs, least).collect()
            assert len(got) == len({(r.doc_id, r.text_hash) for r in got})
            bits = {(r.doc_id, t): r for r in line_dedup.with_bitmaps(docs, spark.createDataFrame(got, "doc_id long, text_hash long, n_dropped long, keep binary")).collect() for t in [r.text or ""]}
            for d, t in distinct:
                want = [x for x, k in zip(t.split("\n"), keys(t)) if count[k] < least]
                assert line_dedup.kept_lines(t, bits[d, t].keep)[0] == want
                assert (bits[d, t].n_dropped or 0) == len(t.split("\n")) - len(want)
            first = line_dedup.keep_bitmaps(docs, least, keep_first=True).agg({"n_dropped": "sum"}).first()[0] or 0
            assert first == sum(r.n_dropped for r in got) - sum(n >= least for n in count.values())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_few_rows_are_learned_from_however_often_an_id_is_repeated(spark):
    docs = spark.createDataFrame([(1, f"text {i % 50}", 5) for i in range(5000)] + [(2, None, None), (None, "x", 1)], "doc_id long, text string, n_chars long")
    marks = spark.createDataFrame([(1, 1), (2, 1), (1, 1)], "doc_id long, toxic int")
    drawn = features.labelled(docs, marks, "toxic", 1, 10, 3)
    assert sorted(r.doc_id for r in drawn.collect()) == [1, 2] and "n_chars" in drawn.columns
    assert drawn.collect() == drawn.collect()


@pytest.mark.parametrize("cell", [near_dup.CELL, 2])
def test_near_duplicates_are_the_components_of_all_similar_pairs(spark, monkeypatch, cell):
    monkeypatch.setattr(near_dup, "CELL", cell)
    base = prose(70, 60).split()
    extra = [(200 + i, " ".join([*base[: 60 - i], *prose(300 + i, i).split()]), "en", "s", 1, 1, 0.1, 1, "x", "y") for i in range(30)]
    data = rows() + extra
    sets = {}
    for r in data:
        w = words(r[1])
        sets[r[0]] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            if a != b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                parent[top(a)] = top(b)
    got = {}
    for r in near_dup.classes(documents(spark, data)).collect():
        got.setdefault(bytes(r.root) if r.root else ("own", r.doc_id), set()).add(r.doc_id)
    want = collections.defaultdict(set)
    for i in sets:
        want[top(i)].add(i)
    assert sorted(map(str, got.values())) == sorted(map(str, want.values()))
    kept = near_dup.without_copies(documents(spark, data))
    assert kept.columns == documents(spark).columns
    ids = collections.Counter(r.doc_id for r in kept.collect())
    assert set(ids) == {min(g, key=lambda i: (i is None, i or 0)) for g in want.values()} and set(ids.values()) == {1}


def test_texts_that_repeat_a_passage_are_linked_by_their_sets(spark):
    data = []
    for i, (block, times) in enumerate([(20, 100)] * 8 + [(20, 30)] * 8 + [(20, 5)] * 2):
        shared = prose(4000 + i, 104)
        repeated = " ".join([prose(5000 + i, block)] * times)
        data += [(2 * i, shared), (2 * i + 1, shared + " " + repeated)]
    for a, b in zip(data[::2], data[1::2]):
        x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (words(a[1]), words(b[1])))
        assert len(x & y) >= 0.8 * len(x | y)
    df = spark.createDataFrame(data, "doc_id long, text string")
    root = {r.doc_id: r.root for r in near_dup.classes(df).collect()}
    assert all(root[a[0]] == root[b[0]] for a, b in zip(data[::2], data[1::2]))
    assert len(set(root.values())) == len(data) // 2


def test_sketches_estimate_the_probability_similarity():
    rng = np.random.default_rng(5)
    a = rng.integers(1, 2**63, 900).astype(np.uint64)
    b = np.concatenate([a[:600], rng.integers(1, 2**63, 300).astype(np.uint64)])
    s = near_dup.sketches(np.repeat([0, 1], 900), np.concatenate([a, b]), 2, registers=2000)
    assert abs((s[0] == s[1]).mean() - 600 / 1200) < 0.05 and (s > 0).all()


def test_license_scan_counts_base_phrases_and_resolves_overlaps(spark):
    texts = [
        None, "", "MIT License", "mit, license; the MIT-License", "Licensed under the Apache License, Version 2.0.", "the permit license",
        "SPDX-License-Identifier: MIT", "GNU General Public License v3 or GNU Lesser General Public License", "x " * 30000 + "general public\nlicense",
    ]
    got = [r.result for r in license_scan.scan(spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)).collect()]
    assert [r.n_base for r in got] == [0, 0, 1, 2, 1, 0, 0, 2, 1]
    assert (got[3].first_word, got[3].last_word, got[8].first_word) == (0, 3, 30000)
    assert got[4].labels == ["apache", "apache-2.0"] and got[4].base_labels == ["apache"]
    assert [d.label for d in got[4].detections] == ["apache-2.0"] and got[6].labels == ["mit"] or got[6].labels == ["mit-license"]
    assert got[0].score == got[5].score == 0 and all(0 <= r.score <= 1 for r in got)
    assert len(license_scan.rules()) > 300
    assert license_scan.resolved([(0, 9, 1, 1), (2, 5, 1, 2), (2, 5, 3, 3), (8, 12, 1, 4)]) == [(0, 9, 1, 1), (2, 5, 3, 3), (8, 12, 1, 4)]


def test_shards_hold_near_equal_bytes_and_gapless_slots(spark):
    data = [(i, prose(i % 300, 20 + i % 50), "en", "s", 1, 1, 0.1, 1, "x", "y") for i in range(900)] + rows()
    docs = documents(spark, data)
    shard = kd_shards.shard_column(docs, 8)
    crc = kd_shards.F.crc32(kd_shards.F.encode(kd_shards.F.coalesce(kd_shards.F.col("text"), kd_shards.F.lit("")), "utf-8"))
    got = kd_shards.numbered(docs.select("doc_id", kd_shards.size_of().alias("size"), crc.alias("text_crc32"), shard.alias("shard"))).collect()
    size, slots = collections.Counter(), collections.defaultdict(list)
    for r in got:
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert len(got) == len(data) and set(size) <= set(range(8))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    most = max(len((r[1] or "").encode()) for r in data)
    assert max(size.values()) < sum(size.values()) / 8 + 2 * most
    assert sorted(r.text_crc32 for r in got) == sorted(zlib.crc32((r[1] or "").encode()) for r in data)


def test_mixing_meets_its_targets(spark):
    data = [(i, prose(i, 1 + i * 7 % 90), "en", f"s{i % 7}" if i % 11 else None, 1, 1, 0.1, 1, "x", "y") for i in range(1500)] + rows()
    docs = documents(spark, data)
    got = mixing.copies(mixing.sized(docs), chunk_rows=50, fan_in=4).collect()
    assert len(got) == len(data)
    again = mixing.copies(mixing.sized(docs), chunk_rows=50, fan_in=4).collect()
    plain = lambda x: sorted((str(r.doc_id), r.text_hash, r.copies) for r in x if r.text_hash)
    assert plain(got) == plain(again)
    taken, target = collections.Counter(), {}
    for r in got:
        assert 0 <= r.copies <= 3
        taken[r.source] += r.copies * r["size"]
        target[r.source] = r.target
    # Chunks this small leave the root little to make up with: one document at most is off.
    assert all(abs(taken[s] - target[s]) <= 6000 for s in target)
    whole = collections.Counter()
    for r in mixing.copies(mixing.sized(docs)).collect():
        whole[r.source] += r.copies * r["size"]
    assert all(abs(whole[s] - target[s]) <= 60 for s in target)
    size = collections.Counter()
    for r in data:
        size[r[3]] += len((r[1] or "").split())
    names = sorted(s for s in size if s is not None) + [None]
    weight, full = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, set()
    while True:
        rest = sum(size.values()) - sum(3 * size[s] for s in full)
        share = rest / sum(weight[s] for s in names if s not in full)
        if not (over := {s for s in names if s not in full and share * weight[s] > 3 * size[s]}):
            break
        full |= over
    assert all(abs(target[s] - (3 * size[s] if s in full else share * weight[s])) < 1e-6 for s in names)
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and out.count() == sum(r.copies for r in mixing.copies(mixing.sized(docs)).collect())


def test_a_row_repeated_often_is_dealt_over_the_chunks(spark, monkeypatch):
    longest = spark.sparkContext.accumulator(0)
    inner = mixing._round

    def watched(last, seed):
        run = inner(last, seed)

        def counting(rows):
            out = run(rows)
            longest.add(int(len(out) > 400))
            return out

        return counting

    monkeypatch.setattr(mixing, "_round", watched)
    data = [(1, "the same words again", "en", "s1", 1, 1, 0.1, 1, "x", "y")] * 2000
    data += [(i, prose(i, 3 + i % 20), "en", "s1" if i % 2 else "s2", 1, 1, 0.1, 1, "x", "y") for i in range(2, 2000)]
    got = mixing.copies(mixing.sized(documents(spark, data)), chunk_rows=100, fan_in=8).collect()
    assert longest.value == 0 and len(got) == len(data)
    same = [r for r in got if r.doc_id == 1]
    assert sorted(r.nth for r in same) == list(range(2000)) and max(r.copies for r in same) - min(r.copies for r in same) <= 1
    for source in ("s1", "s2"):
        rows_ = [r for r in got if r.source == source]
        assert rows_[0].source_size == sum(r["size"] for r in rows_)
        assert abs(sum(r.copies * r["size"] for r in rows_) - rows_[0].target) <= 60
    out = mixing.mixed(documents(spark, data)).groupBy("doc_id").count().where("doc_id = 1").first()
    assert out["count"] == sum(r.copies for r in mixing.copies(mixing.sized(documents(spark, data))).where("doc_id = 1").collect())


PAGE = (
    "<html><head><title>t</title><script>var t='</p>';</script></head><body><header>Site name</header><nav><a>Home</a></nav>{}"
    "<footer>&copy; all of it</footer></body></html>"
)


def test_main_text_of_articles_and_of_pages_without(spark):
    menu = "<div>go to the start of this big site now</div>"
    article = "<article><header><h1>A  &amp; B</h1></header><p><b>One<br>two<p>three<div class='ad'>buy</div><ul><li>x<li>y</ul><section id=comments><p>me too</section></article>"
    pages = [
        (1, "http://h/1", PAGE.format(article)), (2, "http://h/2", None), (3, None, ""), (4, "http://h/4", PAGE.format(menu + "<p>own words of the fourth page</p>")),
        (5, "http://h/5", PAGE.format(menu + "<div>other words stand on this one</div>")), (6, "http://h/6", "<p>broken <a href='x"), (5, "http://h/5", PAGE.format(menu + "<div>other words stand on this one</div>")),
        (7, "http://g/7", PAGE.format("<article></article><p>aside from it</p>")), (None, "http://h/8", "<main>nobody" + " long" * 50000 + "</main>"),
    ]
    for part_tokens in (500_000, 12):
        df = spark.createDataFrame(pages, "page_id long, url string, html string")
        parsed = html_text.main_text(df) if part_tokens > 100 else None
        if parsed is None:
            import roostline.llm.html_text as module

            whole = module.PART_TOKENS
            module.covered_runs.__defaults__ = (module.RUN, module.PAGES, part_tokens)
            try:
                parsed = html_text.main_text(df)
                got = {r.page_id: r.text for r in parsed.collect()}
            finally:
                module.covered_runs.__defaults__ = (module.RUN, module.PAGES, whole)
        else:
            got = {r.page_id: r.text for r in parsed.collect()}
            assert parsed.count() == len(pages)
        assert got[1] == "A & B\n\nOne two\n\nthree\n\nx\n\ny"
        assert got[2] == got[3] == ""
        assert got[4] == "own words of the fourth page" and got[5] == "other words stand on this one"
        assert got[6].startswith("broken") and got[None] == "nobody" + " long" * 50000


@pytest.mark.parametrize("part_tokens", [html_text.PART_TOKENS, 150])
def test_pages_without_articles_lose_only_what_a_share_of_the_host_has(spark, monkeypatch, part_tokens):
    monkeypatch.setattr(html_text.covered_runs, "__defaults__", (html_text.RUN, html_text.PAGES, part_tokens))
    phrase, notice = "on the other hand it is", prose(80, 30)
    own = [f"{prose(600 + i, 20)} {phrase if i < 2 else prose(800 + i, 6)} {prose(700 + i, 20)}" for i in range(40)]
    # A short menu and a notice within a longer block are on all pages; two pages share a whole block.
    page = lambda i: PAGE.format(f"<div>all our pages</div><p>{own[i]}</p><p>end {i} {notice} {i}</p>" + ("<p>a block of two pages</p>" if i < 2 else ""))
    data = [(i, f"http://h/{i}", page(i)) for i in range(40)] + [(50 + i, f"http://h/copy{i}", page(3)) for i in range(9)]
    data += [(70 + i, f"http://copies/{i}", PAGE.format("<p>the same page under two ids without any article</p>")) for i in range(2)]
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(data, "page_id long, url string, html string")).collect()}
    for i in range(40):
        assert got[i] == f"{own[i]}\n\nend {i} {i}" + ("\n\na block of two pages" if i < 2 else "")
    assert {got[50 + i] for i in range(9)} == {got[3]}
    assert got[70] == got[71] == "the same page under two ids without any article"


def test_repeated_runs_and_equal_blocks_are_those_of_brute_force():
    rng = np.random.default_rng(4)
    for run in (2, 3, 5):
        blocks = [[int(x) for x in rng.integers(2, 5, rng.integers(1, 9))] for _ in range(60)]
        owner = [int(x) for x in np.sort(rng.integers(0, 12, 60))]
        tokens = np.array([t for b in blocks for t in (1, *b, 0)])
        page = np.array([p for b, p in zip(blocks, owner) for _ in range(len(b) + 2)])
        want, whole = collections.defaultdict(set), collections.defaultdict(set)
        for b, p in zip(blocks, owner):
            whole[tuple(b)].add(p)
            for i in range(len(b) - run + 1):
                want[tuple(b[i : i + run])].add(p)
            if len(b) < run:
                want[(1, *b, 0)].add(p)
        start, number, count = html_text.repeated(tokens, page, run)
        text = lambda i: tuple(tokens[i : i + run]) if tokens[i] != 1 else tuple(tokens[i : i + 1 + list(tokens[i:]).index(0)])
        assert {text(i): count[n] for i, n in zip(start, number)} == {k: len(v) for k, v in want.items()}
        assert len({(text(i), n) for i, n in zip(start, number)}) == len(want)
        start, number, count = html_text.equal_blocks(tokens, page, fm_index.suffix_order(tokens))
        block = lambda i: tuple(tokens[i + 1 : i + list(tokens[i:]).index(0)])
        assert len(start) == 60 and {block(i): count[n] for i, n in zip(start, number)} == {k: len(v) for k, v in whole.items()}


@pytest.mark.parametrize("part_tokens", [html_text.PART_TOKENS, 150])
def test_blocks_of_most_articles_of_a_host_are_furniture(spark, monkeypatch, part_tokens):
    monkeypatch.setattr(html_text.covered_runs, "__defaults__", (html_text.RUN, html_text.PAGES, part_tokens))
    line, shared = "Subscribe to our newsletter today", prose(81, 60)
    # A sign-up line on all pages of a host, a passage on four of twelve; eight near copies of one story on another host.
    text = lambda i: f"<article><p>{prose(900 + i, 30)}</p><p>{line}</p>" + f"<p>{shared}</p>" * (i < 4) + "</article>"
    data = [(i, f"http://h/{i}", PAGE.format(text(i)), "x") for i in range(12)]
    copy = lambda i: f"<article><p>{prose(950, 50)}</p><p>{prose(951, 50)}</p><p>end {i}</p></article>"
    data += [(20 + i, f"http://c/{i}", PAGE.format(copy(i)), "x") for i in range(8)]
    # Four pages are too few for a verdict, and equal pages are one.
    data += [(40 + i, f"http://f/{i % 4}", PAGE.format(text(20 + i % 4)), "x") for i in range(40)]
    # A host without anything to tell.
    data += [(100 + i, f"http://n/{i}", PAGE.format(f"<article>{prose(990 + i, 9)}</article>").replace("&copy; all of it", "").replace("Site name", "").replace("Home", ""), "x") for i in range(6)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string, host string")
    got = {r.page_id: r.text for r in html_text.main_text(pages).collect()}
    for i in range(12):
        assert got[i] == prose(900 + i, 30) + ("\n\n" + shared) * (i < 4)
    for i in range(8):
        assert got[20 + i] == f"{prose(950, 50)}\n\n{prose(951, 50)}\n\nend {i}"
    for i in range(40):
        assert got[40 + i] == f"{prose(920 + i % 4, 30)}\n\n{line}"


def test_marked_inline_elements_leave_their_block_and_end_with_it():
    a = lambda inner: "\n\n".join(article_text(f"<article>{inner}</article>"))
    assert a("<p>Intro <span class='ad'>Buy now</span> outro</p>") == "Intro outro"
    assert a("<p>kept words <span class='ad'>x<p>next</p>") == "kept words\n\nnext"
    assert a("a <span hidden>s</span>b <a class='share'>t</a><label>u</label> c<span style='display:none'>v</span>") == "a b c"
    assert a("<span class=ad><p>x</p>y<span>z</span>w</span> t<p>one<p>two") == "t\n\none\n\ntwo"
    assert a("<p>in<b>side</b> <i class=ad>x <b>y</b></i>it</p>") == "inside it"
    assert a("<ul><li class=ad>x<li>y</ul><p class=ad>q<p>r") == "y\n\nr"
    assert a("<div class=ad><p>x<p>y</div>z") == "z"


def article_text(page):
    return [t for z, t in html_text.blocks(page) if z == html_text.ARTICLE]


def test_wrappers_and_class_names_do_not_drop_articles():
    for wrapper in ("class='site has-sidebar'", "class=header-fixed", "id='nav-open'", "class='overflow-hidden rounded'", "data-class='nav'", "class='sidebar'", "class='no-ads'"):
        assert article_text(PAGE.format(f"<div {wrapper}><article><p>kept</p></article></div>")) == ["kept"], wrapper
    inner = "<div class='overflow-hidden p-4'>one</div><p class='social-science'>two</p><div title='hidden '>three</div>"
    gone = "<div hidden>a</div><div class='x site-footer'>b</div><div class='ad_300x250'>c</div><div style='display: none'>d</div><p aria-hidden=true>e</p><p class=comment-12>f</p>"
    assert article_text(f"<article>{inner}{gone}</article>") == ["one", "two", "three"]
    # Articles of a sidebar beside a real one, and comments as articles, are still none.
    assert article_text("<article>real</article><div class=sidebar><article>teaser</article></div>") == ["real"]
    assert article_text("<div class=comments><article>a</article><article>b</article></div>") == []
    both = html_text.blocks("<p>plain text</p><div class=comments><article>one comment</article></div>")
    assert [t for z, t in both if z == html_text.OUTSIDE] == ["plain text", "one comment"]


@pytest.mark.parametrize("cell", [500, 3])
def test_cells_link_what_several_components_of_a_bucket_have_in_common(spark, monkeypatch, cell):
    monkeypatch.setattr(near_dup, "CELL", cell)
    # Chains 0-9, 10-14, 15 and 16-18 of sets that grow by one; the whole row is one component in the end.
    name = lambda i: bytes([i])
    sets = spark.createDataFrame([(name(i), np.arange(i, i + 40, dtype=np.uint64).tobytes()) for i in range(19)], "node binary, shingles binary")
    members = spark.createDataFrame([(k, name(i)) for k in (1, 2) for i in range(19) if k == 1 or i < 10], "key long, node binary")
    root = lambda i: 0 if i < 10 else 10 if i < 15 else 15 if i < 16 else 16
    roots = spark.createDataFrame([(name(i), name(root(i))) for i in range(19)], "node binary, root binary")
    found = near_dup.unsettled_links(members, roots, sets, 0.9).collect()
    similar = {(a, b) for a in range(19) for b in range(a + 1, 19) if (40 - (b - a)) / (40 + (b - a)) >= 0.9}
    pairs = {tuple(sorted((r.a[0], r.b[0]))) for r in found}
    assert pairs <= similar and all(root(a) != root(b) for a, b in pairs)
    joined = {0}
    for _ in range(4):
        joined |= {root(x) for a, b in pairs if {root(a), root(b)} & joined for x in (a, b)}
    assert joined == {0, 10, 15, 16}


def test_closest_are_those_of_exact_distances_with_ties_and_repeated_ids():
    rng = np.random.default_rng(8)
    for scale in (1.0, 1e-9, 1e6, 1e200):
        rows = np.round(rng.normal(size=(300, 6)), 1) * scale
        rows[200:260] = rows[:60] + 1e-12 * scale
        ids, queries = rng.integers(0, 120, 300), rows[:9].copy()
        allowed = rng.random((9, 300)) < 0.7
        allowed[0], allowed[1, 5:] = False, False
        with np.errstate(over="ignore"):
            exact = nearest.distances(queries, rows)
            got = nearest.closest(queries, rows, ids, allowed, 10)
        for i, (at, d) in enumerate(got):
            least = {}
            for j in np.flatnonzero(allowed[i] & np.isfinite(exact[i])):
                least[ids[j]] = min(exact[i, j], least.get(ids[j], np.inf))
            assert list(zip(d, ids[at])) == sorted((v, k) for k, v in least.items())[:10]


@pytest.mark.parametrize("hot", [nearest.HOT_ROWS, 5])
def test_nearest_neighbours_reach_the_recall(spark, monkeypatch, hot):
    monkeypatch.setattr(nearest, "HOT_ROWS", hot)
    rng = np.random.default_rng(1)
    v = rng.normal(size=(1200, 16)).astype(np.float32)
    v[50:80] = v[0]
    data = [(i, [float(x) for x in row]) for i, row in enumerate(v)]
    data += [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] + [1.0] * 15), (5003, [None] + [1.0] * 15), (5004, [1.0]), (5005, []), (0, data[0][1]), (None, data[1][1])]
    df = spark.createDataFrame(data, "vec_id long, vector array<float>")
    got = collections.defaultdict(dict)
    for r in nearest.neighbours(df, df.where("vec_id % 100 = 0"), 10).collect():
        got[r.query_id][r.rank] = (r.vec_id, r.score)
    assert set(got) == set(range(0, 1200, 100))
    hits = 0
    for q, found in got.items():
        d = np.sqrt(((v.astype(np.float64) - v[q].astype(np.float64)) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(len(d)), d))[:10].tolist()
        assert sorted(found) == list(range(1, 11)) and all(abs(d[i] - s) < 1e-12 for i, s in found.values())
        hits += len(set(want) & {i for i, _ in found.values()})
    assert hits >= 0.9 * 10 * len(got)
    assert [got[0][r][0] for r in range(1, 11)] == list(range(50, 60))


def learning(spark):
    bad, data, marks = ["moron", "scum", "idiot"], [], []
    for i in range(400):
        toxic, good = i % 8 == 0, i % 5 != 0
        text = prose(i, 60) + (f" {bad[i % 3]} you {bad[(i + 1) % 3]}" if toxic else "")
        data.append((i, text if good else text.upper().replace(" ", "!! ") + " %%% ###", "en", "s", len(text), 1, 0.1, 1, "x", "y"))
        marks.append((i, int(good), int(toxic)))
    return documents(spark, data + rows()), spark.createDataFrame(marks + [(3, 1, 0), (None, None, 1)], "doc_id long, quality int, toxic int"), marks


def test_classifiers_hold_on_documents_they_have_not_seen(spark):
    docs, known, marks = learning(spark)
    held = [(i, q, t) for i, q, t in marks if zlib.crc32(str(i).encode()) % 5 == 0]
    toxic = {r.doc_id: r for r in toxicity.digest(toxicity.scored(docs, toxicity.train(docs, known)), 0.5).collect()}
    good = {r.doc_id: r for r in toxicity.digest(quality.scored(quality.inputs(docs), quality.train(quality.inputs(docs), known)), 0.3).collect()}
    assert np.mean([toxic[i].predicted == t for i, _, t in held]) > 0.95
    assert np.mean([good[i].predicted == q for i, q, _ in held]) > 0.9
    assert all(toxic[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _ in marks)
    assert all(0 <= r.score <= 1 for r in [*toxic.values(), *good.values()]) and toxic[None].held_out
    kept = toxicity.without_toxic(docs, known)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in toxic.items() if not r.predicted}


def test_the_machine_sums_pairs_in_linear_time():
    rng = np.random.default_rng(2)
    m = quality.Model(0.1, rng.normal(size=8), rng.normal(size=(8, 3)), rng.normal(size=2), rng.normal(size=(2, 3)), np.zeros(2), np.ones(2))
    x, z = rng.normal(size=4), rng.normal(size=(1, 2))
    y, _ = quality.forward(m, np.zeros(4, int), np.array([1, 3, 5, 6]), x, z, 1)
    inputs = [(x[k], m.words[b], m.pairs[b]) for k, b in enumerate([1, 3, 5, 6])] + [(z[0, k], m.about[k], m.about_pairs[k]) for k in range(2)]
    want = 0.1 + sum(v * w for v, w, _ in inputs) + sum(a[0] * b[0] * (a[2] @ b[2]) for i, a in enumerate(inputs) for b in inputs[i + 1 :])
    assert abs(y[0] - want) < 1e-9


def test_queries_far_from_all_cells_get_all_their_neighbours(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(1500, 32))
    v /= np.linalg.norm(v, axis=1)[:, None]
    v[:12] *= np.repeat([3, 5, 40], 4)[:, None]
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)] + [(20, [float(x) for x in v[20] + 1])], "vec_id long, vector array<double>")
    got = collections.defaultdict(dict)
    for r in nearest.neighbours(df, df.where("vec_id < 12"), 10).collect():
        got[r.query_id][r.rank] = (r.vec_id, r.score)
    for q in range(12):
        d = np.sqrt(((v - v[q]) ** 2).sum(1))
        d[20] = min(d[20], np.sqrt(((v[20] + 1 - v[q]) ** 2).sum()))
        d[q] = np.inf
        want = np.lexsort((np.arange(len(d)), d))[:10].tolist()
        assert [got[q][r][0] for r in range(1, 11)] == want and all(abs(d[i] - s) < 1e-9 for i, s in got[q].values())
    few = df.where("vec_id < 6")
    assert nearest.neighbours(few, few, 10).count() == 30


def test_empty_tables_give_empty_results(spark):
    docs = documents(spark, [])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    vectors = spark.createDataFrame([], "vec_id long, vector array<float>")
    results = [
        license_scan.scan(docs), decontaminate.contaminated(docs, bench), decontaminate.without_spans(docs, bench), near_dup.classes(docs),
        near_dup.without_copies(docs), mixing.mixed(docs), docs.withColumn("shard", kd_shards.shard_column(docs)), line_dedup.keep_bitmaps(docs),
        toxicity.without_toxic(docs, none), quality.scored(docs, quality.train(docs, none)), html_text.main_text(pages), nearest.neighbours(vectors, vectors),
    ]
    assert [r.count() for r in results] == [0] * len(results)
    full = decontaminate.contaminated(documents(spark), bench).select("result.n_hit").distinct().collect()
    assert [r.n_hit for r in full] == [0]
    assert {r.result.score for r in toxicity.scored(documents(spark), toxicity.train(documents(spark), none)).collect()} == {0.0}


def test_digests_are_what_the_contract_says(spark):
    assert hashlib.sha256(b"").hexdigest() == spark.sql("select sha2('', 256)").first()[0]
    fold = spark.createDataFrame([(i,) for i in range(50)], "doc_id long").select("doc_id", features.train_fold(features.F.col("doc_id")).alias("t")).collect()
    assert all(r.t == (zlib.crc32(str(r.doc_id).encode()) % 5 != 0) for r in fold)
