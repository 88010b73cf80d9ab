"""Main text of web pages, with a suffix array per host for what repeats between its pages.

A page is cut into blocks at block-level tags; each block lies in the article, in page
furniture (menus, headers, footers, sidebars, notices, adverts, forms, comments) or in
neither. An inline element with such a mark is taken out of its block, and ends with it.
The token streams of all blocks of a host's pages, articles included, are concatenated,
and the suffix array of the stream shows what stands on several pages. Equal pages count
once. Two verdicts follow:

* Outside articles: runs of ``RUN`` tokens or more inside a block, and whole shorter blocks,
  on at least ``PAGES`` and the share ``SHARE`` of the host's distinct page texts. On a page
  without an article the rest of these blocks is the main text.
* Inside articles: whole blocks only, on at least ``ARTICLE_PAGES`` and ``ARTICLE_SHARE`` of
  the distinct page texts, such as a sign-up line in the template. A sentence is never cut
  out of an article, and an article that would lose more than half of its words is a copy
  of others, not furniture, and keeps them all.

A host's stream is cut into parts of bounded size. A part settles what is common enough
inside it; other runs and blocks are counted across the host's parts by their hash. A host
with too few pages for any verdict has no array; its pages do not move.

Defined results: null and empty pages have empty text; pages without url share one host;
broken markup closes at its container or at the end; a page whose article is empty has
empty text; rows of equal texts on a host are one page of the stream, and each row gets
its own text; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, LongType, StringType, StructField, StructType

from roostline.llm import batches
from roostline.llm.fm_index import suffix_order
from roostline.session import stored

RUN = 24
PAGES = 2
SHARE = 0.1
ARTICLE_PAGES = 5
ARTICLE_SHARE = 0.5
PART_TOKENS = 500_000
# The token before each block; words have larger numbers.
START = 1

# Element names and the words of class, id and role that mark furniture.
RAW = frozenset("script style noscript template textarea title iframe svg math object xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary "
    "table tbody td tfoot th thead tr ul".split()
)
#: Their end tags are often left out.
PARAGRAPHS = frozenset("p li td th tr dt dd option h1 h2 h3 h4 h5 h6".split())
FURNITURE = frozenset("head nav footer aside header form button select dialog menu fieldset search option label".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
MARKS = frozenset(
    "ad ads adv advert advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disclaimer "
    "disqus footer form gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notices popup promo promoted promotion "
    "related reply replies share sharing sidebar signup skyscraper social sponsor sponsored subscribe subscription toolbar widget".split()
)
#: Inside an article its own heading stays.
ALLOWED_IN_ARTICLE = frozenset(("header", "masthead"))
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>""", re.S)
#: Words before a mark that say how the page is laid out, not what the element is.
LAYOUT = frozenset("has no with without".split())
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
INVISIBLE = re.compile(r"display\s*:\s*none", re.I)

# HELD: in an article inside a marked wrapper, until the whole page is known.
ARTICLE, OUTSIDE, BOILERPLATE, HELD = 0, 1, 2, 3


def _marked(value: str, marks: frozenset) -> bool:
    """Whether a token of ``value`` is a mark or ends in one: ``site-footer``, ``ad_300x250``, but not ``has-sidebar``."""
    for token in value.lower().split():
        words = [w for w in (re.sub(r"\d.*", "", x) for x in re.split(r"[^a-z0-9]+", token)) if w]
        if words and words[-1] in marks and not LAYOUT & set(words[:-1]):
            return True
    return False


def _furniture(name: str, attributes: str, in_article: bool) -> bool:
    if name in FURNITURE and not (in_article and name in ALLOWED_IN_ARTICLE):
        return True
    if not attributes or name in ("html", "body", "article", "main"):
        return False
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and INVISIBLE.search(value):
            return True
        if key in ("class", "id", "role"):
            marks = ROLES if key == "role" else MARKS
            if _marked(value, marks - ALLOWED_IN_ARTICLE if in_article else marks):
                return True
    return False


def blocks(page: str | None) -> list[tuple[int, str]]:
    """(zone, text) of each block with text, in page order; markup and scripts left out.

    A block with marked inline elements gives the text of each of its zones.
    """
    out: list[tuple[int, str]] = []
    runs: list[tuple[int, str]] = []
    # Name, zone, and whether a paragraph is open around an inline element.
    stack: list[tuple[str, int, bool]] = [("", OUTSIDE, False)]
    page, at, articles, held, paragraph = page or "", 0, 0, 0, False

    def flush():
        by_zone: dict[int, list[str]] = {}
        for zone, piece in runs:
            by_zone.setdefault(zone, []).append(piece)
        runs.clear()
        for zone, pieces in by_zone.items():
            words = html.unescape("".join(pieces)).split()
            if words:
                out.append((zone, " ".join(words)))

    while m := TAG.search(page, at):
        if m.start() > at:
            runs.append((stack[-1][1], page[at : m.start()]))
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if name in BLOCK:
            flush()
            # A marked inline element ends with the paragraph around it.
            while stack[-1][2]:
                stack.pop()
            # A paragraph ends where any block begins, an item or a cell where the next one does.
            if not closing and (stack[-1][0] == "p" or stack[-1][0] == name and name in PARAGRAPHS):
                stack.pop()
            paragraph = name in PARAGRAPHS and not closing
        elif name == "br":
            runs.append((stack[-1][1], " "))
        if closing:
            if any(n == name for n, _, _ in stack[1:]):
                while stack.pop()[0] != name:
                    pass
        elif name in RAW:
            if not attributes.endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else len(page)
        elif name not in VOID and not attributes.endswith("/"):
            zone = stack[-1][1]
            if name in ("article", "main"):
                # An article inside comments or a sidebar is none; an unclosed menu does not hold one.
                if zone != HELD:
                    inside = zone == BOILERPLATE and stack[-1][0] in ("aside", "div", "section", "li")
                    held, articles, zone = held + inside, articles + (not inside), HELD if inside else ARTICLE
            elif zone != BOILERPLATE and _furniture(name, attributes, zone in (ARTICLE, HELD)):
                zone = BOILERPLATE
            # Only what holds other elements, marks a zone or lies in a marked inline element needs to be remembered.
            in_inline = len(stack) > 1 and stack[-1][0] not in BLOCK
            if name in BLOCK and (name not in PARAGRAPHS or in_inline) or zone != stack[-1][1] or in_inline and name == stack[-1][0]:
                stack.append((name, zone, name not in BLOCK and paragraph))
    runs.append((stack[-1][1], page[at:]))
    flush()
    # The only article of a page is not lost with its wrapper; text beside it is not lost for it.
    only = BOILERPLATE if articles or held > 1 else OUTSIDE if any(z == OUTSIDE for z, _ in out) else ARTICLE
    return [(only if z == HELD else z, t) for z, t in out]


def host_of(url: str | None) -> str:
    rest = re.sub(r"^[a-zA-Z][a-zA-Z0-9+.-]*:", "", url or "")
    return re.split(r"[/?#\\]", rest[2:], maxsplit=1)[0].rpartition("@")[2].partition(":")[0].lower() if rest.startswith("//") else ""


PARSED = StructType(
    [
        StructField("host", StringType()),
        StructField("text_key", LongType()),
        StructField("settled", BooleanType()),
        StructField("tokens", LongType()),
        StructField("packed", BinaryType()),
    ]
)
CODEC, LEVEL = "zstd", 6


def packed(found: list[tuple[int, str]]) -> tuple[int, bytes]:
    """A hash of blocks, and the blocks compressed behind their size. No block holds a line break."""
    raw = "\n".join(f"{zone}{text}" for zone, text in found).encode("utf-8", "replace")
    return key_of(raw), len(raw).to_bytes(8, "little") + pa.Codec(CODEC, LEVEL).compress(raw, asbytes=True)


def unpacked(data: bytes) -> list[tuple[int, str]]:
    size = int.from_bytes(data[:8], "little")
    raw = pa.Codec(CODEC).decompress(data[8:], decompressed_size=size, asbytes=True).decode() if size else ""
    return [(int(line[0]), line[1:]) for line in raw.split("\n")] if raw else []


def settled(found: list[tuple[int, str]]) -> bool:
    """Whether a page has an article, or nothing that could stand for one."""
    zones = {zone for zone, _ in found}
    return ARTICLE in zones or OUTSIDE not in zones


def key_of(raw: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True)


def _parse(parts):
    for part in parts:
        host, key, done, tokens, data = [], [], [], [], []
        for url, page in zip(part.column("url").to_pylist(), part.column("html").to_pylist()):
            found = blocks(page)
            hashed, bytes_ = packed(found)
            host.append(host_of(url))
            key.append(hashed)
            done.append(settled(found))
            tokens.append(sum(t.count(" ") + 3 for _, t in found))
            data.append(bytes_)
        yield part, [host, key, done, tokens, data]


def repeated(tokens: np.ndarray, page: np.ndarray, run: int, order: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of ``run`` words, and whole blocks of fewer, by the suffix array of ``tokens``.

    ``order`` may be a part of the array, whose places alone are looked at. A block is ``START``, its words and 0. Returns the start of every run (of a whole block,
    its ``START``), the number of its class (equal runs are neighbours in the array, with a
    common prefix of their length at least) and each class's number of pages.
    """
    order = suffix_order(tokens) if order is None else order
    padded = np.concatenate([tokens, np.zeros(run + 1, tokens.dtype)])
    full, same, ended = np.ones(len(order), bool), np.ones(len(order), bool), np.zeros(len(order), bool)
    for i in range(run + 1):
        here = padded[order + i]
        if i < run:
            full &= here > START
        done = ended | full if i == run else ended
        same[1:] &= (here[1:] == here[:-1]) | done[1:]
        ended |= here == 0
    whole = full | (padded[order] == START) & ended
    same[:1] = False
    number = np.cumsum(~(same & whole))
    number, start = number[whole], order[whole]
    _, number = np.unique(number, return_inverse=True)
    return start, number, _pages_of(number, page[start])


def _pages_of(number: np.ndarray, page: np.ndarray) -> np.ndarray:
    """How many different pages each class has."""
    width = int(page.max(initial=0)) + 1
    return np.bincount(np.unique(number * width + page) // width, minlength=int(number.max(initial=-1)) + 1)


def equal_blocks(tokens: np.ndarray, page: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, class and the pages of each class of whole blocks, of any length: equal ones are neighbours in the suffix array."""
    start = order[tokens[order] == START]
    left, right = start[:-1], start[1:]
    new, alive, i = np.ones(len(start), bool), np.arange(len(left)), 0
    while len(alive):
        a, b = tokens[left[alive] + i], tokens[right[alive] + i]
        new[1 + alive[(a == b) & (a == 0)]] = False
        alive, i = alive[(a == b) & (a != 0)], i + 1
    number = np.cumsum(new) - 1
    return start, number, _pages_of(number, page[start])


def _stream(pages: list[list[tuple[int, str]]]):
    """Tokens of the blocks of a part: START, words as numbers, 0; the page, block, place and zone of each;
    the blocks' texts with the start of each; and a hash of each number."""
    texts = [t for found in pages for _, t in found]
    split = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
    coded = split.values.dictionary_encode()
    length = np.diff(split.offsets.to_numpy())
    size = length + 2
    first = np.cumsum(size) - size
    tokens = np.zeros(int(size.sum()), np.int64)
    place = np.arange(len(tokens)) - np.repeat(first, size)
    word = (place > 0) & (place <= np.repeat(length, size))
    tokens[first] = START
    tokens[word] = coded.indices.to_numpy() + START + 1
    spread = lambda x: np.repeat(np.array(x, np.int64), size)
    page = spread([i for i, found in enumerate(pages) for _ in found])
    block = spread([j for found in pages for j in range(len(found))])
    zone = spread([z for found in pages for z, _ in found])
    # No word is empty or a space.
    raw, offsets = batches.utf8(pa.array(["", " ", *coded.dictionary.to_pylist()], pa.string()))
    hashed = batches.hashes(batches.Words(raw, offsets, offsets[:-1], offsets[1:], np.arange(len(offsets))))
    return tokens, page, block, np.maximum(place - 1, 0), zone, texts, first, hashed


FOUND = "host string, article boolean, key long, pages long, here boolean, text_key long, block int, word int"


def _runs(run: int):
    """Per part: runs and blocks that are settled here, and those to be counted over the whole host."""

    def work(rows: pa.Table) -> pa.Table:
        pages = [unpacked(p) for p in rows["packed"].to_pylist()]
        tokens, page, block, place, zone, texts, first, hashed = _stream(pages)
        order = suffix_order(tokens)
        several = bool(rows["parts"][0].as_py() > 1)
        open_ = np.array([not settled(found) for found in pages], bool)
        outside = zone[order] != ARTICLE if open_.any() or rows["asked"][0].as_py() else np.zeros(len(order), bool)
        start, number, count = repeated(tokens, page, run, order[outside])
        here = count[number] >= rows["least"][0].as_py()
        # One row for each class, for the count; and one for each place on a page that asks.
        _, one = np.unique(number, return_index=True)
        one = one if several else one[:0]
        asks = np.flatnonzero(open_[page[start]] & (here | several))
        at = start[np.concatenate([one, asks])]
        padded = np.concatenate([tokens, np.zeros(run + 1, tokens.dtype)])
        key, going = np.zeros(len(at), np.uint64), np.ones(len(at), bool)
        for i in range(run + 1):
            w = padded[at + i]
            if i == run:
                going &= padded[at] == START
            key = np.where(going, batches.mix(key + hashed[w]), key)
            going &= w > 0
        # Blocks of articles are known by their text, so no place is sent. Elsewhere they only count.
        begin, klass, held = equal_blocks(tokens, page, order)
        klasses, example = np.unique(klass, return_index=True)
        inside = np.zeros(len(klasses), bool)
        inside[klass[zone[begin] == ARTICLE]] = True
        told = np.flatnonzero((held[klasses] >= 1 if several else held[klasses] >= rows["least_article"][0].as_py()) & (inside | several))
        names = [key_of(texts[i].encode()) for i in np.searchsorted(first, begin[example[told]])]
        names_of = {i: packed(pages[i])[0] for i in np.unique(page[start[asks]])}
        n, m, rest = len(one), len(told), len(asks)
        none = [None] * (n + m)
        return pa.table(
            {
                "host": pa.array([rows["host"][0].as_py()] * (n + m + rest), pa.string()),
                "article": pa.array([True] * m + [False] * (n + rest), pa.bool_()),
                "key": pa.array(np.concatenate([np.array(names, np.int64), key.view(np.int64)])),
                "pages": pa.array(np.concatenate([held[klasses[told]], count[number[one]], np.zeros(rest, np.int64)]).astype(np.int64)),
                "here": pa.array(np.concatenate([np.zeros(m + n, bool), here[asks]]), pa.bool_()),
                "text_key": pa.array(none + [names_of[i] for i in page[start[asks]]], pa.int64()),
                "block": pa.array(none + block[start[asks]].tolist(), pa.int32()),
                "word": pa.array(none + place[start[asks]].tolist(), pa.int32()),
            }
        )

    return work


def covered_runs(parsed: DataFrame, run: int = RUN, pages: int = PAGES, part_tokens: int = PART_TOKENS) -> tuple[DataFrame, DataFrame]:
    """(host, text_key, covered): starts of the covered runs of each page text that asks; and
    (host, common): hashes of the article blocks that are furniture, at most twice the blocks of a page."""
    # Equal pages count once, whatever their ids.
    distinct = parsed.where("tokens > 0").select("host", "text_key", "settled", "tokens").dropDuplicates(["host", "text_key"])
    share = lambda least, part: F.greatest(F.lit(least), F.ceil(F.count("*") * part)).cast("bigint")
    sizes = stored(
        distinct.groupBy("host")
        .agg(
            (F.floor(F.sum("tokens") / part_tokens) + 1).alias("parts"), share(pages, SHARE).alias("least"),
            share(ARTICLE_PAGES, ARTICLE_SHARE).alias("least_article"), (~F.min("settled")).alias("asked"), F.count("*").alias("n"),
        )
        .where((F.col("n") >= ARTICLE_PAGES) | (F.col("n") >= pages) & F.col("asked")).drop("n"),
        "hosts",
    )
    # Copies go before the shuffle already: a part's set of packed pages is made by the tasks that read them.
    rows = parsed.where("tokens > 0").select("host", "text_key", "packed").join(sizes, "host").withColumn("part", F.pmod(F.xxhash64("text_key"), F.col("parts")))
    figures = [F.first(c).alias(c) for c in ("parts", "least", "least_article", "asked")]
    dealt = rows.groupBy("host", "part").agg(F.collect_set("packed").alias("packed"), *figures).withColumn("packed", F.explode("packed"))
    found = stored(dealt.groupBy("host", "part").applyInArrow(_runs(run), FOUND), "runs")
    asked = found.where("block is not null")
    counted = found.where("block is null").groupBy("host", "article", "key").agg(F.sum("pages").alias("pages")).join(sizes, "host")
    common = counted.where("not article and pages >= least")
    across = asked.where("not here").join(common.select("host", "key"), ["host", "key"], "left_semi")
    place = F.struct("block", "word")
    covered = (
        asked.where("here").select("host", "text_key", place.alias("at")).union(across.select("host", "text_key", place.alias("at")))
        .groupBy("host", "text_key").agg(F.collect_list("at").alias("covered"))
    )
    furniture = counted.where("article and pages >= least_article").groupBy("host").agg(F.collect_set("key").alias("common"))
    return stored(covered, "covered"), stored(furniture, "furniture")


def unique_runs(found: list[tuple[int, str]], covered, run: int) -> str:
    """What is left of the blocks outside furniture once covered tokens are gone."""
    gone: dict[int, list[int]] = {}
    for c in covered if covered is not None else ():
        gone.setdefault(c["block"], []).append(c["word"])
    out = []
    for i, (zone, text) in enumerate(found):
        if zone != OUTSIDE:
            continue
        words = text.split(" ")
        keep = np.ones(len(words), bool)
        for at in gone.get(i, ()):
            keep[at : at + run] = False
        if keep.any():
            out.append(" ".join(w for w, k in zip(words, keep) if k))
    return "\n\n".join(out)


def article_text(found: list[tuple[int, str]], common) -> str:
    """The blocks of the article without those that are ``common`` on the host, unless they are most of it."""
    article = [t for z, t in found if z == ARTICLE]
    if common is not None and len(common):
        gone = set(common)
        kept = [t for t in article if key_of(t.encode()) not in gone]
        size = lambda texts: sum(t.count(" ") + 1 for t in texts)
        if 2 * size(kept) >= size(article):
            article = kept
    return "\n\n".join(article)


def main_text(pages: DataFrame, run: int = RUN) -> DataFrame:
    """(page_id, url, host, text) of every row of ``pages`` (page_id, url, html)."""
    made = batches.with_results(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"), "html", PARSED, _parse)
    parsed = stored(made.select("row.page_id", "row.url", "result.*"), "parsed-pages")
    covered, furniture = covered_runs(parsed, run)
    c, a = covered.alias("c"), parsed.where("not settled").alias("a")
    open_ = a.join(c, (F.col("a.text_key") == F.col("c.text_key")) & (F.col("a.host") == F.col("c.host")), "left")

    @F.pandas_udf(StringType())
    def left(data: pd.Series, covered: pd.Series) -> pd.Series:
        return pd.Series([unique_runs(unpacked(d), c, run) for d, c in zip(data, covered)])

    @F.pandas_udf(StringType())
    def article(data: pd.Series, common: pd.Series) -> pd.Series:
        return pd.Series([article_text(unpacked(d), c) for d, c in zip(data, common)])

    ready = parsed.where("settled").join(furniture, "host", "left")
    return ready.select("page_id", "url", "host", article("packed", "common").alias("text")).union(
        open_.select("a.page_id", "a.url", "a.host", left("a.packed", "c.covered").alias("text"))
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: the main text of every page."""
    pages = main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return pages.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
