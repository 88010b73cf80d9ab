"""Benchmark decontamination with an FM-index per shard of training text.

A shard is a run of documents of bounded size inside one task. Its words become symbols
of the phrase alphabet; a word that no phrase has ends a run, and runs shorter than the
shortest phrase hold no occurrence and are left out of the index. The phrases (10-word
windows of the items) are searched backwards through the ranks of a wavelet matrix; the
occurrences are located by sampled suffix positions, and their spans are merged into
what is to be removed. Documents never move: the pass is narrow.

The phrases go to the tasks in blocks of bounded size (``BLOCK_BYTES`` of item text); a
larger benchmark is searched block after block, each pass adding to the spans so far. The
driver and the tasks hold one block at a time; between blocks the documents are written
with their spans, so such a benchmark costs one copy of them per block.

Defined results: null and empty texts have no words and are clean; an item without words
has no window; an item without id counts hits but is not listed; items are listed once
however often their rows repeat; documents are treated row by row, so repeated rows and
null ids are no special case; empty tables give empty or clean results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from roostline.llm import batches
from roostline.llm.fm_index import FMIndex
from roostline.session import scratch_path, without_folder

WINDOW = 10
BLOCK_BYTES = 16 << 20
SHARD_BYTES = 16 << 20
SHARD_TOKENS = 1 << 20

SPAN = StructType([StructField(n, IntegerType()) for n in ("first_word", "last_word", "start", "end")])
RESULT = StructType(
    [
        StructField("n_words", LongType()),
        StructField("n_hit", LongType()),
        StructField("items", ArrayType(StringType())),
        StructField("spans", ArrayType(SPAN)),
    ]
)


class Phrases(NamedTuple):
    """Distinct windows as symbols of a sorted alphabet of word hashes, and their items."""

    alphabet: np.ndarray
    symbols: np.ndarray  # one row a window, filled up with 0
    lengths: np.ndarray
    item_first: np.ndarray  # windows to items: item_list[item_first[i]:item_first[i + 1]]
    item_list: np.ndarray
    names: list


def phrases_of(texts: pa.Array, names: list, window: int) -> Phrases:
    w = batches.words(texts)
    h = batches.hashes(w)
    alphabet = np.unique(h)
    symbol = np.append(np.searchsorted(alphabet, h) + 1, 0)
    words = np.diff(w.first)
    size = np.minimum(words, window)
    count = np.where(size > 0, words - size + 1, 0)
    item = np.repeat(np.arange(len(words)), count)
    begin = w.first[item] + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    place = np.arange(window)
    inside = place < size[item][:, None]
    table = symbol[np.where(inside, begin[:, None] + place, len(h))].reshape(-1, window)
    rows, which = np.unique(table, axis=0, return_inverse=True)
    named = np.array([n is not None for n in names], bool)[item]
    pairs = np.unique(which.reshape(-1)[named] * max(1, len(names)) + item[named])
    window_of, item_list = pairs // max(1, len(names)), pairs % max(1, len(names))
    return Phrases(
        alphabet,
        rows.astype(np.int64),
        (rows > 0).sum(1).astype(np.int64),
        np.searchsorted(window_of, np.arange(len(rows) + 1)).astype(np.int64),
        item_list.astype(np.int64),
        [None if n is None else str(n) for n in names],
    )


class _Shard:
    """Words of the documents so far, reduced to runs that may hold a phrase."""

    def __init__(self, phrases: Phrases):
        self.p = phrases
        self.shortest = int(phrases.lengths.min()) if len(phrases.lengths) else 0
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(phrases.alphabet & np.uint64(0xFFFFF)).astype(np.int64)] = True
        self.clear()

    def clear(self):
        self.parts, self.tokens, self.docs, self.word, self.n_docs, self.bytes, self.n = [], [], [], [], 0, 0, 0

    def add(self, part: pa.RecordBatch, texts: pa.Array):
        w = batches.words(texts)
        self.parts.append((part, w.start.astype(np.int32), w.end.astype(np.int32), w.first, w.offsets))
        self.bytes += len(w.low)
        if len(w.start) and self.shortest:
            h = batches.hashes(w)
            maybe = np.flatnonzero(self.seen[(h & np.uint64(0xFFFFF)).astype(np.int64)])
            at = np.searchsorted(self.p.alphabet, h[maybe])
            at[at == len(self.p.alphabet)] = 0
            good = self.p.alphabet[at] == h[maybe]
            symbol = np.zeros(len(h), np.int32)
            symbol[maybe[good]] = at[good] + 1
            begin, end = batches.edges(symbol > 0, w.first)
            long = end - begin >= self.shortest
            begin, end = begin[long], end[long]
            if len(begin):
                size = end - begin
                # Each run and one 0 after it.
                first = np.concatenate([[0], np.cumsum(size + 1)])
                tokens = np.zeros(first[-1], np.int32)
                word = np.full(first[-1], -1, np.int64)
                inside = np.ones(first[-1], bool)
                inside[first[1:] - 1] = False
                word[inside] = np.arange(size.sum()) + np.repeat(begin - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
                tokens[inside] = symbol[word[inside]]
                doc = np.zeros(first[-1], np.int64)
                doc[inside] = np.searchsorted(w.first, word[inside], side="right") - 1 + self.n_docs
                word[inside] -= w.first[doc[inside] - self.n_docs]
                self.tokens.append(tokens)
                self.docs.append(doc)
                self.word.append(word)
                self.n += len(tokens)
        self.n_docs += len(texts)

    def full(self) -> bool:
        return self.bytes >= SHARD_BYTES or self.n >= SHARD_TOKENS

    def occurrences(self):
        """Per occurrence its window and first token; no index is built over nothing."""
        if not self.n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        index = FMIndex(np.concatenate(self.tokens), len(self.p.alphabet))
        low, high = index.search(self.p.symbols, self.p.lengths)
        count = np.maximum(high - low, 0)
        which = np.repeat(np.arange(len(count)), count)
        rows = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + low[which]
        return which, index.locate(rows)

    def results(self):
        """Each part with its documents' hit words, items and merged spans."""
        which, place = self.occurrences()
        hit_doc = hit_word = np.zeros(0, np.int64)
        item_doc = item_no = np.zeros(0, np.int64)
        if len(which):
            docs, word = np.concatenate(self.docs), np.concatenate(self.word)
            change = np.zeros(self.n + 1, np.int64)
            np.add.at(change, place, 1)
            np.add.at(change, place + self.p.lengths[which], -1)
            covered = np.flatnonzero(np.cumsum(change[:-1]) > 0)
            hit_doc, hit_word = docs[covered], word[covered]
            pair = np.unique(docs[place] * len(self.p.lengths) + which)
            d, win = pair // len(self.p.lengths), pair % len(self.p.lengths)
            count = self.p.item_first[win + 1] - self.p.item_first[win]
            at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(self.p.item_first[win], count)
            pair = np.unique(np.repeat(d, count) * max(1, len(self.p.names)) + self.p.item_list[at])
            item_doc, item_no = pair // max(1, len(self.p.names)), pair % max(1, len(self.p.names))
        base = 0
        for part, start, end, first, offsets in self.parts:
            n = len(first) - 1
            words = np.diff(first)
            hits = np.searchsorted(hit_doc, np.arange(base, base + n + 1))
            items = np.searchsorted(item_doc, np.arange(base, base + n + 1))
            spans, names = [], []
            for i in range(n):
                h = hit_word[hits[i] : hits[i + 1]]
                if len(h):
                    cut = np.flatnonzero(np.diff(h) > 1)
                    a, b = h[np.concatenate([[0], cut + 1])], h[np.concatenate([cut, [len(h) - 1]])]
                    at = start[first[i] + a] - offsets[i], end[first[i] + b] - offsets[i]
                    spans.append([{"first_word": int(p), "last_word": int(q), "start": int(s), "end": int(e)} for p, q, s, e in zip(a, b, *at)])
                else:
                    spans.append([])
                names.append(sorted({self.p.names[j] for j in item_no[items[i] : items[i + 1]]}))
            yield part, [words, np.diff(hits), names, spans]
            base += n
        self.clear()


def _pass(phrases):
    def run(parts):
        shard = _Shard(phrases.value)
        for part in parts:
            shard.add(part, part.column("text"))
            if shard.full():
                yield from shard.results()
        yield from shard.results()

    return run


def benchmark_blocks(benchmark: DataFrame, window: int, block_bytes: int = BLOCK_BYTES) -> Iterator[Phrases]:
    """The windows of all items, block after block of about ``block_bytes`` of item text."""
    items = benchmark.select(F.col("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = total // block_bytes + 1
    for b in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        rows = part.distinct().toArrow()
        yield phrases_of(rows["text"].combine_chunks(), rows["item_id"].to_pylist(), window)


def _merged(df: DataFrame) -> DataFrame:
    """Results of a further block put together with those so far."""
    words = F.array_distinct(
        F.flatten(F.transform(F.concat("row.found.spans", "result.spans"), lambda s: F.sequence(s["first_word"], s["last_word"])))
    )
    found = F.struct(
        F.col("result.n_words").alias("n_words"),
        F.size(words).cast("long").alias("n_hit"),
        F.array_sort(F.array_union("row.found.items", "result.items")).alias("items"),
        F.concat("row.found.spans", "result.spans").alias("spans"),
    )
    return df.select("row.doc", "row.text", found.alias("found"))


def contaminated(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Columns ``row`` (all of ``documents``) and ``result``: words, hit words, items, spans.

    ``start`` and ``end`` of a span are bytes of the text's UTF-8. Several blocks may give
    spans that overlap; ``without_spans`` takes them so.
    """
    spark = documents.sparkSession
    doc = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("doc")
    df = documents.select(doc, F.col("text").alias("text"))
    earlier = shared = None
    for i, block in enumerate(benchmark_blocks(benchmark, window, block_bytes)):
        if i:
            # One block at a time: what was found so far is written, its block and its input go.
            path = scratch_path(spark, "spans")
            df.write.parquet(path)
            shared.destroy()
            if earlier:
                without_folder(spark, earlier)
            df, earlier = spark.read.parquet(path), path
        shared = spark.sparkContext.broadcast(block)
        made = batches.with_results(df, "text", RESULT, _pass(shared))
        df = _merged(made) if i else made.select("row.doc", "row.text", F.col("result").alias("found"))
    return df.select(F.col("doc").alias("row"), F.col("found").alias("result"))


def _cut(text: str | None, spans) -> str | None:
    if text is None or not len(spans):
        return text
    raw, out, at = text.encode(), [], 0
    for s in sorted(spans, key=lambda s: s["start"]):
        if s["start"] > at:
            out.append(raw[at : s["start"]])
        at = max(at, s["end"])
    out.append(raw[at:])
    return b"".join(out).decode()


@F.pandas_udf(StringType())
def _without(text, spans):
    import pandas as pd

    return pd.Series([_cut(t, s) for t, s in zip(text, spans)])


def without_spans(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``documents`` with every hit span cut out of ``text``, and ``n_chars`` made to fit.

    Texts without a hit stay as they are, null included; text around a span stays.
    """
    found = contaminated(documents, benchmark, window, block_bytes)
    text = F.when(F.col("result.n_hit") > 0, _without(F.col("row.text"), F.col("result.spans"))).otherwise(F.col("row.text"))
    out = found.select("row", F.col("result.n_hit").alias("n_hit"), text.alias("clean"))
    changed = {"text": F.col("clean"), "n_chars": F.when(F.col("n_hit") > 0, F.char_length("clean").cast("long")).otherwise(F.col("row.n_chars")) if "n_chars" in documents.columns else None}
    return out.select(*[changed[c].alias(c) if changed.get(c) is not None else F.col(f"row.`{c}`").alias(c) for c in documents.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: words of ``documents`` inside any occurrence of a 10-word window of ``benchmark``."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = contaminated(documents, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "row.doc_id",
        "result.n_words",
        "result.n_hit",
        F.size("result.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("result.items", ","), 256).alias("items_sha256"),
        (F.col("result.n_hit") > 0).alias("contaminated"),
    )


SQL = r"""
WITH item_words AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[p : p + least(len(w), 10) - 1], ' ') AS phrase
  FROM item_words, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS u(p) WHERE len(w) > 0
), doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), places AS (
  SELECT doc_id, size, p, array_to_string(w[p : p + size - 1], ' ') AS phrase
  FROM doc_words, (SELECT DISTINCT size FROM windows), unnest(range(1, len(w) - size + 2)) AS u(p)
), found AS (
  SELECT doc_id, item_id, p, windows.size FROM places JOIN windows USING (size, phrase)
), hit AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM found, unnest(range(p, p + size)) AS u(q) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id
)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""
