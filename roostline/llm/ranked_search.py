"""Ranked lexical search by NRA: sequential reads of impact-sorted lists, no random access.

A shard is a run of documents of bounded size inside one task. Per term of the queries it
holds a list of (impact, document), highest impact first. A query reads its lists step by
step, twice as deep each time. Every document met has a lower bound, the impacts read so
far, and an upper bound, which adds the last impact read of each list it was not met in.
Reading goes on until every document whose upper bound reaches the k-th lower bound is
fully known and no unmet one can reach it; membership, scores and ties are then exact.
The k best scores a task has found so far count as lower bounds of its later shards.

Documents never move. A first pass counts the documents of each term and all terms; the
second sends k rows a query and shard at most. Items go to the tasks in blocks of about
``BLOCK_BYTES`` of text, one block after another, and a block is freed before the next.

Scores are whole numbers: weight of the term times its saturated frequency, as ``impacts``
says. Defined results: null and empty texts have no terms and are no document; repeated
rows are documents of their own; a null doc_id ranks after all others of its score; rows
of one item_id, null included, are one item with the terms of all; an item without terms,
or whose terms no document has, has no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roostline.llm import batches
from roostline.session import stored

TOP = 10
# Saturation 100-90 and length slope 90 of the score, in the contract's units.
FLAT, SLOPE = 10, 90
BLOCK_BYTES = 4 << 20
SHARD_BYTES = 16 << 20
SHARD_DOCS = 1 << 15
# Postings of a list that are read first; each further step doubles what has been read.
FIRST_READ = 64

LOCAL = "item long, doc_id long, score long"


class Queries(NamedTuple):
    """Items of a block: their terms as places in a sorted alphabet of word hashes."""

    alphabet: np.ndarray
    terms: list[np.ndarray]


class Corpus(NamedTuple):
    """What the score needs to know of all documents."""

    documents: int
    terms: int
    weights: np.ndarray  # of the alphabet


def queries_of(texts: pa.Array, item: np.ndarray, n: int) -> Queries:
    """The distinct terms of items 0 to n - 1; row ``i`` of ``texts`` belongs to ``item[i]``."""
    w = batches.words(texts)
    h = batches.hashes(w)
    alphabet = np.unique(h)
    pairs = np.unique(np.stack([item[w.text], np.searchsorted(alphabet, h)], 1), axis=0) if len(h) else np.zeros((0, 2), np.int64)
    cut = np.searchsorted(pairs[:, 0], np.arange(n + 1))
    return Queries(alphabet, [pairs[a:b, 1] for a, b in zip(cut[:-1], cut[1:])])


def weights_of(documents: int, df: np.ndarray) -> np.ndarray:
    return np.floor(1000 * np.log((2 * documents + 2) / (2 * df.astype(np.float64) + 1))).astype(np.int64)


def impacts(corpus: Corpus, term: np.ndarray, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
    """What ``tf`` occurrences of ``term`` add to the score of a document of ``n`` terms."""
    m = FLAT + (SLOPE * n * corpus.documents) // max(corpus.terms, 1)
    return corpus.weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


def postings(texts: pa.Array, alphabet: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, tf) of all terms of the alphabet, and the number of terms of each text."""
    w = batches.words(texts)
    size = np.diff(w.first)
    if not len(w.start) or not len(alphabet):
        none = np.zeros(0, np.int64)
        return none, none, none, size
    h = batches.hashes(w)
    at = np.minimum(np.searchsorted(alphabet, h), len(alphabet) - 1)
    good = np.flatnonzero(alphabet[at] == h)
    pair, tf = np.unique(w.text[good] * len(alphabet) + at[good], return_counts=True)
    return pair // len(alphabet), pair % len(alphabet), tf, size


def _counts(queries):
    """Per task: documents of each term (by place in the alphabet), of any term (-1), all terms (-2)."""

    def run(runs: Iterator[pa.RecordBatch]):
        alphabet = queries.value.alphabet
        df, documents, terms = np.zeros(len(alphabet), np.int64), 0, 0
        for batch in runs:
            texts = batch.column(0)
            _, at = batches.utf8(texts)
            for part in batches.pieces(batch, np.diff(at)):
                _, term, _, size = postings(part.column(0), alphabet)
                df += np.bincount(term, minlength=len(alphabet))
                documents += int((size > 0).sum())
                terms += int(size.sum())
        found = np.flatnonzero(df)
        term = np.concatenate([found, [-1, -2]])
        yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(np.concatenate([df[found], [documents, terms]]))], names=["term", "n"])

    return run


def corpus_of(documents: DataFrame, queries) -> Corpus:
    """One narrow pass over the texts; a row per term of the block comes back."""
    counted = documents.select("text").mapInArrow(_counts(queries), "term long, n long")
    rows = counted.groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    term, n = (rows[c].to_numpy() for c in ("term", "n"))
    df = np.zeros(len(queries.value.alphabet), np.int64)
    df[term[term >= 0]] = n[term >= 0]
    total = {int(t): int(v) for t, v in zip(term, n) if t < 0}
    return Corpus(total.get(-1, 0), total.get(-2, 0), weights_of(total.get(-1, 0), df))


def nra(lists: list[tuple[np.ndarray, np.ndarray]], n_docs: int, top: int, floor: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Documents that score ``floor`` or more and may be among the ``top``, with exact scores.

    ``lists`` are (documents, impacts), highest impact first. All documents that tie with
    the last of the top are returned, so that the caller's order of ties decides.
    """
    lists = [x for x in lists if len(x[0])]
    lower = np.zeros(n_docs, np.int64)
    read, more = [0] * len(lists), FIRST_READ
    while True:
        frontier = np.zeros(len(lists), np.int64)
        for i, (docs, impact) in enumerate(lists):
            stop = min(len(docs), more)
            now = docs[read[i] : stop]
            lower[now] += impact[read[i] : stop]
            read[i] = stop
            frontier[i] = impact[stop - 1] if stop < len(docs) else 0
        best = np.partition(lower, n_docs - top)[n_docs - top] if n_docs > top else 0
        needed = max(int(best), floor)
        # No document that was not met can reach what is needed, and all that can are known.
        if frontier.sum() < needed:
            open_ = np.flatnonzero(lower + frontier.sum() >= needed)
            met = np.zeros(n_docs, np.int64)
            for (docs, _), stop, last in zip(lists, read, frontier):
                met[docs[:stop]] += last
            missing = frontier.sum() - met[open_]
            if not missing[lower[open_] + missing >= needed].any():
                found = np.flatnonzero(lower >= needed)
                return found, lower[found]
        more *= 2


class _Shard:
    """Documents so far, their postings, and the best scores of the task."""

    def __init__(self, queries: Queries, corpus: Corpus, top: int):
        self.q, self.corpus, self.top = queries, corpus, top
        self.best = [np.zeros(0, np.int64) for _ in queries.terms]
        self.clear()

    def clear(self):
        self.docs, self.terms, self.impacts, self.ids, self.n, self.bytes = [], [], [], [], 0, 0

    def add(self, ids: pa.Array, texts: pa.Array):
        doc, term, tf, size = postings(texts, self.q.alphabet)
        self.docs.append((doc + self.n).astype(np.int32))
        self.terms.append(term.astype(np.int32))
        self.impacts.append(impacts(self.corpus, term, tf, size[doc]))
        self.ids.append(ids)
        self.n += len(size)
        self.bytes += int(batches.utf8(texts)[1][-1])

    def full(self) -> bool:
        return self.bytes >= SHARD_BYTES or self.n >= SHARD_DOCS

    def results(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        docs, terms, impact = (np.concatenate(x) for x in (self.docs, self.terms, self.impacts))
        order = np.lexsort((-impact, terms))
        docs, terms, impact = docs[order], terms[order], impact[order]
        cut = np.searchsorted(terms, np.arange(len(self.q.alphabet) + 1))
        ids = pa.concat_arrays(self.ids)
        nameless, name = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False)
        items, found, scores = [], [], []
        for item, wanted in enumerate(self.q.terms):
            best = self.best[item]
            floor = int(best[0]) if len(best) == self.top else 1
            doc, score = nra([(docs[cut[t] : cut[t + 1]], impact[cut[t] : cut[t + 1]]) for t in wanted], self.n, self.top, max(floor, 1))
            if len(doc):
                first = np.lexsort((name[doc], nameless[doc], -score))[: self.top]
                doc, score = doc[first], score[first]
                self.best[item] = np.sort(np.concatenate([best, score]))[-self.top :]
                items.append(np.full(len(doc), item))
                found.append(doc)
                scores.append(score)
        if items:
            at = pa.array(np.concatenate(found))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(items)), ids.take(at), pa.array(np.concatenate(scores))], names=["item", "doc_id", "score"])
        self.clear()


def _search(queries, corpus: Corpus, top: int):
    def run(runs: Iterator[pa.RecordBatch]):
        shard = _Shard(queries.value, corpus, top)
        for batch in runs:
            _, at = batches.utf8(batch.column("text"))
            for part in batches.pieces(batch, np.diff(at)):
                shard.add(part.column("doc_id"), part.column("text"))
                if shard.full():
                    yield from shard.results()
        yield from shard.results()

    return run


def _blocks(items: DataFrame, block_bytes: int) -> Iterator[pa.Table]:
    """Items with all their texts, in blocks of about ``block_bytes``; one block at a time is held."""
    items = items.select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = total // block_bytes + 1
    for b in range(blocks):
        yield (items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)).toArrow()


def search(documents: DataFrame, items: DataFrame, top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score) of the ``top`` documents of every item."""
    spark = documents.sparkSession
    documents = documents.select("doc_id", "text")
    found = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long").select(
        F.col("item_id").cast(items.schema["item_id"].dataType).alias("item_id"), "rank", F.col("doc_id").cast(documents.schema["doc_id"].dataType).alias("doc_id"), "score"
    )
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    for block in _blocks(items, block_bytes):
        names = block["item_id"].combine_chunks().dictionary_encode(null_encoding="encode")
        code = names.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        n = len(names.dictionary)
        if not n:
            continue
        queries = spark.sparkContext.broadcast(queries_of(block["text"].combine_chunks(), code, n))
        corpus = corpus_of(documents, queries)
        local = documents.mapInArrow(_search(queries, corpus, top), LOCAL)
        ranked = local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        name = spark.createDataFrame(pa.table({"item": pa.array(np.arange(n)), "item_id": names.dictionary}))
        part = stored(ranked.join(F.broadcast(name), "item").select("item_id", "rank", "doc_id", "score"), "ranked")
        queries.destroy()
        found = found.unionByName(part)
    return found


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: the ten best documents of every item of ``benchmark``."""
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL = r"""
WITH tokens AS (
  SELECT row_number() OVER () AS d, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), stats AS (
  SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM tokens WHERE len(w) > 0
), tf AS (
  SELECT d, doc_id, len(w)::BIGINT AS n, term, count(*) AS tf FROM (SELECT d, doc_id, w, unnest(w) AS term FROM tokens) GROUP BY ALL
), wanted AS (
  SELECT DISTINCT item_id, term
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
), df AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS weight FROM tf, stats GROUP BY term, n_docs
), parts AS (
  SELECT item_id, d, doc_id, weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * n_docs) // n_terms)))) AS part
  FROM tf JOIN df USING (term) JOIN wanted USING (term), stats
), scores AS (
  SELECT item_id, d, doc_id, sum(part)::BIGINT AS score FROM parts GROUP BY ALL HAVING sum(part) > 0
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scores) WHERE rank <= 10
"""
