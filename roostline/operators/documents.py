"""Text of a listing for embedding, and filling in missing vectors. Specified behaviour."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roostline import config
from roostline.functions.text import WHITESPACE, without_names
from roostline.operators.reconcile import newest_children

Embedder = Callable[[Sequence[str]], np.ndarray]


def scrub(rows: DataFrame, column: str, names: tuple[str, ...] = ()) -> DataFrame:
    """``column`` without probable personal names; the one path review text takes outward."""
    return rows.withColumn(column, without_names(F.col(column), names))


def excerpts(
    reviews: DataFrame,
    words: int = config.EXCERPT_WORDS,
) -> DataFrame:
    """``(listing_id, excerpt)``: review text, newest first, cut after ``words`` words.

    Every review with a word has one at least, so the newest ``words`` of them hold all
    words of the excerpt; no more are brought together, however many a listing has.
    """
    gap = f"[{WHITESPACE}]+"
    # A scrub never empties a text, so only what is shown has to be scrubbed and split.
    told = reviews.where(F.col("comments").rlike(f"[^{WHITESPACE}]")).select("listing_id", "id", "date", "comments")
    newest = newest_children(told, words, key="listing_id", date="date", position="id")
    spoken = F.slice(F.filter(F.split(without_names(F.col("comments")), gap), lambda w: w != ""), 1, words)
    parts = newest.select("listing_id", "recency", spoken.alias("words"))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("recency", "words"))), lambda r: r["words"])
    return parts.groupBy("listing_id").agg(
        F.array_join(F.slice(F.flatten(in_order), 1, words), " ").alias("excerpt")
    )


def documents(listings: DataFrame, excerpt: DataFrame) -> DataFrame:
    """``(id, doc_text)``: the one template of the embedded text.

    ``listings`` carry dimension names; absent parts leave no empty line.
    """
    parts = excerpt.select(F.col("listing_id").alias("id"), "excerpt")
    joined = listings.join(parts, "id", "left")
    amenities = F.when(F.size("amenities") > 0, F.concat(F.lit("Amenities: "), F.array_join("amenities", ", ")))
    kind = F.concat_ws(", ", "room_type", "property_type")
    guests = F.when(F.col("excerpt") != "", F.concat(F.lit("Guests say: "), F.col("excerpt")))
    text = F.concat_ws("\n", "name", "description", "neighbourhood", kind, amenities, guests)
    return joined.select("id", text.alias("doc_text"))


def hashing_embedder(width: int = config.EMBEDDING_WIDTH) -> Callable[[], Embedder]:
    """A deterministic stand-in for a model: signed word counts, unit length."""

    def load() -> Embedder:
        def embed(texts: Sequence[str]) -> np.ndarray:
            out = np.zeros((len(texts), width), dtype=np.float64)
            for row, text in enumerate(texts):
                for word in text.lower().split() or [""]:
                    digest = hashlib.blake2b(word.encode(), digest_size=8).digest()
                    slot = int.from_bytes(digest[:6], "little") % width
                    out[row, slot] += 1.0 if digest[6] & 1 else -1.0
                if not out[row].any():
                    out[row, 0] = 1.0
            return out / np.linalg.norm(out, axis=1, keepdims=True)

        return embed

    return load


def fill_embeddings(
    listings: DataFrame, load: Callable[[], Embedder], width: int = config.EMBEDDING_WIDTH
) -> DataFrame:
    """``(id, embedding)`` for listings that have a document and no vector yet.

    The model is loaded once per task. A result that is not unit length or has the wrong
    width stops the job.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embed = None
        for batch in batches:
            if not batch.num_rows:
                continue
            embed = embed or load()
            vectors = np.asarray(embed(batch.column("doc_text").to_pylist()), dtype=np.float64)
            if vectors.shape != (batch.num_rows, width):
                raise ValueError(f"the embedder returned {vectors.shape}, expected width {width}")
            vectors = (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32)
            offsets = pa.array(np.arange(0, (len(vectors) + 1) * width, width), pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.array(vectors.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), lists], names=["id", "embedding"])

    todo = listings.where(F.col("embedding").isNull() & F.col("doc_text").isNotNull())
    id_type = dict(listings.dtypes)["id"]
    return todo.select("id", "doc_text").mapInArrow(run, f"id {id_type}, embedding array<float>")


def embedding_coverage(listings: DataFrame, width: int = config.EMBEDDING_WIDTH) -> DataFrame:
    """Listings, and how many lack a vector or have one of the wrong width: one row."""
    missing = F.col("embedding").isNull()
    return listings.agg(
        F.count("*").alias("listings"),
        F.count_if(missing).alias("missing"),
        F.count_if(~missing & (F.size("embedding") != width)).alias("wrong_width"),
    )
