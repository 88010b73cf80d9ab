"""Line dedup by range-partitioned hashes: per-document keep bitmaps instead of text.

Every line becomes a 128-bit hash of its key (the line without spaces at its ends, A-Z
lower-cased). The hashes are range-partitioned and sorted by (hash, document, position)
and streamed twice where they lie: first for the hashes a partition begins or ends with,
which neighbours may share and whose counts are added up; then every task, knowing those,
counts the documents of its hashes, knows the first occurrence, and passes on the lines
that go. What comes back per document is a compressed bitmap of its lines, one bit each;
texts move only where a caller applies the bitmaps.

Defined results: a null or empty text is one empty line; a key shorter than
``min_chars`` code points never counts; a document is a distinct (doc_id, text), so
repeated rows count once and get the same bitmap, and a null doc_id is a value like any
other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import string
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from roostline.llm import batches
from roostline.session import stable, stored

SPACES = " \t\n\x0b\x0c\r"


def line_hashes(documents: DataFrame, min_chars: int = 1) -> DataFrame:
    """One row per line whose key is long enough: its document, position and hash."""
    text = F.coalesce("text", F.lit(""))
    lines = documents.select("doc_id", F.xxhash64(text).alias("text_hash"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    key = F.translate(F.btrim("line", F.lit(SPACES)), string.ascii_uppercase, string.ascii_lowercase)
    return (
        lines.withColumn("key", key)
        .where(F.char_length("key") >= min_chars)
        .select("doc_id", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64("key", F.lit(1)).alias("h2"))
    )


def by_range(hashed: DataFrame) -> DataFrame:
    """Lines range-partitioned and sorted by (hash, document, position).

    The document is part of the range, so one hash of very many lines is cut into several
    partitions; one document's occurrences of a hash stay together.
    """
    parts = int(hashed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ("h1", "h2", "doc_id", "text_hash")
    return hashed.repartitionByRange(parts, *order).sortWithinPartitions(*order, "pos")


def _stream(runs):
    """Per partition and hash: the number of documents, and where the first occurrence is."""
    held = None  # the last hash: [h1, h2, documents, first doc, first text, first pos, last doc, last text]
    for batch in runs:
        n = batch.num_rows
        if not n:
            continue
        h1, h2, pos, text = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("h1", "h2", "pos", "text_hash"))
        ids = batch.column("doc_id")
        known, doc = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False)
        new_key = np.ones(n, bool)
        new_key[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        new_doc = new_key.copy()
        new_doc[1:] |= (doc[1:] != doc[:-1]) | (known[1:] != known[:-1]) | (text[1:] != text[:-1])
        name = lambda i: int(doc[i]) if known[i] else None
        starts = np.flatnonzero(new_key)
        counts = np.add.reduceat(new_doc.astype(np.int64), starts)
        if held and held[:2] == [h1[0], h2[0]]:
            same = held[6:] == [name(0), text[0]]
            held[2] += int(counts[0]) - same
            begin = 1
        else:
            begin = 0
        done = [held] if held and (begin == 0 or len(starts) > 1) else []
        if len(starts) > begin:
            s, last = starts[begin:-1], starts[-1]
            head = [[x[0]] for x in zip(*done)] if done else [[]] * 8
            join = lambda a, b, t: pa.concat_arrays([pa.array(a, t), b.cast(t)])
            big = pa.int64()
            first_ids = ids.take(pa.array(s))
            yield pa.RecordBatch.from_arrays(
                [
                    join(head[0], pa.array(h1[s]), big), join(head[1], pa.array(h2[s]), big),
                    join(head[2], pa.array(counts[begin:-1]), big), join(head[3], first_ids, big),
                    join(head[4], pa.array(text[s]), big), join(head[5], pa.array(pos[s]), big),
                ],
                names=["h1", "h2", "n_docs", "doc_id", "text_hash", "pos"],
            )
            held = [h1[last], h2[last], int(counts[-1]), name(last), text[last], int(pos[last]), None, None]
        held[6:] = [name(n - 1), text[n - 1]]
    if held:
        names = ["h1", "h2", "n_docs", "doc_id", "text_hash", "pos"]
        yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in held[:6]], names=names)


def _edges(runs):
    """Of what ``_stream`` says of a partition, its first and its last hash."""
    first = last = None
    for found in _stream(runs):
        if found.num_rows:
            first, last = found.slice(0, 1) if first is None else first, found.slice(found.num_rows - 1)
    if first is not None:
        yield first
        if any(first.column(k) != last.column(k) for k in ("h1", "h2")):
            yield last


def shared_hashes(ranged: DataFrame) -> dict[tuple[int, int], tuple]:
    """Per hash that a partition begins or ends with: its documents in all, its first occurrence.

    Only these may be continued in a neighbouring partition. At most two per partition, so
    they may come to the driver, whatever the number of lines.
    """
    found = ranged.mapInArrow(_edges, "h1 long, h2 long, n_docs long, doc_id long, text_hash long, pos long")
    sums = found.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n"), F.min(F.struct("doc_id", "text_hash", "pos")).alias("first"))
    return {(r["h1"], r["h2"]): (r["n"], tuple(r["first"])) for r in sums.collect()}


def _lost(shared, min_docs: int, keep_first: bool):
    """The lines of a partition that go: those of hashes in ``min_docs`` documents or more.

    A hash that has shown ``min_docs`` documents is decided, and its lines go on at once; only
    lines of a hash with fewer so far are held until the next batch.
    """

    def run(runs):
        held, decided, prev = None, None, None
        known_sums = shared.value
        for batch in runs:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            n = batch.num_rows
            h1, h2, pos, text = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("h1", "h2", "pos", "text_hash"))
            ids = batch.column("doc_id")
            row = np.stack([h1, h2, ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False), text, pos])
            differs = np.ones((6, n), bool)
            differs[:, 1:] = row[:, 1:] != row[:, :-1]
            if prev is not None and held is None:
                differs[:, 0] = row[:, 0] != prev
            same_line = ~differs.any(0)  # of a document whose row is repeated
            new_key = differs[:2].any(0)
            new_key[0] = True
            new_doc = differs[:5].any(0) | new_key
            starts = np.flatnonzero(new_key)
            gone = np.add.reduceat(new_doc.astype(np.int64), starts) >= min_docs
            first = np.zeros(n, bool)
            first[starts] = True
            if decided == (h1[0], h2[0]):
                gone[0], first[0] = True, False
            for g in {0, len(starts) - 1}:
                at = starts[g]
                if (key := (h1[at], h2[at])) in known_sums:
                    total, (doc, of_text, of_pos) = known_sums[key]
                    gone[g] = total >= min_docs
                    inside = slice(at, starts[g + 1] if g + 1 < len(starts) else n)
                    is_doc = row[2, inside] == (doc is not None)
                    first[inside] = is_doc & (row[3, inside] == (doc or 0)) & (text[inside] == of_text) & (pos[inside] == of_pos)
            last = (h1[-1], h2[-1])
            wait = not gone[-1] and last not in known_sums
            held = batch.slice(starts[-1]) if wait else None
            decided, prev = (last if gone[-1] else None), row[:, -1]
            mask = np.repeat(gone, np.diff(np.append(starts, n))) & ~same_line
            if keep_first:
                mask &= ~first
            if mask.any():
                yield batch.filter(pa.array(mask)).select(["doc_id", "text_hash", "pos"])

    return run


def _bitmaps(runs):
    for batch in runs:
        made = []
        for drop in batch.column("drop").to_pylist():
            keep = np.ones((max(drop) // 8 + 1) * 8, np.uint8)
            keep[drop] = 0
            made.append(zlib.compress(np.packbits(keep).tobytes(), 6))
        sizes = [len(d) for d in batch.column("drop").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_hash"), pa.array(sizes, pa.int64()), pa.array(made, pa.binary())],
            names=["doc_id", "text_hash", "n_dropped", "keep"],
        )


def keep_bitmaps(documents: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """(doc_id, text_hash, n_dropped, keep) of each document that loses lines.

    ``keep`` is a zlib-compressed bitmap, one bit a line from the first, 1 to keep; lines
    past its end stay. With ``keep_first`` the first occurrence of a line survives.
    """
    # The ranges are kept as they are cut: both passes over them are narrow.
    ranged = stable(by_range(stored(line_hashes(documents, min_chars), "lines")))
    shared = documents.sparkSession.sparkContext.broadcast(shared_hashes(ranged))
    lost = ranged.mapInArrow(_lost(shared, min_docs, keep_first), "doc_id long, text_hash long, pos int")
    return (
        lost.groupBy("doc_id", "text_hash")
        .agg(F.collect_list("pos").alias("drop"))
        .mapInArrow(_bitmaps, "doc_id long, text_hash long, n_dropped long, keep binary")
    )


def with_bitmaps(documents: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """Every document (doc_id, text) with its bitmap, or null if it keeps all lines."""
    d = documents.select("doc_id", "text").alias("d")
    hashed = F.xxhash64(F.coalesce("d.text", F.lit("")))
    b = bitmaps.alias("b")
    return d.join(b, hashed.eqNullSafe(F.col("b.text_hash")) & F.col("d.doc_id").eqNullSafe(F.col("b.doc_id")), "left").select(
        "d.doc_id", "d.text", "b.n_dropped", "b.keep"
    )


def kept_lines(text: str | None, keep: bytes | None) -> tuple[list[str], int]:
    """The lines ``keep`` leaves of ``text``, and how many there were."""
    lines = (text or "").split("\n")
    if keep is None:
        return lines, len(lines)
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8))
    return [x for i, x in enumerate(lines) if i >= len(bits) or bits[i]], len(lines)


DIGEST = StructType([StructField("n_lines", LongType()), StructField("n_dropped", LongType()), StructField("kept_sha256", StringType())])


def _digests(parts):
    for part in parts:
        done = [kept_lines(t, k) for t, k in zip(part.column("text").to_pylist(), part.column("keep").to_pylist())]
        sums = [hashlib.sha256("\n".join(x).encode()).hexdigest() for x, _ in done]
        yield part, [[n for _, n in done], [n - len(x) for x, n in done], sums]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: lines of at least one code point found in ten documents or more go, everywhere."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    joined = with_bitmaps(documents, keep_bitmaps(documents, min_docs=10, min_chars=1))
    return batches.unpacked(batches.with_results(joined, "text", DIGEST, _digests))


SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), common AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
), flagged AS (
  SELECT k.*, c.key IS NOT NULL AS gone FROM keyed k LEFT JOIN common c ON k.key = c.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM flagged GROUP BY doc_id
"""
