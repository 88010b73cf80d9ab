"""Spelling variants by permuterm rotations: words one code point apart, and their forms.

A word is marked with a terminator and rotated. Two words that differ in one replaced
code point share the rotation that starts right after it, but for its last code point;
a word and the same word with one code point more share a rotation and the longer one's
without its last code point. So every rotation is filed under the prefix that skips the
edited code point (``long``), and whole (``whole``); the filed rotations are
range-partitioned and sorted by prefix, and each range of one prefix is scanned once.
No pairs are made: a range tells each of its words how many others it holds and which is
the most frequent. A prefix can be followed by one code point only, so a range never
holds more rows than the alphabet has letters, and one whole rotation.

A word with a doubled letter would meet the shorter word once per equal letter; only the
first letter of such a stretch counts.

Texts are read in one narrow Arrow pass that counts the words of many texts before any
row leaves the task. Forms lead to more frequent words, at least twice as frequent each
time; roots follow by pointer doubling over written tables.

Defined results: a null text has no words; a null doc_id is written as nothing (``:word``);
repeated rows count again; of equal frequencies the smallest word in code-point order is
the form; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roostline.llm import batches
from roostline.session import stored

MARK = "$"
MIN_CHARS = 5
MIN_COUNT = 3
# A run whose checksum this divides loses a code point.
EDIT_EVERY = 97
# Words of a task that are put together before they are sent on.
HELD_ROWS = 200_000
# Runs of more bytes are checked one by one.
LONG_RUN = 64


def runs(texts: pa.Array) -> batches.Words:
    """Maximal runs of ``[A-Za-z\\u00C0-\\u00FF]``, A-Z lower-cased, found on UTF-8 bytes."""
    raw, offsets = batches.utf8(texts)
    low = raw.copy()
    low[(raw >= 65) & (raw <= 90)] += 32
    inside = (low >= 97) & (low <= 122)
    # These letters are the byte C3 and one byte after it.
    lead = raw == 0xC3
    inside |= lead
    inside[1:] |= lead[:-1]
    start, end = batches.edges(inside, offsets)
    return batches.Words(low, offsets, start, end, np.searchsorted(start, offsets))


@cache
def _crc_steps() -> np.ndarray:
    """Checksum of each single byte, from the reversed polynomial of zlib's CRC-32."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(0xEDB88320), step >> 1)
    return step


def checksums(before: np.ndarray, low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of the bytes ``start`` to ``end``, each carried on from the checksum ``before``."""
    state, size, steps = ~before, end - start, _crc_steps()
    order = np.argsort(-size, kind="stable")
    for i in order[: np.count_nonzero(size > LONG_RUN)]:
        state[i] = ~np.uint32(zlib.crc32(low[start[i] : end[i]].tobytes(), int(before[i])))
    order = order[np.count_nonzero(size > LONG_RUN) :]
    ordered = -size[order]
    for j in range(min(LONG_RUN, int(size[order[0]])) if len(order) else 0):
        active = order[: np.searchsorted(ordered, -j)]
        byte = low[start[active] + j].astype(np.uint32)
        state[active] = steps[(state[active] ^ byte) & np.uint32(255)] ^ (state[active] >> np.uint32(8))
    return ~state


def _strings(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    size = end - start
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    data = low[np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], size)]
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(data))


def counted(ids: pa.Array, texts: pa.Array, min_chars: int = MIN_CHARS) -> pa.Table:
    """(word, n) of the texts, after the edits that (doc_id, run) decides."""
    w = runs(texts)
    text = w.text
    key = batches.mix(batches.hashes(w) + text.astype(np.uint64) * batches.BASE)
    _, at, n = np.unique(key, return_index=True, return_counts=True)
    start, end = w.start[at], w.end[at]
    tails = np.concatenate([[0], np.cumsum((w.low & 0xC0) == 0x80)])
    chars = end - start - (tails[end] - tails[start])
    # A run that loses a code point has to be longer by one.
    enough = chars >= min_chars
    start, end, chars, n, text = start[enough], end[enough], chars[enough], n[enough], text[at[enough]]
    prefix = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids.to_pylist()], np.uint32)
    crc = checksums(prefix[text], w.low, start, end)
    edited = crc % EDIT_EVERY == 0
    whole = ~edited
    words, counts = [_strings(w.low, start[whole], end[whole])], [n[whole]]
    made, made_n = [], []
    for i in np.flatnonzero(edited & (chars > min_chars)):
        run = w.low[start[i] : end[i]].tobytes().decode()
        drop = int(crc[i]) % len(run)
        made.append(run[:drop] + run[drop + 1 :])
        made_n.append(int(n[i]))
    return pa.table({"word": pa.chunked_array([*words, pa.array(made, pa.string())]), "n": np.concatenate([*counts, np.array(made_n, np.int64)]).astype(np.int64)})


def _counting(min_chars: int):
    def summed(held: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        both = pa.concat_tables(held).group_by("word").aggregate([("n", "sum")])
        yield from both.select(["word", "n_sum"]).rename_columns(["word", "n"]).to_batches()

    def run(parts: Iterator[pa.RecordBatch]):
        held, rows = [], 0
        for batch in parts:
            _, at = batches.utf8(batch.column("text"))
            for part in batches.pieces(batch, np.diff(at)):
                held.append(counted(part.column("doc_id"), part.column("text"), min_chars))
                rows += held[-1].num_rows
                if rows >= HELD_ROWS:
                    yield from summed(held)
                    held, rows = [], 0
        if held:
            yield from summed(held)

    return run


def word_counts(documents: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of all documents, edits included."""
    parts = documents.select("doc_id", "text").mapInArrow(_counting(min_chars), "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def rotations(words: DataFrame) -> DataFrame:
    """(prefix, word, n, long, first): every rotation, whole and without its last code point.

    ``first`` says that the code point left out does not repeat the one before it.
    """
    size = F.char_length("word")
    each = words.select("word", "n", F.explode(F.sequence(F.lit(0), size)).alias("i"))
    i, word = F.col("i"), F.col("word")

    def part(begin: Column, length: Column) -> Column:
        return F.substring(word, begin + 1, length)

    whole = F.concat(part(i, size - i), F.lit(MARK), part(F.lit(0), i))
    skipped = F.concat(part(i + 1, size - i - 1), F.lit(MARK), part(F.lit(0), i))
    first = (i == 0) | (part(i, F.lit(1)) != part(i - 1, F.lit(1)))
    filed = F.when(i < size, F.array(F.struct(whole.alias("prefix"), F.lit(False).alias("long"), F.lit(False).alias("first")), F.struct(skipped.alias("prefix"), F.lit(True).alias("long"), first.alias("first"))))
    filed = filed.otherwise(F.array(F.struct(whole.alias("prefix"), F.lit(False).alias("long"), F.lit(False).alias("first"))))
    return each.select("word", "n", F.inline(filed))


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, n_near, best): how many words are one code point away, and the most frequent.

    ``best`` holds minus its frequency and the word.
    """
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rotations(words).repartitionByRange(parts, "prefix")
    group = Window.partitionBy("prefix")
    scan = group.orderBy(F.col("long").desc(), F.col("n").desc(), "word").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own = F.struct((-F.col("n")).alias("minus"), F.col("word").alias("word"))
    seen = ranged.select(
        "word",
        "n",
        "long",
        "first",
        F.first(own).over(scan).alias("best_long"),
        F.nth_value(own, 2).over(scan).alias("next_long"),
        F.min(F.when(~F.col("long"), own)).over(scan).alias("whole"),
        F.min(F.when(F.col("first"), own)).over(scan).alias("longer"),
        F.sum(F.col("long").cast("long")).over(scan).alias("n_long"),
        F.sum(F.col("first").cast("long")).over(scan).alias("n_longer"),
    )
    others = F.when(F.col("n_long") > 1, F.when(F.col("best_long.word") == F.col("word"), F.col("next_long")).otherwise(F.col("best_long")))
    shorter = F.when(F.col("first"), F.col("whole"))
    told = seen.select(
        "word",
        "n",
        F.when(F.col("long"), F.col("n_long") - 1 + shorter.isNotNull().cast("long")).otherwise(F.col("n_longer")).alias("n_near"),
        F.when(F.col("long"), F.least(others, shorter)).otherwise(F.col("longer")).alias("best"),
    ).where("n_near > 0")
    alone = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("struct<minus:bigint,word:string>").alias("best"))
    return told.unionByName(alone).groupBy("word", "n").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form: the last of its forms, by pointer doubling."""
    links = stored(forms.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "links")
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        links = stored(links.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "links")
        if links.where("moved").isEmpty():
            return links.select("word", "root")


def variants(documents: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, factor: int = 2) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word."""
    words = stored(word_counts(documents, min_chars, min_count), "words")
    held = -F.col("best.minus") >= factor * F.col("n")
    near = near_words(words).select("word", "n", "n_near", F.when(held, F.col("best.word")).alias("form"), F.when(held, -F.col("best.minus")).alias("form_n"))
    near = stored(near, "near")
    return near.join(roots(near), "word", "left").withColumn("root", F.coalesce("root", "word"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: words of all documents with their near words, form and root."""
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("word", "form", "root", "n", "n_near", "form_n")


SQL = r"""
WITH RECURSIVE tokens AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents
), pairs AS (
  SELECT id, run, count(*) AS n, hex(encode(id || ':' || run)) AS bytes FROM tokens WHERE length(run) >= 5 GROUP BY ALL
), steps AS (
  SELECT list(list_reduce(range(8), lambda c, _k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) ORDER BY b) AS step FROM range(256) AS r(b)
), crcs AS (
  SELECT run, n, xor(4294967295, list_reduce(list_transform(range(1, length(bytes), 2), lambda p: ('0x' || bytes[p:p + 1])::BIGINT),
           lambda c, x: xor(step[xor(c, x) % 256 + 1], c >> 8), 4294967295::BIGINT)) AS h
  FROM pairs, steps
), results AS (
  SELECT CASE WHEN h % 97 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, sum(n)::BIGINT AS n FROM crcs GROUP BY 1
), words AS (
  SELECT word, n FROM results WHERE length(word) >= 5 AND n >= 3
), cut AS (
  SELECT word, n, i, word[:i] AS a, word[i + 2:] AS b FROM words, unnest(range(0, length(word))) AS u(i)
), near AS (
  SELECT x.word, y.word AS other, y.n FROM cut x JOIN cut y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION SELECT c.word, w.word, w.n FROM cut c JOIN words w ON w.word = c.a || c.b
  UNION SELECT w.word, c.word, c.n FROM cut c JOIN words w ON w.word = c.a || c.b
), best AS (
  SELECT word, count(*) AS n_near, arg_min(struct_pack(other := other, n := n), struct_pack(a := -n, b := other)) AS top FROM near GROUP BY word
), formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top.n >= 2 * w.n THEN top.other END AS form, CASE WHEN top.n >= 2 * w.n THEN top.n END AS form_n
  FROM words w LEFT JOIN best USING (word)
), chain AS (
  SELECT word, word AS root FROM formed
  UNION ALL SELECT chain.word, f.form FROM chain JOIN formed f ON f.word = chain.root WHERE f.form IS NOT NULL
), ends AS (
  SELECT chain.word, chain.root FROM chain JOIN formed f ON f.word = chain.root WHERE f.form IS NULL
)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN ends USING (word)
"""
