"""Near-duplicate texts by ProbMinHash, banding and exact verification.

A text is its 5-word shingles (a text of fewer words, but not none, is one shingle),
weighted 1 + log(count). Each shingle is a Poisson process whose rate is its weight; its
arrivals fall on the registers of the sketch at random, and a register keeps the earliest.
A shingle stops as soon as its next arrival is later than every register of the text.
Two sketches agree in a register with the probability Jaccard similarity of the texts.

A link is a similarity of sets, and where one text repeats a passage the probability Jaccard
lies far below it. So a text that repeats a shingle has a second sketch, of unit weights,
whose registers agree with the set similarity; for all others the two are the same.

Registers of both are banded. Equal texts are one node from the start. In a bucket every node meets
the smallest one, so a bucket of n nodes gives n - 1 pairs; buckets of the same nodes are
taken once. Pairs are verified on whole texts: |A ∩ B| / |A ∪ B| of the shingles is 0.8 or
more. Classes are the connected components of all links. Where the nodes of a bucket end
in several components, they meet in cells of bounded size, each with its shingles, and a
task looks for links between the components; only such links leave it, at most one less
than the components of the cell. So a group of near copies gives rows in proportion to its
nodes, and no link between candidates is left out.

Defined results: texts without words (null, empty) are classes of their own, every row;
documents with the same words share a class whatever their ids; a class is named by its
smallest doc_id (null if it has none); repeated rows and ties change nothing; an empty
table gives an empty result; other columns are carried along or ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from roostline.llm import batches
from roostline.session import stored

SHINGLE = 5
SIMILARITY = 0.8
ROWS, BANDS = 5, 36
REGISTERS = ROWS * BANDS
# Nodes of a bucket that one task compares.
CELL = 500

RESULT = StructType(
    [
        StructField("node", BinaryType()),
        StructField("n_words", LongType()),
        StructField("bands", ArrayType(LongType())),
    ]
)


def shingles(w: batches.Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(text, 64-bit hash) of every shingle, repeats included."""
    h, n = batches.hashes(w), len(w.first) - 1
    count = np.diff(w.first)
    full = np.maximum(count - size + 1, 0)
    text = np.repeat(np.arange(n), full)
    at = np.arange(full.sum()) - np.repeat(np.cumsum(full) - full, full) + w.first[:-1][text]
    out = np.zeros(len(at), np.uint64)
    for i in range(size):
        out = batches.mix(out + h[at + i])
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for k, t in enumerate(short):
            for x in h[w.first[t] : w.first[t + 1]]:
                extra[k : k + 1] = batches.mix(extra[k : k + 1] + x)
        text, out = np.concatenate([text, short]), np.concatenate([out, extra])
        order = np.argsort(text, kind="stable")
        text, out = text[order], out[order]
    return text, out


def nodes(w: batches.Words) -> list[bytes | None]:
    """128 bits that name the word sequence of each text; None without words."""
    h = batches.hashes(w)
    place = np.arange(len(h)) - np.repeat(w.first[:-1], np.diff(w.first))
    halves = []
    for salt in (1, 2):
        mixed = batches.mix(h ^ batches.mix((place.astype(np.uint64) + np.uint64(1)) * np.uint64(2 * salt + 1) * batches.BASE + np.uint64(salt)))
        halves.append(batches.mix(batches.per_text(mixed, w.first) + np.diff(w.first).astype(np.uint64)))
    both = np.stack(halves, 1).byteswap().view(np.uint8).reshape(len(halves[0]), 16)
    return [x.tobytes() if c else None for x, c in zip(both, np.diff(w.first))]


def sketches(text: np.ndarray, shingle: np.ndarray, n: int, registers: int = REGISTERS, unit: bool = False) -> np.ndarray:
    """The shingle that arrives first in each register of each text; 0 without shingles.

    With ``unit`` every shingle weighs 1, however often it is repeated."""
    # 44 bits of the hash tell the shingles of one text apart here.
    both = np.sort((text.astype(np.uint64) << np.uint64(44)) | (shingle >> np.uint64(20)))
    first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.zeros(0, np.int64)
    weight = np.ones(len(first)) if unit else 1 + np.log(np.diff(np.append(first, len(both))))
    owner = (both[first] >> np.uint64(44)).astype(np.int64)
    element = both[first] & np.uint64((1 << 44) - 1)
    seed = batches.mix(element + np.uint64(0x51ED27))
    best = np.full(n * registers, np.inf)
    who = np.zeros(n * registers, np.uint64)
    time, points = np.zeros(len(owner)), np.zeros(len(owner), np.int64)
    # Short texts have few shingles to fill all registers: each gives several arrivals a round.
    step = np.clip(registers // np.maximum(np.bincount(owner, minlength=n), 1), 1, registers)
    live = np.arange(len(owner))
    while len(live):
        times = step[owner[live]]
        e = np.repeat(live, times)
        begin = np.cumsum(times) - times
        nth = np.arange(len(e)) - np.repeat(begin, times) + np.repeat(points[live], times)
        u = batches.mix(seed[e] + (nth.astype(np.uint64) + np.uint64(1)) * batches.BASE)
        gap = -np.log(((u >> np.uint64(24)).astype(np.float64) + 0.5) * 2.0**-40) / weight[e]
        run = np.cumsum(gap)
        run += np.repeat(time[live] - (run[begin] - gap[begin]), times)
        slot = owner[e] * registers + ((u & np.uint64(0xFFFFFF)) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(best, slot, run)
        won = best[slot] == run
        who[slot[won]] = element[e[won]] + np.uint64(1)
        time[live] = run[begin + times - 1]
        points[live] += times
        texts, at = np.unique(owner[live], return_inverse=True)
        latest = best.reshape(n, registers)[texts].max(1)
        live = live[time[live] < latest[at]]
    return who.reshape(n, registers)


def repeating(text: np.ndarray, shingle: np.ndarray, n: int) -> np.ndarray:
    """Whether each text holds a shingle more than once."""
    order = np.lexsort((shingle, text))
    text, shingle = text[order], shingle[order]
    again = (text[1:] == text[:-1]) & (shingle[1:] == shingle[:-1])
    return np.bincount(text[1:][again], minlength=n) > 0


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """One key for each band of each sketch; other bands have other keys."""
    n = len(sketch)
    band = np.zeros((n, BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        band = batches.mix(band + sketch.reshape(n, BANDS, ROWS)[:, :, i])
    return band


def _describe(parts):
    for part in parts:
        w = batches.words(part.column("text"))
        n = part.num_rows
        text, shingle = shingles(w)
        weighted = band_keys(sketches(text, shingle, n))
        has = np.diff(w.first) > 0
        # The bands of the second sketch that differ from those of the first.
        second, more = np.zeros((n, BANDS), np.uint64), np.zeros((n, BANDS), bool)
        again = repeating(text, shingle, n)
        if again.any():
            own = again[text]
            second[again] = band_keys(sketches((np.cumsum(again) - 1)[text[own]], shingle[own], int(again.sum()), unit=True))
            more[again] = second[again] != weighted[again]
        keys, keep = np.concatenate([weighted, second], 1), np.concatenate([np.repeat(has[:, None], BANDS, 1), more], 1)
        first = np.concatenate([[0], np.cumsum(keep.sum(1))])
        bands = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(keys[keep].view(np.int64), pa.int64()))
        yield part, [nodes(w), np.diff(w.first), bands]


def described(documents: DataFrame) -> DataFrame:
    """(doc_id, text_hash, node, n_words, bands) of each row."""
    found = batches.with_results(documents.select("doc_id", "text"), "text", RESULT, _describe)
    return found.select("row.doc_id", F.xxhash64(F.coalesce("row.text", F.lit(""))).alias("text_hash"), "result.*")


def buckets(bands: DataFrame) -> DataFrame:
    """(key, n, pivot, other) of the buckets of two nodes or more, each set of nodes once."""
    sums = bands.groupBy("key").agg(
        F.count("*").alias("n"), F.min("node").alias("pivot"), F.max("node").alias("other"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("sum")
    )
    return sums.where(F.col("n") > 1).groupBy("n", "pivot", "other", "sum").agg(F.min("key").alias("key")).drop("sum")


def _sets(parts):
    for part in parts:
        w = batches.words(part.column("text"))
        text, shingle = shingles(w)
        first = np.searchsorted(text, np.arange(part.num_rows + 1))
        yield part, [[np.unique(shingle[a:b]).tobytes() for a, b in zip(first[:-1], first[1:])]]


def shingle_sets(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, shingles) of the nodes of ``wanted`` (node, doc_id, text_hash), from whole texts."""
    d, w = documents.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")).alias("d"), wanted.alias("w")
    same = (F.col("d.text_hash") == F.col("w.text_hash")) & F.col("d.doc_id").eqNullSafe(F.col("w.doc_id"))
    texts = d.join(w, same).select("w.node", "d.text")
    made = batches.with_results(texts, "text", StructType([StructField("shingles", BinaryType())]), _sets)
    return made.select("row.node", "result.shingles").dropDuplicates(["node"])


def jaccard(a: bytes, b: bytes) -> float:
    """Similarity of two sorted arrays of distinct shingles."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) + len(y) else 0.0


def _compare(least):
    def run(runs):
        for batch in runs:
            a, b = batch.column("x").to_pylist(), batch.column("y").to_pylist()
            keep = pa.array([jaccard(p, q) >= least for p, q in zip(a, b)], pa.bool_())
            yield batch.select(["a", "b"]).append_column("linked", keep)

    return run


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """``pairs`` (a, b) with ``linked``: whether the texts reach ``least``."""
    x = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    y = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    # Sets that differ too much in size cannot be similar enough.
    small, large = F.least(F.length("x"), F.length("y")), F.greatest(F.length("x"), F.length("y"))
    near = pairs.join(x, "a").join(y, "b").where(small >= large * least)
    return near.select("a", "b", "x", "y").mapInArrow(_compare(least), "a binary, b binary, linked boolean").where("linked").select("a", "b")


def _cell_links(least: float):
    """Links of a cell that join nodes of different components, found on whole shingle sets.

    A node is compared with all others at once: its shingles are marked and counted in each.
    Two components that one link has joined are not linked again.
    """

    def run(rows: pa.Table) -> pa.Table:
        name = rows["node"].to_pylist()
        held = [np.frombuffer(x, np.uint64) for x in rows["shingles"].to_pylist()]
        size = np.array([len(x) for x in held])
        _, shingle = np.unique(np.concatenate(held), return_inverse=True)
        first = np.cumsum(size) - size
        _, root = np.unique(np.array(rows["root"].to_pylist(), dtype=object), return_inverse=True)
        marked, out = np.zeros(len(shingle) + 1, bool), []
        for i in np.flatnonzero(root != np.bincount(root).argmax()):
            own = shingle[first[i] : first[i] + size[i]]
            marked[own] = True
            both = np.add.reduceat(marked[shingle], first, dtype=np.int64)
            marked[own] = False
            for j in np.flatnonzero((both >= least * (size + size[i] - both)) & (root != root[i])):
                if root[j] != root[i]:
                    out.append((name[i], name[j]))
                    root[root == root[j]] = root[i]
        return pa.table({"a": pa.array([x for x, _ in out], pa.binary()), "b": pa.array([y for _, y in out], pa.binary())})

    return run


def unsettled_links(members: DataFrame, roots: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(a, b): links between components, in the buckets whose nodes are in several.

    ``members`` are (key, node). The nodes of a bucket's largest component need no comparison
    with each other. The others are cut into chunks of ``CELL``; each chunk meets every chunk
    of the largest component and of the others, so a bucket with few others has few cells.
    """
    told = members.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    held = told.groupBy("key", "root").agg(F.count("*").alias("c"))
    largest = held.groupBy("key").agg(F.max(F.struct("c", "root")).alias("most"), F.sum("c").alias("n")).where("most.c < n")
    chunks = lambda c: F.ceil(c / F.lit(CELL)).cast("bigint")
    cut = largest.select("key", F.col("most.root").alias("major"), chunks(F.col("n") - F.col("most.c")).alias("few"), chunks(F.col("most.c")).alias("many"))
    rows = told.join(cut, "key")
    own = F.pmod(F.xxhash64("node"), F.when(F.col("root") == F.col("major"), F.col("many")).otherwise(F.col("few")))
    upto = lambda c: F.sequence(F.lit(0).cast("bigint"), c - 1)
    # (i, j): j below ``many`` is a chunk of the largest component, beyond it one of the others.
    with_major = F.transform(upto(F.col("many")), lambda j: F.struct(F.col("own").alias("i"), j.alias("j")))
    with_others = F.transform(
        upto(F.col("few")), lambda o: F.struct(F.least("own", o).alias("i"), (F.greatest("own", o) + F.col("many")).alias("j"))
    )
    of_major = F.transform(upto(F.col("few")), lambda i: F.struct(i.alias("i"), F.col("own").alias("j")))
    cells = F.when(F.col("root") == F.col("major"), of_major).otherwise(F.concat(with_major, with_others))
    placed = rows.withColumn("own", own).select("key", "node", "root", F.explode(cells).alias("cell"))
    return placed.select("key", "cell.i", "cell.j", "node", "root").join(sets, "node").groupBy("key", "i", "j").applyInArrow(_cell_links(least), "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every linked node; root is the smallest node of its component.

    Each round takes the least root among neighbours and then the root of that root.
    """
    edges = stored(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).where("a <> b").distinct(), "edges")
    roots = stored(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("root")), "roots")
    while True:
        near = edges.join(roots, edges["b"] == roots["node"]).groupBy(F.col("a").alias("node")).agg(F.min("root").alias("low"))
        step = roots.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "low").alias("root"))
        up = roots.select(F.col("node").alias("root"), F.col("root").alias("upper"))
        new = stored(step.join(up, "root", "left").select("node", "old", F.least("root", F.coalesce("upper", "root")).alias("root")), "roots")
        if new.where("old <> root").isEmpty():
            return new.select("node", "root")
        roots = new.select("node", "root")


def classes(documents: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(doc_id, text_hash, n_words, node, root) of each row; null node and root without words."""
    rows = stored(described(documents), "sketches")
    name = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    distinct = stored(
        rows.where(F.col("node").isNotNull()).groupBy("node").agg(F.min(name).alias("name"), F.first("bands").alias("bands")),
        "distinct",
    )
    bands = distinct.select("node", F.explode("bands").alias("key"))
    found = stored(buckets(bands), "buckets")
    members = stored(bands.join(found.where("n > 2").select("key", "pivot"), "key"), "members")
    two = found.where("n = 2").select(F.col("pivot").alias("a"), F.col("other").alias("b"))
    star = members.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b"))
    pairs = stored(two.union(star).distinct(), "pairs")
    touched = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = distinct.join(touched, "node", "left_semi").select("node", "name.doc_id", "name.text_hash")
    sets = stored(shingle_sets(documents, wanted), "sets")
    links = stored(verified(pairs, sets, least), "links")
    more = stored(unsettled_links(members, components(links), sets, least), "more-links")
    roots = components(links.union(more))
    root, r = roots.alias("c"), rows.alias("r")
    return r.join(root, F.col("r.node") == F.col("c.node"), "left").select(
        "r.doc_id", "r.text_hash", "r.n_words", "r.node", F.coalesce("c.root", "r.node").alias("root")
    )


def without_copies(documents: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """``documents`` with one row of each class, that of the smallest doc_id; all without words stay."""
    found = classes(documents, least).select("doc_id", "text_hash", "root")
    name = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    chosen = found.where(F.col("root").isNotNull()).groupBy("root").agg(F.min(name).alias("name")).select("name.doc_id", "name.text_hash", F.lit(False).alias("all"))
    wordless = found.where(F.col("root").isNull()).select("doc_id", "text_hash", F.lit(True).alias("all")).distinct()
    row = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row")
    d = documents.select(row, "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")).alias("d")
    k = chosen.union(wordless).alias("k")
    kept = d.join(k, (F.col("d.text_hash") == F.col("k.text_hash")) & F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")))
    nth = F.row_number().over(Window.partitionBy("d.text_hash", "d.doc_id").orderBy(F.lit(0)))
    return kept.withColumn("nth", nth).where(F.col("all") | (F.col("nth") == 1)).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: the class of near-duplicate texts each document belongs to."""
    found = stored(classes(spark.read.parquet(f"{sf_dir}/documents.parquet")), "classes")
    ids = found.where(F.col("root").isNotNull()).groupBy("root").agg(F.min("doc_id").alias("class_id"))
    return found.join(ids, "root", "left").select(
        "doc_id", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), "n_words"
    )


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[p : p + least(len(w), 5) - 1], ' ') AS shingle
  FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS u(p) WHERE len(w) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM s a JOIN s b USING (shingle) JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  WHERE a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING count(*) >= 0.8 * (x.n + y.n - count(*))
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.other
)
SELECT d.doc_id, min(reach.other) AS class_id, any_value(len(w)) AS n_words FROM d JOIN reach USING (doc_id) GROUP BY d.doc_id
"""
