"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source should be taken target/size times; the whole part is sure, the
fraction is rounded. Two fractional documents meet and words are moved from one to the
other, in a random direction that keeps each document's expected count, until one of the
two is whole; the words of the source in the mix stay the same at every step. Chunks of a
source do this in parallel and leave one fractional document each; these residuals meet
again, chunk by chunk, in a reduction tree whose root leaves one document per source. It
goes to its nearer side, and what that adds or lacks is made up for by documents of the
root that may be rounded either way; this last step is not random.

Defined results: a null text has no words and is taken for nothing (its whole part); a
null source is a source of its own, the last one; equal rows are interchangeable; a
source without words has target 0; an empty table gives an empty result; other columns
are carried along or ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roostline.session import stored

WEIGHTS = (5, 2, 1)
MOST = 3
CHUNK_ROWS = 20_000
BLOCKS = 20  # blocks of equal rows that make a chunk
FAN_IN = 1_000
EPS = 1e-9


def sized(documents: DataFrame) -> DataFrame:
    """(doc_id, source, text_hash, size) of each row; size is its number of words."""
    words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    return documents.select("doc_id", "source", F.xxhash64("text").alias("text_hash"), words.alias("size"))


def grouped(rows: DataFrame) -> DataFrame:
    """Equal rows of ``sized`` as one, with their number ``n``."""
    return rows.groupBy("doc_id", "source", "text_hash", "size").agg(F.count("*").alias("n"))


def targets(groups: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, n_docs, source_size, target) of ``grouped`` rows: shares of all words by weight.

    No target is above ``most`` times its source; the excess goes to the others by weight
    until none is above. In the order of room per weight a source is full exactly if its
    room is below the share it would get with all before it full. One row a source.
    """
    sums = groups.groupBy("source").agg(F.sum("n").alias("n_docs"), F.sum(F.col("n") * F.col("size")).alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    ranked = sums.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (place % len(weights) + 1).cast("int")))
    room = (F.col("source_size") * most).cast("double")
    order = Window.orderBy(F.col("room") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy(F.lit(0))
    shared = (
        ranked.withColumn("room", room)
        .withColumn("total", F.sum("source_size").over(every).cast("double"))
        .withColumn("share", (F.col("total") - F.coalesce(F.sum("room").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
        .withColumn("full", F.col("room") < F.col("share") * F.col("weight"))
    )
    level = (F.col("total") - F.sum(F.when(F.col("full"), F.col("room")).otherwise(0.0)).over(every)) / F.sum(
        F.when(~F.col("full"), F.col("weight")).otherwise(0)
    ).over(every)
    target = F.when(F.col("full"), F.col("room")).otherwise(F.least(level * F.col("weight"), F.col("room")))
    return shared.select("source", "n_docs", "source_size", target.alias("target"))


def pivotal(size: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int]:
    """Round ``p`` to 0 or 1 but for one place, keeping the sum of p·size; -1: none is left."""
    p, held = p.copy(), -1
    draws = rng.random(len(p))
    for i in range(len(p)):
        if size[i] == 0 or p[i] < EPS or p[i] > 1 - EPS:
            p[i] = 0.0 if size[i] == 0 else round(p[i])
            continue
        if held < 0:
            held = i
            continue
        to_i = min((1 - p[i]) * size[i], p[held] * size[held])
        to_held = min(p[i] * size[i], (1 - p[held]) * size[held])
        move = to_i if draws[i] * (to_i + to_held) < to_held else -to_held
        for at, q in ((i, p[i] + move / size[i]), (held, p[held] - move / size[held])):
            p[at] = 0.0 if q < EPS else 1.0 if q > 1 - EPS else q
        open_ = [x for x in (held, i) if 0 < p[x] < 1]
        held = open_[0] if open_ else -1
    return p, held


def _evened(size: np.ndarray, wanted: np.ndarray, p: np.ndarray, held: int) -> np.ndarray:
    """The last open place to its nearer side; what that adds or lacks is made up for.

    A long document that stayed open may be thousands of words off. Documents that could be
    rounded either way and fit into the difference change sides, the longest first.
    """
    if held >= 0:
        p[held] = round(p[held])
    over = float(((p - wanted) * size).sum())
    for i in np.argsort(-size, kind="stable"):
        if 0 < size[i] <= abs(over) and EPS < wanted[i] < 1 - EPS and (p[i] == 1) == (over > 0):
            over -= size[i] if over > 0 else -size[i]
            p[i] = 1 - p[i]
    return p


def _round(last: bool, seed: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        # Equal rows came as one entry of bounded number; from here on each is its own.
        n = rows["n"].to_numpy()
        offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        rows = rows.iloc[np.repeat(np.arange(len(rows)), n)]
        rows = rows.assign(nth=rows["nth"].to_numpy() + offset, n=1)
        # Large documents first, so that what is left at the end is small.
        rows = rows.sort_values(["size", "doc_id", "text_hash", "nth"], ascending=[False, True, True, True], kind="stable", na_position="last")
        source = rows["source"].iloc[0]
        name = zlib.crc32(source.encode()) if isinstance(source, str) else 0
        rng = np.random.default_rng([seed, name, int(rows["chunk"].iloc[0]), len(rows)])
        p, held = pivotal(rows["size"].to_numpy(np.float64), rows["p"].to_numpy(np.float64), rng)
        if last:
            p = _evened(rows["size"].to_numpy(np.float64), rows["p"].to_numpy(np.float64), p, held)
        return rows.assign(p=p)

    return run


def copies(rows: DataFrame, seed: int = 17, chunk_rows: int = CHUNK_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """``rows`` (``sized``) with source_size, target and ``copies``, how often each is taken.

    Equal rows are numbered by ``nth`` from 0. They are dealt over the chunks in blocks of
    bounded size, so that a row repeated any number of times is not one chunk.
    """
    groups = stored(grouped(rows), "sized")
    goal = stored(targets(groups), "targets")
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    block = max(1, chunk_rows // BLOCKS)
    first = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(block).cast("long"))).alias("nth")
    blocks = groups.select("*", first).withColumn("n", F.least(F.col("n") - F.col("nth"), F.lit(block)))
    joined = blocks.alias("r").join(goal.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source")))
    open_ = joined.select(
        "r.doc_id", "r.source", "r.text_hash", "r.size", "t.source_size", "t.target", "r.nth", "r.n",
        F.floor(times + EPS).cast("long").alias("whole"),
        F.greatest(times - F.floor(times + EPS), F.lit(0.0)).alias("p"),
        F.pmod(F.xxhash64("r.doc_id", "r.text_hash", "r.nth"), F.floor(F.col("t.n_docs") / chunk_rows) + 1).cast("long").alias("chunk"),
    )
    chunks = int((goal.agg(F.max("n_docs")).first()[0] or 0) // chunk_rows + 1)
    done = []
    while True:
        last = chunks == 1
        made = stored(open_.groupBy("source", "chunk").applyInPandas(_round(last, seed + len(done)), open_.schema), "rounded")
        whole = F.col("p").isin(0.0, 1.0)
        done.append(made.where(whole))
        if last:
            break
        chunks = (chunks + fan_in - 1) // fan_in
        # One residual per chunk at most goes on, to be rounded with those of its neighbours.
        open_ = made.where(~whole).withColumn("chunk", F.floor(F.col("chunk") / fan_in).cast("long"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("doc_id", "source", "text_hash", "size", "nth", "source_size", "target", (F.col("whole") + F.col("p").cast("long")).alias("copies"))


def mixed(documents: DataFrame) -> DataFrame:
    """``documents`` with each row repeated as often as the mix takes it, maybe never.

    Rows meet their counts by (doc_id, source, text); those equal in these by their number,
    in the order of a hash of the whole row.
    """
    keys = ("doc_id", "source", "text_hash")
    row = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row")
    own = documents.select(row, "doc_id", "source", F.xxhash64("text").alias("text_hash"))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64("row"))) - 1
    a, b = own.withColumn("nth", nth).alias("a"), copies(sized(documents)).select(*keys, "nth", "copies").alias("b")
    same = F.col("a.nth") == F.col("b.nth")
    for k in keys:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    taken = a.join(b, same).where(F.col("copies") > 0).select("a.row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return taken.select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: how many words of each document the mix takes."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return copies(sized(documents)).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken")
    )
