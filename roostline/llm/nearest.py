"""Nearest neighbours by multiprobe p-stable hashing.

Each table hashes a vector to the cell ⌊(a·v + b) / w⌋ of ``HASHES`` Gaussian projections.
A query visits its own cell and perturbed ones, each projection one step down, up or not,
in the order of the summed squared distances to the cell walls: the order of estimated
success. Rows are grouped by cell, not by query: a task holds the vectors of its cells and
compares each cell with the queries that visit it, exactly and in double precision, and
keeps the best ``k`` per query; those of all tables and tasks are merged and ranked.

Cells of more than ``HOT_ROWS`` rows are dealt to several tasks, and the queries that visit
them go to each. The width w and the number of visits are fitted on at most ``SAMPLE``
vectors drawn by hash (the documented bound), as the least that reach ``RECALL`` there;
neighbours are farther apart in a sample than in all rows, so this errs to the safe side.
All rows are indexed.

Where the visited cells hold fewer than ``k`` candidates, or the k-th is farther than any
neighbour the fit has seen, the fit says nothing about the query: far from all rows, or in
a sparse region. Such a query is compared with all vectors, exactly, block by block.

Defined results: vectors that are null, zero, hold null or non-finite components, or have
another length than most, take no part as query or candidate; a row is known by its
vec_id, so repeated ids are one candidate at their least distance; ties go to the smaller
vec_id; fewer candidates give fewer rows; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roostline.llm.batches import mix
from roostline.session import stored

TABLES, HASHES = 6, 8
SAMPLE, SAMPLE_QUERIES = 4_000, 60
RECALL = 0.96
PART_ROWS = 50_000
HOT_ROWS = 20_000
SEED = 3
QUERY_BLOCK = 128
# Queries that one task compares with a slice of all vectors.
EXACT_QUERIES = 4_096


class Hashing(NamedTuple):
    """Projections of each table (seeded, so tasks make them themselves), width, visits and the farthest neighbour of the fit."""

    width: int
    step: float
    visits: int
    reach: float = float("inf")

    def project(self, v: np.ndarray, table: int) -> np.ndarray:
        rng = np.random.default_rng([SEED, table])
        return (v @ rng.normal(size=(self.width, HASHES)) + rng.uniform(0, self.step, HASHES)) / self.step


def cell_keys(cells: np.ndarray) -> np.ndarray:
    """One number for each row of cell coordinates along the last axis."""
    key = np.zeros(cells.shape[:-1], np.uint64)
    for i in range(cells.shape[-1]):
        key = mix(key + cells[..., i].astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(i + 1))
    return key.view(np.int64)


def steps() -> np.ndarray:
    """All ways to move each coordinate one step down, up or not."""
    return np.array(list(itertools.product((0, -1, 1), repeat=HASHES)), np.int64)


def visited(h: Hashing, queries: np.ndarray, table: int, moves: np.ndarray) -> np.ndarray:
    """Keys of the cells each query visits, likeliest first."""
    x = h.project(queries, table)
    cell = np.floor(x).astype(np.int64)
    low = x - cell
    cost = np.zeros((len(x), len(moves)))
    for i in range(HASHES):
        cost += np.stack([np.zeros(len(x)), (1 - low[:, i]) ** 2, low[:, i] ** 2], 1)[:, moves[:, i]]
    first = np.argsort(cost, axis=1, kind="stable")[:, : h.visits]
    return cell_keys(cell[:, None, :] + moves[first])


def distances(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Squared distances, each summed over the differences of its own pair."""
    gap = queries[:, None, :] - rows[None, :, :]
    return np.einsum("ijk,ijk->ij", gap, gap)


def fit(sample: np.ndarray, k: int) -> Hashing:
    """Width and visits that find ``RECALL`` of the ``k`` nearest within ``sample``."""
    width = sample.shape[1]
    asked = sample[: min(SAMPLE_QUERIES, len(sample))]
    d = np.stack([distances(asked[i : i + 1], sample)[0] for i in range(len(asked))]) if len(asked) else np.zeros((0, 0))
    d[np.arange(len(asked)), np.arange(len(asked))] = np.inf
    k = min(k, len(sample) - 1)
    if k < 1:
        return Hashing(width, 1.0, 1)
    near = np.argsort(d, axis=1, kind="stable")[:, :k]
    reach = np.sqrt(np.take_along_axis(d, near, 1))
    farthest = float(reach.max())
    reach = reach[reach > 0]
    step, moves = float(np.median(reach)) * 1.35 if len(reach) else 1.0, steps()
    while True:
        h = Hashing(width, step, len(moves))
        first = np.full(d.shape, len(moves))
        for t in range(TABLES):
            key = cell_keys(np.floor(h.project(sample, t)).astype(np.int64))
            for i, seen in enumerate(visited(h, asked, t, moves)):
                order = np.argsort(seen)
                at = np.minimum(np.searchsorted(seen[order], key), len(seen) - 1)
                first[i] = np.minimum(first[i], np.where(seen[order][at] == key, order[at], len(moves)))
        need = np.sort(np.take_along_axis(first, near, 1).ravel())
        visits = int(need[min(len(need) - 1, int(np.ceil(RECALL * len(need))) - 1)]) + 1
        if visits <= len(moves):
            return h._replace(visits=visits, reach=farthest)
        step *= 1.25


def usable(vector: Column) -> Column:
    """Whether a vector takes part: finite components, not all of them zero."""
    real = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce(vector.isNotNull() & F.forall(vector, real) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column, width: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def cells(vectors: DataFrame, h: Hashing) -> DataFrame:
    """(tbl, key, vec_id, vector): each vector in its cell of each table."""

    def run(runs):
        for batch in runs:
            v = _matrix(batch.column("vector"), h.width)
            for t in range(TABLES):
                key = cell_keys(np.floor(h.project(v, t)).astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(v), t), pa.int32()), pa.array(key), batch.column("vec_id"), batch.column("vector")],
                    names=["tbl", "key", "vec_id", "vector"],
                )

    return vectors.mapInArrow(run, f"tbl int, key long, vec_id {vectors.schema['vec_id'].dataType.simpleString()}, vector array<double>")


def probes(queries: DataFrame, h: Hashing) -> DataFrame:
    """(tbl, query_id, key): the cells each query visits."""

    def run(runs):
        moves = steps()
        for batch in runs:
            ids, v = batch.column("vec_id").to_numpy(zero_copy_only=False), _matrix(batch.column("vector"), h.width)
            for a in range(0, len(v), QUERY_BLOCK):
                for t in range(TABLES):
                    seen = visited(h, v[a : a + QUERY_BLOCK], t, moves)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(seen.size, t), pa.int32()), pa.array(np.repeat(ids[a : a + QUERY_BLOCK], seen.shape[1]), pa.int64()), pa.array(seen.ravel())],
                        names=["tbl", "query_id", "key"],
                    )

    return queries.mapInArrow(run, "tbl int, query_id long, key long")


def closest(queries: np.ndarray, rows: np.ndarray, ids: np.ndarray, allowed: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the places in ``rows`` of the ``k`` nearest ``allowed`` ids and their exact squared distances.

    A matrix product tells all distances but for its rounding; what may be among the ``k``
    nearest within that error is measured exactly. An id on several rows counts once, at its
    least distance; ties go to the smaller id.
    """
    with np.errstate(over="ignore", invalid="ignore"):
        norms = np.einsum("ij,ij->i", queries, queries)[:, None] + np.einsum("ij,ij->i", rows, rows)[None, :]
        rough = norms - 2 * (queries @ rows.T)
    error = 8 * np.finfo(np.float64).eps * (rows.shape[1] + 8) * norms
    out = []
    for i in range(len(queries)):
        at = np.flatnonzero(allowed[i])
        if np.isfinite(rough[i, at]).all() and len(at) > k:
            low, high, many = rough[i, at] - error[i, at], rough[i, at] + error[i, at], k
            while many < len(at):
                first = np.argpartition(high, many - 1)[:many]
                if len(np.unique(ids[at[first]])) >= k:
                    at = at[low <= high[first].max()]
                    break
                many *= 2
        exact = distances(queries[i : i + 1], rows[at])[0]
        real = np.isfinite(exact)
        at, exact = at[real], exact[real]
        by = np.lexsort((exact, ids[at]))
        by = by[np.concatenate([[True], ids[at][by][1:] != ids[at][by][:-1]])] if len(by) else by
        by = by[np.lexsort((ids[at][by], exact[by]))][:k]
        out.append((at[by], exact[by]))
    return out


def _found(names: np.ndarray, ids: np.ndarray, results: list[list[tuple[np.ndarray, np.ndarray]]]) -> pa.Table:
    flat = [x for block in results for x in block]
    join = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
    return pa.table(
        {
            "query_id": np.repeat(names[: len(flat)].astype(np.int64), [len(at) for at, _ in flat]),
            "vec_id": join([ids[at] for at, _ in flat], np.int64),
            "score": np.sqrt(join([d for _, d in flat], np.float64)),
        }
    )


def _visit(k: int, width: int):
    def run(index: pa.Table, asked: pa.Table) -> pa.Table:
        if not index.num_rows or not asked.num_rows:
            return _found(np.zeros(0, np.int64), np.zeros(0, np.int64), [])
        key, ids = index["key"].to_numpy(), index["vec_id"].to_numpy()
        order = np.argsort(key, kind="stable")
        key, ids, rows = key[order], ids[order], _matrix(index["vector"], width)[order]
        cell, of = np.unique(key, return_inverse=True)
        names, queries, seen = asked["query_id"].to_numpy(), _matrix(asked["vector"], width), asked["keys"].combine_chunks()
        results = []
        for a in range(0, len(names), QUERY_BLOCK):
            part = seen.slice(a, QUERY_BLOCK)
            want = part.flatten().to_numpy()
            who = np.repeat(np.arange(len(part)), np.diff(part.offsets.to_numpy()))
            at = np.minimum(np.searchsorted(cell, want), len(cell) - 1)
            hit = cell[at] == want
            visits = np.zeros((len(part), len(cell)), bool)
            visits[who[hit], at[hit]] = True
            # Only the rows of cells that some query of the block visits.
            near = np.flatnonzero(visits.any(0)[of])
            allowed = visits[:, of[near]] & (ids[near] != names[a : a + len(part), None])
            results.append([(near[x], d) for x, d in closest(queries[a : a + len(part)], rows[near], ids[near], allowed, k)])
        return _found(names, ids, results)

    return run


def _compare(k: int, width: int):
    def run(index: pa.Table, asked: pa.Table) -> pa.Table:
        if not index.num_rows or not asked.num_rows:
            return _found(np.zeros(0, np.int64), np.zeros(0, np.int64), [])
        ids, rows = index["vec_id"].to_numpy(), _matrix(index["vector"], width)
        names, queries = asked["query_id"].to_numpy(), _matrix(asked["vector"], width)
        blocks = range(0, len(names), QUERY_BLOCK)
        return _found(names, ids, [closest(queries[a : a + QUERY_BLOCK], rows, ids, ids != names[a : a + QUERY_BLOCK, None], k) for a in blocks])

    return run


def compared(vectors: DataFrame, n: int, asked: DataFrame, queries: int, k: int, width: int) -> DataFrame:
    """(query_id, vec_id, score): the ``k`` nearest of each slice of ``vectors`` to each of ``asked`` (query_id, vector)."""
    slices, blocks = int(n // PART_ROWS + 1), int(queries // EXACT_QUERIES + 1)
    every = lambda m, name: F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(name)
    deal = lambda c, m, name: F.pmod(F.xxhash64(c, "vector"), F.lit(m)).cast("int").alias(name)
    rows = vectors.select("vec_id", "vector", deal("vec_id", slices, "slice"), every(blocks, "block"))
    sent = asked.select("query_id", "vector", deal("query_id", blocks, "block"), every(slices, "slice"))
    groups = rows.groupBy("slice", "block").cogroup(sent.groupBy("slice", "block"))
    return groups.applyInArrow(_compare(k, width), "query_id long, vec_id long, score double")


def ranked(found: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest of each query, each vec_id once."""
    merged = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return merged.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def neighbours(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` nearest rows of ``vectors`` (vec_id, vector)
    to each of ``queries``, its own row left out."""
    vectors = vectors.where(usable(F.col("vector")) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long"), F.col("vector").cast("array<double>").alias("vector"))
    sizes = vectors.groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), "width").first()
    width = sizes["width"] if sizes else 1
    fits = F.size("vector") == width
    vectors, n = vectors.where(fits), sizes["count"] if sizes else 0
    asked = queries.where(usable(F.col("vector")) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long"), F.col("vector").cast("array<double>").alias("vector")).where(fits)
    sample = vectors.orderBy(F.xxhash64("vec_id", F.lit(SEED)), "vec_id").limit(SAMPLE).select("vector").toArrow()
    h = fit(_matrix(sample["vector"], width), k)
    index, visits = stored(cells(vectors, h), "cells"), probes(asked, h)
    parts = int(n // PART_ROWS + 2)
    hot = index.groupBy("tbl", "key").count().where(F.col("count") > HOT_ROWS).select("tbl", "key", F.ceil(F.col("count") / HOT_ROWS).alias("pieces"))
    part = (F.pmod(F.xxhash64("key", "piece"), F.lit(parts)) + F.col("tbl") * parts).alias("part")
    own = F.coalesce(F.pmod(F.xxhash64("vec_id"), F.col("pieces")), F.lit(0)).cast("long").alias("piece")
    dealt = index.join(hot, ["tbl", "key"], "left").select("tbl", "key", "vec_id", "vector", own).select(part, "key", "vec_id", "vector")
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("pieces", F.lit(1)).cast("bigint") - 1)).alias("piece")
    sent = visits.join(hot, ["tbl", "key"], "left").select("tbl", "key", "query_id", every).select(part, "key", "query_id")
    lists = sent.groupBy("part", "query_id").agg(F.collect_set("key").alias("keys"))
    lists = lists.join(asked.select(F.col("vec_id").alias("query_id"), "vector"), "query_id").select("part", "query_id", "vector", "keys")
    found = dealt.groupBy("part").cogroup(lists.groupBy("part")).applyInArrow(_visit(k, width), "query_id long, vec_id long, score double")
    met = stored(ranked(found, k), "met")
    full = met.groupBy("query_id").agg(F.count("*").alias("n"), F.max("score").alias("last")).where((F.col("n") >= k) & (F.col("last") <= h.reach))
    short = asked.select(F.col("vec_id").alias("query_id"), "vector").join(full, "query_id", "left_anti")
    short = stored(short, "short-queries")
    open_ = short.count()
    if not open_:
        return met
    exact = ranked(compared(vectors, n, short, open_, k, width), k)
    return met.join(full.select("query_id"), "query_id", "left_semi").select(*exact.columns).union(exact)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: the ten nearest rows to every hundredth."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").alias("vector"))
    return neighbours(vectors, vectors.where(F.col("vec_id") % 100 == 0), 10)
