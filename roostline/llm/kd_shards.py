"""Sharding by a k-d tree: split at weighted medians along the widest metadata dimension.

A node that stands for k shards is cut along the dimension in which its documents spread
widest, at the place where ⌊k/2⌋/k of its bytes lie on the left, until every leaf is one
shard of the target size. Medians are exact and distributed: each dimension is a 62-bit
key (place in the dimension, then checksum of the text, then hash of the document, so
equal texts lie together and no tie is unsplittable), and a cut is found digit by digit
from sums of bytes per digit. Only these sums (``DIGIT`` values a node at most) and the
few cuts reach one place; documents are read, never moved.

Defined results: a null text has no bytes and the checksum of the empty text; a null
doc_id is a value; rows that are equal in every key lie in one shard; an empty table
gives an empty result; other columns are carried along or ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roostline.session import stored

SHARDS = 40
ROW_BYTES = 16
# Bits of a key: place in the dimension, checksum of the text, hash of the document.
PLACE_BITS, TEXT_BITS, DOC_BITS = 18, 24, 20
DIGITS = (18, 14, 15, 15)
# Documents of a shard that one task numbers.
SLOT_ROWS = 100_000


def size_of() -> Column:
    return (F.octet_length(F.coalesce(F.col("text"), F.lit(""))) + ROW_BYTES).cast("long")


def dimensions() -> dict[str, Column]:
    """Metadata of a document that its text alone decides: length, script and layout."""
    text = F.coalesce(F.col("text"), F.lit(""))
    size = F.octet_length(text).cast("double")
    return {
        "length": F.log1p(size),
        "script": size / F.greatest(F.char_length(text), F.lit(1)),
        "lines": F.log1p((F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit("")))).cast("double")),
    }


@dataclass
class Node:
    """Shards ``first`` to ``first + shards - 1``; cut once ``key`` is set."""

    first: int
    shards: int
    key: int | None = None
    cut: int = 0
    left: "Node | None" = None
    right: "Node | None" = None


def _assign(node: Node, keys: list[Column], leaf: Callable[[Node], Column]) -> Column:
    if node.key is None:
        return leaf(node)
    return F.when(keys[node.key] <= node.cut, _assign(node.left, keys, leaf)).otherwise(_assign(node.right, keys, leaf))


def _leaves(node: Node) -> list[Node]:
    return [node] if node.key is None else _leaves(node.left) + _leaves(node.right)


def keys_of(places: list[Column], ranges: list[tuple[float, float]]) -> list[Column]:
    """The 62-bit key of each dimension, its values spread evenly over ``ranges``."""
    text = F.shiftrightunsigned(F.crc32(F.encode(F.coalesce(F.col("text"), F.lit("")), "utf-8")), 32 - TEXT_BITS)
    doc = F.shiftrightunsigned(F.xxhash64(F.col("doc_id").cast("string"), F.lit(7)), 64 - DOC_BITS)
    low = F.shiftleft(text, DOC_BITS).bitwiseOR(doc)
    out = []
    for place, (least, most) in zip(places, ranges):
        top = (1 << PLACE_BITS) - 1
        step = F.floor((place - least) / (most - least) * top) if most > least else F.lit(0)
        out.append(F.shiftleft(F.least(F.greatest(step, F.lit(0)), F.lit(top)).cast("long"), TEXT_BITS + DOC_BITS).bitwiseOR(low))
    return out


def _cuts(compact: DataFrame, keys: list[str], node_of: Column, wanted: dict[int, tuple[int, float]]) -> dict[int, int]:
    """For each node number its (key, bytes that go left): the largest key on the left."""
    shift, found, rest = sum(DIGITS), {n: 0 for n in wanted}, {n: w for n, (_, w) in wanted.items()}
    chosen = F.coalesce(*[F.when(F.col("node") == n, F.col(keys[k])) for n, (k, _) in wanted.items()])
    base = compact.select(node_of.alias("node"), "size", *keys).where(F.col("node").isin(list(wanted))).select("node", "size", chosen.alias("key"))
    for bits in DIGITS:
        high, shift = shift, shift - bits
        prefix = F.coalesce(*[F.when(F.col("node") == n, F.lit(v)) for n, v in found.items()])
        digit = F.shiftrightunsigned("key", shift).bitwiseAND(F.lit((1 << bits) - 1))
        sums = base.where(F.shiftrightunsigned("key", high) == prefix).groupBy("node", digit.alias("digit")).agg(F.sum("size").alias("size"))
        aim = F.coalesce(*[F.when(F.col("node") == n, F.lit(float(w))) for n, w in rest.items()])
        run = F.sum("size").over(Window.partitionBy("node").orderBy("digit"))
        # The digit in which the aim is reached; at the last one, the nearer of both sides.
        reach = sums.select("node", "digit", "size", run.alias("run")).withColumn("reached", F.col("run") >= aim)
        rows = (
            reach.groupBy("node")
            .agg(
                F.min(F.when(F.col("reached"), F.struct("digit", "size", "run"))).alias("at"),
                F.max(F.struct("digit", "size", "run")).alias("last"),
                F.max(F.when(~F.col("reached"), F.col("digit"))).alias("before"),
            )
            .collect()
        )
        for r in rows:
            at, left = r["at"] or r["last"], rest[r["node"]]
            digit_, below = at["digit"], at["run"] - at["size"]
            if not shift and r["before"] is not None and left - below < at["run"] - left:
                digit_ = r["before"]
            found[r["node"]] = (found[r["node"]] << bits) | digit_
            rest[r["node"]] = left - below
    return found


def fit(compact: DataFrame, keys: list[str], shards: int = SHARDS) -> Node:
    """The tree over ``compact`` (size and one column a dimension), level by level."""
    root = Node(0, shards)
    while open_ := [n for n in _leaves(root) if n.shards > 1]:
        node_of = _assign(root, [F.col(k) for k in keys], lambda n: F.lit(n.first))
        spread = [(F.max(k) - F.min(k)).cast("double").alias(k) for k in keys]
        stats = {r["node"]: r for r in compact.groupBy(node_of.alias("node")).agg(F.sum("size").alias("size"), *spread).collect()}
        wanted = {}
        for n in open_:
            if s := stats.get(n.first):
                wanted[n.first] = (max(range(len(keys)), key=lambda i: s[keys[i]]), s["size"] * (n.shards // 2) / n.shards)
        cuts = _cuts(compact, keys, node_of, wanted) if wanted else {}
        for n in open_:
            half = n.shards // 2
            n.left, n.right = Node(n.first, half), Node(n.first + half, n.shards - half)
            n.key, n.cut = wanted.get(n.first, (0, 0))[0], cuts.get(n.first, -1)
    return root


def shard_column(documents: DataFrame, shards: int = SHARDS, dims: dict[str, Column] | None = None) -> Column:
    """The shard of each row of ``documents``, as an expression over it."""
    places = list((dims or dimensions()).values())
    least = documents.agg(*[f(p).alias(f"{f.__name__}{i}") for i, p in enumerate(places) for f in (F.min, F.max)]).first()
    ranges = [(float(least[f"min{i}"] or 0), float(least[f"max{i}"] or 0)) for i in range(len(places))]
    keys = keys_of(places, ranges)
    names = [f"k{i}" for i in range(len(keys))]
    compact = stored(documents.select(size_of().alias("size"), *[k.alias(n) for k, n in zip(keys, names)]), "kd")
    return _assign(fit(compact, names, shards), keys, lambda n: F.lit(n.first)).cast("int")


def numbered(df: DataFrame) -> DataFrame:
    """``df`` (shard, doc_id, size, text_crc32) with a gapless ``slot`` in each shard.

    A shard is numbered in parts of about ``SLOT_ROWS`` rows, shifted by the parts before.
    """
    rows = df.groupBy("shard").count().agg(F.max("count")).first()[0] or 0
    part = F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(rows // SLOT_ROWS + 1))
    df = df.withColumn("part", part)
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = df.groupBy("shard", "part").count().select("shard", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("shift"))
    own = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size"))
    return df.withColumn("own", own).join(shift, ["shard", "part"]).withColumn("slot", F.col("own") - 1 + F.col("shift")).drop("part", "own", "shift")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: all documents in forty shards of near-equal bytes."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    shard = shard_column(documents, SHARDS)
    crc = F.crc32(F.encode(F.coalesce(F.col("text"), F.lit("")), "utf-8"))
    rows = stored(documents.select("doc_id", size_of().alias("size"), crc.alias("text_crc32"), shard.alias("shard")), "shards")
    return numbered(rows).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
