"""Exact percentiles without bringing a group into one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _slot(value: Column) -> Column:
    """A coarse code that orders like the value: sign, power of two, and 64 steps within it.

    Infinite values and NaN have codes of their own, beyond all others.
    """
    size = F.when(F.isnan(value) | (F.abs(value) == float("inf")), F.lit(1.0)).otherwise(F.abs(value))
    power = F.floor(F.log2(size))
    fraction = F.floor((size / F.pow(F.lit(2.0), power) - 1) * 64)
    code = ((power + 1100) * 65 + F.greatest(fraction, F.lit(0))).cast("int")
    beyond = F.when(F.isnan(value), F.lit(1 << 30)).when(value == float("inf"), F.lit(1 << 29)).when(value == float("-inf"), F.lit(-(1 << 29)))
    return F.coalesce(beyond, F.when(value == 0, F.lit(0)).when(value > 0, code).otherwise(-code))


def exact_percentiles(
    df: DataFrame, groups: Sequence[str], value: str, probabilities: Mapping[str, float]
) -> DataFrame:
    """One row per group with the linearly interpolated percentiles of ``value``.

    Equal values are counted before anything moves. Counts per coarse slot say which
    slot a rank falls into, and only the values of those slots are ordered, slot by
    slot, so a group of any size is handled by many tasks.
    """
    keys = list(groups)
    column = F.col(value).cast("double")
    counted = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, column.alias("_value"))
        .agg(F.count("*").alias("_n"))
        .withColumn("_slot", _slot(F.col("_value")))
    )
    # At most some ten thousand slots per group, whatever its size.
    slots = counted.groupBy(*keys, "_slot").agg(F.sum("_n").alias("_n"))
    running = Window.partitionBy(*keys).orderBy("_slot")
    slots = slots.select(
        *keys,
        "_slot",
        F.sum("_n").over(running).alias("_upto"),
        (F.sum("_n").over(running) - F.col("_n")).alias("_before"),
        F.sum("_n").over(Window.partitionBy(*keys)).alias("_total"),
    )
    # Ranks around each percentile position, counted from zero.
    wanted = F.array(
        *[
            F.struct(
                F.lit(name).alias("_p"),
                F.floor(F.lit(p) * (F.col("_total") - 1)).alias("_low"),
                F.ceil(F.lit(p) * (F.col("_total") - 1)).alias("_high"),
                (F.lit(p) * (F.col("_total") - 1)).alias("_at"),
            )
            for name, p in probabilities.items()
        ]
    )
    hits = F.filter(
        wanted,
        lambda w: ((w["_low"] >= F.col("_before")) & (w["_low"] < F.col("_upto")))
        | ((w["_high"] >= F.col("_before")) & (w["_high"] < F.col("_upto"))),
    )
    slots = slots.withColumn("_hits", hits).where(F.size("_hits") > 0)
    inside = Window.partitionBy(*keys, "_slot").orderBy("_value")
    ordered = (
        counted.join(slots, [*keys, "_slot"])
        .withColumn("_upto", F.col("_before") + F.sum("_n").over(inside))
        .withColumn("_before", F.col("_upto") - F.col("_n"))
        .select(*keys, "_value", "_before", "_upto", F.inline("_hits"))
    )
    holds = lambda rank: (F.col(rank) >= F.col("_before")) & (F.col(rank) < F.col("_upto"))
    ends = ordered.groupBy(*keys, "_p").agg(
        F.max(F.when(holds("_low"), F.col("_value"))).alias("_a"),
        F.max(F.when(holds("_high"), F.col("_value"))).alias("_b"),
        F.max(F.col("_at") - F.col("_low")).alias("_share"),
    )
    between = F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_share")
    point = F.when((F.col("_a") == F.col("_b")) | (F.col("_share") == 0), F.col("_a")).otherwise(between)
    return ends.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_p") == name, point)).alias(name) for name in probabilities]
    )
