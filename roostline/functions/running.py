"""Running totals per key that do not need the whole key in one task."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roostline.session import stable


def running_totals(
    df: DataFrame,
    key: str,
    order: str,
    totals: Mapping[str, Column],
    parts: int | None = None,
) -> DataFrame:
    """``df`` with, per entry of ``totals``, the sum over all rows of the key up to this one.

    ``order`` is unique within its key. The rows are cut into ``parts`` ranges of (key,
    order) of about the same number of rows, however far apart the orders are and however
    long a key is. A key is summed within each range it reaches into, and shifted by its
    sums in the ranges before; a key has no more of those than there are ranges.
    """
    ranges = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = df.withColumns({f"_in_{n}": c for n, c in totals.items()})
    # Written down once: the sums and the shifts have to see the same ranges.
    cut = stable(cut.repartitionByRange(ranges, key, order).withColumn("_range", F.spark_partition_id()))
    sums = cut.groupBy(key, "_range").agg(*[F.sum(f"_in_{n}").alias(f"_s_{n}") for n in totals])
    earlier = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sums.select(
        F.col(key).alias("_key_"),
        F.col("_range").alias("_range_"),
        *[F.coalesce(F.sum(f"_s_{n}").over(earlier), F.lit(0)).alias(f"_b_{n}") for n in totals],
    )
    inside = (
        Window.partitionBy(key, "_range")
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    here = F.col(key).eqNullSafe(F.col("_key_")) & (F.col("_range") == F.col("_range_"))
    out = cut.join(shifts, here)
    # A range whose values are all missing adds nothing to what came before.
    out = out.withColumns(
        {n: F.col(f"_b_{n}") + F.coalesce(F.sum(f"_in_{n}").over(inside), F.lit(0)) for n in totals}
    )
    dropped = [f"{p}{n}" for n in totals for p in ("_in_", "_b_")]
    return out.drop("_range", "_range_", "_key_", *dropped)
