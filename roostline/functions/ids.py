"""Consecutive ids in a stated order, numbered by many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roostline.session import stable


def with_dense_ids(
    df: DataFrame, order_by: str, start: int = 0, name: str = "id", id_type: str = "int"
) -> DataFrame:
    """``df`` with ``name`` = ``start`` + 1, + 2, … in the order of ``order_by``.

    Rows are split into ranges, each range is numbered by its own task and shifted by
    the sizes of the ranges before it. The split is written down first, because it is
    read twice and must not move in between.
    """
    ranged = stable(df.repartitionByRange(order_by).withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range: bounded by the number of shuffle partitions.
    shifts = (
        ranged.groupBy("_range")
        .agg(F.count("*").alias("_rows"))
        .select("_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_shift"))
    )
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(order_by))
    numbered = ranged.withColumn("_place", inside).join(F.broadcast(shifts), "_range")
    new_id = (F.lit(start) + F.col("_shift") + F.col("_place")).cast(id_type)
    return numbered.withColumn(name, new_id).drop("_range", "_place", "_shift")
