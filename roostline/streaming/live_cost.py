"""Cost per run while calls keep arriving. Specified behaviour."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from roostline.operators import cost


def start_live_totals(
    calls: DataFrame, rates: DataFrame, sink: str, checkpoint: str, *, until_done: bool = False
) -> StreamingQuery:
    """Keep run totals of a stream of calls below ``sink``.

    Each micro-batch writes the totals of the runs it touched into a folder named after
    the batch, replacing it on a retry, so a batch that runs twice counts once. State is
    four token sums, a count and a cost per run.
    """
    totals = cost.run_totals(cost.price(calls, rates))

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    writer = (
        totals.writeStream.outputMode("update")
        .foreachBatch(keep)
        .option("checkpointLocation", checkpoint)
    )
    return (writer.trigger(availableNow=True) if until_done else writer).start()


def latest_totals(spark: SparkSession, sink: str) -> DataFrame:
    """The newest totals of every run."""
    rows = spark.read.parquet(sink)
    columns = [c for c in rows.columns if c not in ("run_id", "batch")]
    newest = F.max_by(F.struct(*columns), "batch").alias("t")
    return rows.groupBy("run_id").agg(newest).select("run_id", "t.*")


def breaches(spark: SparkSession, sink: str, ceiling: float) -> DataFrame:
    """Runs whose cost so far has passed the ceiling."""
    return latest_totals(spark, sink).where(F.col("cost_usd") > ceiling)
