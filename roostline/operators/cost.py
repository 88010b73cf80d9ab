"""What recorded model calls cost.

``calls(run_id, seq, label, model, input_tokens, output_tokens, cache_read_tokens,
cache_write_tokens, is_batch)``; a failed call that was billed is a call like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roostline import config
from roostline.errors import UnknownModelError
from roostline.functions.running import running_totals

TOKENS = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens")
RATES = (
    "model string, input_per_mtok double, output_per_mtok double, "
    "cache_read_multiplier double, cache_write_multiplier double"
)


def default_rates(spark: SparkSession) -> DataFrame:
    rows = [
        (model, given, taken, config.CACHE_READ_MULTIPLIER, config.CACHE_WRITE_MULTIPLIER)
        for model, given, taken in config.MODEL_RATES
    ]
    return spark.createDataFrame(rows, RATES)


def override_rates(base: DataFrame, override: DataFrame) -> DataFrame:
    """Specified behaviour: rates from a file replace the built-in ones, model by model."""
    columns = [c for c in base.columns if c != "model"]
    joined = base.alias("b").join(override.alias("o"), "model", "full_outer")
    return joined.select("model", *[F.coalesce(F.col(f"o.{c}"), F.col(f"b.{c}")).alias(c) for c in columns])


def billed(calls: DataFrame) -> DataFrame:
    """Calls that cost something: whoever failed after using tokens is billed, others are not."""
    return calls.where(F.col("model").isNotNull() & F.col("input_tokens").isNotNull())


def cost_of_call() -> Column:
    """Dollars of one call joined to its rate."""
    c = F.col
    per_million = (
        c("input_tokens") * c("input_per_mtok")
        + c("output_tokens") * c("output_per_mtok")
        + c("cache_read_tokens") * c("input_per_mtok") * c("cache_read_multiplier")
        + c("cache_write_tokens") * c("input_per_mtok") * c("cache_write_multiplier")
    )
    share = F.when(c("is_batch"), F.lit(config.BATCH_DISCOUNT)).otherwise(F.lit(1.0))
    return per_million / F.lit(1e6) * share


def price(calls: DataFrame, rates: DataFrame) -> DataFrame:
    """Billed calls with ``cost_usd``. A model without a rate stops the job, in a batch and in
    a stream, so that no total leaves a call out.
    """
    out = billed(calls).join(rates.withColumn("_rated", F.lit(True)), "model", "left")
    stop = F.raise_error(F.concat(F.lit("no rate for "), F.col("model"))).cast("double")
    added = [c for c in rates.columns if c != "model"]
    return out.withColumn("cost_usd", F.when(F.col("_rated").isNull(), stop).otherwise(cost_of_call())).drop("_rated", *added)


def unknown_models(calls: DataFrame, rates: DataFrame) -> DataFrame:
    """``(model, calls)`` of billed calls no rate covers."""
    per_model = billed(calls).groupBy("model").agg(F.count("*").alias("calls"))
    return per_model.join(rates.select("model"), "model", "left_anti")


def require_known_models(calls: DataFrame, rates: DataFrame) -> None:
    missing = unknown_models(calls, rates)
    if count := missing.count():
        named = ", ".join(row["model"] for row in missing.orderBy("model").limit(20).collect())
        raise UnknownModelError(f"no rate for {count} models, such as {named}")


def _totals() -> list[Column]:
    return [F.sum(c).alias(c) for c in TOKENS]


def run_totals(priced: DataFrame) -> DataFrame:
    """Calls, tokens and dollars per run."""
    return priced.groupBy("run_id").agg(
        F.count("*").alias("calls"), *_totals(), F.sum("cost_usd").alias("cost_usd")
    )


def cost_by_label(priced: DataFrame) -> DataFrame:
    return priced.groupBy("run_id", "label").agg(F.sum("cost_usd").alias("cost_usd"))


def usage_by_model(priced: DataFrame) -> DataFrame:
    return priced.groupBy("run_id", "model").agg(*_totals())


def ceiling_breaches(priced: DataFrame, ceiling: float = config.MAX_QUERY_COST_USD) -> DataFrame:
    """Specified behaviour: per run, the first call that takes its cost past the ceiling."""
    running = running_totals(priced, "run_id", "seq", {"spent": F.col("cost_usd")})
    return (
        running.where(F.col("spent") > ceiling)
        .groupBy("run_id")
        .agg(F.min("seq").alias("seq"), F.min_by("spent", "seq").alias("spent"))
    )


def projected_spend(
    priced: DataFrame, planned: DataFrame, ceiling: float = config.MAX_RUN_COST_USD
) -> DataFrame:
    """Specified behaviour: planned calls per label at their mean past cost, against a ceiling.

    ``planned(label, planned_calls)``. A label without history makes the estimate NULL.
    """
    mean = priced.groupBy("label").agg(F.avg("cost_usd").alias("mean_cost"))
    lines = planned.join(mean, "label", "left")
    known = F.count("*") == F.count("mean_cost")
    total = F.sum(F.col("planned_calls") * F.col("mean_cost"))
    out = lines.agg(F.when(known, total).alias("projected_usd"))
    return out.withColumn("ceiling_usd", F.lit(ceiling)).withColumn(
        "allowed", F.coalesce(F.col("projected_usd") <= ceiling, F.lit(False))
    )
