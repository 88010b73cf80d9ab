"""Quality and cost of search methods, each figure with its sample size. Specified behaviour."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roostline import config
from roostline.functions.quantiles import exact_percentiles

_SECRET_WORDS = ("key", "secret", "token", "password")


def recall_at_k(found: DataFrame, exact: DataFrame, k: int = 10) -> DataFrame:
    """``(request_id, relevant, hits, recall)`` of ranked ``found`` against the exact top ``k``."""
    truth = exact.where(F.col("place") <= k).select("request_id", "id")
    got = found.where(F.col("place") <= k).select("request_id", "id", F.lit(1).alias("hit"))
    joined = truth.join(got, ["request_id", "id"], "left")
    out = joined.groupBy("request_id").agg(F.count("*").alias("relevant"), F.count("hit").alias("hits"))
    return out.withColumn("recall", F.col("hits") / F.col("relevant"))


def precision_at_k(found: DataFrame, labels: DataFrame, k: int = 5) -> DataFrame:
    """``(request_id, returned, precision)``; a result without a label counts as irrelevant."""
    top = found.where(F.col("place") <= k).select("request_id", "id")
    judged = top.join(labels.select("request_id", "id", "relevant"), ["request_id", "id"], "left")
    return judged.groupBy("request_id").agg(
        F.count("*").alias("returned"),
        F.avg(F.coalesce(F.col("relevant").cast("double"), F.lit(0.0))).alias("precision"),
    )


def mean_metric(per_request: DataFrame, metric: str) -> DataFrame:
    return per_request.agg(F.count(metric).alias("requests"), F.avg(metric).alias(f"mean_{metric}"))


def latency_profile(runs: DataFrame) -> DataFrame:
    """p50 and p95 per method, cold and warm runs apart."""
    keys = ["method", "phase"]
    sizes = runs.groupBy(*keys).agg(F.count("*").alias("runs"))
    return sizes.join(
        exact_percentiles(runs, keys, "latency_ms", {"p50_ms": 0.5, "p95_ms": 0.95}), keys
    )


def field_accuracy(parsed: DataFrame, expected: DataFrame, fields: Sequence[str]) -> DataFrame:
    """``(field, requests, accuracy)``, two missing values being equal.

    A request that was not parsed at all is wrong in every field.
    """
    seen = parsed.withColumn("_parsed", F.lit(True)).alias("p")
    joined = expected.alias("e").join(seen, "request_id", "left")
    pairs = F.array(
        *[
            F.struct(
                F.lit(f).alias("field"),
                (F.col("_parsed").isNotNull() & F.col(f"e.{f}").eqNullSafe(F.col(f"p.{f}"))).alias("same"),
            )
            for f in fields
        ]
    )
    return (
        joined.select(F.inline(pairs))
        .groupBy("field")
        .agg(F.count("*").alias("requests"), F.avg(F.col("same").cast("double")).alias("accuracy"))
    )


def first_attempt_failures(attempts: DataFrame) -> DataFrame:
    """Share of first attempts whose body was invalid, before any second attempt."""
    first = attempts.where(F.col("attempt") == 1)
    bad = F.col("outcome").isin("blank", "not_json", "not_object", "invalid")
    return first.agg(
        F.count("*").alias("requests"),
        F.count_if(bad).alias("invalid"),
        F.avg(bad.cast("double")).alias("invalid_rate"),
    )


def invented_values(attempts: DataFrame) -> DataFrame:
    """Valid attempts, those with unknown names, and the number of such names."""
    valid = attempts.where(F.col("outcome") == "valid")
    return valid.agg(
        F.count("*").alias("attempts"),
        F.count_if(F.size("ungrounded") > 0).alias("with_invented"),
        F.sum(F.size("ungrounded")).alias("invented_names"),
        F.avg((F.size("ungrounded") > 0).cast("double")).alias("invented_rate"),
    )


def mode_comparison(
    queries: DataFrame, threshold: int = config.THIN_RESULT_THRESHOLD
) -> DataFrame:
    """One row per mode from ``(mode, results, precision, latency_ms, tokens, cost_usd)``."""
    sums = queries.groupBy("mode").agg(
        F.count("*").alias("queries"),
        F.avg((F.col("results") >= threshold).cast("double")).alias("enough_share"),
        F.avg("precision").alias("mean_precision"),
        F.avg("tokens").alias("tokens_per_query"),
        F.avg("cost_usd").alias("usd_per_query"),
    )
    return sums.join(
        exact_percentiles(queries, ["mode"], "latency_ms", {"p50_ms": 0.5, "p95_ms": 0.95}), "mode"
    )


def run_manifest(
    spark: SparkSession, settings: Mapping[str, object], snapshot: DataFrame
) -> DataFrame:
    """What a report was measured on: one row, without anything that looks like a secret."""
    shown = {
        k: str(v)
        for k, v in sorted(settings.items())
        if not any(word in k.lower().split("_") for word in _SECRET_WORDS)
    }
    pairs = [F.lit(x) for item in shown.items() for x in item]
    as_map = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return snapshot.select(
        "snapshot_date",
        "city",
        "listing_count",
        "review_count",
        F.lit(spark.version).alias("spark_version"),
        as_map.alias("settings"),
    )


def regressions(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Rows on either side that the other lacks; empty when nothing changed."""
    columns = expected.columns
    gone = expected.exceptAll(actual.select(*columns)).withColumn("side", F.lit("missing"))
    new = actual.select(*columns).exceptAll(expected).withColumn("side", F.lit("unexpected"))
    return gone.unionByName(new)
