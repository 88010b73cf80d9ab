"""Questions to stored run steps. All of it is specified behaviour.

``run_steps(run_id, step_index, kind, name, args, latency_ms, input_tokens,
output_tokens, cost_usd, error)``; ``kind`` is ``node`` or ``tool_call``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roostline import config
from roostline.functions.quantiles import exact_percentiles
from roostline.functions.running import running_totals

# The tools a run may use, and the one that counts as a search.
TOOLS = ("search_listings", "count_matches", "field_stats", "get_listing", "get_reviews")
SEARCH_TOOL = "search_listings"
END_REASONS = ("finished", "tool_limit", "search_limit", "cost", "timeout", "error")

def _tool() -> Column:
    return F.col("kind") == "tool_call"


def replay(steps: DataFrame, run_id) -> DataFrame:
    """The steps of one run in order."""
    return steps.where(F.col("run_id") == run_id).orderBy("step_index")


def last_runs(runs: DataFrame, steps: DataFrame, limit: int = 20) -> DataFrame:
    """The newest runs with their step count, latency and cost."""
    newest = runs.orderBy(F.desc("started_at"), F.desc("run_id")).limit(limit)
    # At most ``limit`` runs, so only their steps are summed.
    per_run = (
        steps.join(F.broadcast(newest.select("run_id")), "run_id", "left_semi")
        .groupBy("run_id")
        .agg(
            F.count("*").alias("steps"),
            F.sum("latency_ms").alias("latency_ms"),
            F.sum("cost_usd").alias("cost_usd"),
        )
    )
    return newest.join(per_run, "run_id", "left").orderBy(F.desc("started_at"), F.desc("run_id"))


def calls_per_run(steps: DataFrame, search_tool: str = SEARCH_TOOL) -> DataFrame:
    """``(run_id, tool_calls, searches)``."""
    return steps.groupBy("run_id").agg(
        F.count_if(_tool()).alias("tool_calls"),
        F.count_if(_tool() & (F.col("name") == search_tool)).alias("searches"),
    )


def call_distribution(steps: DataFrame, search_tool: str = SEARCH_TOOL) -> DataFrame:
    """How many runs made how many tool calls and searches."""
    return (
        calls_per_run(steps, search_tool)
        .groupBy("tool_calls", "searches")
        .agg(F.count("*").alias("runs"))
    )


def call_means(steps: DataFrame, search_tool: str = SEARCH_TOOL) -> DataFrame:
    return calls_per_run(steps, search_tool).agg(
        F.count("*").alias("runs"),
        F.avg("tool_calls").alias("mean_tool_calls"),
        F.avg("searches").alias("mean_searches"),
    )


def tool_usage(steps: DataFrame, tools: Sequence[str] = TOOLS) -> DataFrame:
    """Calls and share per tool, the unused ones included."""
    counts = (
        steps.where(_tool() & F.col("name").isin(*tools)).groupBy("name").agg(F.count("*").alias("calls"))
    )
    listed = steps.sparkSession.createDataFrame([(t,) for t in tools], "name string")
    whole = counts.agg(F.sum("calls").alias("all"))
    return (
        listed.join(counts, "name", "left")
        .withColumn("calls", F.coalesce("calls", F.lit(0)))
        .withColumn("share", F.col("calls") / F.nullif(whole.scalar(), F.lit(0)))
    )


def end_reasons(runs: DataFrame) -> DataFrame:
    """Runs per reason they ended for."""
    return runs.groupBy("end_reason").agg(F.count("*").alias("runs"))


def invalid_arguments(steps: DataFrame, invalid: Column | None = None) -> DataFrame:
    """Tool calls, those with refused arguments, and those still refused on the next try.

    A next try is the same run's next call of the same tool. It is found by the order of
    the calls within bounded chunks, so a long run is no single task.
    """
    bad = invalid if invalid is not None else F.col("error") == "invalid_arguments"
    calls = steps.where(_tool()).withColumn("_bad", F.coalesce(bad, F.lit(False)).cast("long"))
    # Number the calls per run and tool: call n + 1 is the correction of call n.
    keyed = calls.withColumn("_key", F.concat_ws("\x1f", F.col("run_id").cast("string"), "name"))
    numbered = running_totals(keyed, "_key", "step_index", {"_nth": F.lit(1)})
    first = numbered.select("_key", "_nth", "_bad")
    after = numbered.where("_bad = 1").select("_key", (F.col("_nth") + 1).alias("_nth"), F.lit(1).alias("_tried"))
    joined = first.join(after, ["_key", "_nth"], "left")
    return joined.agg(
        F.count("*").alias("calls"),
        F.sum("_bad").alias("invalid"),
        F.sum(F.coalesce("_tried", F.lit(0))).alias("corrections_tried"),
        F.sum(F.when(F.col("_tried") == 1, F.col("_bad")).otherwise(0)).alias("still_invalid"),
    )


def canonical_args(column: str = "args") -> Column:
    """JSON arguments with keys in one order, so equal arguments are equal text."""
    return F.coalesce(F.to_json(F.try_parse_json(column)), F.col(column))


def repeated_calls(steps: DataFrame, result: str = "output") -> DataFrame:
    """Tool calls a run already made with the same arguments, with the first call's result."""
    calls = steps.where(_tool()).withColumn("_args", F.coalesce(canonical_args(), F.lit("")))
    keys = ["run_id", "name", "_args"]
    # The first of each identical call, found with partial results per task.
    firsts = calls.groupBy(*keys).agg(
        F.min("step_index").alias("first_step"),
        F.min_by(result, "step_index").alias("first_result"),
        F.count("*").alias("_times"),
    )
    again = firsts.where("_times > 1").drop("_times")
    return (
        calls.join(again, keys)
        .where(F.col("step_index") > F.col("first_step"))
        .select("run_id", "step_index", "name", "first_step", "first_result")
    )


def repeat_rate(steps: DataFrame) -> DataFrame:
    """Tool calls, repeats among them, and their share."""
    calls = steps.where(_tool()).withColumn("_args", F.coalesce(canonical_args(), F.lit("")))
    kinds = calls.groupBy("run_id", "name", "_args").agg(F.count("*").alias("_times"))
    out = kinds.agg(F.sum("_times").alias("calls"), F.sum(F.col("_times") - 1).alias("repeats"))
    return out.withColumn("repeat_rate", F.col("repeats") / F.col("calls"))


def budget_breaches(
    steps: DataFrame,
    *,
    search_tool: str = SEARCH_TOOL,
    calls: int = config.MAX_TOOL_CALLS,
    searches: int = config.MAX_SEARCHES,
    seconds: float = config.QUERY_TIMEOUT_S,
    dollars: float = config.MAX_QUERY_COST_USD,
) -> DataFrame:
    """Per run, the first step that passes each limit; NULL where a limit holds."""
    if searches > calls:
        raise ValueError(f"a search budget of {searches} can never bind below {calls} tool calls")
    running = running_totals(
        steps,
        "run_id",
        "step_index",
        {
            "_calls": _tool().cast("long"),
            "_searches": (_tool() & (F.col("name") == search_tool)).cast("long"),
            "_ms": F.coalesce(F.col("latency_ms"), F.lit(0.0)),
            "_usd": F.coalesce(F.col("cost_usd"), F.lit(0.0)),
        },
    )
    limits = (
        ("tool_limit_step", F.col("_calls") > calls),
        ("search_limit_step", F.col("_searches") > searches),
        ("timeout_step", F.col("_ms") > seconds * 1000),
        ("cost_step", F.col("_usd") > dollars),
    )
    return running.groupBy("run_id").agg(
        *[F.min(F.when(passed, F.col("step_index"))).alias(name) for name, passed in limits]
    )


def step_profile(steps: DataFrame) -> DataFrame:
    """Latency percentiles, tokens and cost per step name, with the number of steps."""
    latency = exact_percentiles(steps, ["name"], "latency_ms", {"p50_ms": 0.5, "p95_ms": 0.95})
    sums = steps.groupBy("name").agg(
        F.count("*").alias("steps"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.sum("cost_usd").alias("cost_usd"),
    )
    return sums.join(latency, "name", "left")
