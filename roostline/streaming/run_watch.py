"""Totals and ceiling breaches per run while calls arrive, with state that ends with the run.

One keyed state per run: its sums so far and the first call that took its cost past the
ceiling. A timer that every call puts off closes a run without calls for ``idle`` seconds:
its last row is marked finished and its state goes. A call that comes later still opens
the run anew, as another episode, and the totals of a run are those of its episodes; the
ceiling holds for an episode. Specified behaviour.

The sink is a folder per micro-batch, and every ``COMPACT_EVERY`` batches they become one:
open episodes in ``merged``, finished ones written once to ``finished``. A batch that runs
again writes the same folders again, so nothing is counted or reported twice. Calls of a
run count once, in whatever order batches bring them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from roostline import config
from roostline.operators import cost
from roostline.session import exists, subfolders, without_folder

IDLE_SECONDS = 900
COMPACT_EVERY = 20
SUMS = ("calls", *cost.TOKENS, "cost_usd")
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_EMPTY_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"
_STATE = (
    "episode long, calls long, " + ", ".join(f"{t} long" for t in cost.TOKENS) + ", cost_usd double, breach_seq long, breach_spent double"
)


class _Watch(StatefulProcessor):
    def __init__(self, ceiling: float, idle_ms: int) -> None:
        self.ceiling, self.idle_ms = ceiling, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("run", _STATE)

    def _row(self, key: tuple, state: tuple, finished: bool) -> pd.DataFrame:
        names = ["run_id", "episode", *SUMS, "breach_seq", "breach_spent", "finished"]
        # A missing breach stays a missing whole number.
        kinds = {"breach_seq": "Int64"}
        return pd.DataFrame([(*key, *state, finished)], columns=names).astype(kinds)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        came = pd.concat(list(rows)).sort_values("seq", kind="stable")
        if self.state.exists():
            episode, calls, *tokens, spent, seq, at = self.state.get()
        else:
            episode, calls, tokens, spent, seq, at = int(came["seq"].iloc[0]), 0, [0] * len(cost.TOKENS), 0.0, None, None
        running = spent + came["cost_usd"].fillna(0.0).cumsum()
        if seq is None and (over := running > self.ceiling).any():
            first = int(over.to_numpy().argmax())
            seq, at = int(came["seq"].iloc[first]), float(running.iloc[first])
        tokens = [t + int(came[c].fillna(0).sum()) for t, c in zip(tokens, cost.TOKENS)]
        state = (episode, calls + len(came), *tokens, float(running.iloc[-1]), seq, at)
        self.state.update(state)
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield self._row(key, state, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            state = self.state.get()
            self.state.clear()
            yield self._row(key, tuple(state), True)

    def close(self) -> None:
        pass


def watched(calls: DataFrame, rates: DataFrame, ceiling: float, idle_seconds: float) -> DataFrame:
    """A row per run and micro-batch that touches it, and one as it is closed."""
    priced = cost.price(calls, rates).select("run_id", F.col("seq").cast("long").alias("seq"), *cost.TOKENS, "cost_usd")
    kind = calls.schema["run_id"].dataType.simpleString()
    out = f"run_id {kind}, {_STATE}, finished boolean"
    processor = _Watch(ceiling, int(idle_seconds * 1000))
    return priced.groupBy("run_id").transformWithStateInPandas(processor, out, "Update", "ProcessingTime")


def start(
    calls: DataFrame,
    rates: DataFrame,
    sink: str,
    checkpoint: str,
    *,
    ceiling: float = config.MAX_QUERY_COST_USD,
    idle_seconds: float = IDLE_SECONDS,
    compact_every: int = COMPACT_EVERY,
    until_done: bool = False,
) -> StreamingQuery:
    """Watch a stream of calls; what it tells goes below ``sink``."""
    if compact_every < 1:
        raise ValueError(f"batches must be merged every one at least, got {compact_every}")
    spark = calls.sparkSession

    def keep(batch: DataFrame, batch_id: int) -> None:
        if exists(spark, f"{sink}/merged={batch_id}/_SUCCESS"):
            return  # the batch is part of what was merged
        batch.withColumn("as_of", F.lit(batch_id)).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")
        if (batch_id + 1) % compact_every == 0:
            _merge(spark, sink, batch_id)

    rows = watched(calls, rates, ceiling, idle_seconds)
    writer = rows.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint)
    # Keyed timers need this store; a query keeps the settings it was started with. Without
    # new calls timers fire in batches of their own, so one that is to end makes no such batch.
    wanted = {_PROVIDER: _ROCKS} | ({_EMPTY_BATCHES: "false"} if until_done else {})
    before = {name: spark.conf.get(name) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        return (writer.trigger(availableNow=True) if until_done else writer).start()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def _numbered(spark: SparkSession, sink: str, name: str) -> list[int]:
    """The batches of complete folders ``name=<batch>``."""
    found = [f for f in subfolders(spark, sink) if f.startswith(f"{name}=")]
    return sorted(int(f.split("=")[1]) for f in found if exists(spark, f"{sink}/{f}/_SUCCESS"))


def _last(rows: DataFrame) -> DataFrame:
    """The last row of every episode; a closing row comes after the others of its batch."""
    columns = [c for c in rows.columns if c not in ("run_id", "episode")]
    newest = F.max_by(F.struct(*columns), F.struct("as_of", "finished")).alias("t")
    return rows.groupBy("run_id", "episode").agg(newest).select("run_id", "episode", "t.*")


def _open_folders(spark: SparkSession, sink: str) -> tuple[int, list[str]]:
    merged = _numbered(spark, sink, "merged")
    since = merged[-1] if merged else -1
    folders = [f"{sink}/merged={since}"] if merged else []
    return since, folders + [f"{sink}/batch={b}" for b in _numbered(spark, sink, "batch") if b > since]


def _merge(spark: SparkSession, sink: str, batch_id: int) -> None:
    """One folder of open episodes and one of those that finished since the last merge."""
    _, folders = _open_folders(spark, sink)
    rows = _last(spark.read.parquet(*folders)).persist()
    try:
        rows.where("finished").write.mode("overwrite").parquet(f"{sink}/finished={batch_id}")
        # This folder makes the merge count; readers take no finished folder beyond it.
        rows.where("NOT finished").write.mode("overwrite").parquet(f"{sink}/merged={batch_id}")
    finally:
        rows.unpersist()
    for folder in folders:
        without_folder(spark, folder)
    for left in _numbered(spark, sink, "merged"):
        if left < batch_id:
            without_folder(spark, f"{sink}/merged={left}")


def episodes(spark: SparkSession, sink: str) -> DataFrame:
    """The last row of every episode of every run."""
    since, folders = _open_folders(spark, sink)
    folders += [f"{sink}/finished={b}" for b in _numbered(spark, sink, "finished") if b <= since]
    return _last(spark.read.parquet(*folders))


def totals(spark: SparkSession, sink: str) -> DataFrame:
    """``(run_id, calls, tokens, cost_usd)`` of every run so far."""
    return episodes(spark, sink).groupBy("run_id").agg(*[F.sum(c).alias(c) for c in SUMS])


def breaches(spark: SparkSession, sink: str) -> DataFrame:
    """``(run_id, seq, spent)``: once per run, the first call that passed the ceiling."""
    passed = episodes(spark, sink).where(F.col("breach_seq").isNotNull())
    return passed.groupBy("run_id").agg(F.min("breach_seq").alias("seq"), F.min_by("breach_spent", "breach_seq").alias("spent"))
