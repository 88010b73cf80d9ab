"""The stateful watch over runs: totals, one breach each, expiry, merges and replays."""

import random

import pytest
from pyspark.sql import functions as F
from test_records import CALLS

from roostline.operators import cost
from roostline.session import subfolders
from roostline.standins import answers
from roostline.streaming import run_watch

BATCHES, RUNS = 7, 9


@pytest.fixture(scope="module")
def calls(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(RUNS), i, "parse", rng.choice(["claude-haiku-4-5", "claude-opus-5", None]), rng.randint(1, 900), rng.randint(1, 90), 0, 5, False) for i in range(210)]
    return spark.createDataFrame(rows, CALLS).checkpoint()


@pytest.fixture(scope="module")
def source(calls, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("calls") / "c")
    for b in range(BATCHES):  # later calls in later files
        calls.where((F.col("seq") / 30).cast("int") == b).coalesce(1).write.mode("append").parquet(path)
    return path


def watch(spark, source, root, **options):
    stream = spark.readStream.schema(CALLS).option("maxFilesPerTrigger", 1).parquet(source)
    query = run_watch.start(stream, cost.default_rates(spark), f"{root}/sink", f"{root}/state", until_done=True, **options)
    query.awaitTermination()
    return f"{root}/sink"


def shown(df, digits=9):
    return {r["run_id"]: tuple(round(v, digits) if isinstance(v, float) else v for v in r[1:]) for r in df.collect()}


def want(spark, calls):
    priced = cost.price(calls, cost.default_rates(spark))
    return priced.groupBy("run_id").agg(F.count("*").alias("calls"), *[F.sum(t).alias(t) for t in cost.TOKENS], F.sum("cost_usd").alias("cost_usd")), priced


def test_a_watch_totals_every_run_and_tells_of_a_breach_once(spark, calls, source, tmp_path):
    totals, priced = want(spark, calls)
    ceiling = totals.agg(F.avg("cost_usd")).first()[0] / 2
    sink = watch(spark, source, tmp_path, ceiling=ceiling, compact_every=3)
    # Batches 0 to 2 and 3 to 5 were merged, the last one stands alone.
    assert sorted(subfolders(spark, sink)) == ["batch=6", "finished=2", "finished=5", "merged=5"]
    assert shown(run_watch.totals(spark, sink)) == shown(totals)
    passed = cost.ceiling_breaches(priced, ceiling)
    assert shown(run_watch.breaches(spark, sink)) == shown(passed) and 0 < passed.count() <= RUNS
    assert run_watch.episodes(spark, sink).count() == totals.count()
    # A batch that runs again changes nothing, merged or not.
    again = spark.read.parquet(f"{sink}/batch=6").drop("as_of")
    again.withColumn("as_of", F.lit(6)).checkpoint().write.mode("overwrite").parquet(f"{sink}/batch=6")
    assert shown(run_watch.totals(spark, sink)) == shown(totals)


def test_finished_runs_leave_the_state(spark, calls, source, tmp_path):
    totals, _ = want(spark, calls)
    sink = watch(spark, source, tmp_path, ceiling=1e9, idle_seconds=0, compact_every=2)
    told = run_watch.episodes(spark, sink)
    assert told.where("finished").count() > RUNS  # runs were closed and opened anew
    assert shown(run_watch.totals(spark, sink)) == shown(totals) and run_watch.breaches(spark, sink).isEmpty()
    merged = [f for f in subfolders(spark, sink) if f.startswith("merged=")]
    assert len(merged) == 1 and spark.read.parquet(f"{sink}/{merged[0]}").count() <= RUNS


def test_batches_have_to_be_merged(spark, calls):
    with pytest.raises(ValueError, match="merged"):
        run_watch.start(calls, cost.default_rates(spark), "sink", "state", compact_every=0)


def test_registered_streams_read_a_folder_of_parts_like_one_file(spark, tmp_path):
    rows = [(run, turn, "user", "x" * (10 + run + turn)) for run in range(4) for turn in range(3)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    (tmp_path / "folder").mkdir()
    table.repartition(3).write.parquet(str(tmp_path / "folder" / "conversations.parquet"))
    (tmp_path / "file").mkdir()
    table.toPandas().to_parquet(tmp_path / "file" / "conversations.parquet", index=False)
    for sf in ("folder", "file"):
        want = sorted(answers.totals(spark, str(tmp_path / sf)).collect())
        assert want and sorted(answers.live(spark, str(tmp_path / sf)).collect()) == want
        got = answers.watched(spark, str(tmp_path / sf)).select(*answers.totals(spark, str(tmp_path / sf)).columns)
        assert sorted(got.collect()) == want
