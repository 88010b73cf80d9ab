"""The pipeline on an awkward table: stages keep what they should, in the columns of documents."""

import pytest
from small import documents, labels, prose, rows, words

import corpus_pipeline


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    bad = [(500 + i, prose(i + 40, 50) + " moron scum idiot", "en", "s1", 10, 1, 0.1, 1, "x", "y") for i in range(40)]
    clean = [(700 + i, prose(i + 900, 50), "en", f"s{i % 4}", 10, 1, 0.1, 1, "x", "y") for i in range(200)]
    leak = [(950, prose(5000, 30) + " " + prose(9, 30), "en", "s1", 10, 1, 0.1, 1, "x", "y")]
    documents(spark, rows() + bad + clean + leak).repartition(3).write.parquet(f"{path}/documents.parquet")
    marks = labels() + [(r[0], 1, 1) for r in bad] + [(r[0], 1, 0) for r in clean]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, prose(9, 30)), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_every_stage_does_its_work(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        seen[name] = (docs.columns, docs.collect())
        docs = spark.createDataFrame(seen[name][1], docs.schema)
    columns = [c for c, _ in seen.values()]
    assert all(c == columns[0] for c in columns[:4]) and set(columns[4]) == set(columns[0])
    ids = {name: [r.doc_id for r in found] for name, (_, found) in seen.items()}
    assert not set(range(500, 540)) & set(ids["toxicity"]) and set(range(700, 900)) <= set(ids["toxicity"])
    assert 5 not in ids["near_duplicates"] and ids["near_duplicates"].count(6) == 1 and set(range(700, 900)) <= set(ids["near_duplicates"])
    cut = {r.doc_id: r.text for r in seen["decontamination"][1]}
    assert words(cut[950]) == words(prose(5000, 30)) and len(ids["decontamination"]) == len(ids["near_duplicates"])
    assert set(ids["mixing"]) <= set(ids["decontamination"]) and len(ids["sharding"]) == len(ids["mixing"])
    assert {r.shard for r in seen["sharding"][1]} <= set(range(40))


def test_run_applies_all_stages(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.count() > 100 and len(corpus_pipeline.STAGES) == 5
