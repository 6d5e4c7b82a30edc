"""The pipeline stage by stage: what goes, what stays, what is planted."""

from collections import defaultdict

import corpus_pipeline
from conftest import prose
from pyspark.sql import functions as F

from dosebin.llm import decontam, files, simhash
from test_pii import plain

FOLDER = "/root/testdata/sf0.01"


def test_stage_by_stage(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, folder, by = docs.columns, files.new_folder(spark, "test"), {}
    leak = spark.read.parquet(f"{FOLDER}/benchmark.parquet").where("length(text) > 150").first()["text"]
    more = [
        (900_001, prose(50, 120) + "\n" + leak + "\n" + prose(51, 120), "en", "planted", 0),
        (900_002, prose(52, 150), "en", "planted", 0),
        (900_003, prose(52, 150), "en", "planted", 0),
        (900_004, prose(53, 90) + " write to jo.doe@mail.example.com now", "en", "planted", 0),
        (900_005, prose(54, 90), "en", "planted", 0),
    ]
    docs = docs.union(spark.createDataFrame(more, docs.schema))
    docs = files.written(docs, folder, "input")
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, files.written(stage(spark, docs, FOLDER), folder, name)
        by[name] = docs
        if name != "packing":
            assert docs.columns == columns
            assert docs.join(before, "doc_id", "left_anti").count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "personal_data", "packing"]

    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    kept = by["quality"].join(labels, "doc_id").groupBy("quality").count().collect()
    kept = {r["quality"]: r["count"] for r in kept}
    assert kept[1] >= 0.98 * labels.where("quality = 1").count() and kept.get(0, 0) <= 0.1 * labels.where("quality = 0").count()

    fps = simhash.with_components(by["quality"]).groupBy("component_id").agg(F.min("doc_id").alias("doc_id"))
    assert sorted(r.doc_id for r in fps.collect()) == sorted(r.doc_id for r in by["near_duplicates"].select("doc_id").collect())
    texts = {r.doc_id: r.text for r in by["near_duplicates"].collect()}
    assert 900_002 in texts and 900_003 not in texts and {900_001, 900_004, 900_005} <= set(texts)

    items = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    assert decontam.find(by["decontamination"], items).where("size(runs) > 0").count() == 0
    clean = {r.doc_id for r in decontam.find(by["near_duplicates"], items).where("size(runs) = 0").collect()}
    cut = {r.doc_id: r for r in by["decontamination"].collect()}
    assert all(cut[i].text == texts[i] for i in clean) and 900_001 in cut and leak not in cut[900_001].text
    assert all(r.n_chars == len(r.text) for r in cut.values())

    masked = {r.doc_id: r.text for r in by["personal_data"].collect()}
    assert set(masked) == set(cut) and all(plain(t) == [] for t in masked.values())
    assert "[EMAIL]" in masked[900_004] and masked[900_005] == more[4][1]

    rows = by["packing"].collect()
    assert {r.doc_id for r in rows} == set(masked)
    places = defaultdict(int)
    for r in rows:
        places[r.sequence_id] += r.length
    assert max(places.values()) <= 4096 and len(places) <= -(-sum(places.values()) // 4096) + 1


def test_empty_and_odd_input(spark, odd, none):
    five = ["doc_id", "text", "lang", "source", "n_chars"]
    for docs in (none.select(five), odd.select(five)):
        folder = files.new_folder(spark, "test")
        docs = files.written(docs, folder, "input")
        for name, stage in corpus_pipeline.STAGES:
            docs = files.written(stage(spark, docs, FOLDER), folder, name)
    assert {None, 1, 4, 6, 7, 8, 9} >= {r.doc_id for r in docs.select("doc_id").collect()}
