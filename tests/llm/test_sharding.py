"""Sharding: whole, equal in bytes, gapless, equal texts together."""

import zlib
from collections import defaultdict

from conftest import SCHEMA, prose, row
from pyspark.sql import functions as F

from dosebin.llm import queries, sharding


def check(rows, shards, total, largest, tolerance=0.001):
    size, slots = defaultdict(int), defaultdict(list)
    for r in rows:
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert set(size) <= set(range(shards))
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    slack = 2 * (tolerance * total / shards + largest) + 1
    assert all(abs(size.get(s, 0) - total / shards) <= slack for s in range(shards))


def test_op5(spark, folder, table):
    docs = {d["doc_id"]: (d["text"] or "").encode() for d in table("documents")}
    rows = queries.op5_sharding(spark, folder).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    assert all((r.size, r.text_crc32) == (len(docs[r.doc_id]) + 8, zlib.crc32(docs[r.doc_id])) for r in rows)
    check(rows, 24, sum(r.size for r in rows), max(r.size for r in rows))
    assert {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}


def test_a_hot_text_is_divided_and_others_stay_together(spark):
    rows = [row(i, "the same text") for i in range(3000)] + [row(5000 + i, prose(i // 3, 5 + i % 7)) for i in range(600)]
    placed = sharding.shard(spark.createDataFrame(rows, SCHEMA).repartition(5), 8, part_bytes=4000)
    got = placed.collect()
    assert len(got) == len(rows)
    check(got, 8, sum(r.size for r in got), max(r.size for r in got))
    spread = placed.groupBy("text").agg(F.countDistinct("shard").alias("n")).where("n > 1").count()
    assert spread <= 7


def test_repeated_rows_alone_are_divided(spark):
    got = sharding.shard(spark.createDataFrame([row(1, "again")] * 800, SCHEMA).repartition(4), 4).collect()
    check(got, 4, sum(r.size for r in got), got[0].size)


def test_odd_rows(spark, odd, odd_rows, none):
    placed = sharding.shard(odd, 3)
    assert placed.columns == [c for c in odd.columns if c != "size"] + ["size", "shard", "slot"]
    rows = placed.collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in rows) == sorted((str(r[0]), str(r[1])) for r in odd_rows)
    assert {r.doc_id: r.size for r in rows}[1] == 8
    check(rows, 3, sum(r.size for r in rows), max(r.size for r in rows))
    assert sharding.shard(none, 3).count() == 0


def test_no_python_on_the_main_path(spark, odd):
    plan = sharding.shard(odd, 3)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
