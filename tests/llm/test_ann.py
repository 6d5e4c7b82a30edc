"""Nearest neighbours against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from dosebin.llm import ann, queries


def brute(ids, x, k):
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        s = (x * x[i]).sum(1)
        other = np.flatnonzero(ids != ids[i])
        out[int(ids[i])] = ids[other[np.lexsort((ids[other], -s[other]))][:k]].tolist()
    return out


def found(rows):
    got = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append(r.vec_id)
        assert r["rank"] == len(got[r.query_id])
    return got


def test_op7_recall(spark):
    folder = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got, want = queries.op7_neighbours(spark, folder).collect(), brute(ids, x, 20)
    near = found(got)
    assert set(near) == set(want) and all(len(v) == 20 for v in near.values())
    assert np.mean([len(set(near[q]) & set(want[q])) / 20 for q in want]) >= 0.9
    at = {v: i for i, v in enumerate(ids.tolist())}
    assert all(abs(r.score - x[at[r.query_id]] @ x[at[r.vec_id]]) < 1e-12 for r in got)


def clustered(n, seed=1):
    r = np.random.default_rng(seed)
    return r.normal(size=(40, 16))[r.integers(0, 40, n)] * 3 + r.normal(size=(n, 16))


def asked(index):
    return index.rows.where(F.col("vec_id") % 20 == 0).dropDuplicates(["vec_id"]).select("vec_id", "vec")


def test_visits_are_fewer_where_there_are_clusters(spark, monkeypatch):
    monkeypatch.setattr(ann, "LEAF_SAMPLE", 50)
    monkeypatch.setattr(ann, "BLOCK_ROWS", 40)  # leaves of several blocks
    x = clustered(3000)
    monkeypatch.setattr(ann, "grow", lambda s, f=ann.grow: f(s, leaf_rows=50))
    index = ann.build(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"))
    visits = ann.calibrate(index, asked(index), 10, 0.95)
    assert len(index.leaf_rows) > 30 and visits < len(index.leaf_rows) / 2
    got, want = found(ann.search(index, asked(index), 10).collect()), brute(np.arange(3000), x, 10)
    assert np.mean([len(set(got[q]) & set(want[q])) / 10 for q in want]) >= 0.9
    assert found(ann.search(index, asked(index), 10, visits=10_000).collect()) == want


def test_large_leaves_are_divided_and_hot_leaves_parted(spark, monkeypatch):
    """Leaves grow with the table; queries of a leaf meet its blocks in parts."""
    monkeypatch.setattr(ann, "LEAF_ROWS", 150)
    monkeypatch.setattr(ann, "BLOCK_ROWS", 60)
    monkeypatch.setattr(ann, "PART_QUERIES", 7)
    monkeypatch.setattr(ann, "grow", lambda s, f=ann.grow: f(s, leaf_rows=60))
    x = clustered(3000)
    x[:700] = x[0]  # a leaf that cannot be divided
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    index = ann.build(df, sample_rows=200)
    sizes = index.rows.groupBy("leaf").count().collect()
    assert {r["leaf"]: r["count"] for r in sizes} == index.leaf_rows and sum(index.leaf_rows.values()) == 3000
    assert sorted(index.leaf_rows.values())[-2] <= 150 and len(index.leaf_rows) > 20
    leaves = index.tree.leaf[index.tree.leaf >= 0]
    assert len(set(leaves.tolist())) == len(leaves) and all(not kids for kids, n in zip(index.tree.children, index.tree.leaf) if n >= 0)
    placed = {r.vec_id: r.leaf for r in index.rows.collect()}
    assert [placed[i] for i in range(3000)] == ann.leaf_of(index.tree, x).tolist()
    assert found(ann.search(index, asked(index), 10, visits=10_000).collect()) == brute(np.arange(3000), x, 10)
    got, want = found(ann.search(index, asked(index), 10).collect()), brute(np.arange(3000), x, 10)
    assert np.mean([len(set(got[q]) & set(want[q])) / 10 for q in want]) >= 0.9


def test_ties_hot_vectors_and_unusable_rows(spark):
    same, other = [0.1, 0.2, 0.3, 0.4], clustered(200)[:, :4].tolist()
    rows = [(i, same) for i in range(300)] + [(1000 + i, v) for i, v in enumerate(other)]
    bad = [(2000, None), (2020, [0.0] * 4), (2040, [1.0, None, 1.0, 1.0]), (2060, [float("nan")] * 4), (2080, [float("inf"), 0.0, 0.0, 0.0]), (2100, [1.0]), (None, same), (2120, [])]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows + bad], "vec_id long, embedding array<double>, vec string, leaf int").repartition(4)
    index = ann.build(df)
    assert index.rows.count() == len(rows)
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    got = found(ann.search(index, asked(index), 20, visits=10_000).collect())
    assert got == brute(ids, x, 20)
    assert got[0] == list(range(1, 21)) or got[0][0] >= 1000
    near = found(ann.search(index, asked(index), 20).collect())
    assert all(len(v) == 20 for v in near.values())


@pytest.mark.parametrize("n", [0, 1, 5])
def test_few_rows(spark, n):
    df = spark.createDataFrame([(i, [1.0 + i, 2.0]) for i in range(n)], "vec_id long, embedding array<float>")
    index = ann.build(df)
    got = found(ann.search(index, asked(index), 20).collect())
    assert got == ({0: [4, 3, 2, 1]} if n == 5 else {})


def test_best_bins_visits_every_leaf_once():
    tree = ann.grow(clustered(2000), leaf_rows=60)
    n = int(tree.leaf.max()) + 1
    order = ann.best_bins(tree, np.ones(16), lambda f: False)
    assert sorted(order) == list(range(n)) and set(ann.leaf_of(tree, clustered(500, 2)).tolist()) <= set(range(n))
    assert ann.best_bins(tree, np.ones(16), lambda f: len(f) >= 3) == order[:3]
