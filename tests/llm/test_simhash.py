"""Fingerprints bit by bit, components against all pairs."""

import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from dosebin.llm import components, files, queries, simhash


def brute_fingerprint(text):
    lower = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_roots(values):
    values, root = np.unique(np.array(values, "<u8")), {}
    for s in range(len(values)):
        if s in root:
            continue
        root[s], todo = s, [s]
        while todo:
            at = todo.pop()
            for j in np.flatnonzero(np.bitwise_count(values ^ values[at]) <= 3).tolist():
                if j not in root:
                    root[j] = s
                    todo.append(j)
    return {int(values[i]): r for i, r in root.items()}


def test_op4_against_all_pairs(spark, folder, table):
    docs = table("documents")
    got = {r.doc_id: r for r in queries.op4_simhash(spark, folder).collect()}
    fps = {d["doc_id"]: brute_fingerprint(d["text"]) for d in docs}
    assert {i: f"{v:016x}" for i, v in fps.items()} == {i: r.fingerprint for i, r in got.items()}
    roots = brute_roots(list(fps.values()))
    least = {}
    for i, v in fps.items():
        least[roots[v]] = min(i, least.get(roots[v], i))
    assert {i: least[roots[v]] for i, v in fps.items()} == {i: r.component_id for i, r in got.items()}


def test_slices_do_not_change_fingerprints(monkeypatch, odd_rows):
    want = [brute_fingerprint(r[1]) for r in odd_rows[:7]]
    assert [simhash.fingerprint(r[1]) for r in odd_rows[:7]] == want
    monkeypatch.setattr(simhash, "slices", lambda d, f=simhash.slices: f(d, 50))
    assert [simhash.fingerprint(r[1]) for r in odd_rows[:7]] == want


@pytest.mark.parametrize("large", [2048, 4])
def test_links_join_clusters_whole(spark, monkeypatch, large):
    """Random centres with chains and clouds of close values; small keys and keys divided again."""
    monkeypatch.setattr(simhash, "LARGE_KEY", large)
    r = np.random.default_rng(5)
    values = set(r.integers(0, 1 << 63, 300, dtype=np.uint64).tolist())
    for c in r.integers(0, 1 << 63, 12, dtype=np.uint64).tolist():
        for _ in range(60):
            v = c
            for b in r.integers(0, 64, r.integers(0, 4)).tolist():
                v ^= 1 << b
            values.add(v)
            c = v if r.random() < 0.1 else c
    values = sorted(values)
    rows = [(simhash._signed(v),) for v in values]
    folder = files.new_folder(spark, "test")
    edges = simhash.links(spark.createDataFrame(rows, "fp long"), folder)
    assert edges.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) > 64).count() == 0
    root = {x.v: x.root for x in components.connected(edges, folder).collect()}
    want = brute_roots(values)
    got = {v: root.get(simhash._signed(v), simhash._signed(v)) for v in values}
    assert len(set(got.values())) == len(set(want.values()))
    assert len({(got[v], want[v]) for v in values}) == len(set(want.values()))
    pairs = edges.select("u", "v").distinct().count()
    assert pairs < 30 * len(values)


def test_pigeonring_keys_cover_all_differences():
    """Any three bits leave some table's key and chains intact."""
    tables = simhash._tables()
    r = np.random.default_rng(1)
    for bits in r.integers(0, 64, (3000, 3)).tolist():
        diff = 0
        for b in bits:
            diff |= 1 << b
        assert any(
            diff & mask == 0
            and all((diff & simhash._segments(s, tuple(range(n)))).bit_count() <= n * 3 // 8 for n in (5, 7))
            for s, mask in tables
        )


def test_odd_rows(spark, odd, odd_rows, none):
    got = simhash.with_components(odd)
    assert got.columns == [*odd.columns, "__fp", "component_id"] and got.count() == len(odd_rows)
    by_id = {r.doc_id: r for r in got.collect()}
    assert by_id[1]["__fp"] == by_id[2]["__fp"] == by_id[3]["__fp"] == 0
    assert {by_id[i].component_id for i in (1, 2, 3)} == {1} and {by_id[i].component_id for i in (4, 5)} == {4}
    assert by_id[None].component_id is None
    kept = simhash.deduplicate(odd)
    assert kept.schema == odd.schema
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 4, 6, 7, 8, None, 9]))
    assert simhash.with_components(none).count() == 0 and simhash.deduplicate(none).count() == 0


def test_components_of_paths_and_stars(spark):
    rows = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(260, 7), (3, 3), (100, 90)]
    root = {r.v: r.root for r in components.connected(spark.createDataFrame(rows, "u long, v long"), files.new_folder(spark, "test")).collect()}
    assert root == {**{i: 90 for i in range(100, 161)}, **{i: 7 for i in range(200, 261)}}
    none = spark.createDataFrame([], "u long, v long")
    assert components.connected(none, files.new_folder(spark, "test")).count() == 0
