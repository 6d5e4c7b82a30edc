"""Exact quantiles and equal-count bins of uneven groups, against numpy and window functions."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from dosebin.operators import selection
from dosebin.operators.binning import equal_count_bins
from dosebin.operators.selection import quantiles, running_count, slot


def uneven(n=6000, seed=1):
    """One key with most rows, one value repeated in a third of them, plus odd values."""
    rng = np.random.default_rng(seed)
    key = np.where(rng.random(n) < 0.6, "hot", rng.choice(["a", "b", "c"], n)).astype(object)
    x = rng.lognormal(0, 3, n) * rng.choice([-1.0, 1.0], n)
    x[rng.random(n) < 0.33] = 2.5
    x[:3] = [0.0, 1e300, -1e-300]
    key[-1], x[-1] = "single", 7.0
    return pd.DataFrame({"k": key, "x": x, "id": rng.permutation(n).astype("int64") * (1 << 31) + 5})


QS = [0.0, 0.001, 0.25, 0.5, 0.9, 0.999, 1.0]


@pytest.mark.parametrize("slot_rows", [100_000, 40])
def test_quantiles_match_numpy(spark, monkeypatch, slot_rows):
    monkeypatch.setattr(selection, "SLOT_ROWS", slot_rows)
    monkeypatch.setattr(selection, "STEPS", 16)
    pdf = uneven()
    df = spark.createDataFrame(pdf)
    got = quantiles(df, ["k"], {f"q{i}": ("x", q) for i, q in enumerate(QS)}).toPandas().set_index("k")
    assert sorted(got.index) == ["a", "b", "c", "hot", "single"]
    for k, part in pdf.groupby("k"):
        np.testing.assert_allclose(got.loc[k].to_numpy(float), np.quantile(part.x, QS), rtol=1e-12, err_msg=k)


def test_quantiles_skip_missing_and_keep_infinity(spark):
    rows = [("a", 1.0), ("a", None), ("a", float("nan")), ("a", float("-inf")), ("a", 3.0), ("n", None), (None, 4.0)]
    got = quantiles(spark.createDataFrame(rows, "k string, x double"), ["k"], {"lo": ("x", 0.0), "mid": ("x", 0.5)})
    assert {(r.k, r.lo, r.mid) for r in got.collect()} == {("a", float("-inf"), 1.0), (None, 4.0, 4.0)}


def test_quantiles_of_two_columns_without_keys(spark):
    pdf = uneven(500)
    pdf["y"] = -pdf.x
    row = quantiles(spark.createDataFrame(pdf), [], {"a": ("x", 0.3), "b": ("y", 0.7)}).first()
    assert row.a == pytest.approx(np.quantile(pdf.x, 0.3)) and row.b == pytest.approx(np.quantile(pdf.y, 0.7))


def test_a_narrow_range_is_cut_until_few_rows_are_left(spark, monkeypatch):
    """Values like time stamps all fall into one slot; it is cut by their own range."""
    monkeypatch.setattr(selection, "SLOT_ROWS", 500)
    stamps = 1.7e12 + np.random.default_rng(2).integers(0, 40_000_000, 20_000).astype(float)
    stamps[:7000] = 1.7e12 + 777
    df = spark.createDataFrame(pd.DataFrame({"k": "hot", "x": stamps}))
    assert df.select(slot(F.col("x"))).distinct().count() == 1
    seen = []
    keep = selection.materialize
    monkeypatch.setattr(selection, "materialize", lambda t: seen.append(keep(t)) or seen[-1])
    got = quantiles(df, ["k"], {f"q{i}": ("x", q) for i, q in enumerate(QS)}).first()
    assert [got[f"q{i}"] for i in range(len(QS))] == np.quantile(stamps, QS).tolist()
    last = seen[-1].where("__slot_lo < __slot_hi").agg(F.max("__c")).first()[0]
    assert len(seen) == 2 and last < 500


def test_running_count_does_not_hold_a_group_in_one_task(spark):
    values = 1.7e12 + np.random.default_rng(4).permutation(6000)
    runs = spark.createDataFrame(pd.DataFrame({"k": "hot", "v": values, "c": 2}))
    got = running_count(runs, ["k"], "v", "c", "upto").orderBy("v").toPandas()
    assert got.upto.tolist() == (2 * np.arange(1, 6001)).tolist()


def test_slot_never_decreases(spark):
    xs = sorted([*np.geomspace(1e-300, 1e300, 400), *-np.geomspace(1e-300, 1e300, 400), 0.0, 1.0, float("inf"), float("-inf")])
    df = spark.createDataFrame([(float(x),) for x in xs], "x double").select("x", slot(F.col("x")).alias("s"))
    got = [r.s for r in df.orderBy("x").collect()]
    assert got == sorted(got)


@pytest.mark.parametrize("n_bins", [3, 10])
def test_equal_count_bins_are_ntile(spark, n_bins):
    df = spark.createDataFrame(uneven(2000)).cache()
    got = equal_count_bins(df, n_bins, ["k"], "x", "id").select("id", "bin_id")
    want = df.withColumn("want", F.ntile(n_bins).over(Window.partitionBy("k").orderBy("x", "id"))).select("id", "want")
    joined = got.join(want, "id")
    assert joined.count() == 2000
    assert joined.where(F.col("bin_id") != F.col("want")).count() == 0


def test_equal_count_bins_seven_in_three(spark):
    df = spark.createDataFrame([("g", float(i), i) for i in range(1, 8)], "k string, x double, id bigint")
    got = equal_count_bins(df, 3, ["k"], "x", "id").orderBy("id").collect()
    assert [r.bin_id for r in got] == [1, 1, 1, 2, 2, 3, 3]


def test_rows_outside_wanted_slots_never_meet_the_groups(spark, monkeypatch):
    """Every row of both columns was compared with the keys of all wanted slots."""
    met, keep = [], selection.attach

    def counted(rows, summary, keys, *more):
        met.append(rows.count())
        return keep(rows, summary, keys, *more)

    monkeypatch.setattr(selection, "attach", counted)
    pdf = pd.DataFrame({"k": ["a", None] * 1000, "x": np.geomspace(1, 1e6, 2000), "y": np.geomspace(1, 1e9, 2000)})
    got = quantiles(spark.createDataFrame(pdf), ["k"], {"x0": ("x", 0.001), "y1": ("y", 0.999)}).toPandas()
    for k, part in pdf.groupby("k", dropna=False):
        row = got[got.k.isna() if pd.isna(k) else got.k == k].iloc[0]
        np.testing.assert_allclose([row.x0, row.y1], [np.quantile(part.x, 0.001), np.quantile(part.y, 0.999)], rtol=1e-12)
    assert max(met) < 200
