"""Distributions against known values, fits and variance tables against least squares."""

import statistics

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from dosebin.functions import f_upper_tail, normal_quantile, t_quantile
from dosebin.functions.distributions import beta_regularised
from dosebin.operators import stats
from dosebin.operators import density
from dosebin.operators.density import violin_density


def test_normal_quantile(spark):
    ps = [1e-300, 1e-12, 0.001, 0.075, 0.2, 0.5, 0.6, 0.925, 0.99, 1 - 1e-12]
    df = spark.createDataFrame([(p,) for p in ps], "p double").select("p", normal_quantile(F.col("p")).alias("z"))
    for r in df.collect():
        assert r.z == pytest.approx(statistics.NormalDist().inv_cdf(r.p), rel=1e-13, abs=1e-15)
    out = spark.createDataFrame([(0.0,), (1.0,), (None,)], "p double").select(normal_quantile(F.col("p")).alias("z"))
    assert [r.z for r in out.collect()] == [None, None, None]


def test_t_quantile(spark):
    known = {1: 12.706204736432095, 8: 2.306004135204166, 30: 2.0422724563012373, None: None, 0: None}
    df = spark.createDataFrame([(k,) for k in known], "df long").select("df", t_quantile(0.975, F.col("df")).alias("t"))
    for r in df.collect():
        assert r.t == (None if known[r.df] is None else pytest.approx(known[r.df], rel=1e-9))


def test_f_tail(spark):
    rows = [(4.9646027437307145, 1.0, 10.0, 0.05), (3.0, 2.0, 1e9, float(np.exp(-3.0))), (0.0, 3.0, 4.0, 1.0)]
    df = spark.createDataFrame(rows, "f double, a double, b double, want double")
    for r in df.select("want", f_upper_tail(F.col("f"), F.col("a"), F.col("b")).alias("p")).collect():
        assert r.p == pytest.approx(r.want, rel=1e-6)


def test_beta_by_quadrature():
    x = np.linspace(0, 0.37, 200001)
    y = x**1.5 * (1 - x) ** 3.0
    full = np.linspace(0, 1, 200001)
    z = full**1.5 * (1 - full) ** 3.0
    assert beta_regularised(0.37, 2.5, 4.0) == pytest.approx(np.trapezoid(y, x) / np.trapezoid(z, full), rel=1e-7)


def least_squares_rss(y, *columns):
    a = np.column_stack([np.ones(len(y)), *columns])
    return float(((y - a @ np.linalg.lstsq(a, y, rcond=None)[0]) ** 2).sum())


def unbalanced(seed=2):
    rng = np.random.default_rng(seed)
    n = 40
    e = rng.choice(["a", "b", "c"], n, p=[0.5, 0.3, 0.2])
    g = rng.choice(["1", "2"], n, p=[0.7, 0.3])
    x = rng.choice([0.1, 1.0, 10.0], n)
    y = (e == "b") * 1.0 + (g == "2") * 0.5 + np.log10(x) * 0.2 + rng.normal(0, 0.5, n)
    return pd.DataFrame({"experiment": e, "group_id": g, "ligand_conc": x, "eucl_diff": y, "range": y})


def test_two_way_anova(spark):
    pdf = unbalanced()
    got = {r.term: r for r in stats.two_way_anova(spark.createDataFrame(pdf)).collect()}
    y = pdf.eucl_diff.to_numpy()
    e = [(pdf.experiment == k).to_numpy(float) for k in ("b", "c")]
    g = (pdf.group_id == "2").to_numpy(float)
    rss = [least_squares_rss(y), least_squares_rss(y, *e), least_squares_rss(y, *e, g), least_squares_rss(y, *e, g, *[v * g for v in e])]
    assert got["experiment"].sum_sq == pytest.approx(rss[0] - rss[1])
    assert got["group_id"].sum_sq == pytest.approx(rss[1] - rss[2])
    assert got["experiment:group_id"].sum_sq == pytest.approx(rss[2] - rss[3])
    assert got["residual"].sum_sq == pytest.approx(rss[3])
    assert [got[t].df for t in ("experiment", "group_id", "experiment:group_id", "residual")] == [2, 1, 2, 34]


def test_ancova(spark):
    pdf = unbalanced()
    got = {r.term: r for r in stats.ancova(spark.createDataFrame(pdf)).collect()}
    y, x = pdf.range.to_numpy(), np.log10(pdf.ligand_conc.to_numpy())
    e = [(pdf.experiment == k).to_numpy(float) for k in ("b", "c")]
    full = least_squares_rss(y, *e, x)
    assert got["residual"].sum_sq == pytest.approx(full)
    assert got["experiment"].sum_sq == pytest.approx(least_squares_rss(y, x) - full)
    assert got["covariate"].sum_sq == pytest.approx(least_squares_rss(y, *e) - full)
    assert 0 <= got["experiment"].p_value <= 1 and got["residual"].p_value is None


def test_density_is_close_to_the_direct_sum(spark):
    rng = np.random.default_rng(4)
    y = rng.normal(0, 1, 300)
    out = violin_density(spark.createDataFrame(pd.DataFrame({"k": "a", "y": y})), ["k"], "y").orderBy("point").toPandas()
    iqr = np.subtract(*np.quantile(y, [0.75, 0.25]))
    bw = 0.9 * min(y.std(ddof=1), iqr / 1.34) * 300**-0.2
    assert out.bw[0] == pytest.approx(bw) and len(out) == 512
    direct = np.exp(-0.5 * ((out.x.to_numpy()[:, None] - y) / bw) ** 2).sum(axis=1) / (300 * bw * np.sqrt(2 * np.pi))
    np.testing.assert_allclose(out.density, direct, atol=2e-3)
    assert np.trapezoid(out.density, out.x) == pytest.approx(1, abs=5e-3)


def test_qq_points(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (3, 1, 2)], "k string, y double")
    got = stats.qq_points(df, ["k"], "y").orderBy("point").collect()
    want = [statistics.NormalDist().inv_cdf((i - 0.375) / 3.25) for i in (1, 2, 3)]
    assert [r.sample for r in got] == [1.0, 2.0, 3.0]
    assert [r.theoretical for r in got] == pytest.approx(want, abs=1e-12)


@pytest.mark.parametrize("points", [16, 512, 1000])
def test_transform_is_the_sum_over_all_pairs_of_nodes(points):
    mass = np.random.default_rng(points).random(points) * (np.arange(points) % 3 == 0)
    apart = (np.arange(points)[:, None] - np.arange(points)) * 0.07
    direct = (mass * np.exp(-0.5 * apart**2)).sum(axis=1) / np.sqrt(2 * np.pi)
    np.testing.assert_allclose(density._smoothed(mass, 0.07), direct, rtol=1e-10, atol=1e-12)
