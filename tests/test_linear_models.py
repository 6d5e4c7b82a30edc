"""Analysis of variance by Gram matrices against least squares; sketches; summaries by experiment."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from dosebin.operators import linear_models as L
from dosebin.operators.gates import control_gate, control_untreated, trim_outliers
from dosebin.operators.selection import quantiles
from dosebin.operators.sketches import merge_sketches, sketch_quantiles, sketch_table
from dosebin.plans import analysis as A
from dosebin.plans import summaries


def rss(x, y):
    return float(((y - x @ np.linalg.lstsq(x, y, rcond=None)[0]) ** 2).sum()), np.linalg.matrix_rank(x)


def design(pdf, term, adjusted):
    out = np.ones((len(pdf), 1))
    for name in term:
        if name == "x":
            columns = (pdf.x - pdf.x.mean()).to_numpy()[:, None]
        else:
            levels = sorted(pdf[name].unique())
            kept, last = (levels[:-1], levels[-1]) if adjusted else (levels[1:], None)
            columns = np.array([(pdf[name] == v).astype(float) - (pdf[name] == last).astype(float) for v in kept]).T
        out = np.array([a * b for a, b in itertools.product(out.T, columns.T)]).T
    return out


@pytest.mark.parametrize("adjusted", [False, True])
@pytest.mark.parametrize("empty", [False, True])
def test_three_levels_unbalanced_with_a_covariate(spark, adjusted, empty):
    r = np.random.default_rng(8)
    n = 300
    pdf = pd.DataFrame({"e": r.choice(list("abcd"), n, p=[0.5, 0.3, 0.15, 0.05]), "g": r.choice(["1", "2", "3"], n, p=[0.6, 0.3, 0.1]), "x": r.normal(1e3, 2, n)})
    if empty:  # a combination that never occurs
        pdf = pdf[~((pdf.e == "b") & (pdf.g == "3"))].reset_index(drop=True)
    pdf["y"] = 1e4 + pdf.x + (pdf.g == "2") * 2 - (pdf.e == "c") * (pdf.g == "3") + r.normal(size=len(pdf))
    terms = [("e",), ("g",), ("x",), ("e", "g"), ("g", "x")]
    df = spark.createDataFrame(pd.concat([pdf, pd.DataFrame({"e": ["a"], "g": ["1"], "x": [np.nan], "y": [1.0]})])).repartition(4)
    got = {row.term: row for row in L.anova(df, "y", terms, ["e", "g"], {"x": F.col("x")}, adjusted).collect()}
    y = pdf.y.to_numpy()
    parts = [np.ones((len(pdf), 1))] + [design(pdf, t, adjusted) for t in terms]
    full, rank = rss(np.hstack(parts), y)
    for k, term in enumerate(terms, 1):
        if adjusted:
            less, less_rank = rss(np.hstack(parts[:k] + parts[k + 1 :]), y)
            more, more_rank = full, rank
        else:
            (less, less_rank), (more, more_rank) = rss(np.hstack(parts[:k]), y), rss(np.hstack(parts[: k + 1]), y)
        row = got[":".join(term)]
        assert row.df == more_rank - less_rank and row.sum_sq == pytest.approx(less - more, rel=1e-6, abs=1e-6)
        assert row.f_value == pytest.approx((less - more) / row.df / (full / (len(pdf) - rank)), rel=1e-6) and 0 <= row.p_value <= 1
    assert (got["residual"].df, got["residual"].sum_sq, got["residual"].f_value) == (len(pdf) - rank, pytest.approx(full, rel=1e-7), None)


def test_moments_merge(spark):
    r = np.random.default_rng(1)
    df = spark.createDataFrame(pd.DataFrame({"e": r.choice(list("ab"), 90), "x": r.normal(size=90), "y": r.normal(size=90), "half": np.arange(90) % 2}))
    centred = df.select("e", "half", *[(F.col(c) - df.agg(F.avg(c)).first()[0]).alias(c) for c in ("x", "y")])
    sums = lambda d: d.groupBy("e").agg(F.count("*").alias("n"), F.sum("x").alias("s_x"), F.sum("y").alias("s_y"), F.sum(F.col("x") * F.col("y")).alias("p_x_y"))
    merged = L.merge_moments(*[sums(centred.where(f"half = {k}")) for k in (0, 1)], factors=["e"]).orderBy("e").toPandas()
    whole = L.moments(df, "y", ["e"], {"x": F.col("x")}).select(*merged.columns).orderBy("e").toPandas()
    pd.testing.assert_frame_equal(merged, whole, check_exact=False, rtol=1e-9)


def test_sketches_merge_and_stay_close(spark):
    r = np.random.default_rng(6)
    pdf = pd.DataFrame({"k": r.choice(["hot", "b"], 60_000, p=[0.9, 0.1]), "part": r.integers(0, 7, 60_000), "x": r.lognormal(size=60_000)})
    pdf.loc[:20_000, "x"] = 1.0
    df = spark.createDataFrame(pdf).unionByName(spark.createDataFrame([("n", 0, None), ("n", 0, float("nan"))], "k string, part int, x double"))
    wanted = {"low": ("x", 0.001), "mid": ("x", 0.5), "high": ("x", 0.999)}
    approximate = quantiles(df, ["k"], wanted, accuracy=4096).collect()
    merged = sketch_quantiles(merge_sketches(sketch_table(df, ["k", "part"], ["x"], 4096), keys=["k"]), ["k"], wanted)
    exact = {row.k: row for row in quantiles(df, ["k"], wanted).collect()}
    assert {row.k for row in approximate} == set(exact) == {"hot", "b"}
    for row in [*approximate, *[m for m in merged.collect() if m.k != "n"]]:
        x = np.sort(pdf.x[pdf.k == row.k].to_numpy())
        for name, (_, q) in wanted.items():
            ranks = np.searchsorted(x, row[name], "left") / len(x), np.searchsorted(x, row[name], "right") / len(x)
            assert ranks[0] - 0.002 <= q <= ranks[1] + 0.002
    small = df.where("part = 3 and k = 'b'").limit(500)
    got = quantiles(small, ["k"], {"m": ("x", 0.5)}, accuracy=4096).first().m
    values = sorted(v[0] for v in small.select("x").collect())
    assert got == values[(len(values) + 1) // 2 - 1]  # a small group is exact: the lower middle


def test_trim_and_gate_by_sketches(spark):
    r = np.random.default_rng(2)
    pdf = pd.DataFrame({"g": "a", "psmad2": r.normal(size=20_000), "ha": r.normal(size=20_000), "dox": "-dox", "ligand": "No Cyto", "cell_line": "R3", "experiment": "e"})
    pdf["norm_psmad2"] = pdf.psmad2
    df = spark.createDataFrame(pdf)
    exact, close = (trim_outliers(df, ["g"], low=0.05, high=0.95, accuracy=a).count() for a in (None, 4096))
    assert abs(exact - close) < 20_000 * 0.004
    exact, close = (control_gate(df, control_untreated(), 0.2, 0.9, accuracy=a).count() for a in (None, 4096))
    assert abs(exact - close) < 20_000 * 0.002


def test_a_new_experiment_is_added_alone(spark, tmp_path):
    r = np.random.default_rng(3)
    n = 4000
    pdf = pd.DataFrame({
        "experiment": r.choice(["007", "1995", "1996"], n, p=[0.6, 0.2, 0.2]), "cell_line": r.choice(["R3", "Luc"], n), "dox": r.choice(["-dox", "+dox"], n),
        "ligand": r.choice(["No Cyto", "TGFB1"], n), "ligand_conc": 1.0, "replicate": r.integers(1, 3, n), "gate": "Singlet",
        "ha": r.normal(2, 0.5, n), "psmad2": r.normal(1, 0.1, n), "norm_psmad2": r.normal(0.5, 0.1, n),
    })
    cells = spark.createDataFrame(pdf)
    s = A.Settings(q_ha=0.1, statistic="mean")
    stored, path, whole = (str(tmp_path / x) for x in ("cells", "states", "whole"))
    cells.write.partitionBy("experiment").parquet(stored)
    rows = spark.read.schema(cells.schema).parquet(stored)
    assert summaries.add_experiments(rows, whole, s) == ["007", "1995", "1996"]
    assert summaries.add_experiments(rows.where("experiment <> '007'"), path, s) == ["1995", "1996"]
    seen, real = [], summaries.gates.trim_outliers
    try:
        summaries.gates.trim_outliers = lambda df, keys: seen.append(df) or real(df, keys)
        assert summaries.add_experiments(rows, path, s) == ["007"] and summaries.add_experiments(rows, path, s) == []
    finally:
        summaries.gates.trim_outliers = real
    (read,) = seen
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(experiment" in plan and "(experiment" in plan and "= 007)" in plan  # no other folder is read
    keys = list(s.summary_keys)
    tables = [summaries.described(summaries.read_states(spark, p), keys, s.signal).orderBy(*keys, "bin_id").toPandas() for p in (path, whole)]
    pd.testing.assert_frame_equal(*tables, check_exact=False, rtol=1e-9)
    pooled = summaries.described(summaries.merged_states(summaries.read_states(spark, path), ["cell_line"], s.signal), ["cell_line"], s.signal)
    binned = A.bin_cells(A.gated_cells(trim_outliers(cells, ["experiment", "cell_line", "ligand", "ligand_conc", "gate"]), s), s).toPandas()
    for row in pooled.collect():
        x = binned.norm_psmad2[(binned.cell_line == row.cell_line) & (binned.bin_id == row.bin_id)]
        assert (row.n, row.least, row.most) == (len(x), x.min(), x.max()) and row["mean"] == pytest.approx(x.mean())
        assert row.sd is None if len(x) < 2 else row.sd == pytest.approx(x.std())
