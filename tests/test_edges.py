"""Hand-made cases: missing values, thresholds, bin edges, tiny groups."""

import math

import pytest
from pyspark.sql import functions as F

from dosebin import functions as fn
from dosebin.operators import binning, dose, gates, matrix, normalize, stats


def column(spark, values, expr, kind="double"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in df.select("i", expr(F.col("x")).alias("y")).orderBy("i").collect()]


def test_log_channel(spark):
    assert column(spark, [0.0, -1.0, None, 10.0], fn.log_channel) == [None, None, None, 1.0]
    got = column(spark, [0.0, -1.0, None, 10.0], lambda x: fn.log_channel(x, "neg_inf"))
    assert got == [float("-inf"), None, None, 1.0]
    with pytest.raises(ValueError):
        fn.log_channel(F.col("x"), "other")


def test_floored_log(spark):
    assert column(spark, [0.0, -5.0, 100.0], fn.floored_log_channel) == pytest.approx([-1.0, -1.0, 2.0])


def test_ratio_with_zero_denominator(spark):
    assert column(spark, [0.0, 2.0], lambda x: fn.log_ratio(F.lit(4.0), x)) == [None, 2.0]


def test_names(spark):
    def field(i, make):
        return lambda x: make(fn.name_field(x, i))

    names = ["R3_pD_mC", "R3_pD_1T_2_DAPI", "R3_xx_zz", "Luc_mD_0.1G_rep12"]
    assert column(spark, names, field(1, fn.dox_label), "string") == ["+dox", "+dox", "Error", "-dox"]
    assert column(spark, names, field(2, fn.ligand_conc), "string") == [0.0, 1.0, -1.0, 0.1]
    assert column(spark, names, field(2, fn.ligand_label), "string") == ["No Cyto", "TGFB1", "Error", "GDF11"]
    assert column(spark, names, field(3, fn.replicate_number), "string") == [1, 2, 1, 12]
    assert column(spark, names, fn.gate_label, "string") == ["Singlet", "DAPI", "Singlet", "Singlet"]
    assert column(spark, ["Luc_0T", "R3_2.5G"], fn.legacy_conc, "string") == [0.0, 2.5]
    assert column(spark, ["Luc_0T", "R3_2.5G", "x"], fn.legacy_ligand, "string") == ["TGFB1", "GDF11", "error"]
    paths = ["file:/a/2024-01-02/R3_pD_mC.csv", "file:/a/e=1/sample=R3_1T.csv/part-0-x.csv", "s3://b/e/A%20b.csv"]
    assert column(spark, paths, fn.sample_of_path, "string") == ["R3_pD_mC", "R3_1T", "A b"]


CELL = "experiment string, cell_line string, dox string, ligand string, ligand_conc double, ha double, norm_psmad2 double"


def test_gate_is_strict_and_needs_a_control(spark):
    rows = [("e1", "R3", "-dox", "No Cyto", 0.0, h, h) for h in (1.0, 2.0, 3.0)]
    rows += [("e1", "R3", "+dox", "TGFB1", 1.0, 3.0, 2.0), ("e1", "R3", "+dox", "TGFB1", 1.0, 3.1, 2.0)]
    rows += [("e1", "Luc", "+dox", "TGFB1", 1.0, 9.0, 9.0), ("e2", "R3", "+dox", "TGFB1", 1.0, 9.0, 9.0)]
    df = spark.createDataFrame(rows, CELL)
    kept = gates.control_gate(df, q_signal=0.0, q_ha=1.0).collect()
    assert [(r.experiment, r.ha) for r in kept] == [("e1", 3.1)]
    missing = gates.groups_without_control(df, gates.control_untreated()).collect()
    assert [r.experiment for r in missing] == ["e2"]


def test_trim_is_inclusive(spark):
    df = spark.createDataFrame([("g", float(i)) for i in range(11)], "k string, x double")
    kept = gates.trim_outliers(df, ["k"], ("x",), 0.1, 0.9)
    assert sorted(r.x for r in kept.collect()) == [float(i) for i in range(1, 10)]


def binned(spark, values, n, **kw):
    df = spark.createDataFrame([("g", float(v)) for v in values], "k string, ha double")
    return binning.equal_width_bins(df, n, ["k"], **kw)


def test_inner_edge_goes_to_the_lower_bin(spark):
    got = binned(spark, [0.0, 1.0, 2.0, 3.0, 4.0], 4, margin=0.0).orderBy("ha").collect()
    assert [r.bin_id for r in got] == [1, 1, 2, 3, 4]
    edges = binned(spark, [0.1 * i for i in range(11)], 10, margin=0.0).orderBy("ha").collect()
    for r in edges:
        assert r.bin_id == 1 or r.bin_lo < r.ha
        assert r.ha <= r.bin_hi or r.bin_id == 10


def test_one_value_uses_one_bin(spark):
    out = binned(spark, [5.0, 5.0], 10)
    summary = out.groupBy("k", "bin_id").count()
    numbered = binning.renumber_bins(summary, ["k"]).collect()
    assert [(r.bin_id, r["count"]) for r in numbered] == [(1, 2)]


def test_empty_bins_close_up(spark):
    out = binned(spark, [0.0, 0.1, 9.0, 10.0], 10)
    ids = [r.bin_id for r in binning.renumber_bins(out.groupBy("k", "bin_id").count(), ["k"]).collect()]
    assert sorted(ids) == list(range(1, len(ids) + 1)) and len(ids) < 10


def test_log_bins_leave_out_what_is_outside(spark):
    df = spark.createDataFrame([(v,) for v in (1.0, 9.0, 11.0, 99.0, 1000.0, 1001.0)], "ha double")
    got = binning.log_spaced_bins(df, F.lit(1.0), F.lit(1000.0), 3).orderBy("ha").collect()
    assert [r.bin_id for r in got] == [None, 1, 2, 2, 3, None]


BIN = "k string, ligand_conc double, bin_id int, mean_norm_psmad2 double"


def test_forward_difference_of_one_row(spark):
    df = spark.createDataFrame([("a", 1.0, 1, 2.0), ("b", 1.0, 1, 2.0), ("b", 1.0, 2, 5.0)], BIN)
    got = dose.forward_differences(df, ["k"]).orderBy("k").collect()
    assert [(r.k, r.bin_id, r.diffs) for r in got] == [("a", 1, None), ("b", 1, 3.0)]


def test_control_anchor(spark):
    df = spark.createDataFrame([("a", 0.0, 1, 2.0), ("a", 1.0, 1, 4.0), ("a", 1.0, 2, 6.0), ("b", 1.0, 1, 1.0)], BIN)
    got = normalize.control_anchored_scale(df, ["k"]).orderBy("k", "ligand_conc", "bin_id").collect()
    assert [r.norm_mean for r in got] == [0.0, 0.5, 1.0, None]
    twice = df.union(df.where("ligand_conc = 0"))
    with pytest.raises(Exception, match="more than one control"):
        normalize.control_anchored_scale(twice, ["k"]).collect()


def test_scaling_of_constant_groups(spark):
    df = spark.createDataFrame([("a", 0.0, 1, 2.0), ("a", 0.0, 2, 2.0)], BIN)
    assert [r.s for r in normalize.min_max_scale(df, ["k"], name="s").collect()] == [None, None]
    assert [r.s for r in normalize.z_score(df, ["k"], "mean_norm_psmad2", "s").collect()] == [None, None]


def test_inner_bins(spark):
    df = spark.createDataFrame([("a", 0.0, b, 1.0) for b in (1, 2, 3, 4)] + [("b", 0.0, 2, 1.0)], BIN)
    assert sorted((r.k, r.bin_id) for r in normalize.inner_bins(df).collect()) == [("a", 2), ("a", 3), ("b", 2)]
    assert sorted((r.k, r.bin_id) for r in normalize.inner_bins(df, ["k"]).collect()) == [("a", 2), ("a", 3)]


def test_fit_with_two_points(spark):
    df = spark.createDataFrame([("a", 0.0, 1, 2.0), ("a", 0.0, 2, 5.0), ("c", 0.0, 1, 1.0)], BIN)
    rows = {r.k: r for r in stats.linear_fits(df, ["k"]).collect()}
    assert rows["a"].slope == pytest.approx(3.0) and rows["a"].slope_low is None
    assert rows["c"].slope is None and rows["c"].slope_low is None


def test_rank_sum_separated(spark):
    rows = [("e", "1", float(i)) for i in range(6)] + [("e", "2", 10.0 + i) for i in range(3)]
    r = stats.rank_sum_test(spark.createDataFrame(rows, "experiment string, group_id string, eucl_diff double"), ["experiment"]).first()
    assert (r.n1, r.n2, r.w) == (6, 3, 0.0) and r.p_value == pytest.approx(2 / 84)


def test_rank_sum_with_ties_is_approximate(spark):
    rows = [("e", g, v) for g, v in [("1", 1.0), ("1", 2.0), ("1", 2.0), ("2", 2.0), ("2", 3.0), ("2", 4.0)]]
    r = stats.rank_sum_test(spark.createDataFrame(rows, "experiment string, group_id string, eucl_diff double"), ["experiment"]).first()
    assert r.w == 1.0
    n, ties = 6, 3**3 - 3
    sigma = math.sqrt(9 / 12 * (n + 1 - ties / (n * (n - 1))))
    assert r.p_value == pytest.approx(math.erfc((4.5 - 1 - 0.5) / sigma / math.sqrt(2)))


def test_distances_scale_up_for_missing_bins(spark):
    rows = [("a", 1, 0.0), ("a", 2, 0.0), ("b", 1, 3.0), ("b", 2, 4.0), ("c", 1, 1.0)]
    df = spark.createDataFrame(rows, "exp_rep string, bin_id int, mean_norm_psmad2 double")
    got = {(r.row_a, r.row_b): r.distance for r in matrix.row_distances(df).collect()}
    assert got == {("a", "b"): 5.0, ("a", "c"): pytest.approx(math.sqrt(2)), ("b", "c"): pytest.approx(math.sqrt(8))}


def test_null_keys_are_a_group(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0)], "k string, ha double")
    out = binning.equal_width_bins(df, 2, ["k"]).collect()
    assert len(out) == 3 and all(r.bin_id is not None for r in out)


def test_rank_sum_of_a_hot_group(spark):
    """Slots and ties: against ranks by pandas."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"e": rng.choice(["hot", "b"], 900, p=[0.9, 0.1]), "g": rng.choice(["1", "2"], 900)})
    pdf["y"] = np.where(rng.random(900) < 0.4, 1.5, rng.lognormal(0, 2, 900))
    for r in stats.rank_sum_test(spark.createDataFrame(pdf), ["e"], "y", "g").collect():
        part = pdf[pdf.e == r.e]
        n1 = (part.g == "1").sum()
        assert r.w == part.y.rank()[part.g == "1"].sum() - n1 * (n1 + 1) / 2
        assert 0 < r.p_value <= 1
