"""Registered queries against their SQL at the smallest scale, and their plans."""

import os
from dataclasses import replace

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import check
from dosebin import schema as S
from dosebin import session
from dosebin.operators import binning, bootstrap, gates, matrix
from dosebin.plans import analysis as A
from dosebin.plans import queries as Q
from dosebin.plans.oracle import ORACLE
from dosebin.sources import tables
from dosebin.sources.tables import cells

FEW = [
    "minimum_slice", "scan_by_instrument", "parameter_sweep", "control_anchored_scale", "two_way_anova",
    "rank_sum_test", "violin_density", "gate_comparison", "dose_panels", "bootstrap_event_values",
]


@pytest.fixture(scope="module")
def con(folder):
    c = duckdb.connect()
    for t in check.TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return c


def same(spark, con, folder, name):
    df = entry.queries()[name](spark, folder)
    rel = con.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert check.rows_of(df.columns, [tuple(r) for r in df.collect()]) == check.rows_of(rel.columns, rel.fetchall())


@pytest.mark.parametrize("name", FEW)
def test_query_matches_sql(spark, con, folder, name):
    same(spark, con, folder, name)


def test_any_dose_legacy_gate_has_intervals(spark, con, folder):
    same(spark, con, folder, "grouped_legacy_intervals")


def test_every_query_has_sql():
    assert set(Q.QUERIES) == set(ORACLE)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_gated_cells_are_not_shuffled(spark, folder):
    """Trim, gate and bin only look up small summaries; rows stay where they were scanned."""
    rows = gates.trim_outliers(cells(spark, folder), S.TRIM_KEYS)
    rows = binning.equal_width_bins(gates.control_gate(rows, q_ha=0.1))
    text = plan_of(rows)
    assert "SortMergeJoin" not in text and "CartesianProduct" not in text and "NestedLoop" not in text
    top = text.split("BroadcastExchange")[0]
    assert "Exchange hashpartitioning" not in top


def test_rows_look_up_written_summaries(spark, folder):
    rows = gates.control_gate(gates.trim_outliers(cells(spark, folder), S.TRIM_KEYS), q_ha=0.1)
    text = plan_of(rows)
    assert "percentile" not in text and "Exchange hashpartitioning" not in text
    assert text.count("BroadcastHashJoin") == 2


def scans_of(spark, monkeypatch, build):
    """How often line items are read, by the tables written on the way and by the result: as given, and as landed."""
    monkeypatch.setattr(tables, "_LANDED", {})
    plans = []
    writer = type(spark.range(1).write)
    keep = writer.parquet
    monkeypatch.setattr(writer, "parquet", lambda w, path, *a, **k: plans.append(plan_of(w._df)) or keep(w, path, *a, **k))
    plans.append(plan_of(build()))
    ((_, stored),) = tables._LANDED.values()
    assert len(stored) <= 1
    return [sum(p.count(name) for p in plans) for name in ("lineitem.parquet", *(path.rsplit("/", 1)[1] for path in stored))]


@pytest.mark.parametrize("name", ["single_ligand_analysis", "equal_width_bins", "parameter_sweep", "trim_outliers"])
def test_raw_cells_are_read_three_times_at_most(spark, folder, monkeypatch, name):
    raw, landed = scans_of(spark, monkeypatch, lambda: Q.QUERIES[name](spark, folder))
    assert raw == 1 and 0 < landed <= 3


def test_landed_tables_follow_their_files(spark, folder, monkeypatch):
    monkeypatch.setattr(tables, "_LANDED", {})
    monkeypatch.setattr(session, "_WRITTEN", [])
    first = tables.landed_table(spark, folder, "events", ["event_id", "value"])
    assert tables.landed_table(spark, folder, "events", ["event_id", "value"]) is first and first.rdd.getNumPartitions() > 1
    assert session.release_tables(spark) == 1
    again = tables.landed_table(spark, folder, "events", ["event_id", "value"])
    assert again is not first and again.count() == spark.read.parquet(f"{folder}/events.parquet").count()
    wide = spark.range(100, numPartitions=64)
    assert session.landed(wide) is wide  # as many parts as cores: never shuffled


def test_profiles_of_any_width(spark):
    df = spark.createDataFrame([("a", b, float(b)) for b in (1, 3, 20)], "exp_rep string, bin_id int, mean_norm_psmad2 double")
    assert matrix.wide_profiles(df).columns == ["exp_rep", "bin_1", "bin_3", "bin_20"]
    with pytest.raises(Exception, match="not among the columns: 20"):
        matrix.wide_profiles(df, columns=[1, 2, 3]).collect()


def test_written_tables_can_be_released(spark, monkeypatch):
    monkeypatch.setattr(session, "_WRITTEN", [])
    table = session.materialize(spark.range(5))
    path = table.inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path) and session.release_tables(spark) == 1 and not os.path.exists(path)


def test_only_needed_columns_are_read(spark, folder):
    text = plan_of(cells(spark, folder).groupBy("experiment").agg(F.avg("ha")))
    assert "l_suppkey" not in text.split("ReadSchema")[1] and "l_discount" not in text


def test_result_properties(spark, folder):
    s = A.Settings(q_ha=0.1, n_boot=10)
    r = A.analyse(Q.trimmed(spark, folder), s)
    n = r.filtered.count()
    assert r.binned.where("bin_id between 1 and 10").count() == n
    assert r.boot.agg(F.sum("n_cells")).first()[0] == n
    scaled = Q.QUERIES["min_max_scaled"](spark, folder).agg(F.min("new_norm_psmad2"), F.max("new_norm_psmad2")).first()
    assert tuple(scaled) == (0.0, 1.0)
    with pytest.raises(ValueError):
        A.summarise(r.binned, A.Settings(statistic="mode"))


def test_single_analysis_stores_only_columns_of_its_summary(spark, folder, monkeypatch):
    """Trimmed and gated cells were both stored with channels and doses that nothing read."""
    stored, keep = [], Q.trimmed
    monkeypatch.setattr(Q, "trimmed", lambda *a, **more: stored.append(keep(*a, **more)) or stored[-1])
    got = Q.single(spark, folder)
    assert not {"smad2", "psmad2", "dapi", "tgfb1", "gdf11", "gate", "cell_id"} & set(stored[0].columns)
    whole = A.analyse(keep(spark, folder), Q.SINGLE).boot
    columns = [*S.SUMMARY_KEYS, "bin_id", "n_cells", Q.MEAN]
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, whole.select(*columns).collect()))


def sweep_cells(spark):
    rng = np.random.default_rng(17)
    rows = []
    for i in range(1500):
        line, ligand = ("Luc", "R3", "R3")[i % 3], ("No Cyto", "TGFB1", None)[i // 3 % 3]
        dose = 0.0 if line == "Luc" else (0.1, None)[i % 2]
        rows.append(("1" if i % 7 else None, 1 + i % 2, ligand, dose, line, "+dox", float(rng.normal(2, 0.4)), float(rng.normal(1, 0.3))))
    rows.append(("no control", 1, "TGFB1", 0.1, "R3", "+dox", 9.0, 9.0))
    names = "experiment string, replicate int, ligand string, ligand_conc double, cell_line string, dox string, ha double, norm_psmad2 double"
    return spark.createDataFrame(rows, names)


def test_sweep_is_every_combination_by_itself(spark):
    rows = sweep_cells(spark)
    s = A.Settings(control="luc", statistic="mean", number_keys=tuple(S.SUMMARY_KEYS))
    got = A.parameter_sweep(rows, [0.6, 0.0], [0.1, 0.3], [3, 5], s)
    columns = [*S.SUMMARY_KEYS, "bin_id", "n_cells", "median_norm_psmad2", "bin_lo", "bin_hi"]
    for qs in (0.6, 0.0):
        for qh in (0.1, 0.3):
            for n in (3, 5):
                one = A.analyse(rows, replace(s, q_signal=qs, q_ha=qh, n_bins=n)).boot
                some = got.where((F.col("q_signal") == qs) & (F.col("q_ha") == qh) & (F.col("n_bins") == n))
                want = sorted(map(repr, one.select(*columns).collect()))
                assert sorted(map(repr, some.select(*columns).collect())) == want and len(want) > 12


def test_sweep_repeats_cells_for_bin_counts_after_their_range(spark, monkeypatch):
    """Ranges were looked for among cells repeated for every combination, and all names travelled with each."""
    rows = sweep_cells(spark)
    ranged, binned = [], []
    keep, boot = binning.bin_ranges, bootstrap.bootstrap_bins
    monkeypatch.setattr(binning, "bin_ranges", lambda df, *a: ranged.append(df) or keep(df, *a))
    monkeypatch.setattr(bootstrap, "bootstrap_bins", lambda df, *a, **more: binned.append(df) or boot(df, *a, **more))
    got = A.parameter_sweep(rows, [0.5, 0.0], [0.1], [2, 4, 8], A.Settings(control="luc", n_boot=3))
    cells = sum(r["n_cells"] for r in got.where("n_bins = 2").collect())
    assert cells > 500 and [df.count() for df in ranged] == [cells]
    assert binned[0].count() == 3 * cells and "string" not in dict(binned[0].dtypes).values()


def test_sweep_stores_only_columns_of_its_summary(spark, folder, monkeypatch):
    stored, keep = [], Q.trimmed
    monkeypatch.setattr(Q, "trimmed", lambda *a, **more: stored.append(keep(*a, **more)) or stored[-1])
    Q.QUERIES["parameter_sweep"](spark, folder)
    assert not {"smad2", "psmad2", "dapi", "tgfb1", "gdf11", "gate", "cell_id"} & set(stored[0].columns)
