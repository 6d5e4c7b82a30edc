"""CSV folders with different headers, instruments and name grammars."""

import os

import pytest

from dosebin.operators.gates import trim_outliers
from dosebin.sources import csv_tree


def put(root, path, text):
    full = os.path.join(root, path)
    os.makedirs(os.path.dirname(full), exist_ok=True)
    with open(full, "w") as f:
        f.write(text)


def test_columns_are_bound_by_name(spark, tmp_path):
    root = str(tmp_path)
    put(root, "2024-01-02/R3_pD_0.1T_2.csv", "FSC-A,B1-A :: HA,YG1-A,R2-A,UV7-A,Time\n1,10,100,1000,5,0\n")
    put(root, "2024-01-02/R3_mD_mC_DAPI.csv", "UV7-A,R2-A,YG1-A,B1-A :: HA,FSC-A\n6,2000,200,20,2\n")
    put(root, "2024-09-04/R3_mD_mC.csv", "FSC-A,B1-A :: HA,YG1-A,R2-A\n3,30,300,3000\n")
    put(root, "2024-09-04/empty.csv", "")
    rows = {r["sample"]: r for r in csv_tree.scan_samples(spark, root).collect()}
    assert len(rows) == 3
    a, b, c = rows["R3_pD_0.1T_2"], rows["R3_mD_mC_DAPI"], rows["R3_mD_mC"]
    assert (a.fsc_a, a.ha, a.psmad2, a.smad2, a.dapi) == (1, 10, 100, 1000, 5)
    assert (b.fsc_a, b.ha, b.psmad2, b.smad2, b.dapi) == (2, 20, 200, 2000, 6)
    assert c.dapi is None and c.experiment == "2024-09-04"
    assert (a.experiment, a.dox, a.ligand, a.ligand_conc, a.replicate, a.gate) == ("2024-01-02", "+dox", "TGFB1", 0.1, 2, "Singlet")
    assert b.gate == "DAPI" and b.ligand == "No Cyto"
    loaded = csv_tree.load_cells(spark, root)
    assert sorted(r["sample"] for r in loaded.collect()) == ["R3_mD_mC_DAPI", "R3_pD_0.1T_2"]


def test_long_and_quoted_headers_and_odd_names(spark, tmp_path):
    root = str(tmp_path)
    many = ",".join(f"Comp-{i}-{'x' * 60}" for i in range(1200))  # over 64 KiB
    put(root, "a+b 50%/R3_pD_0.1T_2.csv", f'{many},"B1-A :: HA, area",YG1-A,R2-A,UV7-A,FSC-A\n' + "0," * 1200 + "10,100,1000,5,1\n")
    put(root, "e/R3_mD_mC.csv", "\ufeff\nFSC-A,B1-A,YG1-A,R2-A,UV7-A\r\n2,20,200,2000,6\r\n\r\n3,,300,3000,7\r\n")
    rows = sorted(csv_tree.scan_samples(spark, root).collect(), key=lambda r: r.fsc_a)
    assert [(r.experiment, r.ha, r.dapi) for r in rows] == [("a+b 50%", 10, 5), ("e", 20, 6), ("e", None, 7)]


def test_no_path_reaches_the_driver(spark, tmp_path, monkeypatch):
    for i in range(30):
        put(str(tmp_path), f"e{i}/R3_pD_mC.csv", "FSC-A,B1-A,YG1-A,R2-A,UV7-A\n1,2,3,4,5\n")
    seen = []
    frame = type(spark.range(1))
    keep = frame.collect
    monkeypatch.setattr(frame, "collect", lambda df: seen.extend(keep(df)) or seen)
    csv_tree.scan_samples(spark, str(tmp_path))
    assert len(seen) == 1 and "__path" not in seen[0].asDict()


def test_two_columns_for_one_channel(spark, tmp_path):
    put(str(tmp_path), "e/R3_pD_mC.csv", "FSC-A,B1-A,B1-A extra,YG1-A,R2-A,UV7-A\n1,2,3,4,5,6\n")
    with pytest.raises(ValueError, match="B1-A"):
        csv_tree.scan_samples(spark, str(tmp_path))


def test_instruments(spark, tmp_path):
    root = str(tmp_path)
    put(root, "TGFB1/3 Laser Experiments/2024-01-02/Luc_0T.csv", "FSC,HA,pSMAD2,SMAD2\n1,10,100,1000\n")
    put(root, "TGFB1/5 Laser Experiments/2024-01-03/R3_3.16T.csv", "FSC-A,B1-A,YG1-A,R2-A,HA\n2,20,200,2000,7\n")
    rows = {r.experiment: r for r in csv_tree.scan_samples(spark, root, "legacy").collect()}
    a, b = rows["2024-01-02"], rows["2024-01-03"]
    assert (a.instrument, a.cell_line, a.ligand, a.ligand_conc, a.ha) == ("3 Laser Experiments", "Luc", "TGFB1", 0.0, 10)
    assert (b.instrument, b.cell_line, b.ligand_conc, b.ha, b.psmad2) == ("5 Laser Experiments", "R3", 3.16, 20, 200)


def test_two_ligand_control_files(spark, tmp_path):
    root = str(tmp_path)
    head = "FSC-A,B1-A,YG1-A,R2-A,UV7-A\n"
    put(root, "e/R3_3.16T_25G.csv", head + "1,10,100,1000,5\n")
    put(root, "e/control minusDox.csv", head + "1,20,200,2000,5\n")
    rows = {r.dox: r for r in csv_tree.scan_samples(spark, root, "two_ligand").collect()}
    assert (rows["+dox"].tgfb1, rows["+dox"].gdf11, rows["+dox"]["sample"]) == (3.16, 25.0, "R3_3.16T_25G")
    m = rows["-dox"]
    assert (m.cell_line, m.tgfb1, m.gdf11, m["sample"], m.ha) == ("R3", 0.0, 0.0, "Minus Dox Control", 20)


def test_land_prunes_partitions(spark, tmp_path):
    root, out = str(tmp_path / "csv"), str(tmp_path / "cells")
    head = "FSC-A,B1-A,YG1-A,R2-A,UV7-A\n"
    for e in ("e1", "e2"):
        put(root, f"{e}/R3_pD_mC.csv", head + "".join(f"1,{i},100,1000,5\n" for i in range(1, 50)))
    csv_tree.land(trim_outliers(csv_tree.load_cells(spark, root)), out)
    df = spark.read.parquet(out).where("experiment = 'e1'").select("ha")
    assert df.count() == 47
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(experiment" in plan and "ReadSchema: struct<ha:double>" in plan


def test_each_line_is_parsed_once_and_names_once_per_file(spark, tmp_path):
    head = "FSC-A,B1-A,YG1-A,R2-A,UV7-A\n"
    for e in ("e1", "e2"):
        put(str(tmp_path), f"{e}/R3_pD_0.1T_2.csv", head + "1,2,3,4,5\n")
    df = csv_tree.load_cells(spark, str(tmp_path))
    assert df.count() == 2
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_csv(") == 1 and "regexp" not in plan
    assert "BroadcastHashJoin" in df._jdf.queryExecution().executedPlan().toString()


def test_first_lines_across_batches():
    import pyarrow as pa

    batches = [pa.record_batch({"p": list(p), "v": list(v)}) for p, v in (("aab", "123"), ("", ""), ("bc", "45"), ("cc", "67"), ("a", "8"))]
    got = [v for b in csv_tree._where_path_changes(iter(batches)) for v in b.column(1).to_pylist()]
    assert got == ["1", "3", "5", "8"]


def test_a_sample_is_not_written_by_every_task(spark, tmp_path):
    cells = spark.range(0, 4000, 1, 16).selectExpr("'e' as experiment", "concat('R3_pD_', id % 20) as sample", "double(id) as ha")
    csv_tree.write_samples(cells, str(tmp_path / "t"), ["experiment"])
    files = [f for _, _, names in os.walk(tmp_path / "t") for f in names if f.endswith(".csv")]
    assert len(files) == 20
    assert spark.read.option("header", True).csv(str(tmp_path / "t")).count() == 4000
