"""Every operator as a query over the driver's tables.

Each function takes (spark, folder) and returns a DataFrame; doubles are rounded
by their size so that results compare across engines.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..functions import (
    complete_rows,
    composite_key,
    dox_label,
    floored_log_channel,
    gate_label,
    legacy_cell_line,
    legacy_conc,
    legacy_ligand,
    ligand_conc,
    ligand_label,
    log_channel,
    name_field,
    replicate_number,
    safe_log10,
    strip_extension,
    suffixed_dose,
)
from ..operators import binning, bootstrap, density, dose, gates, linear_models, matrix, normalize, selection, sketches, stats
from ..session import attach, materialize, shared_folder
from ..sources import csv_tree
from ..sources.tables import cells, landed_table, raw_cells, read_table
from . import analysis as A
from . import summaries

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

N_BOOT = 1000
N_TREE = 200
BLOCK = 256
SEED = 7
MEAN = "mean_norm_psmad2"
INTERVALS = [f"{s}_norm_psmad2{e}" for s in ("mean", "median") for e in ("", "_low", "_high")]

# Looser control quantile than the defaults: the star-schema cells have few high values.
SINGLE = BOOT = replace(A.SINGLE_LIGAND, q_ha=0.1, n_boot=N_BOOT, seed=SEED)
PLAIN = replace(SINGLE, statistic="mean")
GRID = replace(A.TWO_LIGAND, q_ha=0.1, n_boot=N_BOOT, seed=SEED)
LEGACY = replace(A.LEGACY, q_ha=0.1, n_boot=N_BOOT, seed=SEED)


def rounded(df: DataFrame) -> DataFrame:
    """Doubles rounded by size (six digits below 1000), negative zero made plain."""

    def short(c: str) -> str:
        cuts = f"when abs({c}) < 1e3D then round({c}, 6) when abs({c}) < 1e6D then round({c}, 4) when abs({c}) < 1e9D then round({c}, 2)"
        return f"case {cuts} else round({c}, 0) end + 0.0D as {c}"

    return df.selectExpr(*[short(f"`{f.name}`") if isinstance(f.dataType, T.DoubleType) else f"`{f.name}`" for f in df.schema])


def query(fn: Query) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return rounded(fn(spark, folder))

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    QUERIES[fn.__name__] = run
    return fn


# ---------------------------------------------------------------- shared steps


def trimmed(spark: SparkSession, folder: str, *more: str, only: list[str] | None = None) -> DataFrame:
    """Trimmed cells without their number, if it is not asked for; columns ``only``, if others are not read."""
    rows = gates.trim_outliers(cells(spark, folder), S.TRIM_KEYS_GATED)
    rows = rows if only is None else rows.select(*only)
    return materialize(rows if "cell_id" in more else rows.drop("cell_id"))


def gated(spark: SparkSession, folder: str) -> DataFrame:
    return gates.control_gate(trimmed(spark, folder), q_ha=0.1)


def single(spark: SparkSession, folder: str) -> DataFrame:
    """Bootstrapped and renumbered bins of the single-ligand analysis."""
    boot = A.analyse(trimmed(spark, folder, only=A.summarised_columns(SINGLE)), SINGLE).boot
    return materialize(boot).withColumn(
        "exp_rep", composite_key(F.col("experiment"), F.col("replicate"))
    )


def plus(spark: SparkSession, folder: str) -> DataFrame:
    return single(spark, folder).where(F.col("dox") == S.PLUS_DOX)


def tgf_by_dose(spark: SparkSession, folder: str) -> DataFrame:
    """Induced TGFB1 rows, one per unit, dose and bin."""
    return plus(spark, folder).where(F.col("ligand") == "TGFB1")


def tgf_diffs(spark: SparkSession, folder: str) -> DataFrame:
    rows = tgf_by_dose(spark, folder).where(F.col("replicate") == 1)
    diffs = dose.forward_differences(rows, ["exp_rep", "ligand_conc"], MEAN)
    return gates.min_group_distinct(diffs, ["exp_rep"], "ligand_conc", 3)


def grid_cells(spark: SparkSession, folder: str, *more: str) -> DataFrame:
    rows = gates.trim_outliers(cells(spark, folder), S.TRIM_KEYS_TWO_LIGAND)
    return materialize(rows if "cell_id" in more else rows.drop("cell_id"))


def heat_map(spark: SparkSession, folder: str) -> DataFrame:
    """Dose grid per experiment and bin with the min-max scaled signal."""
    boot = materialize(A.analyse(grid_cells(spark, folder), GRID).boot)
    return normalize.min_max_scale(boot, ["experiment"], MEAN)


def steps(spark: SparkSession, folder: str) -> DataFrame:
    return dose.metric_steps(dose.rls_lic(heat_map(spark, folder)))


def counts_by(df: DataFrame, keys: list[str], *columns: str) -> DataFrame:
    """Number of rows and sum, min and max of each column: a compact view of a row set."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for c in columns:
        aggs += [F.sum(c).alias(f"sum_{c}"), F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}")]
    return df.groupBy(*keys).agg(*aggs)


# ------------------------------------------------------------- names and fields


def sample_names(spark: SparkSession, folder: str) -> DataFrame:
    """File names with every kind of field, well-formed or not, from line item keys."""
    li = read_table(spark, folder, "lineitem")
    dox = F.array(*[F.lit(v) for v in ("pD", "mD", "xx")])
    lig = F.array(*[F.lit(v) for v in ("mC", "0.1T", "2.5G", "zz", "1..2T")])
    rep = F.array(*[F.lit(v) for v in ("1", "rep2", "DAPI", "12")])
    return li.select(
        F.concat(
            F.concat_ws(
                "_",
                F.when(F.col("l_linenumber") <= 5, "R3").otherwise("Luc"),
                F.get(dox, (F.col("l_orderkey") % 3).cast("int")),
                F.get(lig, (F.col("l_partkey") % 5).cast("int")),
                F.when(F.col("l_suppkey") % 5 < 4, F.get(rep, (F.col("l_suppkey") % 5).cast("int"))),
                F.when(F.col("l_suppkey") % 7 == 0, "DAPI"),
            ),
            F.lit(".csv"),
        ).alias("file_name")
    )


def parsed(spark: SparkSession, folder: str, **columns) -> DataFrame:
    name = strip_extension(F.col("file_name"))
    out = sample_names(spark, folder).select(
        "file_name", *[make(name).alias(c) for c, make in columns.items()]
    )
    return out.groupBy(*out.columns).agg(F.count(F.lit(1)).alias("n"))


@query
def strip_file_extension(spark, folder):
    return parsed(spark, folder, sample=lambda n: n)


@query
def gate_labels(spark, folder):
    return parsed(spark, folder, gate=gate_label)


@query
def split_name_fields(spark, folder):
    return parsed(
        spark, folder, **{f"field_{i}": (lambda n, i=i: name_field(n, i)) for i in range(4)}
    )


@query
def dox_labels(spark, folder):
    return parsed(spark, folder, dox=lambda n: dox_label(name_field(n, 1)))


@query
def ligand_concentrations(spark, folder):
    return parsed(spark, folder, ligand_conc=lambda n: ligand_conc(name_field(n, 2)))


@query
def ligand_labels(spark, folder):
    return parsed(spark, folder, ligand=lambda n: ligand_label(name_field(n, 2)))


@query
def replicate_numbers(spark, folder):
    return parsed(spark, folder, replicate=lambda n: replicate_number(name_field(n, 3)))


@query
def legacy_name_fields(spark, folder):
    raw = raw_cells(spark, folder)
    out = raw.select(_NAME["legacy"]().alias("sample")).select(
        "sample",
        legacy_cell_line(F.col("sample")).alias("cell_line"),
        legacy_ligand(F.col("sample")).alias("ligand"),
        legacy_conc(F.col("sample")).alias("ligand_conc"),
    )
    return out.groupBy(*out.columns).agg(F.count(F.lit(1)).alias("n"))


@query
def two_ligand_name_fields(spark, folder):
    raw = raw_cells(spark, folder)
    name = F.concat_ws(
        "_",
        "cell_line",
        F.concat(F.col("tgfb1").cast("string"), F.lit("T")),
        F.concat(F.col("gdf11").cast("string"), F.lit("G")),
    )
    out = raw.select(name.alias("sample")).select(
        "sample",
        suffixed_dose(name_field(F.col("sample"), 1), "T").alias("tgfb1"),
        suffixed_dose(name_field(F.col("sample"), 2), "G").alias("gdf11"),
    )
    return out.groupBy(*out.columns).agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------ scans and results

_NAME = {
    "single": lambda: F.concat_ws(
        "_",
        "cell_line",
        F.when(F.col("dox") == "+dox", "pD").otherwise("mD"),
        F.when(F.col("ligand") == "No Cyto", "mC").otherwise(
            F.concat(F.col("ligand_conc").cast("string"), F.substring("ligand", 1, 1))
        ),
        F.col("replicate").cast("string"),
        F.when(F.col("gate") == "DAPI", "DAPI"),
    ),
    "no_ligand": lambda: F.concat_ws(
        "_",
        "cell_line",
        F.when(F.col("dox") == "+dox", "pD").otherwise("mD"),
        F.lit("mC"),
        F.col("replicate").cast("string"),
    ),
    "legacy": lambda: F.concat(
        F.col("cell_line"), F.lit("_"), F.col("ligand_conc").cast("string"),
        F.when(F.col("ligand") == "GDF11", "G").otherwise("T"),
    ),
    "two": lambda: F.when(F.col("dox") == "-dox", "minusDox").otherwise(
        F.concat(
            F.col("cell_line"), F.lit("_"), F.col("tgfb1").cast("string"), F.lit("T_"),
            F.col("gdf11").cast("string"), F.lit("G"),
        )
    ),
    "two_replicate": lambda: F.concat(
        F.col("cell_line"), F.lit("_"), F.col("tgfb1").cast("string"), F.lit("T_"),
        F.col("gdf11").cast("string"), F.lit("G_"), F.col("replicate").cast("string"),
    ),
}


def _fresh(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/{what}/{uuid.uuid4().hex}"


def _write_tree(df: DataFrame, root: str, name: str, folders: list[str], columns: dict[str, str]) -> None:
    """Raw cells as per-sample CSV folders, with export column names in the given order."""
    csv_tree.write_samples(
        df.select(
            *folders,
            _NAME[name]().alias("sample"),
            *[F.col(c).alias(out) for out, c in columns.items()],
        ),
        root,
        folders,
    )


FIVE = {"FSC-A": "ha", "B1-A": "ha", "YG1-A": "psmad2", "R2-A": "smad2", "UV7-A": "dapi"}
FIVE_OTHER_ORDER = {"UV7-A": "dapi", "R2-A": "smad2", "B1-A": "ha", "YG1-A": "psmad2", "FSC-A": "ha"}
OLD = {"FSC-A": "ha", "HA": "ha", "pSMAD2": "psmad2", "SMAD2": "smad2"}


@query
def scan_sample_folder(spark, folder):
    """One folder of samples; gated samples were exported with another column order."""
    raw, root = raw_cells(spark, folder).withColumn("experiment", F.lit("all")), _fresh(spark, "csv")
    _write_tree(raw.where(F.col("gate") == "DAPI"), f"{root}/a", "single", ["experiment"], FIVE_OTHER_ORDER)
    _write_tree(raw.where(F.col("gate") != "DAPI"), f"{root}/b", "single", ["experiment"], FIVE)
    got = csv_tree.scan_samples(spark, root, "single_ligand")
    return counts_by(
        got,
        ["sample", "experiment", "cell_line", "dox", "ligand", "ligand_conc", "replicate", "gate"],
        "fsc_a", "ha", "psmad2", "smad2", "dapi",
    )


@query
def scan_experiment_tree(spark, folder):
    """A folder per experiment, loaded, logged and complete."""
    root = _fresh(spark, "csv")
    _write_tree(raw_cells(spark, folder), root, "single", ["experiment"], FIVE)
    got = csv_tree.load_cells(spark, root, "single_ligand")
    return counts_by(
        got, ["experiment", "cell_line", "dox", "ligand", "ligand_conc", "replicate", "gate"],
        "ha", "psmad2", "smad2", "dapi", "norm_psmad2",
    )


@query
def scan_by_instrument(spark, folder):
    """Two instruments with their own channel names below one root."""
    raw = raw_cells(spark, folder).withColumn(
        "instrument", F.when(F.col("experiment") % 2 == 1, "3 Laser Experiments").otherwise("5 Laser Experiments")
    )
    root = _fresh(spark, "csv")
    three = F.col("instrument").startswith("3")
    folders = ["instrument", "experiment"]
    _write_tree(raw.where(three), f"{root}/t", "legacy", folders, OLD)
    _write_tree(raw.where(~three), f"{root}/f", "legacy", folders, FIVE)
    got = csv_tree.scan_samples(spark, root, "legacy")
    return counts_by(
        got, ["instrument", "experiment", "cell_line", "ligand", "ligand_conc"], "ha", "psmad2", "smad2"
    )


def _two_ligand_scan(spark, folder, layout, name, columns, keys, *measures):
    root = _fresh(spark, "csv")
    _write_tree(raw_cells(spark, folder), root, name, ["experiment"], columns)
    return counts_by(csv_tree.scan_samples(spark, root, layout), ["experiment", *keys], *measures)


@query
def scan_two_ligand_tree(spark, folder):
    return _two_ligand_scan(
        spark, folder, "two_ligand", "two", FIVE,
        ["sample", "cell_line", "dox", "tgfb1", "gdf11"], "ha", "psmad2", "smad2", "dapi",
    )


@query
def scan_old_two_ligand_tree(spark, folder):
    return _two_ligand_scan(
        spark, folder, "two_ligand_old", "two", OLD,
        ["sample", "cell_line", "dox", "tgfb1", "gdf11"], "ha", "psmad2", "smad2",
    )


@query
def scan_two_ligand_replicates(spark, folder):
    return _two_ligand_scan(
        spark, folder, "two_ligand_replicate", "two_replicate", FIVE,
        ["sample", "cell_line", "tgfb1", "gdf11", "replicate"], "ha", "psmad2", "smad2", "dapi",
    )


@query
def channel_selection(spark, folder):
    """Keys, scatter and the mapped channels only, renamed by column-name prefix."""
    raw = raw_cells(spark, folder).select(
        "experiment", *[F.col(c).alias(f"{out} :: Area") for out, c in FIVE.items()], F.col("dapi").alias("Time")
    )
    picked = csv_tree.pick_channels(raw.columns, S.FIVE_LASER)
    got = raw.select("experiment", *[F.col(f"`{c}`").alias(n) for c, n in picked.items() if "FSC" not in c])
    return counts_by(got, ["experiment"], "ha", "psmad2", "smad2", "dapi")


@query
def csv_result_round_trip(spark, folder):
    """Range table written as CSV and read back with stated types."""
    out = dose.dose_range(plus(spark, folder), ["experiment", "replicate", "ligand", "ligand_conc"])
    path = _fresh(spark, "results")
    csv_tree.write_result(out, path)
    return csv_tree.read_result(spark, path, out.schema)


# --------------------------------------------------------- channels and filters


@query
def log_channels(spark, folder):
    """Zero and negative values leave; the fixture shifts quantities to get some."""
    raw = raw_cells(spark, folder).withColumn("shifted", F.col("psmad2") - 3)
    out = raw.withColumn("logged", log_channel(F.col("shifted"))).withColumn(
        "as_inf", log_channel(F.col("shifted"), "neg_inf").isNotNull().cast("int")
    )
    return out.groupBy("experiment").agg(
        F.count("logged").alias("n_logged"), F.sum("as_inf").alias("n_with_zero"), F.sum("logged").alias("total")
    )


@query
def floored_log(spark, folder):
    raw = raw_cells(spark, folder).withColumn("logged", floored_log_channel(F.col("psmad2") - 3))
    return counts_by(raw, ["experiment"], "logged")


@query
def drop_incomplete_rows(spark, folder):
    raw = raw_cells(spark, folder).withColumn("psmad2", F.when(F.col("psmad2") > 5, F.col("psmad2")))
    return counts_by(complete_rows(raw), ["experiment", "cell_line"], "psmad2")


@query
def signal_ratio(spark, folder):
    return counts_by(cells(spark, folder), ["experiment", "ligand", "ligand_conc"], "norm_psmad2")


@query
def composite_keys(spark, folder):
    keyed = cells(spark, folder).select(
        composite_key(F.col("experiment"), F.col("replicate")).alias("exp_rep"),
        composite_key(
            F.col("experiment"), F.col("replicate"), F.lit("TGFB1 = "), F.col("ligand_conc").cast("string"), F.lit("ng/ml")
        ).alias("exp_rep_lig"),
    )
    return keyed.groupBy("exp_rep", "exp_rep_lig").agg(F.count(F.lit(1)).alias("n"))


@query
def dose_order(spark, folder):
    """Dose text with an explicit rank, ascending and descending."""
    doses = cells(spark, folder).groupBy("tgfb1").agg(F.count(F.lit(1)).alias("n"))
    return doses.select(
        F.col("tgfb1").cast("string").alias("dose"),
        F.col("tgfb1").cast("string").try_cast("double").alias("tgfb1"),
        F.row_number().over(Window.orderBy("tgfb1")).alias("place"),
        F.row_number().over(Window.orderBy(F.desc("tgfb1"))).alias("place_reversed"),
        "n",
    )


@query
def column_pruning(spark, folder):
    kept = cells(spark, folder).select("experiment", "replicate", "dox", "norm_psmad2").drop("dox")
    return counts_by(kept, ["experiment", "replicate"], "norm_psmad2")


@query
def log_of_results(spark, folder):
    ranges = dose.dose_range(plus(spark, folder), ["experiment", "replicate", "ligand", "ligand_conc"])
    return ranges.select(
        "experiment", "replicate", "ligand", "ligand_conc",
        safe_log10(F.col("range")).alias("log_range"),
        safe_log10(F.col("ligand_conc")).alias("log_dose"),
    )


@query
def trim_outliers(spark, folder):
    return counts_by(trimmed(spark, folder), S.TRIM_KEYS_GATED, "psmad2", "ha")


@query
def trim_without_dose(spark, folder):
    t = gates.trim_outliers(cells(spark, folder), S.TRIM_KEYS_NO_LIGAND)
    return counts_by(t, S.TRIM_KEYS_NO_LIGAND, "psmad2", "ha")


@query
def trim_dose_grid(spark, folder):
    return counts_by(grid_cells(spark, folder), S.TRIM_KEYS_TWO_LIGAND, "psmad2", "ha")


@query
def trim_linear_channels(spark, folder):
    t = gates.trim_outliers(raw_cells(spark, folder), S.TRIM_KEYS)
    return counts_by(t, S.TRIM_KEYS, "psmad2", "ha")


@query
def gate_on_untreated(spark, folder):
    return counts_by(gated(spark, folder), ["experiment", "ligand", "ligand_conc", "dox"], "norm_psmad2", "ha")


@query
def gate_on_uninduced(spark, folder):
    g = gates.control_gate(grid_cells(spark, folder), gates.control_uninduced(), 0.0, 0.1).where(
        F.col("dox") == S.PLUS_DOX
    )
    return counts_by(g, ["experiment", "tgfb1", "gdf11"], "norm_psmad2", "ha")


@query
def gate_on_luc(spark, folder):
    """Control cell line at dose 0, per experiment and replicate."""
    g = gates.control_gate(trimmed(spark, folder), gates.control_luc(), 0.25, 0.1, ["experiment", "replicate"])
    return counts_by(g, ["experiment", "replicate", "ligand", "ligand_conc"], "norm_psmad2", "ha")


@query
def gate_on_raw_signal(spark, folder):
    g = gates.control_gate(trimmed(spark, folder), gates.control_luc(), 0.5, 0.1, signal="psmad2")
    return counts_by(g, ["experiment", "ligand", "ligand_conc"], "psmad2", "ha")


@query
def thresholds_on_rows(spark, folder):
    g = gates.control_gate(trimmed(spark, folder), q_ha=0.1, keep_thresholds=True)
    return g.groupBy("experiment", "signal_threshold", "ha_threshold").agg(F.count(F.lit(1)).alias("n"))


@query
def groups_without_control(spark, folder):
    """Doses that never occur uninduced without ligand, per experiment."""
    return gates.groups_without_control(
        trimmed(spark, folder), gates.control_untreated(), ["experiment", "ligand_conc"]
    )


@query
def band_per_experiment(spark, folder):
    rows = trimmed(spark, folder).where((F.col("dox") == S.PLUS_DOX) & (F.col("ligand") != "GDF11"))
    return counts_by(gates.percentile_band(rows, ["experiment"]), ["experiment", "ligand_conc"], "dapi", "norm_psmad2")


@query
def band_per_dose(spark, folder):
    b = gates.percentile_band(trimmed(spark, folder), ["experiment", "ligand_conc"], high=0.75)
    return counts_by(b, ["experiment", "ligand_conc"], "dapi", "norm_psmad2")


@query
def plain_predicates(spark, folder):
    rows = single(spark, folder).where(
        (F.col("dox") == S.PLUS_DOX)
        & ~F.col("ligand").contains("GDF11")
        & F.col("ligand_conc").isin(0.0, 1.0)
        & F.col("bin_id").isin(1, 5, 10)
    )
    return rows.select("experiment", "replicate", "ligand_conc", "bin_id", MEAN)


@query
def groups_with_enough_rows(spark, folder):
    ranges = dose.dose_range(plus(spark, folder), ["experiment", "replicate", "ligand", "ligand_conc"])
    return gates.min_group_rows(ranges, ["experiment", "replicate", "ligand"], 3)


@query
def groups_with_enough_doses(spark, folder):
    kept = gates.min_group_distinct(plus(spark, folder), ["exp_rep", "ligand"], "ligand_conc", 3)
    return kept.groupBy("exp_rep", "ligand").agg(F.count(F.lit(1)).alias("n"))


@query
def thin_bins_removed(spark, folder):
    kept = gates.min_cells(single(spark, folder), 30)
    numbered = binning.renumber_bins(kept, list(SINGLE.number_keys))
    return numbered.select(*SINGLE.summary_keys, "bin_id", "n_cells", MEAN)


@query
def dose_grid_edge(spark, folder):
    edge = gates.grid_edge(heat_map(spark, folder))
    return edge.select("experiment", "tgfb1", "gdf11", "cell_line", "bin_id", "new_norm_psmad2")


@query
def cells_outside_bins(spark, folder):
    """Log-spaced bins leave cells unbinned; those drop out of the summary."""
    b = _log_binned(spark, folder)
    return b.where(F.col("bin_id").isNotNull()).groupBy("experiment").agg(
        F.count(F.lit(1)).alias("n"), F.min("bin_id").alias("lowest"), F.max("bin_id").alias("highest")
    )


@query
def odd_bins(spark, folder):
    return dose.odd_bins(dose.rls_lic(heat_map(spark, folder)))


@query
def even_bins(spark, folder):
    return dose.even_bins(dose.rls_lic(heat_map(spark, folder)))


@query
def first_seven_bins(spark, folder):
    return dose.rls_lic(heat_map(spark, folder)).where(F.col("bin_id") < 8)


# ---------------------------------------------------------------------- joins


@query
def dose_panels(spark, folder):
    rows = plus(spark, folder).where(~F.col("ligand").contains("GDF11"))
    return dose.dose_panels(rows).select("panel_dose", "exp_rep", "ligand_conc", "bin_id", MEAN)


@query
def edge_lookup(spark, folder):
    return dose.outer_edge(heat_map(spark, folder)).select(
        "experiment", "edge_idx", "tgfb1", "gdf11", "bin_id", "new_norm_psmad2"
    )


# ---------------------------------------------------------------- aggregations


@query
def exact_quantiles(spark, folder):
    """Quantiles of every event type's values."""
    return selection.quantiles(
        read_table(spark, folder, "events"),
        ["event_type"],
        {"q025": ("value", 0.025), "q250": ("value", 0.25), "q500": ("value", 0.5), "q975": ("value", 0.975)},
    )


@query
def bin_ranges(spark, folder):
    return binning.bin_ranges(gated(spark, folder), list(SINGLE.bin_keys))


@query
def bin_summary(spark, folder):
    binned = binning.equal_width_bins(gated(spark, folder))
    return binning.bin_summary(binned)


@query
def grid_bin_means(spark, folder):
    binned = binning.equal_width_bins(grid_cells(spark, folder), 10, [])
    return binning.bin_means(binned, ["experiment", "tgfb1", "gdf11"])


@query
def bootstrap_intervals(spark, folder):
    binned = binning.equal_width_bins(gated(spark, folder))
    return bootstrap.bootstrap_bins(binned, S.SUMMARY_KEYS, n_boot=N_BOOT, seed=SEED)


@query
def bootstrap_event_values(spark, folder):
    """Bootstrap of event values per type in equal-width value bins (bins of thousands)."""
    ev = read_table(spark, folder, "events")
    binned = binning.equal_width_bins(ev, 4, ["event_type"], "value")
    return bootstrap.bootstrap_bins(binned, ["event_type"], "value", n_boot=N_BOOT, seed=SEED)


@query
def bootstrap_block_tree(spark, folder):
    """The same bins with blocks and slices so small that draws pass through the tree and meet several slices."""
    events = read_table(spark, folder, "events")
    binned = binning.equal_width_bins(events, 2, ["event_type"], "value")
    return bootstrap.bootstrap_bins(binned, ["event_type"], "value", N_TREE, SEED, slice_cells=1024, block_cells=BLOCK)


@query
def bootstrap_poisson(spark, folder):
    """Event values by Poisson weights of the events."""
    events = read_table(spark, folder, "events")
    binned = binning.equal_width_bins(events, 4, ["event_type"], "value")
    return bootstrap.bootstrap_bins(binned, ["event_type"], "value", N_TREE, SEED, mode="poisson", row_id="event_id")


@query
def sketched_quantiles(spark, folder):
    """Quantiles of event values from one stored table of sketches: per user, and merged per type and day of the month."""
    events = read_table(spark, folder, "events").withColumn("day", F.dayofmonth("ts"))
    wanted = {"low": ("value", 0.05), "middle": ("value", 0.5), "high": ("value", 0.95)}
    table = materialize(sketches.sketch_table(events, ["event_type", "day", "user_id"], ["value"], 60_000))
    of_type = sketches.merge_sketches(table, keys=["event_type", "day"])
    return sketches.sketch_quantiles(of_type, ["event_type", "day"], wanted)


@query
def trim_by_sketches(spark, folder):
    """The outlier trim with limits from sketches; these groups are small enough to be exact."""
    kept = gates.trim_outliers(cells(spark, folder), S.TRIM_KEYS_GATED, low=0.05, high=0.95, accuracy=60_000)
    return counts_by(kept, ["experiment", "gate"], "ha", "psmad2")


@query
def dynamic_range_per_dose(spark, folder):
    """The exported range table: at least three doses, scaled by the largest range."""
    rows = tgf_by_dose(spark, folder).where((F.col("replicate") == 1) & (F.col("ligand_conc") >= 0.1))
    ranges = dose.dose_range(rows, ["experiment", "replicate", "ligand", "ligand_conc"])
    kept = gates.min_group_rows(ranges, ["experiment", "replicate", "ligand"], 3)
    return normalize.scale_by_max(kept, ["experiment", "replicate", "ligand"], "range", "norm_range")


@query
def rls_lic(spark, folder):
    return dose.rls_lic(heat_map(spark, folder))


@query
def rls_lic_averaged_edge(spark, folder):
    return dose.rls_lic(heat_map(spark, folder), averaged_edge=True)


@query
def range_and_end_change(spark, folder):
    return dose.range_and_change(heat_map(spark, folder), ["experiment", "tgfb1", "gdf11"])


@query
def spread_over_second_dose(spark, folder):
    return dose.spread_over_dose(heat_map(spark, folder), ["experiment", "tgfb1", "bin_id"], MEAN, "diff_gdf11")


@query
def edge_mean_and_sd(spark, folder):
    return dose.edge_summary(dose.outer_edge(heat_map(spark, folder)))


@query
def linear_fits(spark, folder):
    fits = stats.linear_fits(tgf_by_dose(spark, folder), ["exp_rep", "ligand_conc"])
    return gates.min_group_rows(fits, ["exp_rep"], 3)


@query
def linear_fits_late_bins(spark, folder):
    rows = tgf_by_dose(spark, folder).where(F.col("bin_id") >= 3)
    fits = stats.linear_fits(rows, ["exp_rep", "ligand_conc"])
    return gates.min_group_rows(fits, ["exp_rep"], 3)


@query
def dose_anova_pooled(spark, folder):
    return stats.one_covariate_anova(tgf_diffs(spark, folder), [], "diffs", F.log10("ligand_conc"))


@query
def dose_anova_per_experiment(spark, folder):
    return stats.one_covariate_anova(tgf_diffs(spark, folder), ["exp_rep"], "diffs", F.log10("ligand_conc"))


@query
def two_way_anova(spark, folder):
    return stats.two_way_anova(steps(spark, folder))


@query
def range_ancova(spark, folder):
    rows = tgf_by_dose(spark, folder).where(F.col("replicate") == 1)
    ranges = dose.dose_range(rows, ["experiment", "replicate", "ligand", "ligand_conc"])
    return stats.ancova(ranges)


@query
def two_way_anova_by_gram(spark, folder):
    """The same model from merged cross products."""
    terms = [("experiment",), ("group_id",), ("experiment", "group_id")]
    return linear_models.anova(steps(spark, folder), "eucl_diff", terms, ["experiment", "group_id"])


@query
def range_ancova_by_gram(spark, folder):
    rows = tgf_by_dose(spark, folder).where(F.col("replicate") == 1)
    ranges = dose.dose_range(rows, ["experiment", "replicate", "ligand", "ligand_conc"])
    terms, covariates = [("experiment",), ("covariate",)], {"covariate": F.log10("ligand_conc")}
    return linear_models.anova(ranges, "range", terms, ["experiment"], covariates, adjusted=True)


@query
def rank_sum_test(spark, folder):
    return stats.rank_sum_test(steps(spark, folder), ["experiment"])


@query
def rank_sum_of_cells(spark, folder):
    """Rank-sum of the whole gated signal, induced against not, per experiment (normal tail)."""
    rows = gated(spark, folder)
    return stats.rank_sum_test(rows, ["experiment"], "norm_psmad2", "dox", S.PLUS_DOX, S.MINUS_DOX)


@query
def lowest_gated_value(spark, folder):
    return dose.lowest_per_group(gated(spark, folder), ["experiment"])


@query
def histogram(spark, folder):
    return density.histogram(trimmed(spark, folder), "dapi", ["cell_line", "dox"])


@query
def histogram_of_bin_sizes(spark, folder):
    sizes = single(spark, folder).withColumn("log_n", F.log10(F.col("n_cells").cast("double")))
    return density.histogram(sizes, "log_n", [])


@query
def histogram_2d(spark, folder):
    return density.histogram_2d(trimmed(spark, folder), "ha", "norm_psmad2", ["cell_line", "ligand_conc"])


@query
def histogram_2d_per_sample(spark, folder):
    return density.histogram_2d(trimmed(spark, folder), "ha", "psmad2", ["experiment", "dox"], 100)


@query
def violin_density(spark, folder):
    return density.violin_density(tgf_diffs(spark, folder), ["ligand_conc"], "diffs")


@query
def violin_density_fine(spark, folder):
    return density.violin_density(tgf_diffs(spark, folder), ["ligand_conc"], "diffs", points=8192)


@query
def distinct_units(spark, folder):
    return single(spark, folder).select("exp_rep", "ligand_conc").distinct()


@query
def profile_distances(spark, folder):
    rows = plus(spark, folder).where(F.col("ligand_conc") == 0)
    return matrix.row_distances(rows)


# -------------------------------------------------------------- windows and bins


@query
def renumbered_bins(spark, folder):
    boot = A.analyse(trimmed(spark, folder), PLAIN).boot
    return boot.select(*SINGLE.summary_keys, "bin_id", "bin_lo", "bin_hi", "n_cells")


@query
def equal_count_bins(spark, folder):
    ev = landed_table(spark, folder, "events", ["event_type", "value", "event_id"])
    b = binning.equal_count_bins(ev, 10, ["event_type"], "value", "event_id")
    return b.groupBy("event_type", "bin_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("value").alias("lowest"), F.max("value").alias("highest"),
        F.sum("event_id").alias("sum_id"),
    )


@query
def equal_width_bins(spark, folder):
    b = binning.equal_width_bins(gated(spark, folder))
    return counts_by(b, [*SINGLE.bin_keys, "bin_id", "bin_lo", "bin_hi"], "ha")


@query
def equal_width_bins_overall(spark, folder):
    b = binning.equal_width_bins(grid_cells(spark, folder), 10, [])
    return counts_by(b, ["experiment", "bin_id", "bin_lo", "bin_hi"], "ha")


@query
def equal_width_bins_per_sample(spark, folder):
    """Twenty bins per sample, as for the runs without ligand."""
    rows = gated(spark, folder).withColumn("sample", F.concat_ws("_", "cell_line", "dox", "replicate", "gate"))
    b = binning.equal_width_bins(rows, 20, S.BIN_KEYS_NO_LIGAND)
    return counts_by(b, [*S.BIN_KEYS_NO_LIGAND, "bin_id"], "ha")


def _log_binned(spark, folder):
    raw = gates.trim_outliers(raw_cells(spark, folder), S.TRIM_KEYS)
    limits = gates.gate_thresholds(raw, gates.control_luc(), 0.5, 0.5, [], "psmad2")
    top = raw.agg(F.max("ha").alias("top"))
    rows = attach(attach(raw.where(F.col("cell_line") == "R3"), limits, []), top, [])
    rows = rows.where(F.col("psmad2") > F.col("signal_threshold"))
    return binning.log_spaced_bins(rows, F.col("ha_threshold"), F.col("top"), 5)


@query
def log_spaced_bins(spark, folder):
    b = _log_binned(spark, folder).where(F.col("bin_id").isNotNull())
    return binning.bin_summary(b, ["cell_line", "ligand_conc"], "psmad2")


@query
def forward_differences(spark, folder):
    return tgf_diffs(spark, folder).select(
        "experiment", "ligand", "ligand_conc", "bin_id", "diff_id", MEAN, "diffs"
    )


@query
def metric_steps(spark, folder):
    return steps(spark, folder).select(
        "experiment", "bin_id", "diff_rls", "diff_lic", "diff_id", "eucl_diff", "theta", "group_id"
    )


@query
def min_max_scaled(spark, folder):
    return heat_map(spark, folder).select("experiment", "tgfb1", "gdf11", "cell_line", "dox", "bin_id", "new_norm_psmad2")


@query
def min_max_scaled_median_inner_grid(spark, folder):
    boot = A.analyse(grid_cells(spark, folder), GRID).boot.where((F.col("tgfb1") > 0) & (F.col("gdf11") > 0))
    out = normalize.min_max_scale(boot, ["experiment"], "median_norm_psmad2")
    return out.select("experiment", "tgfb1", "gdf11", "bin_id", "new_norm_psmad2")


def _anchored_rows(spark, folder):
    keys = ("experiment", "replicate", "ligand_conc")
    s = replace(BOOT, bin_keys=keys, summary_keys=(*keys, "cell_line", "dox"), only_dox=S.PLUS_DOX,
                number_keys=(*keys, "dox"))
    return A.analyse(trimmed(spark, folder), s).boot


@query
def control_anchored_scale(spark, folder):
    rows = _anchored_rows(spark, folder)
    out = normalize.control_anchored_scale(rows, ["experiment", "replicate"], "mean")
    out = normalize.control_anchored_scale(out, ["experiment", "replicate"], "median")
    return out.select(
        "experiment", "replicate", "ligand_conc", "bin_id", "control_mean", "norm_mean", "norm_mean_low",
        "norm_mean_high", "norm_median", "norm_median_low", "norm_median_high",
    )


@query
def mean_centred_profiles(spark, folder):
    rows = plus(spark, folder).where(F.col("ligand_conc") == 0)
    out = normalize.mean_centre(rows, ["exp_rep"], MEAN, "centred")
    return out.select("exp_rep", "bin_id", "centred")


@query
def z_scored_profiles(spark, folder):
    rows = single(spark, folder)
    out = normalize.z_score(rows, ["exp_rep"], MEAN, "z_score")
    out = normalize.mean_centre(out, ["exp_rep"], MEAN, "centred")
    return out.select("exp_rep", "ligand", "ligand_conc", "dox", "bin_id", "z_score", "centred")


@query
def z_scored_diffs(spark, folder):
    out = normalize.z_score(tgf_diffs(spark, folder), ["exp_rep", "ligand_conc"], "diffs", "z_score_diffs")
    out = normalize.mean_centre(out, ["exp_rep", "ligand_conc"], "diffs", "norm_diffs")
    return out.select("exp_rep", "ligand_conc", "bin_id", "z_score_diffs", "norm_diffs")


@query
def row_scaled_matrix(spark, folder):
    rows = plus(spark, folder).where(F.col("ligand_conc") == 0)
    inner = normalize.z_score(normalize.inner_bins(rows), ["exp_rep"], MEAN, "z")
    return matrix.wide_profiles(inner, value="z", columns=list(range(2, 10)))


@query
def scaled_by_largest_range(spark, folder):
    rows = plus(spark, folder).where((F.col("ligand") != "TGFB1") & (F.col("ligand_conc") > 0))
    ranges = dose.dose_range(rows, ["experiment", "replicate", "ligand", "ligand_conc"])
    return normalize.scale_by_max(ranges, ["experiment"], "range", "norm_range")


@query
def qq_points(spark, folder):
    return stats.qq_points(tgf_diffs(spark, folder), ["exp_rep", "ligand_conc"], "diffs")


@query
def qq_line(spark, folder):
    return stats.qq_line(tgf_diffs(spark, folder), ["exp_rep", "ligand_conc"], "diffs")


# ------------------------------------------------------ sorting, stacking, shape


@query
def sorted_edge(spark, folder):
    edge = dose.outer_edge(heat_map(spark, folder)).select("experiment", "edge_idx", "bin_id", "new_norm_psmad2")
    return dose.ordered(edge, "experiment", "edge_idx", "bin_id")


@query
def all_but_last_bin(spark, folder):
    rows = dose.forward_differences(plus(spark, folder), ["exp_rep", "ligand", "ligand_conc"], MEAN)
    return rows.groupBy("exp_rep", "ligand", "ligand_conc").agg(
        F.count(F.lit(1)).alias("n"), F.max("bin_id").alias("last_bin"), F.sum("diffs").alias("total")
    )


@query
def range_preview(spark, folder):
    """First six rows of the range table."""
    ranges = dose.dose_range(tgf_by_dose(spark, folder), ["experiment", "replicate", "ligand", "ligand_conc"])
    return ranges.orderBy("experiment", "replicate", "ligand", "ligand_conc").limit(6)


@query
def stacked_gates(spark, folder):
    """The two gates analysed apart and stacked by name."""
    rows = trimmed(spark, folder)
    parts = []
    for name in ("DAPI", "Singlet"):
        one = rows.where(F.col("gate") == name)
        parts.append((name, A.analyse(one, SINGLE.with_keys("gate")).boot))
    out = A.stack(*parts)
    return out.select("gate", *SINGLE.summary_keys, "bin_id", MEAN, "n_cells")


@query
def wide_profiles(spark, folder):
    rows = plus(spark, folder).where(F.col("ligand_conc") == 0)
    return matrix.wide_profiles(rows, columns=list(range(1, 11)))


@query
def wide_profiles_of_20_bins(spark, folder):
    boot = A.analyse(trimmed(spark, folder), replace(SINGLE, n_bins=20)).boot
    rows = boot.where((F.col("dox") == S.PLUS_DOX) & (F.col("ligand_conc") == 0))
    rows = rows.withColumn("exp_rep", composite_key(F.col("experiment"), F.col("replicate")))
    return matrix.wide_profiles(rows, columns=list(range(1, 21)))


# ------------------------------------------------------------------ full analyses


@query
def single_ligand_analysis(spark, folder):
    boot = A.analyse(trimmed(spark, folder), BOOT).boot
    return boot


@query
def decile_analysis(spark, folder):
    boot = A.analyse(trimmed(spark, folder, "cell_id"), replace(BOOT, binning="equal_count")).boot
    return boot.select(*BOOT.summary_keys, "bin_id", *INTERVALS, "n_cells")


@query
def two_ligand_analysis(spark, folder):
    return A.analyse(grid_cells(spark, folder), GRID).boot


@query
def two_ligand_decile_analysis(spark, folder):
    s = replace(A.TWO_LIGAND_DECILES, q_ha=0.1, n_boot=N_BOOT, seed=SEED)
    boot = A.analyse(grid_cells(spark, folder, "cell_id"), s).boot
    return boot.select(*s.summary_keys, "bin_id", *INTERVALS, "n_cells")


@query
def one_experiment_analysis(spark, folder):
    """Bins over all conditions of an experiment, for every experiment."""
    s = replace(PLAIN, n_bins=5, bin_keys=("experiment",))
    return A.analyse_experiment(trimmed(spark, folder), s)["bin_summary"]


@query
def one_experiment_bootstrap(spark, folder):
    s = replace(BOOT, n_bins=5, bin_keys=("experiment",), number_keys=tuple(S.SUMMARY_KEYS))
    boot = A.analyse_experiment(trimmed(spark, folder), s)["boot"]
    return boot.select(*s.summary_keys, "bin_id", *INTERVALS, "n_cells")


@query
def one_experiment_density_of_all(spark, folder):
    return A.analyse_experiment(trimmed(spark, folder), replace(PLAIN, n_bins=5))["density_all"]


@query
def one_experiment_density(spark, folder):
    return A.analyse_experiment(trimmed(spark, folder), replace(PLAIN, n_bins=5))["density_filtered"]


@query
def parameter_sweep(spark, folder):
    s = replace(BOOT, control="luc")
    out = A.parameter_sweep(trimmed(spark, folder, only=A.summarised_columns(s)), s=s)
    return out.select("param_combo", *s.summary_keys, "bin_id", "relative_bin", *INTERVALS, "n_cells")


@query
def gate_comparison(spark, folder):
    s = BOOT.with_keys("gate")
    boot = A.compare_gates(trimmed(spark, folder), s).boot
    return boot.select(*s.summary_keys, "bin_id", *INTERVALS, "n_cells")


@query
def rebinned_after_band(spark, folder):
    boot = A.rebin_after_band(trimmed(spark, folder), replace(BOOT, q_ha=0.5)).boot
    return boot.select(*BOOT.summary_keys, "bin_id", *INTERVALS, "n_cells")


@query
def grouped_legacy_analysis(spark, folder):
    """Gate and bins per (experiment, ligand) against the control line at any dose of the ligand."""
    g = gates.control_gate(trimmed(spark, folder), F.col("cell_line") == "Luc", 0.75, 0.1, ["experiment", "ligand"])
    b = binning.equal_width_bins(g, 8, S.BIN_KEYS_LEGACY)
    out = binning.renumber_bins(binning.bin_summary(b, S.SUMMARY_KEYS_LEGACY), ["experiment", "ligand", "ligand_conc"])
    return out.select(*S.SUMMARY_KEYS_LEGACY, "bin_id", MEAN, "median_norm_psmad2", "n_cells")


@query
def grouped_legacy_intervals(spark, folder):
    """Gate and bins of ``grouped_legacy_analysis``, resampled."""
    g = gates.control_gate(trimmed(spark, folder), F.col("cell_line") == "Luc", 0.75, 0.1, ["experiment", "ligand"])
    boot = A.summarise(binning.equal_width_bins(g, 8, S.BIN_KEYS_LEGACY), LEGACY)
    return boot.select(*LEGACY.summary_keys, "bin_id", *INTERVALS, "n_cells")


@query
def legacy_analysis(spark, folder):
    """Gate against the control line at dose 0 per (experiment, ligand); dose 0 goes by the name of TGFB1."""
    named = F.when(F.col("ligand") == S.NO_LIGAND, "TGFB1").otherwise(F.col("ligand"))
    boot = A.analyse(trimmed(spark, folder).withColumn("ligand", named), LEGACY).boot
    return boot.select(*LEGACY.summary_keys, "bin_id", *INTERVALS, "n_cells")


@query
def tree_to_bootstrapped_bins(spark, folder):
    """From a tree of CSV samples to the bootstrapped bins of the single-ligand analysis."""
    root = _fresh(spark, "csv")
    _write_tree(raw_cells(spark, folder), root, "single", ["experiment"], FIVE)
    loaded = materialize(csv_tree.load_cells(spark, root, "single_ligand"))
    return A.analyse(gates.trim_outliers(loaded, S.TRIM_KEYS_GATED), BOOT).boot


@query
def heat_map_round_trip(spark, folder):
    """Dose grid written as CSV, read back with stated types, then both dose metrics."""
    out, path = heat_map(spark, folder), _fresh(spark, "results")
    csv_tree.write_result(out, path)
    return dose.rls_lic(csv_tree.read_result(spark, path, out.schema))


def _no_ligand(spark, folder):
    root = _fresh(spark, "csv")
    raw = raw_cells(spark, folder).where(F.col("ligand") == S.NO_LIGAND)
    _write_tree(raw, root, "no_ligand", ["experiment"], FIVE)
    return materialize(csv_tree.load_cells(spark, root, "no_ligand"))


@query
def no_ligand_scan(spark, folder):
    keys = ["sample", "experiment", "cell_line", "dox", "ligand", "replicate"]
    return counts_by(_no_ligand(spark, folder), keys, "ha", "psmad2", "smad2", "norm_psmad2")


@query
def no_ligand_analysis(spark, folder):
    """Samples without any ligand: twenty bins per sample."""
    s = replace(A.NO_LIGAND, q_ha=0.1, n_boot=N_BOOT, seed=SEED)
    boot = A.analyse(gates.trim_outliers(_no_ligand(spark, folder), S.TRIM_KEYS_NO_LIGAND), s).boot
    return boot.select(*s.summary_keys, "bin_id", *INTERVALS, "n_cells")


def _summaries(spark, folder):
    """Bin states of all experiments: those of 2001 are added to a table of the others."""
    stored, path = _fresh(spark, "cells"), _fresh(spark, "states")
    cells(spark, folder).write.partitionBy("experiment").parquet(stored)
    rows = spark.read.schema(cells(spark, folder).schema).parquet(stored)
    summaries.add_experiments(rows.where("experiment <> '2001'"), path, PLAIN, accuracy=60_000)
    summaries.add_experiments(rows, path, PLAIN, accuracy=60_000)
    return summaries.read_states(spark, path)


@query
def summaries_with_one_more_experiment(spark, folder):
    return summaries.described(_summaries(spark, folder), list(PLAIN.summary_keys), PLAIN.signal)


@query
def summaries_merged_over_experiments(spark, folder):
    keys = ["cell_line", "dox", "ligand", "ligand_conc"]
    return summaries.described(summaries.merged_states(_summaries(spark, folder), keys, PLAIN.signal), keys, PLAIN.signal)


@query
def minimum_slice(spark, folder):
    """Trim, ratio, gate, bin, summarise, renumber."""
    boot = A.analyse(trimmed(spark, folder), PLAIN).boot
    return boot.select(*SINGLE.summary_keys, "bin_id", "bin_lo", "bin_hi", MEAN, "median_norm_psmad2", "n_cells")
