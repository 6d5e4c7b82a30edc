"""Outlier trim, control-quantile gate, percentile band, and the plain filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..session import attach, materialize
from .selection import quantiles


def trim_outliers(
    df: DataFrame,
    keys: list[str] = S.TRIM_KEYS,
    columns: tuple[str, ...] = ("psmad2", "ha"),
    low: float = 0.001,
    high: float = 0.999,
    accuracy: int | None = None,
) -> DataFrame:
    """Keep rows whose ``columns`` all lie in their own per-group quantile range, inclusive.

    ``accuracy`` takes the limits from sketches of that size: one scan, ranks off by about 1.7 / accuracy.
    """
    wanted = {}
    for c in columns:
        wanted[f"__low_{c}"] = (c, low)
        wanted[f"__high_{c}"] = (c, high)
    limits = materialize(quantiles(df, keys, wanted, accuracy))
    rows = attach(df, limits, keys)
    for c in columns:
        rows = rows.where(F.col(c).between(F.col(f"__low_{c}"), F.col(f"__high_{c}")))
    return rows.drop(*wanted)


def percentile_band(
    df: DataFrame, keys: list[str], column: str = "dapi", low: float = 0.08, high: float = 0.70
) -> DataFrame:
    """Keep rows inside a quantile band of one channel; both ends from the whole group."""
    return trim_outliers(df, keys, (column,), low, high)


def control_untreated() -> Column:
    """No induction and no ligand."""
    return (F.col("dox") == S.MINUS_DOX) & (F.col("ligand") == S.NO_LIGAND)


def control_uninduced() -> Column:
    return F.col("dox") == S.MINUS_DOX


def control_luc() -> Column:
    """Control cell line at dose 0."""
    return (F.col("cell_line") == "Luc") & (F.col("ligand_conc") == 0)


def gate_thresholds(
    df: DataFrame,
    control: Column,
    q_signal: float = 0.0,
    q_ha: float = 0.9,
    keys: tuple[str, ...] | list[str] = ("experiment",),
    signal: str = "norm_psmad2",
    ha: str = "ha",
    accuracy: int | None = None,
) -> DataFrame:
    """Control quantiles per group: ``signal_threshold`` and ``ha_threshold``."""
    return quantiles(
        df.where(control),
        list(keys),
        {"signal_threshold": (signal, q_signal), "ha_threshold": (ha, q_ha)},
        accuracy,
    )


def control_gate(
    df: DataFrame,
    control: Column | None = None,
    q_signal: float = 0.0,
    q_ha: float = 0.9,
    keys: tuple[str, ...] | list[str] = ("experiment",),
    signal: str = "norm_psmad2",
    ha: str = "ha",
    cell_line: str | None = "R3",
    keep_thresholds: bool = False,
    accuracy: int | None = None,
) -> DataFrame:
    """Keep ``cell_line`` rows strictly above the control quantiles of their group.

    A group without control rows keeps nothing; ``groups_without_control`` lists them.
    """
    control = control_untreated() if control is None else control
    limits = materialize(gate_thresholds(df, control, q_signal, q_ha, keys, signal, ha, accuracy))
    rows = df if cell_line is None else df.where(F.col("cell_line") == cell_line)
    rows = attach(rows, limits, list(keys)).where(
        (F.col(signal) > F.col("signal_threshold")) & (F.col(ha) > F.col("ha_threshold"))
    )
    return rows if keep_thresholds else rows.drop("signal_threshold", "ha_threshold")


def groups_without_control(
    df: DataFrame, control: Column, keys: tuple[str, ...] | list[str] = ("experiment",)
) -> DataFrame:
    return (
        df.groupBy(*keys)
        .agg(F.count(F.when(control, 1)).alias("n_control"))
        .where(F.col("n_control") == 0)
        .select(*keys)
    )


def min_group_rows(df: DataFrame, keys: list[str], at_least: int = 3) -> DataFrame:
    """Keep groups of summary rows with at least ``at_least`` rows."""
    return (
        df.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
        .where(F.col("__n") >= at_least)
        .drop("__n")
    )


def min_group_distinct(
    df: DataFrame, keys: list[str], column: str = "ligand_conc", at_least: int = 3
) -> DataFrame:
    """Keep groups with at least ``at_least`` distinct values of ``column``."""
    enough = (
        df.groupBy(*keys)
        .agg(F.count_distinct(column).alias("__n"))
        .where(F.col("__n") >= at_least)
        .drop("__n")
    )
    return attach(df, enough, keys, "left_semi")


def min_cells(df: DataFrame, more_than: int = 30) -> DataFrame:
    return df.where(F.col("n_cells") > more_than)


def grid_edge(df: DataFrame, x: str = "tgfb1", y: str = "gdf11") -> DataFrame:
    """Rows at the overall maximum of either dose."""
    top = df.agg(F.max(x).alias("x"), F.max(y).alias("y")).first()
    return df.where((F.col(x) == F.lit(top["x"])) | (F.col(y) == F.lit(top["y"])))
