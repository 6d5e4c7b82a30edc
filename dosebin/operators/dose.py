"""Comparisons across doses and bins: panels, steps, ranges, dose-grid metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import step_angle, step_length, threshold_group
from ..session import attach


def dose_panels(
    df: DataFrame, unit: str = "exp_rep", dose: str = "ligand_conc", baseline: float = 0.0
) -> DataFrame:
    """One panel per non-baseline dose: units that have the dose, at the dose and the baseline.

    All panels at once, told apart by ``panel_dose``; a unit's baseline rows
    appear in each of its panels.
    """
    panels = (
        df.where(F.col(dose) != baseline)
        .select(unit, F.col(dose).alias("panel_dose"))
        .distinct()
    )
    return attach(df, panels, [unit]).where(
        (F.col(dose) == baseline) | F.col(dose).eqNullSafe(F.col("panel_dose"))
    )


def dose_range(
    df: DataFrame, keys: list[str], value: str = "mean_norm_psmad2"
) -> DataFrame:
    """min, max and max - min over the bins."""
    out = df.groupBy(*keys).agg(F.min(value).alias("min_signal"), F.max(value).alias("max_signal"))
    return out.withColumn("range", F.col("max_signal") - F.col("min_signal"))


def range_and_change(
    df: DataFrame, keys: list[str], value: str = "new_norm_psmad2", first: int = 1, last: int = 10
) -> DataFrame:
    """Range over bins, and last bin minus first bin."""
    return df.groupBy(*keys).agg(
        (F.max(value) - F.min(value)).alias("minmax"),
        (
            F.max(F.when(F.col("bin_id") == last, F.col(value)))
            - F.max(F.when(F.col("bin_id") == first, F.col(value)))
        ).alias("end_change"),
    )


def forward_differences(
    df: DataFrame, keys: list[str], value: str = "mean_norm_psmad2", order: str = "bin_id"
) -> DataFrame:
    """Next bin minus this one; the last bin is dropped unless it is the only one."""
    w = Window.partitionBy(*keys).orderBy(order)
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return (
        df.withColumn("diffs", F.lead(value).over(w) - F.col(value))
        .withColumn("diff_id", F.col(order) + 1)
        .withColumn("__i", F.row_number().over(w))
        .withColumn("__n", n)
        .where((F.col("__i") < F.col("__n")) | (F.col("__n") == 1))
        .drop("__i", "__n")
    )


def edge_table(df: DataFrame) -> DataFrame:
    """The outer edge of the dose grid in walking order (7 rows)."""
    rows = [(x, y, i + 1) for i, (x, y) in enumerate(S.EDGE_ORDER)]
    return df.sparkSession.createDataFrame(rows, "tgfb1 double, gdf11 double, edge_idx int")


def outer_edge(grid: DataFrame) -> DataFrame:
    """Rows on the outer edge with their index along it."""
    return attach(grid, F.broadcast(edge_table(grid)), ["tgfb1", "gdf11"])


def edge_summary(edge: DataFrame, value: str = "new_norm_psmad2") -> DataFrame:
    return edge.groupBy("bin_id", "edge_idx").agg(
        F.avg(value).alias("mean_signal"), F.stddev_samp(value).alias("sd_signal")
    )


def rls_lic(
    grid: DataFrame,
    averaged_edge: bool = False,
    value: str = "new_norm_psmad2",
    x: tuple[float, float] = (1.0, 3.16),
    y: tuple[float, float] = (7.9, 25.0),
) -> DataFrame:
    """Relative ligand strength and combination metrics per experiment and bin.

    a and b are the lower and the upper single-ligand response; RLS = a / b and
    LIC = (edge minimum) / a - b / (edge maximum).  ``x`` and ``y`` are the second
    highest and highest dose of each ligand; with ``averaged_edge`` b and the edge
    used for LIC include the second highest, the reported edge range does not.
    """
    v, tx, ty = F.col(value), F.col("tgfb1"), F.col("gdf11")
    top_x, top_y = tx == x[1], ty == y[1]
    wide_x, wide_y = (tx.isin(*x), ty.isin(*y)) if averaged_edge else (top_x, top_y)
    alone_y, alone_x = (tx == 0) & top_y, top_x & (ty == 0)
    a = F.min(F.when(alone_y | alone_x, v))
    b = F.max(F.when(((tx == 0) & wide_y) | (wide_x & (ty == 0)), v))
    edge, top_edge = F.when(wide_x | wide_y, v), F.when(top_x | top_y, v)
    sums = grid.groupBy("experiment", "bin_id").agg(
        a.alias("a"),
        b.alias("b"),
        F.min(edge).alias("__lo"),
        F.max(edge).alias("__hi"),
        F.min(top_edge).alias("satmin"),
        F.max(top_edge).alias("satmax"),
    )
    return sums.select(
        "experiment",
        "bin_id",
        "a",
        "b",
        F.try_divide("a", "b").alias("rls"),
        (F.try_divide("__lo", "a") - F.try_divide("b", "__hi")).alias("lic"),
        "satmin",
        "satmax",
    )


def metric_steps(metrics: DataFrame, cutoff: int = 7) -> DataFrame:
    """Step from the previous bin in (LIC, RLS): lengths, angle, and early / late group."""
    w = Window.partitionBy("experiment").orderBy("bin_id")
    return (
        metrics.withColumn("diff_rls", F.col("rls") - F.lag("rls").over(w))
        .withColumn("diff_lic", F.col("lic") - F.lag("lic").over(w))
        .withColumn("diff_id", F.row_number().over(w) - 1)
        .withColumn("eucl_diff", step_length(F.col("diff_rls"), F.col("diff_lic")))
        .withColumn("theta", step_angle(F.col("diff_rls"), F.col("diff_lic")))
        .where(F.col("eucl_diff").isNotNull())
        .withColumn("group_id", threshold_group(F.col("diff_id"), cutoff))
    )


def spread_over_dose(
    df: DataFrame, keys: list[str], value: str = "mean_norm_psmad2", name: str = "spread"
) -> DataFrame:
    return df.groupBy(*keys).agg((F.max(value) - F.min(value)).alias(name))


def lowest_per_group(df: DataFrame, keys: list[str], column: str = "ha") -> DataFrame:
    return df.groupBy(*keys).agg(F.min(column).alias(f"min_{column}"))


def odd_bins(df: DataFrame) -> DataFrame:
    return df.where(F.col("bin_id") % 2 == 1)


def even_bins(df: DataFrame) -> DataFrame:
    return df.where(F.col("bin_id") % 2 == 0)


def ordered(df: DataFrame, *columns: str | Column) -> DataFrame:
    """Sort of a final result."""
    return df.orderBy(*columns)
