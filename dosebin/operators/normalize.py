"""Scaling of summary rows within their group (bins per condition, conditions per experiment)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import attach


def _over(keys: list[str]):
    return Window.partitionBy(*keys)


def min_max_scale(
    df: DataFrame, keys: list[str], column: str = "mean_norm_psmad2", name: str = "new_norm_psmad2"
) -> DataFrame:
    """(x - min) / (max - min) per group; NULL for a constant group."""
    w = _over(keys)
    low, high = F.min(column).over(w), F.max(column).over(w)
    return df.withColumn(name, F.try_divide(F.col(column) - low, high - low))


def control_anchored_scale(
    df: DataFrame,
    keys: list[str],
    statistic: str = "mean",
    value: str = "norm_psmad2",
    control: Column | None = None,
) -> DataFrame:
    """(x - control) / (max - control) for a statistic and its interval.

    The control is the one row per group at dose 0 in bin 1.  Without it the
    result is NULL; two of them are an error.
    """
    at_control = (F.col("ligand_conc") == 0) & (F.col("bin_id") == 1) if control is None else control
    w = _over(keys)
    x = f"{statistic}_{value}"
    base = F.max(F.when(at_control, F.col(x))).over(w)
    times = F.count(F.when(at_control, 1)).over(w)
    base = F.when(times > 1, F.raise_error(F.lit("more than one control row in a group")).cast("double")).otherwise(base)
    out = df.withColumn(f"control_{statistic}", base).withColumn(
        f"control_{statistic}_max", F.max(x).over(w)
    )
    span = F.col(f"control_{statistic}_max") - F.col(f"control_{statistic}")
    for source, target in (
        (x, f"norm_{statistic}"),
        (f"{x}_low", f"norm_{statistic}_low"),
        (f"{x}_high", f"norm_{statistic}_high"),
    ):
        if source in df.columns:
            out = out.withColumn(
                target, F.try_divide(F.col(source) - F.col(f"control_{statistic}"), span)
            )
    return out


def mean_centre(df: DataFrame, keys: list[str], column: str, name: str) -> DataFrame:
    return df.withColumn(name, F.col(column) - F.avg(column).over(_over(keys)))


def z_score(df: DataFrame, keys: list[str], column: str, name: str) -> DataFrame:
    """(x - mean) / sd per group; NULL when the sd is 0 or undefined."""
    w = _over(keys)
    return df.withColumn(
        name,
        F.try_divide(F.col(column) - F.avg(column).over(w), F.stddev_samp(column).over(w)),
    )


def scale_by_max(df: DataFrame, keys: list[str], column: str, name: str) -> DataFrame:
    return df.withColumn(name, F.try_divide(F.col(column), F.max(column).over(_over(keys))))


def inner_bins(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Leave out the first and the last bin: of each group, or of the whole table with no keys."""
    if keys:
        w = _over(keys)
        return (
            df.withColumn("__top", F.max("bin_id").over(w))
            .where((F.col("bin_id") > 1) & (F.col("bin_id") < F.col("__top")))
            .drop("__top")
        )
    top = df.agg(F.max("bin_id").alias("__top"))
    return attach(df, top, []).where(
        (F.col("bin_id") > 1) & (F.col("bin_id") < F.col("__top"))
    ).drop("__top")
