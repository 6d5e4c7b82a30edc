"""Scalar column expressions on channels and results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

__all__ = [
    "log_channel",
    "floored_log_channel",
    "log_ratio",
    "composite_key",
    "parameter_label",
    "relative_bin",
    "step_length",
    "step_angle",
    "threshold_group",
    "interpolate",
    "complete_rows",
    "safe_log10",
]


def log_channel(x: Column, zero: str = "drop") -> Column:
    """log10; NULL below zero.  Zero is NULL, or -Infinity with ``zero="neg_inf"``."""
    logged = F.when(x > 0, F.log10(x))
    if zero == "neg_inf":
        return F.when(x == 0, F.lit(float("-inf"))).otherwise(logged)
    if zero != "drop":
        raise ValueError("zero must be 'drop' or 'neg_inf'")
    return logged


def floored_log_channel(x: Column, floor: float = 0.1) -> Column:
    return F.log10(F.when(x <= 0, F.lit(floor)).otherwise(x))


def safe_log10(x: Column) -> Column:
    return F.when(x > 0, F.log10(x))


def log_ratio(num: Column, den: Column) -> Column:
    """Ratio of two logged channels; NULL when the denominator is 0."""
    return F.try_divide(num, den)


def composite_key(experiment: Column, replicate: Column, *more: Column) -> Column:
    return F.concat(experiment, F.lit(" #"), replicate.cast("string"), *more)


def parameter_label(q_signal: Column, q_ha: Column, n_bins: Column) -> Column:
    return F.concat(
        F.lit("pSMAD2_"), q_signal.cast("string"),
        F.lit("_HA_"), q_ha.cast("string"),
        F.lit("_bins_"), n_bins.cast("string"),
    )


def relative_bin(bin_id: Column, n_bins: Column) -> Column:
    return bin_id / n_bins


def step_length(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def step_angle(dy: Column, dx: Column) -> Column:
    return F.atan2(dy, dx)


def threshold_group(index: Column, cutoff: int = 7) -> Column:
    return F.when(index < cutoff, "1").when(index >= cutoff, "2")


def interpolate(lo: Column, hi: Column, fraction: Column) -> Column:
    """Linear interpolation that keeps ends exact, also infinite ones."""
    return F.when((lo == hi) | (fraction == 0), lo).otherwise(lo + (hi - lo) * fraction)


def complete_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Drop rows with a NULL or NaN in any of ``columns`` (all by default)."""
    return df.dropna(how="any", subset=columns)
