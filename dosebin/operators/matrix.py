"""Bin profiles as matrix rows, and distances between them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import attach


def wide_profiles(
    df: DataFrame, row: str = "exp_rep", column: str = "bin_id", value: str = "mean_norm_psmad2",
    columns: list[int] | None = None, prefix: str = "bin_",
) -> DataFrame:
    """One row per ``row``, one column per bin: all bins there are, or ``columns``.

    A bin that is not among given ``columns`` is an error, raised when its row is read.
    """
    bins = sorted(r[0] for r in df.select(column).distinct().collect()) if columns is None else columns
    if columns is not None:
        stray = F.raise_error(F.concat(F.lit(f"{column} not among the columns: "), F.col(column).cast("string")))
        df = df.withColumn(column, F.when(F.col(column).isin(bins), F.col(column)).otherwise(stray.cast("int")))
    out = df.groupBy(row).pivot(column, bins).agg(F.first(value))
    return out.select(row, *[F.col(str(b)).alias(f"{prefix}{b}") for b in bins])


def row_distances(
    df: DataFrame, row: str = "exp_rep", column: str = "bin_id", value: str = "mean_norm_psmad2"
) -> DataFrame:
    """Euclidean distance between the profiles of every two rows, once per pair.

    The result is the distance matrix itself, so it has a row per pair of
    profiles; profiles are summary rows (one per experiment and replicate).
    Bins that one of the two lacks are left out and the sum is scaled up to the
    number of bins, as a distance over incomplete profiles.
    """
    left = df.select(F.col(row).alias("row_a"), F.col(column).alias("__c"), F.col(value).alias("__a"))
    right = df.select(F.col(row).alias("row_b"), F.col(column).alias("__d"), F.col(value).alias("__b"))
    total = df.agg(F.count_distinct(column).alias("__bins"))
    pairs = left.join(right, (F.col("__c") == F.col("__d")) & (F.col("row_a") < F.col("row_b")))
    gap = F.col("__a") - F.col("__b")
    sums = pairs.groupBy("row_a", "row_b").agg(
        F.sum(gap * gap).alias("__ss"), F.count(gap).alias("__used")
    )
    return attach(sums, total, []).select(
        "row_a",
        "row_b",
        F.sqrt(F.col("__ss") * F.col("__bins") / F.col("__used")).alias("distance"),
    )
