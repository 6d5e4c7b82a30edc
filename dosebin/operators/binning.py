"""Equal-width, log-spaced and equal-count bins, and bin renumbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import complete_rows
from ..session import attach, materialize
from .selection import Position, quantiles, select_positions


def _right_closed(x: Column, guess: Column, edge, n_bins: Column) -> Column:
    """Settle a computed bin against the edges themselves: (edge(k-1), edge(k)]."""
    k = F.least(F.greatest(guess, F.lit(1)), n_bins)
    k = F.when(x > edge(k), k + 1).when(x <= edge(k - 1), k - 1).otherwise(k)
    return F.least(F.greatest(k, F.lit(1)), n_bins).cast("int")


def bin_ranges(df: DataFrame, keys: list[str], column: str = "ha") -> DataFrame:
    return df.groupBy(*keys).agg(
        F.min(column).alias("min_ha"), F.max(column).alias("max_ha")
    )


def equal_width_bins(
    df: DataFrame,
    n_bins: int | Column | list[int] = 10,
    keys: list[str] = S.BIN_KEYS,
    column: str = "ha",
    margin: float = 0.1,
) -> DataFrame:
    """Add ``bin_id``, ``bin_lo``, ``bin_hi``: equal widths over the group's range.

    Bins are right-closed with the lowest value included.  ``keys=[]`` uses one
    range for all rows.  ``n_bins`` may be a column, or a list: rows with their range are then
    repeated for each number, which column ``n_bins`` holds.
    """
    ranges = materialize(bin_ranges(df, keys, column))
    rows = attach(df, ranges, keys)
    if isinstance(n_bins, list):
        rows = rows.withColumn("n_bins", F.explode(F.array(*map(F.lit, n_bins))))
        n_bins = F.col("n_bins")
    n = F.lit(n_bins) if isinstance(n_bins, int) else n_bins
    lo = F.col("min_ha") - margin
    width = ((F.col("max_ha") + margin) - lo) / n
    x = F.col(column)
    k = _right_closed(x, F.ceil((x - lo) / width), lambda i: lo + i * width, n)
    return (
        rows.withColumn("bin_id", F.when(x.isNotNull(), k))
        .withColumn("bin_lo", lo + (F.col("bin_id") - 1) * width)
        .withColumn("bin_hi", lo + F.col("bin_id") * width)
        .drop("min_ha", "max_ha")
    )


def log_spaced_bins(
    df: DataFrame,
    lowest: Column,
    highest: Column,
    n_bins: int = 5,
    column: str = "ha",
) -> DataFrame:
    """Add log-spaced bins from ``lowest`` (excluded) to ``highest``; NULL outside."""
    x = F.col(column)
    lo, hi = F.log(lowest), F.log(highest)
    step = (hi - lo) / n_bins

    def edge(i: Column) -> Column:
        return F.exp(lo + i * step)

    guess = F.ceil((F.log(x) - lo) / step)
    inside = (x > lowest) & (x <= highest)
    return (
        df.withColumn("bin_id", F.when(inside, _right_closed(x, guess, edge, F.lit(n_bins))))
        .withColumn("bin_lo", edge(F.col("bin_id") - 1))
        .withColumn("bin_hi", edge(F.col("bin_id")))
    )


def equal_count_bins(
    df: DataFrame,
    n_bins: int = 10,
    keys: list[str] = S.BIN_KEYS,
    column: str = "ha",
    tie_break: str = "cell_id",
) -> DataFrame:
    """Add ``bin_id`` 1..n with sizes that differ by at most one, bigger bins first.

    Equal to ``ntile`` over (column, tie_break), but from the cut points of each
    group instead of a sort of the whole group: first the values at the cuts,
    then, where a cut falls inside a run of equal values, the tie-break at it.
    """
    rows = complete_rows(df, [column])

    base = f"floor(__n / {n_bins})"
    cuts = [Position(str(j), column, f"{base} * {j} + least({j}, __n - {base} * {n_bins})") for j in range(1, n_bins)]
    at = materialize(select_positions(rows, keys, cuts))

    split = at.where(F.col("run_offset") > 0).select(
        *keys, F.col("position").alias("__cut"), F.col("value").alias("__at"), "run_offset"
    )
    run = attach(
        rows.select(*keys, F.col(column).alias("__at"), F.col(tie_break).alias("__tie")),
        split,
        [*keys, "__at"],
    )
    # The rows of the runs are read where they lie; only slot counts of their tie-breaks are shuffled.
    ties = _kth_tie(run.select(*keys, "__cut", "__tie", "run_offset"), [*keys, "__cut"])

    wide = at.groupBy(*keys).agg(
        *[
            F.max(F.when(F.col("position") == str(j), F.col("value"))).alias(f"__v{j}")
            for j in range(1, n_bins)
        ]
    )
    tie_wide = ties.groupBy(*keys).agg(
        *[
            F.max(F.when(F.col("__cut") == str(j), F.col("__tie"))).alias(f"__t{j}")
            for j in range(1, n_bins)
        ]
    )
    limits = materialize(attach(wide, tie_wide, keys, "left"))
    out = attach(rows, limits, keys, "left")
    x, t = F.col(column), F.col(tie_break)
    k = F.lit(1)
    for j in range(1, n_bins):
        v, at_tie = F.col(f"__v{j}"), F.col(f"__t{j}")
        past = (x > v) | ((x == v) & (at_tie.isNull() | (t >= at_tie)))
        k = k + F.when(past, 1).otherwise(0)
    drop = [f"__v{j}" for j in range(1, n_bins)] + [f"__t{j}" for j in range(1, n_bins)]
    return out.withColumn("bin_id", k.cast("int")).drop(*drop)


def _kth_tie(run: DataFrame, keys: list[str]) -> DataFrame:
    """Tie-break value at ``run_offset`` within each run of equal values."""
    group = [*keys, "run_offset"]
    found = select_positions(run, group, [Position("k", "__tie", "run_offset")], "bigint")
    return found.select(*keys, F.col("value").alias("__tie"))


def renumber_bins(df: DataFrame, keys: list[str], order: str = "bin_id") -> DataFrame:
    """Number the bins that are present 1, 2, ... so that empty bins close up."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("bin_id", F.row_number().over(w))


def bin_summary(
    binned: DataFrame, keys: list[str] = S.SUMMARY_KEYS, value: str = "norm_psmad2"
) -> DataFrame:
    """Mean, median and number of cells per condition and bin."""
    rows = binned.where(F.col("bin_id").isNotNull())
    group = [*keys, "bin_id"]
    extra = [F.first(c).alias(c) for c in ("bin_lo", "bin_hi") if c in binned.columns]
    aggs = [F.avg(value).alias(f"mean_{value}"), F.count(F.lit(1)).alias("n_cells"), *extra]
    means = rows.groupBy(*group).agg(*aggs)
    medians = quantiles(rows, group, {f"median_{value}": (value, 0.5)})
    return attach(means, materialize(medians), group, "left")


def bin_means(
    binned: DataFrame, keys: list[str], value: str = "norm_psmad2"
) -> DataFrame:
    return (
        binned.where(F.col("bin_id").isNotNull())
        .groupBy(*keys, "bin_id")
        .agg(F.avg(value).alias(f"mean_{value}"), F.count(F.lit(1)).alias("n_cells"))
    )
