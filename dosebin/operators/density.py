"""Histograms in one and two dimensions, and kernel density tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import attach, materialize
from .selection import quantiles


def _cells_of(df: DataFrame, columns: list[str], bins: int) -> tuple[DataFrame, list[Column]]:
    """Equal-width cell number (1..bins, right-closed) of each column over its overall range."""
    named = {c: (f"__lo_{i}", f"__hi_{i}") for i, c in enumerate(columns)}
    limits = []
    for c, (lo, hi) in named.items():
        limits += [F.min(c).alias(lo), F.max(c).alias(hi)]
    rows = attach(df, df.agg(*limits), [])
    cells = []
    for c, (lo, hi) in named.items():
        width = (F.col(hi) - F.col(lo)) / bins
        guess = F.ceil(F.try_divide(F.col(c) - F.col(lo), width))
        cells.append(
            F.when(
                F.col(c).isNotNull(),
                F.least(F.greatest(F.coalesce(guess, F.lit(1)), F.lit(1)), F.lit(bins)),
            ).cast("int")
        )
    return rows, cells


def histogram(df: DataFrame, column: str, facets: list[str], bins: int = 30) -> DataFrame:
    """Cells per equal-width bin of the overall range, per facet."""
    rows, (cell,) = _cells_of(df, [column], bins)
    return (
        rows.withColumn("cell", cell)
        .where(F.col("cell").isNotNull())
        .groupBy(*facets, "cell")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def histogram_2d(df: DataFrame, x: str, y: str, facets: list[str], bins: int = 128) -> DataFrame:
    """Counts on a grid of equal-width cells over the overall ranges, per facet."""
    rows, (cx, cy) = _cells_of(df, [x, y], bins)
    return (
        rows.withColumn("cell_x", cx)
        .withColumn("cell_y", cy)
        .where(F.col("cell_x").isNotNull() & F.col("cell_y").isNotNull())
        .groupBy(*facets, "cell_x", "cell_y")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def violin_density(
    df: DataFrame, keys: list[str], column: str, points: int = 512, reach: float = 3.0
) -> DataFrame:
    """Gaussian kernel density of ``column`` per group on ``points`` grid points.

    The bandwidth is 0.9 * min(sd, IQR / 1.34) * n^(-1/5); the grid reaches
    ``reach`` bandwidths past the data.  Values are first shared linearly between
    their two neighbouring nodes of a grid four bandwidths wider still; the nodes of a group, ``points``
    at most, are smoothed by fast Fourier transform, however many values there are, and
    interpolated to the output grid.  Groups of one value have none.
    """
    rows = df.where(F.col(column).isNotNull() & ~F.isnan(column))
    quartiles = quantiles(rows, keys, {"__q1": (column, 0.25), "__q2": (column, 0.5), "__q3": (column, 0.75)})
    spread = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.stddev_samp(column).alias("__sd"),
        F.min(column).alias("__min"),
        F.max(column).alias("__max"),
    )
    stats = attach(spread, materialize(quartiles), keys)
    iqr = (F.col("__q3") - F.col("__q1")) / 1.34
    scale = F.when(iqr > 0, F.least(F.col("__sd"), iqr)).otherwise(F.col("__sd"))
    stats = (
        stats.withColumn("bw", 0.9 * scale * F.pow(F.col("n").cast("double"), F.lit(-0.2)))
        .where(F.col("bw") > 0)
        .withColumn("__from", F.col("__min") - reach * F.col("bw"))
        .withColumn("__to", F.col("__max") + reach * F.col("bw"))
        .withColumn("__lo", F.col("__from") - 4 * F.col("bw"))
        .withColumn("__step", (F.col("__to") + 4 * F.col("bw") - F.col("__lo")) / (points - 1))
        .select(*keys, "n", "bw", "__from", "__to", "__lo", "__step", F.col("__q2").alias("median"))
    )
    stats = materialize(stats)

    at = (F.col(column) - F.col("__lo")) / F.col("__step")
    left = F.floor(at)
    shares = F.array(
        F.struct(left.alias("node"), (1 - (at - left)).alias("w")),
        F.struct((left + 1).alias("node"), (at - left).alias("w")),
    )
    masses = (
        attach(rows, stats, keys)
        .select(*keys, F.inline(shares))
        .groupBy(*keys, "node")
        .agg(F.sum("w").alias("w"))
        .groupBy(*keys)
        .agg(F.collect_list(F.struct("node", "w")).alias("__mass"))
    )
    out = attach(stats, masses, keys)
    made = [("point", T.IntegerType()), ("x", T.DoubleType()), ("density", T.DoubleType())]
    head = [*keys, "n", "bw", "median"]
    schema = T.StructType([out.schema[c] for c in head] + [T.StructField(name, t) for name, t in made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                start, stop, lo, step, bw, n = (row.column(c)[0].as_py() for c in ("__from", "__to", "__lo", "__step", "bw", "n"))
                mass = np.zeros(points)
                for m in row.column("__mass")[0].as_py():
                    if 0 <= m["node"] < points:  # the share of a last node's right neighbour is nothing
                        mass[m["node"]] += m["w"]
                x = start + np.arange(points) * (stop - start) / (points - 1)
                found = np.interp(x, lo + step * np.arange(points), _smoothed(mass, step / bw) / (bw * n))
                same = pa.array(np.zeros(points, np.int64))
                columns = [row.column(c).take(same) for c in head]
                columns += [pa.array(np.arange(points, dtype=np.int32)), pa.array(x), pa.array(found)]
                yield pa.RecordBatch.from_arrays(columns, [*head, "point", "x", "density"])

    return out.mapInArrow(run, schema)


def _smoothed(mass: np.ndarray, step: float) -> np.ndarray:
    """Masses on grid nodes smoothed by a normal curve; ``step`` is the grid's in bandwidths.

    A product of transforms instead of all pairs of nodes; the grid is doubled, so that nothing wraps around.
    """
    size = 1 << (2 * len(mass) - 1).bit_length()
    away = np.minimum(np.arange(size), size - np.arange(size)) * step
    curve = np.exp(-0.5 * away**2) / np.sqrt(2 * np.pi)
    return np.maximum(np.fft.irfft(np.fft.rfft(mass, size) * np.fft.rfft(curve), size)[: len(mass)], 0.0)
