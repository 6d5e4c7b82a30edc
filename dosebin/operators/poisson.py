"""Bootstrap by Poisson weights: for bins of any size, without positions.

Instead of drawing as many cells as a bin holds, every replicate gives each cell a weight
that is Poisson distributed with mean 1, from a keyed hash of the cell's number.  Rows
are weighed where they are scanned; what leaves a task is a few sums per bin and
replicate.  For the medians only the cells near the bin's middle are needed: of ``n`` cells
those of the ranks ``n / 2 - WINDOW sqrt(n)`` to ``n / 2 + WINDOW sqrt(n)``, ten standard deviations of a
replicate's median to each side.  Cells below add to a sum, as do those equal to either end.

Means and medians of the weighted cells are exact.  The number of draws of a replicate is not
fixed but varies around the bin's size, so intervals differ from those of drawing by a
part of the order of ``1 / n`` and by chance.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import attach, materialize
from .selection import Position, select_positions

PRIME = (1 << 31) - 1
WINDOW = 5
WEIGHED_AT_ONCE = 1 << 18
HELD_BINS = 500
# Hashes below LIMITS[0] weigh 0, below LIMITS[1] weigh 1, and so on.
LIMITS = np.array([int(PRIME * sum(exp(-1) / factorial(i) for i in range(k + 1))) for k in range(13)])


def _reduced(h: np.ndarray) -> np.ndarray:
    for _ in range(2):
        h = (h & PRIME) + (h >> 31)
    return h


def weights(coef: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Weight of each cell (column) in each replicate (row of four coefficients).

    The hash is a cubic polynomial modulo 2^31 - 1 of the number's low part, and the same polynomial
    of that and the high part.
    """
    low, high = np.mod(ids, PRIME)[None, :], np.mod(ids // PRIME, PRIME)[None, :]
    c = [coef[:, k : k + 1] for k in range(4)]
    z, h = low, 0
    for _ in range(2):
        h = c[3]
        for k in (2, 1, 0):
            h = _reduced(h * z + c[k])
        z = _reduced(h + high)
    return np.searchsorted(LIMITS, h - (h >= PRIME) * PRIME, side="right")


def _replicate_sums(rows: DataFrame, group: list[str], n_boot: int, seed: int, coefficients) -> DataFrame:
    """Per bin and task: weighted sums of all replicates and the cells inside the window."""
    numbers = ["sums", "total", "below", "at_lo", "at_hi"]
    types = [T.ArrayType(T.DoubleType())] + [T.ArrayType(T.LongType())] * 4 + [T.ArrayType(T.DoubleType()), T.ArrayType(T.LongType())]
    head = [*group, "n_cells", "__lo", "__hi", "__key"]
    schema = T.StructType([rows.schema[c] for c in head] + [T.StructField(n, t) for n, t in zip([*numbers, "xs", "ids"], types)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[pa.RecordBatch, np.ndarray, np.ndarray, list, list]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for row, sums, n, xs, ids in held.values():
                made = [pa.array([sums], pa.list_(pa.float64())), *(pa.array([x], pa.list_(pa.int64())) for x in n)]
                made += [pa.array([np.concatenate(xs)], pa.list_(pa.float64())), pa.array([np.concatenate(ids)], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*row.columns, *made], [*head, *numbers, "xs", "ids"])
            held.clear()

        for batch in batches:
            keys = batch.column("__key").dictionary_encode()
            code, names = keys.indices.to_numpy(), keys.dictionary.to_pylist()
            x_all, id_all = batch.column("__x").to_numpy(), batch.column("__id").to_numpy()
            order = np.argsort(code, kind="stable")
            ends = np.searchsorted(code[order], np.arange(len(names) + 1))
            for k, name in enumerate(names):
                own = order[ends[k] : ends[k + 1]]
                if name not in held:
                    if len(held) >= HELD_BINS:
                        yield from flush()
                    row = pa.RecordBatch.from_arrays([batch.column(c).slice(int(own[0]), 1) for c in head], head)
                    held[name] = row, np.zeros(n_boot), np.zeros((4, n_boot), np.int64), [], []
                row, sums, n, xs, ids = held[name]
                lo, hi = row.column("__lo")[0].as_py(), row.column("__hi")[0].as_py()
                x, number = x_all[own], id_all[own]
                coef = coefficients([f"{seed}|{name}|{b}" for b in range(1, n_boot + 1)])
                step = max(1, WEIGHED_AT_ONCE // len(own))
                parts = [np.ones(len(own), bool), x < lo, x == lo, (x == hi) & (hi > lo)]
                for at in range(0, n_boot, step):
                    w = weights(coef[at : at + step], number)
                    sums[at : at + step] += w @ x
                    for p, part in enumerate(parts):
                        n[p, at : at + step] += w[:, part].sum(axis=1)
                inside = (lo < x) & (x < hi)
                xs.append(x[inside])
                ids.append(number[inside])
        yield from flush()

    return rows.mapInArrow(run, schema)


def poisson_replicates(
    binned: DataFrame, keys: list[str], value: str, n_boot: int, seed: int, row_id: str, key_text, coefficients
) -> DataFrame:
    """One row per condition, bin and replicate, as ``bootstrap_replicates`` gives.

    ``row_id`` is an integer that tells the cells of a bin apart.  A replicate in which every cell weighs
    0 (bins of a few cells) has a NULL mean and median.
    """
    group = [*keys, "bin_id"]
    rows = binned.where(F.col("bin_id").isNotNull() & F.col(value).isNotNull() & ~F.isnan(value)).select(
        *group, F.col(value).cast("double").alias("__x"), F.col(row_id).cast("long").alias("__id")
    )
    reach = f"ceil({float(WINDOW)}D * sqrt(__n)) + 1"
    ends = [
        Position("lo", "__x", f"greatest(floor(__n / 2) - ({reach}), 0)"),
        Position("hi", "__x", f"least(floor(__n / 2) + {reach}, __n - 1)"),
    ]
    found = select_positions(rows, group, ends)
    pick = lambda name: F.max(F.when(F.col("position") == name, F.col("value")))
    limits = found.groupBy(*group).agg(F.max("n").alias("n_cells"), pick("lo").alias("__lo"), pick("hi").alias("__hi"))
    limits = materialize(limits.withColumn("__key", key_text(group)))
    parts = materialize(_replicate_sums(attach(rows, limits, group), group, n_boot, seed, coefficients))

    zipped = F.arrays_zip(F.sequence(F.lit(1), F.lit(n_boot)).alias("replicate_no"), "sums", "total", "below", "at_lo", "at_hi")
    each = parts.select(*group, "n_cells", "__lo", "__hi", "__key", F.inline(zipped)).groupBy(
        *group, "n_cells", "__lo", "__hi", "__key", "replicate_no"
    )
    each = each.agg(*[F.sum(c).alias(c) for c in ("sums", "total", "below", "at_lo", "at_hi")])
    near = parts.select(*group, F.inline(F.arrays_zip("xs", "ids")))
    names = [*group, "replicate_no", "boot_mean", "boot_median", "n_cells"]
    schema = T.StructType(
        [each.schema[c] for c in group]
        + [T.StructField("replicate_no", T.IntegerType()), T.StructField("boot_mean", T.DoubleType())]
        + [T.StructField("boot_median", T.DoubleType()), T.StructField("n_cells", T.LongType())]
    )

    def middle(told: pa.Table, cells: pa.Table) -> pa.Table:
        """Medians of the replicates of one bin from its cells near the middle."""
        told, cells = told.sort_by("replicate_no"), cells.sort_by("xs")
        x, number = cells.column("xs").to_numpy(), cells.column("ids").to_numpy()
        total, below, at_lo, at_hi = (told.column(c).to_numpy() for c in ("total", "below", "at_lo", "at_hi"))
        lo, hi, key = (told.column(c)[0].as_py() for c in ("__lo", "__hi", "__key"))
        texts = [f"{seed}|{key}|{b}" for b in told.column("replicate_no").to_pylist()]
        coef, medians = coefficients(texts), np.full(len(total), np.nan)
        step = max(1, WEIGHED_AT_ONCE // max(1, len(x)))
        values = np.r_[lo, x, hi]
        for at in range(0, len(total), step):
            r = slice(at, at + step)
            w = np.c_[at_lo[r], weights(coef[r], number) if len(x) else np.zeros((len(at_lo[r]), 0), np.int64), at_hi[r]]
            upto = below[r, None] + np.cumsum(w, axis=1)
            for i, (n, first, sums) in enumerate(zip(total[r], below[r], upto)):
                ranks = ((n - 1) // 2, n // 2)
                if n and not first <= ranks[0] <= ranks[1] < sums[-1]:
                    raise ValueError("a replicate's median lies outside the window")
                if n:
                    medians[at + i] = values[np.searchsorted(sums, ranks, side="right")].sum() / 2
        sums = told.column("sums").to_numpy()
        means = np.divide(sums, total, out=np.full(len(sums), np.nan), where=total > 0)
        columns = [told.column(c).combine_chunks() for c in [*group, "replicate_no"]]
        columns += [pa.array(v, pa.float64(), mask=total == 0) for v in (means, medians)]
        return pa.Table.from_arrays([*columns, told.column("n_cells").combine_chunks()], names)

    return each.groupBy(*group).cogroup(near.groupBy(*group)).applyInArrow(middle, schema)
