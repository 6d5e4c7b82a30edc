"""Bootstrap mean and median with percentile intervals, per condition and bin.

Each replicate draws as many cells as the bin holds, with replacement.  A bin's sorted
values are cut into blocks of ``block_cells`` positions, and a binary tree over the blocks
splits the draws of every replicate: of the draws of a node as many fall into its left
half as a binomial variable says, down to one block, whose draws are positions in it.
Splits and positions come from a keyed polynomial hash, with a key for each replicate and
node, so they depend on seed, bin, replicate, size of the bin and of the blocks alone:
not on row order, partitions or the way the work is cut.

A task holds a slice of whole blocks.  A bin of one slice is resampled by one task, which meets its
key text once and not with every value.  For a larger bin the tree is walked first, which needs no values; its counts, one number per
replicate and block, are all that meets the values of a slice, and each slice draws for
itself.  Sums add up over the slices, and the median lies in a block known from the
counts.  Equal values are combined before the shuffle, so a repeated value costs one row
per slice it fills.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .. import schema as S
from ..session import attach, materialize
from .poisson import poisson_replicates
from .selection import running_count

PRIME = (1 << 31) - 1
INVERSE = (1 + 2.0**-51) / PRIME
FIRST = 500_000_003  # numbers that are hashed begin here: small ones would show that coefficients are under 2^28
HASHED_AT_ONCE = 1 << 16  # coins' numbers that a processor's cache holds
DRAWN_AT_ONCE = 1 << 17  # draws that are counted together
KEPT_BYTES = 24 << 20
ROW_ALONE = 1 << 13  # cells whose draws are worth a call for each replicate
SCALED_AT_ONCE = 1 << 14  # numbers that a processor's cache holds
WALKED_AT_ONCE = 1 << 22  # counts that a walk of the tree holds
SPAN = 128  # draw numbers that share coefficients
STEPS, WIDE_STEPS = (np.arange(-n / 2, n / 2) ** np.arange(4.0)[:, None] for n in (SPAN, 2 * SPAN))
LOT = 64  # positions whose counts are added up before the middle draw is looked for
DRAWS_PER_TASK = 200_000_000
BLOCK_CELLS = 1 << 16
SLICE_CELLS = 1 << 20
BITS = 30  # of a hash that serve as coins
STEP = 1 << 25  # hashes for each digit of a split; coins for 10^9 draws at least
DIGITS = 48  # of a binomial's probability; a draw that they leave open is one of 10^14
SPLIT_DRAWS = 1_000_000_000


def _coefficients(texts: list[str]) -> np.ndarray:
    """Four 28-bit hash coefficients per key text: the 32-bit words of its md5."""
    digests = b"".join(hashlib.md5(t.encode()).digest() for t in texts)
    return np.frombuffer(digests, dtype=">u4").astype(np.int64).reshape(-1, 4) & ((1 << 28) - 1)


def _hash(coef: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Cubic polynomials of the numbers ``z`` (under 2^31) modulo 2^31 - 1, a row per row of coefficients.

    The powers of the numbers are reduced once for all rows, so a value stays under 2^61 and needs one
    reduction, which folds the high bits onto the low ones.
    """
    squares = z * z % PRIME
    h = coef[:, 3:4] * (squares * z % PRIME)
    more = coef[:, 2:3] * squares
    h += more
    np.multiply(coef[:, 1:2], z, out=more)
    h += more
    h += coef[:, :1]
    return _reduced(h, more)


def _reduced(h: np.ndarray, more: np.ndarray) -> np.ndarray:
    """``h`` (under 2^61) modulo 2^31 - 1, in place; ``more`` is room of the same shape."""
    np.right_shift(h, 31, out=more)
    h &= PRIME
    h += more
    np.subtract(h, PRIME, out=more)
    # Unsigned, a negative difference is larger than any value.
    np.minimum(h.view(np.uint64), more.view(np.uint64), out=h.view(np.uint64))
    return h


def _positions(coef: np.ndarray, count: int, size: int) -> np.ndarray:
    """``_hash`` of the first ``count`` draw numbers, scaled to ``size`` positions; a row per row of coefficients.

    Within a span of numbers the cubic is written about the span's middle one, z: its coefficients are reduced
    once a span, and the values that they give for the steps from it are exact in floating point (under 2^51).
    A multiple of the prime keeps them above zero.  The inverse of the prime is a little too large, by less than
    takes a quotient (under 2^20) past the next whole number, so quotients are rounded down to the right one.
    """
    steps = WIDE_STEPS if count >= ROW_ALONE else STEPS
    span, spans = steps.shape[1], -(-count // steps.shape[1])
    z = FIRST + span // 2 + span * np.arange(spans)
    c1, c2, c3 = coef[:, 1:2], coef[:, 2:3], coef[:, 3:4]
    slope = c1 + 2 * c2 * z + 3 * c3 * (z * z % PRIME)
    bend = c2 + 3 * c3 * z
    about = np.empty((len(coef), spans, 4))
    about[..., 0] = _hash(coef, z)
    about[..., 0] += 300_000 * PRIME
    about[..., 1] = _reduced(slope, np.empty_like(slope))
    about[..., 2] = _reduced(bend, np.empty_like(bend))
    about[..., 3] = c3
    scale = size / 2.0**31
    unit = 1.0 if size & (size - 1) else scale  # a power of two is scaled to without rounding at any time
    about = about.reshape(-1, 4)
    about *= unit
    out = np.empty((len(about), span), np.intp)
    some = SCALED_AT_ONCE // span
    values, quotients = np.empty((2, some, span))
    for at in range(0, len(about), some):
        now = about[at : at + some]
        h, t = values[: len(now)], quotients[: len(now)]
        np.matmul(now, steps, out=h)
        np.multiply(h, INVERSE / unit, out=t)
        np.floor(t, out=t)
        t *= PRIME * unit
        h -= t
        if unit != scale:
            h *= scale
        out[at : at + some] = h
    return out.reshape(len(coef), -1)[:, :count]


def _coins(coef: np.ndarray, n: np.ndarray, digit: int) -> np.ndarray:
    """Of ``n[r]`` fair coins of each row, how many show one."""
    ones = np.zeros(len(n), np.int64)
    words = -(-int(n.max()) // BITS)
    step = max(1, HASHED_AT_ONCE // len(n))
    for at in range(0, words, step):
        j = np.arange(at, min(at + step, words))
        shown = np.clip(n[:, None] - BITS * j, 0, BITS)
        h = _hash(coef, FIRST + digit * STEP + j) & ((1 << shown) - 1)
        ones += np.bitwise_count(h).sum(axis=1, dtype=np.int64)
    return ones


def _left(texts: list[str], n: np.ndarray, left: int, size: int) -> np.ndarray:
    """Binomial counts: of ``n[r]`` draws from ``size`` positions, how many are among the first ``left``.

    A draw is a random number of unknown digits: it is compared with left / size digit by digit,
    where one coin each tells whether it is settled, so half of the open draws are left each time.
    """
    done = np.zeros(len(n), np.int64)
    for part in range(-(-int(n.max()) // SPLIT_DRAWS) if len(n) else 0):
        coef = _coefficients([f"{t}|{part}" for t in texts] if part else texts)
        open_ = np.clip(n - part * SPLIT_DRAWS, 0, SPLIT_DRAWS)
        rest, digit = left, 0
        while rest and digit < DIGITS and open_.any():
            ones = _coins(coef, open_, digit)
            rest, digit = 2 * rest, digit + 1
            if rest >= size:
                rest -= size
                done += open_ - ones
                open_ = ones
            else:
                open_ = open_ - ones
    return done


def block_counts(n_cells: int, block_cells: int, texts: list[str]) -> np.ndarray:
    """Draws of each replicate (row) that fall into each block of a bin."""
    blocks = -(-n_cells // block_cells)
    counts = np.zeros((len(texts), blocks), np.int64)
    nodes = [(0, blocks, np.full(len(texts), n_cells, np.int64))]
    while nodes:
        i, j, n = nodes.pop()
        if j - i == 1:
            counts[:, i] = n
            continue
        middle, size = (i + j) // 2, min(n_cells, j * block_cells) - i * block_cells
        first = _left([f"{t}|{i}|{j}" for t in texts], n, (middle - i) * block_cells, size)
        nodes += [(i, middle, first), (middle, j, n - first)]
    return counts


def _block_texts(texts: list[str], block: int, blocks: int) -> list[str]:
    return texts if blocks == 1 else [f"{t}|{block}|{block + 1}" for t in texts]


def _drawn(coef: np.ndarray, n: np.ndarray, size: int, apart: int, unused: int) -> np.ndarray:
    """Positions of the first ``n[r]`` draws of a row of coefficients; rows are filled up with ``unused``.

    Each row's positions begin ``apart`` after those of the row before.
    """
    spans = -(-int(n.max()) // SPAN)  # whole ones, so that rows follow each other without a gap
    drawn, least = _positions(coef, spans * SPAN, size), int(n.min())
    if apart:
        drawn += apart * np.arange(len(n))[:, None]
    if least < drawn.shape[1]:
        drawn[:, least:][np.arange(least, drawn.shape[1]) >= n[:, None]] = unused
    return drawn


def _times_drawn(coef: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    """How often each of ``size`` positions is among the first ``n[r]`` draws of a row of coefficients.

    Rows are filled up with zeros to whole lots of ``LOT`` positions.  Counts are exact as floating numbers,
    and sums of those are quick.
    """
    wide = -(-size // LOT) * LOT
    if size >= ROW_ALONE:
        times = np.empty((len(n), wide))
        for row, drawn, k in zip(times, _positions(coef, int(n.max()), size), n):
            row[:] = np.bincount(drawn[:k], minlength=wide)
        return times
    unused = len(n) * wide
    times = np.bincount(_drawn(coef, n, size, wide, unused).ravel(), minlength=unused + 1)[:unused]
    return times.reshape(len(n), wide).astype(np.float64)


def _drawn_sums(coef: np.ndarray, n: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Sums of the values ``held`` at the first ``n[r]`` draws of a row of coefficients."""
    with np.errstate(invalid="ignore"):  # both infinities
        if len(held) >= ROW_ALONE:
            return np.array([held.take(drawn[:k]).sum() for drawn, k in zip(_positions(coef, int(n.max()), len(held)), n)])
        return np.append(held, 0.0).take(_drawn(coef, n, len(held), 0, len(held))).sum(axis=1)


def _weighted_sums(times: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Sums of the sorted values ``held``, each as often as a row of ``times`` says; infinite ones count if drawn."""
    low, high = np.searchsorted(held, -np.inf, side="right"), np.searchsorted(held, np.inf)
    sums = times[:, low:high] @ held[low:high]
    if low:
        sums[times[:, :low].any(axis=1)] -= np.inf
    if high < len(held):
        sums[times[:, high : len(held)].any(axis=1)] += np.inf
    return sums


def _nth_drawn(times: np.ndarray, lots: np.ndarray, rows: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """Positions of the ``nth`` draws (from 0, in the order of positions) of ``rows``; ``lots`` are running counts by lot."""
    lot = (lots[rows] <= nth[:, None]).sum(axis=1)
    past = np.where(lot > 0, lots[rows, lot - 1], 0)
    inside = np.cumsum(times.reshape(len(times), -1, LOT)[rows, lot], axis=1)
    return lot * LOT + (inside <= (nth - past)[:, None]).sum(axis=1)


def _keep_freed_memory() -> None:
    """Free a large array: the C library then keeps freed memory of up to its size.

    Else the arrays of every batch go back to the system, and fetching them again takes as long as the draws.
    """
    np.empty(KEPT_BYTES, np.uint8)


def _resample(cells: np.ndarray, first: int, counts: np.ndarray, before: np.ndarray, n_cells: int, block_cells: int, texts: list[str]):
    """Sums and middle order statistics of the replicates' draws from a slice.

    ``cells`` are the sorted values of the slice's blocks, ``first`` is the number of the first one,
    ``counts`` the draws of each replicate in each, ``before`` those in the blocks before the slice.
    A middle value that lies in another slice is NaN.
    """
    _keep_freed_memory()
    blocks = -(-n_cells // block_cells)
    sums = np.zeros(len(texts))
    middle = [np.full(len(texts), np.nan), np.full(len(texts), np.nan)]
    ranks = [(n_cells - 1) // 2, n_cells // 2]
    before = before.copy()
    for k in range(counts.shape[1]):
        held = cells[k * block_cells : (k + 1) * block_cells]
        size, names, most = len(held), _block_texts(texts, first + k, blocks), counts[:, k]
        step = min(1024, max(1, DRAWN_AT_ONCE // max(size, int(most.max()))))
        for at in range(0, len(texts), step):
            rows = slice(at, min(at + step, len(texts)))
            n, coef = most[rows], _coefficients(names[rows])
            own = [rank - before[rows] for rank in ranks]
            if not np.any([(0 <= x) & (x < n) for x in own]):
                sums[rows] += _drawn_sums(coef, n, held)  # no counts are needed, and fetching values is quicker
                continue
            times = _times_drawn(coef, n, size)
            sums[rows] += _weighted_sums(times, held)
            lots = np.cumsum((times.reshape(-1, LOT) @ np.ones(LOT)).reshape(len(n), -1), axis=1)
            for x, found in zip(own, middle):
                here = np.flatnonzero((0 <= x) & (x < n))
                found[at + here] = held[_nth_drawn(times, lots, here, x[here])]
        before += most
    return sums, *middle


def _key_text(keys: list[str]) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("NULL")) for k in keys])


def bootstrap_replicates(
    binned: DataFrame,
    keys: list[str] = S.SUMMARY_KEYS,
    value: str = "norm_psmad2",
    n_boot: int = 1000,
    seed: int = 0,
    slice_cells: int = SLICE_CELLS,
    block_cells: int = BLOCK_CELLS,
    mode: str = "exact",
    row_id: str = "cell_id",
    names: DataFrame | None = None,
) -> DataFrame:
    """One row per condition, bin and replicate: keys, ``bin_id``, ``replicate_no``,
    ``boot_mean``, ``boot_median``, ``n_cells``.

    ``slice_cells`` is what a task holds at once, in whole blocks; it changes no number.  ``block_cells``
    is part of the tree: other blocks are other draws.  With ``mode="poisson"`` cells get random weights by
    their ``row_id`` instead of being drawn, see ``poisson``.

    ``names`` has a row for each combination of ``keys`` if these are short codes: its other columns are what
    they stand for and make the text that draws depend on, so that they need not travel with every cell.
    """
    if mode == "poisson":
        if names is not None:
            raise ValueError("names are for mode 'exact'")
        return poisson_replicates(binned, keys, value, n_boot, seed, row_id, _key_text, _coefficients)
    if mode != "exact":
        raise ValueError("mode must be 'exact' or 'poisson'")
    spark = binned.sparkSession
    group = [*keys, "bin_id"]
    cells = binned.where(
        F.col("bin_id").isNotNull() & F.col(value).isNotNull() & ~F.isnan(value)
    ).select(*group, F.col(value).cast("double").alias("__x"))
    runs = materialize(cells.groupBy(*group, "__x").agg(F.count(F.lit(1)).alias("__c")))
    sizes = materialize(runs.groupBy(*group).agg(F.sum("__c").alias("n_cells")))
    seen = sizes.agg(F.max("n_cells").alias("top"), F.sum("n_cells").alias("all")).first()
    told = group if names is None else [*(c for c in names.columns if c not in keys), "bin_id"]
    sizes = sizes if names is None else attach(sizes, names, keys)
    sizes = sizes.select(*group, "n_cells", _key_text(told).alias("__key"))
    # Draws are many times the bytes: the number of tasks follows them.
    tasks = max(spark.sparkContext.defaultParallelism * 2, (seen["all"] or 0) * n_boot // DRAWS_PER_TASK)
    per_slice = max(1, slice_cells // block_cells)
    one = F.col("n_cells") <= per_slice * block_cells
    some_large = (seen["top"] or 0) > per_slice * block_cells
    rows = attach(runs, sizes.where(one).select(*group), group, "left_semi") if some_large else runs
    each = _whole_bins(rows, sizes.where(one), group, n_boot, seed, block_cells, tasks)
    if some_large:
        large = sizes.where(~one)
        placed = materialize(running_count(attach(runs, large.drop("__key"), group), group, "__x", "__c", "__upto"))
        # Replicates that walk the tree together: enough of such sets for the cores, and counts that fit a task.
        walks = large.count() * n_boot // (8 * spark.sparkContext.defaultParallelism)
        together = max(1, min(64, n_boot, walks, WALKED_AT_ONCE * block_cells // seen["top"]))
        each = each.unionByName(
            _sliced_bins(placed, large, group, n_boot, seed, block_cells, per_slice, tasks, together)
        )
    return each.select(
        *group,
        "replicate_no",
        (F.col("sums") / F.col("n_cells")).alias("boot_mean"),
        ((F.col("mid_lo") + F.col("mid_hi")) / 2).alias("boot_median"),
        "n_cells",
    )


def _texts(seed: int, key: str, numbers) -> list[str]:
    start = f"{seed}|{key}|"
    return [start + b for b in map(str, numbers)]


def _schemas(fields: list[T.StructField]) -> tuple[T.StructType, pa.Schema]:
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in fields])
    return schema, pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in schema])


def _lists(rows: DataFrame, group: list[str]) -> tuple[T.StructType, pa.Schema]:
    """Keys and the replicates of one task as arrays."""
    made = [("n_cells", T.LongType()), ("replicate_no", T.ArrayType(T.IntegerType()))]
    made += [(name, T.ArrayType(T.DoubleType())) for name in ("sums", "mid_lo", "mid_hi")]
    return _schemas([rows.schema[c] for c in group] + [T.StructField(n, t) for n, t in made])


def _row(first: pa.Table, group: list[str], schema: pa.Schema, n: int, numbers: np.ndarray, made) -> pa.Table:
    columns = [first.column(c).combine_chunks() for c in group]
    columns += [pa.array([n], pa.int64()), pa.array([numbers.astype(np.int32)], pa.list_(pa.int32()))]
    columns += [pa.array([m], pa.list_(pa.float64())) for m in made]
    return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)


def _unpacked(parts: DataFrame, group: list[str]) -> DataFrame:
    return parts.select(
        *group, "n_cells", F.inline(F.arrays_zip("replicate_no", "sums", "mid_lo", "mid_hi"))
    )


def _whole_bins(rows: DataFrame, sizes: DataFrame, group: list[str], n_boot: int, seed: int, block_cells: int, tasks: int) -> DataFrame:
    """Replicates of bins of one slice, each in one task."""
    schema, arrow = _lists(rows, group)

    def resample(table: pa.Table, bin_: pa.Table) -> pa.Table:
        if not table.num_rows or not bin_.num_rows:
            return arrow.empty_table()
        values, counts = (table.column(c).to_numpy() for c in ("__x", "__c"))
        order = np.argsort(values)
        n, numbers = int(counts.sum()), np.arange(n_boot) + 1
        texts = _texts(seed, bin_.column("__key")[0].as_py(), numbers.tolist())
        drawn = block_counts(n, block_cells, texts)
        made = _resample(np.repeat(values[order], counts[order]), 0, drawn, np.zeros(n_boot, np.int64), n, block_cells, texts)
        return _row(bin_, group, arrow, n, numbers, made)

    values, bins = rows.repartition(tasks, *group), sizes.repartition(tasks, *group)
    return _unpacked(values.groupBy(*group).cogroup(bins.groupBy(*group)).applyInArrow(resample, schema), group)


def _sliced_bins(
    rows: DataFrame, sizes: DataFrame, group: list[str], n_boot: int, seed: int, block_cells: int, per_slice: int, tasks: int, together: int = 1
) -> DataFrame:
    """Replicates of bins of several slices; a tree is walked for ``together`` of them at once."""
    work = (
        sizes.withColumn("__b", F.explode(F.sequence(F.lit(1), F.lit(n_boot), F.lit(together))))
        .repartition(tasks, *group, "__b")
    )
    keys = [sizes.schema[c] for c in group]
    own = [("__key", T.StringType()), ("__b", T.IntegerType()), ("__slice", T.IntegerType()), ("__before", T.LongType())]
    told, told_arrow = _schemas(keys + [T.StructField(n, t) for n, t in [*own, ("__counts", T.ArrayType(T.LongType()))]])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each replicate, the draws in the blocks of every slice and before it."""
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                n, b, key = (row.column(c)[0].as_py() for c in ("n_cells", "__b", "__key"))
                numbers = np.arange(b, min(b + together, n_boot + 1))
                counts = block_counts(n, block_cells, _texts(seed, key, numbers.tolist()))
                cuts = np.arange(0, counts.shape[1], per_slice)
                slices = np.arange(len(cuts))
                for number, own in zip(numbers, counts):
                    sums = np.add.reduceat(own, cuts)
                    lists = pa.ListArray.from_arrays(pa.array(np.append(cuts, len(own)), pa.int32()), pa.array(own))
                    same = [row.column(c).take(pa.array(0 * slices)) for c in [*group, "__key"]]
                    columns = [*same, pa.array(number + 0 * slices), pa.array(slices), pa.array(np.cumsum(sums) - sums), lists]
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, told_arrow)], schema=told_arrow)

    size = F.lit(per_slice * block_cells).cast("long")
    start = F.col("__upto") - F.col("__c")
    held = (
        rows.withColumn(
            "__slice",
            F.explode(F.sequence(F.floor(start / size).cast("int"), F.floor((F.col("__upto") - 1) / size).cast("int"))),
        )
        .withColumn(
            "__in", F.least(F.col("__upto"), (F.col("__slice") + 1) * size) - F.greatest(start, F.col("__slice") * size)
        )
        .select(*group, "__slice", "n_cells", "__x", "__in")
    )
    schema, arrow = _lists(sizes, group)

    def resample(values: pa.Table, draws: pa.Table) -> pa.Table:
        if not values.num_rows or not draws.num_rows:
            return arrow.empty_table()
        values = values.sort_by("__x")
        cells = np.repeat(values.column("__x").to_numpy(), values.column("__in").to_numpy())
        n, k = values.column("n_cells")[0].as_py(), draws.column("__slice")[0].as_py()
        numbers = draws.column("__b").to_numpy()
        counts = np.array(draws.column("__counts").to_pylist(), np.int64)
        texts = _texts(seed, draws.column("__key")[0].as_py(), numbers.tolist())
        made = _resample(cells, k * per_slice, counts, draws.column("__before").to_numpy(), n, block_cells, texts)
        return _row(values.slice(0, 1), group, arrow, n, numbers, made)

    part = [*group, "__slice"]
    values, draws = held.repartition(tasks, *part), work.mapInArrow(walk, told).repartition(tasks, *part)
    both = values.groupBy(*part).cogroup(draws.groupBy(*part)).applyInArrow(resample, schema)
    return _unpacked(both, group).groupBy(*group, "n_cells", "replicate_no").agg(
        F.sum("sums").alias("sums"),
        F.max(F.nanvl("mid_lo", F.lit(None))).alias("mid_lo"),
        F.max(F.nanvl("mid_hi", F.lit(None))).alias("mid_hi"),
    )


def bootstrap_summary(replicates: DataFrame, keys: list[str], value: str = "norm_psmad2") -> DataFrame:
    """Mean over replicates and 2.5% / 97.5% quantiles, per condition and bin."""
    group = [*keys, "bin_id"]

    def ends(column: str, name: str) -> list[Column]:
        q = F.percentile(column, F.array(F.lit(0.025), F.lit(0.975)))
        return [F.avg(column).alias(name), q[0].alias(f"{name}_low"), q[1].alias(f"{name}_high")]

    return replicates.groupBy(*group).agg(
        *ends("boot_mean", f"mean_{value}"),
        *ends("boot_median", f"median_{value}"),
        F.first("n_cells").alias("n_cells"),
    )


def bootstrap_bins(
    binned: DataFrame,
    keys: list[str] = S.SUMMARY_KEYS,
    value: str = "norm_psmad2",
    n_boot: int = 1000,
    seed: int = 0,
    slice_cells: int = SLICE_CELLS,
    block_cells: int = BLOCK_CELLS,
    mode: str = "exact",
    row_id: str = "cell_id",
    names: DataFrame | None = None,
) -> DataFrame:
    """Bootstrap summary per condition and bin, with ``n_cells``."""
    reps = bootstrap_replicates(binned, keys, value, n_boot, seed, slice_cells, block_cells, mode, row_id, names)
    return bootstrap_summary(reps, keys, value)
