"""Sharding by histogram sort, in DataFrame operations only.

Rows are sorted by (hash of the text, hash of id and row), a 128-bit key in which equal
texts follow each other and a large group of them can still be divided.  Splitters are the
keys below which given shares of all bytes lie.  They are found by counting exact bytes between
candidate keys: each round divides the interval that holds a splitter into PROBES and counts
again over all rows, until every splitter is within tolerance or its interval holds one row.
Then rows are exchanged once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import files

BITS = 8
PROBES = 1 << BITS
PART_BYTES = 128 << 20
ROW_BYTES = 8


def _prefix(depth: int) -> list[Column]:
    """The first ``depth`` bits of the key, in its order, as two longs."""
    low = -(1 << 63)
    high, rest = F.col("__h").bitwiseXOR(F.lit(low)), F.col("__r").bitwiseXOR(F.lit(low))
    if depth <= 64:
        return [F.shiftrightunsigned(high, 64 - depth) if depth else F.lit(0).cast("long"), F.lit(0).cast("long")]
    return [high, F.shiftrightunsigned(rest, 128 - depth)]


def splitters(sizes: DataFrame, parts: int, tolerance: int) -> list[int]:
    """Keys (128-bit, unsigned) that divide ``__h, __r, __size`` rows into ``parts`` of equal bytes.

    A splitter is off by more than ``tolerance`` bytes only if it would have to cut a row.
    """
    spark = sizes.sparkSession
    total = sizes.agg(F.sum("__size")).first()[0] or 0
    # Open splitters by number: (prefix of the interval, bytes below the interval).
    open_ = {j: (0, 0) for j in range(1, parts)} if total else {}
    found = {j: 1 << 128 for j in range(1, parts)} if not total else {}
    depth = 0
    while open_:
        wanted = sorted({p for p, _ in open_.values()})
        n1, n2 = _prefix(depth + BITS)
        probe = (n1 if depth < 64 else n2).bitwiseAND(PROBES - 1).cast("int").alias("probe")
        signed = [(_signed(p >> max(0, depth - 64)), _signed(p & ((1 << max(0, depth - 64)) - 1))) for p in wanted]
        if depth:
            which = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(signed)], "p1 long, p2 long, i int")
            p1, p2 = _prefix(depth)
            rows = sizes.select(p1.alias("p1"), p2.alias("p2"), probe, "__size")
            rows = rows.join(F.broadcast(which), ["p1", "p2"])  # at most ``parts`` rows
        else:
            rows = sizes.select(F.lit(0).alias("i"), probe, "__size")
        counted = rows.groupBy("i", "probe")
        histogram: dict[int, dict[int, tuple[int, int]]] = {}
        for i, probe_, size, n in counted.agg(F.sum("__size"), F.count("*")).collect():  # at most parts x PROBES rows
            histogram.setdefault(i, {})[probe_] = (size, n)
        depth += BITS
        for j, (prefix, below) in list(open_.items()):
            goal = total * j // parts
            cells = histogram.get(wanted.index(prefix), {})
            for probe_ in sorted(cells):
                size, n = cells[probe_]
                if below + size >= goal:
                    break
                below += size
            inner = prefix << BITS | probe_
            near_low = goal - below <= below + size - goal
            if min(goal - below, below + size - goal) <= tolerance or n == 1 or depth == 128:
                found[j] = (inner if near_low else inner + 1) << (128 - depth)
                del open_[j]
            else:
                open_[j] = (inner, below)
    return [found[j] for j in range(1, parts)]


def _signed(v: int) -> int:
    return v - (1 << 64) if v >> 63 else v


def _number_below(keys: list[int], first: int = 0) -> Column:
    """How many splitters are at or below a row's key, by binary search."""
    if not keys:
        return F.lit(first)
    mid = len(keys) // 2
    if keys[mid] >= 1 << 128:
        return _number_below(keys[:mid], first)
    h, r = _signed(keys[mid] >> 64 ^ 1 << 63), _signed(keys[mid] & ((1 << 64) - 1) ^ 1 << 63)
    below = (F.col("__h") < h) | ((F.col("__h") == h) & (F.col("__r") < r))
    return F.when(below, _number_below(keys[:mid], first)).otherwise(_number_below(keys[mid + 1 :], first + mid + 1))


def shard(
    docs: DataFrame,
    shards: int = 24,
    tolerance: float = 0.001,
    part_bytes: int = PART_BYTES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """All rows and columns of ``docs``, written by shard, with ``size, shard, slot``.

    ``size`` is the UTF-8 bytes of the text plus 8; a null text has none.  Shards hold equal bytes up to
    ``tolerance`` of a shard, or half the largest row where that is more.  Slots count a shard's rows
    in key order from 0 without gaps.  Repeated rows are rows of their own.  An empty table gives
    an empty result.  Columns of ``docs`` named like the new ones are replaced.
    """
    spark = docs.sparkSession
    folder = files.new_folder(spark, "shards")
    rows = docs.drop("size", "shard", "slot").withColumns(
        {
            "__h": F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))),
            # The last bits only tell rows apart that share text and id.
            "__r": F.xxhash64(F.col(id_col)).bitwiseAND(F.lit(-1 << 16)).bitwiseOR(
                F.xxhash64(F.monotonically_increasing_id()).bitwiseAND(F.lit((1 << 16) - 1))
            ),
            "__size": F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("long") + ROW_BYTES,
        }
    )
    sizes = files.written(rows.select("__h", "__r", "__size"), folder, "sizes")
    total = sizes.agg(F.sum("__size")).first()[0] or 0
    each = max(1, -(-total // (shards * part_bytes)))
    keys = splitters(sizes, shards * each, int(tolerance * total / shards))
    exchanged = (
        rows.withColumn("__part", _number_below(keys))
        .repartitionById(shards * each, F.col("__part"))
        .withColumn("shard", F.floor(F.col("__part") / each).cast("int"))
        .sortWithinPartitions("shard", "__h", "__r")
        .withColumn("__at", F.monotonically_increasing_id())
    )
    exchanged.write.partitionBy("shard").parquet(f"{folder}/rows")
    schema = exchanged.schema
    stored = spark.read.schema(schema).parquet(f"{folder}/rows")
    # A part is one task's rows: where it begins, and the rows of its shard before it.
    counts = {r[0]: (r[1], r[2]) for r in stored.groupBy("__part").agg(F.min("__at"), F.count("*")).collect()}
    shift, before = [], 0
    for p in range(shards * each):
        before = 0 if p % each == 0 else before
        first, n = counts.get(p, (0, 0))
        shift.append(before - first)
        before += n
    moved = F.get(F.array(*[F.lit(s).cast("long") for s in shift]), F.col("__part"))
    kept = [c for c in docs.columns if c not in ("size", "shard", "slot")]
    return stored.select(*kept, F.col("__size").alias("size"), "shard", (F.col("__at") + moved).alias("slot"))
