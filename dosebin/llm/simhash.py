"""SimHash near-duplicates with pigeonring candidate filtering.

A 64-bit fingerprint is a ring of eight segments of eight bits.  If two fingerprints differ
in at most 3 bits, there is a start from which every chain of l segments in a row differs in at
most 3 l / 8 bits: none in the first two, one in the first five, two in the first seven.  So
the first two segments are equal and two of the next three are; these 32 bits, for each start and
choice, are the keys by which candidates meet.  Chains are checked before all 64 bits are.

Only distinct fingerprints are compared.  A key's fingerprints give star edges of their
components, never all pairs.  Keys with many are keyed again by a quarter of their other bits,
of which one must agree; after three times at most 14 bits are left, which bounds them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import files
from .components import connected
from .encode import slices

SEED = 42
MOST_BITS = 3
LARGE_KEY = 2048
LAST_LEVEL = 3


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Fingerprint of a whole text; 0 if it has no word.  Memory is bounded by its slices."""
    ones, n, before = np.zeros(64, np.int64), 0, []
    digest = xxhash.xxh64_intdigest
    count = 0
    for piece in slices((text or "").encode().lower()):
        words = before + piece.split()
        count += len(words) - len(before)
        if len(words) >= shingle:
            line = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            starts = np.r_[0, ends[:-1]]
            cuts = zip(starts[: len(words) - shingle + 1].tolist(), (ends[shingle - 1 :] - 1).tolist())
            h = np.array([digest(line[a:b], SEED) for a, b in cuts], "<u8")
            for k in range(0, len(h), 1 << 15):
                ones += np.unpackbits(h[k : k + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            n += len(h)
        before = words[-(shingle - 1) :] if shingle > 1 else []
    if not count:
        return 0
    if count < shingle:
        return digest(b" ".join(before), SEED)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (default: all) of every row with its fingerprint as a long, ``__fp``."""
    keep = docs.columns if keep is None else keep
    rows = docs.select(*keep, F.col(text_col).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in batch.column("__text")], "<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fps)], [*keep, "__fp"])

    return rows.mapInArrow(run, rows.drop("__text").withColumn("__fp", F.lit(0).cast("long")).schema)


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _segments(start: int, which: tuple[int, ...]) -> int:
    return sum(0xFF << 8 * ((start + k) % 8) for k in which)


def _tables() -> list[tuple[int, int]]:
    """(start, key mask) of each table."""
    return [(s, _segments(s, (0, 1, *two))) for s in range(8) for two in ((2, 3), (2, 4), (3, 4))]


def _finer(mask: int) -> list[int]:
    """Key masks that add a quarter of the bits that ``mask`` leaves out."""
    rest = [b for b in range(64) if not mask >> b & 1]
    cut = [rest[len(rest) * k // 4 : len(rest) * (k + 1) // 4] for k in range(4)]
    return [mask | sum(1 << b for b in bits) for bits in cut]


def _stars(fps: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Star edges of the components that links of one key's distinct fingerprints make."""
    fps = np.sort(fps)
    chains = [(np.uint64(_segments(start, tuple(range(n)))), n * MOST_BITS // 8) for n in (5, 7)]
    root = np.full(len(fps), -1)
    for seed in range(len(fps)):
        if root[seed] >= 0:
            continue
        root[seed], todo = seed, [seed]
        while todo:
            at = todo.pop()
            open_ = np.flatnonzero(root < 0)
            diff = fps[open_] ^ fps[at]
            for mask, most in chains:
                near = np.bitwise_count(diff & mask) <= most
                open_, diff = open_[near], diff[near]
            found = open_[np.bitwise_count(diff) <= MOST_BITS]
            root[found] = seed
            todo.extend(found.tolist())
    other = root != np.arange(len(fps))
    return fps[root[other]], fps[other]


def _bucket_edges(starts: list[int]):
    """Edges of rows sorted by (table, key), a key's rows following each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t0, k0, held = None, None, []

        def flush():
            if held and t0 is not None:
                fps = np.concatenate(held)
                if len(fps) > 1:
                    u, v = _stars(fps, starts[t0])
                    if len(u):
                        yield pa.RecordBatch.from_arrays([pa.array(u.view("<i8")), pa.array(v.view("<i8"))], ["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            t, k, fp = (batch.column(i).to_numpy() for i in range(3))
            cuts = np.flatnonzero((t[1:] != t[:-1]) | (k[1:] != k[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(t)]):
                if (int(t[a]), int(k[a])) != (t0, k0):
                    yield from flush()
                    t0, k0, held = int(t[a]), int(k[a]), []
                held.append(fp[a:b].astype("<i8").view("<u8"))
        yield from flush()

    return run


def links(distinct: DataFrame, folder: str) -> DataFrame:
    """Edges ``u, v`` that connect all distinct fingerprints (``fp``) as their links do."""
    tables = _tables()
    rows, found = distinct.select("fp", F.lit(-1).alias("old")), []
    for level in range(LAST_LEVEL + 1):
        if level:
            tables = [(s, m) for s, mask in tables for m in _finer(mask)]
            masks = F.array(*[F.lit(_signed(m)) for _, m in tables])
            keyed = rows.withColumn("t", F.explode(F.array(*[F.col("old") * 4 + i for i in range(4)])))
            keyed = keyed.select("t", F.col("fp").bitwiseAND(F.get(masks, F.col("t"))).alias("key"), "fp")
        else:
            each = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, (_, m) in enumerate(tables)])
            keyed = rows.select(F.explode(each).alias("k"), "fp").select("k.t", "k.key", "fp")
        counts = keyed.groupBy("t", "key").agg(F.count("*").alias("n"), F.min("fp").alias("u"), F.max("fp").alias("v"))
        counts = files.written(counts.where("n > 1"), folder, f"keys-{level}")
        # Two fingerprints in a key are a pair: chains first, then all bits.
        pair = counts.where("n = 2").withColumn("x", F.col("u").bitwiseXOR(F.col("v")))
        for n in (5, 7):
            mask = F.get(F.array(*[F.lit(_signed(_segments(s, tuple(range(n))))) for s, _ in tables]), F.col("t"))
            pair = pair.where(F.bit_count(F.col("x").bitwiseAND(mask)) <= n * MOST_BITS // 8)
        found.append(pair.where(F.bit_count("x") <= MOST_BITS).select("u", "v"))
        most = LARGE_KEY if level < LAST_LEVEL else 1 << 62
        some = counts.where(F.col("n").between(3, most)).select("t", "key")
        sorted_ = keyed.join(some, ["t", "key"]).select("t", "key", "fp").repartition("t", "key").sortWithinPartitions("t", "key")
        found.append(sorted_.mapInArrow(_bucket_edges([s for s, _ in tables]), "u long, v long"))
        large = counts.where(F.col("n") > most).select("t", "key")
        if not large.take(1):
            break
        rows = files.written(keyed.join(large, ["t", "key"]).select("fp", F.col("t").alias("old")).distinct(), folder, f"large-{level}")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def near_duplicates(stored: DataFrame, folder: str, id_col: str = "doc_id") -> DataFrame:
    """``stored`` (stored rows with ``__fp``) with ``component_id``.

    That is the smallest id of all rows reachable over links of at most three differing bits,
    null only if none has an id.  Repeated rows share fingerprint and component; rows
    without words have fingerprint 0 and are linked like any other.
    """
    distinct = stored.groupBy(F.col("__fp").alias("fp")).agg(F.min(F.col(id_col).cast("long")).alias("first"))
    distinct = files.written(distinct, folder, "distinct")
    roots = connected(links(distinct, folder), folder)
    members = roots.select(F.col("v").alias("fp"), "root").unionByName(
        roots.select(F.col("root").alias("fp"), "root").distinct()
    )
    firsts = members.join(distinct, "fp").groupBy("root").agg(F.min("first").alias("least"))
    moved = files.written(members.join(firsts, "root").select("fp", "least"), folder, "moved")
    named = distinct.join(moved, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id"))
    return stored.join(named, stored["__fp"] == named["fp"]).drop("fp")


def with_components(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (default: all) of every row of ``docs``, ``__fp`` and ``component_id``."""
    folder = files.new_folder(docs.sparkSession, "simhash")
    stored = files.written(fingerprints(docs, shingle, text_col, keep), folder, "fingerprints")
    return near_duplicates(stored, folder, id_col)


def deduplicate(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, that with the smallest id (then of repeated rows one); all columns kept."""
    folder = files.new_folder(docs.sparkSession, "simhash")
    numbered = docs.withColumn("__uid", F.monotonically_increasing_id())
    stored = files.written(fingerprints(numbered, shingle, text_col), folder, "fingerprints")
    known = near_duplicates(stored.select(id_col, "__uid", "__fp"), folder, id_col)
    # Components are named by their smallest id; those without any share the null, told apart by fingerprint.
    lone = F.when(F.col("component_id").isNull(), F.col("__fp"))
    order = F.struct(F.col(id_col).isNull(), F.col(id_col), F.col("__uid"))
    kept = known.groupBy("component_id", lone.alias("lone")).agg(F.min(order)["__uid"].alias("__uid"))
    return stored.join(kept.select("__uid"), "__uid").select(*docs.columns)
