"""Packing documents into fixed-length sequences by swap-based local search.

Documents are encoded once and only those longer than a sequence are cut.  Pieces of a
full sequence stand alone.  The rest are dealt by hash into blocks of some thousand
pieces.  A block is filled best-fit, then improved by moving a document, exchanging
one for one, or two for one, between bins that are not full, always from the emptier to
the fuller bin, so that the sum of squared fills grows; the emptiest bins run dry.
The bins a block could not fill are pooled with those of other blocks and packed again in
blocks of the same size, round by round, until one block is left or pooling frees no more
bins, so the loss does not grow with the blocks.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import files
from .encode import encoder

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, width int, ids binary"
BLOCK_PIECES = 4096
POOLED_FILL = 0.97


def cut_pieces(
    docs: DataFrame,
    vocabulary: str,
    capacity: int = 4096,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Ids of every whole text with the end id, cut after each ``capacity`` ids.

    A null text is empty: one piece with the end id alone.  Repeated rows and rows that
    share an id give pieces of their own.
    """
    code = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(code.value)
        end = np.array([end_id], enc.dtype).tobytes()
        width = enc.dtype.itemsize
        names = [x.split(" ")[0] for x in PIECE.split(", ")]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                some, rows = batch.slice(i, 64), []
                for doc, data in zip(some.column(0).to_pylist(), enc.encode(some.column(1).to_pylist())):
                    data += end
                    for k in range(0, len(data), capacity * width):
                        ids = data[k : k + capacity * width]
                        crc = zlib.crc32(np.frombuffer(ids, enc.dtype).astype("<u4").tobytes())
                        rows.append((doc, k // (capacity * width), k // width, len(ids) // width, crc, width, ids))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")
    ).mapInArrow(cut, PIECE)


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each length: longest first, each into the fullest bin that takes it."""
    bins = np.empty(len(lengths), np.int64)
    gaps: list[tuple[int, int]] = []  # (gap, bin), ascending
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        at = bisect_left(gaps, (n, -1))
        if at < len(gaps):
            gap, b = gaps.pop(at)
        else:
            gap, b = capacity, i
        bins[i] = b
        if gap > n:
            insort(gaps, (gap - n, b))
    return np.unique(bins, return_inverse=True)[1].reshape(-1)


def _sums(lengths: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, list[tuple[int, ...]]]:
    """Ascending sums of one or two of ``own``, each once with documents that have it; one is preferred to two."""
    by_length: dict[int, list[int]] = {}
    for i in own.tolist():
        by_length.setdefault(int(lengths[i]), []).append(i)
    found: dict[int, tuple[int, ...]] = {n: (some[0],) for n, some in by_length.items()}
    sizes = sorted(by_length)  # few: different lengths of one bin
    for x, n in enumerate(sizes):
        if len(by_length[n]) > 1:
            found.setdefault(2 * n, tuple(by_length[n][:2]))
        for m in sizes[x + 1 :]:
            found.setdefault(n + m, (by_length[n][0], by_length[m][0]))
    sums = sorted(found)
    return np.array(sums, np.int64), [found[s] for s in sums]


def improve(lengths: np.ndarray, bins: np.ndarray, capacity: int) -> np.ndarray:
    """Exchange documents between underfull bins until no bin can be emptied.

    One bin at a time gives, the emptiest first.  The most that another, at least as full
    bin can gain by a move, a one-for-one or a two-for-one exchange of any of their documents
    is done first; every exchange makes the squared fill grow, so this ends.  It stops when the bins
    are as few as the sum of lengths allows, or when every underfull bin was tried since one was emptied.
    """
    lengths, bins = lengths.astype(np.int64), bins.copy()
    fill = np.bincount(bins, weights=lengths).astype(np.int64)
    fewest = -(-int(lengths.sum()) // capacity)
    given: set[int] = set()
    while (fill > 0).sum() > fewest:
        live = [b for b in np.argsort(fill, kind="stable").tolist() if 0 < fill[b] < capacity and b not in given]
        if not live:
            break
        giver = live[0]
        while fill[giver] > 0:
            own = np.flatnonzero(bins == giver)
            gap = capacity - fill
            open_ = np.flatnonzero((bins != giver) & (gap[bins] > 0) & (fill[bins] >= fill[giver]))
            best = (0, None)
            takers = np.flatnonzero((gap > 0) & (fill >= fill[giver]) & (fill > 0))
            takers = takers[takers != giver]
            for i in own.tolist():  # a move into the tightest bin
                fit = takers[gap[takers] >= lengths[i]]
                if len(fit) and lengths[i] > best[0]:
                    best = (int(lengths[i]), ((i,), None, int(fit[np.argmin(gap[fit])])))
            if best[1] is None and len(open_):
                theirs, room = lengths[open_], gap[bins[open_]]
                sums, groups = _sums(lengths, own)
                most = np.searchsorted(sums, theirs + room, "right") - 1  # the largest sum that fits
                gain = np.where(most >= 0, sums[most] - theirs, 0)
                k = int(np.argmax(gain))
                if gain[k] > 0:
                    best = (int(gain[k]), (groups[most[k]], int(open_[k]), int(bins[open_[k]])))
            if best[1] is None:
                given.add(giver)
                break
            g, back, taker = best[1]
            bins[list(g)] = taker
            if back is not None:
                bins[back] = giver
            fill[taker] += best[0]
            fill[giver] -= best[0]
        else:
            given.clear()
    return bins


def _pack_block(pdf: pd.DataFrame, capacity: int, last: bool) -> pd.DataFrame:
    pdf = pdf.sort_values("uid", kind="stable")
    lengths = pdf["length"].to_numpy(np.int64)
    bins = improve(lengths, best_fit(lengths, capacity), capacity)
    fill = np.bincount(bins, weights=lengths)
    done = np.full(len(fill), True)
    if not last:
        used = np.flatnonzero(fill > 0)
        done = fill >= POOLED_FILL * capacity
        done[used[np.argmin(fill[used])]] = False
    order = np.argsort(bins, kind="stable")
    sizes, of = lengths[order], bins[order]
    ends = np.cumsum(sizes)
    first = np.r_[True, of[1:] != of[:-1]]
    offsets = ends - sizes - np.repeat((ends - sizes)[first], np.diff(np.r_[np.flatnonzero(first), len(of)]))
    return pd.DataFrame(
        {
            "uid": pdf["uid"].to_numpy()[order],
            "length": sizes,
            "block": pdf["block"].to_numpy()[order],
            "bin": of,
            "offset": offsets,
            "done": done[of],
        }
    )


def _packer(capacity: int, last: bool):
    def pack_one(pdf: pd.DataFrame) -> pd.DataFrame:
        return _pack_block(pdf, capacity, last)

    return pack_one


def pack(pieces: DataFrame, capacity: int = 4096, block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """Place ``(uid, length)`` rows: returns ``uid, sequence_id, offset``.

    ``uid`` must be unique and its rows stored, not recomputed.  Offsets of a sequence are gapless
    from 0.  An empty table gives no rows.
    """
    spark = pieces.sparkSession
    folder = files.new_folder(spark, "packing")
    schema = "uid long, length long, block long, bin long, offset long, done boolean"
    rest = pieces.where(F.col("length") < capacity).select("uid", "length")
    zero = F.lit(0).cast("long")
    placed = [
        pieces.where(F.col("length") >= capacity).select("uid", (-1 - F.col("uid")).alias("sequence_id"), zero.alias("offset"))
    ]
    blocks, number = max(1, -(-rest.count() // block_pieces)), 0
    shrinks = True
    while True:
        last = blocks == 1 or not shrinks
        dealt = rest.withColumn("block", F.pmod(F.xxhash64("uid", F.lit(number)), F.lit(blocks)))
        packed = files.written(
            dealt.groupBy("block").applyInPandas(_packer(capacity, last), schema),
            folder,
            f"round-{number}",
        )
        sequence = F.lit(number << 56) + F.shiftleft("block", 24) + F.col("bin")
        placed.append(packed.where("done").select("uid", sequence.alias("sequence_id"), "offset"))
        if last:
            break
        rest = packed.where(~F.col("done")).select("uid", "length")
        # Blocks stay as large as they are; where most pieces cannot be placed well, pooling is of no more use.
        left = max(1, -(-rest.count() // block_pieces))
        shrinks, blocks, number = left <= 0.7 * blocks, left, number + 1
    out = placed[0]
    for more in placed[1:]:
        out = out.unionByName(more)
    return out


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 1, **names) -> DataFrame:
    """Pieces of all documents with their ids and places: PIECE columns, ``sequence_id, offset``."""
    folder = files.new_folder(docs.sparkSession, "packing")
    numbered = cut_pieces(docs, vocabulary, capacity, end_id, **names).withColumn("uid", F.monotonically_increasing_id())
    pieces = files.written(numbered, folder, "pieces")
    return pieces.join(pack(pieces, capacity), "uid").drop("uid")


def sequences(packed: DataFrame) -> DataFrame:
    """Ids of each sequence, its pieces in order: ``sequence_id, ids`` (binary, as in the pieces)."""
    rows = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # a sequence holds at most its capacity
    return packed.groupBy("sequence_id").agg(
        F.aggregate(rows, F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"), F.sum("length").alias("length")
    )
