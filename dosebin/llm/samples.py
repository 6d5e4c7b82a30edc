"""Bounded, reproducible samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(id_col: str, folds: int = 5) -> Column:
    """crc32 of an id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds


def per_label(labelled: DataFrame, id_col: str, label_col: str, most: int) -> tuple[DataFrame, dict]:
    """About ``most`` rows, as many of each label, chosen by a hash of the id; and all labels' counts.

    The chance to be chosen follows from the label's count, so no group is sorted or
    collected.  Labels and counts go to the driver: one row per label.
    """
    counts = {r[0]: r[1] for r in labelled.groupBy(label_col).count().collect() if r[0] is not None}
    if not counts:
        return labelled.where(F.lit(False)), {}
    chance = F.lit(0.0)
    for label, n in counts.items():
        chance = F.when(F.col(label_col) == F.lit(label), min(1.0, most / len(counts) / n)).otherwise(chance)
    uniform = F.shiftrightunsigned(F.xxhash64(F.col(id_col).cast("string"), F.lit("sample")), 11) / float(1 << 53)
    return labelled.where(F.col(label_col).isNotNull() & (uniform < chance)), counts
