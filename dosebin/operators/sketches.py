"""Approximate quantiles from mergeable sketches, kept as a table of one row per group.

The exact way reads rows several times; a sketch reads them once, has a bounded size
for groups of any size, and two sketches of parts of a group make one of the whole, so
a stored table takes in new rows without a look at the old ones.  The rank of a value
found is off by about ``1.7 / accuracy`` of the group at most (99 of 100 times); a group of no more rows
than ``accuracy`` is kept whole, and its values are exact, the lower of two neighbours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACCURACY = 4096


def _present(column: str) -> Column:
    x = F.col(column).cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x), x)


def sketch_table(df: DataFrame, keys: list[str], columns: list[str], accuracy: int = ACCURACY) -> DataFrame:
    """Keys and a sketch of each of ``columns`` (``sketch_<column>``), from one scan.

    NULL and NaN are left out; a group without any value has a NULL sketch.
    """
    made = [
        F.when(F.count(_present(c)) > 0, F.kll_sketch_agg_double(_present(c), accuracy)).alias(f"sketch_{c}") for c in columns
    ]
    return df.groupBy(*keys).agg(*made)


def merge_sketches(*tables: DataFrame, keys: list[str]) -> DataFrame:
    """One table for all rows of several tables with the same columns; ``keys`` may be fewer than theirs."""
    columns = [c for c in tables[0].columns if c.startswith("sketch_")]
    both = tables[0].select(*keys, *columns)
    for t in tables[1:]:
        both = both.unionByName(t.select(*keys, *columns))
    return both.groupBy(*keys).agg(*[F.when(F.count(c) > 0, F.kll_merge_agg_double(c)).alias(c) for c in columns])


def sketch_quantiles(sketches: DataFrame, keys: list[str], wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """Quantiles per group: ``wanted`` maps output column -> (input column, probability)."""
    found = [F.kll_sketch_get_quantile_double(f"sketch_{c}", F.lit(float(q))).alias(name) for name, (c, q) in wanted.items()]
    return sketches.select(*keys, *found)
