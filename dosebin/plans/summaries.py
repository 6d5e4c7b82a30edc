"""Summaries that take in new experiments without a look at the old ones.

Trim, gate and bins of an experiment need its own cells alone.  What later tables need of them is kept as
mergeable states, one row per condition and bin: counts, sums, extremes and a quantile sketch,
in a table partitioned by experiment.  A new experiment adds its partition; tables over several
experiments are merged from states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..operators import gates
from ..operators.sketches import ACCURACY, merge_sketches, sketch_quantiles, sketch_table
from ..session import attach
from . import analysis as A


def bin_states(binned: DataFrame, keys: list[str], value: str, accuracy: int = ACCURACY) -> DataFrame:
    """Per condition and bin: ``n``, ``total``, ``squares``, ``least``, ``most`` and a sketch of ``value``."""
    rows = binned.where(F.col("bin_id").isNotNull() & F.col(value).isNotNull() & ~F.isnan(value))
    x, group = F.col(value), [*keys, "bin_id"]
    sums = rows.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), F.sum(x).alias("total"), F.sum(x * x).alias("squares"),
        F.min(x).alias("least"), F.max(x).alias("most"),
    )
    return attach(sums, sketch_table(rows, group, [value], accuracy), group)


def merged_states(states: DataFrame, keys: list[str], value: str) -> DataFrame:
    """States of coarser groups: ``keys`` (without the bin) are some of the states' keys."""
    group = [*keys, "bin_id"]
    sums = states.groupBy(*group).agg(
        *[F.sum(c).alias(c) for c in ("n", "total", "squares")], F.min("least").alias("least"), F.max("most").alias("most")
    )
    return attach(sums, merge_sketches(states, keys=group), group)


def described(states: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Number, mean, standard deviation, extremes and (approximate) median of every state."""
    n, total = F.col("n"), F.col("total")
    spread = F.greatest(F.col("squares") - total * total / n, F.lit(0.0))
    group = [*keys, "bin_id"]
    medians = sketch_quantiles(states, group, {"median": (value, 0.5)})
    out = states.select(*group, n.alias("n"), (total / n).alias("mean"), F.sqrt(F.try_divide(spread, n - 1)).alias("sd"), "least", "most")
    return attach(out, medians, group)


def known_experiments(spark: SparkSession, path: str) -> list[str]:
    """Experiments that have states under ``path``; none if there is no table yet."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return []
    return [r[0] for r in read_states(spark, path).select("experiment").distinct().collect()]


def add_experiments(cells: DataFrame, path: str, s: A.Settings, trim_keys: list[str] = S.TRIM_KEYS_GATED, accuracy: int = ACCURACY) -> list[str]:
    """Analyse the experiments of ``cells`` that have no states under ``path`` yet and add theirs; returns their names.

    ``cells`` stored by experiment are read for the new ones only.  Experiments go by text.
    """
    known = known_experiments(cells.sparkSession, path)
    there = [r[0] for r in cells.select(F.col("experiment").cast("string")).distinct().collect()]  # names of folders
    new = sorted(set(there) - set(known))
    if new:
        rows = cells.where(F.col("experiment").isin(new))
        kept = A.gated_cells(gates.trim_outliers(rows, trim_keys), s)
        states = bin_states(A.bin_cells(kept, s), list(s.summary_keys), s.signal, accuracy)
        states.write.mode("append").partitionBy("experiment").parquet(path)
    return new


def read_states(spark: SparkSession, path: str) -> DataFrame:
    """States of all experiments; the names of their folders are text, also where they look like numbers."""
    found = spark.read.parquet(path).schema
    text = T.StructType([T.StructField(f.name, T.StringType()) if f.name == "experiment" else f for f in found])
    return spark.read.schema(text).parquet(path)
