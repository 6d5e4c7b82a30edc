"""Folders of per-sample CSV exports, as cell tables; and CSV results.

Columns are bound by name: every file's header tells at which place of a line each
channel stands, so a file with another column order or a missing channel lands in the
right columns.  Headers and lines are both read by Spark's text source; only the different
headers, not the files, come to the driver.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..functions import (
    dox_label,
    gate_label,
    legacy_cell_line,
    legacy_conc,
    legacy_ligand,
    ligand_conc,
    ligand_label,
    log_channel,
    log_ratio,
    name_field,
    replicate_number,
    sample_of_path,
    suffixed_dose,
)
from ..session import materialize


def _lines(spark: SparkSession, root: str) -> DataFrame:
    """All lines of the CSV files below ``root`` that are not blank, with the place of their block."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv")
    return (
        files.text(root)
        .where(F.trim("value") != "")
        .select("value", F.col("_metadata.file_path").alias("__path"), F.col("_metadata.file_block_start").alias("__start"))
    )


def _headers(lines: DataFrame) -> DataFrame:
    """First line of every file: ``__path, __header``.

    Lines come file by file, so all but the first of each are left out where they are scanned: an
    aggregate that keeps a text would sort all lines.
    """
    first = lines.where(F.col("__start") == 0).withColumn("__at", F.monotonically_increasing_id())
    first = first.select("__path", "value", "__at").mapInArrow(_where_path_changes, "__path string, value string, __at long")
    return first.groupBy("__path").agg(F.min_by("value", "__at").alias("__header"))


def _where_path_changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose first column differs from that of the row before."""
    last = pa.scalar(None, pa.string())
    for batch in batches:
        if batch.num_rows:
            path = batch.column(0)
            inner = pc.not_equal(path.slice(1), path.slice(0, len(path) - 1))
            yield batch.filter(pa.concat_arrays([pa.array([path[0] != last]), inner]))
            last = path[-1]


def _columns(header: str) -> list[str]:
    """Column names of a header line; names in quotes may hold commas."""
    return [c.strip() for c in next(csv.reader([header.removeprefix("\ufeff")], skipinitialspace=True))]


def pick_channels(columns: list[str], channels: dict[str, str], scatter: str = "FSC-A") -> dict[str, str]:
    """Export column -> analyte column.  Two matches for one channel are an error."""
    picked: dict[str, str] = {}
    for c in columns:
        if scatter in c:
            picked[c] = c.lower().replace("-", "_").replace(" ", "_")
    for prefix, analyte in channels.items():
        hits = [c for c in columns if c.startswith(prefix)]
        if len(hits) > 1:
            raise ValueError(f"{len(hits)} columns match channel {prefix}: {hits}")
        for c in hits:
            picked[c] = analyte
    return picked


def _single_ligand(sample: Column) -> dict[str, Column]:
    lig = name_field(sample, 2)
    return {
        "cell_line": name_field(sample, 0),
        "dox": dox_label(name_field(sample, 1)),
        "ligand": ligand_label(lig),
        "ligand_conc": ligand_conc(lig),
        "replicate": replicate_number(name_field(sample, 3)),
        "gate": gate_label(sample),
    }


def _no_ligand(sample: Column) -> dict[str, Column]:
    return {
        "cell_line": name_field(sample, 0),
        "dox": dox_label(name_field(sample, 1)),
        "ligand": F.when(name_field(sample, 2) == "mC", S.NO_LIGAND).otherwise("Error"),
        "replicate": replicate_number(name_field(sample, 3)),
    }


def _legacy(sample: Column) -> dict[str, Column]:
    return {
        "cell_line": legacy_cell_line(sample),
        "ligand": legacy_ligand(sample),
        "ligand_conc": legacy_conc(sample),
    }


def _two_ligand(sample: Column) -> dict[str, Column]:
    control = sample.contains("minusDox")
    return {
        "sample": F.when(control, "Minus Dox Control").otherwise(sample),
        "cell_line": F.when(control, "R3").otherwise(name_field(sample, 0)),
        "dox": F.when(control, S.MINUS_DOX).otherwise(S.PLUS_DOX),
        "tgfb1": F.when(control, F.lit(0.0)).otherwise(suffixed_dose(name_field(sample, 1), "T")),
        "gdf11": F.when(control, F.lit(0.0)).otherwise(suffixed_dose(name_field(sample, 2), "G")),
    }


def _two_ligand_replicate(sample: Column) -> dict[str, Column]:
    return {
        "cell_line": name_field(sample, 0),
        "tgfb1": suffixed_dose(name_field(sample, 1), "T"),
        "gdf11": suffixed_dose(name_field(sample, 2), "G"),
        "replicate": replicate_number(name_field(sample, 3)),
    }


@dataclass(frozen=True)
class Layout:
    """A file-name grammar and the channels to keep."""

    parse: object
    channels: dict[str, str] = field(default_factory=lambda: S.FIVE_LASER)
    three_laser: dict[str, str] | None = None
    scatter: str = "FSC-A"


LAYOUTS = {
    "single_ligand": Layout(_single_ligand),
    "no_ligand": Layout(_no_ligand, S.FIVE_LASER_NO_DAPI),
    "legacy": Layout(_legacy, S.FIVE_LASER_NO_DAPI, S.THREE_LASER, "FSC"),
    "two_ligand": Layout(_two_ligand),
    "two_ligand_old": Layout(_two_ligand, S.THREE_LASER),
    "two_ligand_replicate": Layout(_two_ligand_replicate),
}


def scan_samples(spark: SparkSession, root: str, layout: str = "single_ligand") -> DataFrame:
    """Raw cells of every sample below ``root``: name fields, linear channels, ``experiment``.

    ``experiment`` is the folder that holds the sample.  Layouts with a
    three-laser channel map also get ``instrument``, the folder above it, whose
    name decides which map applies.
    """
    kind = LAYOUTS[layout]
    lines = _lines(spark, root)
    path = F.col("__path")
    heads = _headers(lines).withColumn(
        "__three", _folder_of(path, 1).contains("3 Laser") if kind.three_laser else F.lit(False)
    )
    heads = materialize(heads)
    places: list[tuple[str, bool, dict[str, int]]] = []
    width = 1
    for r in heads.select("__header", "__three").distinct().collect():  # one row per kind of file
        columns = _columns(r["__header"])
        picked = pick_channels(columns, kind.three_laser if r["__three"] else kind.channels, kind.scatter)
        places.append((r["__header"], r["__three"], {name: columns.index(c) for c, name in picked.items()}))
        width = max(width, len(columns))
    if not places:
        raise FileNotFoundError(f"no CSV file with a header under {root}")
    names = sorted({n for *_, at in places for n in at})
    rows = [(h, t, [at.get(n) for n in names]) for h, t, at in places]
    known = spark.createDataFrame(rows, "__header string, __three boolean, __places array<int>")
    heads = heads.join(known, ["__header", "__three"]).select(
        "__path",
        "__header",
        "__places",
        sample_of_path(path).alias("sample"),
        _folder_of(path, 0).alias("experiment"),
        *([_folder_of(path, 1).alias("instrument")] if kind.three_laser else []),
    )
    own = heads.columns[3:]
    fields = kind.parse(F.col("sample"))
    sample = fields.pop("sample", None)
    heads = heads.withColumns(fields)
    # Names are parsed once per file, and written, so that the planner knows how small the table is.
    heads = materialize(heads if sample is None else heads.withColumn("sample", sample))
    data = lines.join(heads, "__path").where(~((F.col("__start") == 0) & (F.col("value") == F.col("__header"))))
    # A generator is not copied into the expressions above it: each line is parsed once, not once per channel.
    cells = F.from_csv("value", ", ".join(f"__c{i} double" for i in range(width)))
    values = F.array(*[F.col(f"__c{j}") for j in range(width)])
    return data.select(*heads.columns[2:], F.inline(F.array(cells))).select(
        *own,
        *[F.get(values, F.get("__places", F.lit(i))).alias(n) for i, n in enumerate(names)],
        *fields,
    )


_FOLDERS = r"([^/=]+)/(?:[a-z_]+=)?([^/=]+)/(?:[a-z_]+=)?[^/=]+\.csv(?:/part-[^/]*)?$"


def _folder_of(path: Column, up: int) -> Column:
    decoded = F.url_decode(F.regexp_replace(path, r"\+", "%2B"))
    return F.regexp_extract(decoded, _FOLDERS, 2 - up)


def load_cells(
    spark: SparkSession, root: str, layout: str = "single_ligand", zero: str = "drop"
) -> DataFrame:
    """Scan, log channels, drop incomplete rows, add the ratio.  Trim with ``trim_outliers``."""
    raw = scan_samples(spark, root, layout)
    measured = [f.name for f in raw.schema if isinstance(f.dataType, T.DoubleType)]
    logged = raw.withColumns({c: log_channel(F.col(c), zero) for c in ("ha", "psmad2", "smad2")})
    keys = [c for c in raw.columns if c not in measured]
    return logged.dropna(how="any", subset=[*keys, *measured]).withColumn(
        "norm_psmad2", log_ratio(F.col("psmad2"), F.col("smad2"))
    )


def land(cells: DataFrame, path: str, by: str = "experiment") -> None:
    """Write scanned cells as Parquet, one folder per experiment, for pruned and pushed-down reads."""
    cells.write.mode("overwrite").partitionBy(by).parquet(path)


def write_samples(cells: DataFrame, root: str, folders: list[str], sample: str = "sample") -> None:
    """Write cells as a tree of per-sample CSV folders of part files, ``<sample>.csv`` each.

    Rows are brought together by sample first, else every task writes a file of every sample; adaptive
    execution divides a large sample over several tasks.
    """
    named = cells.withColumn(sample, F.concat(F.col(sample), F.lit(".csv")))
    named.hint("rebalance", *folders, sample).write.mode("overwrite").option("header", True).partitionBy(*folders, sample).csv(root)


def write_result(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_result(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV result with its types stated, never inferred."""
    return spark.read.option("header", True).schema(schema).csv(path)
