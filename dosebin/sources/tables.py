"""Cell tables in the shape of the analysis, as views over the driver's star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import session
from ..functions import log_channel, log_ratio

LINE_ITEM = "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_linestatus l_shipdate".split()
_LANDED: dict[tuple, tuple[DataFrame, set[str]]] = {}


def landed_table(spark: SparkSession, folder: str, name: str, columns: list[str]) -> DataFrame:
    """Some columns of a table; a table of few row groups is stored once a session in as many files as there are cores.

    It is stored again when its files change or ``release_tables`` has deleted it.
    """
    table = read_table(spark, folder, name).select(*columns)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    files = [spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f) for f in sorted(table.inputFiles())]
    seen = tuple((f.toString(), f.getFileSystem(conf).getFileStatus(f).getModificationTime()) for f in files[:1000])
    key = (spark.sparkContext.applicationId, name, *columns, len(files), seen)
    if key not in _LANDED or not _LANDED[key][1] <= set(session.written_tables()):
        before = set(session.written_tables())
        stored = session.landed(table)
        _LANDED[key] = stored, set(session.written_tables()) - before
    return _LANDED[key][0]


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def content_id(*columns: str) -> str:
    """SQL of a 60-bit integer from the text of a row's columns; equal rows get equal ids."""
    text = ", ".join(f"cast({c} as string)" for c in columns)
    return f"cast(conv(substring(md5(concat_ws('|', {text})), 1, 15), 16, 10) as bigint)"


def raw_cells(spark: SparkSession, folder: str) -> DataFrame:
    """One cell per line item: condition columns and linear channels."""
    cents = [f"cast(round({c} * 100) as bigint)" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")]
    return landed_table(spark, folder, "lineitem", LINE_ITEM).selectExpr(
        "cast(year(l_shipdate) as string) as experiment",
        "case when l_linenumber <= 5 then 'R3' else 'Luc' end as cell_line",
        "case when l_linestatus = 'F' then '-dox' else '+dox' end as dox",
        "case l_orderkey % 5 when 0 then 'No Cyto' when 4 then 'GDF11' else 'TGFB1' end as ligand",
        "case l_orderkey % 5 when 0 then 0D when 1 then 0.1D when 2 then 1D when 3 then 3.16D else 2.5D end as ligand_conc",
        "cast(l_suppkey % 2 + 1 as int) as replicate",
        "case when l_suppkey % 3 = 0 then 'DAPI' else 'Singlet' end as gate",
        "get(array(0D, 0.316D, 1D, 3.16D), cast(l_orderkey % 4 as int)) as tgfb1",
        "get(array(0D, 2.5D, 7.9D, 25D), cast(l_suppkey % 4 as int)) as gdf11",
        "cast(l_partkey + 10 as double) as ha",
        "l_quantity as psmad2",
        "l_extendedprice as smad2",
        "cast(l_suppkey as double) as dapi",
        content_id("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *cents) + " as cell_id",
    )


def log_cells(raw: DataFrame, zero: str = "drop") -> DataFrame:
    """Log channels, drop incomplete rows, add the signal ratio."""
    logged = raw
    for c in ("ha", "psmad2", "smad2"):
        logged = logged.withColumn(c, log_channel(F.col(c), zero))
    return logged.dropna(subset=["ha", "psmad2", "smad2"]).withColumn(
        "norm_psmad2", log_ratio(F.col("psmad2"), F.col("smad2"))
    )


def cells(spark: SparkSession, folder: str) -> DataFrame:
    return log_cells(raw_cells(spark, folder))
