"""Session set-up and the shared-folder tables that cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_WRITTEN: list[str] = []


def local_session(app: str = "dosebin", cores: str = "*", partitions: int = 8) -> SparkSession:
    """Session for tests and single-machine runs."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", "4096")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        # Call sites of columns for error messages take several round trips to the JVM each.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local-mode session without the setting gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="dosebin-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    elif not spark.sparkContext.master.startswith("local"):
        place = folder.removeprefix("file:").replace("//", "/")
        if place.startswith(tempfile.gettempdir() + "/"):
            raise RuntimeError(f"{folder} is a temporary folder of one machine; executors do not share it")
    return folder.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Used for per-group summaries that several later steps join to: they are
    computed once, survive lost executors, and carry file sizes, so the planner
    broadcasts them when they are under ``spark.sql.autoBroadcastJoinThreshold``
    and uses a shuffle join when they are not.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def landed(scan: DataFrame) -> DataFrame:
    """``scan`` itself, or its rows stored once in as many files as there are cores.

    Files of a few row groups are read by a few tasks however many cores there are, and so is
    everything up to the first shuffle; such rows are dealt over the cores once.  A scan of as many splits
    as cores is left as it is: it is never shuffled for this.  ``scan`` must be a plain scan and projection.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else materialize(scan.repartition(cores))


def written_tables() -> list[str]:
    """Folders that ``materialize`` has written and ``release_tables`` has not deleted."""
    return list(_WRITTEN)


def release_tables(spark: SparkSession) -> int:
    """Delete the tables that ``materialize`` has written so far; results not read yet need them."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    done = 0
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        done += path.getFileSystem(conf).delete(path, True)
    return done


def attach(df: DataFrame, summary: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join per-group columns of ``summary`` onto the rows of ``df``.

    Keys match null-safely: a NULL key is a group of its own.  Without keys the
    summary is one row, whose values become constants.
    """
    if not keys:
        row = summary.first()
        if row is None:
            return df.where(F.lit(False)).withColumns(
                {f.name: F.lit(None).cast(f.dataType) for f in summary.schema}
            )
        return df.withColumns(
            {f.name: F.lit(row[f.name]).cast(f.dataType) for f in summary.schema}
        )
    renamed = summary.selectExpr(
        *[f"`{k}` as `__k_{k}`" for k in keys], *[f"`{c}`" for c in summary.columns if c not in keys]
    )
    cond = F.expr(" and ".join(f"`{k}` <=> `__k_{k}`" for k in keys))
    return df.join(renamed, cond, how).drop(*[f"__k_{k}" for k in keys])
