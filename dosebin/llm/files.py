"""Binary files that tasks write to and read from the shared folder.

Spark has no sink for raw bytes, so tasks write such files themselves, each under
a name of its own, and return one row per finished file.  Those rows are written as
a table by Spark, which keeps the rows of successful attempts only: a file left by
a lost or repeated attempt is in no table and so is never read.
"""

from __future__ import annotations

import re
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from ..session import shared_folder

# Scheme names of Hadoop's file systems and of Arrow's: fixed values.
ARROW_SCHEME = {"s3a": "s3", "s3n": "s3", "abfs": "abfs", "abfss": "abfss", "gs": "gs", "hdfs": "hdfs", "viewfs": "viewfs"}


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system and path for a folder or file named as Spark names it."""
    m = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", uri)
    if not m or m[1] == "file":
        return fs.LocalFileSystem(), re.sub(r"^file:/*", "/", uri)
    if m[1] == "dbfs":
        return fs.LocalFileSystem(), re.sub(r"^dbfs:/*", "/dbfs/", uri)
    return fs.FileSystem.from_uri(ARROW_SCHEME.get(m[1], m[1]) + uri[m.end() - 1 :])


def is_local(uri: str) -> bool:
    return isinstance(filesystem(uri)[0], fs.LocalFileSystem)


def new_folder(spark: SparkSession, kind: str) -> str:
    """Name of a fresh folder under the shared one."""
    return f"{shared_folder(spark)}/{kind}/{uuid.uuid4().hex}"


def create(uri: str):
    """Open a new binary file for writing, with its folder."""
    system, path = filesystem(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(path, compression=None)


def open_file(uri: str):
    """Random-access file: mapped into memory where it is local, else range reads."""
    system, path = filesystem(uri)
    if isinstance(system, fs.LocalFileSystem):
        import pyarrow as pa

        return pa.memory_map(path) if system.get_file_info(path).size else system.open_input_file(path)
    return system.open_input_file(path)


def written(rows: DataFrame, folder: str, name: str) -> DataFrame:
    """Write ``rows`` once as a table of ``folder`` and read it back."""
    path = f"{folder}/{name}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
