"""Token-id files: flat unsigned integers with 64-bit document offsets.

A part of the collection is three files, all little-endian and without headers:

- ``ids.bin``: the ids of its documents one after another, 16 bits wide where the
  vocabulary fits, else 32;
- ``offsets.bin``: unsigned 64-bit, one more than documents; document *i* of the part
  has ids ``offsets[i] : offsets[i + 1]``;
- ``docs.bin``: signed 64-bit document ids.

Parts hold ascending ranges of document ids.  The manifest has a row per part; its
``base``, the number of ids in all parts before it, is a prefix sum over the parts.
"""

from __future__ import annotations

import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import files
from .encode import encoder

PART = "part int, path string, width int, n_docs long, n_null long, n_tokens long, first_doc long, last_doc long"
ROWS_OUT = 2_000


def write_tokens(
    docs: DataFrame,
    vocabulary: str,
    folder: str | None = None,
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Write the ids of every text in ascending order of document id; return the manifest.

    ``vocabulary`` is the JSON text of a vocabulary of the ``tokenizers`` library.  Rows
    are dealt out by range of (id, hash of the text), so rows that share an id spread
    over parts too; rows of one id follow each other in the order of that hash, and
    repeated rows stay separate documents.  A null text is empty: its document is the
    end id alone.  Null document ids come first.  An empty table gives an empty manifest.
    Other columns are not read.
    """
    spark = docs.sparkSession
    folder = folder or files.new_folder(spark, "tokens")
    code = spark.sparkContext.broadcast(vocabulary)
    ordered = (
        docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange("id", "tie")
        .sortWithinPartitions("id", "tie", "text")
        .select("id", "text")
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(code.value)
        end = np.array([end_id], enc.dtype).tobytes()
        width, at, n_null, ids, offsets, out, path = enc.dtype.itemsize, 0, 0, array("q"), array("Q", [0]), None, ""
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                some = batch.slice(i, 64)
                if out is None:
                    path = f"{folder}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
                    out = files.create(f"{path}/ids.bin")
                for doc, data in zip(some.column(0).to_pylist(), enc.encode(some.column(1).to_pylist())):
                    out.write(data + end)
                    at += len(data) // width + 1
                    n_null += doc is None
                    ids.append(0 if doc is None else doc)
                    offsets.append(at)
        if out is None:
            return
        out.close()
        for name, values, kind in (("offsets.bin", offsets, "<u8"), ("docs.bin", ids, "<i8")):
            with files.create(f"{path}/{name}") as f:
                f.write(np.frombuffer(values, kind[1:]).astype(kind).tobytes())
        row = [TaskContext.get().partitionId(), path, width, len(ids), n_null, at, ids[0], ids[-1]]
        names = [x.split(" ")[0] for x in PART.split(", ")]
        types = [pa.int32(), pa.string(), pa.int32()] + [pa.int64()] * 5
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names)

    parts = files.written(ordered.mapInArrow(write, PART), folder, "parts")
    return with_bases(parts)


def with_bases(parts: DataFrame) -> DataFrame:
    """Add ``base`` and ``first_row``: ids and documents in the parts before (one row a part)."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    return parts.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), zero)).withColumn(
        "first_row", F.coalesce(F.sum("n_docs").over(before), zero)
    )


def read_tokens(manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """Documents read back from the files of a manifest, which are mapped into memory.

    Returns ``doc_id, start, n_tokens, ids_crc32`` and, if asked for, ``ids`` as an array
    of longs.  ``start`` counts the ids of all documents before it in the collection, the
    checksum is of the ids as little-endian unsigned 32-bit integers.
    """
    n = max(1, manifest.count())
    rows = manifest.select("part", "path", "width", "n_null", "base").repartition(n, "part")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, offsets, docs = open_part(row["path"], row["width"])
                for i in range(0, len(docs), ROWS_OUT):
                    j = min(i + ROWS_OUT, len(docs))
                    cut = [ids[a:b] for a, b in zip(offsets[i:j].tolist(), offsets[i + 1 : j + 1].tolist())]
                    columns = [
                        pa.array(docs[i:j], pa.int64(), mask=np.arange(i, j) < row["n_null"]),
                        pa.array(offsets[i:j].astype("i8") + row["base"]),
                        pa.array([len(x) for x in cut], pa.int64()),
                        pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in cut], pa.int64()),
                    ]
                    if with_ids:
                        columns.append(pa.array([x.astype("i8") for x in cut], pa.list_(pa.int64())))
                    yield pa.RecordBatch.from_arrays(columns, [x.split(" ")[0] for x in schema.split(", ")])

    return rows.mapInArrow(read, schema)


def open_part(path: str, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, offsets and document ids of one part; no more is read than what is looked at."""

    def whole(name: str, kind: str) -> np.ndarray:
        f = files.open_file(f"{path}/{name}")
        return np.frombuffer(f.read_buffer(f.size()), kind) if f.size() else np.zeros(0, kind)

    return whole("ids.bin", f"<u{width}"), whole("offsets.bin", "<u8"), whole("docs.bin", "<i8")


def vocabulary_text(path: str) -> str:
    """JSON text of a vocabulary file on the driver; tasks get it by broadcast (a few MB)."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def load_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Manifest of a collection written earlier."""
    return with_bases(spark.read.schema(PART).parquet(f"{folder}/parts"))
