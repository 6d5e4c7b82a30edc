"""The stages of the corpus pipeline: (name, function of (spark, docs, sf_dir)).

Each takes stored rows with the columns of ``documents`` and returns those columns for the rows
it keeps; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table
from . import decontam, packing, pii, quality, simhash
from .queries import KEPT_SCORE, vocabulary


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    model = quality.train(docs, read_table(spark, sf_dir, "labels"))
    scored = quality.with_score(docs, model, score_col="__score")
    return scored.where(F.col("__score") >= KEPT_SCORE).drop("__score")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that 3-word SimHash fingerprints link within 3 bits."""
    return simhash.deduplicate(docs, shingle=3)


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` of the texts as they are now; that of a null text stays."""
    if "n_chars" not in docs.columns:
        return docs
    counted = F.coalesce(F.char_length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars"))
    return docs.withColumn("n_chars", counted)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of test items; documents that mostly are such passages go."""
    return _counted(decontam.decontaminate(docs, read_table(spark, sf_dir, "benchmark")))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind."""
    return _counted(pii.mask(docs, pii.train(docs)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences of 4096 tokens."""
    packed = packing.pack_documents(docs, vocabulary(), 4096, end_id=1)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("personal_data", mask_personal_data),
    ("packing", pack),
]
