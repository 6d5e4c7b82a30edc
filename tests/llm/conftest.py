import os
import random

import pyarrow.parquet as pq
import pytest

WORDS = "the of and sea river stone cloud house winter paper garden letter window silver morning".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, id string, label int, uid string"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "", ",", "."]) for _ in range(n))


def row(doc_id, text, lang="en", source="s"):
    return (doc_id, text, lang, source, None if text is None else len(text), 7, "x", 1, None)


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows, extra columns."""
    copy = prose(1, 40)
    return [
        row(1, None, None, None),
        row(2, ""),
        row(3, " \n\t "),
        row(4, copy),
        row(5, copy),
        row(5, copy),
        row(6, prose(2, 60)),
        row(7, prose(3, 60_000)),
        row(8, "éß漢字 \U0001f44d <|endoftext|> It's 12.5%!! " + "x" * 3000),
        row(None, prose(4, 30)),
        (9, prose(5, 30), None, None, None, None, None, None, None),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def table(folder):
    return lambda name: pq.read_table(os.path.join(folder, f"{name}.parquet")).to_pylist()
