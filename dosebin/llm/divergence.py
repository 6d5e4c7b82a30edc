"""How far the sources of a language differ in their words, from run-length coded counts.

Words are counted per language and source; words of fewer than three documents of a language
go.  Words with the same counts in every source are alike to every comparison, so the
vocabulary is reordered: sorted by those counts, cut into ranges, equal ones next to each
other.  In a range the counts of each source are a column of runs, and most of a column is
few runs, many of them zeros.  For two sources the boundaries of their runs are
intersected: between two boundaries both counts stand still, so what one word adds is
multiplied by the number of words.

Shares are whole numbers: ``p = 1 + floor(scale (count + 1) / (N + V))`` with N the
source's occurrences of kept words and V the kept words of the language.  All sums are exact.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import files

SCALE = 1_000_000_000
COUNTED = "lang string, source string, term string, n long, docs long"
FLUSH = 250_000
RANGE_ROWS = 20_000
LONG = 9_000_000_000  # SCALE times this still is a 64-bit number
# Bytes of a term: ASCII letters, lower-cased, and all bytes of other characters.
TERM_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(TERM_BYTES).split()


def count_terms(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``lang, source, term, n, docs``: occurrences and documents, one row of each; nulls are empty.

    A task adds up what it has before rows leave it, and a word's counts of each source are
    added up apart, so no frequent word or large source goes to one task.
    """
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    names = [x.split(" ")[0] for x in COUNTED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs) in found.items():
                k = len(n)  # both counters saw their words in the same order
                same = [pa.array([x], pa.string()).take(pa.array(np.zeros(k, np.int64))) for x in (lang, source)]
                columns = [*same, pa.array(list(n), pa.binary()).cast(pa.string()), *(pa.array(list(c.values()), pa.int64()) for c in (n, docs))]
                yield pa.RecordBatch.from_arrays(columns, names)
            found.clear()

        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                for lang, source, text in zip(*(c.to_pylist() for c in batch.slice(i, 64).columns)):
                    n, docs = found.setdefault((lang, source), (Counter(), Counter()))
                    terms = terms_of(text)
                    n.update(terms)
                    docs.update(dict.fromkeys(terms).keys())  # in the order of first use, as in n
                if sum(len(n) for n, _ in found.values()) > FLUSH:
                    yield from flush()
        yield from flush()

    counted = docs.select(empty(lang_col).alias("lang"), empty(source_col).alias("source"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, COUNTED)
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_terms(counted: DataFrame, least_docs: int = 3) -> DataFrame:
    """``lang, term, total, counts``: terms of at least so many documents and their counts by source.

    ``counts`` holds ``(source, n)`` in order of source, at most one of each source of the language.
    """
    listed = F.array_sort(F.collect_list(F.struct("source", "n"))).alias("counts")
    terms = counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), listed)
    return terms.where(F.col("docs") >= least_docs).drop("docs")


def groups_of(docs: DataFrame, terms: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``lang, source, n, lang_n, v``: every source of every language with its N, the language's N and V."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    there = docs.select(empty(lang_col).alias("lang"), empty(source_col).alias("source")).groupBy("lang", "source").agg(F.lit(0).cast("long").alias("n"))
    found = terms.select("lang", F.inline("counts")).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = there.unionByName(found).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    of_lang = terms.groupBy("lang").agg(F.sum("total").alias("lang_n"), F.count("*").alias("v"))
    zero = {"lang_n": 0, "v": 0}
    return groups.join(of_lang, "lang", "left").fillna(zero)


def shares(counts: np.ndarray, total: int) -> np.ndarray:
    """``p`` of whole counts, exact also where the product passes 64 bits."""
    if len(counts) and int(counts.max()) + 1 > LONG:
        return np.array([1 + SCALE * (int(c) + 1) // total for c in counts], np.int64)
    return 1 + SCALE * (counts + 1) // total


def runs(positions: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and values of the runs of a column that is zero but at the ascending ``positions``."""
    if not len(positions):
        return np.zeros(1, np.int64), np.zeros(1, np.int64)
    # A zero run goes from the end of each stretch of neighbours to the next; it may be empty.
    stops = np.r_[0, positions + 1]
    starts = np.c_[stops, np.r_[positions, size]].reshape(-1)[: 2 * len(positions) + 1]
    values = np.zeros(len(starts), np.int64)
    values[1::2] = counts
    last = np.r_[starts[1:], size]
    starts, values = starts[last > starts], values[last > starts]
    first = np.r_[True, values[1:] != values[:-1]]
    return starts[first], values[first]


def pair_sums(columns: list[tuple[np.ndarray, np.ndarray]], ends: np.ndarray) -> np.ndarray:
    """``sums[s, t]``: floor((p - q)^2 / q) with p of column s, q of column t, added up over all words.

    A column is its runs: starts and shares.  ``ends[i]`` counts the words of the rows before i.
    """
    sums = np.zeros((len(columns), len(columns)), np.int64)
    for s, (a, p_all) in enumerate(columns):
        for t in range(s):
            b, q_all = columns[t]
            cuts = np.union1d(a, b)
            length = np.diff(ends[np.r_[cuts, len(ends) - 1]])
            p = p_all[np.searchsorted(a, cuts, "right") - 1]
            q = q_all[np.searchsorted(b, cuts, "right") - 1]
            square = (p - q) ** 2
            sums[s, t] = (square // q * length).sum()
            sums[t, s] = (square // p * length).sum()
    return sums


def _range_sums(rows: pa.Table, groups: pa.Table) -> pa.Table:
    """Sums of all ordered pairs of sources over one range of the vocabulary of a language."""
    head = groups.sort_by("source").to_pydict()
    lang, sources, v = head["lang"][0] if head["lang"] else "", head["source"], head["v"][0] if head["v"] else 0
    same = rows.to_pydict()
    order = sorted(range(rows.num_rows), key=lambda i: [(x["source"].encode(), x["n"]) for x in same["counts"][i]])
    ends = np.r_[0, np.cumsum([same["words"][i] for i in order], dtype=np.int64)]
    at: dict[str, tuple[list[int], list[int]]] = {s: ([], []) for s in sources}
    for k, i in enumerate(order):
        for x in same["counts"][i]:
            positions, counts = at[x["source"]]
            positions.append(k)
            counts.append(x["n"])
    columns = []
    for s, n in zip(sources, head["n"]):
        starts, counts = runs(np.array(at[s][0], np.int64), np.array(at[s][1], np.int64), len(order))
        columns.append((starts, shares(counts, max(1, n + v))))
    sums = pair_sums(columns, ends) if len(order) else np.zeros((len(sources), len(sources)), np.int64)
    s, t = np.nonzero(~np.eye(len(sources), dtype=bool))
    named = pa.array(sources, pa.string())
    lang_column = pa.array([lang], pa.string()).take(pa.array(np.zeros(len(s), np.int64)))
    return pa.Table.from_arrays([lang_column, named.take(pa.array(s)), named.take(pa.array(t)), pa.array(sums[s, t])], ["lang", "source", "item", "value"])


def pair_divergence(terms: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, source, item, value`` of every two sources of a language, 0 if it kept no term.

    A pair is a result row, so there are as many as sources times sources of a language.
    """
    folder = files.new_folder(terms.sparkSession, "divergence")
    alike = files.written(terms.groupBy("lang", "counts").agg(F.count("*").alias("words")), folder, "alike")
    n = alike.count() // RANGE_ROWS + 1
    ranged = files.written(alike.repartitionByRange(n, "lang", "counts").withColumn("range", F.spark_partition_id()), folder, "ranges")
    # A range of its own without words gives every pair of every language a row.
    spans = ranged.select("lang", "range").distinct().unionByName(groups.select("lang", F.lit(-1).alias("range")).distinct())
    heads = files.written(groups.select("lang", "source", "n", "v").join(spans, "lang"), folder, "heads")
    schema = "lang string, source string, item string, value long"
    sums = ranged.groupBy("lang", "range").cogroup(heads.groupBy("lang", "range")).applyInArrow(_range_sums, schema)
    return sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def _share(n: Column, total: Column) -> Column:
    wide = F.lit(SCALE).cast("decimal(38,0)") * (n + 1).cast("decimal(20,0)")
    exact = F.call_function("div", wide, total.cast("decimal(20,0)"))
    return F.lit(1) + F.when(n < LONG, F.call_function("div", F.lit(SCALE) * (n + 1), total)).otherwise(exact)


def term_divergence(terms: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, source, item, value`` of the terms that a source uses more than its language does."""
    rows = terms.select("lang", F.col("term").alias("item"), "total", F.inline("counts")).join(
        groups.withColumnRenamed("n", "group_n"), ["lang", "source"]
    )
    p, q = _share(F.col("n"), F.col("group_n") + F.col("v")), _share(F.col("total"), F.col("lang_n") + F.col("v"))
    rows = rows.withColumns({"p": p, "q": q}).where(F.col("p") > F.col("q"))
    step = F.col("p") - F.col("q")
    return rows.select("lang", "source", "item", F.call_function("div", step * step, F.col("q")).alias("value"))


def audit(
    docs: DataFrame, top_terms: int = 200, least_docs: int = 3, text_col: str = "text", lang_col: str = "lang", source_col: str = "source"
) -> DataFrame:
    """``lang, source, part, item, value, rank``: divergence of sources and of their terms.

    Part ``pair`` ranks the other sources of the language, part ``term`` the first ``top_terms`` terms.
    Null and empty text, language and source are ''.  Repeated rows are documents of their own.  A
    language without kept terms has pairs of value 0.  Other columns are not read; an empty table gives no rows.
    """
    folder = files.new_folder(docs.sparkSession, "divergence")
    terms = files.written(kept_terms(count_terms(docs, text_col, lang_col, source_col), least_docs), folder, "terms")
    groups = files.written(groups_of(docs, terms, lang_col, source_col), folder, "groups")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pair_divergence(terms, groups).withColumn("rank", F.row_number().over(order))
    top = term_divergence(terms, groups).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_terms)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(columns).unionByName(top.withColumn("part", F.lit("term")).select(columns))
