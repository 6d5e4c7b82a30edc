"""Approximate nearest neighbours: a hierarchical k-means tree searched best bin first.

The tree is fitted on a bounded sample and then every row is put into a leaf.  Leaves that hold too
many rows are divided again, each by a sample of its own rows, so the number of leaves grows
with the table and a leaf does not.  A query walks the
tree with a priority queue of nodes, the most promising first, and visits leaves in that order.
How many it must visit is calibrated: for some queries the true neighbours are found by a full
scan, and visits are widened until those leaves hold the wanted share of them.
Leaves are searched as blocks of bounded size by parts of their queries, also of bounded size; each pair of
block and part gives the block's best k per query.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import files

SAMPLE_ROWS = 16_384
BRANCHES = 8
LEAF_SAMPLE = 384
CALIBRATED = 64
BLOCK_ROWS = 4096
PART_QUERIES = 4096
LEAF_ROWS = 65_536
CLOSE = 1e-9  # scores of one pair by different orders of summing differ by far less


class Tree(NamedTuple):
    """Nodes in breadth-first order: children of each (none: a leaf), its centre and spread."""

    children: list[list[int]]
    centres: np.ndarray
    spread: np.ndarray  # deviation along one direction
    leaf: np.ndarray  # leaf number or -1


def k_means(x: np.ndarray, k: int, random: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Cluster number of each row; may use fewer than ``k``."""
    centres = x[random.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[random.integers(0, len(x), k)])
    return near


def grow(x: np.ndarray, branches: int = BRANCHES, leaf_rows: int = LEAF_SAMPLE, seed: int = 3) -> Tree:
    """Tree over sample rows: a node of more than ``leaf_rows`` is divided by k-means."""
    random = np.random.default_rng(seed)
    todo, children, centres, spread, leaf = [np.arange(len(x))], [], [], [], []
    while len(children) < len(todo):
        rows = x[todo[len(children)]]
        centre = rows.mean(0) if len(rows) else np.zeros(x.shape[1])
        centres.append(centre)
        spread.append(math.sqrt(((rows - centre) ** 2).sum() / max(1, rows.size)))
        groups = []
        if len(rows) > leaf_rows:
            near = k_means(rows, branches, random)
            groups = [todo[len(children)][near == c] for c in range(branches) if (near == c).any()]
        if len(groups) < 2:  # small enough, or equal rows
            groups = []
        leaf.append(-1 if groups else sum(v >= 0 for v in leaf))
        children.append(list(range(len(todo), len(todo) + len(groups))))
        todo += groups
    return Tree(children, np.array(centres), np.array(spread), np.array(leaf))


def leaf_of(tree: Tree, x: np.ndarray) -> np.ndarray:
    """Leaf of each row: from the root to the child with the nearest centre."""
    out, todo = np.full(len(x), -1), [(0, np.arange(len(x)))]
    while todo:
        v, rows = todo.pop()
        kids = tree.children[v]
        if not kids:
            out[rows] = tree.leaf[v]
            continue
        c = tree.centres[kids]
        near = ((c**2).sum(1) - 2 * x[rows] @ c.T).argmin(1)
        todo += [(kids[k], rows[near == k]) for k in np.unique(near).tolist()]
    return out


def graft(tree: Tree, grown: dict[int, Tree]) -> Tree:
    """``tree`` with some leaves (by number) divided as their own trees say."""
    children, leaf = [list(c) for c in tree.children], tree.leaf.tolist()
    centres, spread, free = [tree.centres], [tree.spread], int(tree.leaf.max()) + 1
    node = {n: v for v, n in enumerate(leaf) if n >= 0}
    for n, sub in sorted(grown.items()):
        if len(sub.children) < 2:
            continue
        shift = len(children) - 1  # the root of the smaller tree is the leaf itself
        children[node[n]] = [c + shift for c in sub.children[0]]
        leaf[node[n]] = -1
        for kids, own in zip(sub.children[1:], sub.leaf[1:].tolist()):
            children.append([c + shift for c in kids])
            leaf.append(-1 if own < 0 else free + own)
        free += int(sub.leaf.max()) + 1
        centres.append(sub.centres[1:])
        spread.append(sub.spread[1:])
    return Tree(children, np.concatenate(centres), np.concatenate(spread), np.array(leaf))


def best_bins(tree: Tree, q: np.ndarray, enough) -> list[int]:
    """Leaves in the order a query visits them, while ``enough(leaves so far)`` is false.

    A node promises its centre's product with the query and two deviations more.
    """
    promise = tree.centres @ q + 2 * tree.spread * math.sqrt(q @ q)
    queue, found = [(-promise[0], 0)], []
    while queue and not enough(found):
        _, v = heapq.heappop(queue)
        if tree.leaf[v] >= 0:
            found.append(int(tree.leaf[v]))
        for c in tree.children[v]:
            heapq.heappush(queue, (-promise[c], c))
    return found


def _matrix(column) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(values)
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def valid_vectors(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``vec_id, vec`` of usable vectors: not null or zero, no null or non-finite component.

    Vectors have the most frequent length (the larger of equally frequent ones); others take no part.
    """
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("vec"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull())
    bad = F.exists("vec", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = rows.where(~bad & F.exists("vec", lambda v: v != 0))
    size = rows.groupBy(F.size("vec").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return rows.where(F.size("vec") == (size["size"] if size else 0))


def _top(scores: np.ndarray, ids: np.ndarray, vectors: np.ndarray, q: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Best k rows for a query but its own: ids and products, summed in one order for every row."""
    keep = ids != own
    if keep.sum() > k:
        floor = np.partition(scores[keep], -k)[-k] - CLOSE * (1 + np.abs(scores).max())
        keep &= scores >= floor
    at = np.flatnonzero(keep)
    exact = (vectors[at] * q).sum(1)
    order = np.lexsort((ids[at], -exact))[:k]
    return ids[at][order], exact[order]


_FOUND = "query_id long, vec_id long, score double"


def _found(rows: list[tuple[int, np.ndarray, np.ndarray]]) -> list[pa.Array]:
    return [
        pa.array(np.concatenate([np.full(len(i), q) for q, i, _ in rows] or [np.zeros(0, np.int64)]), pa.int64()),
        pa.array(np.concatenate([i for _, i, _ in rows] or [np.zeros(0, np.int64)]), pa.int64()),
        pa.array(np.concatenate([s for _, _, s in rows] or [np.zeros(0)]), pa.float64()),
    ]


def _ranked(found: DataFrame, k: int) -> DataFrame:
    nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def exact_neighbours(rows: DataFrame, queries: list[tuple[int, list[float]]], k: int) -> DataFrame:
    """True neighbours of a bounded list of queries among ``vec_id, vec`` rows, by one scan."""
    sent = rows.sparkSession.sparkContext.broadcast(queries)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [(q, np.array(v, np.float64)) for q, v in sent.value]
        all_q = np.array([v for _, v in own])
        for batch in batches:
            ids, x = batch.column("vec_id").to_numpy(), _matrix(batch.column("vec"))
            if len(ids):
                scores = x @ all_q.T
                got = [(q, *_top(scores[:, j], ids, x, v, q, k)) for j, (q, v) in enumerate(own)]
                yield pa.RecordBatch.from_arrays(_found(got), ["query_id", "vec_id", "score"])

    return _ranked(rows.mapInArrow(scan, _FOUND), k)


class Index(NamedTuple):
    tree: Tree
    rows: DataFrame  # vec_id, vec, leaf: every usable row
    leaf_rows: dict[int, int]


def build(rows: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "vec_id", vec_col: str = "embedding") -> Index:
    """Fit the tree on about ``sample_rows`` rows chosen by a hash, and index every usable row.

    The bound holds at every size.  An empty table gives an index that finds nothing.
    """
    spark = rows.sparkSession
    folder = files.new_folder(spark, "ann")
    usable = valid_vectors(rows, id_col, vec_col)
    total = usable.count()
    chosen = F.shiftrightunsigned(F.xxhash64("vec_id", "vec"), 11) / float(1 << 53) < sample_rows / max(1, total)
    # Equal rows are chosen together, so each counts once in the sample.
    some = usable.where(chosen).groupBy("vec_id").agg(F.first("vec").alias("vec")).collect()
    sample = np.array([r["vec"] for r in sorted(some, key=lambda r: r["vec_id"])], np.float64)
    tree = grow(sample if len(sample) else np.zeros((1, 1)))
    stored, held, whole, number = _placed(usable, tree, folder, 0), {}, set(), 0
    while True:
        held = {r[0]: r[1] for r in stored.groupBy("leaf").count().collect()}  # a row per leaf
        large = {leaf: n for leaf, n in held.items() if n > LEAF_ROWS and leaf not in whole}
        if not large:
            return Index(tree, stored, held)
        grown = _grown_leaves(stored, large, sample_rows)
        whole |= {leaf for leaf in large if len(grown[leaf].children) < 2}  # equal rows are not divided
        tree, number = graft(tree, grown), number + 1
        stored = _placed(stored.select("vec_id", "vec"), tree, folder, number)


def _placed(rows: DataFrame, tree: Tree, folder: str, number: int) -> DataFrame:
    """``vec_id, vec`` rows with their leaf, stored."""
    sent = rows.sparkSession.sparkContext.broadcast(tuple(tree))  # a centre for LEAF_ROWS / BRANCHES rows or more

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = leaf_of(Tree(*sent.value), _matrix(batch.column("vec"))) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf, pa.int32())], [*batch.schema.names, "leaf"])

    return files.written(rows.mapInArrow(place, rows.withColumn("leaf", F.lit(0)).schema), folder, f"rows-{number}")


def _grown_leaves(rows: DataFrame, large: dict[int, int], sample_rows: int) -> dict[int, Tree]:
    """A tree for each large leaf from about ``sample_rows`` of its own rows, grown in tasks."""
    spark = rows.sparkSession
    chances = spark.createDataFrame([(leaf, sample_rows / n) for leaf, n in large.items()], "leaf int, chance double")
    uniform = F.shiftrightunsigned(F.xxhash64("vec_id", "vec", F.lit("leaf")), 11) / float(1 << 53)
    some = rows.join(chances, "leaf").where(uniform < F.col("chance")).groupBy("leaf", "vec_id").agg(F.first("vec").alias("vec"))

    def run(table: pa.Table) -> pa.Table:
        tree = grow(_matrix(table.sort_by("vec_id").column("vec")))
        whole, real = pa.list_(pa.int64()), pa.list_(pa.float64())
        made = zip((tree.children, tree.centres.tolist(), tree.spread.tolist(), tree.leaf.tolist()), (pa.list_(whole), pa.list_(real), real, whole))
        columns = [table.column("leaf").slice(0, 1).combine_chunks(), *(pa.array([v], t) for v, t in made)]
        return pa.Table.from_arrays(columns, ["leaf", "children", "centres", "spread", "leaves"])

    schema = "leaf int, children array<array<bigint>>, centres array<array<double>>, spread array<double>, leaves array<bigint>"
    got = some.groupBy("leaf").applyInArrow(run, schema).collect()
    grown = {r["leaf"]: Tree([list(c) for c in r["children"]], np.array(r["centres"]), np.array(r["spread"]), np.array(r["leaves"])) for r in got}
    alone = Tree([[]], np.zeros((1, 1)), np.zeros(1), np.zeros(1, int))  # no row was chosen: its rows are one and the same
    return {leaf: grown.get(leaf, alone) for leaf in large}


def calibrate(index: Index, queries: DataFrame, k: int, recall: float, calibrated: int = CALIBRATED) -> int:
    """Fewest leaves to visit for ``recall`` of the true neighbours of about ``calibrated`` queries."""
    n = queries.count()
    h = F.shiftrightunsigned(F.xxhash64("vec_id", F.lit("calibrate")), 11) / float(1 << 53)
    some = queries.where(h < calibrated / max(1, n)).groupBy("vec_id").agg(F.first("vec").alias("vec")).collect()
    if not some:  # too few queries to choose from by hash
        some = queries.limit(calibrated).collect()
    asked = sorted((r["vec_id"], list(r["vec"])) for r in some)
    if not asked:
        return 1
    truth = exact_neighbours(index.rows.select("vec_id", "vec"), asked, k)
    where = truth.join(index.rows.select("vec_id", "leaf"), "vec_id").select("query_id", "leaf").collect()
    rank = {}
    for q, v in asked:
        order = best_bins(index.tree, np.array(v, np.float64), lambda found: False)
        rank[q] = {leaf: i for i, leaf in enumerate(order)}
    needed = sorted(rank[r["query_id"]][r["leaf"]] + 1 for r in where)
    return needed[min(len(needed) - 1, math.ceil(recall * len(needed)) - 1)] if needed else 1


def search(index: Index, queries: DataFrame, k: int = 20, recall: float = 0.95, visits: int | None = None) -> DataFrame:
    """The ``k`` nearest indexed rows of every query but itself: ``query_id, rank, vec_id, score``.

    ``queries`` has ``vec_id, vec``, each id once.  Nearness is the inner product; equal ones go to the smaller id.
    Repeated rows of the index are rows of their own, but all rows with a query's id are its own and left out.
    ``visits`` leaves (default: calibrated for ``recall``) are searched, and more where these
    hold no more than ``k`` rows.
    """
    spark = queries.sparkSession
    folder = files.new_folder(spark, "ann-search")
    visits = visits or calibrate(index, queries, k, recall)
    sent = spark.sparkContext.broadcast((tuple(index.tree), index.leaf_rows))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, held = Tree(*sent.value[0]), sent.value[1]
        for batch in batches:
            at, leaves = [], []
            for j, q in enumerate(_matrix(batch.column("vec"))):
                found = best_bins(tree, q, lambda f: len(f) >= visits and sum(held.get(v, 0) for v in f) > k)
                at += [j] * len(found)
                leaves += found
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(at, pa.int64())), pa.array(leaves, pa.int32())], ["vec_id", "leaf"])

    asked = queries.select("vec_id", "vec")
    visited = files.written(asked.mapInArrow(ask, "vec_id long, leaf int"), folder, "visits")
    # Of each leaf, how many blocks of rows and parts of queries there are; every part meets every block.
    share = lambda n, of: F.ceil(F.col(n) / of).cast("long")
    leaves = index.rows.groupBy("leaf").agg(F.count("*").alias("n")).select("leaf", share("n", BLOCK_ROWS).alias("blocks"))
    leaves = leaves.join(visited.groupBy("leaf").agg(F.count("*").alias("n")), "leaf").select("leaf", "blocks", share("n", PART_QUERIES).alias("parts"))
    leaves = files.written(leaves, folder, "leaves")
    counted = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    rows = index.rows.join(leaves, "leaf").withColumn("block", F.pmod(F.xxhash64("vec_id", "vec"), F.col("blocks")))
    rows = rows.select("leaf", "block", F.explode(counted("parts")).alias("part"), "vec_id", "vec")
    told = visited.join(leaves, "leaf").withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit("part")), F.col("parts")))
    told = told.select("leaf", F.explode(counted("blocks")).alias("block"), "part", "vec_id").join(asked, "vec_id")
    told = told.select("leaf", "block", "part", F.col("vec_id").alias("query_id"), F.col("vec").alias("query"))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        got = []
        if left.num_rows and right.num_rows:
            ids, x = left.column("vec_id").to_numpy(), _matrix(left.column("vec"))
            names, q = right.column("query_id").to_numpy(), _matrix(right.column("query"))
            for i in range(0, len(q), 512):
                scores = x @ q[i : i + 512].T
                got += [(names[i + j], *_top(scores[:, j], ids, x, q[i + j], names[i + j], k)) for j in range(scores.shape[1])]
        return pa.Table.from_arrays(_found(got), ["query_id", "vec_id", "score"])

    meeting = ["leaf", "block", "part"]
    return _ranked(rows.groupBy(*meeting).cogroup(told.groupBy(*meeting)).applyInArrow(meet, _FOUND), k)
