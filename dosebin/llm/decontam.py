"""Benchmark decontamination with a generalised suffix automaton of the test items.

An item's window is ``min_words`` consecutive words of it, or, for an item with fewer,
the share ``coverage`` of its words (all of them by default).  The automaton of all
items is walked with a document's words; at each word it gives the longest suffix read
that occurs in an item, and so every window that ends there.  Words inside an
occurrence are hit.  Automata are built over at most BLOCK_WORDS item words.  A larger test
set is stored in blocks of that size: a task reads the blocks one after another from the shared
folder, scans what documents it holds with each, and unites the runs.  The test set is neither
on the driver nor whole in any task.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import files

BLOCK_WORDS = 100_000
PART_WORDS = 10_000
CHUNK_BYTES = 16 << 20  # of texts that are scanned with a block at a time
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
# Everything that WORD leaves out becomes a space; upper-case ASCII letters become lower-case.
_TABLE = bytes(32 if re.match(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]", bytes([b])) else bytes([b]).lower()[0] for b in range(256))
FOUND = "doc_id long, n_words long, runs array<struct<first:long,last:long>>, items array<string>"


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words of a whole text, in order; null has none."""
    return (text or "").encode().translate(_TABLE).split()


class Automaton:
    """Suffix automaton of item words, with the items' windows at its states."""

    def __init__(self, items: list[tuple[str, list[bytes], int]]):
        """``items``: (id, words, window length) with a window length of at least 1."""
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for _, words, _ in items:
            last = 0
            for w in words:
                last = self._extend(last, self.vocabulary.setdefault(w, len(self.vocabulary)))
        own: list[dict[int, set[str]]] = [{} for _ in self.link]
        for item, words, need in items:
            v, n = 0, 0
            for k, w in enumerate(words):
                v, n = self.next[v][self.vocabulary[w]], n + 1
                if k + 1 >= need:
                    u = v
                    while self.length[self.link[u]] >= need:
                        u = self.link[u]
                    own[u].setdefault(need, set()).add(item)
        # Windows that end at a state's words: its own and those of its suffixes.
        self.windows: list[tuple[tuple[int, frozenset[str]], ...]] = [()] * len(self.link)
        for v in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            mine = tuple((n, frozenset(s)) for n, s in own[v].items())
            self.windows[v] = tuple(sorted(mine + self.windows[self.link[v]], key=lambda x: x[0]))
        self.least = [w[0][0] if w else math.inf for w in self.windows]

    def _extend(self, last: int, c: int) -> int:
        """State of ``last``'s words and one more, added where it is new."""
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        new = self._state(self.length[last] + 1, {}, 0)
        p = last
        while p != -1 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p != -1:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return new

    def _state(self, length: int, following: dict[int, int], link: int) -> int:
        self.length.append(length)
        self.next.append(following)
        self.link.append(link)
        return len(self.link) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        half = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = half
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = half
            p = self.link[p]
        return half

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Runs of hit words (first, last) and the items with occurring windows."""
        following, link, length, least = self.next, self.link, self.length, self.least
        known = self.vocabulary.get
        runs: list[tuple[int, int]] = []
        items: set[str] = set()
        v = n = 0
        for k, c in enumerate(map(known, words)):
            if c is None:
                v = n = 0
                continue
            to = following[v].get(c)
            while to is None and v:
                v = link[v]
                n = length[v]
                to = following[v].get(c)
            if to is None:
                continue
            v, n = to, n + 1
            if n >= least[v]:
                most = 0
                for need, some in self.windows[v]:
                    if need > n:
                        break
                    most = need
                    items |= some
                first = k - most + 1
                while runs and runs[-1][1] >= first - 1:
                    first = min(first, runs.pop()[0])
                runs.append((first, k))
        return runs, items


class Items:
    """The stored blocks of a test set; holds the automaton of one of them at a time."""

    def __init__(self, folder: str, blocks: int):
        self.folder, self.blocks = folder, blocks
        self.held, self.now = -1, None

    def automaton(self, block: int) -> Automaton:
        if self.held != block:
            self.now = None  # before the next one is built
            system, path = files.filesystem(f"{self.folder}/block={block}")
            rows = []
            if system.get_file_info(path).type == fs.FileType.Directory:
                rows = ds.dataset(path, filesystem=system, format="parquet").to_table(["item", "words", "need"]).to_pylist()
            self.now, self.held = Automaton([(r["item"], r["words"].encode().split(b" "), r["need"]) for r in rows]), block
        return self.now

    def scan(self, texts: list[list[bytes]]) -> list[tuple[list[tuple[int, int]], set[str]]]:
        """Of each list of words the runs of hit words (first, last) and the items with occurring windows."""
        found = [self.automaton(0).scan(words) for words in texts]
        for block in range(1, self.blocks):
            automaton = self.automaton(block)
            for k, words in enumerate(texts):
                runs, items = automaton.scan(words)
                if items:
                    found[k] = united(found[k][0] + runs), found[k][1] | items
        return found


def united(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs in order, those that overlap or touch as one."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(runs):
        if out and first <= out[-1][1] + 1:
            out[-1] = out[-1][0], max(last, out[-1][1])
        else:
            out.append((first, last))
    return out


def _chunks(batch: pa.RecordBatch, texts: pa.Array) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, some texts of about CHUNK_BYTES at a time."""
    size, first = 0, 0
    for k, text in enumerate(texts):
        size += len(text.as_buffer()) if text.is_valid else 0
        if size > CHUNK_BYTES:
            yield batch.slice(first, k + 1 - first)
            size, first = 0, k + 1
    if first < batch.num_rows:
        yield batch.slice(first)


def store_items(benchmark: DataFrame, min_words: int, coverage: float, item_col: str, text_col: str) -> Items:
    """Items in blocks of about BLOCK_WORDS words; long items are cut with overlaps.

    A null item id counts as the empty string; items without words have no window.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(text)
                if words:
                    need = min_words if len(words) >= min_words else max(1, math.ceil(coverage * len(words)))
                    for k in range(0, max(1, len(words) - need + 1), PART_WORDS):
                        some = words[k : k + PART_WORDS + need - 1]
                        rows.append((item, b" ".join(some).decode(), need, len(some)))
            columns = list(zip(*rows)) or [[], [], [], []]
            types = [pa.string(), pa.string(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["item", "words", "need", "n"])

    folder = files.new_folder(benchmark.sparkSession, "decontam")
    items = benchmark.select(
        F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).cast("string").alias("text")
    )
    parts = files.written(items.mapInArrow(cut, "item string, words string, need int, n int"), folder, "items")
    total = parts.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, math.ceil(total / BLOCK_WORDS))
    block = F.pmod(F.xxhash64("item", "words"), F.lit(blocks)).cast("int")
    parts.withColumn("block", block).write.partitionBy("block").parquet(f"{folder}/blocks")
    return Items(f"{folder}/blocks", blocks)


def find(
    docs: DataFrame,
    benchmark: DataFrame,
    min_words: int = 10,
    coverage: float = 1.0,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """Hit words and items of every document: ``doc_id, n_words, runs, items``.

    ``runs`` are disjoint runs of hit words (first, last; from 0), ``items`` distinct item
    ids as strings.  Every row of ``docs`` gives a row: null and empty texts have no words.
    An empty test set hits nothing.
    """
    items = store_items(benchmark, min_words, coverage, item_col, item_text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in _chunks(batch, batch.column(1)):
                texts = [words_of(t) for t in some.column(1).to_pylist()]
                found = items.scan(texts)
                runs = [[{"first": a, "last": b} for a, b in r] for r, _ in found]
                columns = [pa.array(map(len, texts), pa.int64()), pa.array(runs, kind), pa.array([sorted(s) for _, s in found], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([some.column(0), *columns], ["doc_id", "n_words", "runs", "items"])

    return rows.mapInArrow(run, FOUND)


def hit_words(runs: str = "runs"):
    """Number of hit words of a column of runs."""
    return F.aggregate(runs, F.lit(0).cast("long"), lambda a, r: a + r["last"] - r["first"] + 1)


def cut_runs(text: str, runs: list[tuple[int, int]]) -> str:
    """``text`` without the words of disjoint runs in order, and without what lies between the words of a run."""
    data = text.encode()
    ends = [m.span() for m in WORD.finditer(data.lower())]
    kept, at = [], 0
    for a, b in runs:
        kept.append(data[at : ends[a][0]])
        at = ends[b][1]
    return b"".join([*kept, data[at:]]).decode()


def cut_texts(texts: list[str | None], items: Items) -> list[tuple[str | None, int]]:
    """Texts without hit words, and how many words went.

    Cutting brings words together that were apart, so the texts that changed are scanned again until nothing
    is hit.  Every round takes at least a window from each of them, so there are no more rounds than windows in a text.
    """
    out: list[tuple[str | None, int]] = [(t, 0) for t in texts]
    open_ = [k for k, t in enumerate(texts) if t]
    while open_:
        found = items.scan([words_of(out[k][0]) for k in open_])
        hit = [(k, runs) for k, (runs, _) in zip(open_, found) if runs]
        for k, runs in hit:
            out[k] = cut_runs(out[k][0], runs), out[k][1] + sum(b - a + 1 for a, b in runs)
        open_ = [k for k, _ in hit]
    return out


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    min_words: int = 10,
    coverage: float = 1.0,
    most_hit: float = 0.5,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """``docs`` with hit spans cut out of the texts, all columns kept.

    A document of which more than ``most_hit`` of the words went is removed.  Documents
    without a hit come back unchanged, null and empty texts too.  A text is cut by the runs of all
    blocks of the test set at once, and again until it holds no window of any.
    """
    items = store_items(benchmark, min_words, coverage, item_col, item_text_col)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in _chunks(batch, batch.column(at)):
                texts = some.column(at).to_pylist()
                cut = cut_texts(texts, items)
                keep = [not gone or gone <= most_hit * len(words_of(t)) for t, (_, gone) in zip(texts, cut)]
                columns = list(some.columns)
                columns[at] = pa.array([t for t, _ in cut], batch.schema.field(at).type)
                yield pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
