"""Collocations: phrases of up to five words that follow each other more often than chance.

A suffix pointer is a place where a phrase may begin; its key is the next words of the
piece, at most five.  Pointers are routed by their leading words over all tasks (ranges of
keys, so a frequent word or pair is divided by the words behind it) and sorted in
each by multikey quicksort: split in three by the word at the present depth, less, equal
and more, then go one word deeper in the equal part.  The size of an equal part is the
count of its phrase; parts smaller than the least count are left.  Phrases that lie across
a border of two ranges are added up afterwards.

Before that, what cannot begin a frequent phrase is left out: words, then pairs of leading
words, are counted over all documents, and only places whose next two words are a frequent
pair keep a pointer.  The frequent ones reach the tasks as bitmaps of a fixed size; a
wrongly set bit lets a pointer through that quicksort leaves later.  Equal pointers are
added up over all tasks before they are stored, sampled for ranges and sorted.

Words are 64-bit hashes of language and word.  All distinct words are counted by hash and
by text, so it is known that no frequent word shares its hash; else everything is
done again with a cryptographic hash.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import files
from .hashing import mixed

WIDTH = 5
KEYS = [f"w{i}" for i in range(WIDTH)]
POINTERS = ", ".join(f"{k} long" for k in KEYS) + ", n long"
BITS = 26  # of a bitmap: 8 MB
SLICE = 1 << 17
SHORT = 64
FLUSH_WORDS = 250_000
FLUSH_PAIRS = 1_000_000
FLUSH_POINTERS = 400_000  # five words each are under 2^21 different ones
RANGE_ROWS = 1_000_000
# Signs that end a piece (ten bytes) become a line feed, a tab a space, letters A-Z small.
BREAK = 10
BYTES = bytes(BREAK if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
_P = np.uint64(0xBF58476D1CE4E5B9)
_UP = np.cumprod(np.r_[np.uint64(1), np.full(2 * SLICE, _P)], dtype=np.uint64)
_DOWN = np.cumprod(np.r_[np.uint64(1), np.full(2 * SLICE, np.uint64(pow(int(_P), -1, 1 << 64)))], dtype=np.uint64)
_SIGNS = np.frombuffer(b"".join(hashlib.blake2b(bytes([b]), digest_size=8).digest() for b in range(256)), "<u8")


def _hash(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


def _slices(data: bytes) -> Iterator[np.ndarray]:
    """Parts of some length, cut at spaces where there is one."""
    at = 0
    while at < len(data):
        end = data.find(b" ", at + SLICE) if len(data) - at > SLICE else -1
        end = len(data) if end < 0 else end
        yield np.frombuffer(data, np.uint8, end - at, at)
        at = end


def _word_hashes(data: np.ndarray, strong: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, a second and independent sum, start and end of each run of bytes other than the space."""
    edge = np.flatnonzero(np.diff(np.r_[False, data != 32, False].view(np.int8)))
    start, end = edge[::2], edge[1::2]
    total, check = np.zeros(len(data) + 1, np.uint64), np.zeros(len(data) + 1, np.uint64)
    n = min(len(data), len(_UP))  # past that lies one word without a space, hashed apart
    np.cumsum((data[:n].astype(np.uint64) + np.uint64(1)) * _UP[:n], out=total[1 : n + 1])
    np.cumsum(_SIGNS[data], out=check[1:])
    h = mixed((total[end] - total[start]) * _DOWN[np.minimum(start, n)])
    for k in range(len(h)) if strong else np.flatnonzero(end - start > SHORT):
        h[k] = _hash(data[start[k] : end[k]].tobytes())
    return h, check[end] - check[start], start, end


def hashed(lang: str, texts: list[str | None], strong: bool) -> Iterator[tuple[np.ndarray, ...]]:
    """Slice by slice: word hashes (0 between pieces), second sums, starts, ends and the bytes."""
    seed = np.uint64(_hash(b"language:" + lang.encode()))
    data = b"\n".join((t or "").encode() for t in texts).translate(BYTES).replace(b"\n", b" \n ")
    for part in _slices(data):
        h, check, start, end = _word_hashes(part, strong)
        h = mixed(h ^ seed)
        h[h == 0] = 1
        h[part[start] == BREAK] = 0
        yield h, check, start, end, part


def _by_lang(batch: pa.RecordBatch, rows: int = 64) -> Iterator[tuple[str, list[str | None]]]:
    for i in range(0, batch.num_rows, rows):
        found = defaultdict(list)
        for lang, text in zip(*(c.to_pylist() for c in batch.slice(i, rows).columns)):
            found[lang].append(text)
        yield from found.items()


def _joined(slices: Iterator[tuple[np.ndarray, ...]]) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.uint64), *(x[0] for x in slices)])


def count_words(rows: DataFrame, least: int, strong: bool = False) -> DataFrame:
    """``h, lang, word, n, same`` of words that occur ``least`` times; ``same`` counts the words of a hash.

    A row of each language without a word has hash 0 and the number of all its words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = defaultdict(list), 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                h = np.concatenate([x[0] for x in parts])
                check, n = np.concatenate([x[1] for x in parts]), np.concatenate([x[2] for x in parts])
                words = [w for x in parts for w in x[3]]
                some, first, group = np.unique(h, return_index=True, return_inverse=True)
                if (check == check[first][group]).all():
                    n, words = np.bincount(group, n).astype(np.int64), [words[k] for k in first.tolist()]
                    h = some
                columns = [h.view(np.int64), pa.array([lang], pa.string()).take(pa.array(np.zeros(len(h), np.int64))), pa.array(words, pa.binary()).cast(pa.string()), n]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], ["h", "lang", "word", "n"])
                yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([lang]), pa.array([None], pa.string()), pa.array([int(n.sum())])], ["h", "lang", "word", "n"])
            held.clear()

        for batch in batches:
            for lang, texts in _by_lang(batch):
                for h, check, start, end, data in hashed(lang, texts, strong):
                    word = np.flatnonzero(h)
                    some, first, group, n = np.unique(h[word], return_index=True, return_inverse=True, return_counts=True)
                    if not (check[word] == check[word][first][group]).all():  # two words, one hash: each occurrence for itself
                        some, first, n = h[word], np.arange(len(word)), np.ones(len(word), np.int64)
                    at, raw = word[first], data.tobytes()
                    words = [raw[a:b] for a, b in zip(start[at].tolist(), end[at].tolist())]
                    held[lang].append((some, check[at], n, words))
                    size += len(some)
                if size > FLUSH_WORDS:
                    yield from flush()
                    size = 0
        yield from flush()

    found = rows.mapInArrow(run, "h long, lang string, word string, n long").repartition("h").groupBy("h", "lang", "word").agg(F.sum("n").alias("n"))
    same = F.count("*").over(Window.partitionBy("h"))
    return found.withColumn("same", same).where((F.col("n") >= least) | (F.col("h") == 0))


def bitmap(numbers: DataFrame) -> np.ndarray:
    """Bits of the leading ``BITS`` bits of the only column; the driver gets 2^BITS bits at most."""
    at = numbers.select(F.shiftrightunsigned(F.col(numbers.columns[0]), 64 - BITS).alias("at"))
    bits = at.select(F.shiftright("at", 6).alias("at"), F.expr("shiftleft(1L, int(at % 64))").alias("bit"))
    found = bits.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (BITS - 6), np.int64)
    out[found.column("at").to_numpy()] = found.column("bits").to_numpy()
    return out.view(np.uint64)


def _has(bits: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    at = numbers >> np.uint64(64 - BITS)
    return (bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def _pairs(h: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a word and the next one can both be frequent, and a hash of the two."""
    there = (h != 0) & _has(words, h)
    return there[:-1] & there[1:], mixed(h[:-1] * _P + h[1:])


def count_pairs(rows: DataFrame, words, least: int, strong: bool = False) -> DataFrame:
    """Hashes of neighbours that occur ``least`` times, all their words frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []

        def flush() -> Iterator[pa.RecordBatch]:
            pairs, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pairs.view(np.int64)), pa.array(n.astype(np.int64))], ["pair", "n"])
            held.clear()

        for batch in batches:
            for lang, texts in _by_lang(batch):
                there, pairs = _pairs(_joined(hashed(lang, texts, strong)), words.value)
                held.append(pairs[there])
            if sum(map(len, held)) > FLUSH_PAIRS:
                yield from flush()
        yield from flush()

    return rows.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("pair")


def windows(h: np.ndarray, words: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """A row of up to five words for each place that begins with a frequent pair; 0 behind its last word.

    A window goes on while neighbours are frequent pairs: a phrase that crosses another pair is infrequent.
    """
    there, hashes = _pairs(h, words)
    there &= _has(pairs, hashes)
    at = np.flatnonzero(there)
    out = np.zeros((len(at), WIDTH), np.uint64)
    out[:, 0] = h[at]
    on = np.ones(len(at), bool)
    there = np.r_[there, np.zeros(WIDTH, bool)]
    for k in range(1, WIDTH):
        on &= there[at + k - 1]
        out[on, k] = h[at[on] + k]
    return out


def _added(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different rows and how often each occurs."""
    ids = np.unique(rows, return_inverse=True)[1].reshape(rows.shape).astype(np.int64)
    keys = [sum(ids[:, k] << (21 * (2 - k % 3)) for k in range(f, min(f + 3, WIDTH))) for f in range(0, WIDTH, 3)]
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    at = np.flatnonzero(new)
    return rows[order[at]], np.diff(np.r_[at, len(order)])


def pointers(rows: DataFrame, words, pairs, strong: bool = False) -> DataFrame:
    """Columns ``w0`` to ``w4`` and ``n``: the suffix pointers of all texts by their keys, equal ones added up.

    Spark adds them up, in each task and then over all: blocks of a task have fewer equal ones the more pairs are frequent.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, texts in _by_lang(batch):
                found = windows(_joined(hashed(lang, texts, strong)), words.value, pairs.value)
                for i in range(0, len(found), FLUSH_POINTERS):
                    keys = found[i : i + FLUSH_POINTERS]
                    n = np.ones(len(keys), np.int64)
                    if len(keys) == FLUSH_POINTERS:  # of a few very long texts, which repeat themselves
                        keys, n = _added(keys)
                    columns = [pa.array(np.ascontiguousarray(c).view(np.int64)) for c in keys.T]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(n.astype(np.int64))], [*KEYS, "n"])

    return rows.mapInArrow(run, POINTERS).groupBy(*KEYS).agg(F.sum("n").alias("n"))


def multikey_quicksort(keys: list[np.ndarray], n: np.ndarray, least: int) -> Iterator[tuple[tuple[int, ...], int]]:
    """Prefixes of the keys that occur ``least`` times, with their counts: the sizes of equal parts.

    ``keys[d]`` is the word at depth d of each pointer, 0 behind the last; a pointer counts ``n``.
    """
    open_ = [(np.arange(len(n)), 0, ())]
    while open_:
        some, depth, prefix = open_.pop()
        if n[some].sum() < least:  # infrequent, and so is all in it
            continue
        word = keys[depth][some]
        pivot = np.partition(word[:: max(1, len(word) // 9)][:9], min(len(word), 9) // 2)[min(len(word), 9) // 2]
        less, more = word < pivot, word > pivot
        equal = some[~(less | more)]
        open_ += [(some[less], depth, prefix), (some[more], depth, prefix)]
        count = int(n[equal].sum())
        if pivot and count >= least:
            yield (*prefix, int(pivot)), count
            if depth + 1 < len(keys):
                open_.append((equal, depth + 1, (*prefix, int(pivot))))


def _border(keys: list[np.ndarray], n: np.ndarray, last: bool) -> dict[tuple[int, ...], int]:
    """Prefixes of the first or last key of a range, which its neighbours may have too, and their counts."""
    found, some, prefix = {}, np.arange(len(n)), ()
    for column in keys:
        word = column[some]
        w = word.max() if last else word.min()
        some, prefix = some[word == w], (*prefix, int(w))
        if not w:
            break
        found[prefix] = int(n[some].sum())
    return found


def count_phrases(keys: DataFrame, least: int) -> DataFrame:
    """``words, n``: phrases of two to five words that occur ``least`` times, as arrays of hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        table = pa.Table.from_batches(got)  # a range: a bounded number of rows
        columns = [table.column(k).to_numpy() for k in KEYS]
        n = table.column("n").to_numpy()
        shared = _border(columns, n, False) | _border(columns, n, True)
        found = list(shared.items()) + [x for x in multikey_quicksort(columns, n, least) if x[0] not in shared]
        found = [(list(p), c) for p, c in found if len(p) > 1]
        for i in range(0, len(found), 50_000):
            words, counts = zip(*found[i : i + 50_000])
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.list_(pa.int64())), pa.array(counts, pa.int64())], ["words", "n"])

    ranges = keys.count() // RANGE_ROWS + 1
    sorted_ = keys.repartitionByRange(ranges, *KEYS).mapInArrow(run, "words array<long>, n long")
    return sorted_.groupBy("words").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def collocations(docs: DataFrame, least: int = 100, top: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the best phrases of every language.

    ``a`` counts the phrase, ``l`` and ``r`` the two parts of its worst cut, ``n`` all words of the
    language; the score is floor(1000 a n / (l r)).  A phrase inside a longer one that occurs as often is left
    out.  A null text is empty, a null language ``und``; repeated rows count each.  Other columns are
    not read.  An empty table gives no rows.
    """
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    spark = docs.sparkSession
    for strong in (False, True):
        folder = files.new_folder(spark, "phrases")
        found = files.written(count_words(rows, least, strong), folder, "words")
        words = found.where("h <> 0")
        if strong or not words.where("same > 1").limit(1).count():
            break
    send = spark.sparkContext.broadcast
    word_bits = send(bitmap(words.select("h")))
    pairs = files.written(count_pairs(rows, word_bits, least, strong), folder, "pairs")
    keys = files.written(pointers(rows, word_bits, send(bitmap(pairs)), strong), folder, "pointers")
    phrases = files.written(count_phrases(keys, least), folder, "phrases")
    totals = found.where("h = 0").select("lang", F.col("n").alias("n"))
    return _ranked(phrases, words, totals, top)


def _ranked(phrases: DataFrame, words: DataFrame, totals: DataFrame, top: int) -> DataFrame:
    size = F.size("words")
    known = phrases.unionByName(words.select(F.array("h").alias("words"), "n"))
    spelled = phrases.select("words", F.posexplode("words").alias("at", "h")).join(words.select("h", "lang", "word"), "h")
    spelled = spelled.groupBy("words", "lang").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("spelled"))  # five at most
    text = spelled.select("words", "lang", F.array_join(F.transform("spelled", lambda x: x["word"]), " ").alias("phrase"))

    # A phrase and the same without its first or last word: the shorter one goes if it occurs no more often.
    parts = F.array(F.slice("words", 1, size - 1), F.slice("words", F.lit(2), size - 1))
    longer = phrases.where(size > 2).select(F.explode(parts).alias("words"), "n").groupBy("words").agg(F.max("n").alias("longer"))
    kept = phrases.join(longer, "words", "left").where(F.coalesce(F.col("longer") < F.col("n"), F.lit(True)))

    cuts = kept.select("words", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("words", "a", "k", F.slice("words", F.lit(1), F.col("k")).alias("left"), F.slice("words", F.col("k") + 1, size - F.col("k")).alias("right"))
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(known.select(F.col("words").alias(side), F.col("n").alias(name)), side)
    cuts = cuts.join(text, "words").join(totals, "lang")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    score = F.call_function("div", F.lit(1000).cast("decimal(4,0)") * wide("a") * wide("n"), wide("l") * wide("r"))
    worst = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("worst")
    best = cuts.groupBy("words", "lang", "phrase", "a", "n").agg(worst).select("lang", "phrase", "a", "worst.l", "worst.r", "n", "worst.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
