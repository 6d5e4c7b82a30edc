"""Collocations against plain counting; quicksort, windows and hashes against direct versions."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from dosebin.llm import phrases


def plain(rows, least, top=2000):
    counts, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for m in range(1, 6):
                counts[lang].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, f in counts.items():
        found = []
        for p, a in f.items():
            if len(p) < 2 or a < least:
                continue
            longer = [q for q in f if len(q) > len(p) and f[q] >= a and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if longer:
                continue
            n = total[lang]
            score, k = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), p[:k], p[k:], n))
        for rank, (s, a, text, x, y, n) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, text.decode(), -a, f[x], f[y], n, -s))
    return sorted(out)


def mined(df, **kw):
    return sorted(map(tuple, phrases.collocations(df, **kw).collect()))


@pytest.fixture(scope="module")
def texts(table):
    return [(r["text"], r["lang"]) for r in table("documents")][:60]


def test_real_documents_against_plain_counts(spark, texts, monkeypatch):
    df = spark.createDataFrame(texts, "text string, lang string").repartition(5)
    want = plain(texts, 15)
    assert len(want) > 60 and mined(df, least=15) == want
    assert mined(df, least=15, top=7) == [r for r in want if r[1] <= 7]
    monkeypatch.setattr(phrases, "RANGE_ROWS", 50)  # borders everywhere, within hot words too
    monkeypatch.setattr(phrases, "FLUSH_WORDS", 30)
    monkeypatch.setattr(phrases, "FLUSH_PAIRS", 30)
    monkeypatch.setattr(phrases, "FLUSH_POINTERS", 30)
    monkeypatch.setattr(phrases, "SLICE", 100)
    assert mined(df, least=15) == want


def test_words_that_share_a_hash_are_hashed_anew(spark, texts, monkeypatch):
    real, asked = phrases.hashed, []

    def weak(lang, texts, strong):
        for h, *rest in real(lang, texts, strong):
            few = (h % np.uint64(50) + np.uint64(1)) << np.uint64(40)
            yield h if strong else np.where(h > 0, few, h), *rest

    monkeypatch.setattr(phrases, "hashed", weak)
    first = phrases.count_words
    monkeypatch.setattr(phrases, "count_words", lambda rows, least, strong: asked.append(strong) or first(rows, least, strong))
    rows = texts[:20]
    df = spark.createDataFrame(rows, "text string, lang string").repartition(2)
    assert mined(df, least=10) == plain(rows, 10) and asked == [False, True]


def test_odd_rows(spark, odd, none, odd_rows):
    rows = [(r[1], r[2]) for r in odd_rows if r[0] != 7]
    short = odd.where("doc_id IS NULL OR doc_id <> 7")
    assert mined(short, least=2) == plain(rows, 2)
    assert mined(none) == []
    more = [("a b. a b! a\tb \x0b a  b", None), ("A B a b a b", "x"), ("é \x00 é \x00 é \x00", ""), ("x" * 300 + " y", "x"), ("x" * 300 + " y", "x"), (None, "x"), ("a", "y")]
    clash = spark.createDataFrame([(*r, 1, "q", 5) for r in more], "text string, lang string, n long, words string, rank int")
    assert mined(clash, least=2) == plain(more, 2)
    word = "w" * 600_000  # longer than a slice
    long = [(f"a b {word} a b {word} a b", "x")]
    assert mined(spark.createDataFrame(long, "text string, lang string"), least=2) == plain(long, 2)


def test_quicksort_against_counting():
    r = np.random.default_rng(5)
    for _ in range(100):
        rows = r.integers(0, 4, (int(r.integers(1, 60)), 5))
        rows[np.cumsum(rows == 0, axis=1) > 0] = 0  # nothing behind the end
        n = r.integers(1, 4, len(rows))
        want = Counter()
        for row, c in zip(rows.tolist(), n.tolist()):
            for m in range(1, 6):
                if row[m - 1]:
                    want[tuple(row[:m])] += c
        got = list(phrases.multikey_quicksort([rows[:, k] for k in range(5)], n, 5))
        assert len(got) == len(dict(got)) and dict(got) == {p: c for p, c in want.items() if c >= 5}
        keys, counts = phrases._added(rows.astype(np.uint64))
        assert Counter({tuple(k): c for k, c in zip(keys.tolist(), counts.tolist())}) == Counter(map(tuple, rows.tolist()))


def test_windows_and_hashes():
    lower = [(w, b) for w in ("Straße", "THE", "x" * 100) for b in (" ", ". ")]
    text = "".join(w + b for w, b in lower)
    (h, _, start, end, data), = phrases.hashed("en", [text], False)
    assert [bytes(data[a:b]).decode() for a, b, x in zip(start, end, h) if x] == [w.lower() if w.isascii() else w[0].lower() + w[1:] for w, _ in lower]
    assert [x == 0 for x in h] == [False, False, True] * 3 and h[0] == h[1] and len(set(h.tolist())) == 4
    other = next(phrases.hashed("de", [text], False))[0]
    assert not set(h[h > 0].tolist()) & set(other.tolist())
    every = np.full(1 << (phrases.BITS - 6), ~np.uint64(0))
    found = phrases.windows(np.array([1, 2, 3, 0, 4, 0, 5, 6, 7, 8, 9, 10], np.uint64), every, every)
    assert found.tolist() == [[1, 2, 3, 0, 0], [2, 3, 0, 0, 0], [5, 6, 7, 8, 9], [6, 7, 8, 9, 10], [7, 8, 9, 10, 0], [8, 9, 10, 0, 0], [9, 10, 0, 0, 0]]
    assert phrases.windows(np.zeros(0, np.uint64), every, every).shape == (0, 5)


@pytest.mark.parametrize("block", [3, 400_000])
def test_equal_pointers_of_all_tasks_are_one_row(spark, monkeypatch, block):
    monkeypatch.setattr(phrases, "FLUSH_POINTERS", block)
    every = spark.sparkContext.broadcast(np.full(1 << (phrases.BITS - 6), ~np.uint64(0)))
    texts = ["a b c d e f g. a b", "b c d e f g, h", None, "", "a"]

    def stored(copies, tasks):
        df = spark.createDataFrame([("x", t) for t in texts] * copies, "lang string, text string").repartition(tasks)
        got = phrases.pointers(df, every, every).collect()
        return {tuple(r)[:5]: r["n"] for r in got}, len(got)

    once, rows = stored(1, 1)
    assert rows == len(once) == 7 and sum(once.values()) == 12  # six places of the long piece, one of the short; five shared
    again, more = stored(40, 8)
    assert more == rows and again == {k: 40 * n for k, n in once.items()}


def test_products_beyond_64_bits(spark):
    big = 3 * 10**12
    known = spark.createDataFrame([([1, 2], big)], "words array<long>, n long")
    words = spark.createDataFrame([(1, "x", "a", big + 5), (2, "x", "b", big + 7)], "h long, lang string, word string, n long")
    totals = spark.createDataFrame([("x", 10**13 + 1)], "lang string, n long")
    (r,) = phrases._ranked(known, words, totals, 5).collect()
    assert r["phrase"] == "a b" and r["score"] == 1000 * big * (10**13 + 1) // ((big + 5) * (big + 7))
