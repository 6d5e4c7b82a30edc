"""Source divergence against plain dictionaries; run-length columns; numbers beyond 64 bits."""

import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from dosebin.llm import divergence


def plain(rows, least=3, most=200):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower)
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]

        def p_of(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 1) // (total + len(kept)) for t in kept}

        p = {s: p_of(counts[lang, s]) for s in sources}
        q = p_of(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in sources - {s}]
            terms = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, cut in (("pair", pairs, None), ("term", terms, most)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:cut]
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(ranked, 1)]
    return sorted(out)


def audited(df, **kw):
    return sorted(map(tuple, divergence.audit(df, **kw).collect()))


def test_real_documents_against_plain_counts(spark, folder, table, monkeypatch):
    rows = [(r["text"], r["lang"], r["source"]) for r in table("documents")]
    want = plain(rows)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert audited(docs) == want
    monkeypatch.setattr(divergence, "RANGE_ROWS", 37)  # many ranges of the vocabulary
    monkeypatch.setattr(divergence, "FLUSH", 50)
    assert audited(docs) == want


def test_odd_rows(spark, odd, none, odd_rows):
    rows = [(r[1], r[2], r[3]) for r in odd_rows]
    assert audited(odd, least_docs=2, top_terms=5) == plain(rows, 2, 5)
    more = [*rows, ("É é", "", "t"), ("only here", "xx", "a"), ("", "xx", "b"), (None, "xx", None), ("漢字 ß ẞ A_b1c", None, "t")]
    clash = spark.createDataFrame([(*r, 1, "x", 2) for r in more], "text string, lang string, source string, n long, term string, counts int")
    assert audited(clash) == plain(more)
    assert audited(none) == []
    no_terms = [r for r in audited(clash) if r[0] == "xx"]
    assert len(no_terms) == 6 and all(r[2] == "pair" and r[4] == 0 for r in no_terms)


def test_runs_and_their_intersection():
    r = np.random.default_rng(3)
    for _ in range(200):
        size = int(r.integers(1, 40))
        dense = [r.integers(0, 3, size) * r.integers(0, 2, size) for _ in range(3)]
        words = r.integers(1, 6, size)
        columns = []
        for c in dense:
            at = np.flatnonzero(c)
            starts, values = divergence.runs(at, c[at], size)
            assert (np.repeat(values, np.diff(np.r_[starts, size])) == c).all() and (values[1:] != values[:-1]).all()
            columns.append((starts, divergence.shares(values, 50)))
        got = divergence.pair_sums(columns, np.r_[0, np.cumsum(words)])
        p = [[1 + 10**9 * (int(x) + 1) // 50 for x in c] for c in dense]
        for s in range(3):
            for t in range(3):
                if s != t:
                    assert got[s, t] == sum((a - b) ** 2 // b * int(w) for a, b, w in zip(p[s], p[t], words))
    assert [x.tolist() for x in divergence.runs(np.zeros(0, np.int64), np.zeros(0, np.int64), 4)] == [[0], [0]]


def test_counts_beyond_64_bits(spark):
    counts = [0, 5, 9_000_000_000, 4 * 10**12]
    total = 10**13 + 7
    want = [1 + 10**9 * (c + 1) // total for c in counts]
    assert divergence.shares(np.array(counts), total).tolist() == want
    df = spark.createDataFrame([(c, total) for c in counts], "n long, t long")
    assert [r[0] for r in df.select(divergence._share(F.col("n"), F.col("t"))).collect()] == want
