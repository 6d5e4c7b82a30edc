"""Decontamination against sets of windows."""

import hashlib
import random
import re

import pytest
from conftest import SCHEMA, prose, row

from dosebin.llm import decontam, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def brute(texts, items, n=10):
    """(words, hit words, items) of each text; items are (id, text)."""
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - n + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = []
    for t in texts:
        w, hit, found = words(t), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if (s := windows.get(tuple(w[k : k + size]))) is not None:
                    hit |= set(range(k, k + size))
                    found |= s
        out.append((len(w), len(hit), found))
    return out


def test_op3_against_windows(spark, folder, table):
    docs, items = table("documents"), table("benchmark")
    got = {r.doc_id: r for r in queries.op3_decontamination(spark, folder).collect()}
    want = brute([d["text"] for d in docs], [(str(i["item_id"]), i["text"]) for i in items])
    assert sum(w[1] > 0 for w in want) > 0
    for d, (n, hit, found) in zip(docs, want):
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        assert tuple(got[d["doc_id"]]) == (d["doc_id"], n, hit, len(found), digest, hit > 0)


def test_automaton_on_random_words():
    r = random.Random(2)
    for _ in range(60):
        items = [(str(i), " ".join(r.choice("abc") for _ in range(r.randint(0, 14)))) for i in range(r.randint(1, 8))]
        parsed = [(i, t.encode().split(), min(4, len(t.split()))) for i, t in items if t]
        auto = decontam.Automaton(parsed)
        texts = [" ".join(r.choice("abcd") for _ in range(r.randint(0, 40))) for _ in range(10)]
        for t, (_, hit, found) in zip(texts, brute(texts, items, 4)):
            runs, some = auto.scan(decontam.words_of(t))
            assert sum(b - a + 1 for a, b in runs) == hit and some == found
            assert all(x[1] + 1 < y[0] for x, y in zip(runs, runs[1:]))


@pytest.fixture(scope="module")
def items(spark):
    rows = [(1, prose(1, 40)), (1, prose(9, 12)), (None, "silver window"), (3, ""), (4, None), (5, prose(6, 3000)), (1, prose(1, 40))]
    return spark.createDataFrame([(*r, 0) for r in rows], "item_id long, text string, n_words long")


def test_odd_rows_in_one_block_and_many(spark, odd, odd_rows, items, none, monkeypatch):
    pairs = [("" if r.item_id is None else str(r.item_id), r.text) for r in items.collect()]
    want = sorted((str(r[0]), n, hit, sorted(s)) for r, (n, hit, s) in zip(odd_rows, brute([r[1] for r in odd_rows], pairs)))

    def got():
        found = decontam.find(odd, items).withColumn("hit", decontam.hit_words())
        return sorted((str(r.doc_id), r.n_words, r.hit, sorted(r["items"])) for r in found.collect())

    assert got() == want
    monkeypatch.setattr(decontam, "BLOCK_WORDS", 300)
    monkeypatch.setattr(decontam, "PART_WORDS", 50)
    assert got() == want
    stored = decontam.store_items(items, 10, 1.0, "item_id", "text")
    assert stored.blocks > 8 and stored.now is None  # the driver has read none
    sizes = [len(stored.automaton(b).vocabulary) for b in range(stored.blocks)]
    whole = [stored.automaton(b) for b in range(stored.blocks)]
    assert max(len(a.link) for a in whole) < 4 * 300 and len(sizes) == stored.blocks and stored.held == stored.blocks - 1
    assert decontam.find(none, items).count() == 0
    assert decontam.find(odd, items.limit(0)).where("size(runs) > 0").count() == 0


def test_cut_texts_hold_no_window(spark, items):
    leak = prose(1, 40)
    rows = [
        row(1, "Clean text here, untouched."), row(2, f"{prose(20, 80)}\n{leak} {prose(21, 80)}"), row(3, leak), row(4, None), row(5, ""),
        row(6, "x " * 60 + "silver " + leak + " window" + " y" * 60),
    ]
    docs = spark.createDataFrame(rows, SCHEMA)
    cut = decontam.decontaminate(docs, items)
    assert cut.schema == docs.schema
    got = {r.doc_id: r.text for r in cut.collect()}
    assert set(got) == {1, 2, 4, 5, 6} and got[1] == rows[0][1] and got[4] is None and got[5] == ""
    assert decontam.find(cut, items).where("size(runs) > 0").count() == 0
    assert len(words(got[2])) >= 150 and "silver" not in got[6] and got[6].count("x") == 60


def test_blocks_cut_as_one(spark, items, monkeypatch):
    """Cutting until nothing is hit, with one block and many, in chunks of single texts; rounds are few."""
    leak = prose(6, 3000).split()
    texts = [" ".join([*leak[k : k + 5], *leak[k + 900 : k + 930], *leak[k + 5 : k + 12], "end"]) for k in range(0, 60, 7)] + [None, "", "silver window"]
    docs = spark.createDataFrame([row(k, t) for k, t in enumerate(texts)], SCHEMA)
    one = {r.doc_id: r.text for r in decontam.decontaminate(docs, items, most_hit=1.0).collect()}
    monkeypatch.setattr(decontam, "BLOCK_WORDS", 200)
    monkeypatch.setattr(decontam, "PART_WORDS", 40)
    monkeypatch.setattr(decontam, "CHUNK_BYTES", 10)
    assert {r.doc_id: r.text for r in decontam.decontaminate(docs, items, most_hit=1.0).collect()} == one
    assert one[0].strip() == "end"  # the two ends met when the middle went, and went too
    stored, scans = decontam.store_items(items, 10, 1.0, "item_id", "text"), []
    real = stored.scan
    stored.scan = lambda t: scans.append(len(t)) or real(t)
    decontam.cut_texts(texts, stored)
    assert len(scans) == 3 and scans[0] == len([t for t in texts if t])
    assert decontam.united([(5, 6), (0, 1), (2, 3), (5, 9), (11, 12)]) == [(0, 3), (5, 9), (11, 12)]
