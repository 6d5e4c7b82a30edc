"""Base spans against the plain patterns, message passing against enumeration, added spans."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from conftest import SCHEMA, row

from dosebin.llm import pii, queries

PLAIN = [
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"),
    re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def plain(text):
    out = []
    for kind, pattern in enumerate(PLAIN):
        for m in pattern.finditer(text):
            d = re.sub("[^0-9]", "", m[0])
            ok = [True, kind == 1 and all(int(p) <= 255 for p in m[0].split(".")), 14 <= len(d) <= 19 and pii.luhn(d), 10 <= len(d) <= 15][kind]
            if ok:
                out.append((kind, *m.span()))
    return sorted(out, key=lambda s: (s[1], s[0]))


def test_base_spans_are_those_of_the_patterns():
    r = random.Random(4)
    pieces = ["a.b@c.de", "@", "x@y", ".", "..", "-", "+", " ", "  ", "(", ")", "1.2.3.4", "255.256.1.1", "007.1.2.3", "4111 1111 1111 1111", "12", "7", "é", "+1 (017) 555-7713", "A_%", "a@b.c.d-e@f.g"]
    for _ in range(4000):
        text = "".join(r.choice(pieces) for _ in range(r.randint(0, 9)))
        assert pii.base_spans(text) == plain(text), text


def test_long_runs_take_linear_time():
    for text in ("1" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "a@" * 60_000, "+1" * 60_000, "1 " * 100_000, "@" * 100_000):
        pii.base_spans(text), pii.tokens(text)


@pytest.fixture(scope="module")
def model(spark, folder):
    return pii.train(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))


def test_op8(spark, folder, table):
    got = {r.doc_id: r for r in queries.op8_personal_data(spark, folder).collect()}
    for d in table("documents"):
        r, want = got[d["doc_id"]], plain(d["text"] or "")
        joined = [f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in want]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in want) for k in range(4)]
        assert r.base_sha256 == hashlib.sha256(",".join(joined).encode()).hexdigest()
        assert set(joined) <= set(r.spans.split(",")) | {""}


def test_messages_are_exact_on_trees():
    r = np.random.default_rng(3)
    node = r.normal(size=(1 << pii.BITS, 5))
    model = pii.Model(node, r.normal(size=(5, 5)), 1.3)
    g = pii.Graph([(0, 1)] * 4, [4, 4, 1, 4], r.integers(0, 1 << pii.BITS, (4, 8)).tolist(), [(0, 1)], [(1, 2), (1, 3)])
    want = np.zeros((4, 5))
    for y in itertools.product(range(5), repeat=4):
        if y[2] != 1:
            continue
        s = sum(node[g.features[i], y[i]].sum() for i in range(4)) + model.chain[y[0], y[1]]
        s += sum(model.chain[4, y[i]] for i in (0, 2, 3)) + sum(model.chain[y[i], 4] for i in (1, 2, 3))
        s += 1.3 * ((y[1] == y[2]) + (y[1] == y[3]))
        for i in range(4):
            want[i, y[i]] += np.exp(s)
    want /= want.sum(1, keepdims=True)
    other = pii.Graph([], [], [], [], [])
    got = pii.marginals(model, [other, g, g], most=200, enough=1e-9)
    assert np.allclose(got[1], want, atol=1e-5) and np.allclose(got[2], want, atol=1e-5) and len(got[0]) == 0


def test_evidence_reaches_every_repeat():
    model = pii.Model(np.zeros((1 << pii.BITS, 5)), np.zeros((5, 5)), 7.0)
    n = 60
    g = pii.Graph([(0, 1)] * n, [3] + [4] * (n - 1), [[0] * 8] * n, [], [(i, i + 1) for i in range(n - 1)])
    keep = np.exp(7.0) / (np.exp(7.0) + 4)  # a link's labels agree
    want = 0.2 + 0.8 * (keep - (1 - keep) / 4) ** np.arange(n)
    for many in ([g], [pii.Graph([], [], [], [], []), g, g]):
        got = pii.marginals(model, many)[-1]
        assert np.allclose(got[:, 3], want, atol=1e-3) and (got[:, 3] > pii.SURE * 0.8).all()
    ring = g._replace(skip=[*g.skip, (0, n - 1)], labels=[3] + [4] * (n - 1))
    assert (pii.marginals(model, [ring])[0].argmax(1) == 3).all()


def test_distant_mentions_are_found_and_clean_text_is_left(model):
    text = "call +1 (017) 555-7713 today. " + "some words go here " * 50 + "or (017) 555-7713 later"
    spans = pii.find_spans(model, [text])[0]
    assert [s[3] for s in spans] == [True, False]
    assert text[spans[1][1] : spans[1][2]] == "(017) 555-7713"
    two = "pay 7536784127813050 4845168114407329 now"  # together too long for a card number
    assert any(two[a:b] == "4845168114407329" for _, a, b, _ in pii.find_spans(model, [two])[0]) or pii.luhn("4845168114407329") is False
    clean = ["version 1.2.3 of 2024-01-01 has 12345678 rows", "in 1999, 5 of 30 (or 12.5%) at 10:30", "token = \"9233a8ecf7c5b09f\" and @home", None, ""]
    assert pii.find_spans(model, clean) == [[]] * 5


def test_odd_rows(spark, odd, odd_rows, none, model):
    found = pii.with_spans(odd.withColumnRenamed("uid", "spans"), model)
    assert found.count() == len(odd_rows) and found.columns[-1] == "spans" and found.columns.count("spans") == 1
    masked = pii.mask(odd, model)
    assert masked.schema == odd.schema
    assert sorted(map(str, (r.text for r in masked.collect()))) == sorted(map(str, (r[1] for r in odd_rows)))
    assert pii.with_spans(none, model).count() == 0 and pii.mask(none, model).count() == 0
    blank = pii.train(none)
    assert pii.find_spans(blank, ["mail a@b.co and 017 555-7713"]) == [[(0, 5, 11, True)]]


def test_masks(spark, model):
    docs = spark.createDataFrame([row(1, "mail a@b.co, ip 1.2.3.4 or +1 (017) 555-7713."), row(2, "nothing"), row(3, "x@1.2.3.4 é")], SCHEMA)
    assert {r.doc_id: r.text for r in pii.mask(docs, model).collect()} == {1: "mail [EMAIL], ip [IP] or [PHONE].", 2: "nothing", 3: "[EMAIL] é"}


def test_numbers_written_in_another_way_are_linked():
    """In groups, in one piece, with and without prefix: the joined digits tie them."""
    forms = ["+1 415 555 0134", "+14155550134", "4155550134", "415 555 0134", "415-555-0134", "(415) 555-0134", "1-415-555-0134"]
    for a in forms:
        for b in forms:
            text = f"Call {a} today. Later text: {b} again, not 555 9999."
            g = pii.graph(text, pii.base_spans(text))
            at = text.index("Later")
            assert any(g.spans[i][0] < at < g.spans[j][0] for i, j in g.skip), (a, b)
            assert all("9999" not in text[slice(*g.spans[j])] for _, j in g.skip)
    long = "x" + "1" * 5000
    assert pii._features(f"{long} {long}2", 0, 5001)[1] != pii._features(f"{long[:-1]}b", 0, 5001)[1]  # whole tokens
