"""Language and quality classifiers: held-out accuracy, bounded samples, odd rows."""

import zlib

import numpy as np
import pytest
from conftest import prose

from dosebin.llm import hashing, langid, quality, queries


@pytest.fixture(scope="module")
def larger():
    return "/root/testdata/sf0.01"


def test_op2_held_out_accuracy(spark, larger):
    rows = queries.op2_language(spark, larger).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{larger}/documents.parquet").collect()}
    assert len(rows) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.98


def test_op6_held_out_accuracy(spark, larger):
    rows = queries.op6_quality(spark, larger).collect()
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{larger}/labels.parquet").collect()}
    held = [r for r in rows if r.held_out and r.doc_id in label]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert np.mean([r.predicted == label[r.doc_id] for r in held]) > 0.95
    good = np.array([r.score for r in held if label[r.doc_id] == 1])
    bad = np.array([r.score for r in held if label[r.doc_id] == 0])
    assert (good[:, None] > bad[None]).mean() > 0.97


def plain_shares(text):
    """N-grams counted one by one from a list of bytes."""
    letters, word_end = [32], True
    for b in (text or "").lower().encode():
        letter = b >= 128 or 97 <= b <= 122
        if letter or not word_end:
            letters.append(b if letter else 32)
        word_end = not letter
    if not word_end:
        letters.append(32)
    counts = np.zeros(1 << langid.BITS)
    for k in range(1, langid.RUN + 1):
        for i in range(len(letters) - k + 1):
            h = 0
            for b in letters[i : i + k]:
                h = ((h * 0x01000193 & 0xFFFFFFFF) ^ b) * 0x9E3779B1 & 0xFFFFFFFF
            counts[h >> (32 - langid.BITS)] += 1
    return np.sqrt(counts / max(1, counts.sum()))


def test_op2_against_plain_counts_and_a_search_of_all_codewords(spark, folder, table):
    model = langid.train(spark.read.parquet(f"{folder}/documents.parquet"))
    got = {r.doc_id: r for r in queries.op2_language(spark, folder).collect()}
    for r in table("documents")[:60]:
        x = plain_shares(r["text"])
        assert np.abs(langid.shares(r["text"]) - x).max() < 1e-6
        bits = [sum(x[i] * float(model.weights[i, b]) for i in np.flatnonzero(x)) + float(model.bias[b]) for b in range(model.codes.shape[1])]
        losses = []
        for code, trust in zip(model.codes.tolist(), model.trust.tolist()):
            losses.append(sum(t * np.log1p(np.exp(-c * b)) for t, c, b in zip(trust, code, bits)))
        best = int(np.argmin(losses))
        odds = [np.exp(-(v - losses[best]) * len(bits)) for v in losses]
        if r["text"] and any(c.isalpha() for c in r["text"]):
            assert got[r["doc_id"]].lang_pred == model.languages[best]
            assert got[r["doc_id"]].score == pytest.approx(1 / sum(odds), abs=1e-4)
            assert got[r["doc_id"]].ambiguous == (sorted(losses)[1] - losses[best] < langid.AMBIGUOUS)


def test_signs_that_are_no_letters(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["½", "²", "Ⅷ", "①", "_ 12", "½ a", "漢"])], "doc_id long, text string")
    model = langid.Model(["en", "fr"], langid.codewords(2), np.ones((2, 1)), np.zeros((1 << langid.BITS, 1)), np.zeros(1))
    found = {r.doc_id: (r.lang_pred, r.score) for r in langid.with_language(docs, model).collect()}
    assert [found[i] for i in range(5)] == [("und", 0.0)] * 5 and found[5][0] == found[6][0] == "en"


def test_quality_updates_against_single_weights():
    """Follow the regularised leader, one weight at a time, in plain Python."""
    r = np.random.default_rng(2)
    rows = [(r.integers(0, 12, int(r.integers(1, 9))).astype(np.uint32), int(r.random() < 0.4)) for _ in range(40)]
    model = quality.fit(rows, 0.4, epochs=2, alpha=0.5, beta=1.0, l1=1e-3, l2=1e-2, scale=3.0, seed=7)
    z, n, zb, nb = [0.0] * 12, [0.0] * 12, 0.0, 0.0
    ones = sum(y for _, y in rows)
    order = np.random.default_rng(7)

    def weight(i):
        return 0.0 if abs(z[i]) <= 1e-3 else -(z[i] - np.sign(z[i]) * 1e-3) / ((1.0 + n[i] ** 0.5) / 0.5 + 1e-2)

    def bias():
        return -zb / ((1.0 + nb**0.5) / 0.5)

    for _ in range(2):
        for k in order.permutation(40).tolist():
            x, y = rows[k]
            value = {int(i): 3.0 * x.tolist().count(i) / len(x) for i in x}
            p = 1 / (1 + np.exp(-sum(v * weight(i) for i, v in value.items()) - bias()))
            g = (p - y) * 20 / (ones if y else 40 - ones)
            for i, v in value.items():
                w, new = weight(i), n[i] + (g * v) ** 2
                z[i] += g * v - (new**0.5 - n[i] ** 0.5) / 0.5 * w
                n[i] = new
            zb, nb = zb + g - ((nb + g * g) ** 0.5 - nb**0.5) / 0.5 * bias(), nb + g * g
    assert model.weights[:12] == pytest.approx([3.0 * weight(i) for i in range(12)], rel=1e-5, abs=1e-7)
    assert model.bias == pytest.approx(bias()) and np.count_nonzero(model.weights) <= 12


def test_codewords_are_apart():
    for n in (2, 3, 4, 5, 6, 12, 40):
        code = langid.codewords(n)
        apart = (code[:, None] != code[None]).sum(2)[~np.eye(n, dtype=bool)]
        assert apart.min() >= (1 if n == 2 else 2) and len(np.unique(np.abs(code.sum(0)) == n)) == 1
        assert apart.min() >= code.shape[1] // 4 or n < 6


def test_one_wrong_bit_is_corrected():
    code = langid.codewords(5)
    model = langid.Model(list("abcde"), code, np.full(code.shape, 1 / code.shape[1]), np.eye(code.shape[1]), np.zeros(code.shape[1]))
    for c in range(5):
        for bit in range(code.shape[1]):
            x = 3.0 * code[c].astype(float)
            x[bit] *= -1
            best, score, _ = langid.decode(model, x[None])
            assert best[0] == c and 0 < score[0] <= 1
    assert langid.decode(model, np.zeros((1, code.shape[1])))[2][0]  # nothing known: ambiguous


def test_token_hashes_do_not_depend_on_place_or_slices(monkeypatch):
    a = hashing.token_hashes(np.frombuffer(b"  one two  three one ", np.uint8))
    assert len(a) == 4 and a[0] == a[3] and len(set(a.tolist())) == 3
    text = prose(3, 4000) + "\n" + prose(4, 300)
    whole, shares = np.sort(quality.feature_indices(text)), langid.shares(text)
    monkeypatch.setattr(hashing, "SLICE", 500)
    for module in (quality, langid):
        monkeypatch.setattr(module, "text_slices", lambda t, f=hashing.text_slices: f(t))
    assert (np.sort(quality.feature_indices(text)) == whole).all()
    assert np.abs(langid.shares(text) - shares).max() < 0.02


def test_a_score_is_a_sparse_dot_product():
    x = quality.feature_indices("one two one two !!! one")
    model = quality.Model(np.arange(1 << quality.BITS, dtype=np.float32) / 1e5, 0.25, 0.5)
    i, n = np.unique(x, return_counts=True)
    assert np.isclose(quality.score(model, "one two one two !!! one"), 1 / (1 + np.exp(-(model.weights[i] @ (n / len(x)) + 0.25))))


def test_odd_rows(spark, odd, odd_rows, none):
    docs = odd.union(odd.where("doc_id = 6").selectExpr("doc_id + 100", "text", "'fr'", "source", "n_chars", "size", "id", "label", "uid"))
    model = langid.train(docs, sample_rows=100)
    found = langid.with_language(docs.withColumnRenamed("label", "score"), model)
    assert found.columns == ["doc_id", "text", "lang", "source", "n_chars", "size", "id", "uid", "lang_pred", "score", "ambiguous"]
    by_id = {r.doc_id: r for r in found.collect()}
    assert {by_id[i].lang_pred for i in (1, 2, 3)} == {"und"} and by_id[1].score == 0 and by_id[6].lang_pred in ("en", "fr")
    assert langid.train(none) is None and langid.train(docs.where("doc_id = 1")) is None
    assert {r.lang_pred for r in langid.with_language(odd, None).collect()} == {"und"}
    assert langid.with_language(none, model).count() == 0

    labels = spark.createDataFrame([(4, 1), (4, 0), (6, 1), (7, None), (77, 1), (None, 1), (6, 1), (9, 1)], "doc_id long, quality int")
    model = quality.train(odd, labels)
    scored = quality.with_score(odd, model)
    assert scored.columns == [*odd.columns, "score"] and scored.count() == len(odd_rows)
    by_id = {r.doc_id: r.score for r in scored.collect()}
    assert by_id[1] == by_id[2] == by_id[3] and by_id[4] == by_id[5] < by_id[6]
    blank = quality.train(odd, labels.limit(0))
    assert {r.score for r in quality.with_score(odd, blank).collect()} == {0.5}
    assert quality.with_score(none, model).count() == 0


def test_held_out_rows_teach_nothing(spark, odd):
    ids = [i for i in range(1, 60) if zlib.crc32(str(i).encode()) % 5 == 0][:4]
    rows = [(i, "some words here", "xx") for i in ids]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.train(docs) is None
    labels = spark.createDataFrame([(i, 1) for i in ids], "doc_id long, quality int")
    assert quality.train(docs, labels).prior == 0.5
