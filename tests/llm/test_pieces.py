"""Encoding by backtracking and decoding against the library, piece by piece."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from dosebin.llm import pieces, queries

PATH = public_tokenizers.path(queries.PIECES_32K)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def coder():
    return pieces.Coder(pieces.model_bytes(PATH))


def ids(data):
    return np.frombuffer(data, np.int32).tolist()


def made_up(coder, n):
    r = random.Random(5)
    pools = [
        "ab ▁\n  ", "the of and ing tion   \t é", "x", "0123 abc.,;:!?<>/s'\"", "漢字かなカナ한국어 ", "😀👍🏽éàß́क़ ",
        [chr(c) for c in range(0x300)], [chr(c) for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000],
        [p.replace("▁", " ") for p in coder.text[3:]], coder.text[259:2000],
    ]
    for k in range(n):
        yield "".join(r.choice(pools[k % len(pools)]) for _ in range(r.randint(0, 40)))


def test_encoding_and_decoding_are_those_of_the_library(library, coder, odd_rows, monkeypatch):
    texts = [*[r[1] or "" for r in odd_rows], "<s>hi</s><unk><0x41>", "▁a b▁", " ", "x" * 5000, " " * 3000, "ab" * 999 + "é", *made_up(coder, 6000)]
    want = library.encode(texts)
    assert [ids(c) for c in coder.encode(texts)] == want
    assert [coder.decode(w) for w in want] == library.decode(want)
    monkeypatch.setattr(pieces, "KEPT_LENGTH", 3)
    small = pieces.Coder(pieces.model_bytes(PATH))
    small.units.most = small.pairs.most = 50  # forgotten again and again
    again = [ids(small.encode([t])[0]) for t in texts]
    assert again == want and len(small.units.young) < 2000 and small.units.old


def test_decoding_of_any_ids(library, coder):
    r = random.Random(7)
    for _ in range(3000):
        some = [r.randrange(32_000) if r.random() < 0.5 else r.randrange(300) for _ in range(r.randint(0, 12))]
        assert coder.decode(some) == library.decode(some)


def test_parts(library, coder):
    # Any two pieces that the library puts next to each other fit, and pairs it parts in another way don't.
    r = random.Random(3)
    for _ in range(2000):
        a, b = r.randrange(259, 32_000), r.randrange(259, 32_000)
        text = coder.text[a] + coder.text[b]
        assert coder.fits(a, b) == (coder.merged(text) == [coder.text[a], coder.text[b]])
    for text in made_up(coder, 300):
        normal = coder.normalize(text)
        assert "".join(coder.cut(normal)) == normal
    # "th" + "e" can stand in "the" by its pieces, but merging doesn't stop there
    assert not coder.fits(coder.ids["th"], coder.ids["e"])
    words = [coder.normalize(w) for w in made_up(coder, 300) if w]
    longest = [max((w[:k] for k in range(1, 17) if w[:k] in coder.ids), key=len, default="") for w in words]
    first = [coder.text[ids(coder.encode([w[1:].replace("▁", " ")])[0])[0]] for w in words]
    assert any(a and a != b for a, b in zip(longest, first))  # the longest piece is not always right


def test_op13_against_the_library(spark, folder, table, library):
    got = sorted(map(tuple, queries.op13_pieces(spark, folder).collect()))
    want = []
    for r in table("documents"):
        code = library.encode(r["text"] or "")
        listed = ",".join(map(str, code)).encode()
        want.append((r["doc_id"], len(code), hashlib.sha256(listed).hexdigest(), hashlib.sha256(library.decode(code).encode()).hexdigest()))
    assert got == sorted(want)


def test_odd_rows(spark, odd, none, odd_rows, library):
    model = pieces.model_bytes(PATH)
    clash = odd.withColumnRenamed("size", "ids").withColumnRenamed("uid", "decoded")
    back = pieces.decode(pieces.encode(clash, model), model)
    assert set(back.columns) == set(clash.columns)
    rows = sorted((str(r["doc_id"]), r["text"] or "", list(r["ids"]), r["decoded"]) for r in back.collect())
    assert rows == sorted((str(r[0]), r[1] or "", library.encode(r[1] or ""), library.decode(library.encode(r[1] or ""))) for r in odd_rows)
    assert pieces.decode(pieces.encode(none, model), model).count() == 0
    holes = spark.createDataFrame([(None,), ([],), ([None, 264],)], "ids array<int>")
    assert [r["decoded"] for r in pieces.decode(holes, model, keep=[]).collect()] == ["", "", "a"]


def test_units_are_looked_up_once_a_batch(library):
    """Every occurrence of a unit was looked up among all units that the worker had kept."""

    class Counted(dict):
        asked = 0

        def __getitem__(self, key):
            Counted.asked += 1
            return super().__getitem__(key)

        def get(self, key, *default):
            Counted.asked += 1
            return super().get(key, *default)

    small = pieces.Coder(pieces.model_bytes(PATH))
    small.units.young = Counted()
    texts = ["the of and, again. " * 300] * 3
    assert [ids(c) for c in small.encode(texts)] == library.encode(texts) and Counted.asked < 20


def test_the_sign_between_units_may_stand_in_a_text(library, coder):
    texts = [f"one{coder.gap}two {coder.gap}{coder.gap}", coder.gap, f"{coder.gap}a", "plain, text", ""]
    want = library.encode(texts)
    assert [ids(c) for c in coder.encode(texts)] == want and [coder.decode(w) for w in want] == library.decode(want)
