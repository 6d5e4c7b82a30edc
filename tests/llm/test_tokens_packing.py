"""Token files and packing against direct encoding; sequences and their fill."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from dosebin.llm import encode, packing, queries, tokens


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path(queries.WORDS_49K))


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def direct(tokenizer, text, end):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [end]


def test_encoding_is_that_of_the_library(tokenizer, odd_rows, monkeypatch):
    texts = [r[1] for r in odd_rows] + [
        "Don't we'll X'S 'tis", "Å é, ñ.", "İstanbul ΣΑΣ Σ", "a\x85b \x1c c d",
        "≠ = ̸, ≯", "<|startoftext|>a <|ENDOFTEXT|> x<|", "한 이", "...!!, ,a,b,,c. (d) [e]"
    ]
    want = [direct(tokenizer, t, 0)[:-1] for t in texts]
    vocabulary = queries.vocabulary()
    assert [np.frombuffer(d, "<u2").tolist() for d in encode.Encoder(vocabulary).encode(texts)] == want
    monkeypatch.setattr(encode, "CACHED_WORDS", 30)  # forgotten again and again
    monkeypatch.setattr(encode, "SLICE_BYTES", 100)
    monkeypatch.setattr(encode, "slices", lambda d, most=100, f=encode.slices: f(d, most))
    small = encode.Encoder(vocabulary)
    assert [np.frombuffer(d, "<u2").tolist() for d in small.encode(texts)] == want
    assert [np.frombuffer(small.encode([t])[0], "<u2").tolist() for t in texts] == want and small.older


def test_random_strings(tokenizer):
    """Marks, composed and decomposed letters, contractions, special tokens, in one batch and alone."""
    r = random.Random(11)
    pools = [
        "ab ,.\n  '", "the of 's 't 're ,.;:!? \t é", "x", "0123 abc.,;:!?<>/s'\"=+", "漢字かなカナ한국어 ,.", "😀👍🏽éàß́क़ ,.a",
        [chr(c) for c in range(0x300)], [chr(c) for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000],
        "a,.'s 'S'ReE=+̸̧́;`", ["<|endoftext|>", "<|", "a", ",", " ", "'s"], [*encode.MARKS.decode(), "a", "7", " ", "é", "'"],
    ]
    texts = ["".join(r.choice(pools[k % len(pools)]) for _ in range(r.randint(0, 40))) for k in range(20_000)]
    encoder = encode.Encoder(queries.vocabulary())
    assert encoder.parts_marks and encoder.lower
    got = [d for i in range(0, len(texts), 64) for d in encoder.encode(texts[i : i + 64])]
    want = tokenizer.encode_batch(texts, add_special_tokens=False)
    assert [np.frombuffer(d, "<u2").tolist() for d in got] == [w.ids for w in want]


def test_letters_that_normalize_to_letter_and_mark(tokenizer):
    parted = [
        0x130, *range(0x958, 0x960), 0x9DC, 0x9DD, 0x9DF, 0xA33, 0xA36, 0xA59, 0xA5A, 0xA5B, 0xA5E, 0xB5C, 0xB5D, 0xF43, 0xF4D, 0xF52,
        0xF57, 0xF5C, 0xF69, 0xFB1D, 0xFB1F, *range(0xFB2A, 0xFB37), 0xFB38, 0xFB39, 0xFB3A, 0xFB3B, 0xFB3C, 0xFB3E, 0xFB40, 0xFB41,
        0xFB43, 0xFB44, *range(0xFB46, 0xFB4F),
    ]
    texts = [f"a{chr(c)}{m}" for c in parted for m in ("", ",", "...", "_", "b,")] + ["ÉTÉ, été. Σ! 한, एक।"]
    encoder = encode.Encoder(queries.vocabulary())
    got = [np.frombuffer(d, "<u2").tolist() for d in encoder.encode(texts)]
    assert len(parted) == 60 and got == [direct(tokenizer, t, 0)[:-1] for t in texts]
    assert [encoder._only_letters(s.encode()) for s in ("a", "été", "a\u0130", "क़", "a1", "")] == [True, True, False, False, False, False]


def test_op1_against_direct_encoding(spark, folder, table, tokenizer):
    got = sorted(map(tuple, queries.op1_token_files(spark, folder).collect()))
    start, want = 0, []
    for r in sorted(table("documents"), key=lambda r: r["doc_id"]):
        ids = direct(tokenizer, r["text"], 2)
        want.append((r["doc_id"], start, len(ids), crc(ids)))
        start += len(ids)
    assert got == want


def test_token_files_of_odd_rows(spark, odd, odd_rows, none, tokenizer):
    manifest = tokens.write_tokens(odd, queries.vocabulary())
    rows = tokens.read_tokens(manifest).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, 1, 2, 3, 4, 5, 5, 6, 7, 8, 9]
    by_id = {r[0]: r[1] for r in odd_rows}
    start = 0
    for r in rows:
        ids = direct(tokenizer, by_id[r.doc_id], 2)
        assert (r.start, r.n_tokens, list(r.ids), r.ids_crc32) == (start, len(ids), ids, crc(ids))
        start += len(ids)
    folder = manifest.first()["path"].rsplit("/", 1)[0]
    assert tokens.load_manifest(spark, folder).count() == manifest.count()
    assert tokens.read_tokens(tokens.write_tokens(none, queries.vocabulary())).count() == 0


def check_packed(rows, capacity):
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for some in places.values():
        at = 0
        for offset, length in sorted(some):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


def test_op9_against_direct_encoding(spark, folder, table, tokenizer):
    rows = queries.op9_packing(spark, folder).collect()
    want = []
    for r in table("documents"):
        ids = direct(tokenizer, r["text"], 1)
        want += [(r["doc_id"], k // 4096, k, len(ids[k : k + 4096]), crc(ids[k : k + 4096])) for k in range(0, len(ids), 4096)]
    assert sorted(tuple(r)[:5] for r in rows) == sorted(want)
    assert check_packed(rows, 4096) <= -(-sum(r.length for r in rows) // 4096) + 1


def test_packing_odd_rows(spark, odd, none, tokenizer, odd_rows):
    packed = packing.pack_documents(odd, queries.vocabulary(), 4096)
    rows = packed.collect()
    check_packed(rows, 4096)
    assert sum(r.piece == 0 for r in rows) == len(odd_rows)
    assert {r.length for r in rows if r.doc_id in (1, 2, 3)} == {1}
    ids = {r.sequence_id: np.frombuffer(r.ids, "<u2").tolist() for r in packing.sequences(packed).collect()}
    for r in rows:
        assert ids[r.sequence_id][r.offset : r.offset + r.length] == np.frombuffer(r.ids, "<u2").tolist()
    assert packing.pack_documents(none, queries.vocabulary()).count() == 0


def test_many_blocks_lose_little(spark):
    n = 6000
    lengths = spark.range(n).select(F.col("id").alias("uid"), (F.pmod(F.xxhash64("id"), 60) + 1).alias("length"))
    packed = packing.pack(lengths, 100, block_pieces=700).join(lengths, "uid").collect()
    assert len(packed) == n
    assert check_packed(packed, 100) <= -(-sum(r.length for r in packed) // 100) * 1.005 + 1


def test_blocks_stay_bounded_when_nothing_fits(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(packing, "_packer", lambda c, last, f=packing._packer: seen.append(last) or f(c, last))
    lengths = spark.range(3000).select(F.col("id").alias("uid"), F.lit(60).cast("long").alias("length"))
    packed = packing.pack(lengths, 100, block_pieces=300)
    assert seen == [False, True] and packed.select("sequence_id").distinct().count() == packed.count() == 3000


def test_exchanges_empty_a_bin():
    # 6+4 and 7+3 fit two bins of 10, but are laid out in three.
    lengths, bins = np.array([6, 3, 7, 4]), np.array([0, 0, 1, 2])
    done = packing.improve(lengths, bins, 10)
    fill = np.bincount(done, weights=lengths)
    assert sorted(fill[fill > 0]) == [10, 10]
    random = np.random.default_rng(0)
    for _ in range(20):
        x = random.integers(1, 60, 80)
        before = packing.best_fit(x, 100)
        after = packing.improve(x, before, 100)
        fill = np.bincount(after, weights=x)
        assert fill.max() <= 100 and fill.sum() == x.sum() and (fill > 0).sum() <= before.max() + 1
        assert (fill**2).sum() >= (np.bincount(before, weights=x) ** 2).sum()


def test_pairs_of_any_documents_and_every_underfull_bin():
    # The pair that frees the giver is past its first 48 documents: 7 + 8 for the other bin's 14.
    lengths = np.array([2] * 60 + [7, 8] + [986, 14] + [864])
    bins = np.array([0] * 62 + [1, 1] + [2])
    sums, groups = packing._sums(lengths, np.flatnonzero(bins == 0))
    assert 15 in sums.tolist() and set(groups[sums.tolist().index(15)]) == {60, 61}
    # Ten bins can give nothing; the fuller ones after them can be emptied.
    hard = [501] * 10
    x = np.array([*hard, 600, 700, 300, 400])
    b = np.array([*range(10), 10, 11, 12, 12])
    done = packing.improve(x, b, 1000)
    fill = np.bincount(done, weights=x)
    assert fill.max() <= 1000 and (fill > 0).sum() == 12 and fill.sum() == x.sum()
