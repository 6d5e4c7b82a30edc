"""Whole texts to token ids, with each distinct word encoded once per worker.

The vocabulary's pattern never joins characters over white space, and a run of
letters is one unit of its own, so a text's ids are those of its words in order.  Where
the pattern also parts ASCII letters and digits from marks, words are cut there first, so that
only words without their marks have to be known.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np

CACHED_WORDS = 500_000
JOINED_WORDS = 200
SLICE_BYTES = 1 << 20
SPACE = re.compile(rb"[ \n\t\r]")
# Marks that end a word's letters and start a unit of their own, whatever follows; the
# apostrophe and the signs of special tokens and of combined characters are not among them.
MARKS = b".,;:!?*#$%&()[]{}\"/\\+-_@"
BETWEEN = b"\xff"  # in no text
# 1 for ASCII letters and digits, 2 for marks: a place between the two is where words are cut.
KIND = np.array([1 if chr(b).isalnum() and b < 128 else 2 if b in MARKS else 0 for b in range(256)], np.uint8)
_ENCODERS: dict[str, Encoder] = {}


def slices(data: bytes, most: int = SLICE_BYTES) -> Iterator[bytes]:
    """``data`` in parts of about ``most`` bytes, cut at white space."""
    at = 0
    while len(data) - at > most:
        m = SPACE.search(data, at + most)
        if not m:
            break
        yield data[at : m.start()]
        at = m.end()
    yield data[at:] if at else data


class Encoder:
    """Ids of texts by a vocabulary of the ``tokenizers`` library, special tokens not added."""

    def __init__(self, vocabulary: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.letters: set[str] = set()
        self.lower = self._ignores_case()
        self.parts_marks = self._parts_marks()
        self.ends = self._word_ends(json.loads(vocabulary)["model"].get("end_of_word_suffix"), size)

    def _ignores_case(self) -> bool:
        words = ["The", "QUICK", "Éa"]
        return all(
            self.tokenizer.encode(w, add_special_tokens=False).ids
            == self.tokenizer.encode(w.encode().lower().decode(), add_special_tokens=False).ids
            for w in words
        )

    def _parts_marks(self) -> bool:
        """Whether marks are units apart from ASCII letters and digits on both sides."""
        ids = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        return all(ids(a + m + a) == ids(a) + ids(m) + ids(a) for m in MARKS.decode() for a in ("a", "re", "7"))

    def _word_ends(self, suffix: str | None, size: int) -> np.ndarray | None:
        """Which ids end a word; None if the vocabulary doesn't tell."""
        if not suffix:
            return None
        ends = np.zeros(size, bool)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            ends[i] = token.endswith(suffix)
        return ends

    def _only_letters(self, stem: bytes) -> bool:
        """Whether a stem is letters that stay letters when normalized; some become letter and mark."""
        text = stem.decode()
        if not text.isalpha():
            return False
        for c in () if self.letters.issuperset(text) else set(text).difference(self.letters):
            if self.tokenizer.normalizer and not self.tokenizer.normalizer.normalize_str(c).isalpha():
                return False
            self.letters.add(c)
        return True

    def _learn(self, words: set[bytes]) -> None:
        """Make all ``words`` known.  Of the store's two generations the older is forgotten when the young one is full."""
        if len(self.known) > CACHED_WORDS:
            self.known, self.older = {}, self.known
        known = self.known
        words = words.difference(known)
        if self.older and words:
            again = words.intersection(self.older)
            known.update(zip(again, map(self.older.__getitem__, again)))
            words -= again
        cut, letters, others = [], set(), set()
        for w in words:
            if w.isalpha():  # ASCII letters
                letters.add(w)
                continue
            stem = w.rstrip(MARKS)
            if self._only_letters(stem):
                letters.add(stem)
                if len(stem) < len(w):
                    others.add(w[len(stem) :])
                    cut.append((w, stem, w[len(stem) :]))
            else:
                others.add(w)
        joined = [] if self.ends is None else list(letters.difference(known))
        alone = self._learn_lines([joined[i : i + JOINED_WORDS] for i in range(0, len(joined), JOINED_WORDS)])
        alone += (others if self.ends is not None else others | letters).difference(known)
        for i in range(0, len(alone), 20_000):
            some = alone[i : i + 20_000]
            codes = self.tokenizer.encode_batch_fast([p.decode() for p in some], add_special_tokens=False)
            known.update((p, array(self.dtype.char, c.ids).tobytes()) for p, c in zip(some, codes))
        for w, stem, marks in cut:
            known[w] = known[stem] + known[marks]

    def _learn_lines(self, lines: list[list[bytes]]) -> list[bytes]:
        """Encode words of letters, many as one line, and part its ids where words end; returns the words of lines where that fails."""
        failed = []
        for words, code in zip(lines, self.tokenizer.encode_batch_fast([b" ".join(x).decode() for x in lines], add_special_tokens=False)):
            ids = np.array(code.ids, self.dtype)
            stops = ((np.flatnonzero(self.ends[ids]) + 1) * self.dtype.itemsize).tolist()
            if len(stops) != len(words):
                failed += words
                continue
            data = ids.tobytes()
            self.known.update((w, data[a:b]) for w, a, b in zip(words, [0, *stops], stops))
        return failed

    def _parted(self, data: bytes) -> bytes:
        """A space between ASCII letters or digits and marks."""
        held = np.frombuffer(data, np.uint8)
        kind = KIND[held]
        at = np.flatnonzero(kind[:-1] + kind[1:] == 3) + 1
        return np.insert(held, at, 32).tobytes() if len(at) else data

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """Ids of each text as the bytes of little-endian ``self.dtype``; null is empty."""
        out: list[list[bytes]] = []
        plain: list[tuple[int, bytes]] = []  # slices without a sign of special tokens
        size = 0

        def flush(some: list[tuple[int, bytes]], part: bool) -> None:
            data = BETWEEN.join(x[1] for x in some)
            words = [x.split() for x in (self._parted(data) if part else data).split(BETWEEN)]
            self._learn(set().union(*words))
            for (k, _), w in zip(some, words):
                out[k].append(b"".join(map(self.known.__getitem__, w)))

        for k, text in enumerate(texts):
            out.append([])
            data = (text or "").encode()
            special = b"<|" in data
            if special:
                for piece in slices(data):
                    flush([(k, piece)], False)
                continue
            for piece in slices(data.lower() if self.lower else data):
                plain.append((k, piece))
                size += len(piece)
                if size > SLICE_BYTES:
                    flush(plain, self.parts_marks)
                    plain, size = [], 0
        if plain:
            flush(plain, self.parts_marks)
        return [x[0] if len(x) == 1 else b"".join(x) for x in out]


def encoder(vocabulary: str) -> Encoder:
    """The worker's encoder of a vocabulary; kept from task to task."""
    key = hashlib.sha256(vocabulary.encode()).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(vocabulary)
    return _ENCODERS[key]
