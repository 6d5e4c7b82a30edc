"""Exact merge-type encoding of whole texts by backtracking, and decoding.

A sequence of pieces is what merging adjacent pieces, best score first, makes of a text if
and only if every two neighbours are what merging makes of the two of them alone.  So an
encoding is found from left to right: take the longest piece that starts here (an
Aho-Corasick automaton gives them all in one pass), keep it if it stands next to the piece
before, else try its next shorter prefix, else go back one piece.  A text has one encoding
only, so a position from which no piece goes on can be no boundary; a bitfield remembers
it and nothing is tried twice.

No merge crosses two characters that follow each other in no piece.  Texts are cut there
into units, mostly words and signs, and a worker encodes each distinct unit once.
"""

from __future__ import annotations

import codecs
import hashlib
from array import array
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"  # the sign that vocabularies of this kind write for a space: a fixed value
KEPT_UNITS = 500_000
KEPT_LENGTH = 64
KEPT_PAIRS = 1_000_000
ROWS = 64
NEVER = float("-inf")
_CODERS: dict[str, Coder] = {}


def _each_byte(e: UnicodeDecodeError) -> tuple[str, int]:
    return "�", e.start + 1


codecs.register_error("replace-each-byte", _each_byte)


class Store:
    """A map of two generations: when the young one is full, the old one is forgotten.

    What is asked for again moves to the young one, so entries in use stay.
    """

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def age(self) -> None:
        if len(self.young) >= self.most:
            self.young, self.old = {}, self.young

    def put(self, key, value) -> None:
        self.age()
        self.young[key] = value

    def found(self, keys: set) -> dict:
        """Values of ``keys``, None where neither generation has one; those of the old one move to the young one.

        What follows looks into this small map, which a processor's cache holds, and not into the large ones.
        """
        here = dict(zip(keys, map(self.young.get, keys)))
        if self.old:
            for key in [k for k, value in here.items() if value is None]:
                if key in self.old:
                    here[key] = self.young[key] = self.old[key]
        return here


class Coder:
    """Encoder and decoder of a model of merge type, given as the bytes of its file.

    Characters without a piece become their bytes' pieces if the model has these, else the
    unknown piece.  Pieces that a user defined to be kept whole are not supported.
    """

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_proto=model)
        self.normalize = sp.normalize
        n = sp.get_piece_size()
        self.text = [sp.id_to_piece(i) for i in range(n)]
        plain = [not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)) for i in range(n)]
        self.ids = {p: i for i, p in enumerate(self.text) if plain[i]}
        self.scores = {p: sp.get_score(i) for p, i in self.ids.items()}
        self.size = [len(p) for p in self.text]
        self.shorter = [self._shorter(p) if plain[i] else -1 for i, p in enumerate(self.text)]
        self.unknown = sp.unk_id()
        self.byte_ids = {int(self.text[i][1:-1], 16): i for i in range(n) if sp.is_byte(i)}
        self.bare = [p.replace(SPACE, " ").encode() if plain[i] else b"" for i, p in enumerate(self.text)]
        for b, i in self.byte_ids.items():
            self.bare[i] = bytes([b])
        self.bare[self.unknown] = sp.decode([self.unknown]).encode()
        self.control = {i for i in range(n) if sp.is_control(i)}
        self.starts_blank = {i for p, i in self.ids.items() if p.startswith(SPACE)}
        self.drops_blank = sp.normalize("a").startswith(SPACE)  # a blank is put before every text
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            if len(p) > 1:
                self.automaton.add_word(p, i)
        self.automaton.make_automaton()
        self._follow()
        self.ends: dict[int, tuple | None] = {}
        self.units, self.pairs = Store(KEPT_UNITS), Store(KEPT_PAIRS)

    def _shorter(self, piece: str) -> int:
        """The longest piece that this one starts with, or -1."""
        return next((self.ids[piece[:k]] for k in range(len(piece) - 1, 0, -1) if piece[:k] in self.ids), -1)

    def _follow(self) -> None:
        """Number the characters of all pieces and mark which of them follow each other in one."""
        known = sorted(set("".join(self.ids)))
        self.number = np.zeros(0x110000, np.uint16 if len(known) < 65_535 else np.uint32)
        self.number[[ord(c) for c in known]] = np.arange(1, len(known) + 1)
        self.follow = np.zeros((len(known) + 1, len(known) + 1), bool)
        for p in self.ids:
            k = self.number[[ord(c) for c in p]]
            self.follow[k[:-1], k[1:]] = True
        self.gap = next(chr(c) for c in range(0x10FFFF, 0, -1) if not self.number[c])
        if not self.ids.keys() >= set(known):
            raise ValueError("every character of a piece must be a piece itself")
        self.single = np.array([-1, *map(self.ids.__getitem__, known)], np.int32)

    def _merges(self, text: str) -> tuple[list[str], list[tuple[float, str | None, str | None]]]:
        """Pieces left when adjacent ones are merged, best score first, the leftmost of equals; for short texts.

        And of each merge in order its score, and the first and the last part if it uses them up.
        """
        parts, done = list(text), []
        scores = self.scores
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            done.append((best, None if at else parts[0], parts[-1] if at == len(parts) - 2 else None))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts, done

    def merged(self, text: str) -> list[str]:
        return self._merges(text)[0]

    def _ends(self, piece: int) -> tuple[list[tuple[str, float]], list[tuple[str, float]]] | None:
        """First parts and last parts of a piece while its characters merge, each with the score at which it is used up.

        None if merging doesn't give the piece, or not by ever lower scores.
        """
        if piece not in self.ends:
            text, found = self.text[piece], None
            parts, done = self._merges(text)
            if parts == [text] and all(x[0] > y[0] for x, y in zip(done, done[1:])):
                found = tuple([*((m[side], m[0]) for m in done if m[side] is not None), (text, NEVER)] for side in (1, 2))
            self.ends[piece] = found
        return self.ends[piece]

    def _fit(self, before: int, piece: int) -> bool:
        left, right = self._ends(before), self._ends(piece)
        if left and right:
            # The parts at the border grow while scores fall; a merge across it must never be the best one.
            i = j = 0
            while True:
                (x, x_ends), (y, y_ends) = left[1][i], right[0][j]
                next_one = max(x_ends, y_ends)
                across = self.scores.get(x + y)
                if across is not None and across > next_one:
                    return False
                if next_one == NEVER:
                    return True
                if across == next_one or x_ends == y_ends:
                    break  # places decide between equal scores
                i, j = (i + 1, j) if x_ends > y_ends else (i, j + 1)
        pair = [self.text[before], self.text[piece]]
        return self.merged("".join(pair)) == pair

    def fits(self, before: int, piece: int) -> bool:
        """Whether merging gives these two pieces for the text of both; ``before`` is -1 at the start."""
        found = self._fit(before, piece) if before >= 0 else self.merged(self.text[piece]) == [self.text[piece]]
        self.pairs.put((before + 1) * len(self.text) + piece, found)
        return found

    def backtrack(self, longest: list[int], at: int, stop: int, out: list[int]) -> None:
        """Add the pieces of the unit from ``at`` to ``stop`` to ``out``, from the longest piece at each character."""
        size, shorter, pieces, known = self.size, self.shorter, len(self.text), self.pairs.young.get
        first, begin, failed = len(out), at, None
        piece, before = longest[at], 0  # the piece before, plus one, times the number of pieces
        while True:
            end = at + size[piece]
            if failed is None or not failed[end - begin >> 3] >> (end - begin & 7) & 1:
                fits = known(before + piece)
                if fits is None:
                    fits = self.fits(before // pieces - 1, piece)
                if fits:
                    out.append(piece)
                    if end == stop:
                        return
                    before = (piece + 1) * pieces
                    at, piece = end, longest[end]
                    continue
            piece = shorter[piece]
            while piece < 0:  # nothing goes on from here
                if failed is None:
                    failed = bytearray((stop - begin >> 3) + 1)
                failed[at - begin >> 3] |= 1 << (at - begin & 7)
                piece = out.pop()
                at -= size[piece]
                piece = shorter[piece]
                before = (out[-1] + 1) * pieces if len(out) > first else 0

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        found, known = {}, []
        for u in new:
            if len(u) > 1:
                known.append(u)
            elif u in self.ids:
                found[u] = array("i", [self.ids[u]]).tobytes()
            else:
                them = [self.byte_ids.get(b, self.unknown) for b in u.encode()] if self.byte_ids else [self.unknown]
                found[u] = array("i", them).tobytes()
        line = self.gap.join(known)
        longest = self.single[self.number[np.frombuffer(line.encode("utf-32-le"), "<u4")]].tolist()
        size = self.size
        for end, piece in self.automaton.iter(line):  # by end: the last one kept for a start is the longest
            longest[end + 1 - size[piece]] = piece
        at, out, ends = 0, [], [0]
        for u in known:
            stop = at + len(u)
            self.backtrack(longest, at, stop, out)
            ends.append(4 * len(out))
            at = stop + 1
        data = array("i", out).tobytes()
        found.update(zip(known, [data[a:b] for a, b in zip(ends, ends[1:])]))
        return found

    def cut(self, text: str) -> list[str]:
        """Units of a normalized text: parts that no merge crosses."""
        if len(text) < 2:
            return [text] if text else []
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        k = self.number[codes]
        ends = np.flatnonzero(~self.follow[k[:-1], k[1:]]) + 1
        if self.gap in text:
            return [text[a:b] for a, b in zip([0, *ends.tolist()], [*ends.tolist(), len(text)])]
        # Written with a gap at each end and split there: quicker than a slice for each unit.
        apart, inside = np.full(len(text) + len(ends), ord(self.gap), "<u4"), np.ones(len(text) + len(ends), bool)
        inside[ends + np.arange(len(ends))] = False
        apart[inside] = codes
        return apart.tobytes().decode("utf-32-le", "surrogatepass").split(self.gap)

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """Ids of each text as native 32-bit integers; null is empty."""
        cut = [self.cut(self.normalize(t)) if t else [] for t in texts]
        units = self.units
        units.age()
        here = units.found(set().union(*cut))
        learnt = self._learn([u for u, ids in here.items() if ids is None])
        here.update(learnt)
        units.young.update((u, ids) for u, ids in learnt.items() if len(u) <= KEPT_LENGTH)
        return [b"".join(map(here.__getitem__, some)) for some in cut]

    def decode(self, ids: list[int]) -> str:
        """Text of ids: control pieces are empty, bytes that are no text become a replacement sign each."""
        data = b"".join(map(self.bare.__getitem__, ids))
        if self.drops_blank:
            first = next((i for i in ids if i not in self.control), -1)
            if first in self.starts_blank:
                data = data[1:]
        return data.decode("utf-8", "replace-each-byte")


def coder(model: bytes) -> Coder:
    """The worker's coder of a model; kept from task to task."""
    key = hashlib.sha256(model).hexdigest()
    if key not in _CODERS:
        _CODERS[key] = Coder(model)
    return _CODERS[key]


def model_bytes(path: str) -> bytes:
    """A model file read on the driver; tasks get it by broadcast (about half a MB)."""
    with open(path, "rb") as f:
        return f.read()


def _with_column(rows: DataFrame, source: str, new: str, kind: str, to_type: pa.DataType, make, keep: list[str] | None) -> DataFrame:
    """Columns ``keep`` of ``rows`` and ``new``, made from column ``source`` some rows at a time."""
    kept = [c for c in (rows.columns if keep is None else keep) if c != new]
    read = rows.select(*kept, F.col(source).cast("array<int>" if kind == "string" else "string").alias("__source"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                some = batch.slice(i, ROWS)
                yield pa.RecordBatch.from_arrays([*some.columns[:-1], make(some.columns[-1]).cast(to_type)], [*kept, new])

    return read.mapInArrow(run, read.drop("__source").withColumn(new, F.lit(None).cast(kind)).schema)


def encode(docs: DataFrame, model: bytes, text_col: str = "text", ids_col: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (default: all) of every row and the ids of its whole text, an array of ints.

    Begin and end ids are not added.  A null text is empty, as is an empty one: no ids.  Repeated
    rows stay.  A column that is already called ``ids_col`` is replaced.  An empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make(texts: pa.Array) -> pa.Array:
        codes = coder(sent.value).encode(texts.to_pylist())
        offsets = np.cumsum([0, *(len(c) // 4 for c in codes)])
        flat = np.frombuffer(b"".join(codes), np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))

    return _with_column(docs, text_col, ids_col, "array<int>", pa.list_(pa.int32()), make, keep)


def decode(rows: DataFrame, model: bytes, ids_col: str = "ids", text_col: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (default: all) of every row and the text of its ids.

    Null ids are none, a null among them is left out.  Ids outside the vocabulary are an error.
    A column that is already called ``text_col`` is replaced.
    """
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def make(ids: pa.Array) -> pa.Array:
        c = coder(sent.value)
        if ids.flatten().null_count:
            return pa.array([c.decode([i for i in x or [] if i is not None]) for x in ids.to_pylist()], pa.string())
        # By numpy: an object of Arrow for each id takes longer than to decode it.
        ends = np.cumsum(ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).tolist()
        flat = ids.flatten().to_numpy().tolist()
        return pa.array([c.decode(flat[a:b]) for a, b in zip([0, *ends], ends)], pa.string())

    return _with_column(rows, ids_col, text_col, "string", pa.string(), make, keep)
