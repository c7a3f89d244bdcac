"""A unigram vocabulary read from a SentencePiece model file, and the lattice of a text.

Only the wire format of the public ``ModelProto`` is read here.  A file of the unigram kind
gives its own log-probabilities; a file of another kind orders its pieces by rank only, and
then the score of a piece is the logarithm of its rank by Zipf's law.  Scores are kept as
integers in units of 1/1024, so that sums do not depend on the order of addition and equal
the float arithmetic of the C++ library wherever that is exact.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
import struct
from dataclasses import dataclass, field
from operator import itemgetter

import ahocorasick

#: Where the public tokenizer files are in this environment; always a parameter.
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"

UNIT = 1024
LATIN_END = "\u0250"
#: Fixed values of the model format: kinds of pieces, the kind of a unigram model, the space
#: symbol, and the penalty of an unknown character below the least score.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM_KIND = 1
SPACE = "▁"
#: Marks a key whose part does not start with a space symbol.
BARE = "\x01"
UNKNOWN_PENALTY = 10


def _fields(raw: bytes):
    """(field number, value) of one protobuf message."""
    at = 0

    def varint():
        nonlocal at
        shift = value = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            value = varint()
        elif kind == 2:
            size = varint()
            value = raw[at : at + size]
            at += size
        else:
            size = {1: 8, 5: 4}[kind]
            value = raw[at : at + size]
            at += size
        yield tag >> 3, value


@dataclass
class Vocabulary:
    pieces: list[str]
    kinds: list[int]
    scores: list[int]
    unknown_id: int
    unknown_score: int
    dummy_prefix: bool
    #: No piece goes on beyond a space symbol, so that units can be segmented one by one.
    #: A character that no piece has, as a line end often is, separates as well.
    separable: bool
    key: str
    byte_ids: dict[int, int] = field(default_factory=dict)

    def __post_init__(self):
        # Texts of few scripts need few pieces.  The root of an automaton looks its children up
        # one by one, so units of ASCII or Latin letters have automata of their own; a piece
        # with another letter cannot occur in them.
        self.automata = [ahocorasick.Automaton() for _ in range(3)]
        self.known: list[set[str]] = [set(), set(), set()]
        for k, (piece, kind) in enumerate(zip(self.pieces, self.kinds)):
            if kind in (NORMAL, USER_DEFINED) and piece:
                letters = piece.replace(SPACE, "")
                first = 0 if letters.isascii() else 1 if max(letters) < LATIN_END else 2
                for automaton, known in zip(self.automata[first:], self.known[first:]):
                    automaton.add_word(piece, (len(piece), self.scores[k], k))
                    if len(piece) == 1:
                        known.add(piece)
        self.single = self.known[-1]
        for automaton in self.automata:
            if len(automaton):
                automaton.make_automaton()
        self.splits_lines = not any("\n" in p for p in self.pieces)
        self.has_bytes = len(self.byte_ids) == 256
        self.plain = [p if kind in (NORMAL, USER_DEFINED) else None for p, kind in zip(self.pieces, self.kinds)]

    def unknown_ids(self, char: str) -> list[int]:
        if self.has_bytes:
            return [self.byte_ids[b] for b in char.encode("utf-8", "surrogatepass")]
        return [self.unknown_id]

    def escape(self, text: str) -> str:
        if not text:
            return ""
        return (SPACE if self.dummy_prefix else "") + text.replace(" ", SPACE)

    def parts(self, text: str) -> list[str]:
        """Short keys of the parts between which no piece reaches, in order; see :meth:`unit`.

        A key leaves out the space symbol that nearly all parts start with: keys of Latin
        text are then short strings of one byte a character.
        """
        if not text:
            return []
        if not self.separable or not self.dummy_prefix:
            return [self._key(u) for u in self._split(self.escape(text))]
        if "  " in text or text[0] == " " or BARE in text or SPACE in text or (not self.splits_lines and "\n" in text):
            return [self._key(u) for u in self._split(self.escape(text))]
        if self.splits_lines:
            text = text.replace("\n", f" \n {BARE}")
        return text.split(" ")

    def _split(self, escaped: str) -> list[str]:
        if not self.separable:
            return [escaped]
        line = "\n|" if self.splits_lines else ""
        stop = "\n" if self.splits_lines else ""
        return re.findall(f"{line}{SPACE}+[^{SPACE}{stop}]*|[^{SPACE}{stop}]+", escaped)

    @staticmethod
    def _key(unit: str) -> str:
        if unit == "\n":
            return unit
        return unit[1:] if unit[0] == SPACE and SPACE not in unit[1:] and BARE not in unit and unit[1:] != "\n" else BARE + unit

    @staticmethod
    def unit(key: str) -> str:
        """The part of the escaped text that a key stands for."""
        if key[:1] == BARE:
            return key[1:]
        return key if key == "\n" else SPACE + key

    def units(self, text: str) -> list[str]:
        return [self.unit(key) for key in self.parts(text)]

    def arcs(self, unit: str):
        """``(end, (length, score, id))`` of all pieces in ``unit`` and of its unknown characters
        (id -1): by end, longest first, the unknown character last."""
        for known, automaton in zip(self.known, self.automata):
            if known.issuperset(unit):  # no character that is no piece of its own
                return automaton.iter(unit)
        unknown = (1, self.unknown_score, -1)
        odd = [(k, unknown) for k, c in enumerate(unit) if c not in self.single]
        return heapq.merge(self.automata[-1].iter(unit) if len(self.automata[-1]) else iter(()), odd, key=itemgetter(0))

    def decode(self, ids) -> str:
        try:
            text = "".join(map(self.plain.__getitem__, ids))
        except TypeError:  # bytes, control or unknown pieces
            text = self._decode_any(ids)
        text = text.replace(SPACE, " ")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text

    def _decode_any(self, ids) -> str:
        out, pending = [], bytearray()
        for k in ids:
            kind = self.kinds[k]
            if kind == BYTE:
                pending.append(int(self.pieces[k][3:5], 16))
                continue
            if pending:
                out.append(pending.decode("utf-8", "replace"))
                pending.clear()
            if kind != CONTROL:
                out.append(" \u2047 " if kind == UNKNOWN else self.pieces[k])
        if pending:
            out.append(pending.decode("utf-8", "replace"))
        return "".join(out)


def zipf_score(rank: float) -> float:
    return -math.log(rank + 2.7)


def parse_vocabulary(raw: bytes) -> Vocabulary:
    pieces, kinds, given = [], [], []
    model_kind, unknown_id, dummy, charsmap, squeeze = UNIGRAM_KIND, 0, True, b"", True
    for number, value in _fields(raw):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in _fields(value):
                if n == 1:
                    piece = v.decode("utf-8")
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            pieces.append(piece), kinds.append(kind), given.append(score)
        elif number == 2:
            for n, v in _fields(value):
                if n == 3:
                    model_kind = v
                elif n == 40:
                    unknown_id = v
        elif number == 3:
            for n, v in _fields(value):
                if n == 2:
                    charsmap = v
                elif n == 3:
                    dummy = bool(v)
                elif n == 4:
                    squeeze = bool(v)
    if charsmap or squeeze:
        raise ValueError("only models that leave the text as it is (identity normalizer) are supported")
    if model_kind != UNIGRAM_KIND:
        first = next((k for k, kind in enumerate(kinds) if kind == NORMAL), 0)
        given = [zipf_score(k - first) if kind == NORMAL else 0.0 for k, kind in enumerate(kinds)]
    scores = [round(x * UNIT) for x in given]
    least = min((s for s, kind in zip(scores, kinds) if kind == NORMAL), default=0)
    return Vocabulary(
        pieces, kinds, scores, unknown_id, least - UNKNOWN_PENALTY * UNIT, dummy,
        not any(SPACE in p.lstrip(SPACE) for p in pieces), hashlib.sha256(raw).hexdigest(),
        {int(p[3:5], 16): k for k, (p, kind) in enumerate(zip(pieces, kinds)) if kind == BYTE},
    )


_LOADED: dict[str, Vocabulary] = {}


def worker_vocabulary(raw: bytes) -> Vocabulary:
    """Parsed once a Python process."""
    key = hashlib.sha256(raw).hexdigest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = parse_vocabulary(raw)
    return _LOADED[key]


#: Characters of a part that is worth remembering: longer ones, of text without spaces, hardly come again.
LONGEST = 64


class Remembered(dict):
    """Values by key in two generations: words in use stay, memory is bounded."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > LONGEST:
                return value
        if len(self) >= self.most:
            self.old = self.copy()
            self.clear()
        self[key] = value
        return value
