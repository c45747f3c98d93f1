"""Whole texts to token ids with the tokenizers library, remembering the ids of words seen before.

Both vocabularies in use split text before they merge, and never across a boundary between a non-space
character and a single space or line feed that a non-space character follows. So a text is cut there,
each distinct piece is encoded once a worker (bounded memory), and the ids are joined. Texts with other
white space, white space beside white space, or "<|" (special tokens) go to the tokenizer whole.
"""

from __future__ import annotations

import os
import re
from array import array

#: Bytes of pieces and ids that a worker remembers at most, in each of two generations.
REMEMBER = 24 << 20
#: What a remembered piece takes besides its characters and ids.
_ENTRY = 200
#: White space other than a single space or line feed between words.
_ODD = ("  ", " \n", "\n ", "\n\n", *"\t\v\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000", *map(chr, range(0x2000, 0x200B)))
#: Separators that Python's split() takes for white space and the vocabularies' patterns do not.
_UNLIKE = "\x1c\x1d\x1e\x1f"
#: Beyond these Latin letters, and at the one whose lower case is two, the tokenizer's own rules are asked.
_BEYOND = re.compile("[\u0130\u0250-\U0010ffff]")
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_open: dict[str, "Encoder"] = {}


def _byte_letters() -> dict[int, int]:
    """Byte-level vocabularies write a byte as itself where that prints, and the others as the letters from 256 on."""
    others = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b)]
    return {b: 256 + k for k, b in enumerate(others)}


class _Pieces(dict):
    """Piece to ids, as little-endian unsigned 32-bit bytes; looking up a new piece encodes it."""

    def __init__(self, encoder: "Encoder", lead: str):
        self.encoder, self.lead, self.letters = encoder, lead, _byte_letters()
        self.lower, self.tokenize = encoder.lower, encoder.t.model.tokenize
        self.mark = lead.translate(self.letters)
        # a Latin letter as the letters of its UTF-8 bytes
        self.latin = {c: "".join(chr(self.letters.get(x, x)) for x in chr(c).encode()) for c in range(0x80, 0x250)}
        self.tails: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}  # the generation before: what is asked for again comes over
        self.held = 0

    def __missing__(self, piece: str) -> bytes:
        if self.held > REMEMBER:
            self.old = dict(self)
            self.clear()
            self.held = 0
        if (ids := self.old.get(piece)) is not None:
            return self.keep(piece, ids)
        if "\n" in piece:  # byte level only; as good as unique, so not remembered
            left, right = piece.split("\n", 1)
            return self[left] + self.encoder.feed + self.encoder.first[right]
        if piece.isalpha() and (piece.isascii() or not _BEYOND.search(piece)):
            text = piece.lower() if self.lower else piece
            if not piece.isascii():
                text = text.translate(self.latin)
            ids = array("I", [x.id for x in self.tokenize(self.mark + text)]).tobytes()
        elif (stem := piece.rstrip(_MARKS)) != piece and stem.isalpha() and not _BEYOND.search(stem):
            ids = self[stem] + self.tail(piece[len(stem) :])
        else:
            ids = self.encoder.whole(self.lead + piece)
        return self.keep(piece, ids)

    def keep(self, piece: str, ids: bytes) -> bytes:
        self[piece] = ids
        self.held += _ENTRY + len(piece) + len(ids)
        return ids

    def tail(self, marks: str) -> bytes:
        if marks not in self.tails:
            if len(self.tails) > 10_000:
                self.tails.clear()
            self.tails[marks] = array("I", [x.id for x in self.tokenize(marks)]).tobytes()
        return self.tails[marks]


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        self.lower = self.t.normalizer is not None
        # byte level: the space before a word belongs to it, and a line feed is a token
        self.feed = b"" if self.lower else self.whole("\n")
        self.first = _Pieces(self, "")
        self.later = self.first if self.lower else _Pieces(self, " ")

    @classmethod
    def at(cls, path: str) -> "Encoder":
        """One encoder a worker process."""
        if path not in _open:
            _open[path] = cls(path)
        return _open[path]

    def whole(self, text: str) -> bytes:
        return array("I", self.t.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; null has none."""
        out = []
        for t in texts:
            if not t:
                out.append(b"")
            elif "<|" in t or any(c in t for c in (_UNLIKE if self.lower else _ODD)) or (not self.lower and (t[0] in " \n" or t[-1] in " \n")):
                out.append(self.whole(t))
            elif self.lower:
                out.append(b"".join(map(self.first.__getitem__, t.split())))
            else:
                head, *rest = t.split(" ")
                out.append(self.first[head] + b"".join(map(self.later.__getitem__, rest)))
        return out


def slices(texts: list[str | None], chars: int = 1 << 20):
    """Index ranges of about so many characters, at least one text each."""
    a = n = 0
    for i, text in enumerate(texts):
        n += len(text or "")
        if n >= chars:
            yield a, i + 1
            a, n = i + 1, 0
    if a < len(texts):
        yield a, len(texts)
