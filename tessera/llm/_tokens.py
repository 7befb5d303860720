"""Encoding whole texts with the ``tokenizers`` library, one distinct pre-token at a time.

Both vocabularies used here cut a text by a pattern and then encode each piece by itself, so a piece that recurs
need only be encoded once. The pieces are cut here with explicit character classes, which is only done for texts whose
characters all lie in a range where those classes are certain (ASCII and Latin letters up to U+024F, no added token's
string); any other text goes to the library whole.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache
from operator import attrgetter

import numpy as np
import pyarrow as pa

# Unicode classes within the certain range.
LETTERS = "a-zA-ZªµºÀ-ÖØ-öø-ɏ"
NUMBERS = "0-9²³¹¼-¾"
SPACES = " \t\n\r\x0b\x0c "
#: U+0130 grows when it is lower-cased; U+001C..U+001F and U+0085 are white space to some libraries only.
UNCERTAIN = re.compile("[^\t\n\x0b\x0c\r\x20-\x7e -įı-ɏ]")
# The vocabularies' own patterns, with the classes above put in. (Letters stand first in the one: no other
# alternative that precedes them can begin with a letter or a space.)
BYTE_LEVEL = re.compile(f" ?[{LETTERS}]++|'s|'t|'re|'ve|'m|'ll|'d| ?[{NUMBERS}]++| ?[^{SPACES}{LETTERS}{NUMBERS}]++|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]++")
WORD_LEVEL = re.compile(f"[{SPACES}]*(?:'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^{SPACES}{LETTERS}{NUMBERS}]+)|[{SPACES}]+")

_ID = attrgetter("id")


def _byte_spelling() -> dict[int, int]:
    """Byte-level vocabularies spell printable Latin-1 bytes as themselves and the others as U+0100 and on, in order."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: 256 + i for i, b in enumerate(hidden)}


_SPELLING = _byte_spelling()


def spelling(piece: str) -> str:
    """How byte-level vocabularies spell a piece."""
    return piece.replace(" ", "\u0120") if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(_SPELLING)


#: Pieces from which on a worker's generation is full (one text can double it), and the longest piece that is kept.
KEPT, LONGEST = 250_000, 64


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


class _Pieces(dict):
    """piece -> what ``make`` gives for it, in generations: a full one stays as the older one, from which pieces that are met again
    move on. So memory is bounded and frequent pieces stay."""

    def __init__(self, make, kept: int | None = None, old: dict | None = None):
        super().__init__()
        self.make, self.kept, self.old = make, kept or KEPT, {} if old is None else old

    def __missing__(self, piece):
        out = self.old.get(piece)
        if out is None:
            out = self.make(piece)
        if len(piece) <= LONGEST and len(self) < 2 * self.kept:
            self[piece] = out
        return out

    def current(self) -> "_Pieces":
        """This generation, or if it is full the next one."""
        if len(self) < self.kept:
            return self
        self.old = {}
        return _Pieces(self.make, self.kept, self)


# Classes of bytes, for cutting many texts at once into units that encode alone as they do in their text. A unit is a byte-level piece or several.
_OTHER, _LETTER, _NUMBER, _SPACE, _WHITE, _QUOTE, _MIXED, _BAD = range(8)


def _byte_classes() -> np.ndarray:
    """Letters of two bytes go by their first byte, U+00A0..U+00BF are mixed. Bad: what only the pattern, or the library, can place."""
    out = np.full(256, _OTHER, np.uint8)
    for cls, chars in ((_BAD, range(32)), (_LETTER, b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"), (_NUMBER, b"0123456789"), (_SPACE, b" "), (_WHITE, b"\t\n\x0b\x0c\r"), (_QUOTE, b"'")):
        out[list(chars)] = cls
    out[127], out[0xC0:], out[0xC2], out[0xC3:0xC9] = _BAD, _BAD, _MIXED, _LETTER
    return out


def _boundaries() -> np.ndarray:
    """By the classes of two neighbouring bytes (8 * first + second): 1 if a piece ends between them, 2 if it does so where the first is the only white
    space there (before a longer run the pattern looks ahead)."""
    out = np.zeros((8, 8), np.uint8)
    out[[[_OTHER], [_LETTER], [_NUMBER], [_QUOTE], [_MIXED]], [_SPACE, _WHITE]] = 1
    out[_LETTER, [_OTHER, _QUOTE, _NUMBER]] = out[_NUMBER, [_OTHER, _QUOTE, _LETTER]] = out[_OTHER, [_LETTER, _NUMBER]] = out[_QUOTE, _NUMBER] = 1
    out[_WHITE, [_OTHER, _LETTER, _NUMBER, _QUOTE, _MIXED]] = 2
    return out.ravel()


_PIECE = re.compile(f" ?[{LETTERS}]++")
_CLASS, _BOUNDARY = _byte_classes(), _boundaries()


def _units(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, added: list[str]) -> np.ndarray:
    """First bytes of the units of texts that lie one behind the other in ``data``. A text with bytes that can't be placed is one unit."""
    cls = _CLASS[data]
    after = np.flatnonzero((data[1:] & 0xC0) == 0x80) + 1
    first, second = data[after - 1], data[after]
    cls[after] = cls[after - 1]
    # U+0080..U+00A0, the signs between the letters, and U+0130
    cls[after[((first == 0xC2) & (second <= 0xA0)) | ((first == 0xC3) & ((second == 0x97) | (second == 0xB7))) | ((first == 0xC4) & (second == 0xB0))]] = _BAD
    bad = np.flatnonzero(cls == _BAD)
    raw = data.tobytes()
    cut = np.zeros(len(data), bool)
    kind = _BOUNDARY[cls[:-1] * np.uint8(8) + cls[1:]]
    cut[1:] = kind == 1
    alone = np.flatnonzero(kind == 2)
    white = (cls == _SPACE) | (cls == _WHITE)
    text = np.zeros(len(data), bool)
    text[starts] = True
    cut[alone[text[alone] | ~white[alone - 1]] + 1] = True
    cut |= text
    whole = set((np.searchsorted(starts, bad, "right") - 1).tolist())
    for t in added:
        at = raw.find(t := t.encode())
        while at >= 0:
            whole.add(int(np.searchsorted(starts, at, "right")) - 1)
            at = raw.find(t, at + 1)
    for i in whole:
        cut[starts[i] + 1 : ends[i]] = False
    return np.flatnonzero(cut)


class Encoder:
    """Token ids of a text as little-endian unsigned 32-bit integers, equal to the library's for the whole text."""

    def __init__(self, path: str, kept: int | None = None):
        self.tok = load(path)
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.pieces = _Pieces(self._piece, kept)
        self.tokenize = self.tok.model.tokenize

    def _whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        """By the library's model alone: a piece needs no cutting any more, only the byte-level spelling of its bytes."""
        return array("I", map(_ID, self.tokenize(spelling(piece)))).tobytes()

    def certain(self, text: str) -> bool:
        return UNCERTAIN.search(text) is None and not any(t in text for t in self.added)

    def ids(self, text: str) -> bytes:
        if not self.certain(text):
            return self._whole(text)
        self.pieces = self.pieces.current()
        return b"".join(map(self.pieces.__getitem__, BYTE_LEVEL.findall(text)))

    def _unit(self, unit: str) -> bytes:
        return self.pieces[unit] if _PIECE.fullmatch(unit) else self.ids(unit)

    def all_ids(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of many texts (null: empty), each with ``end`` behind it, one text behind the other, and how many each has. What recurs among them is looked up once."""
        texts = texts.cast(pa.large_string()).fill_null("")
        if not len(texts):
            return np.empty(0, "<u4"), np.empty(0, np.int64)
        at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        if at[0] == at[-1]:
            return np.full(len(texts), end, "<u4"), np.ones(len(texts), np.int64)
        data, at = np.frombuffer(texts.buffers()[2], np.uint8)[at[0] : at[-1]], at - at[0]
        full = at[1:] > at[:-1]
        first = _units(data, at[:-1][full], at[1:][full], self.added)
        found = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(np.append(first, len(data))), pa.py_buffer(data)).dictionary_encode()
        units = found.dictionary.to_numpy(zero_copy_only=False).tolist()
        self.pieces = self.pieces.current()
        ids = [x or self._unit(unit) for x, unit in zip(map(self.pieces.get, units), units)]
        flat = np.frombuffer(b"".join([*ids, np.array([end], "<u4").tobytes()]), "<u4")
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        # every text's units, then the unit that is the end
        order = np.insert(found.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.searchsorted(first, at[1:]), len(ids))
        size = np.append(size, 1)
        n = size[order]
        behind = np.cumsum(n)
        kind = np.int32 if max(len(flat), behind[-1]) < 2**31 else np.int64
        place = np.repeat(((np.cumsum(size) - size)[order] - behind + n).astype(kind), n)
        place += np.arange(len(place), dtype=kind)
        last = behind[np.searchsorted(first, at[1:]) + np.arange(len(texts))]
        return flat[place], np.diff(last, prepend=0)


@lru_cache(maxsize=4)
def encoder(path: str, kept: int | None = None) -> Encoder:
    """One per worker process and vocabulary, so the pieces it knows outlive a task."""
    return Encoder(path, kept)
