"""Token counts by prefix dynamic programming.

For a text of n code points let T(i) be the number of tokens of its first i code points, encoded by themselves. A piece
of the vocabulary's pattern starting at b never depends on what precedes it, so T(i) = T(b) + c(piece, i - b), where
c(piece, k) is the count of the piece's own first k code points; c is solved once for each distinct piece and kept.
Texts outside the certain range are cut by the library's own pre-tokenizer, with its offsets carried back to the raw text.
The increments T(i) - T(i-1) are stored, one signed byte for a code point, so the count of any prefix, the longest
prefix within a budget and the total are sums over stored numbers: nothing is encoded again.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import _common as C
from tessera.llm import _tokens as K

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
#: A piece longer than this is solved token by token (_Long) instead of prefix by prefix, so that its cost grows with its length only.
SOLVED = 256
#: Counts of prefixes up to this length are shared between pieces.
HEAD = 8


class _Long:
    """Counts of all prefixes of one long piece. The encoding of a text is the one sequence of tokens, each of which encodes to itself,
    in which each pair of neighbours encodes to itself; so the last token of a prefix follows from the last tokens of shorter ones."""

    def __init__(self, tok):
        model = json.loads(tok.to_str())["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.ranks = {tuple(m): i for i, m in enumerate(model["merges"])}
        self.vocab, self.longest = model["vocab"], max(map(len, model["vocab"]))
        self.stays = lru_cache(K.KEPT)(self._stays)

    def _symbols(self, token: str, last: bool) -> list[str]:
        body = token[: len(token) - len(self.end)] if last else token
        return [*body[:-1], body[-1] + (self.end if last else "")]

    def _stays(self, before: str, token: str, last: bool) -> bool:
        """Whether the two tokens (``before`` may be empty) are what their text encodes to; ``last``: the word ends behind them."""
        parts = [*before, *self._symbols(token, last)]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(x, sys.maxsize), i) for i, x in enumerate(zip(parts, parts[1:])))
            if rank == sys.maxsize:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts == ([before, token] if before else [token])

    def _ending(self, spelled: str, k: int, tails: list[str], last: bool) -> tuple[str, int]:
        for n in range(min(k, self.longest), 0, -1):
            token = spelled[k - n : k] + (self.end if last else "")
            if token in self.vocab and self.stays("", token, last) and (k == n or self.stays(tails[k - n], token, last)):
                return token, k - n
        raise ValueError("no token ends this prefix")

    def counts(self, body: str) -> list[int]:
        """Of the first 1, 2, ... code points."""
        spelled, tails, n, out = K.spelling(body), [""], [0], []
        ends = set(np.cumsum([len(c.encode()) for c in body]).tolist())
        for k in range(1, len(spelled) + 1):
            token, at = self._ending(spelled, k, tails, False)
            tails.append(token)
            n.append(n[at] + 1)
            if k in ends:
                out.append(n[self._ending(spelled, k, tails, True)[1]] + 1)
        return out


@lru_cache(maxsize=1)
def _composing() -> frozenset[str]:
    """Code points of combining class 0 that may compose with the one before them."""
    found = (unicodedata.decomposition(chr(c)).split() for c in range(sys.maxunicode + 1))
    return frozenset(chr(int(d[1], 16)) for d in found if len(d) == 2 and d[0][0] != "<") | {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}


def _units(text: str) -> list[str]:
    """The text in parts that are normalised by themselves: code points, or groups of them that may compose."""
    if unicodedata.is_normalized("NFC", text):
        return list(text)
    out: list[str] = []
    for c in text:
        if out and (unicodedata.combining(c) or c in _composing()):
            out[-1] += c
        else:
            out.append(c)
    return out


class Prefixes:
    """T as stored increments, for one vocabulary whose pattern drops white space (``word_bpe_49k.json``)."""

    def __init__(self, path: str):
        self.enc = K.Encoder(path)
        self.tok = self.enc.tok
        self.pieces = K._Pieces(self._piece)
        self.heads: dict[str, int] = {}
        self.added = re.compile("|".join(map(re.escape, self.enc.added)) or "(?!)")
        self.long: _Long | None = None

    def _count(self, text: str) -> int:
        return len(self.tok.encode(text, add_special_tokens=False).ids)

    def _piece(self, piece: str) -> bytes:
        body = piece.lstrip(K.SPACES)
        return bytes(len(piece) - len(body)) + self._solve(body) if body else bytes(len(piece))

    def _solve(self, body: str) -> bytes:
        """Increments within one piece."""
        if len(body) > SOLVED:
            self.long = self.long or _Long(self.tok)
            return self._wide(np.diff([0, *self.long.counts(body)]))
        counts = [0, *(self.heads.get(body[:k]) for k in range(1, min(HEAD, len(body)) + 1)), *[None] * (len(body) - HEAD)]
        todo = [k for k, n in enumerate(counts) if n is None]
        for k in todo:
            # a prefix of a piece is a piece, but for the contractions
            counts[k] = len(self.enc.tokenize(K.spelling(body[:k]))) if body[0] != "'" else self._count(body[:k])
            if k <= HEAD:
                if len(self.heads) >= K.KEPT:
                    self.heads.clear()
                self.heads[body[:k]] = counts[k]
        steps = [b - a for a, b in zip(counts, counts[1:])]
        return bytes(x & 255 for x in steps) if min(steps) >= -128 and max(steps) <= 127 else self._wide(np.array(steps))

    @staticmethod
    def _wide(steps: np.ndarray) -> bytes:
        """A step over what a byte holds is carried on to the code points before it, where possible within the piece."""
        steps = steps.astype(np.int64)
        for i in range(len(steps) - 1, 0, -1):
            if not -128 <= steps[i] <= 127:
                keep = int(np.clip(steps[i], -128, 127))
                steps[i - 1] += steps[i] - keep
                steps[i] = keep
        return steps.astype(np.int8).tobytes()

    def increments(self, text: str) -> bytes:
        if self.enc.certain(text):
            self.pieces = self.pieces.current()
            return b"".join(map(self.pieces.__getitem__, K.WORD_LEVEL.findall(text.lower())))
        return self._by_library(text)

    def _by_library(self, text: str) -> bytes:
        """Between added tokens' strings T is that of the text there; such a string is one token once it is complete, and any text before."""
        t, at = [0], 0
        while at < len(text):
            found = self.added.search(text, at)
            part = self._between(text[at : found.end() - 1 if found else len(text)])
            before = t[-1]
            t += [before + n for n in part]
            if found:
                t.append((t[found.start()]) + 1)
            at = found.end() if found else len(text)
        return self._wide(np.diff(t))

    def _between(self, text: str) -> list[int]:
        """T of the first 1, 2, ... code points of a text without added tokens: normalised unit by unit and cut by the library, solved by piece."""
        normal, units = self.tok.normalizer.normalize_str, _units(text)
        of = {u: normal(u) for u in set(units)}
        flat = "".join(of[u] for u in units)
        self.pieces = self.pieces.current()
        steps, starts = np.zeros(len(flat), np.int64), np.arange(len(flat) + 1)  # starts: of the piece that a code point lies in
        for _, (start, end) in self.tok.pre_tokenizer.pre_tokenize_str(flat):
            steps[start:end] = np.frombuffer(self.pieces[flat[start:end]], np.int8)
            starts[start:end] = start
        t = np.r_[0, np.cumsum(steps)].tolist()
        ends = np.r_[0, np.cumsum([len(of[u]) for u in units], dtype=np.int64)]
        raw = np.r_[0, np.cumsum([len(u) for u in units], dtype=np.int64)]
        out: list[int] = []
        for i, u in enumerate(units):
            if len(u) > 1:  # a prefix that ends inside a group: from the start of the piece that it may belong to
                k = int(np.searchsorted(ends, starts[max(0, ends[i] - 1)], side="right")) - 1
                out += [t[ends[k]] + self._count(text[raw[k] : raw[i] + n]) for n in range(1, len(u))]
            out.append(t[ends[i + 1]])
        return out


@lru_cache(maxsize=2)
def _prefixes(path: str) -> Prefixes:
    return Prefixes(path)


def tokens_at(increments: bytes, n_chars: int) -> int:
    """Tokens of the first n_chars code points."""
    return int(np.frombuffer(increments, np.int8)[:n_chars].sum(dtype=np.int64))


def longest_within(increments: bytes, budget: int) -> int:
    """The longest prefix, in code points, that has no more than ``budget`` tokens."""
    t = np.cumsum(np.frombuffer(increments, np.int8), dtype=np.int64)
    within = np.flatnonzero(t <= budget)
    return int(within[-1]) + 1 if len(within) else 0


def prefix_counts(docs: DataFrame, *, limit: int = LIMIT, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, chars_within (longest prefix of at most ``limit`` tokens), increments binary; one row for a row.

    A null text counts as the empty one: no bytes, no tokens. Null and repeated ids pass through as they are.
    Other columns of ``docs`` are not read. No shuffle; a worker holds a batch and a bounded table of pieces.
    """
    path = path or K.default_path(VOCABULARY)

    def run(batch: pa.RecordBatch) -> Iterator[tuple]:
        p = _prefixes(path)
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            text = text or ""
            inc = p.increments(text)
            n = tokens_at(inc, len(inc))
            yield doc_id, len(text.encode()), n, len(text) if n <= limit else longest_within(inc, limit), inc

    kind = docs.schema[id_col].dataType.simpleString()
    return C.arrow_map(C.texts(docs, id_col, text_col), run, f"doc_id {kind}, n_bytes long, n_tokens long, chars_within long, increments binary", rows=256)


def op10_token_counts(spark, sf_dir: str) -> DataFrame:
    t = prefix_counts(C.table(spark, sf_dir, "documents"))
    return t.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"), "chars_within")
