"""Packing token sequences by vector bin packing with the dot-product heuristic.

Every piece of an example demands a vector: tokens, segments (always 1) and loss-bearing tokens. A sequence offers the
capacities in the same three dimensions. A sequence is filled by taking, again and again, the piece that fits and has the
largest dot product of its demand with what the sequence has left (both relative to the capacity). Where nothing
that is left fits, the longest piece may be cut to close the gap, if the gap is worth a segment.

Each task packs the rows of its own input partition, as a stream with a bounded pool; there is no shuffle, so the
result of a lost task is recomputed from its split of the input and is the same again. A task leaves one
sequence at most that is not full.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import _common as C
from tessera.llm import _tokens as K

VOCABULARY = "byte_bpe_50k.json"
END_ID = 0
#: Pieces that a task chooses among; short ones are so many more to a sequence, so the pool also holds some sequences' worth of tokens.
POOL, POOL_SEQUENCES = 1024, 8
#: A gap of fewer tokens stays padding instead of cutting a piece for it.
LEAST_CUT = 12


@dataclass(frozen=True)
class Limits:
    """What a sequence offers. As a segment has a token at least, as many segments as tokens are no limit of their own."""

    tokens: int = 1024
    segments: int = 1024
    loss_tokens: int = 1024


@dataclass
class Piece:
    example: int
    start: int
    length: int
    loss: np.ndarray | None = None  # 1 where a token bears loss; None: every token that has a predecessor in its segment

    @property
    def loss_tokens(self) -> int:
        return self.length - 1 if self.loss is None else int(self.loss.sum())

    def cut(self, n: int) -> tuple[Piece, Piece]:
        a, b = (None, None) if self.loss is None else (self.loss[:n], self.loss[n:])
        return Piece(self.example, self.start, n, a), Piece(self.example, self.start + n, self.length - n, b)


def fill(pool: list[Piece], limits: Limits, keep: int, cuttable: bool = True) -> Iterator[list[Piece]]:
    """Sequences, as lists of pieces, until no more than ``keep`` pieces are left in ``pool`` (which is emptied that far)."""
    pieces = list(pool)
    pool.clear()
    # the demands, one array per dimension (segments: always 1); a piece that is placed demands more than there is.
    # Of equal scores the first piece in the order of the pool is taken.
    length = np.array([p.length for p in pieces], np.float64)
    loss = np.array([p.loss_tokens for p in pieces], np.float64)
    n_free, gone = len(pieces), float("inf")
    if n_free and (length.max() > limits.tokens or loss.max() > limits.loss_tokens):
        raise ValueError("a piece is larger than a sequence")
    while n_free > keep:
        tokens, segments, losses, chosen = limits.tokens, limits.segments, limits.loss_tokens, []
        while segments and n_free:
            fits = np.flatnonzero((length <= tokens) & (loss <= losses))
            if not len(fits):
                break
            # demand . room, both as shares of the capacity; the segments' share is the same for every piece
            score = length[fits] * (tokens / limits.tokens**2) + loss[fits] * (losses / limits.loss_tokens**2)
            i = int(fits[score.argmax()])
            chosen.append(pieces[i])
            tokens, segments, losses = tokens - int(length[i]), segments - 1, losses - int(loss[i])
            length[i], n_free = gone, n_free - 1
        gap = min(tokens, losses + 1)
        if cuttable and gap >= LEAST_CUT and segments and n_free:
            i = int(np.where(length < gone, length, -1).argmax())
            if pieces[i].length > gap:
                head, tail = pieces[i].cut(gap)
                if head.loss_tokens <= losses:
                    chosen.append(head)
                    pieces[i], length[i], loss[i] = tail, tail.length, tail.loss_tokens
        yield chosen
        if 2 * n_free < len(pieces):
            left = np.flatnonzero(length < gone)
            pieces, length, loss = [pieces[i] for i in left.tolist()], length[left], loss[left]
    pool.extend(p for p, n in zip(pieces, length.tolist()) if n < gone)


def pack_documents(docs: DataFrame, *, limits: Limits = Limits(), end_id: int = END_ID, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", pool: int = POOL) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    A document's ids are those of its text and ``end_id``; a null text counts as empty, so that it is one token. Repeated
    rows are packed each; null ids pass through. Other columns, whatever their names, are not read; an empty table gives an empty one. ``sequence_id`` is unique over the
    table; in a sequence the offsets have no gaps from 0. A document longer than a sequence is cut at multiples of it.
    """
    path = path or K.default_path(VOCABULARY)
    end = np.array([end_id], "<u4").tobytes()

    def examples(batch: pa.RecordBatch) -> Iterator[tuple]:
        enc = K.encoder(path)
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            yield doc_id, enc.ids(text or "") + end, None

    return _pack(C.texts(docs, id_col, text_col), examples, docs.schema[id_col].dataType.simpleString(), limits, pool)


def pack_conversations(conversations: DataFrame, *, limits: Limits = Limits(), end_id: int = END_ID, path: str | None = None, bearing: tuple[str, ...] = ("assistant",), pool: int = POOL) -> DataFrame:
    """The same columns for conversations (conv_id, turn, role, text), each an example: its turns in order, each with ``end_id`` behind it.
    Only tokens of turns whose role is in ``bearing`` bear loss. Turns meet by conversation, which bounds what a task gathers; rows
    of a null conv_id are one conversation, a null text is an empty turn, a null role bears none."""
    path = path or K.default_path(VOCABULARY)
    end = np.array([end_id], "<u4").tobytes()
    turns = conversations.groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))

    def examples(batch: pa.RecordBatch) -> Iterator[tuple]:
        enc = K.encoder(path)
        for conv_id, turns in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            parts = [(enc.ids(t["text"] or "") + end, t["role"] in bearing) for t in turns]
            yield conv_id, b"".join(p for p, _ in parts), np.concatenate([np.full(len(p) // 4, bears, np.uint8) for p, bears in parts])

    return _pack(turns, examples, conversations.schema["conv_id"].dataType.simpleString(), limits, pool)


def _pack(rows_of: DataFrame, examples, kind: str, limits: Limits, pool: int) -> DataFrame:
    """``examples`` gives (id, ids, loss marks or None) for the rows of a batch."""
    step = min(limits.tokens, limits.loss_tokens + 1)
    schema = f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    out = C.arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sequence = TaskContext.get().partitionId() << 33
        open_docs: dict[int, list] = {}  # number -> [doc_id, ids, tokens not yet placed]
        waiting: list[Piece] = []
        rows: list[tuple] = []
        number = tokens_waiting = 0

        def place(pieces: list[Piece]) -> None:
            nonlocal sequence
            at = 0
            for p in pieces:
                doc = open_docs[p.example]
                rows.append((doc[0], p.start, p.length, doc[1][4 * p.start : 4 * (p.start + p.length)], len(doc[1]) // 4, sequence, at))
                at += p.length
                doc[2] -= p.length
                if not doc[2]:
                    del open_docs[p.example]
            sequence += 1

        for batch in C.sliced(batches):
            for doc_id, ids, loss in examples(batch):
                n = len(ids) // 4
                open_docs[number] = [doc_id, ids, n]
                size = step if loss is None else min(step, limits.loss_tokens)
                whole = n - n % size
                for start in range(0, whole, size):
                    place([Piece(number, start, size)])
                if n > whole:
                    waiting.append(Piece(number, whole, n - whole, None if loss is None else loss[whole:]))
                    tokens_waiting += n - whole
                number += 1
                if len(waiting) >= pool and tokens_waiting >= POOL_SEQUENCES * limits.tokens:
                    for s in fill(waiting, limits, len(waiting) // 2):
                        place(s)
                    tokens_waiting = sum(p.length for p in waiting)
                if len(rows) >= 2048:
                    yield C.to_batch(rows, out)
                    rows.clear()
        for s in fill(waiting, limits, 0):
            place(s)
        if rows:
            yield C.to_batch(rows, out)

    return rows_of.mapInArrow(run, schema)


def op7_packing(spark, sf_dir: str) -> DataFrame:
    p = pack_documents(C.table(spark, sf_dir, "documents"))
    return p.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
