"""Packs pieces of documents into sequences under limits on tokens, segments and loss tokens.

Vector bin packing: the next piece of a sequence is the one that fits under all limits and has
the largest dot product of its demands with the room that is left, both as shares of the limits.
A document longer than a sequence gives full sequences first; its rest is a piece to be packed.

Each task packs the rows that it reads, from a pool of a bounded number of pieces: documents are
never shuffled or grouped, so no source or group of copies can become hot, and the rows of a
task, and with them its sequence numbers, are the same when it runs again.  A sequence that no
piece of the pool can fill gets the front of one cut to size, if that leaves both parts at least
``least_cut`` tokens.  At the end of a task the last sequence is cut at powers of two, lengths
that need no padding.

Cases: a null or empty text is a document of its end token only; null and repeated ``doc_id``
values are documents of their own; of pieces that are equally good the one read first is taken;
extra columns, whatever their names, are left out; an empty table gives an empty table; a long
document is cut into many pieces; a document without tokens has no piece.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import id_and_text, ready_workers
from .tokens import library_encoder, shares

PIECE_COLUMNS = ("doc_id", "start", "length", "ids", "doc_tokens", "loss_tokens", "sequence_id",
                 "offset", "sequence_tokens")


@dataclass(frozen=True)
class Limits:
    """Of one sequence.  ``pool`` bounds the pieces that a task holds, ``least_cut`` the parts
    into which a piece may be cut to fill a sequence."""

    tokens: int = 1024
    segments: int = 64
    loss_tokens: int = 1024
    pool: int = 4096
    least_cut: int = 16


@dataclass
class Piece:
    document: object
    start: int
    ids: np.ndarray
    loss: np.ndarray
    doc_tokens: int

    def __post_init__(self):
        self.kind = (len(self.ids), int(np.count_nonzero(self.loss)))


class Packer:
    """Packs pieces one sequence at a time.  Pieces of the same demands are one kind and wait in
    one queue, so a choice looks at the distinct demands only."""

    def __init__(self, limits: Limits):
        self.limits, self.size = limits, 0
        self.whole = np.array([limits.tokens, limits.loss_tokens, limits.segments], dtype=float)
        self.clear()

    def clear(self) -> None:
        self.queues: list[deque[Piece]] = []
        self.number: dict[tuple[int, int], int] = {}
        self.kinds = np.ones((256, 3))
        self.waiting = np.zeros(256, dtype=bool)

    def add(self, document, ids: np.ndarray, loss: np.ndarray) -> Iterator[list[Piece]]:
        """Takes a document's ids and, for each, whether it bears loss; yields the sequences that
        it fills alone, and others while the pool is full."""
        start, limit = 0, self.limits
        while len(ids) - start >= limit.tokens:
            end = start + limit.tokens
            if np.count_nonzero(loss[start:end]) > limit.loss_tokens:
                end = start + int(np.searchsorted(np.cumsum(loss[start:end]), limit.loss_tokens,
                                                  side="right"))
            yield [Piece(document, start, ids[start:end], loss[start:end], len(ids))]
            start = end
        if start < len(ids):
            self.put(Piece(document, start, ids[start:], loss[start:], len(ids)))
        while self.size > limit.pool:
            yield self.sequence()

    def put(self, piece: Piece, first: bool = False) -> None:
        """Into the pool; a rest that bears more loss than a sequence may is halved."""
        if piece.kind[1] > self.limits.loss_tokens:
            for part in cut(piece, len(piece.ids) // 2):
                self.put(part)
            return
        at = self.number.get(piece.kind)
        if at is None:
            if len(self.queues) > 4096 + 2 * self.waiting.sum():  # most kinds have no piece left
                held = [q for q in self.queues if q]
                self.clear()
                for queue in held:
                    self._kind(queue[0].kind, queue)
            at = self._kind(piece.kind, deque())
        (self.queues[at].appendleft if first else self.queues[at].append)(piece)
        self.waiting[at] = True
        self.size += 1

    def _kind(self, kind: tuple[int, int], queue: deque[Piece]) -> int:
        at = self.number[kind] = len(self.queues)
        if at == len(self.waiting):
            self.kinds = np.concatenate([self.kinds, np.ones_like(self.kinds)])
            self.waiting = np.concatenate([self.waiting, np.zeros_like(self.waiting)])
        self.queues.append(queue)
        self.kinds[at, :2], self.waiting[at] = kind, bool(queue)
        return at

    def take(self, at: int) -> Piece:
        piece = self.queues[at].popleft()
        self.waiting[at] = bool(self.queues[at])
        self.size -= 1
        return piece

    def sequence(self) -> list[Piece]:
        room, chosen = self.whole.copy(), []
        while self.size and room[2] >= 1 and room[0] >= 1:
            n = len(self.queues)
            kinds = self.kinds[:n]
            # Demands and room as shares of the limits.
            value = kinds @ (room / self.whole ** 2)
            value[~(self.waiting[:n] & (kinds[:, 0] <= room[0]) & (kinds[:, 1] <= room[1]))] = -1
            at = int(value.argmax())
            if value[at] >= 0:
                chosen.append(self.take(at))
            else:
                part = self.fitted(int(room[0]), int(room[1]))
                if part is None:
                    break
                chosen.append(part)
            room -= (*chosen[-1].kind, 1)
        return chosen

    def fitted(self, tokens: int, loss: int) -> Piece | None:
        """The front of the longest waiting piece, cut to the room that is left."""
        least = self.limits.least_cut
        if tokens < least:
            return None
        at = int(np.where(self.waiting, self.kinds[:, 0], 0).argmax())
        if self.kinds[at, 0] < tokens + least:
            return None
        piece = self.take(at)
        front, rest = cut(piece, tokens)
        if front.kind[1] > loss:
            self.put(piece, first=True)
            return None
        self.put(rest)
        return front

    def rest(self) -> Iterator[list[Piece]]:
        while self.size:
            last = self.sequence()
            if self.size:
                yield last
            else:
                yield from powers_of_two(last, self.limits.tokens)


def cut(piece: Piece, at: int) -> tuple[Piece, Piece]:
    return (Piece(piece.document, piece.start, piece.ids[:at], piece.loss[:at], piece.doc_tokens),
            Piece(piece.document, piece.start + at, piece.ids[at:], piece.loss[at:],
                  piece.doc_tokens))


def powers_of_two(pieces: list[Piece], most: int) -> Iterator[list[Piece]]:
    """One sequence, cut into sequences whose lengths are powers of two."""
    left, pieces = sum(len(p.ids) for p in pieces), list(pieces)
    if left == most:
        yield pieces
        return
    while left:
        room = length = 1 << (left.bit_length() - 1)
        out = []
        while room:
            piece = pieces.pop(0)
            if len(piece.ids) > room:
                piece, rest = cut(piece, room)
                pieces.insert(0, rest)
            out.append(piece)
            room -= len(piece.ids)
        yield out
        left -= length


def _packed(rows: DataFrame, limits: Limits, documents) -> DataFrame:
    """``documents(batch)`` yields ``(key, ids, loss)`` for each document of an Arrow batch."""
    ready_workers(rows.sparkSession)
    key = rows.schema["doc_id"]
    schema = T.StructType([key, *T.StructType.fromDDL(
        "start long, length long, ids binary, doc_tokens long, loss_tokens long, "
        "sequence_id long, offset long, sequence_tokens long").fields])
    arrow = to_arrow_schema(schema)

    def run(batches):
        # Sequences are numbered within a task; the upper bits are the task's number.
        number = TaskContext.get().partitionId() << 33
        packer, out = Packer(limits), []

        def flush():
            return pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], t.type) for i, t in enumerate(arrow)],
                schema=arrow)

        def written(pieces):
            nonlocal number
            offset, total = 0, sum(len(p.ids) for p in pieces)
            for p in pieces:
                out.append((p.document, p.start, len(p.ids), p.ids.astype("<u4").tobytes(),
                            p.doc_tokens, p.kind[1], number, offset, total))
                offset += len(p.ids)
            number += 1

        for batch in batches:
            for name, ids, loss in documents(batch):
                for pieces in packer.add(name, ids, loss):
                    written(pieces)
                if len(out) >= 2048:
                    yield flush()
                    out.clear()
        for pieces in packer.rest():
            written(pieces)
            if len(out) >= 2048:
                yield flush()
                out.clear()
        if out:
            yield flush()

    return rows.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, path: str, end_id: int = 0,
                   limits: Limits = Limits()) -> DataFrame:
    """Packs whole texts: a row ``PIECE_COLUMNS`` for each piece.  Each document ends with
    ``end_id``.  Its first token has nothing before it from which it could be foretold, so it
    bears no loss; all others do."""

    def documents(batch):
        encode, end = library_encoder(path), np.array([end_id], "<u4")
        names = batch.column("doc_id")
        for at, texts in shares(batch):
            for i, ids in enumerate(encode(texts)):
                ids = np.concatenate([np.frombuffer(ids, "<u4"), end])
                loss = np.ones(len(ids), dtype=bool)
                loss[0] = False
                yield names[at + i].as_py(), ids, loss

    return _packed(id_and_text(docs), limits, documents)


def pack_examples(examples: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Packs tokenised instruction examples ``(doc_id, ids array<int>, loss array<boolean>)``,
    where ``loss`` marks the tokens to be learned, such as the answers.  Null ids are no tokens;
    null or missing marks bear no loss, marks beyond the ids are ignored."""

    def documents(batch):
        names, ids, loss = (batch.column(c) for c in ("doc_id", "ids", "loss"))
        for i in range(batch.num_rows):
            tokens = np.array(ids[i].as_py() or [], "<u4")
            marks = [bool(x) for x in (loss[i].as_py() or [])][:len(tokens)]
            marks += [False] * (len(tokens) - len(marks))
            yield names[i].as_py(), tokens, np.array(marks, dtype=bool)

    return _packed(examples.select("doc_id", "ids", "loss"), limits, documents)

