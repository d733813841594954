"""Byte-pair encoding and decoding of whole texts, computed here from a vocabulary file.

A sequence of tokens is what the merges would give exactly if each adjacent pair is: no merge
across the pair's border comes before the merges that use up the tokens at the border.  So the
encoder walks over a piece, takes the longest token that starts at the current byte and is
compatible with the token before it, tries the next shorter one if not, and steps back if none
is left; places that led nowhere are marked, so each is given up once and the work is linear.
All tokens that start at a byte come from one Aho-Corasick pass over the piece.

Decoding joins slices of one buffer that holds the bytes of all tokens, by an offset table.

Cases: null and empty texts give no ids; null ids decode to an empty text; null and repeated
``doc_id`` values keep their rows; extra columns, whatever their names, are left out; an empty
table gives an empty table; a long text is encoded piece by piece, and a piece of any length in
linear time; an id outside the vocabulary is an error.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import id_and_text, ready_workers
from .tokens import LATIN_SPLIT, PieceEncoder, is_latin, shares

# A worker remembers at most so many pairs of tokens.
MEMO = 300_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary file: printable Latin-1
    characters stand for themselves, the other bytes for the letters from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """Tokens, merges and the tables derived from them, for one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.check(spec)
        model = spec["model"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.added_pattern = re.compile("(" + "|".join(
            re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")")
        self.ids = {t: i for t, i in model["vocab"].items() if t not in self.added}
        self.buffer, self.offsets = self.offset_table()

    def prepare(self, merges: list) -> None:
        """The tables that encoding needs and decoding doesn't."""
        import ahocorasick
        from tokenizers.pre_tokenizers import ByteLevel

        self.library_split = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
        by_byte = {b: c for c, b in byte_letters().items()}
        self.letters = {i: "".join(by_byte[b] for b in chr(i).encode()) for i in range(256)}
        # For a pair of ids the rank of its merge; for an id its two parts and that rank.
        self.merge: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(merges):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            key = (self.ids[left], self.ids[right])
            self.merge[key] = rank
            self.parts.setdefault(self.ids[left + right], (*key, rank))
        self.finder = ahocorasick.Automaton()
        size = max(self.ids.values(), default=-1) + 1
        # Of each token its length and the longest token that it begins with.
        self.length, self.shorter = [0] * size, [-1] * size
        for token, i in self.ids.items():
            self.finder.add_word(token, i)
            self.length[i] = len(token)
            self.shorter[i] = next((self.ids[token[:n]] for n in range(len(token) - 1, 0, -1)
                                    if token[:n] in self.ids), -1)
        self.finder.make_automaton()
        self.compatible_memo: dict[tuple[int, int], bool] = {}
        self.border_memo: tuple[dict, dict] = ({}, {})

    def split(self, text: str) -> list[str]:
        """Words of the split pattern, with one letter for each byte, as the tokens of the file
        have.  Beyond Latin-1 the library splits, so that character classes are those of its
        Unicode version."""
        if is_latin(text):
            return [w.translate(self.letters) for w in LATIN_SPLIT.findall(text)]
        return [w for w, _ in self.library_split(text)]

    @staticmethod
    def check(spec: dict) -> None:
        pre, model = spec["pre_tokenizer"], spec["model"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] \
                or spec["normalizer"] or model.get("ignore_merges") \
                or any(t["lstrip"] or t["rstrip"] or t["single_word"]
                       for t in spec["added_tokens"]):
            raise ValueError("this encoder reads plain byte-level BPE vocabularies")

    def offset_table(self) -> tuple[np.ndarray, np.ndarray]:
        letters = byte_letters()
        tokens = {i: bytes(letters[c] for c in t) for t, i in self.ids.items()}
        tokens |= {i: t.encode() for t, i in self.added.items()}
        rows = [tokens.get(i, b"") for i in range(max(tokens, default=-1) + 1)]
        return (np.frombuffer(b"".join(rows), dtype=np.uint8),
                np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64))

    def border(self, token: int, side: int) -> list[tuple[int, float]]:
        """The tokens at one border of a token while it is merged together, each with the rank
        of the merge that uses it up."""
        memo = self.border_memo[side]
        if token not in memo:
            rows, until, at = [], float("inf"), token
            while True:
                rows.append((at, until))
                if at not in self.parts:
                    break
                until, at = self.parts[at][2], self.parts[at][side]
            memo[token] = rows
        return memo[token]

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging leaves the border between two tokens alone.  Merges of one rank go
        from left to right, so a tie goes to the part on the left."""
        known = self.compatible_memo.get((a, b))
        if known is None:
            known = not any((rank := self.merge.get((x, y))) is not None
                            and rank < x_until and rank <= y_until
                            for x, x_until in self.border(a, 1)
                            for y, y_until in self.border(b, 0))
            if len(self.compatible_memo) >= MEMO:
                self.compatible_memo.clear()
            self.compatible_memo[(a, b)] = known
        return known

    def encode_word(self, word: str) -> list[int]:
        """The ids of one word of the split pattern."""
        if word in self.ids:
            return [self.ids[word]]  # the longest match at its first byte, with none before it
        length, shorter, known = self.length, self.shorter, self.compatible_memo
        longest = [-1] * len(word)
        for end, i in self.finder.iter(word):  # ends ascend, so the longest comes last
            longest[end + 1 - length[i]] = i
        open_, path, at, before, token = bytearray(b"\1") * (len(word) + 1), [], 0, -1, longest[0]
        while True:
            while token >= 0:
                end = at + length[token]
                if open_[end] and (before < 0 or known.get((before, token))
                                   or self.compatible(before, token)):
                    break
                token = shorter[token]
            if token >= 0:
                path.append(token)
                if end == len(word):
                    return path
                at, before, token = end, token, longest[end]
            elif path:
                open_[at] = 0
                token = path.pop()
                at, before = at - length[token], path[-1] if path else -1
                token = shorter[token]
            else:
                raise ValueError("the vocabulary lacks a byte")

    def encode(self, pieces: list[str]) -> Iterator[bytes]:
        for piece in pieces:
            ids = []
            for n, part in enumerate(self.added_pattern.split(piece) if self.added else [piece]):
                if n % 2:
                    ids.append(np.array([self.added[part]], "<u4").tobytes())
                    continue
                ids += [np.array(self.encode_word(w), "<u4").tobytes() for w in self.split(part)]
            yield b"".join(ids)

    def decode(self, ids: bytes) -> bytes:
        i = np.frombuffer(ids, "<u4")
        if len(i) and int(i.max()) + 1 >= len(self.offsets):
            raise ValueError("an id outside the vocabulary")
        start, length = self.offsets[i], self.offsets[i.astype(np.int64) + 1] - self.offsets[i]
        ends = np.cumsum(length)
        total = int(ends[-1]) if len(ends) else 0
        return self.buffer[np.arange(total) + np.repeat(start - (ends - length), length)].tobytes()


_VOCABULARIES: dict[str, Vocabulary] = {}
_ENCODERS: dict[str, PieceEncoder] = {}


def vocabulary(path: str) -> Vocabulary:
    """One for each worker."""
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Vocabulary(path)
    return _VOCABULARIES[path]


def encoder(path: str) -> PieceEncoder:
    if path not in _ENCODERS:
        with open(path, encoding="utf-8") as f:
            vocabulary(path).prepare(json.load(f)["model"]["merges"])
        _ENCODERS[path] = PieceEncoder(vocabulary(path).encode,
                                       vocabulary(path).added)
    return _ENCODERS[path]


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """``(doc_id, ids)``: the ids of each whole text as little-endian unsigned 32-bit bytes."""
    ready_workers(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for at, texts in shares(batch):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(at, len(texts)),
                     pa.array(encoder(path)(texts), pa.binary())], ["doc_id", "ids"])

    rows = id_and_text(docs)
    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"],
                                              T.StructField("ids", T.BinaryType())]))


def decode_documents(rows: DataFrame, path: str) -> DataFrame:
    """``(doc_id, ids, decoded)`` for rows ``(doc_id, ids)``."""
    ready_workers(rows.sparkSession)

    def run(batches):
        for batch in batches:
            decode, ids = vocabulary(path).decode, batch.column("ids")
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [decode(ids[at + i].as_py() or b"").decode("utf-8", "replace")
                         for i in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("ids"), pa.array(texts, pa.string())],
                    ["doc_id", "ids", "decoded"])

    rows = rows.select("doc_id", "ids")
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields,
                                              T.StructField("decoded", T.StringType())]))
