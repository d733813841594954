"""Token ids of whole texts inside Python workers.

A text is cut where the byte-level split pattern always cuts: a text of Latin-1 characters into the
pattern's own words, any other before each single space that stands between two visible
characters, as the pattern never joins a visible character to a space after it and looks ahead only
within white space.  So the ids of the text are the ids of its pieces in a row.  Most pieces repeat,
and a worker remembers those that it has seen.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np

# A worker remembers two generations of at most so many pieces of at most so many characters.
REMEMBERED, LONGEST = 500_000, 48
# Texts are taken from a batch in shares of about so many characters.
SHARE = 2_000_000
# Pieces that are encoded as one text.
JOINED = 256
# The format's split pattern, with its classes of letters, numbers and white space
# written out for Latin-1.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", "\\t-\\r \\x85\\xa0"
LATIN_SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|"
                         f"[{_S}]+(?![^{_S}])|[{_S}]+")
_CUT = re.compile(r"(?<=\S) (?=\S)")
_ONE_WORD = re.compile(r" ?\S+")


def is_latin(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class _Known(dict):
    """Numbers pieces as they come.  ``ids`` has those of all numbered pieces in a row, but for the
    ``new`` ones at the end."""

    def __init__(self):
        self.new: list[str] = []
        self.count = 0
        self.ids, self.sizes, self.starts = (np.zeros(0, t) for t in ("<u4", np.int64, np.int64))

    def __missing__(self, piece: str) -> int:
        number = self[piece] = self.count
        self.count += 1
        self.new.append(piece)
        return number

    def learn(self, ids: list[bytes]) -> None:
        """The ids of the new pieces; long ones are forgotten again."""
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(ids), "<u4")])
        self.sizes = np.concatenate([self.sizes, [len(i) // 4 for i in ids]]).astype(np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        for piece in self.new:
            if len(piece) > LONGEST:
                del self[piece]
        self.new = []

    def of(self, piece: str) -> bytes | None:
        number = self.get(piece)
        if number is None:
            return None
        return self.ids[self.starts[number]:self.starts[number] + self.sizes[number]].tobytes()


class PieceEncoder:
    """Ids of texts as little-endian unsigned 32-bit bytes.  ``encode`` gives those of a list of
    pieces; ``added`` are strings that are tokens wherever they stand."""

    def __init__(self, encode: Callable[[list[str]], Iterable[bytes]], added: Iterable[str] = ()):
        self.encode, self.added = encode, tuple(added)
        self.known, self.before = _Known(), _Known()

    def pieces(self, text: str) -> list[str]:
        if any(a in text for a in self.added):
            if any(" " in a for a in self.added):
                return [text]
        elif is_latin(text):
            return LATIN_SPLIT.findall(text)
        first, *others = _CUT.split(text)
        return [first, *[" " + p for p in others]]

    def __call__(self, texts: list[str]) -> list[bytes]:
        if self.known.count > REMEMBERED:
            self.known, self.before = _Known(), self.known
        known = self.known
        pieces = [self.pieces(t) for t in texts]
        counts = np.array([len(p) for p in pieces], np.int64)
        at = np.fromiter(map(known.__getitem__, chain.from_iterable(pieces)), np.int64,
                         count=int(counts.sum()))
        if known.new:
            ids = [self.before.of(p) for p in known.new]
            learned = iter(self.encode([p for p, i in zip(known.new, ids) if i is None]))
            known.learn([next(learned) if i is None else i for i in ids])
        # The ids of all pieces in a row, taken from those of the different ones.
        size = known.sizes[at]
        ends = np.concatenate([[0], np.cumsum(size)])
        out = known.ids[np.repeat(known.starts[at] - ends[:-1], size) + np.arange(ends[-1])]
        stops = ends[np.cumsum(counts)].tolist()
        return [out[a:b].tobytes() for a, b in zip([0, *stops[:-1]], stops)]


def _library(path: str) -> tuple[Callable[[list[str]], Iterable[bytes]], Iterable[str]]:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    spec = json.loads(tokenizer.to_str())
    if spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["normalizer"]:
        raise ValueError("pieces of a text are independent in byte-level vocabularies only")
    added = {t["content"] for t in spec["added_tokens"]}
    vocabulary = tokenizer.get_vocab(with_added_tokens=True)
    length = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)  # bytes of each token
    for token, i in vocabulary.items():
        length[i] = len(token.encode()) if token in added else len(token)

    def alone(texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4")
                for e in tokenizer.encode_batch(texts, add_special_tokens=False)]

    def joined(group: list[str]) -> Iterator[bytes]:
        """Words with a line end behind each, which is a piece of its own: their ids follow from
        the tokens' lengths."""
        ids = alone(["\n".join(group)])[0]
        ends = np.cumsum([len(p.encode()) + 1 for p in group])
        places = np.cumsum(length[ids])
        stops = np.searchsorted(places, ends - 1) + 1
        starts = np.searchsorted(places, np.concatenate([[0], ends[:-1]]), side="right")
        starts[0] = 0
        raw = ids.tobytes()
        return (raw[4 * a:4 * b] for a, b in zip(starts.tolist(), stops.tolist()))

    def encode(pieces: list[str]) -> list[bytes]:
        found: list[bytes] = [b""] * len(pieces)
        words = [i for i, p in enumerate(pieces) if _ONE_WORD.fullmatch(p)]
        for at in range(0, len(words), JOINED):
            group = words[at:at + JOINED]
            for i, ids in zip(group, joined([pieces[i] for i in group])):
                found[i] = ids
        others = sorted(set(range(len(pieces))).difference(words))
        for i, ids in zip(others, alone([pieces[i] for i in others])):
            found[i] = ids.tobytes()
        return found

    return encode, added


_ENCODERS: dict[str, PieceEncoder] = {}


def library_encoder(path: str) -> PieceEncoder:
    """The tokenizers library's ids, special strings in a text included; one for each worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(*_library(path))
    return _ENCODERS[path]


def shares(batch, size: int = SHARE) -> Iterator[tuple[int, list[str]]]:
    """``(row, texts)``: the texts of an Arrow batch in runs of bounded length."""
    column, at, texts, chars = batch.column("text"), 0, [], 0
    for i in range(batch.num_rows):
        texts.append(column[i].as_py())
        chars += len(texts[-1])
        if chars >= size:
            yield at, texts
            at, texts, chars = i + 1, [], 0
    if texts:
        yield at, texts
