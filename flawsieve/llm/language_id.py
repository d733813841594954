"""Language identification by prediction by partial matching.

Each language has a tree of contexts of up to ``ORDER`` bytes with the counts of the bytes that
followed them.  A byte is coded in the longest known context: one that followed n times out of N,
where d different bytes followed, costs -log(n / (N + d)); one that never did costs an escape,
-log(d / (N + d)), and is coded in the next shorter context; a byte that no context knows costs
log 256.  Counts are frozen after training, so the code length of a text is a sum over its bytes.
The language with the shortest code is predicted; the score is its share of the probability of the
text over all languages that were learned.

Because counts are frozen, all escapes of a byte add up to a difference: a context keeps E, what it
costs to escape from it and all shorter ones, and a byte in its context keeps its own cost less the
context's E.  So a byte costs E of the longest known context plus what the longest known string of
context and byte keeps.  Strings have at most seven bytes and are whole numbers, with their
length in the upper byte, so nothing is hashed and look-ups are exact.

Training takes a bounded sample: of each language the ``sample_rows`` labelled rows of at most
``sample_bytes`` bytes with the smallest hash of their id.  Its strings are counted in tasks and
added up by key.  The trees have at most as many strings as the sample has bytes, times ``ORDER`` + 1.

Cases: a text that is null or has no letter is ``und`` with score 0; rows without a language or an
id train nothing; repeated rows are trained on and scored each; of languages that cost the same the
first by name is predicted; without any labelled row all texts are ``und``; extra columns, whatever
their names, play no part; an empty table gives an empty table; long texts are scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, ready_workers

ORDER = 5
SAMPLE_ROWS, SAMPLE_BYTES = 200, 65_536
UNKNOWN = "und"
# Bytes of the texts that are scored at once.
SHARE = 1 << 20
_NONE = np.log(256.0)


def strings(data: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """For each length from 1 to ``most`` the numbers of all strings of that length, in order."""
    wide = data.astype(np.uint64)
    found = wide
    for n in range(1, most + 1):
        if n > 1:
            found = (found[:-1] << np.uint64(8)) | wide[n - 1:] if len(wide) >= n else found[:0]
        yield found | np.uint64(n << 56)


def last_bytes(numbers: np.ndarray, n: int) -> np.ndarray:
    """The strings' last ``n`` bytes."""
    mask = (1 << (8 * n)) - 1
    return (numbers & np.uint64(mask)) | np.uint64(n << 56)


def counted(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All strings of up to ``ORDER`` + 1 bytes within the texts, and how often they occur."""
    parts = [s for t in texts for s in strings(np.frombuffer(t, np.uint8), ORDER + 1) if len(s)]
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.unique(np.concatenate(parts), return_counts=True)


class Tree:
    """Frozen statistics of one language.  ``keys`` ascend, and so are grouped by length."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        lengths = (keys >> np.uint64(56)).astype(int)
        groups = {n: (keys[lengths == n], counts[lengths == n]) for n in range(1, ORDER + 2)}
        # By length of the context: its number, and E.
        self.contexts: list[tuple[np.ndarray, np.ndarray]] = []
        self.kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in range(1, ORDER + 2):
            found, times = groups[n]
            above = ((found >> np.uint64(8)) & np.uint64((1 << 48) - 1)) | np.uint64((n - 1) << 56)
            names, at, kinds = np.unique(above, return_inverse=True, return_counts=True)
            total = np.bincount(at, weights=times, minlength=len(names))
            escape = np.log(total + kinds) - np.log(kinds)
            if n > 1:  # every context but the empty one has a shorter one
                shorter = last_bytes(names, n - 2) if n > 2 else np.zeros(len(names), np.uint64)
                ids, all_ = self.contexts[-1]
                escape = escape + all_[np.searchsorted(ids, shorter)]
            self.contexts.append((names, escape))
            self.kept[n] = (found, np.log((total + kinds)[at]) - np.log(times) - escape[at])

    def contexts_cost(self, contexts: np.ndarray) -> np.ndarray:
        """E of the longest known context at the end of each string of ``ORDER`` bytes or fewer."""
        return self._longest(contexts, lambda n: self.contexts[n], range(ORDER, -1, -1), 0.0)

    def bytes_cost(self, found: np.ndarray) -> np.ndarray:
        return self._longest(found, lambda n: self.kept[n], range(ORDER + 1, 0, -1), _NONE)

    @staticmethod
    def _longest(numbers, table, lengths, otherwise) -> np.ndarray:
        out = np.full(len(numbers), otherwise)
        have = (numbers >> np.uint64(56)).astype(int)
        left = np.arange(len(numbers))
        for n in lengths:
            keys, values = table(n)
            if not len(keys) or not len(left):
                continue
            fits = have[left] >= n
            part = left[fits]
            wanted = last_bytes(numbers[part], n) if n else np.zeros(len(part), np.uint64)
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            hit = keys[at] == wanted
            out[part[hit]] = values[at[hit]]
            left = np.concatenate([left[~fits], part[~hit]])
        return out


def pieces(texts: Iterator[bytes]) -> Iterator[tuple[list[bytes], list[int], list[int]]]:
    """Texts in runs of about ``SHARE`` bytes: pieces, the number of the text of each, and how many
    bytes at its front are only the context of the others.  A text may go over several runs."""
    run: tuple[list, list, list] = ([], [], [])
    size = 0
    for number, text in enumerate(texts):
        for at in range(0, len(text), SHARE):
            skipped = min(at, ORDER)
            for column, value in zip(run, (text[at - skipped:at + SHARE], number, skipped)):
                column.append(value)
            size += len(run[0][-1])
            if size >= SHARE:
                yield run
                run, size = ([], [], []), 0
    if run[0]:
        yield run


def code_lengths(texts: list[bytes], skipped: list[int], trees: list[Tree]) -> np.ndarray:
    """In nats, a row for each text, which has bytes, and a column for each tree.  The first
    ``skipped`` bytes of a text are context and cost nothing."""
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint64)
    # The string that ends with each byte, of its text only.
    place = np.arange(len(data)) - np.repeat(ends - sizes, sizes)
    size = np.minimum(place + 1, ORDER + 1).astype(np.uint64)
    counts = place >= np.repeat(skipped, sizes)
    number = data.copy()
    for n in range(1, ORDER + 1):
        number[n:] |= data[:-n] << np.uint64(8 * n)
    number &= (np.uint64(1) << (size * np.uint64(8))) - np.uint64(1)
    number |= size << np.uint64(56)
    kinds, at = np.unique(number, return_inverse=True)
    size = kinds >> np.uint64(56)
    before = ((kinds & np.uint64((1 << 56) - 1)) >> np.uint64(8)) | (
        (size - np.uint64(1)) << np.uint64(56))
    contexts, of = np.unique(before, return_inverse=True)
    out = np.zeros((len(texts), len(trees)))
    for k, tree in enumerate(trees):
        cost = tree.bytes_cost(kinds) + tree.contexts_cost(contexts)[of]
        out[:, k] = np.add.reduceat(np.where(counts, cost[at], 0.0), ends - sizes)
    return out


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS,
          sample_bytes: int = SAMPLE_BYTES) -> dict[str, Tree]:
    """The trees of all languages of ``(doc_id, text, lang)``, by name."""
    ready_workers(docs.sparkSession)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"),
                       F.col("lang").cast("string").alias("lang"))
    rows = rows.filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull()
                       & F.col("text").isNotNull() & (F.octet_length("text") <= sample_bytes))
    rows = rows.withColumn("at", F.struct(F.xxhash64("doc_id").alias("a"),
                                          F.xxhash64("text").alias("b")))

    def first(rows):
        number = F.row_number().over(Window.partitionBy("lang").orderBy("at"))
        return rows.withColumn("n", number).filter(F.col("n") <= sample_rows)

    # The last hash that is wanted of each language: texts are read with it, and never sorted or
    # shuffled.  It is one row for each tree that the workers will hold.
    last = first(rows.select("lang", "at")).groupBy("lang").agg(F.max("at").alias("last"))
    sample = first(rows.join(F.broadcast(last), "lang").filter(F.col("at") <= F.col("last"))).select(
        "lang", "text")
    schema = arrow_schema("lang string, key long, n long")

    def run(batches):
        for batch in batches:
            by_lang: dict[str, list[bytes]] = {}
            for lang, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "text"))):
                by_lang.setdefault(lang, []).append(text.encode())
            for lang, texts in by_lang.items():
                for part, _, _ in pieces(texts):
                    keys, counts = counted(part)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(keys), pa.string()),
                         pa.array(keys.view(np.int64)), pa.array(counts)], schema=schema)

    counts = sample.mapInArrow(run, "lang string, key long, n long").groupBy("lang", "key").agg(
        F.sum("n").alias("n")).toArrow()  # bounded by the sample's size
    out = {}
    for lang in sorted(counts.column("lang").unique().to_pylist()):
        part = counts.filter(pc.equal(counts.column("lang"), lang))
        out[lang] = Tree(np.asarray(part.column("key"), np.int64).view(np.uint64),
                         np.asarray(part.column("n"), np.int64))
    return out


def predicted(docs: DataFrame, trees: dict[str, Tree]) -> DataFrame:
    """``(doc_id, lang_pred, score)`` of each whole text."""
    ready_workers(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.cast("binary").alias("data"),
                       F.rlike(text, F.lit(r"\p{L}")).alias("letters"))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast((list(trees), list(trees.values())))

    def run(batches):
        names, models = shared.value
        for batch in batches:
            letters = batch.column("letters").to_pylist()
            costs = np.zeros((batch.num_rows, len(names)))
            texts = (t.as_py() if known else b"" for t, known in zip(batch.column("data"), letters))
            for parts, of, skipped in pieces(texts) if names else ():
                np.add.at(costs, of, code_lengths(parts, skipped, models))
            langs, scores = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            if names:
                least = costs.min(axis=1, keepdims=True)
                langs = [names[k] if known else UNKNOWN
                         for k, known in zip(costs.argmin(axis=1), letters)]
                scores = np.where(letters, 1 / np.exp(least - costs).sum(axis=1), 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(langs, pa.string()),
                 pa.array(scores, pa.float64())], schema.names)

    return rows.mapInArrow(run, schema)
