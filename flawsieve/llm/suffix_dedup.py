"""Passages of fifty words or more that occur again anywhere: every one of them.

A passage of ``LEAST`` words or more is a run of windows of ``LEAST`` words, each of which occurs
again.  Windows are counted by their hash, with the earliest place of each.  Most windows need not
be: each has a minimiser, the smallest hash of five words within its first ``WINDOW`` runs of such.
Which one that is depends on the words of the window only, so if the window occurs again, so do the
``HEAD`` words from its minimiser on.

1. The hash of the ``HEAD`` words from each minimiser on is counted, combined before the shuffle.
   The places of heads that occur once are gathered by document.
2. The windows whose head occurs again are counted by the hash of all their words, combined before
   the shuffle.  The places of windows that occur once, and the first places of the others, are
   gathered by document; all other windows have an earlier occurrence.
3. The windows that occur again are united for each document.  Those that have an earlier
   occurrence, by ``doc_id`` and position, are ``later``, and can be removed: of each window of a
   passage one copy stays.

Heads and windows are not compared with neighbours and not looked up by hash, so a passage that
very many documents share is no hot key: it reaches its count as one row for each task and leaves
it as one place.

Windows are compared by 64-bit hashes.  Words are runs of characters other than white space, in
lower case; spans count words.

Cases: null, empty and short texts have no passages; a null ``doc_id`` ranks after all others;
repeated rows have all their passages from each other; extra columns, whatever their names, play
no part; an empty table gives an empty table; a long text is taken whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ready_workers, shared_folder, staged
from .exact_dedup import located, on_files
from .jaccard_join import _mixed, plain_words, word_hashes

LEAST, WINDOW, GRAM = 50, 24, 5
HEAD = LEAST - WINDOW + 1
PLACE = ("doc_id", "file", "number")
ODD = np.uint64(0x9E3779B97F4A7C15)
SPANS = T.ArrayType(T.StructType().add("start", T.IntegerType()).add("stop", T.IntegerType()))


def _grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words, from those of 1, 2, 4 ... words."""

    def joined(a, b, step):
        m = max(0, min(len(a), len(b) - step))
        return _mixed(a[:m] * ODD + b[step:step + m])

    out, done, power, width = None, 0, words, 1
    while True:
        if n & width:
            out, done = (power if out is None else joined(out, power, done)), done + width
        if done == n:
            return out
        power, width = joined(power, power, width), 2 * width


def minimisers(words: np.ndarray) -> np.ndarray:
    """The position of the minimiser of each window of ``LEAST`` words."""
    n = len(words) - LEAST + 1
    if n < 1:
        return np.zeros(0, np.int64)
    grams = _grams(words, GRAM)[:n + WINDOW - 1]
    return np.lib.stride_tricks.sliding_window_view(grams, WINDOW).argmin(axis=1) + np.arange(n)


def heads(texts: DataFrame) -> DataFrame:
    """``(file, number, head, at)`` of each minimiser."""
    schema = texts.select("file", "number").schema.add("head", T.LongType()).add(
        "at", T.IntegerType())

    def run(batches):
        for batch in batches:
            column = batch.column("plain")
            rows, found, places = [], [], []
            for i in range(batch.num_rows):
                words = word_hashes(column[i].as_py())
                at = np.unique(minimisers(words))
                if len(at):
                    rows.append(np.full(len(at), i))
                    found.append(_grams(words, HEAD)[at].view(np.int64))
                    places.append(at)
                if rows and (i == batch.num_rows - 1 or sum(map(len, rows)) > 50_000):
                    yield _taken(batch, rows, found, places)
                    rows, found, places = [], [], []
            if rows:
                yield _taken(batch, rows, found, places)

    def _taken(batch, rows, found, places):
        part = batch.select(["file", "number"]).take(pa.array(np.concatenate(rows)))
        return pa.RecordBatch.from_arrays(
            [part.column("file"), part.column("number"), pa.array(np.concatenate(found), pa.int64()),
             pa.array(np.concatenate(places), pa.int32())], schema.names)

    return texts.mapInArrow(run, schema)


def _numbered(places: DataFrame) -> DataFrame:
    """``(file, number, base)`` of ``(doc_id, file, number, size)``: ``base + at`` is a number for
    each place of a word, in their order."""
    rows = places.repartitionByRange(F.col("doc_id").isNull(), *PLACE).sortWithinPartitions(
        F.col("doc_id").isNull(), *PLACE).select("file", "number", "size")
    schema = rows.select("file", "number").schema.add("base", T.LongType())

    def run(batches):
        at = TaskContext.get().partitionId() << 40
        for batch in batches:
            ends = at + np.cumsum(np.asarray(batch.column("size"), np.int64))
            base = np.concatenate([[at], ends])
            at = int(base[-1])
            yield pa.RecordBatch.from_arrays(
                [batch.column("file"), batch.column("number"), pa.array(base[:-1], pa.int64())],
                schema.names)

    return rows.mapInArrow(run, schema)


def _windows(rows: DataFrame) -> DataFrame:
    """``(place, base, n_words, at, key)`` of ``(place, base, plain, single)``: the windows whose
    minimiser is not at one of the places ``single``, and their hashes."""
    schema = rows.select(*PLACE, "base").schema.add("n_words", T.LongType()).add(
        "at", T.ArrayType(T.IntegerType())).add("key", T.ArrayType(T.LongType()))
    names = schema.names[:4]

    def run(batches):
        for batch in batches:
            counts, starts, keys, size, begin = [], [], [], 0, 0
            for i in range(batch.num_rows):
                words = word_hashes(batch.column("plain")[i].as_py())
                single = batch.column("single")[i].values
                from_ = minimisers(words)
                at = np.arange(len(from_)) if single is None else np.flatnonzero(
                    ~np.isin(from_, np.asarray(single)))
                counts.append(len(words))
                starts.append(at)
                keys.append(_grams(words, LEAST)[at].view(np.int64) if len(at) else at)
                size += len(at)
                if size > 500_000 or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays(
                        [*[batch.column(c).slice(begin, len(counts)) for c in names],
                         pa.array(counts, pa.int64()), pa.array(starts, pa.list_(pa.int32())),
                         pa.array(keys, pa.list_(pa.int64()))], schema.names)
                    counts, starts, keys, size, begin = [], [], [], 0, i + 1

    return rows.mapInArrow(run, schema)


def _united(at: np.ndarray) -> list[dict]:
    """Spans of the windows that start at the sorted places ``at``; they don't touch."""
    if not len(at):
        return []
    cuts = np.flatnonzero(np.diff(at) > LEAST)
    return [{"start": int(a), "stop": int(b) + LEAST}
            for a, b in zip(at[np.concatenate([[0], cuts + 1])], at[np.append(cuts, -1)])]


def _spans(rows: DataFrame) -> DataFrame:
    """``(place, n_words, spans, later)`` of ``(place, n_words, at, found)``; ``found`` has twice
    the places of windows that occur once, and of first ones of others, these with 1 added."""
    schema = rows.select(*PLACE, "n_words").schema.add("spans", SPANS).add("later", SPANS)
    names = schema.names[:4]
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))

    def run(batches):
        for batch in batches:
            spans, later = [], []
            for i in range(batch.num_rows):
                at, found = (np.zeros(0, np.int64) if v is None else np.asarray(v, np.int64)
                             for v in (batch.column(c)[i].values for c in ("at", "found")))
                again = at[~np.isin(at, found[found % 2 == 0] >> 1)]
                spans.append(_united(again))
                later.append(_united(again[~np.isin(again, found[found % 2 == 1] >> 1)]))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in names], pa.array(spans, kind), pa.array(later, kind)],
                schema.names)

    return rows.mapInArrow(run, schema)


def repeated_passages(docs: DataFrame) -> DataFrame:
    """``(doc_id, file, number, n_words, spans, later)`` for each row: spans of words that occur
    elsewhere too, and of those that have an earlier occurrence."""
    ready_workers(docs.sparkSession)
    folder = shared_folder(docs.sparkSession)
    place = ["held.doc_id", F.xxhash64("file").alias("file"), "number"]
    docs = on_files(docs)
    texts = located(docs).select(*place, plain_words(F.col("held.text")).alias("plain"))
    size = F.length(F.coalesce(F.col("held.text").cast("string"), F.lit(""))) + 1
    numbered = staged(_numbered(located(docs).select(*place, size.alias("size"))),
                      f"{folder}/numbered")
    # Of a head that occurs once these are its place; the others are not asked for.
    single = heads(texts).groupBy("head").agg(
        F.count(F.lit(1)).alias("n"), *[F.min(c).alias(c) for c in ("file", "number", "at")]
        ).filter("n = 1").groupBy("file", "number").agg(F.collect_list("at").alias("single"))
    joined = texts.join(numbered, ["file", "number"]).join(single, ["file", "number"], "left")
    windows = staged(_windows(joined.select(*PLACE, "base", "plain", "single")),
                     f"{folder}/windows")
    place_of = F.col("base") + F.col("w.at")
    found = windows.select("base", F.explode(F.arrays_zip("at", "key")).alias("w")).groupBy(
        "w.key").agg((F.count(F.lit(1)) > 1).cast("int").alias("again"),
                     F.min(place_of).alias("first"), F.min_by("base", place_of).alias("base"))
    found = found.groupBy("base").agg(F.collect_list(
        ((F.col("first") - F.col("base")) * 2 + F.col("again")).cast("int")).alias("found"))
    return _spans(windows.drop("key").join(found, "base", "left").select(
        *PLACE, "n_words", "at", "found"))


def without_later(docs: DataFrame) -> DataFrame:
    """``(doc_id, text, cleaned)``: each text without the words of its later passages; a text that
    loses words has one space between those that stay."""
    docs = on_files(docs)
    later = repeated_passages(docs).select(*PLACE, "later")
    rows = located(docs).select("held.doc_id", F.col("held.text").alias("text"),
                                F.xxhash64("file").alias("file"), "number").alias("t")
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    gone = F.flatten(F.transform("later", lambda s: F.sequence(s["start"], s["stop"] - 1)))
    stay = F.array_except(F.sequence(F.lit(0), F.size("words") - 1), gone)
    joined = rows.join(later.alias("l"), [F.col(f"t.{c}").eqNullSafe(F.col(f"l.{c}"))
                                          for c in PLACE]).select(
        "t.doc_id", "text", "later", words.alias("words"))
    return joined.select("doc_id", "text", F.when(F.size("later") == 0, F.col("text")).otherwise(
        F.array_join(F.transform(stay, lambda i: F.get("words", i)), " ")).alias("cleaned"))
