"""Matching by vector similarity: lines against a catalogue of described weaknesses.

The package's own catalogues are small matrices that travel with the task; each Arrow batch of
vectors is compared with one by one matrix product, and only the matches come back.  A *table* of
patterns is cut into blocks and meets shares of the items by co-group.  No pair of line and
pattern ever becomes a row unless it is a result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalogue import DETECTOR_DESCRIPTIONS, SEMANTIC_PATTERNS

# Similarity a match must exceed.
PATTERN_THRESHOLD = 0.65
DETECTOR_THRESHOLD = 0.55

HITS_TYPE = "array<struct<ord:int,similarity:double>>"


@dataclass(frozen=True)
class PatternSet:
    """Patterns in arrival order with their unit vectors (float64, one row each)."""

    ords: np.ndarray
    unit: np.ndarray

    @staticmethod
    def of(ords, vectors) -> "PatternSet":
        return PatternSet(np.asarray(ords, dtype=np.int32), unit_rows(vectors))


def unit_rows(vectors) -> np.ndarray:
    v = np.asarray(vectors, dtype=np.float64)
    with np.errstate(divide="ignore", invalid="ignore"):
        return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def semantic_patterns(embed) -> PatternSet:
    return PatternSet.of(range(1, len(SEMANTIC_PATTERNS) + 1),
                         embed([p.text for p in SEMANTIC_PATTERNS]))


def detector_patterns(embed) -> tuple[PatternSet, list[str]]:
    """The detector's descriptions and the type of each."""
    texts = [(t, d) for t, ds in DETECTOR_DESCRIPTIONS.items() for d in ds]
    return (PatternSet.of(range(1, len(texts) + 1), embed([d for _, d in texts])),
            [t for t, _ in texts])


def _pair_finder(threshold: float, best_only: bool):
    """A function from two matrices of unit vectors to the matching pairs ``(i, j, sims)``.

    The matrix product only proposes pairs: its last digits depend on the size of the batch.
    What is compared with the threshold and returned is summed pair by pair, so a result does
    not depend on how rows were batched.  Products and sums are made a bounded number at a time,
    also where all pairs match.  (Defined inside a function so that it is shipped to the workers
    by value.)
    """
    slack, cells_at_once, sums_at_once = 1e-9, 1 << 21, 1 << 22

    def pairs(v, unit):
        import numpy as np

        rows_at_once = max(cells_at_once // max(len(unit), 1), 1)
        parts = [some(v[at:at + rows_at_once], unit)
                 for at in range(0, len(v), rows_at_once)] or [some(v, unit)]
        return (np.concatenate([i + n * rows_at_once for n, (i, _, _) in enumerate(parts)]),
                np.concatenate([j for _, j, _ in parts]),
                np.concatenate([s for _, _, s in parts]))

    def some(v, unit):
        import numpy as np

        rough = v @ unit.T
        rough = np.where(np.isnan(rough), -np.inf, rough)
        floor = max(threshold, 0.0) if best_only else threshold
        near = rough > floor - slack
        if best_only:
            near &= rough >= rough.max(axis=1, keepdims=True) - slack
        i, j = np.nonzero(near)
        step = max(sums_at_once // max(v.shape[1], 1), 1)
        sims = np.concatenate([(v[i[at:at + step]] * unit[j[at:at + step]]).sum(axis=1)
                               for at in range(0, len(i), step)] or [np.zeros(0)])
        keep = sims > floor
        i, j, sims = i[keep], j[keep], sims[keep]
        if best_only and len(i):
            order = np.lexsort((j, -sims, i))
            first = np.concatenate(([True], np.diff(i[order]) != 0))
            i, j, sims = i[order][first], j[order][first], sims[order][first]
        return i, j, sims

    return pairs


def _matcher(patterns: PatternSet, threshold: float, best_only: bool):
    """A function from a matrix of vectors to the matches of each row."""
    ords, unit = patterns.ords, patterns.unit
    pairs = _pair_finder(threshold, best_only)

    def match(vectors):
        import numpy as np

        v = np.asarray(vectors, dtype=np.float64)
        with np.errstate(divide="ignore", invalid="ignore"):
            v = v / np.sqrt((v * v).sum(axis=1, keepdims=True))
        out = [[] for _ in range(len(v))]
        for i, j, s in zip(*pairs(v, unit)):
            out[i].append((int(ords[j]), float(s)))
        return out

    return match


def vector_hits(vector: Column | str, patterns: PatternSet,
                threshold: float = PATTERN_THRESHOLD, best_only: bool = False) -> Column:
    """Matches of a vector column: all above the threshold, or the best one (first of equals)."""
    match = _matcher(patterns, threshold, best_only)

    def hits(vectors: pd.Series) -> pd.Series:
        import numpy as np
        import pandas as pd

        out = pd.Series([[]] * len(vectors), dtype=object)
        present = vectors.notna().to_numpy()
        if present.any():
            found = match(np.stack(vectors[present].to_numpy()))
            for i, f in zip(np.flatnonzero(present), found):
                out.iat[i] = f
        return out

    return F.pandas_udf(hits, HITS_TYPE)(vector)


def text_hits(text: Column | str, patterns: PatternSet, embed,
              threshold: float = PATTERN_THRESHOLD, best_only: bool = False) -> Column:
    """Matches of a text column; a null text has none.

    ``embed`` turns a list of texts into a matrix.  Text goes in and matches come out, so no
    vector crosses between Python and the JVM.
    """
    match = _matcher(patterns, threshold, best_only)

    def hits(texts: pd.Series) -> pd.Series:
        import numpy as np
        import pandas as pd

        out = pd.Series([[]] * len(texts), dtype=object)
        present = texts.notna().to_numpy()
        if present.any():
            found = match(embed(texts[present].tolist()))
            for i, f in zip(np.flatnonzero(present), found):
                out.iat[i] = f
        return out

    return F.pandas_udf(hits, HITS_TYPE)(text)


def hashed_ngrams(dimensions: int = 256):
    """A deterministic stand-in for a language model: counts of hashed character trigrams,
    with everything but letters and digits read as a blank."""
    texts_at_once = 4096

    def embed(texts):
        import re

        import numpy as np

        blanks = re.compile(r"[^a-z0-9]+")
        out = np.zeros((len(texts), dimensions))
        for at in range(0, len(texts), texts_at_once):
            words = [blanks.sub(" ", f" {text.lower()} ").encode()
                     for text in texts[at:at + texts_at_once]]
            c = np.frombuffer(b"".join(words), dtype=np.uint8).astype(np.int64)
            row = np.repeat(np.arange(len(words)), [len(w) for w in words])
            grams = (c[:-2] * 961 + c[1:-1] * 31 + c[2:]) % dimensions
            # Three letters of one text; others span two.
            within = row[:-2] == row[2:]
            out[at:at + len(words)] = np.bincount(
                (row[:-2] * dimensions + grams)[within],
                minlength=len(words) * dimensions).reshape(len(words), dimensions)
        return out

    return embed


def similar_patterns(items: DataFrame, patterns: DataFrame, key: list[str],
                     vector: str = "vector", threshold: float = PATTERN_THRESHOLD,
                     best_only: bool = False, blocks: int = 1,
                     shares: int | None = None) -> DataFrame:
    """The matches ``(*key, ord, similarity)`` of a table of vectors in a table of patterns
    ``(ord, vector)``; of repeated keys each row has its own.

    Patterns are dealt to ``blocks`` and items to ``shares`` (by default the session's number of
    shuffle partitions); each task compares one share with one block.  Both are the caller's
    choice, so that a block and a share fit into a task: nothing is counted beforehand, and the
    plan is the same for all sizes.  An exact search has to bring each item to each block, so
    items are copied ``blocks`` times and patterns ``shares`` times, vectors included.
    """
    shares = shares or int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    blocked = patterns.select(
        F.pmod(F.xxhash64("ord"), F.lit(blocks)).alias("block"), each(shares).alias("share"),
        "ord", F.col("vector").alias("pattern_vector"))
    # Rows are numbered before they are copied.
    numbered = items.select(*key, F.col(vector).alias("item_vector"),
                            F.monotonically_increasing_id().alias("row"))
    shared = numbered.select("*", each(blocks).alias("block")).withColumn(
        "share", F.pmod(F.xxhash64("row"), F.lit(shares)))
    key = [*key, "row"]

    pairs = _pair_finder(threshold, best_only)

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        import numpy as np
        import pandas as pd

        if not len(left) or not len(right):
            return pd.DataFrame({c: [] for c in [*key, "ord", "similarity"]})

        def unit(column):
            v = np.stack(column.to_numpy()).astype(np.float64)
            with np.errstate(divide="ignore", invalid="ignore"):
                return v / np.sqrt((v * v).sum(axis=1, keepdims=True))

        right = right.sort_values("ord")
        i, j, sims = pairs(unit(left["item_vector"]), unit(right["pattern_vector"]))
        out = left[key].iloc[i].reset_index(drop=True)
        out["ord"] = right["ord"].to_numpy()[j]
        out["similarity"] = sims
        return out

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}"
                       for f in shared.select(*key).schema.fields)
    found = (shared.where(F.col("item_vector").isNotNull()).groupBy("block", "share")
             .cogroup(blocked.groupBy("block", "share"))
             .applyInPandas(compare, f"{schema}, ord int, similarity double"))
    if not best_only:
        return found.drop("row")
    best = found.where("similarity > 0").groupBy(*key).agg(
        F.max(F.struct("similarity", (-F.col("ord")).alias("rank"))).alias("best"))
    return best.select(*key[:-1], (-F.col("best.rank")).alias("ord"), "best.similarity")
