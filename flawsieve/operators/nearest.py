"""Exact search for similar vectors among a large table of patterns, with pruning.

A bounded number of patterns are pivots, and each pattern belongs to the block of its nearest
pivot.  Angles obey the triangle inequality: an item at the angle ``a`` to a pivot is at least
``a - r`` from every pattern of a block with radius ``r``.  So an item is copied only to the blocks
whose bound can pass the threshold or, if the best pattern is wanted, beat what it has already
found: first the nearest pivot, then the best of the nearest block.

Blocks and the items that visit them are counted; a large block is cut into slices and many items
into shares, so no task gets more than ``patterns_a_task`` by ``items_a_task`` rows, however
patterns crowd around one pivot.  The driver sees one row for each block.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.staging import staged
from .similarity import PATTERN_THRESHOLD, _pair_finder, unit_rows

# Rounding in angles and products is far below this.
SLACK = 1e-6


@dataclass(frozen=True)
class Pivots:
    """Unit vectors of the pivots, and of each one's block the radius and the number of patterns."""

    unit: np.ndarray
    radius: np.ndarray
    count: np.ndarray


def _directions():
    """A function from a series of vectors to their directions, which is shipped by value."""
    def unit(vectors):
        v = np.stack(vectors.to_numpy()).astype(np.float64)
        with np.errstate(divide="ignore", invalid="ignore"):
            return v / np.sqrt((v * v).sum(axis=1, keepdims=True))

    return unit


def _nearest_pivot(pivots: np.ndarray):
    """A function from vectors to ``(block, angle)``; null for a vector without a direction."""
    directions = _directions()

    def nearest(vectors: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({"block": pd.Series([None] * len(vectors), dtype="Int32"),
                            "angle": np.nan})
        at = np.flatnonzero(vectors.notna().to_numpy())
        if len(at):
            rough = directions(vectors.iloc[at]) @ pivots.T
            good = ~np.isnan(rough).any(axis=1)
            at, rough = at[good], rough[good]
            best = rough.argmax(axis=1)
            out.loc[at, "block"] = best.astype(np.int32)
            out.loc[at, "angle"] = np.arccos(np.clip(rough[np.arange(len(at)), best], -1, 1))
        return out

    return F.pandas_udf(nearest, "block int, angle double")


def indexed(patterns: DataFrame, blocks: int) -> tuple[DataFrame, Pivots]:
    """The patterns ``(ord, vector)`` with their block, and the pivots."""
    usable = patterns.select("ord", "vector").filter("ord is not null and vector is not null")
    rows = usable.orderBy(F.xxhash64("ord"), "ord").limit(blocks).collect()
    unit = unit_rows([r["vector"] for r in rows]) if rows else np.zeros((0, 1))
    unit = np.unique(unit[~np.isnan(unit).any(axis=1)], axis=0)
    if not len(unit):
        unit = np.eye(1, max((len(r["vector"]) for r in rows), default=1))
    placed = staged(usable.withColumn("p", _nearest_pivot(unit)("vector")).filter(
        "p.block is not null").select("ord", "vector", "p.block", "p.angle"))
    stats = {r["block"]: r for r in placed.groupBy("block").agg(
        F.max("angle").alias("radius"), F.count("*").alias("n")).collect()}
    return placed.drop("angle"), Pivots(
        unit, np.array([stats[b]["radius"] if b in stats else 0.0 for b in range(len(unit))]),
        np.array([stats[b]["n"] if b in stats else 0 for b in range(len(unit))]))


def visited_blocks(vector: Column | str, pivots: Pivots, threshold: float, best: Column | None,
                   first_only: bool = False) -> Column:
    """``ARRAY<INT>``: the blocks in which an item may find a match.  With ``best``, the similarity
    that it has reached so far, only those that can equal it; with ``first_only`` only the block
    with the best bound."""
    unit, radius, count = pivots.unit, pivots.radius, pivots.count
    directions = _directions()

    def blocks(vectors: pd.Series, reached: pd.Series) -> pd.Series:
        out = pd.Series([[]] * len(vectors), dtype=object)
        at = np.flatnonzero(vectors.notna().to_numpy())
        if not len(at) or not count.any():
            return out
        rough = directions(vectors.iloc[at]) @ unit.T
        good = ~np.isnan(rough).any(axis=1)
        at, rough = at[good], rough[good]
        gap = np.arccos(np.clip(rough, -1, 1)) - radius
        bound = np.where(count > 0, np.cos(np.clip(gap, 0, np.pi)), -2.0)
        floor = np.fmax(threshold, reached.to_numpy(dtype=float)[at])
        for i, row, least in zip(at, bound, floor):
            wanted = np.flatnonzero(row >= least - SLACK)
            if first_only and len(wanted):
                wanted = wanted[[row[wanted].argmax()]]
            out.iat[i] = wanted.tolist()
        return out

    reached = F.lit(None).cast("double") if best is None else best
    return F.pandas_udf(blocks, "array<int>")(vector, reached)


def _compared(items: DataFrame, visits: Column, patterns: DataFrame, pivots: Pivots, key: list[str],
              threshold: float, best_only: bool, patterns_a_task: int,
              items_a_task: int) -> DataFrame:
    """``(*key, ord, similarity)`` of items and the patterns in the blocks that they visit."""
    visiting = items.select(*key, "item_vector", F.explode(visits).alias("block"))
    visiting = staged(visiting)
    slices = np.maximum(-(-pivots.count // patterns_a_task), 1)
    visitors = {r["block"]: r["count"] for r in visiting.groupBy("block").count().collect()}
    shares = [max(-(-visitors.get(b, 0) // items_a_task), 1) for b in range(len(slices))]

    def number(values, block="block"):
        return F.get(F.lit([int(v) for v in values]).cast("array<int>"), F.col(block))

    def each(n):
        return F.explode(F.sequence(F.lit(0), n - 1))

    left = visiting.withColumn("share", F.pmod(F.xxhash64(*key), number(shares)).cast("int")
                               ).withColumn("slice", each(number(slices)))
    right = patterns.select("ord", F.col("vector").alias("pattern_vector"), "block").filter(
        number([b in visitors for b in range(len(slices))]) == 1).withColumn(
        "slice", F.pmod(F.xxhash64("ord"), number(slices)).cast("int")).withColumn(
        "share", each(number(shares)))
    pairs, directions = _pair_finder(threshold, best_only), _directions()

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({c: [] for c in [*key, "ord", "similarity"]})
        right = right.sort_values("ord")
        i, j, sims = pairs(directions(left["item_vector"]),
                            directions(right["pattern_vector"]))
        out = left[key].iloc[i].reset_index(drop=True)
        out["ord"] = right["ord"].to_numpy()[j]
        out["similarity"] = sims
        return out

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}"
                       for f in visiting.select(*key).schema.fields)
    ord_type = patterns.schema["ord"].dataType.simpleString()
    return left.groupBy("block", "slice", "share").cogroup(
        right.groupBy("block", "slice", "share")).applyInPandas(
        compare, f"{schema}, ord {ord_type}, similarity double")


def _best(found: DataFrame, key: list[str]) -> DataFrame:
    top = found.groupBy(*key).agg(
        F.max(F.struct("similarity", (-F.col("ord")).alias("rank"))).alias("best"))
    return top.select(*key, (-F.col("best.rank")).alias("ord"), "best.similarity")


def similar_among_many(items: DataFrame, patterns: DataFrame, key: list[str],
                       vector: str = "vector", threshold: float = PATTERN_THRESHOLD,
                       best_only: bool = False, blocks: int = 256, patterns_a_task: int = 16_384,
                       items_a_task: int = 16_384) -> DataFrame:
    """The matches ``(*key, ord, similarity)`` of a table of vectors in a table of patterns
    ``(ord, vector)``: all above the threshold or, with ``best_only``, the best one above it and
    above 0 (the first of equals).  Of repeated keys each row has its own.  Vectors that are null
    or have no direction match nothing; ``ord`` numbers the patterns.
    """
    placed, pivots = indexed(patterns, blocks)
    numbered = staged(items.select(*key, F.col(vector).alias("item_vector"),
                                   F.monotonically_increasing_id().alias("row")))
    names, bounds = [*key, "row"], (patterns_a_task, items_a_task)

    def compared(rows, visits):
        return _compared(rows, visits, placed, pivots, names, threshold, best_only, *bounds)

    vectors = F.col("item_vector")
    if not best_only:
        return compared(numbered, visited_blocks(vectors, pivots, threshold, None)).drop("row")
    floor = max(threshold, 0.0)
    near = staged(_best(compared(numbered, visited_blocks(vectors, pivots, floor, None, True)),
                        names))
    # What the nearest block gave says which others are worth a visit.
    others = numbered.join(near.select(
        "row", F.col("similarity").alias("reached")).hint("merge"), "row", "left")
    rest = compared(others, F.array_except(
        visited_blocks(vectors, pivots, floor, F.col("reached")),
        visited_blocks(vectors, pivots, floor, None, True)))
    return _best(near.unionByName(rest), names).drop("row")
