"""Vectors as array columns."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)


def array_cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two array columns."""
    return _dot(a, b) / (F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b)))


def mean_vectors(vectors: DataFrame, key: str, vector: str,
                 mask: str | None = None) -> DataFrame:
    """``(key, mean)``: the mean vector of each key, over the rows whose mask is 1.

    One sum vector per key and task is all that is shuffled.
    """
    rows = vectors if mask is None else vectors.where(F.col(mask) == 1)
    return rows.groupBy(key).agg(vector_to_array(Summarizer.mean(
        array_to_vector(F.col(vector).cast("array<double>")))).alias("mean"))


def masked_mean(hidden: Column, mask: Column) -> Column:
    """Mean of the vectors of one text (``ARRAY<ARRAY>``) whose mask is 1."""
    kept = F.filter(hidden, lambda v, i: F.get(mask, i) == 1)
    zero = F.transform(F.get(hidden, F.lit(0)), lambda _: F.lit(0.0))
    total = F.aggregate(kept, zero, lambda s, v: F.zip_with(
        s, v, lambda x, y: x + y.cast("double")))
    return F.transform(total, lambda x: x / F.size(kept))
