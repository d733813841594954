"""Ranked search against scores of every document."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from flawsieve.llm import lexical_search as ls

from .conftest import odd_texts, table

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans(ls.UPPER, ls.LOWER)


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, most):
    """For each item the scores in order, and the documents of each score."""
    held = [(i, Counter(terms(t))) for i, t in docs]
    n = sum(bool(c) for _, c in held)
    total = sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    wanted = defaultdict(set)
    for item, text in items:
        wanted[item].update(terms(text))
    out = {}
    for item, ts in wanted.items():
        scores = []
        for doc, c in held:
            m = 50 + (50 * sum(c.values()) * n) // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                        * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in ts if c[t])
            if score > 0:
                scores.append((-score, doc is None, doc or 0))
        rows = sorted(scores)[:most]
        if rows:
            out[item] = [(k, None if null else d, -s) for k, (s, null, d) in enumerate(rows, 1)]
    return out


def found(rows):
    out = defaultdict(list)
    for r in rows:
        out[r.item_id].append((r["rank"], r.doc_id, r.score))
    return {i: sorted(v, key=lambda x: x[0]) for i, v in out.items()}


ITEMS = [(1, "w1 w2 w3 w4 W5 w399"), (2, "One two; the é DAY"), (3, ""), (4, None), (5, "nowhere"),
         (None, "about contact home"), (6, "w1"), (6, "w2 w1"), (7, "ein"), (8, "é\U0001F600 y"),
         (9, " ".join(f"w{i}" for i in range(300)))]


@pytest.mark.parametrize("cells, most", [(750_000, 50), (200, 3)])
def test_against_all_documents(spark, odd, none, monkeypatch, cells, most):
    monkeypatch.setattr(ls, "CELLS", cells)
    monkeypatch.setattr(ls, "BLOCK_TERMS", 100 if most == 3 else 200_000)
    items = spark.createDataFrame([(*i, "x", 1) for i in ITEMS],
                                  "item_id long, text string, term string, rank int")
    rows = ls.search(odd, items, most)
    assert rows.columns == ["item_id", "rank", "doc_id", "score"]
    assert found(rows.collect()) == brute(odd_texts(), ITEMS, most)
    assert ls.search(none, items).count() == 0
    assert ls.search(odd, items.limit(0)).count() == 0


def test_copies_and_ties(spark, monkeypatch):
    """Copies have equal scores; the smallest ids rank first, wherever they are indexed."""
    monkeypatch.setattr(ls, "CELLS", 60)
    r = random.Random(1)
    docs = [(i, "alpha beta gamma" if i % 3 else " ".join(
        r.choice(["alpha", "delta", "beta", "epsilon"]) for _ in range(4))) for i in range(300)]
    r.shuffle(docs)
    items = [(1, "alpha gamma"), (2, "delta epsilon beta")]
    rows = ls.search(table(spark, docs).repartition(5),
                     spark.createDataFrame(items, "item_id long, text string"))
    assert found(rows.collect()) == brute(docs, items, 50)


def test_text_ids(spark):
    docs = spark.createDataFrame([("b", "x y"), ("a", "x y"), (None, "x"), ("c", "y")],
                                 "doc_id string, text string")
    items = spark.createDataFrame([("q", "X")], "item_id string, text string")
    assert [(r.doc_id) for r in ls.search(docs, items).orderBy("rank").collect()] == [
        None, "a", "b"]


@pytest.mark.parametrize("at_once", [1, 4, 128])
def test_treap(monkeypatch, at_once):
    monkeypatch.setattr(ls, "AT_ONCE", at_once)
    r = np.random.default_rng(2)
    for rows, columns, cells in ((1, 1, 1), (3, 50, 60), (70, 9, 200), (40, 500, 4000)):
        where = r.choice(rows * columns, size=min(cells, rows * columns), replace=False)
        grid = np.zeros((rows, columns), np.int64)
        grid.flat[where] = r.integers(1, 1_000_000, len(where))
        at = np.nonzero(grid)
        treap = ls.Treap.of(ls.Treap.packed(*at, grid[at]))
        for _ in range(5):
            chosen = r.choice(rows, size=r.integers(1, rows + 1), replace=False)
            weights = r.integers(0, 900, len(chosen))
            best = ls.Best(7)
            best.names = pa.array(np.arange(columns))
            treap.search(chosen.astype(np.int64), weights.astype(np.int64), best)
            scores = weights @ grid[chosen]
            order = [int(c) for c in np.lexsort((np.arange(columns), -scores)) if scores[c] > 0]
            assert [(-s, c) for s, _, c in best.rows] == [(int(scores[c]), c) for c in order[:7]]


def test_the_descent_leaves_documents_out():
    """With few good documents most cells are never met."""
    r = np.random.default_rng(3)
    rows, columns = np.repeat(np.arange(4), 5000), np.tile(np.arange(5000), 4)
    impacts = r.integers(1, 100, len(rows))
    impacts[[7, 5007, 10007]] = 900_000
    treap, met = ls.Treap.of(ls.Treap.packed(rows, columns, impacts)), []

    class Counted(ls.Best):
        def offer(self, numbers, scores):
            met.extend(numbers)
            super().offer(numbers, scores)

    best = Counted(1)
    best.names = pa.array(np.arange(5000))
    treap.search(np.arange(4), np.ones(4, np.int64), best)
    assert best.rows[0][2] == 7 and len(met) < 1000
