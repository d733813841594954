"""Language identification against a plain model, and held-out accuracy."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from flawsieve.llm import language_id as li

SF = "/root/testdata/sf0.01"


class Plain:
    """Prediction by partial matching with dictionaries, byte by byte."""

    def __init__(self, texts):
        self.after = defaultdict(Counter)
        for t in texts:
            for i in range(len(t)):
                for n in range(min(i, li.ORDER) + 1):
                    self.after[t[i - n:i]][t[i]] += 1

    def cost(self, text, i):
        total = 0.0
        for n in range(min(i, li.ORDER), -1, -1):
            seen = self.after.get(text[i - n:i])
            if not seen:
                continue
            size = sum(seen.values()) + len(seen)
            if text[i] in seen:
                return total - math.log(seen[text[i]] / size)
            total -= math.log(len(seen) / size)
        return total + math.log(256)


def texts_of(seed, n=60):
    r = random.Random(seed)
    letters = "abcdé 日" if seed % 2 else "xyzé ,"
    return ["".join(r.choice(letters) for _ in range(r.randrange(1, 60))).encode()
            for _ in range(n)] + [b"a" * 300, bytes(range(256))]


@pytest.mark.parametrize("share", [1 << 20, 64])
def test_code_lengths(monkeypatch, share):
    monkeypatch.setattr(li, "SHARE", share)
    models = [texts_of(1), texts_of(2), [b"a"]]
    trees, plain = [li.Tree(*li.counted(m)) for m in models], [Plain(m) for m in models]
    texts = texts_of(3) + texts_of(4) + [b"x" * 1000]
    got = np.zeros((len(texts), 3))
    for parts, of, skipped in li.pieces(iter(texts)):
        np.add.at(got, of, li.code_lengths(parts, skipped, trees))
    want = [[sum(p.cost(t, i) for i in range(len(t))) for p in plain] for t in texts]
    assert np.allclose(got, want, rtol=1e-9)


def docs(spark, rows):
    return spark.createDataFrame(
        [(*r, None, "x", 1) for r in rows],
        "doc_id long, text string, lang string, at string, letters string, n int")


def test_odd_rows(spark):
    rows = [(i, t.decode("utf-8", "ignore"), lang) for lang, seed in (("aa", 1), ("bb", 2))
            for i, t in enumerate(texts_of(seed))]
    rows += [(None, "xyz xyz", "aa"), (900, None, "aa"), (901, "", "bb"), (902, "12 !?", "bb"),
             (903, "xyz,xyz,zyx", None), (903, "xyz,xyz,zyx", None), (904, "日" * 3000, None),
             (None, "abcd dcba", None)]
    table = docs(spark, rows)
    trees = li.train(table)
    assert list(trees) == ["aa", "bb"]
    out = li.predicted(table, trees).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    by = defaultdict(list)
    for r in out:
        by[r.doc_id].append((r.lang_pred, r.score))
    assert by[900] == by[901] == by[902] == [("und", 0.0)]
    assert [p for p, _ in by[903]] == ["bb", "bb"] and by[904][0][0] == "aa"
    assert sorted(p for p, _ in by[None]) == ["aa", "bb"]
    # With nothing to learn from, and with no rows.
    none = li.train(docs(spark, [(1, "abc", None), (None, "abc", "aa")]))
    assert none == {}
    assert [tuple(r) for r in li.predicted(docs(spark, [(1, "abc", "aa")]), none).collect()] == [
        (1, "und", 0.0)]
    assert li.predicted(docs(spark, []), trees).count() == 0


def test_the_sample_is_bounded(spark):
    """One id that many rows share, and texts beyond the size, train no more than they may."""
    rows = [(7, f"word {i}", "aa") for i in range(50)] + [(8, "y" * 500, "aa"), (9, "zz", "bb")]
    trees = li.train(docs(spark, rows), sample_rows=5, sample_bytes=100)
    empty = np.uint64(0)
    for name, texts in (("aa", 5), ("bb", 1)):
        found, counts = trees[name].kept[1]
        assert (found & np.uint64(255) != ord("y")).all() and trees[name].contexts[0][0] == empty
    assert len(trees["bb"].kept[2][0]) == 1


def test_held_out_accuracy(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    trees = li.train(table.filter(~li.held_out(F.col("doc_id"))))
    rows = li.predicted(table, trees).join(table, "doc_id").filter(li.held_out(F.col("doc_id")))
    right, n = rows.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")),
                        F.count("*")).first()
    assert n > 300 and right >= 0.98 * n
