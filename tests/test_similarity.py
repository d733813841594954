"""Vector matching, pooling and the detector."""

import numpy as np
import pytest
from conftest import files_frame

from checks import queries
from flawsieve import catalogue as cat
from flawsieve.functions.vectors import array_cosine, masked_mean, mean_vectors
from flawsieve.operators.nearest import indexed, similar_among_many, visited_blocks
from flawsieve.operators.similarity import (_pair_finder, hashed_ngrams, similar_patterns,
                                             unit_rows)
from flawsieve.plans.detect import detect
from pyspark.sql import functions as F


def vectors(seed, n, d=8):
    return np.random.default_rng(seed).normal(size=(n, d)).astype("float32")


def table(spark, v, name):
    return spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)],
                                 f"{name} int, vector array<float>")


@pytest.mark.parametrize("blocks", [1, 6])
@pytest.mark.parametrize("best_only", [False, True])
def test_matches(spark, blocks, best_only):
    items, patterns = vectors(1, 300), vectors(2, 40)
    items[5] = 0
    patterns[7] = patterns[3]
    sims = unit_rows(items) @ unit_rows(patterns).T
    want = {}
    for i, row in enumerate(sims):
        if best_only:
            j = int(np.argmax(np.nan_to_num(row, nan=-1)))
            if row[j] > 0.5:
                want[(i, j)] = row[j]
        else:
            want |= {(i, j): s for j, s in enumerate(row) if s > 0.5}
    got = {(r.id, r.ord): r.similarity for r in similar_patterns(
        table(spark, items, "id"), table(spark, patterns, "ord"), ["id"], threshold=0.5,
        best_only=best_only, blocks=blocks).collect()}
    assert got.keys() == want.keys() and len(want) > 100
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_no_patterns(spark):
    empty = spark.createDataFrame([], "ord int, vector array<float>")
    assert similar_patterns(table(spark, vectors(1, 3), "id"), empty, ["id"]).count() == 0


def test_many_copies_of_one_vector(spark):
    """Copies of one item are spread over the shares by their keys."""
    items = np.repeat(vectors(3, 1), 500, axis=0)
    got = similar_patterns(table(spark, items, "id"), table(spark, items[:9], "ord"), ["id"],
                           blocks=3, shares=5)
    assert got.count() == 4500


@pytest.mark.parametrize("blocks", [1, 4])
def test_equal_keys_have_a_match_each(spark, blocks):
    items = table(spark, np.repeat(vectors(3, 1), 6, axis=0), "id").selectExpr("id % 2 AS id", "vector")
    found = similar_patterns(items, table(spark, vectors(3, 9), "ord"), ["id"], threshold=0.0,
                             best_only=True, blocks=blocks, shares=3).collect()
    assert sorted((r.id, r.ord) for r in found) == [(0, 0)] * 3 + [(1, 0)] * 3


def crowded(n, seed=5):
    """Vectors around a few centres, a third of them copies of one."""
    r = np.random.default_rng(seed)
    centres = r.normal(size=(12, 24))
    v = centres[r.integers(0, 12, n)] + 0.05 * r.normal(size=(n, 24))
    v[: n // 3] = centres[0]
    return v


@pytest.mark.parametrize("threshold", [-1.5, 0.3, 0.97])
def test_search_with_pruning(spark, threshold):
    """All matches and best ones, with blocks cut into slices and shares, equal those of all
    pairs; vectors without a direction match nothing."""
    items, patterns = crowded(90, 5), crowded(240, 5)
    items[4] = patterns[7] = 0
    rows = table(spark, items, "id").unionByName(
        spark.createDataFrame([(90, None)], "id int, vector array<float>"))
    many = table(spark, patterns, "ord").unionByName(
        spark.createDataFrame([(240, None)], "ord int, vector array<float>"))
    f32 = [v.astype(np.float32).astype(float) for v in (items, patterns)]
    sims = unit_rows(f32[0]) @ unit_rows(f32[1]).T
    bounds = dict(blocks=16, patterns_a_task=20, items_a_task=15)
    found = similar_among_many(rows, many, ["id"], threshold=threshold, **bounds).collect()
    with np.errstate(invalid="ignore"):
        assert {(r.id, r.ord) for r in found} == set(zip(*np.nonzero(sims > threshold)))
    assert all(abs(r.similarity - sims[r.id, r.ord]) < 1e-9 for r in found)
    best = similar_among_many(rows, many, ["id"], threshold=threshold, best_only=True,
                              **bounds).collect()
    want = {i: int(np.flatnonzero(row >= np.nanmax(row) - 1e-12)[0])
            for i, row in enumerate(sims) if i != 4 and np.nanmax(row) > max(threshold, 0)}
    assert {r.id: r.ord for r in best} == want and len(best) == len(want)


def test_pruning_leaves_pairs_out(spark):
    """Items visit few blocks, and a crowded block meets no task as a whole."""
    items, patterns = table(spark, crowded(200, 5), "id"), table(spark, crowded(3000, 5), "ord")
    placed, pivots = indexed(patterns, 64)
    assert pivots.count.sum() == 3000 and pivots.count.max() >= 1000
    visits = items.select(visited_blocks("vector", pivots, 0.9, None).alias("b")).collect()
    compared = sum(int(pivots.count[r.b].sum()) for r in visits)
    # A third of the patterns and of the items are one vector, so a ninth of all pairs match.
    assert 200 * 3000 / 9 < compared < 200 * 3000 / 4
    nearest = items.select(visited_blocks("vector", pivots, 0.0, None, True).alias("b")).collect()
    assert all(len(r.b) == 1 for r in nearest)


def test_pairs_in_bounded_memory():
    """Where all pairs match, their vectors are not laid side by side at once."""
    import tracemalloc

    v = unit_rows(np.ones((1500, 64)))
    tracemalloc.start()
    i, j, sims = _pair_finder(0.5, False)(v, v)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(i) == len(j) == 1500 ** 2 and abs(sims - 1).max() < 1e-9
    assert peak < 400e6


def test_registered_search_copies_few_rows(monkeypatch, spark):
    """Tiles are large enough that half a million vectors are copied a few times only."""
    bounds = {}
    monkeypatch.setattr(queries, "similar_among_many", lambda items, *a, **b: bounds.update(b)
                        or items.select("vec_id", F.lit(0.0).alias("similarity")))
    monkeypatch.setattr(queries, "table", lambda spark, *a: spark.createDataFrame(
        [], "vec_id long, embedding array<float>"))
    queries.cosine_blocks(spark, "")
    patterns, items = 500_000, 5_000
    copies = (patterns * -(-items // bounds["items_a_task"])
              + items * (bounds["blocks"] + patterns // bounds["patterns_a_task"]))
    assert copies < 10 * patterns
    assert bounds["items_a_task"] * bounds["patterns_a_task"] < 10 ** 7


def test_search_in_empty_tables(spark):
    none = table(spark, vectors(3, 2), "id").limit(0)
    some = table(spark, vectors(3, 5), "ord")
    for best in (False, True):
        assert similar_among_many(none, some, ["id"], best_only=best).count() == 0
        assert similar_among_many(some.withColumnRenamed("ord", "id"),
                                  some.limit(0), ["id"], best_only=best).count() == 0


def test_columns(spark):
    v = vectors(4, 30)
    rows = spark.createDataFrame(
        [(i % 3, [float(x) for x in r], i % 2) for i, r in enumerate(v)],
        "label int, vector array<float>, mask int")
    for r in mean_vectors(rows, "label", "vector", "mask").collect():
        want = np.mean([v[i] for i in range(30) if i % 3 == r.label and i % 2], axis=0)
        assert np.allclose(r["mean"], want, atol=1e-6)
    pair = spark.createDataFrame([([1.0, 2.0], [2.0, 1.0])], "a array<float>, b array<float>")
    assert abs(pair.select(array_cosine(F.col("a"), F.col("b")).alias("c")).first().c - 0.8) < 1e-12
    hidden = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], [1, 1, 0])],
                                   "h array<array<float>>, m array<int>")
    assert hidden.select(masked_mean(F.col("h"), F.col("m")).alias("p")).first().p == [2.0, 3.0]


def test_detector(spark):
    embed = hashed_ngrams()
    described = [(t, d) for t, ds in cat.DETECTOR_DESCRIPTIONS.items() for d in ds]
    unit = unit_rows(embed([d for _, d in described]))
    texts = ["md5 used for protection\n# md5 used for protection\nabc\n  old cipher x ",
             "password = secret_key\neval of user text = user login\n// old cipher\n\nplain",
             "sql text joined from strings = 'admin login'"]
    want = set()
    for i, text in enumerate(texts):
        for n, line in enumerate(text.split("\n"), 1):
            line = line.strip()
            if len(line) >= 5 and not line.startswith(("#", "//")):
                sims = (unit * unit_rows(embed([line]))[0]).sum(axis=1)
                j = int(sims.argmax())
                if sims[j] > 0.55:
                    want.add((f"f{i}.py", n, described[j][0], "semantic", round(float(sims[j]), 9)))
            for tier, words in cat.SENSITIVE_KEYWORDS.items():
                if "=" in line and sum(w in line.lower() for w in words) >= 2:
                    want.add((f"f{i}.py", n, "Sensitive Data", "keyword", 0.6))
                    break
    got = {(r.file, r.line, r.finding_type, r.method, round(r.confidence, 9))
           for r in detect(files_frame(spark, texts), embed).collect()}
    assert got == want and {m for _, _, _, m, _ in got} == {"semantic", "keyword"}
