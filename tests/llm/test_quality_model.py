"""The quality model's training against the update rule written out coordinate by coordinate."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from flawsieve.llm import quality_model as qm


def plain_training(rows):
    """``rows``: (shard, place, label, slots, values).  Weights by slot, the intercept at SLOTS."""
    common_z, common_n = {}, {}

    def weight(z, n):
        if abs(z) <= qm.L1:
            return 0.0
        return -(z - math.copysign(qm.L1, z)) / ((qm.BETA + math.sqrt(n)) / qm.ALPHA + qm.L2)

    for _ in range(qm.ROUNDS):
        states = []
        for shard in range(qm.SHARDS):
            z, n = dict(common_z), dict(common_n)
            mine = sorted((r for r in rows if r[0] == shard),
                          key=lambda r: (r[1], r[2], r[3].tobytes()))
            for _, _, label, slots, values in mine:
                x = {**{int(s): float(v) for s, v in zip(slots, values)}, qm.SLOTS: 1.0}
                w = {s: weight(z.get(s, 0.0), n.get(s, 0.0)) for s in x}
                p = 1 / (1 + math.exp(-sum(w[s] * v for s, v in x.items())))
                for s, v in x.items():
                    g, before = (p - label) * v, n.get(s, 0.0)
                    n[s] = before + g * g
                    z[s] = z.get(s, 0.0) + g - (math.sqrt(n[s]) - math.sqrt(before)) / qm.ALPHA * w[s]
            states.append((z, n))
        for common, k in ((common_z, 0), (common_n, 1)):
            before = dict(common)
            for s in {s for state in states for s in state[k]}:
                common[s] = before.get(s, 0.0) + sum(
                    state[k].get(s, 0.0) - before.get(s, 0.0) for state in states) / qm.SHARDS
    return {s: weight(z, common_n[s]) for s, z in common_z.items()}


def test_weights_and_scores(spark):
    r = random.Random(9)
    good, bad = ["the clear prose of a page", "Reads well, with order"], ["BUY now!!! 99", "click 11 22 22"]
    docs = [(i, " ".join(r.choice(good if i % 3 else bad) for _ in range(r.randrange(1, 6))))
            for i in range(60)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    labels = frame.select("doc_id", (F.col("doc_id") % 3 > 0).cast("int").alias("label"))
    found = qm.train(frame, labels)
    dealt = {x.doc_id: (x.shard, x.place) for x in frame.select(
        "doc_id", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(qm.SHARDS)).alias("shard"),
        F.xxhash64("doc_id", F.lit(5)).alias("place")).collect()}
    hasher = qm.Hasher()
    rows = [(*dealt[i], int(i % 3 > 0), *hasher.vector(t)) for i, t in docs]
    want = plain_training(rows)
    dense = np.zeros(qm.SLOTS + 1)
    dense[list(want)] = list(want.values())
    assert np.allclose(found, dense, atol=1e-9) and np.count_nonzero(dense) > 20
    scores = {x.doc_id: x.score for x in qm.scored(frame, found).collect()}
    for i, text in docs:
        slots, values = hasher.vector(text)
        dot = sum(want.get(int(s), 0.0) * float(v) for s, v in zip(slots, values))
        assert abs(scores[i] - 1 / (1 + math.exp(-dot - want[qm.SLOTS]))) < 1e-6
