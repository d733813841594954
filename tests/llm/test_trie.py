"""The conversation trie against plain Python loops."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from flawsieve.llm import conversation_trie as ct

SCHEMA = ("conv_id long, turn int, role string, text string, key string, node int, h string, "
          "base int, sizes string, part string, t string, size string, turns string")


def table(spark, rows):
    return spark.createDataFrame([(*r, *(["x", 7, "x", 7, *["x"] * 5] if n % 2 else [None] * 9))
                                  for n, r in enumerate(rows)], SCHEMA)


def brute(rows, change=True):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    full = {}
    for c, ts in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        full[c] = turns.get(c - c % 5, [])[:h] + ts[h:] if change else ts
    members = defaultdict(list)
    for c, ts in full.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)

    def below(key):
        return [k for k in members if k[:len(key)] == key]

    out = Counter()
    for key, who in members.items():
        sub = below(key)
        leaves = [k for k in sub if not any(len(o) == len(k) + 1 for o in sub
                                            if o[:len(k)] == k)]
        ends = sorted(c for c in who if len(full[c]) == len(key))
        out[(min(who), len(key), min(members[key[:-1]]) if key else None, len(who),
             sum(len(k) == len(key) + 1 for k in sub), len(leaves),
             sum((len(members[k]) - 1) * len(k[-1][1].encode()) for k in sub if k),
             hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest())] += 1
    return out


def found(nodes):
    assert sorted(nodes.columns) == sorted(ct.NODE)
    assert {t for c, t in nodes.dtypes} == {"bigint", "string"}
    return Counter(tuple(r) for r in nodes.select(*ct.NODE).collect())


def odd_rows():
    r = random.Random(3)
    rows = [(1, 0, "user", "a"), (1, 1, None, None), (2, None, "user", "first"), (2, 0, "x", "é"),
            (5, 1, "user", "a"), (5, 1, "user", "a"), (None, 0, "user", "nobody"),
            (10, 0, "a", "bc"), (11, 0, "ab", "c"), (12, 0, "user", "z" * 50_000)]
    for c in range(20, 140):
        rows += [(c, t, r.choice(["user", "bot"]) if r.random() < .2 else "user",
                  r.choice(["hello", "", "how are you"])) for t in range(r.randrange(1, 12))]
    for c in range(200, 260):  # many equal ones
        rows += [(c, t, "user", f"same {t}") for t in range(10)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("block, parts", [(2, 5), (7, 3), (16_384, 1)])
def test_rebuilt(spark, monkeypatch, block, parts):
    monkeypatch.setattr(ct, "BLOCK", block)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        rows = odd_rows()
        nodes = ct.trie(ct.rebuilt(ct.conversations_of(table(spark, rows))))
        assert found(nodes) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_as_they_are(spark, monkeypatch):
    monkeypatch.setattr(ct, "BLOCK", 5)
    rows = odd_rows()
    assert found(ct.trie(ct.conversations_of(table(spark, rows)))) == brute(rows, change=False)


def test_nothing_and_turnless(spark):
    none = ct.conversations_of(table(spark, []))
    assert ct.trie(ct.rebuilt(none)).count() == 0
    nobody = ct.conversations_of(table(spark, [(None, 0, "user", "a")]))
    assert ct.trie(nobody).count() == 0
    # A family's head may have no turns to give, and c's own may all be replaced.
    empty = spark.range(3).select(F.col("id").alias("conv_id"), F.array().cast(
        "array<struct<digest:binary,size:bigint>>").alias("turns"))
    row, = ct.trie(empty).collect()
    assert (row.conv_id, row.depth, row.parent_conv_id, row.n_convs, row.n_children, row.n_leaves,
            row.saved_tokens, row.ends_sha256) == (
        0, 0, None, 3, 0, 1, 0, hashlib.sha256(b"0,1,2").hexdigest())


def test_shared_turns():
    r = random.Random(5)
    for _ in range(500):
        a, b = (bytes(r.randrange(2) for _ in range(r.randrange(9)) for _ in range(1))
                for _ in range(2))
        wide = [b"".join(bytes([x]) * ct.DIGEST for x in v) for v in (a, b)]
        same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert ct.shared_turns(*wide) == same
