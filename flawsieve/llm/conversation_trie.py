"""The prefix trie of conversations: which first turns they share, and what sharing saves.

1. A turn becomes a digest of role and text (128 bits) and its number of bytes before anything is
   shuffled; a conversation is the row of its turns' digests.
2. Conversations are sorted by these rows, in ranges, and then by id, so that many equal ones fill
   several ranges.
3. Each task takes its range in blocks.  Of a block, neighbours are joined by edges of the depth
   that they share, and a union-find takes the edges in descending depth: every merge of
   components makes a branching node.  What a node reports are sums over its members, which stand
   side by side: differences of running sums.
4. Nodes of a block that reach neither its first nor its last conversation are complete.  Those on
   the paths of these two are what the block's forest is contracted to; they are added up by node
   over all blocks, with a correction for each border between two blocks.  So a first turn that a
   third of all conversations have is one row for each block.

Ids at the end of an unfinished node travel as one text for each block, and are hashed in order by
a task that holds one such text at a time.

Cases: rows without a ``conv_id`` belong to no conversation; a null role or text is an empty one; of
turns with the same number (null comes first) the order is by role and digest, and repeated rows are
turns of their own; a conversation without turns ends at the root; extra columns, whatever their
names, play no part; an empty table gives no nodes; texts of any length count whole.  A conversation's
digests, 24 bytes a turn, must fit into a task's memory.
"""

from __future__ import annotations

import hashlib
from itertools import accumulate

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, ready_workers, staged

DIGEST = 16
# Conversations of a block, and bytes of their digests.
BLOCK, BLOCK_BYTES = 16_384, 32 << 20
# Copies of the unfinished nodes among which look-ups of one parent are dealt.
SALTS = 16
CLOSED, OPEN, ENDS, BORDER = range(4)
ROWS = ("kind int, node binary, parent binary, depth long, conv_id long, parent_conv_id long, "
        "n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, "
        "ends string, part int, block int, first_key binary, first_sizes array<long>, "
        "last_key binary")
NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        "ends_sha256")
SUMS = ("n_convs", "n_children", "n_leaves", "saved_tokens")
NO_ENDS = hashlib.sha256(b"").hexdigest()


def conversations_of(turns: DataFrame) -> DataFrame:
    """``(conv_id, turns)``: digest and bytes of each turn, in order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = turns.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct("turn", role.alias("role"), F.unhex(F.left(digest, F.lit(2 * DIGEST))).alias(
            "digest"), F.octet_length(text).cast("long").alias("size")).alias("t"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t")).select(
        "conv_id", F.transform("t", lambda t: F.struct(t["digest"], t["size"])).alias("turns"))


def rebuilt(conversations: DataFrame, family: int = 5, most: int = 8) -> DataFrame:
    """Each conversation c with the first h turns of conversation c - c % ``family`` in the place
    of its own; h is the CRC-32 of c's digits, modulo ``most`` + 1."""
    head = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")),
                  F.lit(most + 1)).cast("int")
    heads = conversations.filter(F.col("conv_id") % family == 0).select(
        F.col("conv_id").alias("base"), F.slice("turns", 1, most).alias("first"))
    joined = conversations.withColumn("base", F.col("conv_id") - F.col("conv_id") % family).join(
        heads, "base", "left").withColumn("h", head)
    own = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return joined.select("conv_id", F.when(F.col("first").isNull(), own).otherwise(
        F.concat(F.slice("first", F.lit(1), F.col("h")), own)).alias("turns"))


def node_id(key: bytes, depth: int) -> bytes:
    return hashlib.sha256(key[:DIGEST * depth]).digest()


def shared_turns(a: bytes, b: bytes) -> int:
    """How many first turns two conversations share."""
    most = min(len(a), len(b))
    if a[:most] == b[:most]:
        return most // DIGEST
    low, high = 0, most // DIGEST  # the first ``low`` are equal, the first ``high`` are not
    while high - low > 1:
        half = (low + high) // 2
        if a[DIGEST * low:DIGEST * half] == b[DIGEST * low:DIGEST * half]:
            low = half
        else:
            high = half
    return low


def border_rows(last: bytes, key: bytes, sizes: list[int]):
    """Corrections where a block that ends with ``last`` meets one that starts with ``key``: their
    common nodes were counted as if nothing stood on the other side."""
    depth, bytes_ = shared_turns(last, key), [0, *accumulate(sizes)]
    for d in range(depth + 1):
        yield {"kind": OPEN, "node": node_id(key, d), "depth": d,
               "parent": node_id(key, d - 1) if d else None, "n_convs": 0,
               "n_children": -int(d < depth), "n_leaves": -int(depth * DIGEST == len(last)),
               "saved_tokens": bytes_[depth] - bytes_[max(d - 1, 0)]}


class Forest:
    """The nodes of one block of sorted conversations.  A node is known by the depth of its lower
    end and the members ``first`` to ``last``; its edge to the parent stands for the nodes with a
    single child between them."""

    def __init__(self, keys: list[bytes], ids: list[int], sizes: list[list[int]]):
        n = len(keys)
        self.keys, self.ids = keys, ids
        self.lengths = [len(k) // DIGEST for k in keys]
        self.bytes = [[0, *accumulate(s)] for s in sizes]
        lcp = [-1, *(shared_turns(a, b) for a, b in zip(keys, keys[1:])), -1]
        self.leaves = [0, *accumulate(int(lcp[i + 1] < self.lengths[i]) for i in range(n))]
        self.shared = [*accumulate(self.bytes[i][lcp[i]] if i else 0 for i in range(n))]
        # A node for the end of each conversation; more come with the merges.
        self.depth, self.alive = list(self.lengths), [True] * n
        self.first, self.last, self.low = list(range(n)), list(range(n)), list(ids)
        self.children, self.parent = [0] * n, [-1] * n
        self.merge(lcp, n)

    def merge(self, lcp: list[int], n: int) -> None:
        up, top = list(range(n)), list(range(n))

        def find(x):
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for i in sorted(range(1, n), key=lambda i: -lcp[i]):  # of one depth from left to right
            a, b, d = find(i - 1), find(i), lcp[i]
            left, right = top[a], top[b]
            node = left
            if self.depth[left] != d:
                node = len(self.depth)
                self.parent[left] = node
                for column, value in ((self.depth, d), (self.first, self.first[left]),
                                      (self.last, self.last[left]), (self.low, self.low[left]),
                                      (self.children, 1), (self.parent, -1),
                                      (self.alive, True)):
                    column.append(value)
            if self.depth[right] == d:  # a conversation that ends here, too
                self.alive[right] = False
            else:
                self.parent[right] = node
                self.children[node] += 1
            self.last[node] = self.last[right]
            self.low[node] = min(self.low[node], self.low[right])
            up[b], top[a] = a, node

    def rows(self, part: int, block: int):
        end = len(self.keys) - 1
        for v, alive in enumerate(self.alive):
            if not alive:
                continue
            first, last, lowest, above = (self.first[v], self.last[v], self.depth[v],
                                          self.parent[v])
            key, bytes_ = self.keys[first], self.bytes[first]
            above_depth = self.depth[above] if above >= 0 else -1
            open_ = first == 0 or last == end
            ends = []
            for i in range(first, last + 1):
                if self.lengths[i] != lowest:
                    break
                ends.append(str(self.ids[i]))
            for d in range(above_depth + 1, lowest + 1):
                row = {"kind": CLOSED, "depth": d, "conv_id": self.low[v],
                       "n_convs": last - first + 1,
                       "n_children": self.children[v] if d == lowest else 1,
                       "n_leaves": self.leaves[last + 1] - self.leaves[first],
                       "saved_tokens": self.shared[last] - self.shared[first]
                       - (last - first) * bytes_[max(d - 1, 0)]}
                if open_:
                    row |= {"kind": OPEN, "node": node_id(key, d),
                            "parent": node_id(key, d - 1) if d else None}
                else:
                    row["ends_sha256"] = hashlib.sha256(
                        ",".join(ends).encode() if d == lowest else b"").hexdigest()
                    if d > above_depth + 1:
                        row["parent_conv_id"] = self.low[v]
                    elif self.first[above] == 0 or self.last[above] == end:
                        row["parent"] = node_id(key, d - 1)
                    else:
                        row["parent_conv_id"] = self.low[above]
                yield row
            if open_ and ends:
                yield {"kind": ENDS, "node": node_id(key, lowest), "part": part, "block": block,
                       "ends": ",".join(ends)}


def _written(rows, schema):
    batch = []
    for row in rows:
        batch.append(row)
        if len(batch) >= 4096:
            yield pa.RecordBatch.from_pylist(batch, schema=schema)
            batch = []
    if batch:
        yield pa.RecordBatch.from_pylist(batch, schema=schema)


def forests(conversations: DataFrame) -> DataFrame:
    """``ROWS`` of all blocks: complete nodes, parts of unfinished ones, ids at their ends, and the
    first and the last conversation of each range."""
    schema = arrow_schema(ROWS)
    ordered = conversations.select(
        F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), "")).alias("key"),
        "conv_id", F.transform("turns", lambda t: t["size"]).alias("sizes"))
    ordered = ordered.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")

    def run(batches):
        part = TaskContext.get().partitionId()

        def rows():
            keys, ids, sizes, held, block = [], [], [], 0, 0
            first = last = None

            def done():
                nonlocal last
                if last is not None:
                    yield from border_rows(last, keys[0], sizes[0])
                yield from Forest(keys, ids, sizes).rows(part, block)
                last = keys[-1]

            for batch in batches:
                for row in batch.to_pylist():
                    if first is None:
                        first = row
                    keys.append(row["key"])
                    ids.append(row["conv_id"])
                    sizes.append(row["sizes"])
                    held += len(row["key"])
                    if len(keys) >= BLOCK or held >= BLOCK_BYTES:
                        yield from done()
                        keys, ids, sizes, held, block = [], [], [], 0, block + 1
            if keys:
                yield from done()
            if first is not None:
                yield {"kind": BORDER, "part": part, "first_key": first["key"],
                       "first_sizes": first["sizes"], "last_key": last}

        return _written(rows(), schema)

    return ordered.mapInArrow(run, ROWS)


def _borders(rows: DataFrame) -> DataFrame:
    """Corrections between ranges: one row for each of them takes part."""
    schema = arrow_schema(ROWS)
    pairs = rows.filter(F.col("kind") == BORDER).select(
        "first_key", "first_sizes",
        F.lag("last_key").over(Window.orderBy("part")).alias("before")).filter("before is not null")

    def run(batches):
        return _written((r for batch in batches for row in batch.to_pylist() for r in border_rows(
            row["before"], row["first_key"], row["first_sizes"])), schema)

    return pairs.mapInArrow(run, ROWS)


def _ends(rows: DataFrame) -> DataFrame:
    """``(node, hashed)``: digest of the ids at the end of each unfinished node.  They come in the
    order of ranges and blocks, and so of ids."""
    texts = rows.filter(F.col("kind") == ENDS).select("node", "part", "block", "ends").repartition(
        "node").sortWithinPartitions("node", "part", "block")
    schema = arrow_schema("node binary, hashed string")

    def run(batches):
        def hashes():
            node = state = None
            for batch in batches:
                for n, ends in zip(batch.column("node"), batch.column("ends")):
                    if n.as_py() != node:
                        if node is not None:
                            yield {"node": node, "hashed": state.hexdigest()}
                        node, state = n.as_py(), hashlib.sha256(ends.as_py().encode())
                    else:
                        state.update(b"," + ends.as_py().encode())
            if node is not None:
                yield {"node": node, "hashed": state.hexdigest()}

        return _written(hashes(), schema)

    return texts.mapInArrow(run, "node binary, hashed string")


def trie(conversations: DataFrame) -> DataFrame:
    """``NODE`` columns for each node of the trie of ``(conv_id, turns)``; ``conv_id`` is the
    smallest member's."""
    ready_workers(conversations.sparkSession)
    rows = staged(forests(conversations))
    parts = rows.filter(F.col("kind") == OPEN).unionByName(_borders(rows))
    merged = parts.groupBy("node").agg(
        F.first("parent").alias("parent"), F.first("depth").alias("depth"),
        F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in SUMS])
    merged = staged(merged.join(_ends(rows), "node", "left").withColumn(
        "ends_sha256", F.coalesce("hashed", F.lit(NO_ENDS))).drop("hashed"))
    closed = rows.filter(F.col("kind") == CLOSED)
    whole = closed.filter("parent is null").select(*NODE)
    salt: Column = F.pmod("conv_id", F.lit(SALTS)).cast("int")
    above = merged.select(
        F.col("node").alias("parent"), F.col("conv_id").alias("above"),
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    below = closed.filter("parent is not null").select("parent", *NODE).unionByName(
        merged.select("parent", F.lit(None).cast("long").alias("parent_conv_id"),
                      *[c for c in NODE if c != "parent_conv_id"]))
    looked_up = below.withColumn("salt", salt).join(above, ["parent", "salt"], "left").withColumn(
        "parent_conv_id", F.col("above"))
    return whole.unionByName(looked_up.select(*NODE))


_BITS = ("flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), "
         "lambda ch: list_transform(range(8), lambda i: CAST((ascii(ch) >> CAST(i AS INTEGER)) & 1 "
         "AS BIGINT))))")
ORACLE_SQL = f"""
WITH t AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, {{'role': coalesce(role, ''), 'text':
         coalesce(text, '')}} AS turn, row_number() OVER (PARTITION BY conv_id
         ORDER BY turn NULLS FIRST, role, text) AS p
  FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT conv_id, list(turn ORDER BY p) AS turns FROM t GROUP BY conv_id),
h AS (SELECT *, CAST(xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], {_BITS}),
         lambda c, b: xor(c >> 1, CASE WHEN (xor(c, b) & 1) = 1 THEN 3988292384 ELSE 0 END))) % 9
         AS INTEGER) AS h FROM s),
r AS (SELECT h.conv_id, list_concat(coalesce(b.turns[1:h.h], []), h.turns[h.h + 1:]) AS turns
      FROM h LEFT JOIN s b ON b.conv_id = h.conv_id - h.conv_id % 5),
m AS (SELECT conv_id, len(turns) AS n, d, turns[1:d] AS key
      FROM (SELECT *, unnest(range(len(turns) + 1)) AS d FROM r)),
v AS (SELECT key, d, min(conv_id) AS conv_id, count(*) AS n_convs, max(n) = d AS leaf,
             sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)
                             FILTER (n = d), '')) AS ends_sha256,
             CASE WHEN d > 0 THEN (count(*) - 1) * strlen(key[d].text) ELSE 0 END AS saved
      FROM m GROUP BY key, d),
c AS (SELECT key[1:d - 1] AS key, count(*) AS n FROM v WHERE d > 0 GROUP BY 1),
u AS (SELECT key[1:a] AS key, count(*) FILTER (leaf) AS n_leaves, sum(saved) AS saved_tokens
      FROM (SELECT *, unnest(range(d + 1)) AS a FROM v) GROUP BY 1)
SELECT v.conv_id, v.d AS depth, p.conv_id AS parent_conv_id, v.n_convs,
       coalesce(c.n, 0) AS n_children, u.n_leaves, CAST(u.saved_tokens AS BIGINT) AS saved_tokens,
       v.ends_sha256
FROM v JOIN u ON u.key = v.key LEFT JOIN c ON c.key = v.key
LEFT JOIN v p ON v.d > 0 AND p.d = v.d - 1 AND p.key = v.key[1:v.d - 1]
"""
