"""Links between documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or
more, by MinHash banding.

Words are runs of characters other than white space, in lower case; a text of fewer than five
words has one shingle.  Documents with the same words are copies: they share one key, and the
join works on keys.

There is a number of trees; a key has a sequence of MinHashes in each, and a node of a tree is the
keys that agree in all of it.  How long it is follows from the parameters, not from the data: the
longest with which the expected recall of a pair at the threshold reaches the target.  That is
ordinary banding, not an adaptive forest.  Keys that share a node in any tree are compared exactly; a
pair that shares none is missed, at the threshold once in ten thousand pairs or less and more
rarely above it.

* Small nodes (up to ``SMALL`` keys) are written out as pairs, so a key gets a bounded number of
  pairs from each tree.  A pair from several trees is compared once.
* The keys of a large node are dealt to blocks, and each pair of blocks is compared in one task
  by products of incidence matrices, which returns counts and a spanning forest instead of
  pairs.  A pair in several large nodes counts in the first of them only.

Classes are the connected components of the links, found by passing on the smallest label and
jumping along labels; each round is written to the shared folder.

Cases: null and empty texts have no shingles, are copies of each other and linked with nothing
else; a null ``doc_id`` is a document like others, and is the class id only if no other is in
the class; repeated rows are copies; extra columns, whatever their names, play no part; an empty
table gives an empty table; a long text has many shingles and is compared whole.
"""

from __future__ import annotations

import re
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACES, ready_workers, shared_folder, staged
from .exact_dedup import located, on_files

SHINGLE, SIMILARITY = 5, 0.8
TREES, LONGEST_PREFIX, TARGET_RECALL = 32, 12, 0.9999
SMALL, BLOCK = 32, 256
# Columns of an incidence matrix that are multiplied at a time.
WIDTH = 4096


def prefix_length(trees: int = TREES, longest: int = LONGEST_PREFIX,
                  similarity: float = SIMILARITY, target: float = TARGET_RECALL) -> int:
    """The longest prefix whose expected recall at the threshold reaches the target."""
    for length in range(longest, 1, -1):
        if 1 - (1 - similarity ** length) ** trees >= target:
            return length
    return 1


# ---------------------------------------------------------------- shingles and labels

def plain_words(text: Column) -> Column:
    """The words in lower case, one space between them."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))),
                                   f"{SPACES}+", " "))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class _Hashes(dict):
    """Hashes of words, of which a worker remembers a bounded number."""

    def __missing__(self, word: str) -> int:
        from xxhash import xxh64_intdigest

        if len(self) > 400_000:
            self.clear()
        found = self[word] = xxh64_intdigest(word)
        return found


_HASHES = _Hashes()


def word_hashes(plain: str) -> np.ndarray:
    words = plain.split(" ") if plain else []
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def shingles(plain: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    h = word_hashes(plain)
    n = min(SHINGLE, len(h))
    out = np.zeros(len(h) - n + 1 if n else 0, dtype=np.uint64)
    for i in range(n):
        out = _mixed(out + h[i:len(h) - n + 1 + i])
    return np.unique(out)


def permutations(trees: int, prefix: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20250101)
    return (rng.integers(0, 2**64, trees * prefix, dtype=np.uint64) | np.uint64(1),
            rng.integers(0, 2**64, trees * prefix, dtype=np.uint64))


def node_labels(sets: list[np.ndarray], trees: int, prefix: int) -> np.ndarray:
    """The node of each set (none empty) in each tree, as a 64-bit hash of tree and prefix."""
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    joined = np.concatenate(sets)
    factors, shifts = permutations(trees, prefix)
    nodes = np.empty((len(sets), trees), dtype=np.uint64)
    for tree in range(trees):
        node = np.full(len(sets), tree + 1, dtype=np.uint64)
        for i in range(tree * prefix, (tree + 1) * prefix):
            node = _mixed(node + np.minimum.reduceat(joined * factors[i] + shifts[i], starts))
        nodes[:, tree] = node
    return nodes


def _labelled(texts: DataFrame, trees: int, prefix: int) -> DataFrame:
    """``(doc_id, file, number, key, nodes)`` of ``(doc_id, file, number, key, plain)``."""
    schema = texts.drop("plain").schema.add("nodes", T.ArrayType(T.LongType()))
    names = schema.names[:-1]

    def run(batches):
        for batch in batches:
            column, at = batch.column("plain"), 0
            while at < batch.num_rows:
                sets, size, end = [], 0, at
                while end < batch.num_rows and size < 200_000:
                    sets.append(shingles(column[end].as_py()))
                    size += len(sets[-1])
                    end += 1
                full = [i for i, s in enumerate(sets) if len(s)]
                nodes: list = [[] for _ in sets]
                if full:
                    labels = node_labels([sets[i] for i in full], trees, prefix)
                    for i, row in zip(full, labels.view(np.int64)):
                        nodes[i] = row
                part = batch.slice(at, end - at)
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(n) for n in names],
                     pa.array(nodes, pa.list_(pa.int64()))], schema.names)
                at = end

    return texts.mapInArrow(run, schema)


# ---------------------------------------------------------------- exact comparison

def _linked(common, a, b, similarity: Fraction):
    """Whether common / (a + b - common) reaches the similarity, in whole numbers."""
    return common * (similarity.denominator + similarity.numerator) >= \
        similarity.numerator * (a + b)


def _compared(pairs: DataFrame, similarity: Fraction) -> DataFrame:
    """Of ``(a, b, text_a, text_b, n_a, n_b)`` those that are linked, without the texts."""

    def run(batches):
        for batch in batches:
            keep, of, last = [], None, None
            left, right = batch.column("text_a"), batch.column("text_b")
            for i in range(batch.num_rows):
                text = left[i].as_py()
                if text != last:
                    last, of = text, shingles(text)
                other = shingles(right[i].as_py())
                common = len(np.intersect1d(of, other, assume_unique=True))
                keep.append(bool(_linked(common, len(of), len(other), similarity)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in ("a", "b", "n_a", "n_b")],
                ["a", "b", "n_a", "n_b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.mapInArrow(run, pairs.select("a", "b", "n_a", "n_b").schema)


def products(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many elements each set on the left shares with each on the right, by products of
    incidence matrices over the elements that both sides have, ``WIDTH`` of them at a time."""
    common = np.zeros((len(left), len(right)), dtype=np.int64)
    if not len(left) or not len(right):
        return common
    shared = np.intersect1d(np.concatenate(left), np.concatenate(right))

    def places(sets):
        at = [np.searchsorted(shared, s) for s in sets]
        at = [p[(p < len(shared)) & (shared[np.minimum(p, len(shared) - 1)] == s)]
              for p, s in zip(at, sets)] if len(shared) else [p[:0] for p in at]
        rows = np.repeat(np.arange(len(sets)), [len(p) for p in at])
        return rows, np.concatenate(at)

    (rows_l, cols_l), (rows_r, cols_r) = places(left), places(right)
    for start in range(0, len(shared), WIDTH):
        x = np.zeros((len(left), WIDTH), dtype=np.float32)
        y = np.zeros((len(right), WIDTH), dtype=np.float32)
        for m, rows, cols in ((x, rows_l, cols_l), (y, rows_r, cols_r)):
            inside = (cols >= start) & (cols < start + WIDTH)
            m[rows[inside], cols[inside] - start] = 1
        common += (x @ y.T).astype(np.int64)
    return common


def spanning(edges: np.ndarray, n: int) -> list[tuple[int, int]]:
    """A forest with the components of the edges among n points."""
    parent, forest = list(range(n)), []

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges.tolist():
        if (x := root(a)) != (y := root(b)):
            parent[x] = y
            forest.append((a, b))
    return forest


def _blocks(members: DataFrame, similarity: Fraction) -> DataFrame:
    """Counts and links of large nodes.  ``members``: ``(node, i, j, block, key, plain, n,
    large)``, for each pair of blocks the rows of both, with all large nodes of each key.  Rows
    out: ``(a, links, b)``, where a null ``b`` stands for a count and null links for a link."""

    def run(group: pa.Table) -> pa.Table:
        i = group.column("i")[0].as_py()
        node, same = group.column("node")[0].as_py(), i == group.column("j")[0].as_py()
        blocks = group.column("block").to_numpy()
        left = np.flatnonzero(blocks == i)
        right = left if same else np.flatnonzero(blocks != i)
        keys, n = group.column("key").to_pylist(), group.column("n").to_numpy()
        sets = [shingles(t.as_py()) for t in group.column("plain")]
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        earlier = [np.array(sorted(x for x in large if x < node), dtype=np.int64)
                   for large in group.column("large").to_pylist()]
        common = products([sets[x] for x in left], [sets[x] for x in right])
        linked = _linked(common, sizes[left][:, None], sizes[right][None, :], similarity)
        linked &= products([earlier[x] for x in left], [earlier[x] for x in right]) == 0
        if same:
            np.fill_diagonal(linked, False)
        counts = np.zeros(len(keys), dtype=np.int64)
        counts[left] += linked @ n[right]
        if not same:
            counts[right] += n[left] @ linked
        a, b = np.nonzero(linked)
        forest = spanning(np.column_stack([left[a], right[b]]), len(keys))
        some = np.flatnonzero(counts)
        return pa.table({
            "a": pa.array([keys[x] for x in some] + [keys[x] for x, _ in forest], pa.binary()),
            "links": pa.array(counts[some].tolist() + [None] * len(forest), pa.int64()),
            "b": pa.array([None] * len(some) + [keys[y] for _, y in forest], pa.binary())})

    return members.groupBy("node", "i", "j").applyInArrow(run, "a binary, links long, b binary")


# ---------------------------------------------------------------- the join

class Join:
    """``members``: ``(doc_id, file, number, key, class_key)`` of each row; ``counts``: ``(key,
    links)`` for keys that have any; ``copies``: ``(key, n)``."""

    def __init__(self, docs: DataFrame, similarity: float = SIMILARITY, trees: int = TREES,
                 target: float = TARGET_RECALL):
        spark = docs.sparkSession
        ready_workers(spark)
        exact = Fraction(str(similarity))
        folder = shared_folder(spark)
        rows = located(docs)
        texts = rows.select("held.doc_id", "file", "number",
                            plain_words(F.col("held.text")).alias("plain")).withColumn(
            "key", F.unhex(F.md5("plain")))
        labels = staged(_labelled(texts, trees, prefix_length(trees, similarity=similarity,
                                                              target=target)),
                        f"{folder}/labels")
        self.copies = labels.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        keys = labels.groupBy("key").agg(F.first("nodes").alias("nodes"),
                                         F.count(F.lit(1)).alias("n"))
        places = keys.select("key", F.explode("nodes").alias("node"))
        sizes = places.groupBy("node").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
        nodes = staged(places.join(sizes, "node"), f"{folder}/nodes")
        asked = nodes.select("key").distinct()
        # The text of each key that is compared, once.
        known = staged(texts.join(asked, "key", "left_semi").groupBy("key").agg(
            F.first("plain").alias("plain"), F.count(F.lit(1)).alias("n")), f"{folder}/texts")
        large = nodes.filter(F.col("size") > SMALL).groupBy("key").agg(
            F.sort_array(F.collect_list("node")).alias("large"))
        close = staged(_compared(self._pairs(nodes, large, known), exact), f"{folder}/close")
        dense = staged(_blocks(self._members(nodes, large, known), exact), f"{folder}/dense")
        self.counts = dense.filter("links is not null").select("a", "links").unionAll(
            close.select("a", F.col("n_b").alias("links"))).unionAll(
            close.select(F.col("b").alias("a"), F.col("n_a").alias("links"))).groupBy(
            F.col("a").alias("key")).agg(F.sum("links").alias("links"))
        edges = close.select("a", "b").unionAll(dense.filter("b is not null").select("a", "b"))
        classes = components(edges, f"{folder}/classes")
        self.members = labels.drop("nodes").join(classes, "key", "left").withColumn(
            "class_key", F.coalesce("label", "key")).drop("label")

    @staticmethod
    def _pairs(nodes: DataFrame, large: DataFrame, known: DataFrame) -> DataFrame:
        """Each pair of keys in a small node, once, unless a large node has both."""
        groups = nodes.filter(F.col("size") <= SMALL).groupBy("node").agg(
            F.sort_array(F.collect_list("key")).alias("keys")).select("keys").distinct()
        pairs = groups.select(F.posexplode("keys").alias("at", "a"), "keys").select(
            "a", F.explode(F.slice("keys", F.col("at") + 2, SMALL)).alias("b")).distinct()

        def side(name: str, frame: DataFrame, *columns: str) -> DataFrame:
            return frame.select(F.col("key").alias(name), *[
                F.col(c).alias(f"{c}_{name}") for c in columns])

        apart = pairs.join(side("a", large, "large"), "a", "left").join(
            side("b", large, "large"), "b", "left").filter(
            ~F.coalesce(F.arrays_overlap("large_a", "large_b"), F.lit(False))).select("a", "b")
        return apart.join(side("b", known.withColumnRenamed("plain", "text"), "text", "n"),
                          "b").join(
            side("a", known.withColumnRenamed("plain", "text"), "text", "n"), "a").select(
            "a", "b", "text_a", "text_b", "n_a", "n_b")

    @staticmethod
    def _members(nodes: DataFrame, large: DataFrame, known: DataFrame) -> DataFrame:
        blocks = F.ceil(F.col("size") / BLOCK).cast("int")
        dealt = nodes.filter(F.col("size") > SMALL).withColumn(
            "block", F.pmod(F.xxhash64("key"), blocks).cast("int")).withColumn(
            "other", F.explode(F.sequence(F.lit(0), blocks - 1))).select(
            "node", F.least("block", "other").alias("i"),
            F.greatest("block", "other").alias("j"), "block", "key")
        return dealt.join(large, "key").join(known, "key")


def components(edges: DataFrame, folder: str) -> DataFrame:
    """``(key, label)``: for each key of an edge one key that its whole component shares.

    In each round every key goes to the smallest key among itself and its neighbours, and the
    edges are drawn anew between these, without those that have become loops, so only the first
    round has all edges.  Keys are digests, so their order is random, and a round shrinks chains
    as well."""
    edges = staged(edges.filter("a <> b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
        f"{folder}/edges")
    labels, number = None, 0
    while labels is None or not edges.isEmpty():
        number += 1
        ends = edges.select(F.col("a").alias("key"), F.col("b").alias("other")).unionAll(
            edges.select(F.col("b").alias("key"), F.col("a").alias("other")))
        step = staged(ends.groupBy("key").agg(F.min("other").alias("other")).select(
            "key", F.least("key", "other").alias("label")), f"{folder}/step-{number}")
        edges = staged(
            edges.join(step.select(F.col("key").alias("a"), F.col("label").alias("x")), "a")
            .join(step.select(F.col("key").alias("b"), F.col("label").alias("y")), "b")
            .filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
            .distinct(), f"{folder}/edges-{number}")
        if labels is None:
            labels = step
        else:
            labels = staged(labels.join(
                step.select(F.col("key").alias("label"), F.col("label").alias("next")),
                "label", "left").select("key", F.coalesce("next", "label").alias("label")),
                f"{folder}/labels-{number}")
    return labels


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``(doc_id, class_id, n_links, n_copies)`` for each row: the smallest ``doc_id`` of its
    class, the number of other documents that are linked with it, copies among them, and how
    many of those are copies."""
    join = Join(docs, similarity)
    ids = join.members.groupBy("class_key").agg(F.min("doc_id").alias("class_id"))
    return join.members.join(ids, "class_key").join(join.copies, "key").join(
        join.counts, "key", "left").select(
        "doc_id", "class_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        (F.col("n") - 1).alias("n_copies"))


def one_of_each_class(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows with the smallest ``doc_id`` of each class, one for each, with all columns."""
    docs = on_files(docs)
    rows = located(docs)
    best = Join(docs, similarity).members.groupBy("class_key").agg(F.min(F.struct(
        F.col("doc_id").isNull(), "doc_id", "file", "number")).alias("best"))
    return rows.join(best.select("best.file", "best.number"), ["file", "number"],
                     "left_semi").select("held.*")


def jaccard(a: str, b: str) -> float:
    """For tests and small uses: the similarity of two texts."""
    words = [re.sub(r"[\x20\x09-\x0D]+", " ", t.lower()).strip(" ") for t in (a, b)]
    x, y = map(shingles, words)
    common = len(np.intersect1d(x, y))
    return common / (len(x) + len(y) - common) if len(x) + len(y) else 0.0
