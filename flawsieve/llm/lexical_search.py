"""Ranked search for the documents that share weighty terms with an item.

The index is a set of shards.  A task makes them of the documents that it reads, so texts are not
shuffled and no term or source becomes hot.  A shard is a K2-treap over the grid of its terms (rows)
and documents (columns, by id): a quadtree whose empty quadrants are left out, in which each cell
knows the largest impact below it.  A cell's children are found by counting the bits before its own,
and maxima are kept as the drop from the parent's.

To search a shard, the rows of all terms of an item descend together.  A state is a range of
documents with the cell of each row; the sum of weighted maxima bounds the score of any document in
it.  States are taken best first, a few at a time, until none can reach the items found so far.
At the bottom a range is one document and its bound is its score, so results are exact.  A task
searches its shards one after the other and goes on from the threshold that it has reached; it
hands on at most ``most`` documents for each item.

Items are taken in blocks, each with a bounded number of terms, against all shards.

Cases: a null or empty text has no terms; equal scores rank by ascending ``doc_id``, null last;
repeated documents are ranked each; items of one ``item_id`` (null is one, too) are one item with the
terms of all; an item without terms, or whose terms no document has, gives no row; extra columns,
whatever their names, play no part; no documents or no items give no rows; a text of any length is
indexed whole.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import arrow_schema, ready_workers, shared_folder, staged

# Separators between terms: the ASCII characters that are neither letters nor digits.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PLAIN = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()
# Cells of a shard; pairs of item and term in a block; states that descend at once.
CELLS, BLOCK_TERMS, AT_ONCE = 400_000, 200_000, 128
MOST = 50
_ONES = np.array([bin(i).count("1") for i in range(16)], np.int8)
# For a mask and a quadrant: how many of the cell's children come before it, -1 if it is empty.
_BEFORE = np.array([[bin(m & ((1 << q) - 1)).count("1") if m >> q & 1 else -1 for q in range(4)]
                    for m in range(16)], np.int32).ravel()


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_PLAIN).split()


def packed(data: np.ndarray) -> bytes:
    """Compressed, behind the size: most drops are small or none."""
    raw = data.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def _spread(x: np.ndarray) -> np.ndarray:
    """Bits of 32-bit numbers at the even places of 64."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F),
                        (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(mask)
    return x


class Treap:
    """Cells in breadth-first order.  ``masks`` has four bits for each inner cell, ``first`` its
    first child, ``top`` the largest impact in each cell."""

    def __init__(self, height: int, masks: np.ndarray, top: np.ndarray):
        # One more cell, without children or impact, stands for all empty ones.
        self.height, self.empty = height, len(top)
        self.top = np.append(top, np.int32(0))
        ones = np.cumsum(_ONES[masks], dtype=np.int32)
        self.first = np.zeros(len(top) + 1, np.int32)
        self.first[:len(masks)] = 1 + ones - _ONES[masks]
        self.masks = np.zeros(len(top) + 1, np.uint8)
        self.masks[:len(masks)] = masks

    @staticmethod
    def packed(rows: np.ndarray, columns: np.ndarray, impacts: np.ndarray) -> dict:
        """The grid's columns of an index row, from its cells."""
        height = max(1, int(max(rows.max(), columns.max())).bit_length())
        code = (_spread(rows) << np.uint64(1)) | _spread(columns)
        order = np.argsort(code)
        code, top, masks, drops = code[order], impacts[order].astype(np.int32), [], []
        for _ in range(height):
            above = code >> np.uint64(2)
            starts = np.concatenate([[True], above[1:] != above[:-1]])
            at = np.flatnonzero(starts)
            best = np.maximum.reduceat(top, at)
            masks.append(np.bitwise_or.reduceat(
                np.left_shift(1, (code & np.uint64(3)).astype(np.int8)), at).astype(np.uint8))
            drops.append(best[np.cumsum(starts) - 1] - top)
            code, top = above[at], best
        return {"height": height, "root": int(top[0]),
                "masks": packed(np.concatenate(masks[::-1])),
                "drops": packed(np.concatenate(drops[::-1]).astype("<i4"))}

    @classmethod
    def of(cls, row: dict) -> Treap:
        masks = np.frombuffer(unpacked(row["masks"]), np.uint8)
        drops = np.frombuffer(unpacked(row["drops"]), "<i4")
        top, level, begin, at = [np.array([row["root"]], np.int32)], 1, 0, 0
        for _ in range(row["height"]):
            ones = _ONES[masks[begin:begin + level]]
            below = int(ones.sum())
            top.append(np.repeat(top[-1], ones) - drops[at:at + below])
            begin, at, level = begin + level, at + below, below
        return cls(row["height"], masks, np.concatenate(top))

    def search(self, rows: np.ndarray, weights: np.ndarray, found: Best) -> None:
        """Offers documents by their number, until no other can be among the best."""
        right = 2 * ((rows[None, :] >> np.arange(self.height - 1, -1, -1)[:, None]) & 1)
        right = right.astype(np.uint8)
        level, at = np.zeros(1, np.int64), np.zeros(1, np.int64)
        cells = np.zeros((1, len(rows)), np.int32)
        weights = weights.astype(np.float64)  # sums are whole numbers far below 2 ** 53
        bound = np.array([self.top[0] * weights.sum()])
        while len(bound):
            best = np.arange(len(bound)) if len(bound) <= AT_ONCE else np.argpartition(
                bound, -AT_ONCE)[-AT_ONCE:]
            rest = np.ones(len(bound), bool)
            rest[best] = False
            here, of = cells[best], level[best]
            first, quadrant = self.first[here], self.masks[here] * 4 + right[of]
            parts = []
            for half in (0, 1):
                before = _BEFORE[quadrant + half]
                child = first + before
                child[before < 0] = self.empty
                parts.append((of + 1, 2 * at[best] + half, child,
                              self.top[child].astype(np.float64) @ weights))
            new = [np.concatenate(x) for x in zip(*parts)]
            good = new[3] >= found.least
            done = good & (new[0] == self.height)
            if done.any():
                found.offer(new[1][done], new[3][done])
                good &= ~done
            rest &= bound >= found.least
            level, at, cells, bound = (np.concatenate([old[rest], x[good]]) for old, x in zip(
                (level, at, cells, bound), new))


class Best:
    """The best documents of an item so far, and the least score that can still join them."""

    def __init__(self, most: int):
        self.most, self.rows, self.least, self.names = most, [], 1, None

    def offer(self, numbers: np.ndarray, scores: np.ndarray) -> None:
        good = scores >= self.least
        if not good.any():
            return
        numbers, scores = numbers[good], scores[good]
        order = np.lexsort((numbers, -scores))[:self.most]  # names ascend with the numbers
        names = self.names.take(pa.array(numbers[order])).to_pylist()
        self.rows += [(-int(s), n is None, n) for s, n in zip(scores[order], names)]
        self.rows = sorted(self.rows, key=lambda r: r[:2] if r[1] else r)[:self.most]
        if len(self.rows) == self.most:
            self.least = -self.rows[-1][0]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).cast(
        "binary").alias("text"))


def totals(docs: DataFrame) -> tuple[int, int]:
    """Documents that have a term, and terms of all documents."""
    ready_workers(docs.sparkSession)
    schema = arrow_schema("n long, terms long")

    def run(batches):
        for batch in batches:
            sizes = [len(terms_of(t.as_py())) for t in batch.column("text")]
            yield pa.RecordBatch.from_pylist(
                [{"n": sum(s > 0 for s in sizes), "terms": sum(sizes)}], schema=schema)

    n, terms = _texts(docs).select("text").mapInArrow(run, "n long, terms long").agg(
        F.sum("n"), F.sum("terms")).first()
    return n or 0, terms or 0


def index(docs: DataFrame, n: int, terms: int) -> DataFrame:
    """The shards: ``(names, terms, counts, height, root, masks, drops)``.  ``names`` are the ids of
    a shard's documents in order, ``counts`` how many of them have each term."""
    rows = _texts(docs)
    ready_workers(docs.sparkSession)
    schema = T.StructType([T.StructField("names", T.ArrayType(rows.schema["doc_id"].dataType)),
                           *T.StructType.fromDDL("terms binary, counts binary, height int, "
                                                 "root int, masks binary, drops binary").fields])
    arrow = to_arrow_schema(schema)

    def run(batches):
        names, numbers, cells, times, known, size = [], [], [], [], _numbers(), 0

        def shard():
            order = pc.sort_indices(pa.chunked_array(names), null_placement="at_end")
            place = np.empty(len(order), np.int64)
            place[np.asarray(order)] = np.arange(len(order))
            columns = np.repeat(place, [len(c) for c in cells])
            row_of, tf = np.concatenate(cells), np.concatenate(times).astype(np.int64)
            m = 50 + 50 * np.concatenate(numbers) * n // max(terms, 1)
            m = np.repeat(m, [len(c) for c in cells])
            grid = Treap.packed(row_of, columns, 1_000_000_000 * tf // (1000 * tf + 20 * m))
            return pa.RecordBatch.from_pylist([grid | {
                "names": pa.chunked_array(names).take(order).to_pylist(),
                "terms": b"\n".join(known), "counts": np.bincount(row_of).astype(
                    "<i8").tobytes()}], schema=arrow)

        for batch in batches:
            held, lengths = [], []
            for i, text in enumerate(batch.column("text")):
                found = terms_of(text.as_py())
                if not found:
                    continue
                which, count = np.unique(np.array([*map(known.__getitem__, found)], np.int32),
                                         return_counts=True)
                held.append(i)
                lengths.append(len(found))
                cells.append(which)
                times.append(count.astype(np.int32))
                size += len(which)
                if size >= CELLS:
                    names.append(batch.column("doc_id").take(pa.array(held)))
                    numbers.append(np.array(lengths, np.int64))
                    yield shard()
                    names, numbers, cells, times, known, size = [], [], [], [], _numbers(), 0
                    held, lengths = [], []
            if held:
                names.append(batch.column("doc_id").take(pa.array(held)))
                numbers.append(np.array(lengths, np.int64))
        if cells:
            yield shard()

    return rows.mapInArrow(run, schema)


def _numbers() -> dict[bytes, int]:
    """Numbers terms as they come."""
    known: dict[bytes, int] = defaultdict()
    known.default_factory = known.__len__
    return known


def item_terms(items: DataFrame) -> DataFrame:
    """``(item_id, term)``, each once."""
    text = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), UPPER, LOWER)
    return items.select("item_id", F.explode(F.regexp_extract_all(
        text, F.lit(f"({TERM})"), F.lit(1))).alias("term")).distinct()


def _document_counts(shards: DataFrame, wanted: set[bytes]) -> dict[bytes, int]:
    """How many documents have each of a block's terms."""
    shared = shards.sparkSession.sparkContext.broadcast(wanted)
    schema = arrow_schema("term binary, n long")

    def run(batches):
        counts = Counter()
        for batch in batches:
            for terms, n in zip(batch.column("terms"), batch.column("counts")):
                n = np.frombuffer(n.as_py(), "<i8")
                for i, term in enumerate(terms.as_py().split(b"\n")):
                    if term in shared.value:
                        counts[term] += int(n[i])
        yield pa.RecordBatch.from_pylist([{"term": t, "n": n} for t, n in counts.items()],
                                         schema=schema)

    rows = shards.select("terms", "counts").mapInArrow(run, "term binary, n long").groupBy(
        "term").agg(F.sum("n").alias("n")).collect()  # a row for each term of the block at most
    return {bytes(r["term"]): r["n"] for r in rows}


def _block(shards: DataFrame, rows: list, item: T.StructField, n: int, most: int) -> DataFrame:
    """``(item_id, doc_id, score)``: the best documents of a block's items in each task."""
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * count + 1)))
              for t, count in _document_counts(shards, {r["term"].encode() for r in rows}).items()}
    items: dict[object, list[tuple[bytes, int]]] = defaultdict(list)
    for r in rows:
        if (term := r["term"].encode()) in weight:
            items[r["item_id"]].append((term, weight[term]))
    shared = shards.sparkSession.sparkContext.broadcast(dict(items))
    schema = T.StructType([
        item, T.StructField("doc_id", shards.schema["names"].dataType.elementType),
        T.StructField("score", T.LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        best = {i: Best(most) for i in shared.value}
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py()
                       for c in ("terms", "height", "root", "masks", "drops")}
                treap, names = Treap.of(row), batch.column("names")[k].values
                numbers = {t: i for i, t in enumerate(row["terms"].split(b"\n"))}
                for i, terms in shared.value.items():
                    here = [(numbers[t], w) for t, w in terms if t in numbers]
                    if here:
                        best[i].names = names
                        treap.search(*np.array(here, np.int64).T, best[i])
        out = [{"item_id": i, "doc_id": name, "score": -s} for i, found in best.items()
               for s, _, name in found.rows]
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return shards.select("names", "terms", "height", "root", "masks", "drops").mapInArrow(
        run, schema)


def search(docs: DataFrame, items: DataFrame, most: int = MOST) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``most`` best documents of each item."""
    folder = shared_folder(docs.sparkSession)
    n, terms = totals(docs)
    shards = staged(index(docs, n, terms), f"{folder}/shards")
    wanted = staged(item_terms(items), f"{folder}/items")
    blocks = max(1, -(-wanted.count() // BLOCK_TERMS))
    block = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    found = reduce(DataFrame.unionByName, (
        _block(shards, wanted.filter(block == b).collect(), wanted.schema["item_id"], n, most)
        for b in range(blocks)))
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(
        F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", rank).filter(F.col("rank") <= most).select(
        "item_id", "rank", "doc_id", "score")


ORACLE_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}') AS terms
  FROM documents),
f AS (SELECT r, doc_id, len(terms) AS n, unnest(terms) AS term FROM d),
c AS (SELECT count(*) FILTER (len(terms) > 0) AS docs, CAST(sum(len(terms)) AS BIGINT) AS total
      FROM d),
tf AS (SELECT r, term, min(doc_id) AS doc_id, min(n) AS n, count(*) AS tf FROM f GROUP BY r, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(
        translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM benchmark),
s AS (
  SELECT q.item_id, tf.r, min(tf.doc_id) AS doc_id, CAST(sum(
           CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT)
           * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // total)))) AS BIGINT)
         AS score
  FROM q JOIN tf USING (term) JOIN df USING (term), c GROUP BY q.item_id, tf.r),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id
                ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k WHERE rank <= {MOST}
"""
