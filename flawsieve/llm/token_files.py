"""Token ids of documents in shard files, with a minimal perfect hash index for keyed access.

Shard file ``shard-N.ids``: the ids of its documents in a row as little-endian unsigned integers
(2 bytes if the vocabulary allows, else 4); then the number of ids before each document and
after the last, 8 bytes each; then a trailer with magic, width, documents and ids.

Index file ``index-B.mph``: the keys of one bucket, placed by levels of bit arrays.  A key sets
one bit of the first level; keys that meet go on to the next, until none is left.  The rank of a
key's bit among all set bits is its slot, so n keys fill n slots.  A slot holds a fingerprint of
its key, the shard, the first record and the number of records.  A look-up hashes the key,
reads one bit a level until it meets a set one, and compares the fingerprint.

Documents are dealt to shards by ranges of ``doc_id`` and written in ascending order; a task
writes under a name of its own and renames at the end, so a repeated task leaves one whole file.
Keys go to index buckets by their hash, and only entries of some 30 bytes do; texts are
shuffled once.

Cases: a null or empty text is a document of its end id only; a null ``doc_id`` is a key like any
other and comes first; rows that share a ``doc_id`` are records in a row under one key, ordered
by text; integer keys never share a hash, and other keys that do are an error; extra columns,
whatever their names, are left out; an empty table gives no documents; texts are encoded in
shares, so a long one is bounded by its own length only.
"""

from __future__ import annotations

import struct
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_and_text, ready_workers, shared_folder, staged
from .tokens import library_encoder, shares

MAGIC = b"TOKIDS01"
TRAILER = struct.Struct("<8sQQQ")  # magic, bytes of an id, documents, ids
INDEX_HEADER = struct.Struct("<8sQQ")  # magic, levels, keys
SLOT = np.dtype([("fingerprint", "<u4"), ("shard", "<u4"), ("record", "<u8"), ("records", "<u8")])
# Keys in a bucket of the index, on average; bits of a level for each key that comes to it.
BUCKET_KEYS, BITS_A_KEY = 16_384, 2


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    if urlparse(folder).scheme in ("", "file"):
        return fs.LocalFileSystem(), urlparse(folder).path
    return fs.FileSystem.from_uri(folder)


# ---------------------------------------------------------------- shard files

class ShardWriter:
    """Writes one shard under a passing name; ``close`` gives it its own."""

    def __init__(self, folder: str, shard: int, width: int, attempt: int):
        self.files, root = _open(folder)
        self.files.create_dir(root, recursive=True)
        self.final = f"{root}/shard-{shard:08d}.ids"
        self.passing = f"{root}/.shard-{shard:08d}-{attempt}"
        self.out = self.files.open_output_stream(self.passing)
        self.width, self.before, self.total = width, [0], 0

    def add(self, ids: np.ndarray) -> None:
        self.out.write(ids.astype(f"<u{self.width}").tobytes())
        self.total += len(ids)
        self.before.append(self.total)

    def close(self) -> None:
        self.out.write(np.array(self.before, "<u8").tobytes())
        self.out.write(TRAILER.pack(MAGIC, self.width, len(self.before) - 1, self.total))
        self.out.close()
        self.files.move(self.passing, self.final)


class ShardReader:
    """Reads documents of one shard; holds its trailer only."""

    def __init__(self, folder: str, shard: int):
        files, root = _open(folder)
        self.file = files.open_input_file(f"{root}/shard-{shard:08d}.ids")
        size = self.file.size()
        magic, self.width, self.documents, self.total = TRAILER.unpack(
            self.file.read_at(TRAILER.size, size - TRAILER.size))
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")

    def record(self, i: int) -> tuple[int, np.ndarray]:
        """The ids before document ``i`` of the shard, and its own."""
        begin, end = np.frombuffer(
            self.file.read_at(16, self.total * self.width + 8 * i), "<u8").tolist()
        raw = self.file.read_at((end - begin) * self.width, begin * self.width)
        return begin, np.frombuffer(raw, f"<u{self.width}")

    def close(self) -> None:
        self.file.close()


# ---------------------------------------------------------------- index files

def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """Well-spread 64-bit values of 64-bit keys, another set for each seed."""
    with np.errstate(over="ignore"):
        x = keys + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (_mixed(keys, 1 << 20) >> np.uint64(32)).astype("<u4")


class PerfectHash:
    """Slots 0 to n-1 for n distinct 64-bit keys, in about 2.5 bits a key and level ranks."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels  # of bytes, each of 0 or 1, as long as the level has bits
        self.before = []  # set bits before each bit of a level
        total = 0
        for bits in levels:
            self.before.append(total + np.cumsum(bits, dtype=np.int64) - bits)
            total += int(bits.sum())
        self.size = total

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, left = [], keys
        while len(left):
            place = _mixed(left, len(levels)) % np.uint64(BITS_A_KEY * len(left) + 1)
            met = np.bincount(place.astype(np.int64), minlength=BITS_A_KEY * len(left) + 1)
            levels.append((met == 1).astype(np.uint8))
            left = left[met[place.astype(np.int64)] > 1]
            if len(levels) > 200:
                raise ValueError("keys of an index must be distinct")
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 for some that are not in the set (others get a slot, and are
        told apart by the fingerprint)."""
        found, left = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys))
        for n, bits in enumerate(self.levels):
            place = (_mixed(keys[left], n) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[place] == 1
            found[left[hit]] = self.before[n][place[hit]]
            left = left[~hit]
        return found

    def dump(self) -> bytes:
        return b"".join(struct.pack("<Q", len(b)) + np.packbits(b).tobytes() for b in self.levels)

    @classmethod
    def load(cls, raw: bytes, levels: int) -> tuple[PerfectHash, int]:
        at, out = 0, []
        for _ in range(levels):
            n = struct.unpack_from("<Q", raw, at)[0]
            size = (n + 7) // 8
            out.append(np.unpackbits(np.frombuffer(raw, np.uint8, size, at + 8), count=n))
            at += 8 + size
        return cls(out), at


def write_index(folder: str, bucket: int, attempt: int, keys: np.ndarray, values) -> None:
    """``values``: shard, first record and number of records for each key."""
    hashed = PerfectHash.build(keys)
    slots, table = hashed.slots(keys), np.zeros(len(keys), SLOT)
    table["fingerprint"][slots] = fingerprints(keys)
    for name, column in zip(("shard", "record", "records"), values):
        table[name][slots] = column
    files, root = _open(folder)
    files.create_dir(root, recursive=True)
    with files.open_output_stream(passing := f"{root}/.index-{bucket:08d}-{attempt}") as out:
        out.write(INDEX_HEADER.pack(MAGIC, len(hashed.levels), len(keys)))
        out.write(hashed.dump())
        out.write(table.tobytes())
    files.move(passing, f"{root}/index-{bucket:08d}.mph")


class Index:
    """One bucket of the index."""

    def __init__(self, folder: str, bucket: int):
        files, root = _open(folder)
        self.table = np.zeros(0, SLOT)
        self.hashed = PerfectHash([])
        path = f"{root}/index-{bucket:08d}.mph"
        if files.get_file_info(path).type == fs.FileType.NotFound:
            return  # no key fell into this bucket
        with files.open_input_file(path) as f:
            raw = f.read()
        magic, levels, n = INDEX_HEADER.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError("not an index of token ids")
        self.hashed, used = PerfectHash.load(raw[INDEX_HEADER.size:], levels)
        self.table = np.frombuffer(raw, SLOT, n, INDEX_HEADER.size + used)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are known, and the entries of those."""
        slots = self.hashed.slots(keys)
        known = slots >= 0
        known[known] = self.table["fingerprint"][slots[known]] == fingerprints(keys[known])
        return known, self.table[slots[known]]


# ---------------------------------------------------------------- Spark jobs

def _hashed(rows: DataFrame) -> DataFrame:
    """With the 64-bit ``key`` of ``doc_id`` that the index holds; a null has one of its own."""
    return rows.withColumn("key", F.xxhash64(F.col("doc_id").isNull(), F.col("doc_id")))


def _bucket(buckets: int):
    """By other bits than those that place a key within its bucket."""
    return F.pmod(F.xxhash64(F.col("key"), F.lit(7)), F.lit(buckets)).cast("int").alias("bucket")


class TokenFiles:
    """A folder of shards and index files.  ``write`` makes one; ``manifest`` is its table of
    shards, ``buckets`` the number of index files."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int):
        self.spark, self.folder, self.buckets = spark, folder, buckets
        self.manifest = spark.read.schema(
            "shard int, documents long, ids long, before long").parquet(f"{folder}/manifest")

    @classmethod
    def write(cls, docs: DataFrame, path: str, folder: str | None = None, end_id: int = 0,
              width: int = 2, shards: int | None = None) -> TokenFiles:
        """Encodes and writes all documents.  ``width``: bytes of an id.  ``shards``: ranges of
        ``doc_id``, by default the session's number of shuffle partitions."""
        spark = docs.sparkSession
        ready_workers(spark)
        folder = folder or shared_folder(spark)
        rows = id_and_text(docs)
        n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
        key = rows.schema["doc_id"]
        schema = T.StructType([key, T.StructField("shard", T.IntegerType()),
                               T.StructField("record", T.LongType()),
                               T.StructField("n_tokens", T.LongType())])

        def run(batches):
            context, writer, end = TaskContext.get(), None, np.array([end_id], "<u4")
            shard, record = context.partitionId(), 0
            for batch in batches:
                encode = library_encoder(path)
                for at, texts in shares(batch):
                    lengths = []
                    for ids in encode(texts):
                        ids = np.concatenate([np.frombuffer(ids, "<u4"), end])
                        if len(ids) and int(ids.max()) >= 1 << 8 * width:
                            raise ValueError("an id needs more bytes")
                        writer = writer or ShardWriter(folder, shard, width,
                                                       context.taskAttemptId())
                        writer.add(ids)
                        lengths.append(len(ids))
                    k = len(lengths)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").slice(at, k), pa.array([shard] * k, pa.int32()),
                         pa.array(range(record, record + k), pa.int64()),
                         pa.array(lengths, pa.int64())], schema.names)
                    record += k
            if writer:
                writer.close()

        entries = staged(rows.repartitionByRange(n, "doc_id").sortWithinPartitions(
            "doc_id", "text").mapInArrow(run, schema), f"{folder}/entries")
        # One row a shard: their ids in order of shards give the ids before each.
        cls._manifest(entries).write.parquet(f"{folder}/manifest")
        keys = _hashed(entries.groupBy("doc_id").agg(
            F.min(F.struct("shard", "record")).alias("first"),
            F.count(F.lit(1)).alias("records"))).select(
                "key", "first.shard", "first.record", "records")
        buckets = -(-entries.count() // BUCKET_KEYS) or 1
        cls._index(keys.select(_bucket(buckets), "*"), folder)
        return cls(spark, folder, buckets)

    @staticmethod
    def _manifest(entries: DataFrame) -> DataFrame:
        total = entries.groupBy("shard").agg(F.count(F.lit(1)).alias("documents"),
                                             F.sum("n_tokens").alias("ids"))
        order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
        return total.withColumn("before", F.coalesce(F.sum("ids").over(order), F.lit(0)))

    @staticmethod
    def _index(keys: DataFrame, folder: str) -> None:
        """A file for each bucket.  Keys are spread by their hash, so buckets are even."""

        def run(group: pa.Table) -> pa.Table:
            column = lambda c: group.column(c).to_numpy()
            write_index(folder, int(group.column("bucket")[0].as_py()),
                        TaskContext.get().taskAttemptId(), column("key").view("<u8"),
                        [column(c) for c in ("shard", "record", "records")])
            return pa.table({"keys": pa.array([group.num_rows], pa.int64())})

        keys.groupBy("bucket").applyInArrow(run, "keys long").write.format("noop").mode(
            "overwrite").save()

    def find(self, keys: DataFrame) -> DataFrame:
        """``(doc_id, shard, record)`` of every record of the given ``doc_id`` values, by the
        index.  Unknown keys give no row, but for one in some four billion whose fingerprint
        agrees with another key's.  Each bucket's file is read once for the keys that fall into
        it."""
        folder = self.folder
        schema = T.StructType([keys.schema["doc_id"], T.StructField("shard", T.IntegerType()),
                               T.StructField("record", T.LongType()),
                               T.StructField("records", T.LongType())])

        def run(batches):
            bucket, index = None, None
            for batch in batches:
                buckets = batch.column("bucket").to_numpy()
                edges = np.flatnonzero(np.diff(buckets, prepend=-1, append=-1))
                for a, b in zip(edges, edges[1:]):
                    if bucket != buckets[a]:
                        bucket, index = buckets[a], Index(folder, int(buckets[a]))
                    part = batch.slice(a, b - a)
                    known, entry = index.find(part.column("key").to_numpy().view("<u8"))
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id").filter(pa.array(known)),
                         pa.array(entry["shard"], pa.int32()),
                         pa.array(entry["record"], pa.int64()),
                         pa.array(entry["records"], pa.int64())], schema.names)

        asked = _hashed(keys.select("doc_id").distinct()).select(_bucket(self.buckets), "*")
        found = asked.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, schema)
        return found.select("doc_id", "shard", F.explode(F.sequence(
            "record", F.col("record") + F.col("records") - 1)).alias("record"))

    def read(self, keys: DataFrame) -> DataFrame:
        """``(doc_id, start, ids)`` of the given ``doc_id`` values, read from the shards: ``start``
        counts the ids of all documents before, ``ids`` are unsigned 32-bit little-endian bytes.
        Records of a shard are read in order, one at a time."""
        folder, key = self.folder, keys.schema["doc_id"]
        schema = T.StructType([key, *T.StructType.fromDDL("start long, ids binary").fields])

        def run(batches):
            shard, reader = None, None
            for batch in batches:
                shards = batch.column("shard").to_numpy()
                records = batch.column("record").to_numpy()
                before = batch.column("before").to_numpy()
                row, size, start, ids = 0, 0, [], []
                for i in range(batch.num_rows):
                    if shard != shards[i]:
                        if reader:
                            reader.close()
                        shard, reader = shards[i], ShardReader(folder, int(shards[i]))
                    begin, found = reader.record(int(records[i]))
                    start.append(before[i] + begin)
                    ids.append(found.astype("<u4").tobytes())
                    size += len(ids[-1])
                    if size > 8_000_000 or i == batch.num_rows - 1:
                        part = batch.slice(row, len(ids))
                        yield pa.RecordBatch.from_arrays(
                            [part.column("doc_id"), pa.array(start, pa.int64()),
                             pa.array(ids, pa.binary())], schema.names)
                        row, size, start, ids = i + 1, 0, [], []
            if reader:
                reader.close()

        records = self.find(keys).join(self.manifest.select("shard", "before"), "shard")
        return records.repartition("shard").sortWithinPartitions("shard", "record").mapInArrow(
            run, schema)
