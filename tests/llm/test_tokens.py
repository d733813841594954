"""BPE, packing and token files against the tokenizers library."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from flawsieve.llm import bpe, packing, token_files
from flawsieve.llm.tokens import library_encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def reference(text):
    return np.array(LIBRARY.encode(text or "", add_special_tokens=False).ids, "<u4")


def strange_texts():
    r = random.Random(4)
    parts = [" ", "  ", "\n", "\t", "a", "the", "é", "<|endoftext|>", "'s", "12", "...", "\x1c",
             "\x85", "x" * 60, "日本", "\0", "\r\n", " word", "²", "\xa0", " " + "y" * 80]
    mixed = ["".join(r.choices(parts, k=r.randrange(12))) for _ in range(3000)]
    letters = ["".join(r.choices("abcdexyz", k=r.randrange(1, 80))) for _ in range(1000)]
    wild = ["".join(chr(r.choice((r.randrange(1, 0xD800), r.randrange(0xE000, 0x110000))))
                    for _ in range(20)) for _ in range(500)]
    return mixed + letters + wild + ["a" * 1000, "ab" * 2000, "=-" * 3000, ""]


@pytest.mark.parametrize("make", [library_encoder, bpe.encoder])
def test_same_ids_as_the_library(make):
    texts = strange_texts()
    expected = [reference(t).tobytes() for t in texts]
    for _ in range(2):  # the second time most pieces are remembered
        found = [i for at in range(0, len(texts), 700) for i in make(PATH)(texts[at:at + 700])]
        assert found == expected


def test_remembered_pieces_are_given_up(monkeypatch):
    monkeypatch.setattr("flawsieve.llm.tokens.REMEMBERED", 5)
    texts = strange_texts()[:300]
    assert [library_encoder(PATH)([t])[0] for t in texts] == [reference(t).tobytes() for t in texts]


def test_decoding():
    decode = bpe.vocabulary(PATH).decode
    for text in strange_texts():
        ids = reference(text)
        assert decode(ids.tobytes()).decode("utf-8", "replace") == LIBRARY.decode(
            ids.tolist(), skip_special_tokens=False) == text
    for ids in ([0, 50256, 188, 120], [5, 5, 199, 130]):  # not all of it text
        assert decode(np.array(ids, "<u4").tobytes()).decode("utf-8", "replace") == LIBRARY.decode(
            ids, skip_special_tokens=False)
    with pytest.raises(ValueError):
        decode(np.array([50257], "<u4").tobytes())


def test_encode_and_decode_tables(spark, odd, none):
    rows = bpe.decode_documents(bpe.encode_documents(odd, PATH), PATH).collect()
    expected = Counter((r.doc_id, reference(r.text).tobytes(), r.text or "") for r in odd.collect())
    assert Counter((r.doc_id, bytes(r.ids), r.decoded) for r in rows) == expected
    assert bpe.decode_documents(bpe.encode_documents(none, PATH), PATH).count() == 0


def sequences(rows):
    out = defaultdict(list)
    for r in rows:
        out[r.sequence_id].append(r)
    return out


def hold(rows, limits):
    for pieces in sequences(rows).values():
        pieces.sort(key=lambda r: r.offset)
        ends = np.cumsum([r.length for r in pieces]).tolist()
        assert [r.offset for r in pieces] == [0, *ends[:-1]]
        assert ends[-1] <= limits.tokens and len(pieces) <= limits.segments
        assert sum(r.loss_tokens for r in pieces) <= limits.loss_tokens
        assert all(r.length > 0 and len(r.ids) == 4 * r.length for r in pieces)


def test_packed_documents(odd, none):
    rows = packing.pack_documents(odd, PATH).collect()
    hold(rows, packing.Limits())
    by_document = defaultdict(list)
    for r in rows:
        by_document[r.doc_id].append(r)
    for key, texts in {r.doc_id: [q.text for q in odd.collect() if q.doc_id == r.doc_id]
                       for r in odd.collect()}.items():
        expected = Counter(reference(t).tobytes() + b"\0\0\0\0" for t in texts)
        if len(texts) == 1:
            pieces = sorted(by_document[key], key=lambda r: r.start)
            assert Counter([b"".join(bytes(r.ids) for r in pieces)]) == expected
            assert {r.doc_tokens for r in pieces} == {len(next(iter(expected))) // 4}
        assert sum(r.length for r in by_document[key]) * 4 == sum(
            len(k) * n for k, n in expected.items())
    used = [sum(r.length for r in s) for s in sequences(rows).values()]
    assert sum(1024 - n for n in used if n & (n - 1)) <= 0.02 * sum(used)
    assert packing.pack_documents(none, PATH).count() == 0


def test_packed_examples_keep_all_three_limits(spark):
    r = random.Random(8)
    rows = []
    for i in range(600):
        n = r.choice((0, 1, 5, 40, 100, 300))
        loss = [r.random() < r.choice((0.1, 0.9)) for _ in range(n)]
        rows.append((i, list(range(n)), loss if i % 50 else None))
    limits = packing.Limits(tokens=128, segments=4, loss_tokens=60, pool=50, least_cut=4)
    found = packing.pack_examples(
        spark.createDataFrame(rows, "doc_id long, ids array<int>, loss array<boolean>"),
        limits).collect()
    hold(found, limits)
    got = defaultdict(list)
    for p in found:
        got[p.doc_id].append((p.start, bytes(p.ids), p.loss_tokens))
    for i, ids, loss in rows:
        assert b"".join(x for _, x, _ in sorted(got[i])) == np.array(ids, "<u4").tobytes()
        assert sum(n for *_, n in got[i]) == sum(loss or [])


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 5000, dtype=np.uint64))
    hashed = token_files.PerfectHash.build(keys)
    assert sorted(hashed.slots(keys)) == list(range(len(keys)))
    again, _ = token_files.PerfectHash.load(hashed.dump(), len(hashed.levels))
    assert (again.slots(keys) == hashed.slots(keys)).all()
    with pytest.raises(ValueError):
        token_files.PerfectHash.build(np.array([5, 5], np.uint64))


def test_token_files(spark, odd, none):
    files = token_files.TokenFiles.write(odd, PATH, shards=3)
    rows = files.read(odd.select("doc_id")).collect()
    order = sorted(((r.doc_id, r.text or "") for r in odd.collect()),
                   key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    expected, start = Counter(), 0
    for key, text in order:
        ids = np.append(reference(text), 0).astype("<u4")
        expected[(key, start, zlib.crc32(ids.tobytes()))] += 1
        start += len(ids)
    assert Counter((r.doc_id, r.start, zlib.crc32(r.ids)) for r in rows) == expected
    unknown = spark.createDataFrame([(999,), (10,)], "doc_id long")
    assert [r.doc_id for r in files.read(unknown).collect()] == [10]
    empty = token_files.TokenFiles.write(none, PATH)
    assert empty.read(odd.select("doc_id")).count() == 0


def test_token_files_with_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(token_files, "BUCKET_KEYS", 20)
    docs = spark.range(500).selectExpr("id AS doc_id",
                                       "repeat('word ', CAST(id % 7 AS INT)) AS text")
    files = token_files.TokenFiles.write(docs, PATH, shards=5)
    assert files.buckets == 25
    rows = files.read(docs.select("doc_id")).collect()
    assert sorted(r.doc_id for r in rows) == list(range(500))
    start = 0
    for r in sorted(rows, key=lambda r: r.doc_id):
        assert r.start == start and bytes(r.ids) == reference(
            "word " * (r.doc_id % 7)).tobytes() + b"\0\0\0\0"
        start += len(r.ids) // 4
