"""Exact, near, line and passage deduplication against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from flawsieve.llm import exact_dedup, jaccard_join, suffix_dedup, unit_dedup
from flawsieve.llm.common import shared_folder

from .conftest import odd_texts, prose, table

WHITE = re.compile(r"[\x20\x09-\x0D]+")


def rank(key):
    return (key is None, key or 0)


def plain(text):
    return WHITE.sub("", text or "")


def expected_exact(rows):
    groups = defaultdict(list)
    for key, text in rows:
        groups[plain(text)].append((key, text or ""))
    out = Counter()
    for form, members in groups.items():
        keep = min(members, key=lambda m: (-len(m[1]), rank(m[0])))
        for i, (key, text) in enumerate(members):
            first = (key, len(text)) == (keep[0], len(keep[1])) and \
                [(k, len(t)) for k, t in members].index((key, len(text))) == i
            out[(key, keep[0], len(members), first, form)] += 1
    return out


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda t: F.length(t).cast("string")])
def test_exact(odd, digest):
    """Also with a digest that different texts share."""
    rows = exact_dedup.decisions(odd, digest).collect()
    expected = expected_exact(odd_texts())
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in rows) == Counter(
        {k: n for k, n in _without_form(expected).items()})
    if digest is exact_dedup.sha256:
        sums = Counter((r.doc_id, r.digest) for r in rows)
        assert sums == Counter((k, hashlib.sha256(plain(t).encode()).hexdigest())
                               for k, t in odd_texts())


def _without_form(counts):
    out = Counter()
    for (*rest, _), n in counts.items():
        out[tuple(rest)] += n
    return out


@pytest.mark.parametrize("from_files", [True, False])
def test_exact_keeps_rows_and_columns(spark, odd, none, from_files):
    odd = odd if from_files else table(spark, odd_texts())
    kept = exact_dedup.distinct_documents(odd)
    assert kept.schema.names == odd.schema.names
    expected = Counter({k[0]: 0 for k in expected_exact(odd_texts())})
    for k, n in expected_exact(odd_texts()).items():
        expected[k[0]] += n * k[3]
    assert Counter(r.doc_id for r in kept.collect()) == +expected
    assert exact_dedup.distinct_documents(none).count() == 0
    assert exact_dedup.decisions(none).count() == 0


def test_state_goes_on_with_more_rows(spark):
    folder = shared_folder(spark)
    for n, rows in enumerate(([(1, "a b"), (2, "c")], [(0, "ab"), (3, "d")])):
        docs = exact_dedup.located(spark.createDataFrame(rows, "doc_id long, text string"))
        prints = exact_dedup.fingerprints(docs, f"{folder}/batch-{n}", exact_dedup.sha256)
        prints.write.mode("append").parquet(f"{folder}/prints")
        held = exact_dedup.advance(spark, prints, f"{folder}/prints", f"{folder}/state")
    assert Counter((r.n, r.best.doc_id) for r in held.collect()) == {(2, 1): 1, (1, 2): 1,
                                                                     (1, 3): 1}


# ---------------------------------------------------------------- near copies

def near_rows(n=260, seed=5):
    r = random.Random(seed)
    base = [f"w{r.randrange(400)}" for _ in range(160)]
    rows = list(odd_texts())
    for i in range(100, 100 + n):
        words = list(base)
        for _ in range(r.randrange(6)):
            words[r.randrange(160)] = f"z{r.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    return rows + [(1000 + i, "exact copy of one text that has seven words") for i in range(30)]


def brute_links(rows):
    words = [" ".join(WHITE.sub(" ", (t or "").lower()).strip(" ").split(" ")) for _, t in rows]
    sets = [set(jaccard_join.shingles(w).tolist()) for w in words]
    links = defaultdict(set)
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            common = len(a & b)
            if words[i] == words[j] or common and 9 * common >= 4 * (len(a) + len(b)):
                links[i].add(j)
                links[j].add(i)
    return links


@pytest.mark.parametrize("small,block", [(64, 256), (4, 16)])
def test_links_and_classes(spark, monkeypatch, small, block):
    monkeypatch.setattr(jaccard_join, "SMALL", small)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rows = near_rows()
    found = jaccard_join.classes(table(spark, rows)).collect()
    links = brute_links(rows)
    missing = sum(map(len, links.values())) - sum(r.n_links for r in found)
    assert 0 <= missing <= 0.01 * sum(map(len, links.values()))
    root = list(range(len(rows)))
    for _ in range(len(rows)):
        new = [min([root[i], *[root[j] for j in links[i]]]) for i in range(len(rows))]
        if new == root:
            break
        root = new
    ids = defaultdict(list)
    for i, (key, _) in enumerate(rows):
        ids[root[i]].append(key)
    expected = Counter((rows[i][0], min((k for k in ids[root[i]] if k is not None), default=None))
                       for i in range(len(rows)))
    assert Counter((r.doc_id, r.class_id) for r in found) == expected


def test_every_link_counts_once(spark, monkeypatch):
    """With whole prefixes of one hash nearly all pairs of the group meet in many nodes."""
    monkeypatch.setattr(jaccard_join, "SMALL", 3)
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    monkeypatch.setattr(jaccard_join, "prefix_length", lambda *a, **b: 1)
    rows = near_rows(60, 9)
    found = jaccard_join.classes(table(spark, rows)).collect()
    links = brute_links(rows)
    assert Counter((r.doc_id, r.n_links) for r in found) == Counter(
        (rows[i][0], len(links[i])) for i in range(len(rows)))


def test_no_link_of_a_group_of_near_copies_is_missed(spark):
    rows = near_rows()
    found = jaccard_join.classes(table(spark, rows)).collect()
    links = brute_links(rows)
    assert Counter((r.doc_id, r.n_links) for r in found) == Counter(
        (rows[i][0], len(links[i])) for i in range(len(rows)))


@pytest.mark.parametrize("from_files", [True, False])
def test_one_of_each_class(spark, odd, none, from_files):
    odd = odd if from_files else table(spark, odd_texts())
    kept = jaccard_join.one_of_each_class(odd)
    assert kept.schema.names == odd.schema.names
    # 3 is a copy of 1 and 2 in other white space, 4 is near; 9 has the words of 8.
    assert sorted((r.doc_id for r in kept.collect()), key=rank) == [
        1, 5, 8, 10, 11, 12, 13, 14, 15, 16, 17, 18, None]
    assert jaccard_join.classes(none).count() == 0


def test_prefixes_reach_the_target_recall():
    for trees in (4, 16, 32, 64):
        n = jaccard_join.prefix_length(trees)
        assert n == 1 or 1 - (1 - 0.8 ** n) ** trees >= jaccard_join.TARGET_RECALL
        assert 1 - (1 - 0.8 ** (n + 1)) ** trees < jaccard_join.TARGET_RECALL or n == 12


def test_products():
    r = np.random.default_rng(3)
    left, right = ([np.unique(r.integers(0, 9000, r.integers(0, 900))) for _ in range(n)]
                   for n in (7, 5))
    assert (jaccard_join.products(left, right) == [
        [len(np.intersect1d(a, b)) for b in right] for a in left]).all()
    assert jaccard_join._linked(4, 5, 4, Fraction("0.8")) and \
        not jaccard_join._linked(3, 4, 4, Fraction("0.8"))


# ---------------------------------------------------------------- lines

@pytest.mark.parametrize("unit", [unit_dedup.LINE, unit_dedup.PARAGRAPH])
def test_lines(odd, none, unit):
    found = unit_dedup.deduplicated(odd, unit).collect()
    seen, expected = set(), Counter()
    for key, text in sorted(odd_texts(), key=lambda r: rank(r[0])):
        at, stay, gone = 0, [], []
        for u in (text or "").split(unit):
            form = WHITE.sub(" ", u.lower()).strip(" ")
            if form and form in seen:
                gone.append((at, at + len(u)))
            else:
                stay.append(u)
            seen.add(form)
            at += len(u) + len(unit)
        expected[(key, unit.join(stay), tuple(gone))] += 1
    assert Counter((r.doc_id, r.cleaned, tuple(map(tuple, r.removed))) for r in found) == expected
    assert unit_dedup.deduplicated(none, unit).count() == 0


def test_short_lines_and_long_words(spark):
    """All repeats but the earliest go, however short; blank lines stay."""
    long = "文" * 300
    rows = [(1, f"all rights reserved.\nend\n\n{long}"), (0, f"End\n\n\n{long}\nend"),
            (None, "ALL  rights reserved.\nnew")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = unit_dedup.deduplicated(docs).collect()
    assert {r.doc_id: r.cleaned for r in found} == {
        0: f"End\n\n\n{long}", 1: "all rights reserved.\n", None: "new"}
    found = unit_dedup.deduplicated(docs, least_words=2).collect()
    assert {r.doc_id: r.cleaned for r in found}[0] == f"End\n\n\n{long}\nend"


# ---------------------------------------------------------------- passages

def brute_passages(rows):
    words = [[w for w in WHITE.split((t or "").lower()) if w] for _, t in rows]
    places = defaultdict(list)
    for i, w in enumerate(words):
        for at in range(len(w) - 49):
            places[tuple(w[at:at + 50])].append((i, at))
    covered = defaultdict(set)
    for where in places.values():
        if len(where) > 1:
            for i, at in where:
                covered[i].update(range(at, at + 50))
    return words, covered


def spans_of(spans):
    return {i for s in spans for i in range(s.start, s.stop)}


def test_passages(spark, none):
    r = random.Random(11)
    shared = [prose(50 + i, 55 + 20 * i) for i in range(4)]
    rows = list(odd_texts())
    for i in range(200, 300):
        parts = [prose(i, r.randrange(5, 90)), r.choice(shared), prose(i + 1000, r.randrange(60))]
        rows.append((i, " ".join(parts)))
    rows.append((400, shared[0] + " between " + shared[0]))
    found = suffix_dedup.repeated_passages(table(spark, rows)).collect()
    words, covered = brute_passages(rows)
    assert Counter((r.doc_id, r.n_words) for r in found) == Counter(
        (k, len(w)) for (k, _), w in zip(rows, words))
    by_id = defaultdict(list)
    for row in found:
        by_id[row.doc_id].append(spans_of(row.spans))
        assert spans_of(row.later) <= spans_of(row.spans)
    total = missed = 0
    for i, (key, _) in enumerate(rows):
        if sum(k == key for k, _ in rows) == 1:
            assert by_id[key][0] <= covered[i]
            total, missed = total + len(covered[i]), missed + len(covered[i] - by_id[key][0])
    assert missed <= 0.002 * total and total > 5000
    assert suffix_dedup.repeated_passages(none).count() == 0


def test_later_passages_go(spark):
    passage = prose(2, 70)
    rows = [(1, f"one {passage} two"), (2, f"three\n{passage} four"), (3, None), (4, "short")]
    found = {r.doc_id: r.cleaned for r in suffix_dedup.without_later(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: f"one {passage} two", 2: "three four", 3: None, 4: "short"}


def test_a_head_that_all_share_is_spread(spark):
    """Matches across the borders of tasks count as well."""
    passage = prose(2, 60)
    docs = spark.range(400).select(
        F.col("id").alias("doc_id"), F.concat(F.lit(passage + " tail "), F.col("id")).alias("text"))
    found = suffix_dedup.repeated_passages(docs).collect()
    assert all(spans_of(r.spans) == set(range(61)) for r in found)
    assert sorted(r.doc_id for r in found if not r.later) == [0]


def skewed_rows(common, further, n=300, copies=50):
    """Documents that share a text that is too short for a passage; some share words around it."""
    r = random.Random(common)
    shared, before = prose(1, common)[:-1], prose(2, further)[:-1]
    return [(i, " ".join([prose(1000 + i, 30), before if r.randrange(n) < copies else "",
                          shared, prose(5000 + i, 30)])) for i in range(n)]


@pytest.mark.parametrize("common,further", [(40, 12), (45, 10), (45, 30)])
def test_passages_around_a_head_that_many_share(spark, common, further):
    rows = skewed_rows(common, further)
    found = suffix_dedup.repeated_passages(table(spark, rows)).collect()
    covered = brute_passages(rows)[1]
    assert sum(map(len, covered.values())) > 1000
    assert {r.doc_id: spans_of(r.spans) for r in found} == {
        i: covered[i] for i in range(len(rows))}


def test_each_part_of_a_passage_stays_once(spark):
    """Document 1 has the first words of a passage that 2 and 3 share, 4 a part of 60 words."""
    passage = prose(2, 90).split(" ")
    rows = [(1, " ".join(["a", *passage[:45], "b"])), (3, " ".join(["c", *passage, "d"])),
            (2, " ".join(["e", *passage, "f"])), (4, " ".join(["g", *passage[:60], "h"])),
            (0, " ".join(["i", *passage[35:], "j"]))]
    found = {r.doc_id: (spans_of(r.spans), spans_of(r.later)) for r in
             suffix_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id int, text string"))
             .collect()}
    # 0 has the windows from 35 on; 2 has all others before 3 and 4.
    assert found == {0: (set(range(1, 56)), set()), 1: (set(), set()),
                     2: (set(range(1, 91)), set(range(36, 91))),
                     3: (set(range(1, 91)),) * 2, 4: (set(range(1, 61)),) * 2}


def test_components(spark):
    r = random.Random(2)
    names = [hashlib.md5(str(i).encode()).digest() for i in range(300)]
    pairs = [(i, i + 1) for i in range(100)] + [(r.randrange(100, 300), r.randrange(100, 300))
                                                for _ in range(120)] + [(5, 5), (7, 6)]
    edges = spark.createDataFrame([(bytearray(names[a]), bytearray(names[b])) for a, b in pairs],
                                  "a binary, b binary")
    got = {bytes(x.key): bytes(x.label) for x in jaccard_join.components(
        edges, shared_folder(spark)).collect()}
    root = list(range(300))
    for _ in range(300):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    linked = sorted({x for a, b in pairs if a != b for x in (a, b)})
    assert set(got) == {names[i] for i in linked}
    assert all((got[names[i]] == got[names[j]]) == (root[i] == root[j])
               for i in linked for j in linked)
