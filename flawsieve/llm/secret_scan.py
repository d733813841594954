"""Finds secrets in whole texts: three fixed patterns, and strings that look random.

Two Markov models of characters give the chance of each character after the one before it: one
of random strings, one of ordinary identifiers.  A long string is a secret if the sum of the
logarithms of their ratios exceeds what the rarity of secrets asks for.  The models are trained
from labelled samples, counted over all documents: values that a fixed pattern finds are random
strings, all other strings are ordinary, those with digits too.  A character that never followed
another is judged by how often it occurs at all, and gets a fixed share of the chances, so that
evidence does not grow with the corpus; without samples nothing is found but by the fixed patterns.

Everything is array and string functions within the row.  Training counts pairs of characters,
combined before the shuffle; what reaches the driver is at most one count for each pair of 67
characters and label.  Positions are sums of lengths, run in blocks, so texts with very many
matches stay cheap.  All positions are code points, ends exclusive.

Cases: null texts count as empty and have no spans; null and repeated ``doc_id`` values and extra
columns, whatever their names, pass through; of spans that start together the kind that is
listed first comes first; an empty table gives an empty table, with models from no samples; long
texts and long strings are taken whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality_rules import let

# Fixed values of the contract: kinds in order, pattern, group whose length counts, least length.
KINDS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?"""
               r"""([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"(AKIA[A-Z0-9]+)", 1, 16),
    # Runs of 32 and more; shorter ones would only be dropped.
    ("hex", r"([0-9a-f]{32,})", 1, 32),
)
NAMES = tuple(k for k, *_ in KINDS) + ("markov",)
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
STRING = "[A-Za-z0-9+/_=-]"
SIZE = len(LETTERS) + 1  # class 0 stands before the first character
SAMPLE_LENGTH = 8  # least characters of an ordinary sample
LEAST_LENGTH = 20  # least characters of a string that is judged
# Of the chances after a character this share is dealt by how often characters occur at all, and of
# that one half evenly.  Samples of random strings are of a few kinds, others differ in their pairs.
BACK_OFF = {True: 0.5, False: 0.05}
EVEN = 0.5
PRIOR = 1e-6  # share of secrets among long strings
BLOCK = 256
PLACEHOLDER = "[secret]"


def scanned(values: Column, step) -> Column:
    """Running results of ``step(result, value)`` over an array of numbers, from 0.  Each block is
    run by itself after the blocks before it, since appending to one long array is quadratic."""

    def run(start: Column, block: Column) -> Column:
        first = F.struct(start.alias("last"), F.array().cast("array<bigint>").alias("all"))
        return F.aggregate(block, first, lambda a, v: let(step(a["last"], v), lambda n: F.struct(
            n.alias("last"), F.concat(a["all"], F.array(n)).alias("all"))), lambda a: a["all"])

    def blocks(v: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")),
                          lambda b: F.slice(v, b * BLOCK + 1, BLOCK))
        return let(cut, lambda c: let(
            run(F.lit(0).cast("bigint"), F.transform(c, lambda x: F.aggregate(
                x, F.lit(0).cast("bigint"), step))),
            lambda before: F.flatten(F.transform(c, lambda x, i: run(
                F.when(i == 0, F.lit(0).cast("bigint")).otherwise(before[i - 1]), x)))))

    return let(values.cast("array<bigint>"), lambda v: F.when(
        F.size(v) == 0, F.array().cast("array<bigint>")).otherwise(blocks(v)))


def _sum(a: Column, v: Column) -> Column:
    return a + v


SPAN = "array<struct<start:bigint,kind:int,stop:bigint>>"


def _hits(text: Column, pattern: str, body) -> Column:
    """``body`` of matches, their measured groups, and the ends of the matches; no spans if there
    is no match."""

    def found(x: Column) -> Column:
        lengths = F.transform(x["all"], lambda h, i: F.length(x["parts"][i]) + F.length(h))
        return let(scanned(lengths, _sum), lambda ends: body(x, ends))

    def parts(group: int) -> Column:
        return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))

    groups = 2 if pattern == KINDS[0][1] else 1
    pieces = F.struct(F.split(text, pattern, -1).alias("parts"), parts(0).alias("all"),
                      parts(groups).alias("value"))
    return F.when(text.rlike(pattern), let(pieces, found)).otherwise(F.array().cast(SPAN))


def _spans(kind: int, least: int, keep=None):
    def body(x: Column, ends: Column) -> Column:
        spans = F.transform(x["all"], lambda h, i: F.struct(
            (ends[i] - F.length(h)).alias("start"), F.lit(kind).alias("kind"),
            ends[i].alias("stop"),
            ((F.length(x["value"][i]) >= least) if keep is None else keep(h)).alias("good")))
        return F.transform(F.filter(spans, lambda s: s["good"]), lambda s: F.struct(
            s["start"], s["kind"], s["stop"]))

    return body


def base_spans(text: Column) -> Column:
    """Spans of the fixed patterns, in order."""
    return F.array_sort(F.concat(*[_hits(text, pattern, _spans(i, least))
                                   for i, (_, pattern, _, least) in enumerate(KINDS)]))


def replaced(text: Column, spans: Column, filler) -> Column:
    """The text with its spans, in order, replaced by ``filler(length, first)``: once for each
    span, with the code points that it adds to those before, and whether it touches none."""

    def body(c: Column, s: Column, ends: Column) -> Column:
        def piece(x: Column, i: Column) -> Column:
            before = F.when(i == 0, F.lit(0).cast("bigint")).otherwise(ends[i - 1])
            apart = (i == 0) | (x["start"] > before)
            gap = F.when(apart, F.array_join(F.slice(
                c, (before + 1).cast("int"), (x["start"] - before).cast("int")), "")).otherwise("")
            return F.concat(gap, filler(ends[i] - F.greatest(before, x["start"]), apart))

        last = F.element_at(ends, -1).cast("int")
        return F.concat(F.array_join(F.transform(s, piece), ""),
                        F.array_join(F.slice(c, last + 1, F.size(c)), ""))

    return let(spans, lambda s: F.when(F.size(s) == 0, text).otherwise(let(
        F.split(text, ""), lambda c: let(
            scanned(F.transform(s, lambda x: x["stop"]), lambda a, v: F.greatest(a, v)),
            lambda ends: body(c, s, ends)))))


def masked(text: Column, spans: Column) -> Column:
    """With spaces in place of the spans."""
    return replaced(text, spans, lambda n, _: F.repeat(F.lit(" "), n.cast("int")))


# ---------------------------------------------------------------- the models

CLASS_OF = [LETTERS.find(chr(i)) + 1 for i in range(128)]


def _numbers(values: list, kind: str) -> Column:
    """A constant array, from one literal."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")


def _classes(text: Column) -> Column:
    """Class of each character; 0 for all beyond the alphabet, line ends among them."""
    return F.transform(F.split(text, ""), lambda c: F.coalesce(
        F.get(_numbers(CLASS_OF, "int"), F.ascii(c)), F.lit(0)))


def samples(docs: DataFrame) -> DataFrame:
    """``(sample, random)`` labelled samples of a document in one text each, a line for each."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))

    def values(pattern: str, group: int, least: int) -> Column:
        return F.filter(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)),
                        lambda v: F.length(v) >= least)

    random = F.concat(*[F.when(text.rlike(p), values(p, g, n)).otherwise(
        F.array().cast("array<string>")) for _, p, g, n in KINDS])
    rest = let(base_spans(text), lambda s: masked(text, s))
    ordinary = F.regexp_extract_all(rest, F.lit(f"({STRING}{{{SAMPLE_LENGTH},}})"), F.lit(1))
    both = F.array(F.struct(F.array_join(random, "\n").alias("sample"), F.lit(True)
                            .alias("random")),
                   F.struct(F.array_join(ordinary, "\n").alias("sample"), F.lit(False)
                            .alias("random")))
    return docs.select(F.explode(both).alias("s")).select("s.*").filter("sample <> ''")


def train(labelled: DataFrame) -> list[float]:
    """Logarithms of the ratio of both models for each pair of classes, from ``(sample, random)``
    rows; null samples are skipped, and characters beyond the alphabet end a sample."""
    pairs = let(_classes(F.concat(F.lit("\n"), F.col("sample"))), lambda c: F.filter(
        F.zip_with(c, F.slice(c, 2, F.size(c)), lambda a, b: a * SIZE + b),
        lambda p: p.isNotNull() & (p % SIZE != 0)))
    counts = labelled.filter("sample is not null and random is not null").select(
        "random", F.explode(pairs).alias("pair")).groupBy("random", "pair").count()
    table = {kind: [0] * (SIZE * SIZE) for kind in (True, False)}
    for r in counts.collect():  # at most 2 * 68 * 68 rows
        table[r["random"]][r["pair"]] = r["count"]
    random, ordinary = _chances(table[True], True), _chances(table[False], False)
    return [round(math.log(a / b), 6) if i % SIZE else 0.0
            for i, (a, b) in enumerate(zip(random, ordinary))]


def _chances(pairs: list[int], random: bool) -> list[float]:
    """The chance of each character after each other: by counts of the pair, and for the share
    ``BACK_OFF``, or for all after a character that none follows, by counts of the character."""
    total = [sum(pairs[b::SIZE]) for b in range(1, SIZE)]
    even = 1 / len(total)
    each = [EVEN * even + (1 - EVEN) * (n / sum(total) if any(total) else even) for n in total]
    out = []
    for a in range(SIZE):
        row = pairs[a * SIZE + 1:(a + 1) * SIZE]
        share = BACK_OFF[random] if any(row) else 1.0
        out += [1.0] + [(1 - share) * n / max(1, sum(row)) + share * p for n, p in zip(row, each)]
    return out


def evidence(string: Column, ratios: list[float]) -> Column:
    """The log-likelihood ratio of a string without line ends."""
    table = _numbers(ratios, "double")
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("before"))
    return F.aggregate(_classes(string), start, lambda a, c: F.struct(
        (a["sum"] + table[a["before"] * SIZE + c]).alias("sum"), c.alias("before")),
        lambda a: a["sum"])


def scan(docs: DataFrame, ratios: list[float]) -> DataFrame:
    """The rows with two more columns of sorted spans: ``base_spans`` and ``secret_spans``, which
    has those and the ones that the models add."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    long_string = f"({STRING}{{{LEAST_LENGTH},}})"
    least = math.log((1 - PRIOR) / PRIOR)
    with_base = docs.withColumn("base_spans", base_spans(text))
    added = let(masked(text, F.col("base_spans")), lambda rest: _hits(
        rest, long_string, _spans(len(KINDS), 0, lambda h: evidence(h, ratios) > least)))
    return with_base.withColumn("secret_spans", F.array_sort(F.concat("base_spans", added)))


def written(spans: Column) -> Column:
    """``kind:start:stop`` for each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.array(*[F.lit(n) for n in NAMES])[s["kind"]], s["start"], s["stop"])), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == NAMES.index(kind))).cast("long")


def find_secrets(docs: DataFrame) -> DataFrame:
    """``(doc_id, text, base_spans, secret_spans)`` with models trained on all of ``docs``."""
    docs = docs.select("doc_id", "text")
    return scan(docs, train(samples(docs)))


def redacted(docs: DataFrame) -> DataFrame:
    """All rows and columns; in ``text`` a placeholder stands for each run of spans, and
    ``n_chars``, if there is one, counts the new characters.  Texts without secrets, nulls among
    them, stay as they are."""
    ratios = train(samples(docs.select("text")))
    held = scan(docs.select(F.struct("*").alias("row"), "text"), ratios)
    clean = replaced(F.col("text").cast("string"), F.col("secret_spans"), lambda _, apart: F.when(
        apart, F.lit(PLACEHOLDER)).otherwise(""))
    changed = F.size("secret_spans") > 0
    out = held.withColumn("clean", clean)
    replacements = {"text": F.col("clean")}
    if "n_chars" in docs.columns:
        replacements["n_chars"] = F.length("clean").cast(docs.schema["n_chars"].dataType)
    return out.select(*[F.when(changed, replacements[c]).otherwise(F.col("row")[c]).alias(c)
                        if c in replacements else F.col("row")[c].alias(c)
                        for c in docs.columns])
