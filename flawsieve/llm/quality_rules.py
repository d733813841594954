"""Line-first cleaning: lines that break a rule go, then documents that lost too much go.

A line fails if it has no word; if it doesn't end with a closing mark of a sentence; if symbols,
or marks in a row, make up more than a tenth of it; if it has several separators of a
navigation bar; or if it has a phrase of web boilerplate.  A document is rejected if its base
rules fail or less than half of the characters of its words are in lines that stay.

Everything is computed within the row, by array expressions over its lines and words, and in
linear or n log n time: there is no exchange, so no source or copy can become hot.  Words in
windows that occur again are found by 64-bit hashes of the windows, sorted with their positions.

Cases: null and empty texts have no words and fail the base rules; a null, repeated or clashing
column passes through ``clean`` as it is; of equal lines the first is no duplicate; an empty
table gives an empty table; long texts are handled whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES

WINDOW = 8
MIN_WORDS, MAX_REPEATED = 20, 30  # words; words in repeated windows, in hundredths
MIN_KEPT = 50  # characters in lines that stay, in hundredths

SYMBOLS = r"[#*$%&|<>]"
ENDING = r"[.!?…][\x22'”’»)\]]*[\x20\x09-\x0D]*\z"
SEPARATORS = r"[|»›•·]"
BOILERPLATE = (r"(?i)cookie policy|privacy policy|terms of (?:use|service)|all rights reserved|"
               r"lorem ipsum|enable javascript|click here|sign (?:in|up) (?:to|for)|"
               r"subscribe to our|skip to (?:main )?content|share on (?:facebook|twitter)")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, even within the lambdas of the body."""
    return F.transform(F.array(value), body)[0]


def without(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, pattern, "")


def visible(text: Column) -> Column:
    """Characters of words."""
    return F.length(without(text, f"{SPACES}+"))


def only(text: Column, kind: str) -> Column:
    """How many characters of a class there are."""
    return F.length(without(text, f"[^{kind[1:-1]}]+"))


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, f"{SPACES}+"), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """How many words lie in windows of eight words that occur at least twice."""

    def covered(hashes: Column) -> Column:
        at = let(F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"),
                                                                        i.alias("i")))),
                 lambda s: F.array_sort(F.transform(
                     F.filter(F.transform(s, lambda x, j: F.struct(
                         x.i.alias("i"),
                         (F.coalesce(F.get(s, j + 1).h == x.h, F.lit(False))
                          | F.coalesce(F.get(s, j - 1).h == x.h, F.lit(False))).alias("again"))),
                         lambda x: x.again), lambda x: x.i)))
        # Positions ascend, so a window adds what lies behind the end of the one before.
        zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        return F.aggregate(at, zero, lambda a, p: F.struct(
            (a.n + p + WINDOW - F.greatest(a.end, p)).alias("n"), (p + WINDOW).alias("end")),
            lambda a: a.n)

    def hashed(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)),
                           lambda i: F.xxhash64(F.slice(w, i, WINDOW)))

    return let(words, lambda w: F.when(F.size(w) <= WINDOW, F.lit(0)).otherwise(let(
        hashed(w), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0))
        .otherwise(covered(h)))))


def line_stays(line: Column) -> Column:
    def judged(chars: Column) -> Column:
        marks = only(line, "[!?]")
        return ((chars > 0) & line.rlike(ENDING) & (only(line, SYMBOLS) * 10 <= chars)
                & ((marks * 10 <= chars) | (marks < 4)) & (only(line, SEPARATORS) < 3)
                & ~line.rlike(BOILERPLATE))

    return let(visible(line), judged)


def measured(docs: DataFrame) -> DataFrame:
    """The rows with one more column, ``line_rules``: a struct of the base counts, the verdict and
    the cleaned text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))

    def counts(words: Column, lines: Column) -> Column:
        spoken = F.filter(lines, lambda x: x.rlike(f"[^{SPACES[1:-1]}]"))
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            visible(text).cast("long").alias("word_chars"),
            only(text, SYMBOLS).cast("long").alias("n_symbols"),
            let(spoken, lambda s: F.size(s) - F.size(F.array_distinct(s))).cast("long")
            .alias("n_dup_lines"),
            repeated_words(words).cast("long").alias("n_repeat_words"),
            F.size(spoken).cast("long").alias("n_lines"),
            F.filter(lines, line_stays).alias("stay"))

    base = let(words_of(text), lambda w: let(F.split(text, "\n"), lambda x: counts(w, x)))

    def judged(b: Column) -> Column:
        clean = F.array_join(b.stay, "\n")
        failed = (b.n_words < MIN_WORDS) | (b.n_repeat_words * 100 > b.n_words * MAX_REPEATED)
        return let(F.struct(clean.alias("text"), visible(clean).cast("long").alias("chars")),
                   lambda c: F.struct(
                       *[b[k].alias(k) for k in ("n_words", "word_chars", "n_symbols",
                                                 "n_dup_lines", "n_repeat_words", "n_lines")],
                       F.size(b.stay).cast("long").alias("n_kept_lines"),
                       c.chars.alias("kept_chars"), failed.alias("base_failed"),
                       (~failed & (c.chars * 100 >= b.word_chars * MIN_KEPT)).alias("kept"),
                       c.text.alias("cleaned")))

    return docs.withColumn("line_rules", let(base, judged))


def verdicts(docs: DataFrame) -> DataFrame:
    """``doc_id`` and, for each document, the base counts, the verdict and the cleaned text."""
    return measured(docs.select("doc_id", "text")).select("doc_id", "line_rules.*")


def clean(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns; ``text`` has the lines that stay, and
    ``n_chars``, if there is one, counts its characters."""
    columns = docs.columns
    held = measured(docs.select(F.struct("*").alias("row"), "text"))
    kept = held.filter("line_rules.kept")
    cleaned = F.col("line_rules.cleaned")
    replaced = {"text": cleaned, "n_chars": F.length(cleaned).cast(
        docs.schema["n_chars"].dataType if "n_chars" in columns else "long")}
    return kept.select(*[replaced.get(c, F.col("row")[c]).alias(c) for c in columns])


_W = "[^\\x20\\x09-\\x0D]+"
ORACLE_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT r, regexp_extract_all(text, '{_W}') AS words, string_split(text, chr(10)) AS lines
  FROM d),
p AS (
  SELECT r, unnest(range(1, len(words) - {WINDOW - 2})) AS i, words FROM w
  WHERE len(words) >= {WINDOW}),
h AS (SELECT r, i, list_slice(words, i, i + {WINDOW - 1}) AS win FROM p),
again AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n FROM h) WHERE n > 1),
cover AS (
  SELECT r, sum(least({WINDOW}, coalesce(nxt - i, {WINDOW}))) AS n_repeat_words
  FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM again) GROUP BY r),
l AS (
  SELECT r, line, i, len(regexp_replace(line, '{SPACES}+', '', 'g')) AS chars,
         len(regexp_replace(line, '[^#*$%&|<>]+', '', 'g')) AS symbols,
         len(regexp_replace(line, '[^!?]+', '', 'g')) AS marks,
         len(regexp_replace(line, '[^{SEPARATORS[1:-1]}]+', '', 'g')) AS separators
  FROM (SELECT r, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM w)),
j AS (
  SELECT r, count(*) FILTER (chars > 0) AS n_lines,
         count(*) FILTER (chars > 0) - count(DISTINCT line) FILTER (chars > 0) AS n_dup_lines,
         count(*) FILTER (stays) AS n_kept_lines,
         coalesce(sum(chars) FILTER (stays), 0) AS kept_chars
  FROM (SELECT *, chars > 0 AND regexp_matches(line, '{ENDING.replace("'", "''")}')
               AND symbols * 10 <= chars AND (marks * 10 <= chars OR marks < 4)
               AND separators < 3 AND NOT regexp_matches(line, '{BOILERPLATE}') AS stays
        FROM l) GROUP BY r),
m AS (
  SELECT doc_id, len(words) AS n_words,
         len(regexp_replace(text, '{SPACES}+', '', 'g')) AS word_chars,
         len(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, n_lines, n_kept_lines,
         CAST(kept_chars AS BIGINT) AS kept_chars
  FROM d JOIN w USING (r) JOIN j USING (r) LEFT JOIN cover USING (r)),
b AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words
            AS base_failed FROM m)
SELECT *, NOT base_failed AND kept_chars * 100 >= word_chars * {MIN_KEPT} AS kept FROM b
"""
