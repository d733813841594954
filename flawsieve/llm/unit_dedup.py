"""Removes lines or paragraphs that occurred before, anywhere in the corpus.

Units are what stands between line ends (or blank lines).  They are compared by the digest of
their normalised form: lower case, white space as one space.  All units with a word are compared,
or with ``least_words`` those with at least so many.  Of equal units the one with the earliest rank
stays, by ``doc_id`` and then by position; the others are removed, and their places in the original
text, in code points, are kept.

Only digests and places are grouped, combined before the shuffle, so a line that a third of all
documents have reaches its group as one row for each task.  The places that stay are then
gathered by document, not looked up by digest, so that line is no hot key there either.

Cases: null and empty texts have no units that are compared, and stay as they are (a null as an
empty text); a null ``doc_id`` ranks after all others; of repeated rows the first in the files
keeps its units; extra columns, whatever their names, play no part; an empty table gives an
empty table; long texts are handled whole.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES
from .exact_dedup import located
from .quality_rules import let
from .secret_scan import scanned

LINE, PARAGRAPH = "\n", "\n\n"


def normalised(unit: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(unit), f"{SPACES}+", " "))


def units(text: Column, unit: str) -> Column:
    return F.split(text, re.escape(unit).replace("\\\n", "\n"), -1)


def compared(units_: Column, least_words: int) -> Column:
    """``(at, form)`` of the units that have a word and are long enough."""
    forms = F.transform(units_, lambda u, i: F.struct(i.alias("at"), normalised(u).alias("form")))
    return F.filter(forms, lambda u: (u.form != "") & (
        F.size(F.split(u.form, " ")) >= least_words))


def _text(held: str = "held.text") -> Column:
    return F.coalesce(F.col(held).cast("string"), F.lit(""))


def kept_places(rows: DataFrame, unit: str, least_words: int) -> DataFrame:
    """``(file, number, places)``: the units of each document that are the first of their form."""
    places = rows.select("held.doc_id", "file", "number", F.explode(F.transform(
        compared(units(_text(), unit), least_words), lambda u: F.struct(
            u["at"].alias("at"), F.unhex(F.md5(u["form"])).alias("digest")))).alias("u"))
    firsts = places.groupBy("u.digest").agg(F.min(F.struct(
        F.col("doc_id").isNull().alias("unnamed"), "doc_id", "file", "number",
        F.col("u.at").alias("at"))).alias("first"))
    return firsts.groupBy("first.file", "first.number").agg(
        F.collect_list("first.at").alias("places"))


def deduplicated(docs: DataFrame, unit: str = LINE, least_words: int = 1) -> DataFrame:
    """``(doc_id, text, cleaned, n_units, removed)``: ``removed`` has ``(start, stop)`` of each
    removed unit in ``text``, without its line end."""
    rows = located(docs)
    kept = kept_places(rows, unit, least_words)
    none = F.array().cast("array<int>")
    joined = rows.select("held.doc_id", _text().alias("text"), "file", "number").join(
        kept, ["file", "number"], "left")
    gone = F.array_except(F.transform(compared(units(F.col("text"), unit), least_words),
                                      lambda u: u["at"]), F.coalesce("places", none))

    def result(x: Column) -> Column:
        last = F.size(x["units"]) - 1
        stay = F.array_except(F.sequence(F.lit(0), last), x["gone"])
        ends = scanned(F.transform(x["units"], lambda u: F.length(u) + len(unit)),
                       lambda a, v: a + v)
        return F.struct(
            F.array_join(F.transform(stay, lambda p: x["units"][p]), unit).alias("cleaned"),
            let(ends, lambda e: F.transform(x["gone"], lambda p: F.struct(
                (e[p] - F.length(x["units"][p]) - len(unit)).alias("start"),
                (e[p] - len(unit)).alias("stop")))).alias("removed"))

    spans = "array<struct<start:bigint,stop:bigint>>"
    untouched = F.struct(F.col("text").alias("cleaned"), F.array().cast(spans).alias("removed"))
    found = let(F.struct(units(F.col("text"), unit).alias("units"), gone.alias("gone")),
                lambda x: F.struct(F.size(x["units"]).cast("long").alias("n_units"),
                                   F.when(F.size(x["gone"]) == 0, untouched).otherwise(result(x))
                                   .alias("r")))
    return joined.select("doc_id", "text", found.alias("x")).select(
        "doc_id", "text", "x.r.cleaned", "x.n_units", "x.r.removed")


ORACLE_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
u AS (
  SELECT r, doc_id, p, line, trim(regexp_replace(lower(line), '{SPACES}+', ' ', 'g')) AS form,
         coalesce(sum(length(line) + 1) OVER (PARTITION BY r ORDER BY p
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM (SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line,
               unnest(range(len(string_split(text, chr(10))))) AS p FROM d)),
k AS (
  SELECT *, form <> '' AND row_number() OVER (
              PARTITION BY form ORDER BY doc_id NULLS LAST, r, p) > 1 AS gone FROM u)
SELECT min(doc_id) AS doc_id, count(*) AS n_units, count(*) FILTER (gone) AS n_removed,
       coalesce(string_agg(CAST(start AS BIGINT) || ':' || CAST(start + length(line) AS BIGINT),
                           ',' ORDER BY p) FILTER (gone), '') AS removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone), ''))
         AS cleaned_sha256
FROM k GROUP BY r
"""
