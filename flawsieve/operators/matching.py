"""Whole-file pattern matching: every match of every rule, with its exact line number.

All of it happens inside the row of the file.  ``content`` is never exploded per rule, never
shuffled, and the catalogue is a literal array in the plan, so there is no join.

Line numbers: ``regexp_replace(content, pattern, marker || $0)`` puts one marker byte before
each match and changes nothing else, so line *i* of the marked text is longer than line *i* of
the original by the number of matches that start on it.  That holds whatever the content is
and whatever the match spans, and costs one pass per matching rule.

A pass over a text costs far more with a regex than with a literal.  Most patterns start with a
literal, so no match starts before its first place in the folded text, and all passes of such a
rule begin there (``first_start``): the matches are those in the whole text.
Whether the literals occur is looked up together with the needles, and each one that occurs is
searched for once.
"""

from __future__ import annotations

import json

from py4j.protocol import Py4JJavaError
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalogue import DEFAULT_CATALOGUE, HEURISTIC, RULE, Rule, usable
from ..functions.regex import SPACE, WORD, java_pattern, leads
from ..functions.text import (contains_any, escaped, excerpt, let, lines_of, strip,
                              words_in)
from .fallback import PLACE_TYPE, python_matches

MARKER = "\x01"
_BUILT_IN = frozenset(DEFAULT_CATALOGUE)
EVIDENCE_LENGTH = 100
REGEX_CONFIDENCE = 0.7

# Characters that a case-insensitive pattern equates with i, s and k although lower() does not.
_CASE_EXTRAS = "ıİſ\u212a"
_CASE_PLAIN = "iisk"

RULE_TYPE = ("struct<ord:int,lane:string,name:string,regex:string,guard:string,"
             "needles:array<string>,leads:array<struct<word:string,regex:string>>,run:boolean,start:int,"
             "finding_type:string,severity:string,needs_escalation:boolean>")

RAW_COLUMNS = ("lane", "ord", "k", "pattern", "finding_type", "severity", "evidence", "line",
               "confidence", "needs_escalation")


_JAVA_RUNS: dict[tuple[str, bool], bool] = {}


def java_runs(rule: Rule) -> bool:
    """Whether Java's regexes can express a rule; conditional groups, for one, they can't."""
    spark = SparkSession.getActiveSession()
    if rule in _BUILT_IN or spark is None:
        return True
    key = (rule.pattern, rule.lane == HEURISTIC)
    if key not in _JAVA_RUNS:
        try:
            spark._jvm.java.util.regex.Pattern.compile(java_pattern(*key))
            _JAVA_RUNS[key] = True
        except (Py4JJavaError, IllegalArgumentException):
            _JAVA_RUNS[key] = False
    return _JAVA_RUNS[key]


def fallback_rules(catalogue: tuple[Rule, ...]) -> dict[int, Rule]:
    """The usable rules that Python has to match, by their number."""
    return {i: r for i, r in enumerate(usable(catalogue), 1) if not java_runs(r)}


def rule_array(catalogue: tuple[Rule, ...]) -> Column:
    """The catalogue as one literal ``ARRAY<STRUCT>`` column; a rule that Python has to match has
    no regex in it."""
    starts = {r.pattern: leads(r.pattern) or (None, False) for r in usable(catalogue)}
    rows = [
        {"ord": i, "lane": r.lane, "name": r.name,
         "regex": java_pattern(r.linear_pattern or r.pattern, r.lane == HEURISTIC)
         if java_runs(r) else None,
         "guard": r.guard and java_pattern(r.guard, r.lane == HEURISTIC),
         "needles": list(r.needles),
         "leads": starts[r.pattern][0] and [{"word": lead, "regex": escaped(lead)}
                                            for lead in starts[r.pattern][0]],
         "run": starts[r.pattern][1], "start": 1,
         "finding_type": r.finding_type,
         "severity": r.severity, "needs_escalation": r.needs_escalation}
        for i, r in enumerate(usable(catalogue), 1)
    ]
    return F.from_json(F.lit(json.dumps(rows)), f"array<{RULE_TYPE}>")


def has_case_extras(content: Column) -> Column:
    return contains_any(content, _CASE_EXTRAS)


def folded(content: Column) -> Column:
    """The text as the needle test reads it: lower case, by the rules of case-insensitive
    matching."""
    return F.lower(
        F.when(has_case_extras(content), F.translate(content, _CASE_EXTRAS, _CASE_PLAIN))
        .otherwise(content))


def needles_of(catalogue: tuple[Rule, ...]) -> list[str]:
    """The words to look up in a text: those that a rule asks for, and those it may start with."""
    return sorted({n for r in usable(catalogue)
                   for n in (*r.needles, *(leads(r.pattern) or [()])[0])})


# What may stand between the start of a match and a lead, from the lead on to the front.
_RUN_BACKWARDS = f"^[{SPACE}]*+[{WORD}]*+"


def lead_places(low: Column, rules: Column, found: Column) -> Column:
    """``ARRAY<STRUCT<lead, at>>``: the first place, from 1, of each lead of the rules that is
    among the found words; each is looked for once, however many rules have it."""
    def place(lead):
        # Cutting finds a literal faster than `position`, which compares at each letter.
        at = let(F.split(low, lead.regex, 2), lambda parts: F.when(
            F.size(parts) == 2, F.length(F.get(parts, F.lit(0))) + 1))
        return F.struct(lead.word.alias("lead"), at.alias("at"))

    asked = F.array_distinct(F.flatten(F.transform(
        F.filter(rules, lambda rule: rule.leads.isNotNull()), lambda rule: rule.leads)))
    return F.transform(F.filter(asked, lambda lead: F.array_contains(found, lead.word)), place)


def first_start(content: Column, places: Column, rule: Column) -> Column:
    """Where in the text the first match of a rule may start, from 1; null if it has none.

    ``places`` are those of the leads, or null if places in the folded text aren't those in the
    text."""
    def start(at):
        before = F.reverse(F.substr(content, F.lit(1), at - 1))
        return F.when(rule.run, at - F.length(
            F.regexp_extract(before, _RUN_BACKWARDS, 0))).otherwise(at)

    own = F.filter(places, lambda p: F.exists(rule.leads, lambda lead: lead.word == p.lead))
    return F.when(rule.leads.isNull() | places.isNull(), 1).otherwise(
        let(F.array_min(F.transform(own, lambda p: p.at)), start))


def rest_of(content: Column, rule: Column) -> Column:
    """The text from the first place on at which the rule may match."""
    return F.when(rule.start == 1, content).otherwise(F.substr(content, rule.start))


def matching_rules(content: Column, needles: Column, catalogue: tuple[Rule, ...],
                   low: Column | None = None) -> Column:
    """The rules that match the text, in catalogue order, but for those that Python has to match.

    ``needles`` are those of ``needles_of`` the catalogue that occur in the folded text.  They are
    bound to a variable, so they are looked up once wherever the expression stands.  With ``low``,
    the folded text, each rule has the place where its first match may start as ``start``.
    """
    def tried(found):
        rules = F.filter(
            rule_array(catalogue),
            lambda rule: (F.size(rule.needles) == 0)
            | F.exists(rule.needles, lambda needle: F.array_contains(found, needle)))
        if low is None:
            return rules

        # A letter that grew by folding moves all places behind it.
        def started(rules):
            places = F.when(F.length(low) == F.length(content), lead_places(low, rules, found))
            return let(places, lambda places: F.filter(
                F.transform(rules, lambda r: r.withField("start", first_start(content, places, r))),
                lambda r: r.start.isNotNull()))

        return let(rules, started)

    return let(needles, lambda found: F.filter(tried(found), lambda rule: let(
        rest_of(content, rule), lambda rest: (rule.guard.isNull() | F.rlike(rest, rule.guard))
        & F.rlike(rest, rule.regex))))


def match_counts(content: Column, rule: Column) -> Column:
    """Per line of the rest of the text, how many matches of the rule start on it."""
    def counts(rest):
        marked = lines_of(F.regexp_replace(rest, rule.regex, F.lit(MARKER + "$0")))
        return F.zip_with(marked, lines_of(rest),
                          lambda m, l: F.octet_length(m) - F.octet_length(l))

    return let(rest_of(content, rule), counts)


def numbered_counts(content: Column, lines: Column, rule: Column) -> Column:
    """``ARRAY<STRUCT<line, n>>``: the lines on which matches of the rule start, and how many."""
    return let(match_counts(content, rule), lambda counts: F.filter(
        F.transform(counts, lambda n, i: F.struct(
            (i + 1 + F.size(lines) - F.size(counts)).alias("line"), n.alias("n"))),
        lambda c: c.n > 0))


def all_matches(content: Column, lines: Column, rule: Column) -> Column:
    """``ARRAY<STRUCT<line, text>>``: each match of the rule in text order."""
    starts = F.flatten(F.transform(numbered_counts(content, lines, rule),
                                   lambda c: F.array_repeat(c.line, c.n)))
    texts = F.regexp_extract_all(rest_of(content, rule), rule.regex, F.lit(0))
    return F.zip_with(starts, texts,
                      lambda line, text: F.struct(line.alias("line"), text.alias("text")))


def line_evidence(line_text: Column) -> Column:
    return excerpt(strip(line_text), EVIDENCE_LENGTH)


HIT_TYPE = PLACE_TYPE


def line_hits(content: Column, lines: Column, rules: Column, more: Column | None = None) -> Column:
    """``ARRAY<STRUCT<line, hits>>``: the lines of one file that have hits, top to bottom; ``more``
    are hits that were found elsewhere.

    ``hits`` is ordered by arrival.  A heuristic adds one hit to a line however often it
    matches there, since its evidence is the line itself; a deterministic rule adds each
    match with its text.
    """
    def hits_of(rule):
        counts = F.transform(
            numbered_counts(content, lines, rule),
            lambda c: F.struct(c.line.alias("line"), rule.ord.alias("ord"), F.lit(1).alias("k"),
                               F.lit(None).cast("string").alias("text")))
        texts = F.transform(
            all_matches(content, lines, rule),
            lambda m, k: F.struct(m.line.alias("line"), rule.ord.alias("ord"),
                                  (k + 1).alias("k"), m.text.alias("text")))
        array_type = f"array<{HIT_TYPE}>"
        return F.when(rule.lane == RULE, texts.cast(array_type)).otherwise(
            counts.cast(array_type))

    found = F.flatten(F.transform(rules, hits_of))
    return let(F.sort_array(found if more is None else F.concat(found, more)), group_by_line)


def group_by_line(hits: Column) -> Column:
    """Cuts hits ordered by line into one element per line, in linear time."""
    starts = F.filter(
        F.sequence(F.lit(1), F.size(hits)),
        lambda i: (i == 1) | (F.get(hits, i - 1).line != F.get(hits, i - 2).line))

    def cut(starts):
        ends = F.concat(F.slice(starts, F.lit(2), F.size(starts)),
                        F.array(F.size(hits) + 1))
        return F.zip_with(starts, ends, lambda a, b: F.struct(
            F.get(hits, a - 1).line.alias("line"),
            F.slice(hits, a, b - a).alias("hits")))

    return F.when(F.size(hits) > 0, let(starts, cut))


def scan_matches(files: DataFrame, catalogue: tuple[Rule, ...] = DEFAULT_CATALOGUE,
                 path: str = "path", content: str = "content",
                 keep: tuple[str, ...] = ()) -> DataFrame:
    """Raw findings: one row per match, with the ``keep`` columns of its file behind.

    ``k`` numbers the matches of one rule in one file.  The evidence of a deterministic rule
    is the matched text; that of a heuristic is the stripped line the match starts on.
    """
    python = fallback_rules(catalogue)
    found = "array<struct<line:int,text:string>>"
    hits = files.where(F.col(content).isNotNull()).select(
        F.col(path).alias("file"), F.col(content).alias("content"),
        *[F.col(c).alias(f"_{c}") for c in keep], folded(F.col(content)).alias("low")
    ).withColumn("needles", let(F.col("low"), lambda t: words_in(t, needles_of(catalogue))))
    matching = matching_rules(F.col("content"), F.col("needles"), catalogue, F.col("low"))
    kept = [f"_{c}" for c in keep]
    if python:
        hits = hits.withColumn("places", python_matches(F.col("content"), F.col("needles"), python))
        matching = F.concat(
            F.transform(matching, lambda r: F.struct(
                r.alias("rule"), F.lit(None).cast(found).alias("found"))),
            F.transform(
                F.array_distinct(F.transform("places", lambda p: p.ord)),
                lambda o: F.struct(
                    F.get(rule_array(catalogue), o - 1).alias("rule"),
                    F.transform(F.filter("places", lambda p: p.ord == o), lambda p: F.struct(
                        p.line.alias("line"), p.text.alias("text"))).alias("found"))))
        hits = hits.select("file", "content", *kept, F.explode(matching).alias("m")).select(
            "file", "content", *kept, "m.rule", "m.found")
    else:
        hits = hits.select("file", "content", *kept, F.explode(matching).alias("rule"))
    rule, text = F.col("rule"), F.col("content")

    def matches(lines):
        if not python:
            return all_matches(text, lines, rule)
        return F.coalesce("found", all_matches(text, lines, rule).cast(found))

    def finding(lines):
        return F.transform(
            matches(lines),
            lambda m, k: F.struct(
                m.line.alias("line"), (k + 1).alias("k"),
                F.when(rule.lane == RULE, m.text)
                .otherwise(line_evidence(F.get(lines, m.line - 1))).alias("evidence")))

    return (
        hits.select("file", "rule", *kept, F.explode(let(lines_of(text), finding)).alias("m"))
        .select(
            "file", "rule.lane", "rule.ord", "m.k", F.col("rule.name").alias("pattern"),
            "rule.finding_type", "rule.severity", "m.evidence", "m.line",
            F.when(rule.lane == HEURISTIC, F.lit(REGEX_CONFIDENCE)).alias("confidence"),
            (rule.needs_escalation & (rule.lane == RULE)).alias("needs_escalation"),
            *[F.col(f"_{c}").alias(c) for c in keep])
    )
