"""The scan: files in, findings out.

    files -> matching rules -> hits per line -> (similarity) -> dedup -> score -> merge

One file is one row, and every step up to the merged findings works inside that row, so the
scan is a single narrow stage: it reads each file once and shuffles nothing.  It needs no
unique path, has no group that could become hot, and runs as it is on a stream.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalogue import (DEFAULT_CATALOGUE, HEURISTIC, RULE, SCORE_TERMS, SEMANTIC,
                         SEMANTIC_PATTERNS, Rule)
from ..functions.context import context_score
from ..functions.prompts import context_window
from ..functions.scoring import (PIPELINE_CONFIDENCE, risk_score, score_terms_in,
                                 should_escalate)
from ..functions.text import let, lines_of, strip
from ..operators.analysis import standard_analysis
from ..operators.embedding_store import line_digest, stored_hits
from ..operators.fallback import as_line_hits, python_matches
from ..operators.linewise import pattern_lane_eligible
from ..operators.matching import (HIT_TYPE, REGEX_CONFIDENCE, fallback_rules, folded,
                                  group_by_line, has_case_extras, line_evidence, line_hits,
                                  matching_rules, needles_of, rule_array, words_in)
from ..operators.merge import SOURCE_TYPE, dedup_heuristics, merge_line
from ..operators.similarity import (HITS_TYPE, PATTERN_THRESHOLD, semantic_patterns,
                                    text_hits)

# Sorts behind every rule; marks a line that the similarity lane wants although no rule hit it.
_NO_RULE = 2**31 - 1
_LINE_COLUMNS = ("file", "line", "findings", "line_score", "window")


def _scan_rows(files, catalogue, path, content, keep, every_line: bool,
               window: bool) -> DataFrame:
    """``(*keep, file, terms, line, hits, text, window)``: one row per line of interest."""
    text = F.col("_content")
    scored = [*dict.fromkeys(t for t, _ in SCORE_TERMS)]
    words = sorted({*needles_of(catalogue), *scored})
    rows = files.where(F.col(content).isNotNull()).select(
        *keep, F.col(path).alias("file"), F.col(content).alias("_content"),
        folded(F.col(content)).alias("low")).withColumn(
        "needles", let(F.col("low"), lambda t: words_in(t, words)))
    rules = matching_rules(text, F.col("needles"), catalogue, F.col("low"))
    python, more, some = fallback_rules(catalogue), None, F.lit(False)
    if python:
        rows = rows.withColumn("places", python_matches(text, F.col("needles"), python))
        more, some = as_line_hits(F.col("places"), python), F.size("places") > 0
    if every_line:
        rows = rows.withColumn("rules", rules)
    else:
        # A file with no matching rule ends here: the explode gives no row for an empty list.
        rows = rows.select("*", F.explode(F.filter(
            F.array(rules), lambda rules: (F.size(rules) > 0) | some)).alias("rules"))

    def with_lines(lines):
        groups = line_hits(text, lines, F.col("rules"), more)
        if every_line:
            wanted = F.filter(
                F.transform(lines, lambda raw, i: F.when(
                    pattern_lane_eligible(strip(raw)),
                    F.struct((i + 1).alias("line"), F.lit(_NO_RULE).alias("ord"),
                             F.lit(0).alias("k"), F.lit(None).cast("string").alias("text")))),
                lambda hit: hit.isNotNull()).cast(f"array<{HIT_TYPE}>")
            flat = F.flatten(F.transform(F.coalesce(groups, F.array()), lambda g: g.hits))
            groups = let(F.sort_array(F.concat(flat, wanted)), group_by_line)
        return F.transform(groups, lambda g: F.struct(
            g.line.alias("line"), g.hits.alias("hits"),
            F.get(lines, g.line - 1).alias("text"),
            (context_window(lines, g.line) if window else F.lit(None).cast("string"))
            .alias("window")))

    # The score terms are looked up once per file, with the needles and ahead of the explode to
    # lines; the text travels no further.  A text with letters changed for the needles is searched
    # again.  Each line carries its file's terms, so needles that score nothing stay behind.
    terms = F.when(has_case_extras(text), let(F.lower(text), score_terms_in)).otherwise(
        F.filter("needles", lambda n: F.array_contains(F.lit(scored), n)))
    return rows.select(
        *keep, "file", "_content", "rules", *(["places"] if python else []), terms.alias("terms")
    ).select(*keep, "file", "terms", F.inline(let(lines_of(text), with_lines)))


def _sources(rules: Column, hits: Column, text: Column, line: Column, lane: str) -> Column:
    """The hits of one regex lane as findings."""
    of_lane = F.filter(hits, lambda h: (h.ord != _NO_RULE)
                       & (F.get(rules, h.ord - 1).lane == lane))

    def finding(h):
        rule = F.get(rules, h.ord - 1)
        return F.struct(
            F.lit(lane).alias("lane"), rule["name"].alias("pattern"),
            rule.finding_type.alias("finding_type"), rule.severity.alias("severity"),
            (h.text if lane == RULE else line_evidence(text)).alias("evidence"),
            line.alias("line"),
            F.lit(None if lane == RULE else REGEX_CONFIDENCE).cast("double")
            .alias("confidence"),
            (rule.needs_escalation if lane == RULE else F.lit(False))
            .alias("needs_escalation"))

    return F.transform(of_lane, finding).cast(f"array<{SOURCE_TYPE}>")


def _semantic_sources(similar: Column, text: Column, line: Column) -> Column:
    patterns = F.from_json(
        F.lit(json.dumps([{"name": p.name, "finding_type": p.finding_type, "severity": p.severity}
                     for p in SEMANTIC_PATTERNS])),
        "array<struct<name:string,finding_type:string,severity:string>>")
    return F.transform(similar, lambda s: F.struct(
        F.lit(SEMANTIC).alias("lane"), F.get(patterns, s.ord - 1)["name"].alias("pattern"),
        F.get(patterns, s.ord - 1).finding_type.alias("finding_type"),
        F.get(patterns, s.ord - 1).severity.alias("severity"),
        line_evidence(text).alias("evidence"), line.alias("line"),
        s.similarity.alias("confidence"), F.lit(False).alias("needs_escalation"),
    )).cast(f"array<{SOURCE_TYPE}>")


def scan_lines(files: DataFrame, catalogue: tuple[Rule, ...] = DEFAULT_CATALOGUE, *,
               embed=None, threshold: float = PATTERN_THRESHOLD, path: str = "path",
               content: str = "content", keep: tuple[str, ...] = (),
               window: bool = False, store: str | None = None) -> DataFrame:
    """One row per line with findings, in front of them the ``keep`` columns of its file.

    ``findings`` are the deduplicated findings of the line in arrival order, ``line_score``
    is the score of the last of them, and ``window`` the numbered lines around (on request).
    Without ``embed`` the scan is regex-only.  With ``store``, a folder of vectors that
    ``operators.embedding_store`` fills, lines are looked up there, and only patterns are embedded.
    """
    rows = _scan_rows(files, catalogue, path, content, keep, embed is not None, window)
    rules, hits = rule_array(catalogue), F.col("hits")
    text, line = F.col("text"), F.col("line")
    heuristic = _sources(rules, hits, text, line, HEURISTIC)
    if embed is not None:
        stripped = strip(text)
        wanted = F.when(pattern_lane_eligible(stripped), stripped)
        if store is None:
            rows = rows.withColumn("similar", text_hits(
                wanted, semantic_patterns(embed), embed, threshold))
        else:
            hits_of = stored_hits(files.sparkSession, store, semantic_patterns(embed), threshold)
            rows = rows.withColumn("digest", line_digest(wanted)).join(
                hits_of, "digest", "left").withColumn(
                "similar", F.coalesce("similar", F.array().cast(HITS_TYPE)))
        # Only here can a finding repeat another one, or lift its confidence.
        heuristic = let(F.concat(heuristic, _semantic_sources(F.col("similar"), text, line)),
                        dedup_heuristics)
    deterministic = _sources(rules, hits, text, line, RULE)
    rows = rows.select(*keep, "file", "line", "terms", "window",
                       F.concat(deterministic, heuristic).alias("findings"))
    if embed is not None:
        rows = rows.where(F.size("findings") > 0)
    last = F.element_at("findings", -1)
    return rows.select(*keep, "file", "line", "findings",
                       risk_score(last.finding_type, F.col("terms")).alias("line_score"),
                       "window")


def is_real(finding: Column) -> Column:
    """Whether the context validator accepts a finding."""
    return context_score(finding.finding_type, finding.evidence).is_vulnerable


def escalated(findings: Column, line_score: Column) -> Column:
    """The findings of a line that deserve a closer look."""
    return F.filter(findings, lambda f: should_escalate(
        line_score, F.lit(PIPELINE_CONFIDENCE), f.needs_escalation))


def merged_findings(lines: DataFrame, *, strict: bool = False, analyse: bool = False,
                    context_filter: bool = False) -> DataFrame:
    """The findings of a scan: one row per (file, line, type).

    The score of a line goes to its first finding, and so does the analysis of the last
    escalated one (``analyse``).  Further columns of ``lines`` are kept.  With ``context_filter`` only findings that the context
    validator accepts are escalated; ``strict`` also drops the others from the result.
    """
    keep = [c for c in lines.columns if c not in _LINE_COLUMNS]
    if strict:
        lines = lines.withColumn("findings", F.filter("findings", is_real)) \
            .where(F.size("findings") > 0)
    explanation = fix = F.lit(None).cast("string")
    if analyse:
        candidates = (F.filter("findings", is_real) if context_filter and not strict
                      else F.col("findings"))
        lines = lines.withColumn("escalated", escalated(candidates, F.col("line_score")))
        last = F.try_element_at("escalated", F.lit(-1))
        answer = standard_analysis(last.finding_type)
        explanation = F.when(F.size("escalated") > 0, answer.explanation)
        fix = F.when(F.size("escalated") > 0, answer.fix_suggestion)
    first = F.col("seq") == 0
    return lines.select(
        *keep, "file", "line", "line_score", explanation.alias("explanation"), fix.alias("fix"),
        F.posexplode(merge_line(F.col("findings"))).alias("seq", "f"),
    ).select(
        *keep, "file", "line", "seq", "f.finding_type", "f.severity", "f.evidence",
        F.when(first, F.col("line_score")).otherwise(F.lit(0.0)).alias("risk_score"),
        "f.needs_escalation", F.when(first, F.col("explanation")).alias("explanation"),
        F.when(first, F.col("fix")).alias("fix_suggestion"), "f.source_details")


def scan(files: DataFrame, catalogue: tuple[Rule, ...] = DEFAULT_CATALOGUE, *, embed=None,
         strict: bool = False, analyse: bool = False, context_filter: bool = False,
         path: str = "path", content: str = "content",
         keep: tuple[str, ...] = (), store: str | None = None) -> DataFrame:
    """Findings of a table of files.  Order it with ``operators.report.report_order``."""
    return merged_findings(
        scan_lines(files, catalogue, embed=embed, path=path, content=content, keep=keep,
                   store=store),
        strict=strict, analyse=analyse, context_filter=context_filter)


def escalations(lines: DataFrame) -> DataFrame:
    """One row per escalated finding of a scan, in arrival order on its line (``k``), with the
    window of lines around it if the scan kept one."""
    return lines.select(
        "file", "line", "line_score", "window",
        F.posexplode(escalated(F.col("findings"), F.col("line_score"))).alias("k", "f"),
    ).select("file", "line", "k", "f.finding_type", "f.severity", "f.evidence", "f.pattern",
             "f.needs_escalation", "line_score", "window")
