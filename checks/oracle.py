"""DuckDB SQL for the registered queries, on the same tables.

The SQL goes its own way where it can: matches come from ``regexp_extract_all`` and line
numbers from the gaps between matches, merges are window functions over rows, and scores are
sums of CASE terms.
"""

from __future__ import annotations

from dataclasses import replace

from flawsieve import catalogue as cat
from flawsieve.functions.context import (MAX_REASONS, NEUTRAL, NOT_A_LITERAL, SIGNALS,
                                         STRONG_ALGORITHMS, TRUSTED_MARKERS)
from flawsieve.functions.prompts import ANSWER_FORMAT
from flawsieve.operators import linewise
from flawsieve.operators.similarity import DETECTOR_THRESHOLD, PATTERN_THRESHOLD
from flawsieve.sources.files import EXTENSIONS, IGNORED_NAMES, MAX_FILE_SIZE

from .corpus import corpus_sql, path_sql, quoted
from .queries import CONDITIONAL_CATALOGUE, EDITED_CATALOGUE

# The conditional rules without conditions, for RE2.
_PLAIN_FORMS = {"F001": r'secret = "s\d+|"k\d+', "keyed_call": r"\.load\(|exec\("}
PLAIN_CATALOGUE = tuple(replace(r, pattern=_PLAIN_FORMS.get(r.name, r.pattern))
                        for r in CONDITIONAL_CATALOGUE)

# White space and word characters of Unicode text, for RE2.
_SPACE = (r"\t-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}"
          r"\x{205F}\x{3000}")
_WORD = r"\pL\pN_"


def re2(pattern: str, ignore_case: bool = False) -> str:
    # RE2 has no lookahead; the only one in use never changes where a match starts.
    p = pattern.replace("(?!session)", "")
    p = p.replace(r"\w", f"[{_WORD}]").replace(r"\s", f"[{_SPACE}]")
    return ("(?mi)" if ignore_case else "(?m)") + p


def strip_sql(text: str) -> str:
    return f"regexp_replace({text}, '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g')"


def rules_sql(catalogue) -> str:
    rows = ",\n".join(
        f"({i}, {quoted(r.lane)}, {quoted(r.name)}, "
        f"{quoted(re2(r.pattern, r.lane == cat.HEURISTIC))}, {quoted(r.finding_type)}, "
        f"{quoted(r.severity)}, {'TRUE' if r.needs_escalation else 'FALSE'})"
        for i, r in enumerate(catalogue, 1))
    return f"SELECT * FROM (VALUES {rows}) r(ord, lane, pattern, re, finding_type, severity, esc)"


def newlines(text: str) -> str:
    return f"(length({text}) - length(replace({text}, chr(10), '')))"


def raw(catalogue=cat.DEFAULT_CATALOGUE, files: str | None = None) -> str:
    """CTEs up to ``raw``: one row per match."""
    return f"""
files AS ({files or corpus_sql()}),
rules AS ({rules_sql(catalogue)}),
hits AS (SELECT f.path, f.content, r.* FROM files f, rules r
         WHERE regexp_matches(f.content, r.re)),
parts AS (SELECT *, regexp_extract_all(content, re) AS texts,
                 string_split_regex(content, re) AS gaps FROM hits),
places AS (SELECT *, unnest(list_transform(range(1, len(texts) + 1), lambda i: {{
    'k': i, 'text': texts[i],
    'line': CAST(1 + list_sum(list_transform(gaps[1:i], lambda g: {newlines('g')}))
                 + coalesce(list_sum(list_transform(texts[1:i - 1],
                                                    lambda t: {newlines('t')})), 0)
                 AS BIGINT)}})) AS m
           FROM parts),
raw AS (SELECT path AS file, lane, CAST(ord AS INTEGER) AS ord, CAST(m.k AS INTEGER) AS k,
               pattern, finding_type, severity,
               CASE WHEN lane = 'rule' THEN m.text
                    ELSE substring({strip_sql("string_split(content, chr(10))[m.line]")}, 1, 100)
               END AS evidence,
               CAST(m.line AS INTEGER) AS line,
               CASE WHEN lane = 'heuristic' THEN CAST(0.7 AS DOUBLE) END AS confidence,
               esc AND lane = 'rule' AS needs_escalation, CAST(ord AS BIGINT) * 1000000000 + m.k AS seq
        FROM places)"""


def source_corpus() -> str:
    names = ", ".join(map(quoted, IGNORED_NAMES))
    endings = ", ".join(map(quoted, EXTENSIONS))
    return f"""SELECT *, regexp_extract(path, '[^/.][^/]*(\\.[^/.]+)$', 1) AS extension
FROM ({corpus_sql()}) c
WHERE NOT list_has_any(string_split(path, '/'), [{names}])
  AND regexp_extract(path, '[^/.][^/]*(\\.[^/.]+)$', 1) IN ({endings})
  AND strlen(content) <= {MAX_FILE_SIZE}"""


def rank(severity: str) -> str:
    return (f"CASE {severity} WHEN 'Critical' THEN 3 WHEN 'High' THEN 2 WHEN 'Medium' THEN 1 "
            "ELSE 0 END")


def score_sql(finding_type: str, text: str) -> str:
    """``text`` is lower case."""
    terms = " + ".join(
        f"CASE WHEN contains({text}, {quoted(t)}) OR contains(lower({finding_type}), {quoted(t)})"
        f" THEN CAST({w} AS DOUBLE) ELSE CAST(0 AS DOUBLE) END" for t, w in cat.SCORE_TERMS)
    return f"least(CAST(1 AS DOUBLE), CAST(0.5 AS DOUBLE) + {terms})"


def kept(source: str = "raw") -> str:
    """CTEs from matches to deduplicated findings with the score of their line.

    ``lane_rank`` puts deterministic findings first; of those all stay, as each is scored.
    """
    return f"""
kept AS (SELECT *, CASE lane WHEN 'rule' THEN 0 ELSE 1 END AS lane_rank FROM {source}
         QUALIFY lane = 'rule' OR row_number() OVER (
             PARTITION BY file, line, finding_type, pattern, lane = 'rule' ORDER BY seq) = 1),
last_type AS (SELECT file, line, max_by(finding_type, (lane_rank, seq)) AS scored_type
              FROM kept GROUP BY file, line),
scored AS (SELECT l.file, l.line, l.scored_type, {score_sql('l.scored_type', 'f.low')}
               AS line_score
           FROM last_type l JOIN (SELECT path, lower(content) AS low FROM files) f
             ON f.path = l.file)"""


def merged(findings: str = "kept") -> str:
    """CTEs to ``merged``: one row per (file, line, type)."""
    return f"""
sourced AS (SELECT * FROM {findings}
            QUALIFY lane <> 'rule' OR row_number() OVER (
                PARTITION BY file, line, finding_type, lane ORDER BY seq) = 1),
grouped AS (SELECT file, line, finding_type,
                   min_by(evidence, (lane_rank, seq)) AS evidence,
                   min_by(severity, (-({rank('severity')}), lane_rank, seq)) AS severity,
                   min_by(needs_escalation, (lane_rank, seq)) AS needs_escalation,
                   min((lane_rank, seq)) AS arrival,
                   string_agg(lane || ':' || pattern, ',' ORDER BY lane_rank, seq) AS sources
            FROM sourced GROUP BY file, line, finding_type),
merged AS (SELECT *, CAST(row_number() OVER (PARTITION BY file, line ORDER BY arrival) - 1
                          AS INTEGER) AS seq
           FROM grouped)"""


REPORT = """m.file, m.line, m.seq, m.finding_type, m.severity, m.evidence,
CASE WHEN m.seq = 0 THEN s.line_score ELSE CAST(0 AS DOUBLE) END AS risk_score,
m.needs_escalation, m.sources"""


def report(files: str | None = None, extra: str = "", tail: str = "",
           catalogue=cat.DEFAULT_CATALOGUE) -> str:
    return (f"WITH {raw(catalogue, files)}, {kept()}, {merged()}\nSELECT {REPORT}{extra} "
            f"FROM merged m JOIN scored s ON m.file = s.file AND m.line = s.line{tail}")


def escalated(candidates: str = "kept") -> str:
    return f"""
escalated AS (SELECT e.*, s.line_score,
                     CAST(row_number() OVER (PARTITION BY e.file, e.line
                          ORDER BY lane_rank, seq) - 1 AS INTEGER) AS ek
              FROM {candidates} e JOIN scored s ON e.file = s.file AND e.line = s.line
              WHERE e.needs_escalation OR s.line_score >= 0.8)"""


def explanation(finding_type: str, which: int) -> str:
    cases = " ".join(f"WHEN {quoted(t)} THEN {quoted(texts[which])}"
                     for t, texts in cat.STANDARD_ANALYSIS.items())
    return f"CASE {finding_type} {cases} ELSE {quoted(cat.DEFAULT_ANALYSIS[which])} END"


LAST_ESCALATED = """
last_escalated AS (SELECT file, line, max_by(finding_type, (lane_rank, seq)) AS t
                   FROM escalated GROUP BY file, line)"""


def analysed(which: int) -> str:
    return f"CASE WHEN m.seq = 0 AND a.t IS NOT NULL THEN {explanation('a.t', which)} END"


def context_sql(source: str) -> str:
    """``source`` with is_vulnerable, confidence and reasons."""
    e, t = "evidence", "finding_type"
    has = lambda text: f"contains({e}, {quoted(text)})"
    low = lambda text: f"contains(lower({e}), {quoted(text)})"
    up = lambda text: f"contains(upper({e}), {quoted(text)})"
    any_of = lambda f, words: "(" + " OR ".join(f(w) for w in words) + ")"
    of = lambda name: f"{t} = {quoted(name)}"
    o: list[tuple[str, float, str | None]] = []
    for s in SIGNALS:
        seen = f"regexp_matches({e}, {quoted(re2(s))})"
        branch = (f"CASE WHEN {has('request.')} THEN 1 WHEN {has('%')} AND "
                  f"{has('render_template_string')} THEN 2 WHEN {has('+')} AND "
                  f"{any_of(up, ('WHERE', 'SELECT', 'FROM'))} THEN 3 ELSE 0 END")
        o += [(f"{seen} AND {branch} = 1", 0.25, "takes data from the request"),
              (f"{seen} AND {branch} = 2", 0.25, "formats a template string"),
              (f"{seen} AND {branch} = 3", 0.4, "joins SQL text")]
    o.append((any_of(low, TRUSTED_MARKERS), -0.3, "takes data from a trusted source"))
    o.append((f"{of('SQL Injection')} AND ({has('?')} OR {has(', (')})", -0.4,
              "binds query parameters"))
    o.append((f"{of('SQL Injection')} AND {has('+')} AND ({up('SELECT')} OR {up('FROM')})",
              0.2, "joins strings in SQL"))
    chains = {
        "XSS": [(f"({low('escape')} OR {low('markupsafe')})", -0.4, "escapes the output"),
                (f"({has('render_template(')} AND NOT {has('render_template_string')})", -0.3,
                 "uses page templates"),
                (f"({has('render_template_string')} AND {has('%s')})", 0.2, None)],
        "Command Injection": [(has("shell=True"), 0.3, None),
                              (has("shell=False"), -0.4, "runs without a shell"),
                              (has("["), -0.3, "passes a list of arguments")],
        "Weak Cryptography": [(any_of(low, STRONG_ALGORITHMS), -0.4,
                               "uses a strong algorithm"),
                              (f"({low('md5')} OR {low('sha1')})", 0.3,
                               "uses a weak algorithm")],
        "Secrets Leak": [(has("environ.get"), -0.4, "reads the environment"),
                         (has("getpass.getpass"), -0.3, "asks for the value"),
                         (f"({has('=')} AND {has(chr(34))} AND "
                          f"length(split_part({e}, chr(34), 2)) > 10 AND NOT "
                          f"{any_of(low, NOT_A_LITERAL)})", 0.2, None)],
    }
    for name, chain in chains.items():
        for i, (cond, amount, reason) in enumerate(chain):
            before = "".join(f" AND NOT {c}" for c, _, _ in chain[:i])
            o.append((f"{of(name)} AND {cond}{before}", amount, reason))
    total = " + ".join([f"CAST({NEUTRAL} AS DOUBLE)"] + [
        f"CASE WHEN {c} THEN CAST({a} AS DOUBLE) ELSE CAST(0 AS DOUBLE) END" for c, a, _ in o])
    reasons = ", ".join(f"CASE WHEN {c} THEN {quoted(r)} END" for c, _, r in o if r)
    return f"""
judged AS (SELECT *, greatest(0, least(1, {total})) AS context,
                  list_filter([{reasons}], lambda r: r IS NOT NULL)[1:{MAX_REASONS}] AS why
           FROM {source})"""


def window_sql(content: str, line: str) -> str:
    lines = f"string_split({content}, chr(10))"
    return (f"array_to_string(list_transform(range(greatest(0, {line} - 10) + 1, "
            f"least(len({lines}), {line} + 10) + 1), "
            f"lambda i: i || ': ' || {lines}[i]), chr(10))")


def prompt_sql(window: str) -> str:
    return (f"'A scan marked line ' || line || ' as ' || finding_type || ', ' || severity || "
            f"', because of this text:' || chr(10) || '    ' || evidence || chr(10) || "
            f"'The lines around it:' || chr(10) || chr(10) || {window} || chr(10) || chr(10) || "
            f"'Is the mark right, and what would make the code safe?' || chr(10)")


def document_sql(window: str) -> str:
    return (f"file || ':' || line || ' | ' || finding_type || ' | ' || severity || ' | ' || "
            f"evidence || chr(10) || chr(10) || {prompt_sql(window)} || {quoted(ANSWER_FORMAT)}")


KEY = "replace(finding_type, ' ', '_') || '_line' || line"


def parsed_answer(text: str, which: str) -> str:
    lines = f"string_split({text}, chr(10))"
    at = (f"list_position(list_transform({lines}, lambda l: contains(lower(l), 'fix') OR "
          f"contains(lower(l), 'solution')), TRUE)")
    if which == "explanation":
        part = f"CASE WHEN {at} IS NULL OR {at} = 0 THEN {lines} ELSE {lines}[1:{at} - 1] END"
        return f"substring({strip_sql(f'array_to_string({part}, chr(10))')}, 1, 500)"
    fix = f"array_to_string({lines}[{at}:], chr(10))"
    return f"CASE WHEN {at} > 0 THEN substring({strip_sql(fix)}, 1, 500) END"


COUNTS = ("count(*) AS total_findings, count(*) FILTER (severity = 'Critical') AS "
          "critical_count, count(*) FILTER (severity = 'High') AS high_count, "
          "count(*) FILTER (severity = 'Medium') AS medium_count, "
          "count(*) FILTER (severity = 'Low') AS low_count")


def file_lines_sql() -> str:
    return f"""
files AS ({corpus_sql()}),
numbered AS (SELECT path AS file, unnest(list_transform(
                 range(1, len(string_split(content, chr(10))) + 1),
                 lambda i: {{'line': i, 'raw': string_split(content, chr(10))[i]}})) AS l
             FROM files),
lines AS (SELECT file, CAST(l.line AS INTEGER) AS line, {strip_sql('l.raw')} AS text
          FROM numbered)"""


def keyword_sql() -> str:
    count = lambda words: " + ".join(
        f"CAST(contains(lower(text), {quoted(w)}) AS INTEGER)" for w in words)
    tiers = " ".join(f"WHEN {count(words)} >= {linewise.MIN_KEYWORDS} THEN {quoted(name)}"
                     for name, words in cat.SENSITIVE_KEYWORDS.items())
    return f"""WITH {file_lines_sql()},
tiered AS (SELECT *, CASE WHEN NOT contains(text, '=') THEN NULL {tiers} END AS severity
           FROM lines)
SELECT file, line, 'Sensitive Data' AS finding_type, severity,
       substring(text, 1, 80) AS evidence, CAST(0.6 AS DOUBLE) AS confidence,
       'keyword' AS method
FROM tiered WHERE severity IS NOT NULL"""


RAW_CONFIDENT = """
confident AS (SELECT * REPLACE (CAST(0.5 AS DOUBLE) + ((k * 7 + ord * 3) % 10) / 20.0
                                AS confidence) FROM raw)"""

CENTROIDS = """
centroids AS (SELECT label, list(m ORDER BY i) AS centre FROM (
                  SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m
                  FROM embeddings, range(1, 65) r(i) GROUP BY label, i) GROUP BY label),
sims AS (SELECT vec_id, CAST(c.label AS INTEGER) AS ord, e.label AS own,
                list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), c.centre) AS similarity
         FROM embeddings e, centroids c)"""


def requests_sql() -> str:
    code = "text || chr(10) || 'eval(x)' || chr(10) || 'DEBUG = True'"
    base = lambda p: f"regexp_extract({p}, '([^/]*)$', 1)"
    inline = (f"SELECT 'r' || doc_id AS path, {code} AS content FROM documents "
              f"WHERE doc_id % 7 IN (0, 1)")
    both = (f"SELECT path, content FROM ({corpus_sql()}) c UNION ALL {inline}")
    named = ", ".join(map(quoted, IGNORED_NAMES))
    endings = ", ".join(map(quoted, EXTENSIONS))
    counts = [f"{s}_count" for s in ("critical", "high", "medium", "low")]
    number = lambda c: f"coalesce({c}, 0)"
    return f"""WITH {raw(files=both)}, {kept()}, {merged()},
per_file AS (SELECT file, {COUNTS} FROM merged GROUP BY file),
source AS (SELECT path, NOT list_has_any(string_split(path, '/'), [{named}]) AND
                  regexp_extract(path, '[^/.][^/]*(\\.[^/.]+)$', 1) IN ({endings}) AND
                  strlen(content) <= {MAX_FILE_SIZE} AS is_source
           FROM ({corpus_sql()}) c),
request AS (SELECT doc_id AS request_id, doc_id % 7 AS kind,
                   CASE WHEN doc_id % 7 = 0 THEN 'analyze_code'
                        WHEN doc_id % 7 <= 3 THEN 'analyze_file'
                        WHEN doc_id % 7 = 4 THEN 'analyze_repository'
                        WHEN doc_id % 7 = 5 THEN 'explain' ELSE '' END AS method,
                   {path_sql('doc_id')} AS own,
                   ['src', 'web', 'src/app', '.', 'none', 'docs'][doc_id % 6 + 1] AS folder
            FROM documents),
folders AS (SELECT r.folder, count(*) AS files_scanned,
                   {', '.join(f'CAST(sum(coalesce(p.{c}, 0)) AS BIGINT) AS {c}'
                              for c in ['total_findings', *counts])}
            FROM (SELECT DISTINCT folder FROM request WHERE kind = 4) r
            JOIN source s ON s.is_source AND (r.folder = '.' OR
                                              starts_with(s.path, r.folder || '/'))
            LEFT JOIN per_file p ON p.file = s.path GROUP BY r.folder)
SELECT request_id, method,
       CASE WHEN kind = 6 THEN 'invalid JSON' WHEN kind = 5 THEN 'unknown method: explain'
            WHEN kind = 3 THEN 'file not found: ' || own || '.gone'
            WHEN kind = 4 AND d.folder IS NULL THEN 'no such directory: ' || r.folder
       END AS error,
       {', '.join(f'''CASE WHEN kind <= 2 THEN {number('p.' + c)}
            WHEN kind = 4 AND d.folder IS NOT NULL THEN d.{c} END AS {c}'''
                  for c in ['total_findings', *counts])},
       CASE WHEN kind <= 2 THEN 1 WHEN kind = 4 THEN d.files_scanned END AS files_scanned
FROM request r
LEFT JOIN per_file p ON p.file = CASE WHEN kind <= 1 THEN 'r' || request_id
                                      WHEN kind = 2 THEN own END
LEFT JOIN folders d ON kind = 4 AND d.folder = r.folder"""


def similar_lines(eligible: str, patterns: list[tuple]) -> str:
    """CTEs to ``alike (text, ord, name, finding_type, severity, similarity)``: the cosine of
    each different line with each pattern ``(name, type, severity, text)``, by the counts of hashed
    trigrams of letters and digits."""
    def counts(texts):
        return f"""(SELECT id, h, count(*) AS n FROM (
  SELECT id, (961 * ascii(w[i]) + 31 * ascii(w[i + 1]) + ascii(w[i + 2])) % 256 AS h
  FROM (SELECT id, w, unnest(range(1, length(w) - 1)) AS i FROM (
    SELECT id, regexp_replace(' ' || lower(text) || ' ', '[^a-z0-9]+', ' ', 'g') AS w
    FROM {texts}) a) b) c GROUP BY id, h)"""

    rows = ", ".join(f"({i}, {quoted(n)}, {quoted(t)}, {quoted(s)}, {quoted(d)})"
                     for i, (n, t, s, d) in enumerate(patterns, 1))
    return f"""{file_lines_sql()},
described AS (SELECT * FROM (VALUES {rows}) d(id, name, finding_type, severity, text)),
texts AS (SELECT row_number() OVER () AS id, text FROM (
  SELECT DISTINCT text FROM lines WHERE {eligible}) t),
lc AS {counts('texts')}, pc AS {counts('described')},
ln AS (SELECT id, sqrt(sum(n * n)) AS norm FROM lc GROUP BY id),
pn AS (SELECT id, sqrt(sum(n * n)) AS norm FROM pc GROUP BY id),
products AS (SELECT lc.id, pc.id AS ord, sum(lc.n * pc.n) AS dot
             FROM lc JOIN pc USING (h) GROUP BY lc.id, pc.id),
alike AS (SELECT t.text, ord, name, finding_type, severity,
                   CAST(dot AS DOUBLE) / (ln.norm * pn.norm) AS similarity
            FROM products p JOIN ln ON ln.id = p.id JOIN pn ON pn.id = ord
            JOIN texts t ON t.id = p.id JOIN described d ON d.id = ord)"""


def semantic_sql() -> str:
    patterns = [(p.name, p.finding_type, p.severity, p.text) for p in cat.SEMANTIC_PATTERNS]
    eligible = ("length(text) >= 10 AND NOT starts_with(text, '#') "
                "AND NOT starts_with(text, '\"\"\"')")
    return f"""WITH {raw()}, {similar_lines(eligible, patterns).replace('files AS', 'files2 AS')},
both_lanes AS (SELECT * FROM raw UNION ALL
  SELECT file, 'semantic', ord, 1, name, finding_type, severity, substring(text, 1, 100), line,
         similarity, FALSE, 1000000000000000000 + ord
  FROM lines JOIN alike USING (text) WHERE similarity > {PATTERN_THRESHOLD}),
{kept('both_lanes')}, {merged()}
SELECT {REPORT} FROM merged m JOIN scored s ON m.file = s.file AND m.line = s.line"""


def detector_sql() -> str:
    patterns = [("", t, "", d) for t, ds in cat.DETECTOR_DESCRIPTIONS.items() for d in ds]
    eligible = "length(text) >= 5 AND NOT starts_with(text, '#') AND NOT starts_with(text, '//')"
    critical = "'Secrets Leak', 'SQL Injection', 'Injection', 'Insecure Deserialization'"
    high = "'Command Injection', 'Path Traversal', 'SSRF', 'XSS'"
    return f"""WITH {similar_lines(eligible, patterns)},
best AS (SELECT text, min_by(finding_type, (-similarity, ord)) AS finding_type,
                max(similarity) AS similarity FROM alike GROUP BY text
         HAVING max(similarity) > {DETECTOR_THRESHOLD})
SELECT file, line, substring(text, 1, 80) AS evidence, finding_type,
       CASE WHEN finding_type IN ({critical}) THEN 'Critical' WHEN finding_type IN ({high})
            THEN 'High' ELSE 'Medium' END AS severity,
       round(similarity, 6) AS confidence, 'semantic' AS method
FROM lines JOIN best USING (text)
UNION ALL BY NAME SELECT * FROM ({keyword_sql()}) k"""


TREE = f"""SELECT CASE WHEN doc_id % 3 = 0 THEN 'wide/mod_' || doc_id || '.py'
            ELSE 'deep/' || repeat('d/', (doc_id // 3) % 12)
                 || CASE WHEN doc_id % 30 = 1 THEN 'node_modules/' ELSE '' END || 'mod_' || doc_id
                 || CASE WHEN doc_id % 3 = 1 THEN '.js' ELSE '.txt' END END AS path, content
FROM ({corpus_sql()}) c"""


def oracles() -> dict[str, str]:
    all_raw = raw()
    src = source_corpus()
    classify = " ".join(
        f"({quoted(t)}, {quoted(level)}, {quoted(risk)}, {quoted(text)}, "
        f"{quoted('|'.join(examples[:3]))}, {quoted(fix)}),"
        for t, level, risk, text, examples, fix in cat.CLASSIFICATION).rstrip(",")
    level, risk, text, _, fix = cat.UNKNOWN_CLASSIFICATION
    alternatives = " ".join(f"WHEN {quoted(t)} THEN {quoted('|'.join(a))}"
                            for t, a in cat.SAFE_ALTERNATIVES.items())
    with_analysis = (f"LEFT JOIN last_escalated a ON a.file = m.file AND a.line = m.line")
    pages = "SELECT url AS path, html AS content FROM pages"
    plain = "SELECT CAST(doc_id AS VARCHAR) AS path, text AS content FROM documents"
    scan_report = (
        f"WITH {raw(files=src)}, {kept()}, {escalated()}, {LAST_ESCALATED}, {merged()}\n"
        f"SELECT {REPORT}, {analysed(0)} AS explanation, {analysed(1)} AS fix_suggestion "
        f"FROM merged m JOIN scored s ON m.file = s.file AND m.line = s.line {with_analysis}")
    summary = f"""WITH {raw(files=src)}, {kept()}, {merged()}
SELECT {COUNTS}, (SELECT count(*) FROM files) AS files_scanned FROM merged"""
    windows = f"""WITH {raw(files=src)}, {kept()}, {escalated()},
windowed AS (SELECT e.file, e.line, e.ek AS k, e.finding_type, e.severity, e.evidence,
                    {window_sql('f.content', 'e.line')} AS win
             FROM escalated e JOIN files f ON f.path = e.file)"""
    answers = (f"answers AS (SELECT {path_sql('conv_id')} AS file, max_by(text, turn) || chr(10) || "
               f"'Fix: ' || max_by(text, turn) AS answer FROM conversations WHERE role = 'assistant' "
               f"GROUP BY conv_id)")
    routed = f"""{answers},
routed AS (SELECT e.file, e.line, e.ek AS k, e.finding_type,
                  CASE WHEN a.answer IS NOT NULL THEN {parsed_answer('a.answer', 'explanation')}
                       ELSE {explanation('e.finding_type', 0)} END AS explanation,
                  CASE WHEN a.answer IS NOT NULL THEN {parsed_answer('a.answer', 'fix')}
                       ELSE {explanation('e.finding_type', 1)} END AS fix_suggestion,
                  CASE WHEN a.answer IS NOT NULL THEN CAST(0.7 AS DOUBLE)
                       ELSE CAST(0.4 AS DOUBLE) END AS confidence
           FROM escalated e LEFT JOIN answers a ON a.file = e.file)"""
    real = f"""{context_sql('raw')},
real AS (SELECT * EXCLUDE (context, why) FROM judged WHERE context > {NEUTRAL})"""
    dedup_types = """
firsts AS (SELECT *, row_number() OVER (PARTITION BY file, line, finding_type, pattern
                                        ORDER BY seq) AS rn FROM confident)"""

    return {
        "rule_scan": f"""WITH {raw(cat.DETERMINISTIC_RULES)}
SELECT file, ord, k, pattern AS rule_id, finding_type, severity, evidence, line,
       needs_escalation FROM raw""",
        "heuristic_scan": f"""WITH {raw(cat.HEURISTIC_RULES)}
SELECT file, ord, k, pattern, finding_type, severity, evidence, line, confidence FROM raw""",
        "custom_rule_scan": f"""WITH {raw(tuple(r for r in EDITED_CATALOGUE
                                                if r.lane == cat.RULE))}
SELECT file, k, pattern AS rule_id, finding_type, evidence, line FROM raw""",
        "directory_scan": report(
            f"SELECT * FROM ({TREE}) t WHERE path NOT LIKE '%node_modules%' AND path NOT LIKE "
            f"'%.txt' AND strlen(content) <= {MAX_FILE_SIZE}"),
        "directory_entries": f"""SELECT status, count(*) AS entries FROM (
  SELECT CASE WHEN path LIKE '%node_modules/%' THEN 'excluded' WHEN path LIKE '%.txt'
              THEN 'extension' WHEN strlen(content) > {MAX_FILE_SIZE} THEN 'size' ELSE 'file' END
         AS status, CASE WHEN path LIKE '%node_modules/%' THEN
         regexp_replace(path, '/mod_.*', '') ELSE path END AS entry FROM ({TREE}) t
  GROUP BY ALL) e GROUP BY status""",
        "fallback_rule_scan": report(catalogue=PLAIN_CATALOGUE),
        "fallback_matches": f"""WITH {raw(PLAIN_CATALOGUE)}
SELECT file, ord, k, lane, pattern, evidence, line, needs_escalation FROM raw""",
        "web_page_scan": f"""WITH {raw(files=pages)}
SELECT file, pattern, count(*) AS matches, min(line) AS first_line FROM raw
GROUP BY file, pattern""",
        "document_scan": report(plain),
        "path_filter": f"SELECT path, extension, CAST(strlen(content) AS INTEGER) AS bytes FROM ({src}) s",
        "lenient_decode": """SELECT doc_id, md5(content) AS digest,
       CAST(length(content) AS INTEGER) AS chars
FROM (SELECT doc_id, regexp_replace('a' || chr(10) || 'b' || chr(10) || 'c' || text || '(',
                                    '\\r\\n?', chr(10), 'g') AS content FROM documents) d""",
        "eligible_lines": f"""WITH {file_lines_sql()}
SELECT file, count(*) AS lines,
       count(*) FILTER (length(text) >= 10 AND NOT starts_with(text, '#')
                        AND NOT starts_with(text, '\"\"\"')) AS pattern_lane,
       count(*) FILTER (length(text) >= 5 AND NOT starts_with(text, '#')
                        AND NOT starts_with(text, '//')) AS detector
FROM lines GROUP BY file""",
        "heuristic_dedup": f"""WITH {raw(cat.HEURISTIC_RULES)}, {RAW_CONFIDENT}, {dedup_types},
lifted AS (SELECT *, greatest(confidence, max(CASE WHEN rn > 1 THEN confidence END) OVER (
               PARTITION BY file, line, finding_type ORDER BY seq
               ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)) AS best FROM firsts)
SELECT file, line, finding_type, pattern, severity, evidence, round(best, 6) AS confidence
FROM lifted WHERE rn = 1""",
        "detector_merge": f"""WITH {raw(cat.HEURISTIC_RULES)}, {RAW_CONFIDENT}
SELECT file, line, finding_type, min_by(severity, seq) AS severity,
       min_by(evidence, seq) AS evidence, round(max(confidence), 6) AS confidence
FROM confident GROUP BY file, line, finding_type""",
        "table_merge": f"""WITH {all_raw}, {kept()}, {merged()},
last_score AS (SELECT file, line, max_by(length(evidence) / 100.0, seq) AS line_score
               FROM raw GROUP BY file, line)
SELECT {REPORT} FROM merged m JOIN last_score s ON m.file = s.file AND m.line = s.line""",
        "risk_scores": f"""WITH {all_raw}, {kept()}
SELECT file, line, line_score, scored_type FROM scored""",
        "score_rows": f"""WITH {all_raw},
scores AS (SELECT *, {score_sql('finding_type', "lower(evidence || ' ' || content)")} AS score
           FROM raw JOIN files ON path = file)
SELECT file, ord, k, finding_type,
       CASE WHEN score >= 0.8 THEN 'Critical' WHEN score >= 0.65 THEN 'High'
            WHEN score >= 0.5 THEN 'Medium' ELSE severity END AS severity,
       substring(evidence, 1, 100) AS evidence, line, score,
       least(abs(score - 0.5) * 2, CAST(1 AS DOUBLE)) * CAST(0.8 AS DOUBLE) AS confidence
FROM scores""",
        "escalation": f"""WITH {raw(files=src)}, {kept()}, {escalated()}
SELECT file, line, ek AS k, finding_type, pattern, needs_escalation, line_score
FROM escalated""",
        "escalation_lookup": f"""WITH {all_raw},
last_score AS (SELECT file, line, max_by(length(evidence) / 50.0, seq) AS score
               FROM raw WHERE lane = 'rule' GROUP BY file, line)
SELECT r.file, r.line, r.seq, r.pattern, r.needs_escalation,
       coalesce(s.score, 0.5) AS line_score,
       r.needs_escalation OR coalesce(s.score, 0.5) >= 0.8 AS escalate
FROM raw r LEFT JOIN last_score s ON s.file = r.file AND s.line = r.line""",
        "merged_findings": report(),
        "scan_report": scan_report,
        "ordered_report": report(src, f", row_number() OVER (ORDER BY m.file, "
                                      f"{rank('m.severity')} DESC, m.line DESC, m.seq) AS rank"),
        "filtered_report": (
            f"WITH {raw(files=src)}, {real}, {kept('real')}, {escalated()}, {LAST_ESCALATED}, "
            f"all_kept AS (SELECT * FROM raw), {merged()}, "
            f"{_unfiltered_scores()}\n"
            f"SELECT {REPORT}, {_analysed_by('f')} AS explanation FROM merged m "
            f"JOIN full_scored s ON m.file = s.file AND m.line = s.line "
            f"LEFT JOIN full_escalated f ON f.file = m.file AND f.line = m.line"),
        "code_report": (
            f"WITH {raw(files=src)}, {kept()}, {context_sql('kept')}, "
            f"real AS (SELECT * FROM judged WHERE context > {NEUTRAL}), {escalated('real')}, "
            f"{LAST_ESCALATED}, {merged()}\n"
            f"SELECT {REPORT}, {analysed(0)} AS explanation FROM merged m JOIN scored s "
            f"ON m.file = s.file AND m.line = s.line {with_analysis}"),
        "report_summary": summary,
        "gate": f"""SELECT CAST(CASE WHEN critical_count > 0 THEN 2 WHEN high_count > 0 THEN 1
                 ELSE 0 END AS INTEGER) AS exit_code FROM ({summary}) s""",
        "top_findings": f"""SELECT file, line, seq, finding_type, severity,
       substring(evidence, 1, 60) AS evidence, substring(explanation, 1, 100) AS explanation,
       substring(fix_suggestion, 1, 80) AS fix_suggestion
FROM ({scan_report}) r ORDER BY file, {rank('severity')} DESC, line DESC, seq LIMIT 20""",
        "json_report": f"""WITH {all_raw}, {kept()}, {merged()},
details AS (SELECT file, line, finding_type, list({{
                'lane': lane, 'pattern': pattern, 'finding_type': finding_type,
                'severity': severity, 'evidence_span': evidence, 'line': line,
                'confidence': confidence, 'needs_escalation': needs_escalation}}
                ORDER BY lane_rank, seq) AS d FROM sourced GROUP BY file, line, finding_type)
SELECT m.file, CAST(to_json({{
    'finding_type': m.finding_type, 'severity': m.severity, 'evidence_span': m.evidence,
    'line': m.line, 'file': m.file,
    'risk_score': CASE WHEN m.seq = 0 THEN round(s.line_score, 2) ELSE CAST(0 AS DOUBLE) END,
    'needs_escalation': m.needs_escalation, 'llm_explanation': NULL, 'fix_suggestion': NULL,
    'source_details': d.d}}) AS VARCHAR) AS json
FROM merged m JOIN scored s ON m.file = s.file AND m.line = s.line
JOIN details d ON d.file = m.file AND d.line = m.line AND d.finding_type = m.finding_type""",
        "context_validate": f"""WITH {all_raw}, {context_sql('raw')}
SELECT file, ord, k, finding_type, context > {NEUTRAL} AS is_vulnerable,
       round(abs(context - {NEUTRAL}) * 2, 9) AS confidence,
       array_to_string(why, '; ') AS reasons FROM judged""",
        "classified_findings": f"""WITH {all_raw}, {kept()}, {merged()}
SELECT m.file, m.line, m.finding_type, coalesce(c.level, {quoted(level)}) AS severity,
       CAST(0.8 AS DOUBLE) AS confidence,
       CAST(CASE coalesce(c.level, {quoted(level)}) WHEN 'CRITICAL' THEN 5 WHEN 'HIGH' THEN 4
            WHEN 'MEDIUM' THEN 3 WHEN 'LOW' THEN 2 WHEN 'INFO' THEN 1 ELSE 0 END AS INTEGER)
           AS level,
       coalesce(c.risk, {quoted(risk)}) AS risk,
       coalesce(c.description, {quoted(text)}) AS description,
       coalesce(c.examples, '') AS examples, coalesce(c.fix, {quoted(fix)}) AS fix
FROM merged m LEFT JOIN (VALUES {classify})
     c(finding_type, level, risk, description, examples, fix)
  ON c.finding_type = m.finding_type""",
        "safe_alternatives": f"""WITH {all_raw}, {kept()}, {merged()}
SELECT file, line, finding_type, CASE finding_type {alternatives} ELSE '' END
       AS safe_alternatives FROM merged""",
        "keyword_lines": keyword_sql(),
        "semantic_report": semantic_sql(), "embedding_store": semantic_sql(),
        "detector_scan": detector_sql(),
        "cosine_threshold": f"""WITH {CENTROIDS}
SELECT vec_id, ord, round(similarity, 6) AS similarity FROM sims WHERE similarity > 0.2""",
        "cosine_best": f"""WITH {CENTROIDS}
SELECT vec_id, min_by(ord, (-similarity, ord)) AS ord, round(max(similarity), 6) AS similarity
FROM sims GROUP BY vec_id HAVING max(similarity) > 0""",
        "cosine_blocks": """WITH v AS (SELECT vec_id,
       list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)
SELECT i.vec_id, p.vec_id AS ord, round(list_cosine_similarity(i.e, p.e), 6) AS similarity
FROM v i, v p WHERE i.vec_id % 100 = 0 AND list_cosine_similarity(i.e, p.e) > 0.25""",
        "cosine_nearest": """WITH v AS (SELECT vec_id,
       list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
i AS (SELECT a.vec_id, list_transform(list_zip(a.e, b.e), lambda z: z[1] + 2 * z[2]) AS e
      FROM v a JOIN v b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 100 = 0),
sims AS (SELECT i.vec_id, p.vec_id AS ord, list_cosine_similarity(i.e, p.e) AS similarity
         FROM i, v p)
SELECT vec_id, min_by(ord, (-similarity, ord)) AS ord, round(max(similarity), 6) AS similarity
FROM sims GROUP BY vec_id HAVING max(similarity) > 0""",
        "cosine_to_label": f"""WITH {CENTROIDS}
SELECT vec_id, own AS label, round(similarity, 6) AS similarity FROM sims WHERE ord = own""",
        "mean_pool": """SELECT label, CAST(i - 1 AS INTEGER) AS dim,
       round(avg(CAST(embedding[i] AS DOUBLE)), 6) AS value
FROM embeddings, range(1, 65) r(i) WHERE embedding[1] > 0 GROUP BY label, i""",
        "prompt_window": f"{windows}\nSELECT file, line, k, win AS \"window\" FROM windowed",
        "prompt_window_join": f"""WITH {all_raw}, {kept()}, {escalated()}
SELECT e.file, e.line, e.ek AS k,
       md5({window_sql('f.content', 'e.line')}) AS digest
FROM escalated e JOIN files f ON f.path = e.file""",
        "prompt_render": f"""{windows}
SELECT file, line, k, {KEY} AS key, md5({document_sql('win')}) AS digest FROM windowed""",
        "prompt_export": f"""{windows}
SELECT {KEY} AS key, max_by(finding_type, (file, line, k)) AS finding_type,
       max_by(file, (file, line, k)) AS file, max_by(line, (file, line, k)) AS line,
       max_by(md5({document_sql('win')}), (file, line, k)) AS digest
FROM windowed GROUP BY key""",
        "stub_analysis": f"""WITH {all_raw}
SELECT file, finding_type, count(*) AS matches, {explanation('finding_type', 0)} AS explanation,
       {explanation('finding_type', 1)} AS fix_suggestion FROM raw GROUP BY file, finding_type""",
        "response_parse": f"""SELECT conv_id, turn, {parsed_answer('text', 'explanation')}
       AS explanation, {parsed_answer('text', 'fix')} AS fix_suggestion FROM conversations""",
        "analysis_routing": f"WITH {raw(files=src)}, {kept()}, {escalated()}, {routed}\n"
                            "SELECT * FROM routed",
        "analysed_report": f"""WITH {raw(files=src)}, {kept()}, {escalated()}, {routed},
{merged()},
last_answer AS (SELECT file, line, max_by(explanation, k) AS explanation,
                       max_by(fix_suggestion, k) AS fix_suggestion
                FROM routed GROUP BY file, line)
SELECT m.file, m.line, m.seq, m.finding_type, m.severity,
       CASE WHEN m.seq = 0 THEN a.explanation END AS explanation,
       CASE WHEN m.seq = 0 THEN a.fix_suggestion END AS fix_suggestion
FROM merged m LEFT JOIN last_answer a ON a.file = m.file AND a.line = m.line""",
        "training_set": f"""WITH {all_raw}, {kept()}, {merged()}
SELECT m.file, m.line, m.seq, m.finding_type, m.severity, m.evidence,
       md5(f.content) AS code_digest, 1 AS label
FROM merged m JOIN files f ON f.path = m.file""",
        "training_roundtrip": f"""WITH {all_raw}, {kept()}, {merged()}
SELECT f.lang AS scan_id, m.finding_type, m.severity, m.evidence,
       f.lang || ':' || md5(f.content) AS code, count(*) AS copies, count(*) AS labels
FROM merged m JOIN files f ON f.path = m.file WHERE f.lang IN ('en', 'fr') GROUP BY ALL""",
        "known_pattern_summary": f"""WITH {all_raw}, {kept()}, {merged()}
SELECT string_agg('- ' || finding_type || ': ' || substring(evidence, 1, 50) || chr(10), ''
                  ORDER BY file, line, seq) AS known_patterns,
       (SELECT count(*) FROM merged) AS n_examples
FROM (SELECT * FROM merged ORDER BY file, line, seq LIMIT 5) t""",
        "findings_history": f"""WITH {all_raw}, {kept()}, {merged()}
SELECT f.lang AS scan_id, count(*) AS findings FROM merged m JOIN files f ON f.path = m.file
GROUP BY f.lang""",
        "learning_rounds": f"""WITH {all_raw}, {kept()}, {merged()}
SELECT CAST(i AS INTEGER) AS iteration, count(*) AS findings, count(*) AS examples,
       count(*) AS label_sum FROM merged, range(1, 4) r(i) GROUP BY i""",
        "incremental_findings": report(
            f"SELECT doc_id, lang, path, CASE WHEN doc_id % 3 = 0 THEN 'eval(new)' || chr(10) "
            f"ELSE '' END || content AS content FROM ({corpus_sql()}) c"),
        "changed_file_scan": report(
            f"SELECT * FROM ({corpus_sql()}) c WHERE path IN "
            f"(SELECT {path_sql('(doc_id + 1)')} FROM documents)"),
        "request_batch": requests_sql(),
    }


def _unfiltered_scores() -> str:
    """The line scores over all findings, and the last accepted finding that escalates."""
    return f"""
full_kept AS (SELECT *, CASE lane WHEN 'rule' THEN 0 ELSE 1 END AS lr FROM raw
              QUALIFY lane = 'rule' OR row_number() OVER (
                  PARTITION BY file, line, finding_type, pattern, lane ORDER BY seq) = 1),
full_last AS (SELECT file, line, max_by(finding_type, (lr, seq)) AS t
              FROM full_kept GROUP BY file, line),
full_scored AS (SELECT l.file, l.line, {score_sql('l.t', 'f.low')} AS line_score
                FROM full_last l JOIN (SELECT path, lower(content) AS low FROM files) f
                  ON f.path = l.file),
full_escalated AS (SELECT k.file, k.line, max_by(k.finding_type, (k.lane_rank, k.seq)) AS t
                   FROM kept k JOIN full_scored s ON k.file = s.file AND k.line = s.line
                   WHERE k.needs_escalation OR s.line_score >= 0.8 GROUP BY k.file, k.line)"""


def _analysed_by(alias: str) -> str:
    return (f"CASE WHEN m.seq = 0 AND {alias}.t IS NOT NULL THEN "
            f"{explanation(alias + '.t', 0)} END")
