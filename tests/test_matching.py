"""Matches, their lines and texts equal those of Python's ``re`` over the whole text."""

import random
import re
from collections import Counter

import pytest
from conftest import files_frame

import model
from flawsieve import catalogue as cat
from flawsieve.functions.regex import java_pattern
from flawsieve.functions.regex import java_pattern
from flawsieve.operators.fallback import has_needle
from flawsieve.operators.matching import matching_rules, needles_of, scan_matches, words_in
from flawsieve.operators.similarity import hashed_ngrams
from flawsieve.plans.scan import scan, scan_lines
from pyspark.sql import functions as F

# One or more texts for each pattern.
SAMPLES = [
    'eval (x) os.system(c) API_KEY = "abcdefgh12345678" password="p"',
    "cursor.execute(q + x)\nfetchone (\n a + b)", "pickle.load (f); pickle.loads(b)",
    "full = base + name  # the path\nq=a+bdir\nx = y + z", 'render_template_string ("%s" % a)',
    'md5(x) sha1 (y) SALT = "abcd+/=123"', "s.verify = False; c.check_hostname=False DEBUG=True",
    "EXEC(a) Compile (b) __import__('x') getattr(a.b , name) getattr(a,\n b)",
    "subprocess.Popen(c shell = True) os.popen(x) commands.getstatusoutput(y)",
    "execute(f'select 1') fetchall(f\"DELETE x\") order by $x a+b\n+\n+",
    "password = 'longenough' app.secret_key = 'x' APIKEY='k' private_key=\"z\"",
    "jwt_secret = 's' db_user='u' algorithm=\"none\" verify_signature=False mt_rand ( )",
    "int( time. time ( ) ) yaml.load(f) marshal.load(g) unserialize (h)",
    "x.innerHTML = y document.write (z) dangerouslySetInnerHTML send_file( ",
    "name = join(a, file) p=q+r name", "send_from_directory(d open(a + b readfile(",
    "hashlib.md5 (a) hashlib.sha1(b) random.choice (c) nodes(d) rc4(e)",
    "_create_unverified_context context = None 'Access-Control-Allow-Origin' = '*'",
    "display_errors=True phpinfo ( ) traceback.format_exc() request.args.get('user_id",
    "get_by_id (x) WHERE id = abc session WHERE id=a", "urllib.request.urlopen(u)",
    "requests.post(\n u,\n v)", "file_get_contents ( $_GET", "redirect ( $u header('Location:'",
    'header("Location: " . $x', "set_cookie(a + b header(x + y", "header('abc: ' + z",
    "file_put_contents(f, $_POST fwrite(f $x logging (a $_GET", "Template ( $x",
    "render_template_string (a $b f【StringTemplate($c", "move_uploaded_file (x file.save(y",
    "z.save(a $b",
]
ODD = [
    "", "\n", "\r\n\r\neval(x)\r\n", "eval(", "no match here", "  eval (\t x)  \n\n\n+ +\n",
    "ſhell = True", "debug = Truе", "PaSSword = 'abcdefghij'", "tracebacK.format_exc(",
    "pıckle.loads(x) fıle.ſave(x)", "İnnerHTML = 1", "é = à + ü file\nñ=ó+ú dir",
    "x = True debug =　True", "a\x1c=\x1db + c path", "\x01eval(\x01)\x01",
    "$0 \\1 eval($1)", "+" * 50 + "\n" + "+" * 3, "a = b + c path d = e + f dir\ng=h+ifile",
    "z" * 300 + " = " + "y" * 200 + " + " + "w" * 100 + "file", "a̋b = c + d file",
    " eval(x) \u0085exec(y)", "password = \"a\nb\nc\" eval(z)", "İİ eval(x)\nİ+",
]


def expected(texts, rules=cat.DEFAULT_CATALOGUE):
    rows = Counter()
    for path, text in texts:
        for f in model.matches(text, rules):
            rows[(path, f["ord"], f["k"], f["pattern"], f["evidence"], f["line"])] += 1
    return rows


def found(spark, texts, rules=cat.DEFAULT_CATALOGUE):
    rows = scan_matches(files_frame(spark, texts), rules).collect()
    return Counter((r.file, r.ord, r.k, r.pattern, r.evidence, r.line) for r in rows)


def paths(texts):
    return [(f"f{i}", t) for i, t in enumerate(texts)]


def test_every_pattern_is_sampled():
    for rule in cat.DEFAULT_CATALOGUE:
        assert any(f["pattern"] == rule.name for t in SAMPLES for f in model.matches(t)), rule


def test_samples_and_odd_texts(spark):
    texts = paths(SAMPLES + ODD + ["\n".join(SAMPLES), "\r\n".join(SAMPLES).upper()])
    want = expected(texts)
    assert sum(want.values()) > 200
    assert found(spark, texts) == want


def test_random_mixtures(spark):
    rng = random.Random(7)
    pieces = [p for s in SAMPLES + ODD for p in re.split(r"(\W)", s)] + ["\n", " ", "+", "="] * 30
    texts = paths(["".join(rng.choices(pieces, k=rng.randrange(5, 400))) for _ in range(150)])
    assert found(spark, texts) == expected(texts)


def test_needles_hold_in_every_matching_text():
    rng = random.Random(3)
    pieces = [p for s in SAMPLES + ODD for p in re.split(r"(\W)", s)]
    texts = SAMPLES + ODD + ["".join(rng.choices(pieces, k=60)) for _ in range(2000)]
    fold = str.maketrans("ıİſK", "iisk")
    for text in texts:
        low = text.translate(fold).lower()
        for f in model.matches(text):
            rule = cat.DEFAULT_CATALOGUE[f["ord"] - 1]
            assert any(n in low for n in rule.needles), (rule, text)


@pytest.mark.parametrize("name", ["R011", "path_concat"])
def test_linear_patterns_match_the_same(spark, name):
    rule = next(r for r in cat.DEFAULT_CATALOGUE if r.name == name)
    rng = random.Random(11)
    pieces = ["a", "b1", "_", " ", "\t", "=", "+", "path", "file", "dir", "name", "join", "\n",
              "é", ".", "(", "Dir"]
    texts = ["".join(rng.choices(pieces, k=rng.randrange(1, 40))) for _ in range(4000)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", F.regexp_extract_all("t", F.lit(java_pattern(rule.linear_pattern,
                                                          rule.lane == cat.HEURISTIC)),
                                  F.lit(0)).alias("m"),
        F.rlike("t", F.lit(java_pattern(rule.guard, rule.lane == cat.HEURISTIC))).alias("g"))
    flags = re.M | (re.I if rule.lane == cat.HEURISTIC else 0)
    hits = 0
    for row in rows.collect():
        want = [m.group(0) for m in re.finditer(rule.pattern, row.t, flags)]
        assert row.m == want, row.t
        assert row.g or not want
        hits += len(want)
    assert hits > 100


@pytest.mark.parametrize("pattern", [
    r"[\w.]+@[\w-]+", r"(?P<q>['\"])\w+(?P=q)", r"[][]x", r"[^]a]b", r"a[&&]b", r"^\s*#.*$",
    r"\bfoo\b", r"\Bo", r"x\Z", r"[a-z[]+", r"\d+\D\S\W", r"(a|b)\1", r"^$"])
def test_dialect(spark, pattern):
    texts = ["a.b@c-d x@y", "'ab' \"cd\" 'ef\"", "]x [x", "ab cb ]b", "a&b a&&b", " # c\n#d\nx",
             "foo xfoo foo.", "foo o", "x\nx", "ab[cd", "12a b! ٣x -", "aa bb ab", "a\n\nb"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", F.regexp_extract_all("t", F.lit(java_pattern(pattern)), F.lit(0)).alias("m"))
    for row in rows.collect():
        assert row.m == [m.group(0) for m in re.finditer(pattern, row.t, re.M)], row.t


def test_long_line_of_matches(spark):
    text = "+" * 20_000 + "\n" + "eval(x) " * 2_000
    rows = scan_matches(files_frame(spark, [text])).groupBy("pattern", "line").count().collect()
    got = {(r.pattern, r.line): r["count"] for r in rows}
    assert got == {("sql_order_by", 1): 20_000, ("R001", 2): 2_000, ("eval_usage", 2): 2_000}


def test_long_word_is_linear(spark):
    """A file that is one long word would take hours if the cost were quadratic."""
    text = "a" * 900_000 + " path file dir name = +"
    assert scan_matches(files_frame(spark, [text]), cat.DETERMINISTIC_RULES).count() == 0


def test_catalogue_edits(spark):
    rules = cat.add_rule(cat.DEFAULT_CATALOGUE, {
        "id": "X1", "name": "n", "pattern": r"foo\(", "finding_type": "Foo", "severity": "Low"})
    assert cat.add_rule(rules, {"id": "X2"}) is rules
    assert len(cat.DEFAULT_CATALOGUE) == 76 and len(rules) == 77
    rules, removed = cat.remove_rule(rules, "R001")
    assert removed and not cat.remove_rule(rules, "R001")[1]
    got = [(r.pattern, r.ord) for r in scan_matches(
        files_frame(spark, ["foo(1) eval(2)"]), rules).orderBy("ord").collect()]
    assert got == [("X1", 12), ("eval_usage", 14)]


def test_bad_and_empty_patterns_are_skipped(spark):
    rules = (cat.Rule("B", "(", "T", "Low"), cat.Rule("E", "", "T", "Low"),
             cat.Rule("G", "g+", "T", "Low"))
    with pytest.warns(UserWarning, match="rule B skipped"):
        got = [r.pattern for r in scan_matches(files_frame(spark, ["gg"]), rules).collect()]
    assert got == ["G"]


def test_catalogue_sizes():
    assert len(cat.DETERMINISTIC_RULES) == 12
    assert len(cat.HEURISTIC_RULES) == 64
    assert len(cat.SEMANTIC_PATTERNS) == 62
    assert sum(map(len, cat.DETECTOR_DESCRIPTIONS.values())) == 43
    assert len(cat.CLASSIFICATION) == 22


def test_rules_of_the_users(spark):
    """Repetitions from zero and single braces match as in Python, and rules that only Python's
    regexes accept are matched there; those that none accepts are left out with a warning."""
    patterns = [r"foox{,3}\(", "${", "a{b}", "x{2}y{1,}", "", "(", "(foo)(?(1)x|y)"]
    catalogue = tuple(cat.rule_from_dict({"id": f"U{i}", "name": "", "pattern": p,
                                          "finding_type": "Own", "severity": "Low"})
                      for i, p in enumerate(patterns))
    text = "foo( foox( fooxxx( fooxxxx(\na{b} and ${\nxxyyy"
    with pytest.warns(UserWarning, match="U5 skipped"):
        found = scan_matches(files_frame(spark, [text]), catalogue).collect()
    want = {(f"U{i}", m.group(), text[:m.start()].count("\n") + 1)
            for i, p in enumerate(patterns) if i not in (4, 5) for m in re.finditer(p, text, re.M)}
    assert {(r.pattern, r.evidence, r.line) for r in found} == want and len(want) == 6


CONDITIONAL = (
    cat.Rule("C1", r"(<)?\w+@\w+(?(1)>)$", "Address", "High", needs_escalation=True),
    cat.Rule("J1", r"eval\(\w*\)", "Injection", "Low"),
    cat.Rule("C2", r"(a)?\n?(?(1)B|C)+", "Spread", "Critical", lane=cat.HEURISTIC),
    cat.Rule("J2", r"eval", "Injection", "Medium", lane=cat.HEURISTIC),
    cat.with_needles(cat.Rule("C3", r"(x)?(?(1)y|xz)", "Guarded", "Low", lane=cat.HEURISTIC),
                     "xy", "xz"))
ODD = ["", "\n\n", "<u@h>\nu@h\n<u@h x\neval(u) <b@c>", "ab ac c c\na\nB a\n\nCCC\n c",
       "eval(a) eval(b)\r\n<a@b>\u2028\ncC", "xy z xy\nz xz", "z only", "Z\nXY é xy",
       "\U0001F600 <é@日>\n" * 40]


def expected_matches(texts, catalogue):
    out = []
    for file, text in texts.items():
        for ord_, r in enumerate(catalogue, 1):
            flags = re.M | (re.I if r.lane == cat.HEURISTIC else 0)
            for k, m in enumerate(re.finditer(r.pattern, text, flags), 1):
                line = text.count("\n", 0, m.start()) + 1
                evidence = m.group() if r.lane == cat.RULE else \
                    text.split("\n")[line - 1].strip()[:100]
                out.append((file, ord_, k, r.name, evidence, line))
    return sorted(out)


def test_fallback_lane(spark):
    """All matches of rules for both engines, in one numbering."""
    files = files_frame(spark, ODD)
    texts = {r.path: r.content for r in files.collect()}
    got = sorted((r.file, r.ord, r.k, r.pattern, r.evidence, r.line)
                 for r in scan_matches(files, CONDITIONAL).collect())
    want = expected_matches(texts, CONDITIONAL)
    assert got == want and {w[3] for w in want} == {r.name for r in CONDITIONAL}


def test_fallback_lane_in_the_scan(spark):
    """Lines of both engines are merged; a heuristic counts once on a line."""
    files = files_frame(spark, ODD)
    texts = {r.path: r.content for r in files.collect()}
    got = {(r.file, r.line, f.pattern, f.evidence)
           for r in scan_lines(files, CONDITIONAL).collect() for f in r.findings}
    assert got == {(f, line, name, e) for f, _, _, name, e, line
                   in expected_matches(texts, CONDITIONAL)}
    merged = scan(files, CONDITIONAL).collect()
    assert {(r.file, r.line, r.finding_type) for r in merged} == {
        (f, line, {c.name: c for c in CONDITIONAL}[n].finding_type)
        for f, _, _, n, _, line in expected_matches(texts, CONDITIONAL)}
    embedded = scan_lines(files, CONDITIONAL, embed=hashed_ngrams(), threshold=2.0).collect()
    assert {(r.file, r.line, f.pattern, f.evidence)
            for r in embedded for f in r.findings} == got


def test_only_such_rules_need_python(spark):
    files = files_frame(spark, ["eval(x)"])

    def plan(catalogue):
        return scan(files, catalogue)._jdf.queryExecution().executedPlan().toString()

    assert "Python" not in plan(cat.DEFAULT_CATALOGUE) and "Python" in plan(CONDITIONAL)
    # A text without a needle of such a rule stays where it is.
    sent = files.select(F.when(has_needle(F.array(F.lit("q")), CONDITIONAL[4:]), F.col("content"))
                        .alias("c")).collect()
    assert [r.c for r in sent] == [None]


def test_needles_are_looked_up_once_in_a_select(spark):
    files = files_frame(spark, ["eval(x)"])
    needles = words_in(F.lower("content"), needles_of(cat.DEFAULT_CATALOGUE))
    plan = files.select(F.size(matching_rules(F.col("content"), needles, cat.DEFAULT_CATALOGUE))
                        .alias("n"))
    assert plan.first().n > 0
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Contains(") <= 1


def test_leads():
    """What a match starts with, or None where that can't be told."""
    from flawsieve.functions.regex import leads

    assert leads(r"(API_KEY|a\.b)\s*=") == (("api_key", "a.b"), False)
    assert leads(r"\w+\s*=\s*x") == (("=",), True)
    assert leads(r"(a(b|c)|d)e|fg?") == (("a", "d", "f"), False)
    assert leads("f\u3010x") == (("f",), False)
    for pattern in (r"a?b", r"a|", r"(a|b)?c", r"^ab", r"(?<!x)ab", r"(?i)ab", r"\Gab", r"[)(|]x",
                    r"\w+\s*=|b", r"(x)?(?(1)y|xz)", ""):
        assert leads(pattern) is None, pattern
    for rule in cat.DEFAULT_CATALOGUE:
        found = leads(rule.pattern)
        flags = re.MULTILINE | (re.IGNORECASE if rule.lane == cat.HEURISTIC else 0)
        for text in SAMPLES:
            for match in re.finditer(rule.pattern, text, flags):
                front = r"\w+\s*" if found and found[1] else ""
                assert found is None or any(re.match(front + re.escape(w), match.group().lower())
                                            for w in found[0]), rule


def test_passes_begin_where_a_match_may_start(spark):
    """Text in front of the first lead is not searched by regexes, and lines count on from it."""
    from flawsieve.operators.matching import folded

    prose = "plain words \u017f\u212a\u0130 \u00c4\U0001f600 of no interest\n" * 50
    text = prose + "  total \n = base + name + path; EVAL\n(a) + eval(b)"
    files = files_frame(spark, [("a", text), ("b", "eval(x)\n" + text), ("c", prose)])
    low = folded(F.col("content"))
    needles = words_in(low, needles_of(cat.DEFAULT_CATALOGUE))
    rules = files.select("path", F.explode(matching_rules(
        F.col("content"), needles, cat.DEFAULT_CATALOGUE, low)).alias("r")).select(
        "path", "r.name", "r.start").collect()
    starts = {(r.path, r.name): r.start for r in rules}
    assert starts["a", "R001"] == starts["a", "eval_usage"] == text.index("EVAL") + 1
    assert starts["a", "R011"] == text.index("total") + 1
    assert starts["b", "R001"] == 1 and not any(path == "c" for path, _ in starts)
    got = sorted((r.file, r.ord, r.k, r.pattern, r.evidence, r.line)
                 for r in scan_matches(files).collect())
    assert got == expected_matches({r.path: r.content for r in files.collect()},
                                   cat.DEFAULT_CATALOGUE)


def test_a_lead_is_looked_for_once(spark):
    """Rules with the same lead share its place, and a lead that does not occur has none."""
    from flawsieve.operators.matching import folded, lead_places, rule_array

    shared = tuple(cat.with_needles(cat.Rule(f"T{i}", p, "T", "Low"), "eval") for i, p in
                   enumerate((r"eval\(", r"eval\s", r"(?:eval|gone)x")))
    words = needles_of(shared)
    assert words == ["eval", "eval(", "gone"]
    low = folded(F.col("content"))
    got = files_frame(spark, ["\U0001f600 EVAL eval(x"]).select(
        lead_places(low, rule_array(shared), words_in(low, words)).alias("p")).first().p
    assert [tuple(p) for p in got] == [("eval(", 8), ("eval", 3)]
