"""Context validation: is a finding likely to be real, judged from its type and evidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .regex import java_pattern
from .text import contains_any

# Signal patterns, marker words, and the amounts each observation adds to a
# neutral score, in order of addition.
SIGNALS = (
    r"=\s*['\"][a-zA-Z0-9]{8,}['\"]",
    r".*\+.*(WHERE|FROM|SELECT|INSERT|UPDATE)",
    r"request\.(args|form|json|cookies)",
    r"shell\s*=\s*True",
    r"render_template_string.*%",
)
TRUSTED_MARKERS = ("environ.get", "os.environ", "config", "settings", "secretsmanager",
                   "vault", "aws_secret")
STRONG_ALGORITHMS = ("bcrypt", "argon", "scrypt", "pbkdf2")
NOT_A_LITERAL = ("environ", "get", "import", "class")
NEUTRAL = 0.5
MAX_REASONS = 3


def context_score(finding_type: Column, evidence: Column) -> Column:
    """``STRUCT<is_vulnerable, confidence, reasons>``; a neutral score counts as safe.

    Each observation is (condition, amount, reason); the amounts are summed in order and a
    reason of None is not reported.
    """
    lowered, upper = F.lower(evidence), F.upper(evidence)
    has = lambda text: F.contains(evidence, F.lit(text))
    has_lower = lambda text: F.contains(lowered, F.lit(text))
    of = lambda name: finding_type == name

    observations: list[tuple[Column, float, str | None]] = []

    # A signal counts by the first of these that the evidence shows; others count nothing.
    request = has("request.")
    template = ~request & has("%") & has("render_template_string")
    sql = (~request & ~template & has("+")
           & (F.contains(upper, F.lit("WHERE")) | F.contains(upper, F.lit("SELECT"))
              | F.contains(upper, F.lit("FROM"))))
    for signal in SIGNALS:
        seen = F.rlike(evidence, F.lit(java_pattern(signal)))
        observations += [(seen & request, 0.25, "takes data from the request"),
                         (seen & template, 0.25, "formats a template string"),
                         (seen & sql, 0.4, "joins SQL text")]

    observations.append((contains_any(lowered, TRUSTED_MARKERS), -0.3,
                         "takes data from a trusted source"))

    observations += [
        (of("SQL Injection") & (has("?") | has(", (")), -0.4, "binds query parameters"),
        (of("SQL Injection") & has("+")
         & (F.contains(upper, F.lit("SELECT")) | F.contains(upper, F.lit("FROM"))),
         0.2, "joins strings in SQL"),
    ]

    def first_of(name, *cases):
        earlier = F.lit(False)
        for condition, amount, reason in cases:
            observations.append((of(name) & ~earlier & condition, amount, reason))
            earlier = earlier | condition

    first_of("XSS",
             (has_lower("escape") | has_lower("markupsafe"), -0.4, "escapes the output"),
             (has("render_template(") & ~has("render_template_string"), -0.3,
              "uses page templates"),
             (has("render_template_string") & has("%s"), 0.2, None))
    first_of("Command Injection",
             (has("shell=True"), 0.3, None),
             (has("shell=False"), -0.4, "runs without a shell"),
             (has("["), -0.3, "passes a list of arguments"))
    first_of("Weak Cryptography",
             (contains_any(lowered, STRONG_ALGORITHMS), -0.4, "uses a strong algorithm"),
             (has_lower("md5") | has_lower("sha1"), 0.3, "uses a weak algorithm"))
    first_of("Secrets Leak",
             (has("environ.get"), -0.4, "reads the environment"),
             (has("getpass.getpass"), -0.3, "asks for the value"),
             (has("=") & has('"')
              & (F.length(F.split_part(evidence, F.lit('"'), F.lit(2))) > 10)
              & ~contains_any(lowered, NOT_A_LITERAL), 0.2, None))

    total = reduce(
        lambda total, o: total + F.when(o[0], F.lit(o[1])).otherwise(F.lit(0.0)),
        observations, F.lit(NEUTRAL))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))
    reasons = F.array_compact(F.array(*[
        F.when(condition, F.lit(reason)) for condition, _, reason in observations if reason]))
    return F.struct(
        (score > NEUTRAL).alias("is_vulnerable"),
        (F.abs(score - NEUTRAL) * 2).alias("confidence"),
        F.slice(reasons, 1, MAX_REASONS).alias("reasons"))
