"""The second lane of matching: rules that only Python's regexes can express.

Whole files go in Arrow batches to Python's ``re``, and what comes back is the places of matches,
which join the file's other matches by rule number and line.  A file's text only goes there if it
has a needle of such a rule; a catalogue without such rules has no Python in its plan.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..catalogue import HEURISTIC, RULE, Rule

PLACE_TYPE = "struct<line:int,ord:int,k:int,text:string>"


def has_needle(needles: Column, rules: tuple[Rule, ...]) -> Column:
    """Whether one of the rules may match a text that has these needles."""
    if any(not r.needles for r in rules):
        return F.lit(True)
    wanted = sorted({n for r in rules for n in r.needles})
    return F.arrays_overlap(needles, F.lit(wanted).cast("array<string>"))


def python_matches(content: Column, needles: Column, rules: dict[int, Rule]) -> Column:
    """``ARRAY<STRUCT<line, ord, k, text>>``: all matches of the rules, which are given by their
    number; ``k`` counts those of a rule in its file."""
    compiled = [(ord_, r.pattern, re.MULTILINE | (re.IGNORECASE if r.lane == HEURISTIC else 0))
                for ord_, r in rules.items()]

    def places(texts: pd.Series) -> pd.Series:
        import re

        import pandas as pd

        patterns = [(o, re.compile(p, flags)) for o, p, flags in compiled]

        def of(text):
            found = []
            for ord_, pattern in patterns:
                line, at = 1, 0
                for k, match in enumerate(pattern.finditer(text), 1):
                    line += text.count("\n", at, match.start())
                    at = match.start()
                    found.append((line, ord_, k, match.group()))
            return found

        return pd.Series([of(t) if t is not None else [] for t in texts], dtype=object)

    wanted = F.when(has_needle(needles, tuple(rules.values())), content)
    return F.pandas_udf(places, f"array<{PLACE_TYPE}>")(wanted)


def as_line_hits(places: Column, rules: dict[int, Rule]) -> Column:
    """Matches as hits on lines: a deterministic rule keeps each with its text, a heuristic has
    one hit on a line, without text."""
    exact = F.lit([o for o, r in rules.items() if r.lane == RULE]).cast("array<int>")
    lines = F.array_distinct(F.transform(
        F.filter(places, lambda p: ~F.array_contains(exact, p.ord)), lambda p: F.struct(
            p.line.alias("line"), p.ord.alias("ord"), F.lit(1).alias("k"),
            F.lit(None).cast("string").alias("text"))))
    return F.concat(F.filter(places, lambda p: F.array_contains(exact, p.ord)),
                    lines.cast(f"array<{PLACE_TYPE}>"))
