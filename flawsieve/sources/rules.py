"""Rule catalogues kept as JSON."""

from __future__ import annotations

import warnings

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

from ..catalogue import DETERMINISTIC_RULES, HEURISTIC_RULES, Rule, rule_from_dict

RULE_JSON = ("id string, name string, description string, pattern string, severity string, "
             "finding_type string, needs_escalation boolean, _corrupt string")


def read_rules(spark: SparkSession, path: str | None,
               heuristics: tuple[Rule, ...] = HEURISTIC_RULES) -> tuple[Rule, ...]:
    """Deterministic rules from a JSON array, in front of the heuristics.

    The built-in rules take the place of a file that is missing or cannot be read.
    """
    rules = DETERMINISTIC_RULES
    if path is not None:
        try:
            rows = (spark.read.schema(RULE_JSON).option("multiLine", True)
                    .option("columnNameOfCorruptRecord", "_corrupt").json(path)
                    .collect())
        except AnalysisException as e:
            warnings.warn(f"no rules read from {path} ({e.getCondition()}); built-in ones used")
            return rules + heuristics
        if any(r["_corrupt"] is not None for r in rows):
            warnings.warn(f"{path} is not a JSON array of rules; built-in ones used")
        else:
            rules = tuple(rule_from_dict(r.asDict()) for r in rows)
    return rules + heuristics
