"""Finding security weaknesses in large bodies of code with Spark."""

from .catalogue import DEFAULT_CATALOGUE, Rule, add_rule, remove_rule
from .plans.detect import detect
from .plans.requests import answer_requests
from .plans.scan import escalations, scan, scan_lines
from .plans.verbs import Report, scan_code, scan_file, scan_files, scan_repository

__all__ = [
    "DEFAULT_CATALOGUE", "Report", "Rule", "add_rule", "answer_requests", "detect",
    "escalations", "remove_rule", "scan", "scan_code", "scan_file", "scan_files",
    "scan_lines", "scan_repository",
]
