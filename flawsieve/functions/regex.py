"""Catalogue patterns are written in Python's regex dialect; Spark runs Java's.

``java_pattern`` spells out the constructs that the two read differently, so that a match
found by Spark is the match Python's ``re`` would find.
"""

from __future__ import annotations

import re

# What `\w`, `\s` and `\d` stand for on Unicode text, as the inside of a character class.
WORD = r"\p{L}\p{N}_"
SPACE = r"\t-\r\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
DIGIT = r"\p{Nd}"
_CLASSES = {"w": WORD, "s": SPACE, "d": DIGIT}
_BOUNDARY = f"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"
_NO_BOUNDARY = f"(?:(?<=[{WORD}])(?=[{WORD}])|(?<![{WORD}])(?![{WORD}]))"

# A word and blanks at the front of a pattern, and what leads can't be told behind.
_RUN = r"\w+\s*"
_LOOKS_BACK = re.compile(r"\(\?(?!:|=|!|P<)|\\[AGZ]")

_REPETITION = re.compile(r"\{(?=\d|,)(\d*)((?:,\d*)?)\}")


def java_pattern(pattern: str, ignore_case: bool = False) -> str:
    """The Java form of a Python pattern used with MULTILINE (and IGNORECASE)."""
    out = ["(?dmiu)" if ignore_case else "(?dm)"]
    i, in_class = 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            e = pattern[i + 1]
            i += 2
            if e in _CLASSES:
                out.append(_CLASSES[e] if in_class else f"[{_CLASSES[e]}]")
            elif e.lower() in _CLASSES:
                out.append(f"[^{_CLASSES[e.lower()]}]")
            elif e in "bB" and not in_class:
                out.append(_BOUNDARY if e == "b" else _NO_BOUNDARY)
            elif e == "b":
                out.append(r"\x08")
            elif e == "Z" and not in_class:
                out.append(r"\z")
            else:
                out.append("\\" + e)
            continue
        if in_class:
            if c == "]":
                in_class = False
            out.append("\\" + c if c in "[&" else c)
        elif c == "[":
            in_class = True
            out.append(c)
            if pattern[i + 1:i + 2] == "^":
                out.append("^")
                i += 1
            if pattern[i + 1:i + 2] == "]":
                out.append("\\]")
                i += 1
        elif c == "{":
            # `{,n}` counts from zero; a brace that is no repetition stands for itself.
            count = _REPETITION.match(pattern, i)
            if count:
                out.append("{" + (count[1] or "0") + count[2] + "}")
                i = count.end()
                continue
            out.append("\\{")
        elif pattern.startswith("(?P<", i):
            out.append("(?<")
            i += 3
        elif pattern.startswith("(?P=", i):
            end = pattern.index(")", i)
            out.append(f"\\k<{pattern[i + 4:end]}>")
            i = end
        else:
            out.append(c)
        i += 1
    return "".join(out)


def _alternatives(pattern: str) -> list[str]:
    """The parts of a pattern between its outermost bars."""
    parts, depth, in_class, i, begin = [], 0, False, 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
        elif in_class:
            # A bracket right behind the opening one stands for itself.
            in_class = c != "]" or pattern[i - 1] == "[" or pattern[i - 2:i] == "[^"
        elif c == "[":
            in_class = True
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "|" and not depth:
            parts.append(pattern[begin:i])
            begin = i + 1
        i += 1
    return [*parts, pattern[begin:]]


def _closing(pattern: str) -> int:
    """Where the group that opens a pattern ends."""
    for i in range(1, len(pattern)):
        if pattern[i] == ")" and len(_alternatives(pattern[:i + 1] + "|")) == 2:
            return i
    return -1


def _literal(pattern: str) -> str:
    out, i = "", 0
    while i < len(pattern):
        c, step = pattern[i], 1
        if c == "\\":
            c, step = pattern[i + 1:i + 2], 2
            if c.isalnum() or not c:
                break
        elif c in "^$.[](){}|?*+":
            break
        if not c.isascii() or pattern[i + step:i + step + 1] in ("?", "*", "{"):
            break
        out, i = out + c, i + step
    return out


def leads(pattern: str) -> tuple[tuple[str, ...], bool] | None:
    """Literals, in lower case, at one of which each match of a Python pattern starts; or, if the
    second value is true, right before which it has a word and blanks, or blanks only.  None if
    that can't be told.  Nothing in front of a match's start decides whether there is one."""
    if _LOOKS_BACK.search(pattern):
        return None
    found, run = [], pattern.startswith(_RUN)
    for part in _alternatives(pattern):
        if part.startswith(_RUN) != run:
            return None
        part = part[len(_RUN):] if run else part
        if part.startswith("(") and not part.startswith(("(?=", "(?!", "(?P")):
            end = _closing(part)
            inner = None if end < 0 or part[end + 1:end + 2] in ("?", "*", "{") else leads(
                part[1:end].removeprefix("?:"))
            if inner is None or inner[1]:
                return None
            found.extend(inner[0])
        else:
            found.append(_literal(part).lower())
    return (tuple(dict.fromkeys(found)), run) if all(found) else None
