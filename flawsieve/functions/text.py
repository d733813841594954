"""Column functions on texts: newlines, lines, strip."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .regex import SPACE


_SPACES = "".join(c for c in map(chr, range(0x3001)) if re.match(f"[{SPACE}]", c))


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, also where the body uses it in a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# Stands for a replacement character that was in the input itself; holds a noncharacter.
_KEPT = "\ue000\ufffe\ue001"


def lenient_utf8(data: Column | str) -> Column:
    """Bytes to text: invalid sequences are dropped, every line end becomes ``\\n``."""
    raw = F.replace(col(data).cast("string"), F.lit("\ufffd"), F.lit(_KEPT))
    text = F.replace(F.make_valid_utf8(raw), F.lit("\ufffd"), F.lit(""))
    text = F.replace(text, F.lit(_KEPT), F.lit("\ufffd"))
    return F.regexp_replace(text, "\r\n?", "\n")


def lines_of(text: Column | str) -> Column:
    return F.split(col(text), "\n", -1)


def strip(text: Column | str) -> Column:
    """Drops white space at both ends (all of Unicode's, which ``trim`` alone does not).  A regex
    would try each blank inside a line as the start of its end."""
    return F.btrim(col(text), F.lit(_SPACES))


def excerpt(text: Column | str, length: int) -> Column:
    return F.substring(col(text), 1, length)


# Letters that are seldom in prose, the seldom ones first.
_SELDOM = "+(_jqxz0123456789kvwybpfgm.-"


def escaped(text: str) -> str:
    """A literal as a regex of Java."""
    return re.sub(r"(\W)", r"\\\1", text)


def _rest(word: str) -> str | None:
    """A word from its most seldom letter on, if there is one before its last letter; of three
    letters at least, if it can be."""
    found = [i for i, c in enumerate(word[:-1] or word) if c in _SELDOM]
    return word[min(found, key=lambda i: (len(word) - i < 3, _SELDOM.index(word[i]), i)):] \
        if found else None


def _hints(words: list[str]) -> dict[str, str | None]:
    """What must occur for a word to occur; no hint is the start of another one."""
    rests = {w: _rest(w) for w in words}
    return {w: rest and min((r for r in rests.values() if r and rest.startswith(r)), key=len)
            for w, rest in rests.items()}


def _hint_regex(hints: set[str]) -> str:
    """Captures the hint at each place that has one; most places fail at the first test."""
    starts = sorted({h[0] for h in hints})
    branches = [escaped(c) + "(?:" + "|".join(escaped(h[1:]) for h in sorted(hints) if h[0] == c)
                + ")" for c in starts]
    return f"(?=[{''.join(map(escaped, starts))}])(?=({'|'.join(branches)}))"


def words_in(text: Column, words: list[str]) -> Column:
    """Which of a fixed list of words occur in a text.

    To look a word up takes a pass over the text.  So one pass looks for the ends of all words,
    from their most seldom letter on, and only words whose end it finds are looked up; so are
    words without such a letter.  A word with another one of the words in it is only looked up
    if that one occurs.
    """
    if not words:
        return F.array().cast("array<string>")
    hints = _hints(words)
    plain = [w for w in words if not any(o != w and o in w for o in words)]
    longer = [(w, next(o for o in plain if o in w)) for w in words if w not in plain]
    ordered = F.array(*[F.struct(F.lit(w).alias("word"), F.lit(o).cast("string").alias("part"),
                                 F.lit(hints[w]).cast("string").alias("hint"))
                        for w, o in [*((w, None) for w in plain), *longer]])

    def looked_up(hinted):
        return F.aggregate(ordered, F.array().cast("array<string>"), lambda found, w: F.when(
            (w.hint.isNull() | F.array_contains(hinted, w.hint))
            & (w.part.isNull() | F.array_contains(found, w.part)) & F.contains(text, w.word),
            F.concat(found, F.array(w.word))).otherwise(found))

    known = {h for h in hints.values() if h}
    if not known:
        return looked_up(F.array().cast("array<string>"))
    return let(F.array_distinct(F.regexp_extract_all(text, F.lit(_hint_regex(known)), F.lit(1))),
               looked_up)


def contains_any(text: Column, words) -> Column:
    """Whether at least one of a fixed list of words occurs."""
    return F.exists(F.lit(list(words)), lambda w: F.contains(text, w))
