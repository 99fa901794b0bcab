"""Glob and regular-expression predicates.

Each function returns a boolean Column that is true for the rows to *keep*. Patterns are
joined on the driver into one anchored regex, so a row is scanned once however long the list.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablekeep.functions.columns import as_column

# A star run, a question mark, a bracket set, or any single character. "]" right after the
# opening is a member, and a set that never closes is a plain "[".
_TOKEN = re.compile(r"(?s)(?P<many>\*+)|(?P<one>\?)|\[(?P<negate>!?+)(?P<members>.[^\]]*)\]|(?P<char>.)")
_RANGE = re.compile(r"(?s)(.)-(.)")
_JAVA_SPECIAL = re.compile(r"[^\w\s]", re.ASCII)


def _escape(text: str) -> str:
    return _JAVA_SPECIAL.sub(lambda m: "\\" + m.group() if ord(m.group()) < 128 else m.group(), text)


def _bracket(members: str, negate: bool) -> str:
    ranges = []
    singles = _RANGE.sub(lambda m: ranges.append(m.groups()) or "", members)
    body = _escape(singles) + "".join(
        f"{_escape(low)}-{_escape(high)}" for low, high in ranges if low <= high
    )
    if not body:
        return "." if negate else "(?!)"
    return f"[{'^' if negate else ''}{body}]"


def glob_to_regex(pattern: str) -> str:
    """The unanchored Java regex for one glob."""

    def token(match: re.Match) -> str:
        if match["many"]:
            return ".*"
        if match["one"]:
            return "."
        if match["members"]:
            return _bracket(match["members"], bool(match["negate"]))
        return _escape(match["char"])

    return _TOKEN.sub(token, pattern)


def _matches_any_glob(col: Column, patterns: tuple[str, ...]) -> Column:
    if any(set(p) == {"*"} for p in patterns):
        return col.isNotNull()
    body = "|".join(glob_to_regex(p) for p in patterns)
    return col.rlike(rf"(?ius)\A(?:{body})\z")


def _matches_any_regex(col: Column, patterns: tuple[str, ...]) -> Column:
    body = "|".join(f"(?:{p})" for p in patterns)
    return col.rlike(rf"(?imuU)\A(?:{body})")


def include_glob(col: Column | str, *patterns: str) -> Column:
    """True where any pattern matches; no patterns keep nothing."""
    return _matches_any_glob(as_column(col), patterns) if patterns else F.lit(False)


def exclude_glob(col: Column | str, *patterns: str) -> Column:
    """False where any pattern matches; no patterns drop nothing."""
    return ~_matches_any_glob(as_column(col), patterns) if patterns else F.lit(True)


def qualify(*patterns: str) -> list[str]:
    """A pattern without a dot means that name in any database."""
    return [p if "." in p else f"*.{p}" for p in patterns]


def include_glob_qualified(database: Column | str, name: Column | str, *patterns: str) -> Column:
    return include_glob(F.concat_ws(".", as_column(database), as_column(name)), *qualify(*patterns))


def exclude_glob_qualified(database: Column | str, name: Column | str, *patterns: str) -> Column:
    return exclude_glob(F.concat_ws(".", as_column(database), as_column(name)), *qualify(*patterns))


def include_regex(col: Column | str, *patterns: str) -> Column:
    """True where any raw pattern matches at the start of the text."""
    return _matches_any_regex(as_column(col), patterns) if patterns else F.lit(False)


def exclude_regex(col: Column | str, *patterns: str) -> Column:
    return ~_matches_any_regex(as_column(col), patterns) if patterns else F.lit(True)
