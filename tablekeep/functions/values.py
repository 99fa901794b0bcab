"""Typed readings of setting texts, and version numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablekeep.functions.columns import as_column

# Accepted spellings and standard level numbers.
TRUE_WORDS = ["true", "on", "1", "yes"]
FALSE_WORDS = ["false", "off", "0", "no"]
LOG_LEVELS = {"debug": 10, "info": 20, "warning": 30, "error": 40, "critical": 50}

_INTEGER = r"\A\s*[+-]?[0-9]+\s*\z"
_OCTAL = r"\A\s*[+-]?(?:0[oO])?[0-7]+\s*\z"


def to_boolean(value: Column | str) -> Column:
    word = F.lower(as_column(value))
    return F.when(word.isin(TRUE_WORDS), True).when(word.isin(FALSE_WORDS), False)


def to_integer(value: Column | str) -> Column:
    col = as_column(value)
    return F.when(col.rlike(_INTEGER), F.trim(col).try_cast("bigint"))


def to_float(value: Column | str) -> Column:
    return F.trim(as_column(value)).try_cast("double")


def to_octal(value: Column | str) -> Column:
    """Octal digits, an optional sign and an optional ``0o`` in front."""
    col = as_column(value)
    digits = F.regexp_replace(F.trim(col), r"\A[+-]?(?:0[oO])?", "")
    number = F.conv(digits, 8, 10).try_cast("bigint")
    signed = F.when(F.trim(col).startswith("-"), -number).otherwise(number)
    return F.when(col.rlike(_OCTAL), signed)


def to_list(value: Column | str) -> Column:
    """Comma-separated text as a list of trimmed items."""
    col = as_column(value)
    return F.when(F.trim(col) == "", F.array().cast("array<string>")).otherwise(
        F.transform(F.split(col, ","), lambda item: F.trim(item))
    )


# A command line: blanks part words, single quotes keep all, double quotes keep all but escapes.
_QUOTED = r"\\[\s\S]|\"(?:[^\"\\]|\\[\s\S])*\"|'[^']*'"
_PART = rf"[^\s\"'\\]+|{_QUOTED}"


def to_args(value: Column | str) -> Column:
    """A command line as a list of words; NULL where a quote or an escape is left open."""
    col = as_column(value)

    def plain(part: Column) -> Column:
        inside = part.substr(F.lit(2), F.length(part) - 2)
        return (
            F.when(part.startswith("'"), inside)
            .when(part.startswith('"'), F.regexp_replace(inside, r"\\([\"\\])", "$1"))
            .otherwise(F.regexp_replace(part, r"\\([\s\S])", "$1"))
        )

    words = F.regexp_extract_all(col, F.lit(f"(?:{_PART})+"), F.lit(0))
    parts = F.transform(words, lambda word: F.regexp_extract_all(word, F.lit(_PART), F.lit(0)))
    joined = F.transform(parts, lambda some: F.array_join(F.transform(some, plain), ""))
    return F.when(col.rlike(rf"\A(?:\s|{_PART})*\z"), joined)


def to_log_level(value: Column | str) -> Column:
    word = F.lower(F.trim(as_column(value)))
    result = F.lit(None).cast("int")
    for name, number in LOG_LEVELS.items():
        result = F.when(word == name, number).otherwise(result)
    return result


def parse_version(text: Column | str) -> Column:
    """``8.0.36`` as ``[8, 0, 36]``; arrays of numbers order as versions do."""
    col = as_column(text)
    numbers = F.transform(F.split(col, r"\."), lambda n: n.try_cast("int"))
    return F.when(col.rlike(r"\A[0-9]+(?:\.[0-9]+)*\z"), numbers)


def find_version(text: Column | str) -> Column:
    """The first ``d.d.d`` inside a text, NULL without one."""
    return F.nullif(F.regexp_extract(as_column(text), r"([0-9]+\.[0-9]+\.[0-9]+)", 1), F.lit(""))
