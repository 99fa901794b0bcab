"""Names, paths, quoting and templates."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablekeep.functions.columns import as_column


def _code_point(ch: Column) -> Column:
    return F.concat(F.lit("("), F.lower(F.hex(F.ascii(ch))), F.lit(")"))


def safe_name(name: Column | str) -> Column:
    """Visible ASCII is kept, any other character becomes its hex code point in parentheses."""
    col = as_column(name)
    # what a character turns into is visible itself, so one replacement per distinct
    # character is enough and their order does not matter
    unsafe = F.array_distinct(F.regexp_extract_all(col, F.lit("[^!-~]"), F.lit(0)))
    return F.aggregate(unsafe, col, lambda done, ch: F.replace(done, ch, _code_point(ch)))


def path_name(name: str) -> str:
    """A folder name that is unique per name and means nothing to globs or hidden-file rules.

    Stricter than ``safe_name``: only letters, digits, ``-`` and an inner ``_`` stay.
    """
    return "".join(
        ch
        if ch.isascii() and (ch.isalnum() or ch == "-" or (ch == "_" and at))
        else f"({ord(ch):x})"
        for at, ch in enumerate(name)
    )


def path_name_column(name: Column | str) -> Column:
    """``path_name`` for a column."""
    col = as_column(name)
    pieces = F.regexp_extract_all(col, F.lit(r"(?s)[A-Za-z0-9-]+|."), F.lit(0))
    encoded = F.transform(
        pieces,
        lambda piece, at: F.when(piece.rlike(r"\A[A-Za-z0-9-]") | ((piece == "_") & (at > 0)), piece).otherwise(
            _code_point(piece)
        ),
    )
    return F.when(col.rlike(r"\A[A-Za-z0-9-][A-Za-z0-9_-]*\z"), col).otherwise(F.array_join(encoded, ""))


def canonical_key(key: Column | str) -> Column:
    return F.translate(as_column(key), "_", "-")


def kebab_to_camel(key: Column | str) -> Column:
    """``dump-user-data`` becomes ``dumpUserData``."""
    words = F.split(as_column(key), "-")
    rest = F.transform(
        F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))),
        lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.lower(w.substr(F.lit(2), F.length(w)))),
    )
    return F.concat(F.get(words, F.lit(0)), F.array_join(rest, ""))


_TEMPLATE_TOKEN = r"(?s)\$\$|\$\{[_a-zA-Z][_a-zA-Z0-9]*\}|\$[_a-zA-Z][_a-zA-Z0-9]*|[^$]+|\$"


def fill_template(template: Column | str, values: Mapping[str, Column | str]) -> Column:
    """Replace ``$name`` and ``${name}`` in one pass; unknown names stay, ``$$`` is a dollar.

    ``values`` maps a name to a Column, or to a plain text.
    """
    col = as_column(template)

    def fill(token: Column) -> Column:
        result = F.when(token == "$$", F.lit("$"))
        for name, value in values.items():
            result = result.when(
                token.isin(f"${name}", f"${{{name}}}"),
                value if isinstance(value, Column) else F.lit(value),
            )
        return result.otherwise(token)

    tokens = F.regexp_extract_all(col, F.lit(_TEMPLATE_TOKEN), F.lit(0))
    return F.when(col.contains("$"), F.array_join(F.transform(tokens, fill), "")).otherwise(col)


def fill_directory(template: Column | str, directory: Column | str) -> Column:
    """Replace ``{backup_data_dir}``."""
    return F.replace(as_column(template), F.lit("{backup_data_dir}"), as_column(directory))


def archive_name(directory: Column | str) -> Column:
    """``/var/lib/data`` becomes ``var_lib_data.tar``."""
    stripped = F.regexp_replace(as_column(directory), r"\A/+", "")
    return F.concat(F.translate(stripped, "/", "_"), F.lit(".tar"))


def _parts(path: str) -> list[str]:
    return [p for p in path.split("/") if p]


def relative_to(path: Column | str, base: str) -> Column:
    """``path`` as seen from the folder ``base``; both absolute."""
    parts = F.filter(F.split(as_column(path), "/"), lambda p: p != "")
    base_parts = _parts(base)
    shared = reduce(
        lambda deeper, at: F.when(F.get(parts, F.lit(at)) == base_parts[at], F.lit(1) + deeper).otherwise(F.lit(0)),
        reversed(range(len(base_parts))),
        F.lit(0),
    )
    ups = F.array_repeat(F.lit(".."), F.lit(len(base_parts)) - shared)
    rest = F.slice(parts, shared + F.lit(1), F.greatest(F.size(parts) - shared, F.lit(0)))
    joined = F.array_join(F.concat(ups, rest), "/")
    return F.when(joined == "", F.lit(".")).otherwise(joined)


def remap_path(path: Column | str, base: str, mountpoint: str) -> Column:
    """Move a path from under ``base`` to under ``mountpoint``."""
    return F.concat(F.lit(mountpoint.rstrip("/") + "/"), relative_to(path, base))


def quote_double(value: Column | str) -> Column:
    escaped = F.replace(as_column(value), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), escaped, F.lit('"'))


def quote_identifier(name: Column | str) -> Column:
    return F.concat(F.lit("`"), F.replace(as_column(name), F.lit("`"), F.lit("``")), F.lit("`"))


def quote_url(value: Column | str) -> Column:
    """Percent-encoding for a form value: space becomes ``+``."""
    encoded = F.url_encode(as_column(value))
    return F.replace(F.replace(encoded, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def flatten_list(lists: Column | str) -> Column:
    return F.flatten(as_column(lists))
