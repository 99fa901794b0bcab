"""Reading ``INSERT`` statements back as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What stands behind a backslash in a literal, and the text it means.
_ESCAPED = [("\\", "\\"), ("'", "'"), ("n", "\n"), ("r", "\r"), ("0", "\0")]
# While a statement is taken apart, one private character stands for each escape.
_FIRST_MARK = 0xF8F0
_MARKS = [chr(_FIRST_MARK + k) for k in range(len(_ESCAPED))]
_STATEMENT = r"(?s)\A\s*INSERT (?:IGNORE )?INTO (?:`(?:[^`]|``)*`|\S+) VALUES (.*);\s*\z"
_VALUE = r"('[^']*+'|[^,()'\s][^,()']*+)"


def _value(token: Column, field: T.StructField) -> Column:
    """A value of a column from its literal; NULL is the word without quotes."""
    kind, quoted = field.dataType, token.startswith("'")
    text = F.when(quoted, token.substr(F.lit(2), F.length(token) - 2)).otherwise(token)
    for mark, (_, meant) in zip(_MARKS, _ESCAPED, strict=True):
        text = F.replace(text, F.lit(mark), F.lit(meant))
    if isinstance(kind, T.BinaryType):
        value = F.when(quoted, F.encode(text, "UTF-8")).otherwise(F.unhex(F.substring(text, 3, 2**31 - 1)))
    elif isinstance(kind, T.BooleanType):
        value = text.cast("int").cast("boolean")
    elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        value = F.from_json(text, kind)
    else:
        value = text.cast(kind)
    return F.when(token != "NULL", value).alias(field.name)


def from_insert_sql(statements: DataFrame, schema: T.StructType, statement: str = "statement") -> DataFrame:
    """The rows of ``INSERT`` statements, as ``to_insert_sql`` writes them, typed by ``schema``.

    A statement may hold one row or many; quotes, line breaks, commas and brackets inside literals
    are told from those between them. Each statement is taken apart by itself with built-in
    expressions. A text that is no such statement, that holds one of the five private characters
    from U+F8F0 used on the way, or whose values do not make whole rows, is an error. Null and
    blank lines are left out.
    """
    width = len(schema.fields)
    text = F.col(statement)
    taken = F.raise_error(F.lit("a statement holds a private character that stands for an escape")).cast("string")
    marked = F.when(text.rlike(f"[{_MARKS[0]}-{_MARKS[-1]}]"), taken).otherwise(text)
    for mark, (sign, _) in zip(_MARKS, _ESCAPED, strict=True):
        marked = F.replace(marked, F.lit("\\" + sign), F.lit(mark))
    refused = F.raise_error(F.concat(F.lit("not an INSERT statement: "), F.substring("marked", 1, 80))).cast("string")
    found = statements.where(text.isNotNull() & ~text.rlike(r"\A\s*\z")).select(marked.alias("marked"))
    body = F.when(F.col("marked").rlike(_STATEMENT), F.regexp_extract("marked", _STATEMENT, 1)).otherwise(refused)
    tokens = found.select(F.regexp_extract_all(body, F.lit(_VALUE), F.lit(1)).alias("tokens"))
    uneven = F.raise_error(F.lit(f"a statement does not hold whole rows of {width} values")).cast("array<string>")
    whole = tokens.select(F.when(F.size("tokens") % width == 0, F.col("tokens")).otherwise(uneven).alias("tokens"))
    starts = F.filter(F.sequence(F.lit(0), F.size("tokens")), lambda at: (at % width == 0) & (at < F.size("tokens")))
    rows = whole.select(F.explode(F.transform(starts, lambda at: F.slice("tokens", at + 1, width))).alias("row"))
    return rows.select(*(_value(F.get("row", F.lit(k)), field) for k, field in enumerate(schema.fields)))
