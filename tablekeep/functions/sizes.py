"""Byte sizes: parsing and formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablekeep.functions.columns import as_column

# Unit suffixes, smallest first, each 1024 times the one before.
BYTE_UNITS = ["B", "KB", "MB", "GB", "TB", "PB", "EB", "ZB", "YB"]
SIGNED_BYTE_UNITS = ["Bytes", "KB", "MB", "GB", "TB", "PB", "EB", "ZB", "YB"]

# Unit letters, smallest first, and the most that is set aside.
_MULTIPLES = "KMGTPE"
MAX_RESERVE_BYTES = 15 * 1024**3


def _in_units(value: Column, magnitude: Column, units: list[str], precision: int) -> Column:
    def text(power: int) -> Column:
        # bround is half-even, as C's printf is on exact ties such as 1.125
        scaled = F.bround(value / F.lit(float(1024**power)), precision)
        return F.format_string(f"%.{precision}f{units[power]}", scaled)

    result = F.when(magnitude < 1024.0, text(0))
    for power in range(1, len(units) - 1):
        result = result.when(magnitude < float(1024 ** (power + 1)), text(power))
    return result.otherwise(F.when(value.isNotNull(), text(len(units) - 1)))


def format_bytes(n: Column | str, precision: int = 2) -> Column:
    """``1536`` becomes ``1.50KB``. A negative size is an error."""
    value = as_column(n).cast("double")
    return F.when(
        value < 0, F.raise_error(F.lit("a size cannot be negative")).cast("string")
    ).otherwise(_in_units(value, value, BYTE_UNITS, precision))


def format_bytes_signed(n: Column | str, precision: int = 2) -> Column:
    """As ``format_bytes`` for differences: negatives allowed, plain bytes spelled out."""
    value = as_column(n).cast("double")
    return _in_units(value, F.abs(value), SIGNED_BYTE_UNITS, precision)


def _is_number(text: Column) -> Column:
    """Digits, or digits on both sides of one point."""
    parts = F.split(text, r"\.")
    digits = F.forall(parts, lambda part: (part != "") & (F.translate(part, "0123456789", "") == ""))
    return (F.size(parts) <= 2) & digits


def _parse(text: Column, factors: dict[str, float], bare_power: int) -> Column:
    last = F.upper(F.right(text, F.lit(1)))
    factor = F.lit(float(1024**bare_power))
    for letter, value in factors.items():
        factor = F.when(last == letter, value).otherwise(factor)
    has_unit = last.isin(*factors)
    number = F.when(has_unit, text.substr(F.lit(1), F.length(text) - 1)).otherwise(text)
    return F.when(_is_number(number), (number.try_cast("double") * factor).try_cast("bigint"))


_FACTORS = {letter: float(1024**power) for power, letter in enumerate(_MULTIPLES, start=1)}


def parse_size(text: Column | str) -> Column:
    """``'1.5T'`` to bytes; a bare number is bytes; anything else is NULL."""
    return _parse(as_column(text).cast("string"), _FACTORS, 0)


def parse_bytes(text: Column | str) -> Column:
    """As ``parse_size`` with ``B`` allowed and a bare number meaning mebibytes."""
    return _parse(as_column(text).cast("string"), _FACTORS | {"B": 1.0}, 2)


def reserve_size(free: Column | str, size: Column | str) -> Column:
    """Bytes to set aside for a snapshot: free space, a fifth of the volume or 15 GiB,
    whichever is least."""
    return F.least(
        as_column(free).cast("double"),
        as_column(size).cast("double") * 0.2,
        F.lit(float(MAX_RESERVE_BYTES)),
    )
