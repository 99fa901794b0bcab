"""Run names, dates and durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablekeep.functions.columns import as_column

RUN_NAME_FORMAT = "yyyyMMdd_HHmmss"
_RUN_NAME = r"\A(\d{4})(\d{2})(\d{2})_(\d{2})(\d{2})(\d{2})\z"

# Run names have second resolution and are unique in a set, so one day of one set never
# holds more than 86,400 runs.
_DAY_PREFIX = len("yyyyMMdd")


def run_name(ts: Column | str) -> Column:
    return F.date_format(as_column(ts), RUN_NAME_FORMAT)


def parse_run_name(name: Column | str) -> Column:
    """The start time a run name stands for, NULL when it is not a run name. No time zone is involved."""
    col = as_column(name)
    return F.when(col.rlike(_RUN_NAME), F.regexp_replace(col, _RUN_NAME, "$1-$2-$3 $4:$5:$6").try_cast("timestamp_ntz"))


def run_day(name: Column | str) -> Column:
    return F.substring(as_column(name), 1, _DAY_PREFIX)


def format_datetime(ts: Column | str) -> Column:
    """``Mon Jan 01 2024 01:02:03AM``"""
    return F.date_format(as_column(ts), "EEE MMM dd yyyy hh:mm:ssa")


def format_interval(seconds: Column | str) -> Column:
    """``1 hour, 2 minutes, 3.50 seconds``; zero gives an empty text."""
    total = as_column(seconds).cast("double")

    def part(name: str, size: int, within: int | None) -> Column:
        count = F.floor((F.pmod(total, F.lit(float(within))) if within else total) / size)
        return F.when(count == 1, f"1 {name}").when(
            count > 1, F.concat(count.cast("string"), F.lit(f" {name}s"))
        )

    rest = F.pmod(total, F.lit(60.0))
    return F.concat_ws(
        ", ",
        part("week", 604800, None),
        part("day", 86400, 604800),
        part("hour", 3600, 86400),
        part("minute", 60, 3600),
        F.when(rest == 1.0, "1.00 second").when(rest != 0.0, F.format_string("%.2f seconds", rest)),
    )
