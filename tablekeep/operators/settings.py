"""Layered settings: merging and validation.

Settings are long tables ``(scope, section, key, value)`` with text values.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablekeep.functions.text import canonical_key
from tablekeep.functions.values import to_args, to_boolean, to_float, to_integer, to_list, to_log_level, to_octal

SETTING_KEYS = ["scope", "section", "key"]


@dataclass(frozen=True)
class Setting:
    """What a setting must look like. ``default=None`` makes it mandatory."""

    section: str
    key: str
    type: str = "string"
    default: str | None = None
    minimum: int | None = None
    maximum: int | None = None
    options: Sequence[str] = ()


def canonical(settings: DataFrame) -> DataFrame:
    return settings.withColumn("key", canonical_key("key"))


def one_per_key(settings: DataFrame, value: str) -> DataFrame:
    """One value per canonical key. Where a layer spells a key in several ways, the canonical
    spelling wins, then the largest value."""
    spelled = F.struct((F.col("key") == canonical_key("key")).alias("canonical"), F.col("value").alias("value"))
    keyed = settings.withColumn("_spelled", spelled)
    return canonical(keyed).groupBy(*SETTING_KEYS).agg(F.max("_spelled")["value"].alias(value))


def merge_settings(provider: DataFrame, override: DataFrame) -> DataFrame:
    """Provider values under overriding ones, one value per canonical key."""
    lower, upper = one_per_key(provider, "_lower"), one_per_key(override, "_upper")
    return lower.join(upper, SETTING_KEYS, "full_outer").select(
        *SETTING_KEYS, F.coalesce("_upper", "_lower").alias("value")
    )


def for_scopes(scopes: DataFrame, spec: Sequence[Setting]) -> DataFrame:
    """The defaults of ``spec`` as settings of every scope, one row per scope and setting."""
    rows = F.array(
        *(
            F.struct(F.lit(s.section).alias("section"), F.lit(s.key).alias("key"), F.lit(s.default).cast("string").alias("value"))
            for s in spec
        )
    )
    return scopes.select("scope", F.inline(rows))


def _fits(value: Column, setting: Setting) -> Column:
    """Status of a given value: ok, bad_type, out_of_range or bad_option."""

    def ranged(number: Column) -> Column:
        inside = F.lit(True)
        if setting.minimum is not None:
            inside = inside & (number >= setting.minimum)
        if setting.maximum is not None:
            inside = inside & (number <= setting.maximum)
        return F.when(number.isNull(), "bad_type").when(inside, "ok").otherwise("out_of_range")

    match setting.type:
        case "integer":
            return ranged(to_integer(value))
        case "float":
            return ranged(to_float(value))
        case "octal":
            return ranged(to_octal(value))
        case "boolean":
            return F.when(to_boolean(value).isNull(), "bad_type").otherwise("ok")
        case "option":
            return F.when(value.isin(*setting.options), "ok").otherwise("bad_option")
        case "list" | "force_list" | "coerced_list":
            return ranged(F.size(to_list(value)))
        case "logging_level":
            return F.when(to_log_level(value).isNull(), "bad_type").otherwise("ok")
        case "cmd_args":
            return F.when(to_args(value).isNull(), "bad_type").otherwise("ok")
        case "string":
            return F.when(value.isNotNull(), "ok").otherwise("bad_type")
    raise ValueError(f"unknown setting type {setting.type!r}")


def validate_settings(settings: DataFrame, spec: Sequence[Setting]) -> DataFrame:
    """``DF(scope, section, key, value, status)`` with absent settings filled in.

    Status is ok, bad_type, out_of_range, bad_option, unknown for a setting outside ``spec``,
    default where the default was filled in, and missing where there is none. ``spec`` becomes
    expressions, so given settings are judged in one narrow pass.
    """
    given = canonical(settings)
    status = F.lit("unknown")
    for s in spec:
        this = (F.col("section") == s.section) & (F.col("key") == s.key)
        status = F.when(this, _fits(F.col("value"), s)).otherwise(status)
    judged = given.select(*SETTING_KEYS, "value", status.alias("status"))
    absent = (
        for_scopes(given.select("scope").distinct(), spec)
        .join(given.select(*SETTING_KEYS), SETTING_KEYS, "left_anti")
        .withColumn("status", F.when(F.col("value").isNull(), "missing").otherwise("default"))
    )
    return judged.unionByName(absent)
