"""Parse rules: source text to a typed value plus a flag for text that cannot be one.

A rule never raises and never repairs. Blank text is a missing value unless the rule is
marked required.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roostline import config
from roostline.functions.text import distinct_names, has_nul, single_spaced, stripped

# Characters that decorate a price.
CURRENCY_MARKS = "$\u00a3\u20ac,\u00a0 "

_DIGITS = "[0-9]+(?:_[0-9]+)*"
_WHOLE = f"^[+-]?{_DIGITS}$"
# How a number is written; whatever is cast to one is matched against it first.
DECIMAL = rf"^[+-]?(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?$"
_BATH_COUNT = r"^[0-9]+(?:\.[0-9]+)? (?:shared |private )?baths?$"
_HALF_BATH = r"^(?:shared |private )?half-bath$"


class Parsed(NamedTuple):
    """How to read a value, and how to tell from the read value that the text is refused.

    The second part takes the column the value was stored in, so nothing is parsed twice.
    """

    value: Column
    bad: Callable[[Column], Column]


def required(rule: Parsed) -> Parsed:
    return Parsed(rule.value, lambda v: v.isNull() | rule.bad(v))


def within(rule: Parsed, low=None, high=None) -> Parsed:
    """Refuse values outside the closed range."""

    def bad(v: Column) -> Column:
        out = rule.bad(v)
        if low is not None:
            out = out | F.coalesce(v < low, F.lit(False))
        if high is not None:
            out = out | F.coalesce(v > high, F.lit(False))
        return out

    return Parsed(rule.value, bad)


def _unless_blank(text: Column, value: Column) -> Parsed:
    """Blank text is missing; other text has to give a value."""
    return Parsed(value, lambda v: v.isNull() & (text != ""))


def whole_number(col: Column, fits: tuple[int, int] = config.INT8_RANGE) -> Parsed:
    text = stripped(col)
    value = F.when(text.rlike(_WHOLE), F.translate(text, "_", "")).try_cast("bigint")
    if fits != config.INT8_RANGE:
        value = F.nullif(F.greatest(F.least(value, F.lit(fits[1] + 1)), F.lit(fits[0] - 1)), F.lit(fits[1] + 1))
        value = F.nullif(value, F.lit(fits[0] - 1))
    return _unless_blank(text, value)


def finite_number(col: Column, largest: float | None = None) -> Parsed:
    text = stripped(col)
    value = F.when(text.rlike(DECIMAL), F.translate(text, "_", "")).try_cast("double")
    limit = largest if largest is not None else 1.7976931348623157e308
    return Parsed(value, lambda v: (v.isNull() & (text != "")) | F.coalesce(F.abs(v) > F.lit(limit), F.lit(False)))


def price(col: Column) -> Parsed:
    """A decorated, non-negative amount; blank stays unknown instead of free."""
    text = stripped(col)
    number = finite_number(F.translate(text, CURRENCY_MARKS, ""), config.FLOAT4_MAX)
    return Parsed(
        number.value,
        lambda v: (v.isNull() & (text != ""))
        | F.coalesce((v < 0) | (v > F.lit(config.FLOAT4_MAX)), F.lit(False)),
    )


def bath_count(col: Column) -> Parsed:
    """Worded bathroom counts, with a half-bath worth 0.5."""
    text = single_spaced(F.lower(col))
    value = F.when(text.rlike(_HALF_BATH), F.lit(0.5)).when(
        text.rlike(_BATH_COUNT), F.substring_index(text, " ", 1).try_cast("double")
    )
    return _unless_blank(stripped(col), value)


def flag(col: Column) -> Parsed:
    text = F.lower(stripped(col))
    value = F.when(text.isin("t", "true"), F.lit(True)).when(
        text.isin("f", "false"), F.lit(False)
    )
    return _unless_blank(text, value)


def iso_date(col: Column) -> Parsed:
    """A required calendar date written ``yyyy-MM-dd`` or ``yyyyMMdd``."""
    text = stripped(col)
    dashed = F.regexp_replace(text, "^([0-9]{4})([0-9]{2})([0-9]{2})$", "$1-$2-$3")
    value = F.when(
        dashed.rlike("^(?!0000)[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(dashed, "yyyy-MM-dd")
    )
    return Parsed(value, lambda v: v.isNull())


def words(col: Column) -> Parsed:
    """Trimmed text; blank is missing and a NUL byte is refused."""
    return Parsed(F.nullif(stripped(col), F.lit("")), lambda v: F.coalesce(has_nul(v), F.lit(False)))


def listed_strings(rows: DataFrame, column: str, out: str) -> DataFrame:
    """``rows`` with a JSON list of strings as ``array<string>`` in ``out``.

    NULL where the text is refused: no JSON, no list, an entry that is no string, or a
    NUL byte. Each step is a column of its own, so that the text is parsed once.
    """
    text = stripped(F.col(column))
    steps = rows.withColumn("_json", F.try_parse_json(text))
    strings = F.try_variant_get("_json", "$", "array<string>")
    is_list = F.schema_of_variant("_json").isin("ARRAY<STRING>", "ARRAY<VOID>")
    listed = F.when(is_list, strings).when(text == "", F.array().cast("array<string>"))
    steps = steps.withColumn(out, listed)
    usable = ~F.exists(out, lambda s: s.isNull() | has_nul(s))
    return steps.withColumn(out, F.when(usable, F.col(out))).drop("_json")


def name_list(rows: DataFrame, column: str, out: str) -> DataFrame:
    """``rows`` with a JSON list of strings as ``array<struct<name, key>>`` in ``out``, NULL where it is refused."""
    return distinct_names(listed_strings(rows, column, "_strings"), "_strings", out).drop("_strings")
