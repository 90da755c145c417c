"""Amounts. Three readings of the same text are kept apart, as they differ on purpose."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.text import INVISIBLE, let, strip


def _last(c: Column, mark: str) -> Column:
    """Characters behind the last mark, null without one."""
    return F.when(c.contains(mark), F.length(F.substring_index(c, mark, -1)))


def _localized(c: Column, comma_is_point: Column, dot_is_point: Column) -> Column:
    no_dot, no_comma = F.translate(c, ".", ""), F.translate(c, ",", "")
    return F.when(comma_is_point, F.translate(no_dot, ",", ".")).when(dot_is_point, no_comma).otherwise(F.translate(c, ".,", ""))


def _read(t: Column, decimal_tail: Callable[[Column], Column], kind: str) -> Column:
    """A number text. With both marks the last is the decimal mark; alone, one is if decimal_tail holds for the digits behind it."""
    def read(x: Column) -> Column:
        both = x["dot"].isNotNull() & x["comma"].isNotNull()
        comma_point = F.when(both, x["comma"] < x["dot"]).otherwise(F.coalesce(decimal_tail(x["comma"]), F.lit(False)))
        dot_point = F.when(both, x["dot"] < x["comma"]).otherwise(F.coalesce(decimal_tail(x["dot"]), F.lit(False)))
        return _localized(x["t"], comma_point, dot_point).try_cast(kind)
    return let(t, lambda v: let(F.struct(v.alias("t"), _last(v, ".").alias("dot"), _last(v, ",").alias("comma")), read))


def parse_currency(c: Column) -> Column:
    """double: a mark with three digits behind it, alone, divides thousands; any other is decimal. Digits alone or with two behind a point are read as they stand, with the same result."""
    return F.when(c.rlike(r"\A\d+(?:\.\d{2})?\z"), c.try_cast("double")).otherwise(_currency_within(c))


def _currency_within(c: Column) -> Column:
    t = F.nullif(F.regexp_replace(c, r"[^\d.,-]", ""), F.lit(""))
    return _read(t, lambda n: n != 3, "double")


def normalize_amount(c: Column) -> Column:
    """decimal(14,2), half up: a mark alone is decimal only with one or two digits behind it."""
    t = F.regexp_replace(c, r"[^\d,.\-]", "")
    return F.round(_read(t, lambda n: n.isin(1, 2), "decimal(30,8)"), 2).try_cast("decimal(14,2)")


def validator_amount(c: Column) -> Column:
    """decimal: every comma dropped, so 50.000,00 reads as 50."""
    return strip(F.regexp_replace(F.regexp_replace(c, r"\$", ""), ",", "")).try_cast("decimal(30,8)")


def format_money(c: Column) -> Column:
    """Two decimals, half up; null is 0.00."""
    return F.coalesce(F.round(c.cast("decimal(30,8)"), 2), F.lit(0)).cast("decimal(28,2)").cast("string")


def plain_decimal(c: Column) -> Column:
    """A decimal as text without trailing zeros."""
    t = c.cast("string")
    return F.when(t.contains("."), F.regexp_replace(F.regexp_replace(t, "0+$", ""), r"\.$", "")).otherwise(t)


def normalize_reference(c: Column) -> Column:
    """Upper case, one space, without characters that take no room. A word of ASCII letters and marks, with blanks around it or not, needs no patterns beyond that."""
    return F.when(c.rlike(r"\A *[\x21-\x7e]* *\z"), F.upper(F.trim(c))).otherwise(_reference_within(c))


def _reference_within(c: Column) -> Column:
    return F.regexp_replace(F.upper(strip(F.translate(F.coalesce(c, F.lit("")), INVISIBLE, ""))), r"\s+", " ")


def record_signature(reference: Column, amount: Column) -> Column:
    return F.concat(F.upper(strip(F.coalesce(reference, F.lit("")))), F.lit("|"), strip(F.coalesce(amount, F.lit(""))))
