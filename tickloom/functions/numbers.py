"""Decimal numbers as files of the reference kind write them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: blanks around, one sign before or after, thousands commas, a point; no exponent.
NUMBER = r"^\s*(?:[+-]\s*)?(?:\d[\d,]*(?:\.\d*)?|\.\d+)\s*$|^\s*(?:\d[\d,]*(?:\.\d*)?|\.\d+)\s*[+-]\s*$"
KIND = "decimal(20,8)"


def _wide(text: Column) -> Column:
    return F.when(text.rlike(NUMBER), F.regexp_replace(text, r"[\s,+-]", "")).try_cast("decimal(38,18)")


def _fitting(wide: Column, exact: Column, minus: Column) -> Column:
    return F.when(exact.cast("decimal(38,18)") == wide, F.when(minus, -exact).otherwise(exact).cast(KIND))


def parse_decimal(text: Column) -> Column:
    """The number as decimal(20,8), or null for other texts and for numbers too large or finer than eight digits."""
    wide = _wide(text)
    return _fitting(wide, wide.try_cast(KIND), text.contains("-"))


def with_decimals(df: DataFrame, texts: dict[str, Column]) -> DataFrame:
    """Adds the numbers of several texts, each text matched once: what is used twice is a column of its own."""
    df = df.withColumns({f"_wide_{name}": _wide(text) for name, text in texts.items()})
    df = df.withColumns({f"_exact_{name}": F.col(f"_wide_{name}").try_cast(KIND) for name in texts})
    df = df.withColumns({name: _fitting(F.col(f"_wide_{name}"), F.col(f"_exact_{name}"), text.contains("-")) for name, text in texts.items()})
    return df.drop(*(f"_{step}_{name}" for step in ("wide", "exact") for name in texts))
