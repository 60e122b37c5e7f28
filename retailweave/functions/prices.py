"""Prices out of text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _count(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def parse_price(col: Column | str) -> Column:
    """First number of a price text, as double.

    With both separators the last one is the decimal one; a repeated separator groups thousands; a single one
    followed by exactly three digits does too (`1.770 €` is 1770).
    """
    text = F.regexp_replace(F.translate(F.coalesce(_c(col), F.lit("")), "\u00a0", " "), "(?i)eur|€", "")
    number = F.regexp_replace(F.regexp_extract(text, r"([0-9][0-9\s.,]*)", 1), r"\s+", "")

    def read(n: Column) -> Column:
        has_comma, has_dot = n.contains(","), n.contains(".")
        no_comma, no_dot = F.replace(n, F.lit(","), F.lit("")), F.replace(n, F.lit("."), F.lit(""))
        comma_last = F.instr(F.reverse(n), ",") < F.instr(F.reverse(n), ".")
        both = F.when(comma_last, F.translate(no_dot, ",", ".")).otherwise(no_comma)
        thousands = n.rlike(r"^[0-9]+[.,][0-9]{3}$")
        plain = (
            F.when(has_comma & has_dot, both)
            .when(_count(n, ",") > 1, no_comma)
            .when(_count(n, ".") > 1, no_dot)
            .when(thousands, F.translate(n, ",.", ""))
            .otherwise(F.translate(n, ",", "."))
        )
        return plain.try_cast("double")

    # a one-element transform: the number is cut out once, however often the rules look at it
    return F.get(F.transform(F.array(number), read), F.lit(0))


def coerce_price(col: Column | str) -> Column:
    """Strict form for structured values: a positive plain number, with the same reading of two separators."""
    text = F.regexp_replace(F.translate(F.coalesce(_c(col).cast("string"), F.lit("")), " ", ""), " ", "")
    text = F.trim(text)
    comma_last = F.instr(F.reverse(text), ",") < F.instr(F.reverse(text), ".")
    plain = F.when(
        text.contains(",") & text.contains("."),
        F.when(comma_last, F.translate(F.replace(text, F.lit("."), F.lit("")), ",", ".")).otherwise(
            F.replace(text, F.lit(","), F.lit(""))
        ),
    ).otherwise(F.translate(text, ",", "."))
    value = F.when(plain.rlike(r"^\d+(\.\d+)?$"), plain.try_cast("double"))
    return F.when(value > 0, value)
