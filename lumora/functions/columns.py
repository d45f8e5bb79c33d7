"""Column functions: name normalisation, missing tokens, safe arithmetic, number and date parsing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# Texts read as missing, by file ingest and by conversion to a category.
NA_TOKENS = ["", " ", "NA", "N/A", "NULL"]
CATEGORY_NA_TOKENS = ["nan", "None", "null"]

# Date formats, in trial order, in Spark pattern letters.
DATE_FORMATS = ["yyyy-MM-dd", "dd/MM/yyyy", "yyyy-MM-dd HH:mm:ss", "dd-MM-yyyy", "MM/dd/yyyy"]


def normalize_name(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"[_\-\s]+", " "))


def null_tokens(c: Column, tokens: Sequence[str] = NA_TOKENS) -> Column:
    trimmed = F.trim(c)
    return F.when(~trimmed.isin(sorted({t.strip() for t in tokens})), c)


def to_category(c: Column) -> Column:
    text = c.cast("string")
    return F.when(~text.isin(CATEGORY_NA_TOKENS), text)


def strip_symbols(c: Column) -> Column:
    """Text of a number without blanks, no-break blanks and % $ €."""
    return F.regexp_replace(c, "[\\s\\u00A0%$€]", "")


def to_number(c: Column, lone_comma_decimal: bool | Column = True) -> Column:
    """Number with either decimal mark; null when the text is not one.

    When both marks occur, the last one is the decimal mark. A mark that repeats groups thousands. A single
    comma is the decimal mark unless exactly three digits follow; then `lone_comma_decimal` decides.
    """
    text = strip_symbols(c)
    plain_comma, plain_dot = F.replace(text, F.lit(","), F.lit("")), F.replace(text, F.lit("."), F.lit(""))
    commas, dots = F.length(text) - F.length(plain_comma), F.length(text) - F.length(plain_dot)
    after_comma = F.length(F.substring_index(text, ",", -1))
    comma_last = after_comma < F.length(F.substring_index(text, ".", -1))
    european, american = F.replace(plain_dot, F.lit(","), F.lit(".")), plain_comma
    flag = F.lit(lone_comma_decimal) if isinstance(lone_comma_decimal, bool) else lone_comma_decimal
    chosen = (
        F.when((commas > 0) & (dots > 0), F.when(comma_last, european).otherwise(american))
        .when(dots > 1, european)
        .when((commas == 1) & (flag | (after_comma != 3)), european)
        .otherwise(american)
    )
    return chosen.try_cast("double")


def to_moment(c: Column, fmt: str) -> Column:
    """Timestamp of a text in one format, null when it does not match."""
    return F.try_to_timestamp(c, F.lit(fmt))


def safe_float(c: Column) -> Column:
    return c.try_cast("double")


def safe_int(c: Column) -> Column:
    return c.try_cast("bigint")


def safe_divide(a: Column, b: Column, default: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(default))


def safe_percentage(part: Column, whole: Column, default: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")) * 100, F.lit(default))
