"""Comparison as the language defines it, as Column expressions."""

from __future__ import annotations

import operator
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone.types import FLOAT, INT, STRING, TIME, Attribute

OPERATORS: dict[str, Callable[[Column, Column], Column]] = {"=": operator.eq, "<>": operator.ne, "<": operator.lt, ">": operator.gt, "<=": operator.le, ">=": operator.ge}
MIRRORED = {"=": "=", "<>": "<>", "<": ">", ">": "<", "<=": ">=", ">=": "<="}


def first_bytes(text: Column, n: int) -> Column:
    """The characters that lie whole in the first n bytes of a string; strings that fit, by far the most, are passed on.

    A cut character goes, as half of one is no string to Spark, its files or its readers.
    """
    cut = F.make_valid_utf8(F.substring(text.cast("binary"), 1, n).cast("string"))
    return F.when(F.octet_length(text) <= n, text).otherwise(F.regexp_replace(cut, "\ufffd+$", ""))


def column(attribute: Attribute) -> Column:
    return F.col(f"`{attribute.column}`")


def literal(value: int | float | str, attribute: Attribute) -> Column:
    """A literal as the attribute's type. A 4-byte float compares with the literal rounded to 4 bytes, so 4.1 equals a stored 4.1."""
    if attribute.kind == FLOAT:
        return F.lit(float(value)).cast("float" if attribute.length == 4 else "double")
    if attribute.kind == INT:
        return F.lit(int(value)) if -(1 << 31) <= value < 1 << 31 else F.lit(int(value)).cast("long")
    if attribute.kind == TIME:
        return F.to_timestamp(F.lit(value))
    # No more than the declared length of the left side, in bytes, takes part.
    return F.lit(value.encode()[: attribute.length].decode(errors="ignore") if attribute.length else value)


def compare(left: Attribute, op: str, right: Attribute | int | float | str) -> Column:
    """left op right. Strings compare by bytes, over no more than the declared length of the left attribute."""
    if not isinstance(right, Attribute):
        return OPERATORS[op](column(left), literal(right, left))
    return OPERATORS[op](*sides(left, right))


def cuts(left: Attribute, right: Attribute) -> bool:
    """Whether a string of the right side may be longer than the left side's declared length."""
    return left.kind == STRING and left.length > 0 and (right.length == 0 or right.length > left.length)


def sides(left: Attribute, right: Attribute) -> tuple[Column, Column]:
    """What is compared of two attributes."""
    return column(left), first_bytes(column(right), left.length) if cuts(left, right) else column(right)
