"""Delete and update as DataFrames: the rows of the relation afterwards, and the rows to show."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.compare import first_bytes
from marlstone.operators.relational import Test
from marlstone.types import STRING, Attribute


def matching(tests: Sequence[Test]) -> Column:
    return reduce(and_, (t.column() for t in tests), F.lit(True))


def deleted(rows: DataFrame, tests: Sequence[Test]) -> tuple[DataFrame, DataFrame]:
    """Rows that stay, and rows that went."""
    hit = F.coalesce(matching(tests), F.lit(False))
    return rows.filter(~hit), rows.filter(hit)


def updated(rows: DataFrame, a: Attribute, value: Column, tests: Sequence[Test]) -> tuple[DataFrame, DataFrame]:
    """All rows, and the changed ones as they are now. Which rows change is decided on their old values."""
    if a.kind == STRING and a.length:
        value = first_bytes(value, a.length)
    hit = F.coalesce(matching(tests), F.lit(False))
    marked = rows.withColumn("__hit", hit)
    after = marked.withColumn(a.column, F.when(F.col("__hit"), value).otherwise(F.col(f"`{a.column}`")))
    return after.drop("__hit"), after.filter("__hit").drop("__hit")
