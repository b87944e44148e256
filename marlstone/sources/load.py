"""Comma-separated text: no quotes, no header, lenient numbers; empty lines are skipped, missing fields are zero or empty.

Strings that are longer than declared are cut, and how many were is counted while the lines are read, not in a pass of
its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from marlstone.errors import EngineError
from marlstone.functions.fields import typed
from marlstone.sources.storage import Storage
from marlstone.types import STRING, Attribute

TOO_MANY = "a line has too many fields"


def read_lines(spark: SparkSession, path: str, attributes: tuple[Attribute, ...], cut: Observation | None = None) -> DataFrame:
    """One narrow stage from text to typed columns. A line with too many fields fails the load, which then has no effect.

    cut: gets n, the number of strings that were cut, when the rows have been written.
    """
    if not Storage(spark, path).exists():
        raise EngineError("SM_BADTABLE", f"{path} is not there")
    n = len(attributes)
    lines = spark.read.option("lineSep", "\n").text(path).filter("value != ''")
    fields = lines.select(F.split("value", ",", -1).alias("f"))
    checked = fields.select(F.when(F.size("f") <= n, F.col("f")).otherwise(F.raise_error(F.lit(TOO_MANY))).alias("f"))
    longer = [F.when(F.octet_length(F.get("f", i)) > a.length, 1).otherwise(0) for i, a in enumerate(attributes) if a.kind == STRING]
    if cut is not None:
        checked = checked.observe(cut, F.sum(sum(longer, F.lit(0))).alias("n"))
    return checked.select(*(typed(F.get("f", i), a).alias(a.name) for i, a in enumerate(attributes)))
