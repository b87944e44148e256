"""Fields of comma-separated lines, read leniently: a number's longest prefix, or zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone.functions.compare import first_bytes
from marlstone.types import FLOAT, INT, Attribute

INT_PREFIX = r"^\s*([+-]?[0-9]+)"
FLOAT_PREFIX = r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"


def typed(token: Column, attribute: Attribute) -> Column:
    """The value of a field; missing ones are zero or empty, as no value is ever null."""
    if attribute.kind == INT:
        # Beyond four bytes the nearest value stands.
        wide = F.regexp_extract(token, INT_PREFIX, 1).try_cast("decimal(38,0)")
        held = F.greatest(F.least(wide, F.lit((1 << 31) - 1).cast("decimal(38,0)")), F.lit(-(1 << 31)).cast("decimal(38,0)"))
        return F.when(wide.isNull(), 0).otherwise(held.cast("int"))
    if attribute.kind == FLOAT:
        return F.coalesce(F.regexp_extract(token, FLOAT_PREFIX, 1).try_cast("float"), F.lit(0.0).cast("float"))
    return F.coalesce(first_bytes(token, attribute.length), F.lit(""))
