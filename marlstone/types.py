"""The three types of the language, attributes, and what they are in Spark."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import types as T

from marlstone.errors import FormatError

INT, FLOAT, STRING, TIME = "INT", "FLOAT", "STRING", "TIME"
MAX_NAME, MAX_STRING, MAX_ELEMENTS = 24, 255, 40
PAGE_BYTES = 4092


@dataclass(frozen=True)
class Attribute:
    """length is in bytes as declared; 0 for strings of a registered table, which have no limit."""

    relation: str
    name: str
    kind: str
    length: int
    offset: int = 0
    indexed: bool = False

    @property
    def column(self) -> str:
        """The name inside plans, unique over all relations."""
        return f"{self.relation}.{self.name}"

    def spark_type(self) -> T.DataType:
        return {INT: T.IntegerType(), FLOAT: T.FloatType(), STRING: T.StringType()}[self.kind]

    def with_index(self, indexed: bool) -> Attribute:
        return replace(self, indexed=indexed)


def parse_type(text: str) -> tuple[str, int]:
    """i, i4, f, f4, r, r4, cN, sN."""
    m = re.match(r"(.)\s*([+-]?\d+)?", text, re.S)
    letter, size = m[1], m[2] and int(m[2])
    if letter == "i":
        if size not in (None, 4):
            raise FormatError("invalid size for INTEGER attribute (should be 4)")
        return INT, 4
    if letter in "fr":
        if size not in (None, 4):
            raise FormatError("invalid size for REAL attribute (should be 4)")
        return FLOAT, 4
    if letter in "sc":
        if size is None:
            raise FormatError("length must be specified for STRING attribute")
        if not 1 <= size <= MAX_STRING:
            raise FormatError("invalid length for string attribute")
        return STRING, size
    raise FormatError("invalid format string")


def attributes_of(relation: str, schema: T.StructType) -> list[Attribute]:
    """The attributes of a registered table; columns of other types are not visible to the language."""
    families = {T.IntegerType: (INT, 4), T.LongType: (INT, 8), T.ShortType: (INT, 2), T.FloatType: (FLOAT, 4), T.DoubleType: (FLOAT, 8), T.StringType: (STRING, 0), T.TimestampType: (TIME, 8), T.TimestampNTZType: (TIME, 8), T.DateType: (TIME, 4)}
    found, offset = [], 0
    for f in schema.fields:
        if type(f.dataType) in families:
            kind, length = families[type(f.dataType)]
            found.append(Attribute(relation, f.name, kind, length, offset))
            offset += length
    return found
