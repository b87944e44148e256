"""Results as aligned text."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import types as T

NUMBER_WIDTH, TEXT_WIDTH = 12, 53


def lines(rows: DataFrame, lengths: Sequence[int] | None = None) -> Iterator[str]:
    """Heading, rule, rows one at a time, and the number of rows. lengths: declared lengths of strings, 0 for others."""
    names = rows.columns
    texts = [isinstance(f.dataType, T.StringType) for f in rows.schema.fields]
    floats = [isinstance(f.dataType, (T.FloatType, T.DoubleType)) for f in rows.schema.fields]
    widths = []
    for name, text, length in zip(names, texts, lengths or [0] * len(names)):
        own = min(length or TEXT_WIDTH, TEXT_WIDTH) if text else NUMBER_WIDTH
        widths.append(own if len(name) < own else len(name) + 1)
    yield "".join(n.ljust(w) for n, w in zip(names, widths))
    yield "-" * sum(widths)
    count = 0
    for row in rows.toLocalIterator():
        shown = []
        for value, width, text, real in zip(row, widths, texts, floats):
            cell = f"{value:.6f}" if real else str(value)
            if text and len(cell) > TEXT_WIDTH - 1:
                cell = cell[: TEXT_WIDTH - 3] + ".."
            shown.append(cell.ljust(width))
        yield "".join(shown)
        count += 1
    yield ""
    yield f"{count} tuple(s)."
