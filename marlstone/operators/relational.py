"""Scan, filter, join, grouping, order and projection.

They state what is wanted; Catalyst pushes comparisons into the Parquet scan, prunes columns and picks join algorithms,
and adaptive execution splits skewed partitions. It splits by bytes, though, so joins that make far more pairs than they
read rows, of which a few values or none are equal, are dealt to tasks by pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.compare import MIRRORED, column, compare, cuts, sides
from marlstone.types import FLOAT, Attribute

PLACE = "__order"
#: Pairs that a task of a dealt join compares, more or less, and rows of the right side that it holds for them.
PAIRS, HELD = 1 << 24, 1 << 12
#: Pairs for each row read, from which a join is dealt.
MANY = 16
#: Tasks of a dealt join, at most; beyond 3 * 10^11 pairs they grow.
TASKS = 20_000


@dataclass(frozen=True)
class Test:
    """A checked condition: an attribute against an attribute or a literal."""

    left: Attribute
    op: str
    right: Attribute | int | float | str

    @property
    def relations(self) -> frozenset[str]:
        return frozenset({self.left.relation, self.right.relation} if isinstance(self.right, Attribute) else {self.left.relation})

    def column(self) -> Column:
        return compare(self.left, self.op, self.right)

    def mirrored(self) -> Test:
        return Test(self.right, MIRRORED[self.op], self.left)


def place(relation: str) -> str:
    return f"{relation}.{PLACE}"


def scan(rows: DataFrame, attributes: Sequence[Attribute], order: Sequence[str]) -> DataFrame:
    """A relation's attributes under their plan names, and its row order as one column."""
    named = [F.col(f"`{a.name}`").alias(a.column) for a in attributes]
    return rows.select(*named, F.struct(*(F.col(f"`{c}`") for c in order)).alias(place(attributes[0].relation)))


def keep(rows: DataFrame, tests: Iterable[Test]) -> DataFrame:
    tests = list(tests)
    return rows.filter(reduce(and_, (t.column() for t in tests))) if tests else rows


def join(left: DataFrame, right: DataFrame, tests: Sequence[Test], merge: bool = False) -> DataFrame:
    """Inner join on any comparisons; all pairs only where the statement asks for them by giving none."""
    if not tests:
        return left.crossJoin(right)
    return left.join(right.hint("merge") if merge else right, reduce(and_, (t.column() for t in tests)), "inner")


def dealt(left: DataFrame, right: DataFrame, tests: Sequence[Test]) -> DataFrame | None:
    """The same join by tasks of about PAIRS pairs each, if it makes so many that a task for each value or file would be long.

    Counts of the rows of each value say so, in a job of their own. The rows of a value with more than PAIRS pairs are
    dealt into blocks on both sides, and each block of the one meets each of the other once, in a task found by hash.
    """
    equal, rest = [t for t in tests if t.op == "="], [t for t in tests if t.op != "="]
    keys = [_keys(left, right, t) for t in equal]
    left_keys, right_keys = [f"__l{i}" for i in range(len(keys))], [f"__r{i}" for i in range(len(keys))]
    # A null equals nothing.
    left, right = left.withColumns({n: a for n, (a, _) in zip(left_keys, keys)}).dropna(subset=left_keys), right.withColumns({n: b for n, (_, b) in zip(right_keys, keys)}).dropna(subset=right_keys)
    on = [F.col(a) == F.col(b) for a, b in zip(left_keys, right_keys)]
    counts = _matched(left.groupBy(*left_keys).agg(F.count(F.lit(1)).alias("__m")), right.groupBy(*right_keys).agg(F.count(F.lit(1)).alias("__n")), on)
    pairs = F.col("__m").cast("double") * F.col("__n")
    heavy = pairs > PAIRS
    total, rows, square = counts.agg(F.sum(pairs), F.sum(F.col("__m").cast("double") + F.col("__n")), F.max(heavy & (F.least("__m", "__n") > MANY))).first()
    if not total or not (square or total > max(PAIRS, MANY * rows)):
        return None
    across = F.ceil(F.col("__n") / HELD)
    blocks = counts.filter(heavy).select(*left_keys, *right_keys, F.ceil(pairs / (PAIRS * across)).cast("int").alias("__down"), across.cast("int").alias("__across"))
    tasks = int(min(-(-total // PAIRS), TASKS))
    left_cell, right_cell = [*left_keys, "__li", "__lj"], [*right_keys, "__ri", "__rj"]
    left = _deal(left, blocks.drop(*right_keys), left_keys, ("__li", "__down"), ("__lj", "__across")).repartition(tasks, *left_cell)
    right = _deal(right, blocks.drop(*left_keys), right_keys, ("__rj", "__across"), ("__ri", "__down")).repartition(tasks, *right_cell)
    met = [F.col(a) == F.col(b) for a, b in zip(left_cell, right_cell)]
    return left.join(right.hint("merge"), reduce(and_, [*met, *(t.column() for t in rest)]), "inner").drop(*left_cell, *right_cell)


def _keys(left: DataFrame, right: DataFrame, test: Test) -> tuple[Column, Column]:
    """What an equality compares of the left and of the right rows, as one type whose equal values have equal bytes."""
    a, b = sides(test.left, test.right)
    if test.left.column not in left.columns:
        a, b = b, a
    if test.left.kind == FLOAT:
        # -0.0 is 0.0; no two others have the same digits.
        return tuple((c.cast("double") + F.lit(0.0)).cast("string") for c in (a, b))
    both = left.crossJoin(right).select(F.coalesce(a, b)).schema[0].dataType
    return a.cast(both), b.cast(both)


def _matched(left: DataFrame, right: DataFrame, on: Sequence[Column]) -> DataFrame:
    return left.join(right, reduce(and_, on), "inner") if on else left.crossJoin(right)


def _deal(rows: DataFrame, blocks: DataFrame, keys: Sequence[str], own: tuple[str, str], other: tuple[str, str]) -> DataFrame:
    """Rows with the block they are in, of their own side's number of blocks, once for each block of the other side.

    own, other: (column of the block, column of the number of blocks). The block follows from what is in the row, so that
    a task that is run again deals alike; copies of a row, which are told apart by nothing, take turns.
    """
    values = [F.col(f"`{c}`") for c in rows.columns]
    rows = rows.withColumn("__hash", F.xxhash64(*values))
    rows = rows.withColumn("__turn", F.row_number().over(Window.partitionBy("__hash").orderBy(*values)))
    # No more values than one for each 2 * HELD rows have blocks.
    named = blocks.select(*(F.col(k).alias(f"{k}b") for k in keys), *(F.col(n) for _, n in (own, other)))
    on = [F.col(k) == F.col(f"{k}b") for k in keys]
    rows = rows.join(F.broadcast(named), reduce(and_, on) if on else F.lit(True), "left")
    (block, n), (met, m) = own, other
    rows = rows.withColumns({n: F.coalesce(n, F.lit(1)), m: F.coalesce(m, F.lit(1))})
    rows = rows.withColumn(block, F.pmod(F.pmod("__hash", n) + F.col("__turn"), n).cast("int"))
    return rows.withColumn(met, F.explode(F.sequence(F.lit(0), F.col(m) - 1))).drop("__hash", "__turn", n, m, *(f"{k}b" for k in keys))


def join_all(frames: dict[str, DataFrame], tests: Sequence[Test], merge: set[frozenset[str]] = frozenset(), most: dict[str, int] | None = None, unique: dict[str, frozenset[str]] | None = None) -> DataFrame:
    """Left-deep over the relations in their order, but the next is one that a test connects, if any is. A test applies as soon as its relations are there.

    most: numbers of rows of relations, where they are known; unique: columns that tell a relation's rows apart. Joins of
    few rows, and those that give a row of one side no more than one partner, are not counted for being dealt; nor are
    joins of what a dealt one gave, which would be made again for it and is in many tasks, of many bytes, already.
    """
    most, unique = most or {}, unique or {}
    waiting = list(frames)
    rest = [t for t in tests if len(t.relations) == 2]
    first = waiting.pop(0)
    done, rows = {first}, frames[first]
    size, apart, spread = most.get(first), [unique[first]] if first in unique else [], False
    while waiting:
        linked = (r for r in waiting if any(r in t.relations and t.relations - {r} <= done for t in rest))
        new = next(linked, waiting[0])
        waiting.remove(new)
        now = [t for t in rest if new in t.relations and t.relations - {new} <= done]
        rest = [t for t in rest if t not in now]
        size = None if size is None or new not in most else size * most[new]
        given = {a.column for t in now if t.op == "=" for a in ((t.left,) if cuts(t.left, t.right) else (t.left, t.right))}
        old, own = [u for u in apart if u <= given], [u for u in [unique.get(new)] if u and u <= given]
        # Rows keep being told apart by what did so on the side whose rows have no more than one partner.
        apart = [*(apart if own else []), *([unique[new]] if old and new in unique else [])]
        made = None if spread or old or own or (size is not None and size <= PAIRS) else dealt(rows, frames[new], now)
        spread = spread or made is not None
        rows = join(rows, frames[new], now, any(t.op == "=" and t.relations in merge for t in now)) if made is None else made
        done.add(new)
    return rows


def grouped(rows: DataFrame, key: Attribute, wanted: Sequence[tuple[str, Attribute]], relations: Sequence[str]) -> DataFrame:
    """A row for each value of the key; wanted: (function, attribute), named by output_name.

    Counting, least and greatest combine before the shuffle. An attribute without a function is that of the group's
    last row in the order of its input, which is the relations' row order, one after the other.
    """
    last = F.struct(*(F.col(f"`{place(r)}`") for r in relations))
    columns = []
    for function, a in dict.fromkeys(wanted):
        if function == "COUNT":
            made = F.count(F.lit(1))
        elif function == "MIN":
            made = F.min(column(a))
        elif function == "MAX":
            made = F.max(column(a))
        elif a == key:
            continue
        else:
            made = F.max_by(column(a), last)
        columns.append(made.alias(output_name(function, a)))
    by = rows.groupBy(column(key).alias(key.column))
    return by.agg(*columns) if columns else rows.select(column(key).alias(key.column)).distinct()


def output_name(function: str, a: Attribute) -> str:
    return f"{function}({a.column})" if function else a.column


def ordered(rows: DataFrame, a: Attribute, descending: bool = False) -> DataFrame:
    return rows.orderBy(column(a).desc() if descending else column(a).asc())


def project(rows: DataFrame, wanted: Sequence[tuple[str, Attribute]]) -> DataFrame:
    """The select list under its headings."""
    return rows.select(*(F.col(f"`{output_name(f, a)}`") for f, a in wanted)).toDF(*headings(wanted))


def headings(wanted: Sequence[tuple[str, Attribute]]) -> list[str]:
    """attribute, or relation.attribute where another element has the same attribute name; in brackets behind a function."""
    names = [a.name for _, a in wanted]
    plain = [a.column if names.count(a.name) > 1 else a.name for _, a in wanted]
    return [f"{f}({n})" if f else n for (f, _), n in zip(wanted, plain)]
