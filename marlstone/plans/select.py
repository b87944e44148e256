"""A checked query as a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.operators import relational as R
from marlstone.plans.analysis import Query
from marlstone.sources.catalog import BATCH, CATALOGS, PLACE, Database
from marlstone.types import Attribute


def leaf(db: Database, name: str) -> DataFrame:
    """All rows of a relation under plan names."""
    r = db.relation(name)
    if name in CATALOGS:
        rows, order = db.catalog_rows(name), (BATCH, PLACE)
    elif r.table is not None:
        rows, order = r.table, r.order
    else:
        rows, order = db.rows(r), (BATCH, PLACE)
    return R.scan(rows, r.attributes, order)


def build(db: Database, q: Query, settings: dict[str, str] | None = None) -> DataFrame:
    """Filters at the leaves, joins, then grouping, order and projection. A grouped result is ordered by an attribute's own value in the group."""
    # Known sizes first, the smallest first; others as written.
    known = [db.relation(r).records for r in q.relations]
    order = sorted(range(len(known)), key=lambda i: (known[i] is None, known[i] or 0))
    names = [q.relations[i] for i in order]
    frames = {n: R.keep(leaf(db, n), (t for t in q.tests if t.relations == {n})) for n in names}
    if len(names) > 1:
        frames = {n: needed(q, n, f) for n, f in frames.items()}
    most = {n: r for i, n in zip(order, names) if (r := known[i]) is not None and n not in CATALOGS}
    rows = R.join_all(frames, q.tests, merged(q, settings or {}), most, unique(db, names))
    wanted = list(q.wanted)
    if q.group:
        carried = [("", q.order)] if q.order else []
        rows = R.grouped(rows, q.group, [*wanted, *carried], names)
    if q.order:
        rows = R.ordered(rows, q.order, q.descending)
    return R.project(rows, wanted)


def needed(q: Query, name: str, rows: DataFrame) -> DataFrame:
    """The columns of a relation that are read after its filters; its order if nothing else is."""
    attributes = [*(a for _, a in q.wanted), *(a for a in (q.order, q.group) if a), *(a for t in q.tests if t.relations != {name} for a in (t.left, t.right) if isinstance(a, Attribute))]
    own = list(dict.fromkeys(a.column for a in attributes if a.relation == name))
    ordered = [R.place(name)] if q.group or not own else []
    return rows.select(*(F.col(f"`{c}`") for c in (*own, *ordered)))


def unique(db: Database, names: list[str]) -> dict[str, frozenset[str]]:
    """The columns of registered tables by which their rows were said to be ordered, if those are not all columns."""
    relations = {n: db.relation(n) for n in names if n not in CATALOGS}
    return {n: frozenset(f"{n}.{c}" for c in r.order) for n, r in relations.items() if r.table is not None and r.order and len(r.order) < len(r.attributes)}


def merged(q: Query, settings: dict[str, str]) -> set[frozenset[str]]:
    """Pairs of relations to be joined by merging: both sides of an equality have an index, unless it is set otherwise."""
    if settings.get("mergejoin") == "no":
        return set()
    return {t.relations for t in q.tests if len(t.relations) == 2 and t.op == "=" and t.left.indexed and t.right.indexed}


def plan_text(rows: DataFrame) -> str:
    jvm = rows.sparkSession._jvm
    return jvm.PythonSQLUtils.explainString(rows._jdf.queryExecution(), "formatted")
