"""A session: statements as text in, results out."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from marlstone import printer
from marlstone.errors import EngineError, FormatError, LineFault, SyntaxFault
from marlstone.functions.compare import column, literal
from marlstone.operators import changes
from marlstone.operators import relational as R
from marlstone.plans import analysis, parser, select
from marlstone.plans import syntax as S
from marlstone.sources.catalog import BATCH, CATALOGS, PLACE, Database, Relation
from marlstone.sources.load import TOO_MANY, read_lines


@dataclass
class Result:
    """What a statement gave: rows, a message, a plan, or an error."""

    statement: S.Statement | None
    rows: DataFrame | None = None
    lengths: list[int] | None = None
    message: str = ""
    plan: str = ""
    error: Exception | None = None

    @property
    def code(self) -> int:
        return self.error.code if isinstance(self.error, EngineError) else 0

    def text(self) -> Iterator[str]:
        if self.plan:
            yield self.plan
        if self.message:
            yield self.message
        if self.error:
            yield str(self.error)
        if self.rows is not None:
            yield from printer.lines(self.rows, self.lengths)


class Session:
    """Over a database folder, or over registered tables alone."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.db = spark, Database(spark, root)
        self.settings: dict[str, str] = {}
        self.show_plans, self.ended, self.code = False, False, 0

    def register(self, name: str, table: DataFrame, order: tuple[str, ...] = ()) -> Session:
        self.db.register(name, table, order)
        return self

    def query(self, text: str) -> DataFrame:
        """The rows of one statement; faults and errors are raised."""
        made = next(parser.parse(text if text.rstrip().endswith(";") else text + ";"))
        if isinstance(made, Exception):
            raise made
        return self.run(made).rows

    def execute(self, text: str) -> Iterator[Result]:
        """A result for each statement. An error ends the session, a warning or a fault of form does not."""
        for made in parser.parse(text):
            if self.ended:
                return
            if isinstance(made, SyntaxFault):
                yield Result(None, error=made)
                continue
            try:
                result = self.run(made)
                self.code = 0
            except FormatError as e:
                result = Result(made, error=e)
                self.code = 0
            except EngineError as e:
                result = Result(made, error=e)
                self.code, self.ended = e.code, not e.is_warning
            except (PySparkException, Py4JError, OSError) as e:
                # What files, tables or another writer refused: the session ends with the code of the file system.
                lines = str(e).strip().splitlines() or [type(e).__name__]
                result = Result(made, error=EngineError("PF_UNIX", lines[0]))
                self.code, self.ended = result.code, True
            yield result

    def run(self, s: S.Statement) -> Result:
        parser.limits(s)
        return getattr(self, f"_{type(s).__name__.lower()}")(s)

    # -- queries

    def _select(self, s: S.Select) -> Result:
        q = analysis.check_select(self.db, s)
        rows = select.build(self.db, q, self.settings)
        return self._shown(s, rows, [a.length if not f else 0 for f, a in q.wanted])

    def _shown(self, s: S.Statement, rows: DataFrame, lengths: list[int]) -> Result:
        return Result(s, rows, lengths, plan=select.plan_text(rows) if self.show_plans else "")

    # -- definitions

    def _createtable(self, s: S.CreateTable) -> Result:
        self.db.create_table(s.relation, s.attributes)
        return Result(s)

    def _droptable(self, s: S.DropTable) -> Result:
        self.db.drop_table(s.relation)
        return Result(s)

    def _createindex(self, s: S.CreateIndex) -> Result:
        self.db.create_index(s.relation, s.attribute)
        return Result(s)

    def _dropindex(self, s: S.DropIndex) -> Result:
        self.db.drop_index(s.relation, s.attribute)
        return Result(s)

    # -- changes

    def _own(self, name: str) -> Relation:
        """A relation that can be changed."""
        if name in CATALOGS:
            raise EngineError("SM_BADTABLE", name)
        r = self.db.relation(name)
        if r.table is not None:
            raise EngineError("SM_BADTABLE", f"{name} is a registered table")
        self.db.changeable()
        return r

    def _load(self, s: S.Load) -> Result:
        r = self._own(s.relation)
        path = s.path if "://" in s.path or s.path.startswith("/") else f"{self.db.root}/{s.path}"
        cut = Observation()
        try:
            after = self.db.append(r, read_lines(self.spark, path, r.attributes, cut))
        except (PySparkException, Py4JError) as e:
            if TOO_MANY not in str(e):
                raise
            raise LineFault(f"{path}: {TOO_MANY}") from None
        loaded, shorter = after.records - r.records, (cut.get["n"] or 0) if after.records > r.records else 0
        warning = f" {shorter} string(s) were longer than declared and have been cut." if shorter else ""
        return Result(s, message=f"{loaded} tuple(s) loaded.{warning}")

    def _insert(self, s: S.Insert) -> Result:
        r = self._own(s.relation)
        analysis.check_values(r.attributes, s.values)
        row = self.spark.range(1).select(*(literal(v.value, a).alias(a.name) for a, v in zip(r.attributes, s.values)))
        self.db.append(r, row)
        return self._shown(s, row, [a.length for a in r.attributes])

    def _delete(self, s: S.Delete) -> Result:
        r = self._own(s.relation)
        tests = analysis.check_conditions(self.db, r.name, s.conditions)
        kept, gone = changes.deleted(self._plan_rows(r), tests)
        shown = self._attributes(r, gone)
        result = self._shown(s, shown, [a.length for a in r.attributes])
        self.db.replace_rows(r, self._file_rows(r, kept))
        return result

    def _update(self, s: S.Update) -> Result:
        r = self._own(s.relation)
        target, value, tests = analysis.check_update(self.db, s)
        new = column(value) if not isinstance(value, S.Literal) else literal(value.value, target)
        after, changed = changes.updated(self._plan_rows(r), target, new, tests)
        shown = self._attributes(r, changed)
        result = self._shown(s, shown, [a.length for a in r.attributes])
        self.db.replace_rows(r, self._file_rows(r, after))
        return result

    def _plan_rows(self, r: Relation) -> DataFrame:
        return R.scan(self.db.rows(r), r.attributes, (BATCH, PLACE))

    def _file_rows(self, r: Relation, rows: DataFrame) -> DataFrame:
        order = F.col(f"`{R.place(r.name)}`")
        return rows.select(*(column(a).alias(a.name) for a in r.attributes), order[BATCH].alias(BATCH), order[PLACE].alias(PLACE))

    def _attributes(self, r: Relation, rows: DataFrame) -> DataFrame:
        return R.project(rows, [("", a) for a in r.attributes])

    # -- utilities

    def _setting(self, s: S.Setting) -> Result:
        self.settings[s.name] = s.value
        return Result(s, message=f"Set\n   paramName={s.name}\n   value    ={s.value}")

    def _utility(self, s: S.Utility) -> Result:
        if s.action == "print":
            r = self.db.relation(s.what)
            rows = select.leaf(self.db, s.what).orderBy(F.col(f"`{R.place(s.what)}`"))
            return Result(s, self._attributes(r, rows), [a.length for a in r.attributes])
        if s.action == "help" and s.what:
            self.db.relation(s.what)
            rows = self.db.catalog_rows("attrcat").filter(F.col("relName") == s.what).orderBy(PLACE).drop("relName", BATCH, PLACE)
            return Result(s, rows, [25, 0, 0, 0, 0, 0])
        if s.action == "help":
            return Result(s, self.db.catalog_rows("relcat").orderBy(PLACE).select("relName"), [25])
        if s.action == "queryplans":
            self.show_plans = s.what == "on"
            return Result(s, message=f"Query plan display turned {s.what}.")
        if s.action == "exit":
            self.ended = True
        if s.action == "reset buffer":
            self.spark.catalog.clearCache()
            return Result(s, message="Everything kicked out of Buffer!")
        if s.action in ("reset io", "print io", "print buffer", "resize buffer"):
            return Result(s, message="Spark keeps its own buffers and counters.")
        return Result(s)
