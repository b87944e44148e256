"""Relations, their attributes and snapshots.

A relation's rows are a list of Parquet folders, none of which is ever changed. Loading and inserting add a folder;
deleting and updating write the relation anew. A statement takes effect when a catalog file with the next number has
been renamed into place; until then, and for plans made before, the old folders stand. vacuum() deletes folders that no
relation has any more.

Rows of an indexed relation are sorted by its first indexed attribute in every folder, those of later statements too, so
readers always skip row groups. A relation of more than MANY_PARTS folders is written anew as one, so single inserts
don't pile up.

Rows carry the order in which they came in hidden columns, the number of the folder and the place in it.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.errors import EngineError, FormatError
from marlstone.sources.storage import Storage
from marlstone.types import FLOAT, INT, MAX_NAME, PAGE_BYTES, STRING, Attribute, attributes_of, parse_type

BATCH, PLACE = "__batch", "__place"
CATALOGS = ("relcat", "attrcat")
MANY_PARTS = 16
TYPE_NUMBERS = {INT: 0, FLOAT: 1, STRING: 2}


@dataclass(frozen=True)
class Relation:
    name: str
    attributes: tuple[Attribute, ...]
    parts: tuple[str, ...] = ()
    records: int | None = 0
    batches: int = 0
    #: A registered DataFrame instead of parts, and the columns that say its order.
    table: DataFrame | None = field(default=None, compare=False)
    order: tuple[str, ...] = ()

    def attribute(self, name: str) -> Attribute | None:
        return next((a for a in self.attributes if a.name == name), None)

    @property
    def row_bytes(self) -> int:
        return sum(a.length for a in self.attributes)

    def schema(self) -> T.StructType:
        fields = [T.StructField(a.name, a.spark_type()) for a in self.attributes]
        return T.StructType([*fields, T.StructField(BATCH, T.IntegerType()), T.StructField(PLACE, T.LongType())])


class Database:
    """A folder with numbered catalog files and a folder for each relation; without a root, for registered tables only."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.root = spark, root.rstrip("/") if root else None
        self.storage = Storage(spark, self.root) if self.root else None
        self.version, self.relations = 0, {}
        if self.storage:
            if not self.storage.exists():
                raise EngineError("SM_NOSUCHDB", self.root)
            self._read()

    @classmethod
    def create(cls, spark: SparkSession, root: str) -> Database:
        storage = Storage(spark, root)
        if storage.exists():
            raise EngineError("PF_UNIX", f"{root} exists")
        storage.make()
        storage.write(_file(0), json.dumps([]))
        return cls(spark, root)

    def drop(self) -> None:
        self.storage.delete()

    # -- the catalog file

    def _read(self) -> None:
        found = sorted(n for n in self.storage.names() if n.startswith("catalog-") and n.endswith(".json"))
        if not found:
            raise EngineError("SM_NOSUCHDB", self.root)
        self.version = int(found[-1][8:-5])
        for r in json.loads(self.storage.read(found[-1])):
            attributes = tuple(Attribute(**a) for a in r["attributes"])
            self.relations[r["name"]] = Relation(r["name"], attributes, tuple(r["parts"]), r["records"], r["batches"])

    def commit(self, relation: Relation | None, name: str | None = None) -> None:
        """Puts the relation into the catalog, or takes the named one out."""
        after = {k: v for k, v in self.relations.items() if k != (name or relation.name)}
        if relation:
            after[relation.name] = relation
        if self.storage:
            listed = [{"name": r.name, "attributes": [asdict(a) for a in r.attributes], "parts": r.parts, "records": r.records, "batches": r.batches} for r in after.values() if r.table is None]
            self.storage.write(_file(self.version + 1), json.dumps(listed))
            self.version += 1
        self.relations = after

    def vacuum(self) -> None:
        """Deletes old catalog files and the folders that only they name."""
        kept = {p for r in self.relations.values() for p in r.parts}
        for n in self.storage.names():
            if n.startswith("catalog-") and n != _file(self.version):
                self.storage.delete(n)
            elif n.startswith("data-") and n not in kept:
                self.storage.delete(n)

    # -- relations

    def register(self, name: str, table: DataFrame, order: tuple[str, ...] = ()) -> None:
        """A DataFrame as a relation that can be queried. order: the columns that say which row is the last of a group."""
        attributes = tuple(attributes_of(name, table.schema))
        self.relations[name] = Relation(name, attributes, records=None, table=table, order=tuple(order) or tuple(a.name for a in attributes))

    def relation(self, name: str) -> Relation:
        if name in CATALOGS:
            return self._catalog_relation(name)
        if name not in self.relations:
            raise EngineError("SM_NOSUCHTABLE", name)
        return self.relations[name]

    def attribute(self, relation: str, name: str) -> Attribute | None:
        known = relation in CATALOGS or relation in self.relations
        return self.relation(relation).attribute(name) if known else None

    def create_table(self, name: str, columns: tuple[tuple[str, str], ...]) -> None:
        if len(name) > MAX_NAME or any(len(c) > MAX_NAME for c, _ in columns):
            raise FormatError("relation name or attribute name too long")
        types = [parse_type(t) for _, t in columns]
        self.changeable()
        if name in CATALOGS:
            raise EngineError("SM_BADTABLE", name)
        if name in self.relations:
            raise EngineError("PF_UNIX", f"{name} exists")
        if len({c for c, _ in columns}) < len(columns):
            raise EngineError("SM_BADATTR", "an attribute is there twice")
        attributes, offset = [], 0
        for (c, _), (kind, length) in zip(columns, types):
            attributes.append(Attribute(name, c, kind, length, offset))
            offset += length
        if offset >= PAGE_BYTES - 12:
            raise EngineError("SM_INVALIDSIZE", "a row must fit in a page")
        self.commit(Relation(name, tuple(attributes)))

    def drop_table(self, name: str) -> None:
        self.changeable()
        if name in CATALOGS:
            raise EngineError("SM_BADTABLE", name)
        self.commit(None, self.relation(name).name)

    def create_index(self, relation: str, attribute: str) -> None:
        """Notes the index and sorts the rows' folders by the attribute, so that readers skip what a comparison excludes."""
        self.changeable()
        r, a = self._indexable(relation, attribute)
        if a.indexed:
            raise EngineError("SM_INDEXEXISTS", f"{relation}.{attribute}")
        r = replace(r, attributes=tuple(x.with_index(True) if x == a else x for x in r.attributes))
        if r.parts:
            r = replace(r, parts=(self._folder(r, self._spread(self.rows(r), attribute)),))
        self.commit(r)

    def drop_index(self, relation: str, attribute: str) -> None:
        self.changeable()
        r, a = self._indexable(relation, attribute)
        if not a.indexed:
            raise EngineError("IX_NOSUCHINDEX", f"{relation}.{attribute}")
        self.commit(replace(r, attributes=tuple(x.with_index(False) if x == a else x for x in r.attributes)))

    def _indexable(self, relation: str, attribute: str) -> tuple[Relation, Attribute]:
        r = self.relation(relation)
        a = r.attribute(attribute)
        if a is None:
            raise EngineError("SM_BADATTR", f"{relation}.{attribute}")
        if r.table is not None:
            raise EngineError("SM_BADTABLE", f"{relation} is a registered table")
        return r, a

    def changeable(self) -> None:
        if not self.storage:
            raise EngineError("SM_NOTOPEN", "the database has no folder")

    # -- rows

    def rows(self, r: Relation) -> DataFrame:
        """The relation's attributes and the hidden columns of the order."""
        if not r.parts:
            return self.spark.createDataFrame([], r.schema())
        return self.spark.read.schema(r.schema()).parquet(*(f"{self.root}/{p}" for p in r.parts))

    def append(self, r: Relation, rows: DataFrame) -> Relation:
        """Adds a folder with rows (attributes only)."""
        placed = rows.select(*(a.name for a in r.attributes), F.lit(r.batches).alias(BATCH), F.monotonically_increasing_id().alias(PLACE))
        return self._written(r, placed, r.parts)

    def replace_rows(self, r: Relation, rows: DataFrame) -> Relation:
        """Writes the relation anew; rows keep their places in the order."""
        return self._written(r, rows, ())

    def _written(self, r: Relation, rows: DataFrame, before: tuple[str, ...]) -> Relation:
        indexed = next((a.name for a in r.attributes if a.indexed), None)
        path = self._folder(r, rows.sortWithinPartitions(indexed) if indexed and before else self._spread(rows, indexed))
        # Counted from the files' footers.
        count = self.spark.read.schema(r.schema()).parquet(f"{self.root}/{path}").count()
        after = replace(r, parts=(*before, path), records=count + (r.records if before else 0), batches=r.batches + 1)
        if len(after.parts) > MANY_PARTS:
            after = replace(after, parts=(self._folder(after, self._spread(self.rows(after), indexed)),))
        self.commit(after)
        return after

    def _spread(self, rows: DataFrame, by: str | None) -> DataFrame:
        """Rows in ranges of an indexed attribute, sorted by it."""
        return rows.repartitionByRange(by).sortWithinPartitions(by) if by else rows

    def _folder(self, r: Relation, rows: DataFrame) -> str:
        path = f"data-{r.name}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/{path}")
        return path

    # -- the catalog as relations

    def _catalog_relation(self, name: str) -> Relation:
        shapes = {
            "relcat": (("relName", STRING, 25), ("recordSize", INT, 4), ("attrCount", INT, 4), ("numPages", INT, 4), ("numRecords", INT, 4)),
            "attrcat": (("relName", STRING, 25), ("attrName", STRING, 25), ("offset", INT, 4), ("attrType", INT, 4), ("attrLength", INT, 4), ("indexNo", INT, 4), ("func", INT, 4)),
        }
        attributes, offset = [], 0
        for a, kind, length in shapes[name]:
            attributes.append(Attribute(name, a, kind, length, offset))
            offset += length
        return Relation(name, tuple(attributes), records=0)

    def catalog_rows(self, name: str) -> DataFrame:
        """The catalog describes itself like any other relation."""
        every = [*(self._catalog_relation(c) for c in CATALOGS), *self.relations.values()]
        counts = {"relcat": len(every), "attrcat": sum(len(r.attributes) for r in every)}
        if name == "relcat":
            listed = []
            for r in every:
                n = counts.get(r.name, r.records if r.table is None else r.table.count())
                listed.append((r.name, r.row_bytes, len(r.attributes), 1 + -(-n * r.row_bytes // PAGE_BYTES), n))
        else:
            listed = [(r.name, a.name, a.offset, TYPE_NUMBERS.get(a.kind, 2), a.length, a.offset if a.indexed else -1, 0) for r in every for a in r.attributes]
        schema = self._catalog_relation(name).schema()
        return self.spark.createDataFrame([(*row, 0, i) for i, row in enumerate(listed)], schema)


def _file(version: int) -> str:
    return f"catalog-{version:09d}.json"
