"""Registered queries: statements of the language over the relational tables, and SQL that says the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.plans.parser import parse
from marlstone.session import Session
from marlstone.sources.catalog import Database

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
#: The columns by which the last row of a group is told.
ORDER = {
    "region": ("r_regionkey",), "nation": ("n_nationkey",), "customer": ("c_custkey",), "supplier": ("s_suppkey",), "part": ("p_partkey",),
    "orders": ("o_orderkey",), "lineitem": ("l_orderkey", "l_linenumber"), "events": ("event_id",),
}

#: name: (statement, names of the result's columns or None for its own headings, SQL)
SELECTS: dict[str, tuple[str, list[str] | None, str]] = {
    "scan_project": ("select n_name from nation", None, "SELECT n_name FROM nation"),
    "filter_eq": ("select n_nationkey, n_name from nation where n_nationkey = 10", None, "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey = 10"),
    "filter_ne": ("select n_nationkey, n_name from nation where n_nationkey != 10", None, "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey <> 10"),
    "filter_lt": ("select c_custkey, c_acctbal from customer where c_nationkey < 10", None, "SELECT c_custkey, c_acctbal FROM customer WHERE c_nationkey < 10"),
    "filter_le": ("select c_custkey, c_acctbal from customer where c_nationkey <= 10", None, "SELECT c_custkey, c_acctbal FROM customer WHERE c_nationkey <= 10"),
    "filter_gt": ("select o_orderkey, o_totalprice from orders where o_totalprice > 300000.0", None, "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 300000.0"),
    "filter_ge": ("select l_orderkey, l_quantity from lineitem where l_quantity >= 49.0", None, "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity >= 49.0"),
    "filter_string_eq": ('select o_orderkey, o_custkey from orders where o_orderpriority = "5-LOW"', None, "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderpriority = '5-LOW'"),
    "filter_string_range": ('select c_custkey, c_name from customer where c_name > "Customer#000000100"', None, "SELECT c_custkey, c_name FROM customer WHERE c_name > 'Customer#000000100'"),
    "filter_attr_attr": ("select l_orderkey, l_linenumber from lineitem where l_discount = l_tax", None, "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount = l_tax"),
    "filter_conj": (
        'select l_orderkey, l_extendedprice from lineitem where l_quantity < 24.0 and l_discount >= 0.05 and l_returnflag <> "A"', None,
        "SELECT l_orderkey, l_extendedprice FROM lineitem WHERE l_quantity < 24 AND l_discount >= 0.05 AND l_returnflag <> 'A'",
    ),
    "filter_time": ('select o_orderkey from orders where o_orderdate >= "1996-01-01"', None, "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01'"),
    "point_lookup": ("select o_orderkey, o_totalprice from orders where o_orderkey = 100", None, "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 100"),
    "star_expand": (
        "select * from region, nation where r_regionkey = n_regionkey", None,
        "SELECT n_nationkey, n_name, n_regionkey, r_regionkey, r_name FROM region JOIN nation ON r_regionkey = n_regionkey",
    ),
    "join_equi": (
        "select c_name, o_orderkey, o_totalprice from orders, customer where c_custkey = o_custkey", None,
        "SELECT c_name, o_orderkey, o_totalprice FROM orders JOIN customer ON c_custkey = o_custkey",
    ),
    "join_equi_residual": (
        "select c_custkey, s_suppkey from customer, supplier where c_nationkey = s_nationkey and c_acctbal < s_acctbal", None,
        "SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey AND c_acctbal < s_acctbal",
    ),
    "join_theta": (
        "select n_name, r_name from nation, region where n_regionkey > r_regionkey", None,
        "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey > r_regionkey",
    ),
    "join_theta_reversed": (
        "select n_name, r_name from nation, region where r_regionkey < n_regionkey", None,
        "SELECT n_name, r_name FROM nation JOIN region ON r_regionkey < n_regionkey",
    ),
    "cross_join": ("select n_name, r_name from nation, region", None, "SELECT n_name, r_name FROM nation CROSS JOIN region"),
    "join_3way": (
        "select c_name, n_name, r_name from customer, nation, region where c_nationkey = n_nationkey and n_regionkey = r_regionkey", None,
        "SELECT c_name, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    ),
    "join_filter_pushdown": (
        'select o_orderkey, l_extendedprice from orders, lineitem where o_orderpriority = "1-URGENT" and o_totalprice > 200000.0 and o_orderkey = l_orderkey', None,
        "SELECT o_orderkey, l_extendedprice FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 200000",
    ),
    "join_same_relation": (
        "select l_orderkey, o_custkey from lineitem, orders where l_orderkey = o_orderkey and l_discount = l_tax", None,
        "SELECT l_orderkey, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_discount = l_tax",
    ),
    "order_asc": ("select c_custkey, c_name from customer order by c_acctbal", None, "SELECT c_custkey, c_name FROM customer"),
    "order_desc": ("select c_custkey, c_name from customer order by c_custkey desc", None, "SELECT c_custkey, c_name FROM customer"),
    "order_hidden_key": ("select n_name from nation order by n_nationkey desc", None, "SELECT n_name FROM nation"),
    "group_count": ("select o_orderpriority, COUNT(o_orderkey) from orders group by o_orderpriority", ["o_orderpriority", "n"], "SELECT o_orderpriority, count(o_orderkey) AS n FROM orders GROUP BY 1"),
    "group_count_star": ("select l_returnflag, COUNT(*) from lineitem group by l_returnflag", ["l_returnflag", "n"], "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1"),
    "group_min_max": (
        "select l_suppkey, MIN(l_extendedprice), MAX(l_extendedprice) from lineitem group by l_suppkey", ["l_suppkey", "least", "most"],
        "SELECT l_suppkey, min(l_extendedprice) AS least, max(l_extendedprice) AS most FROM lineitem GROUP BY 1",
    ),
    "group_only": ("select c_mktsegment from customer group by c_mktsegment", None, "SELECT DISTINCT c_mktsegment FROM customer"),
    "group_empty": (
        "select n_regionkey, MIN(n_nationkey), COUNT(*) from nation where n_nationkey > 1000 group by n_regionkey", ["n_regionkey", "least", "n"],
        "SELECT n_regionkey, min(n_nationkey) AS least, count(*) AS n FROM nation WHERE n_nationkey > 1000 GROUP BY 1",
    ),
    "group_order": (
        "select n_regionkey, COUNT(*) from nation group by n_regionkey order by n_regionkey desc", ["n_regionkey", "n"],
        "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1",
    ),
    "group_bare_col": (
        "select n_regionkey, MIN(n_nationkey), COUNT(n_regionkey), n_name from nation group by n_regionkey", ["n_regionkey", "least", "n", "last_name"],
        "SELECT n_regionkey, min(n_nationkey) AS least, count(*) AS n, max_by(n_name, n_nationkey) AS last_name FROM nation GROUP BY 1",
    ),
    "join_group": (
        "select c_mktsegment, COUNT(*), MAX(o_totalprice) from customer, orders where c_custkey = o_custkey group by c_mktsegment", ["c_mktsegment", "n", "most"],
        "SELECT c_mktsegment, count(*) AS n, max(o_totalprice) AS most FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1",
    ),
}


def open_tables(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = TABLES) -> Session:
    session = Session(spark)
    for t in names:
        session.register(t, spark.read.parquet(f"{sf_dir}/{t}.parquet"), ORDER[t])
    return session


def _select(text: str, names: list[str] | None, spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statement over the tables that it names; others are not opened."""
    statement = next(parse(f"{text};"))
    rows = open_tables(spark, sf_dir, statement.relations).run(statement).rows
    return rows.toDF(*names) if names else rows


# -- statements that change relations, on a database of their own in the shared folder


def _database(spark: SparkSession) -> Session:
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    root = f"{shared.rstrip('/')}/marlstone-{uuid.uuid4().hex}"
    Database.create(spark, root)
    return Session(spark, root)


def _nations(spark: SparkSession, sf_dir: str) -> Session:
    """A relation loaded from comma-separated text that is written from the nation table."""
    session = _database(spark)
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    nation.select(F.concat_ws(",", "n_nationkey", "n_name", "n_regionkey").alias("value")).write.text(f"{session.db.root}/nation.txt")
    for _ in session.execute('create table NATION (N_NATIONKEY i4, N_NAME c25, N_REGIONKEY i4); load NATION ("nation.txt");'):
        pass
    return session


NATION_COLUMNS = ["n_nationkey", "n_name", "n_regionkey"]


def _changed(statements: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of the loaded relation after the statements."""
    session = _nations(spark, sf_dir)
    for result in session.execute(statements):
        if result.error:
            raise result.error
    return session.query("select * from NATION").toDF(*NATION_COLUMNS)


CHANGES: dict[str, tuple[str, str]] = {
    "load_csv": ("", "SELECT n_nationkey, n_name, n_regionkey FROM nation"),
    "insert_rows": (
        'insert into NATION values (61, "FRANCE", 3); insert into NATION values (62, "FRANCE", 3);',
        "SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL VALUES (61, 'FRANCE', 3), (62, 'FRANCE', 3)",
    ),
    "delete_where": ("delete from NATION where N_REGIONKEY = 1 and N_NATIONKEY > 2;", "SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE NOT (n_regionkey = 1 AND n_nationkey > 2)"),
    "update_value": (
        'update NATION set N_NAME = "NOWHERE" where N_REGIONKEY >= 3;',
        "SELECT n_nationkey, CASE WHEN n_regionkey >= 3 THEN 'NOWHERE' ELSE n_name END AS n_name, n_regionkey FROM nation",
    ),
    "update_attr": (
        "update NATION set N_REGIONKEY = N_NATIONKEY where N_NATIONKEY < 10;",
        "SELECT n_nationkey, n_name, CASE WHEN n_nationkey < 10 THEN n_nationkey ELSE n_regionkey END AS n_regionkey FROM nation",
    ),
}


#: Statements on a relation as large as a table of the benchmark: name: (statements, SQL).
ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice"]
_ORDERS = "SELECT CAST(o_orderkey AS INTEGER) AS o_orderkey, CAST(o_custkey AS INTEGER) AS o_custkey, o_orderpriority, CAST(round(o_totalprice) AS INTEGER) AS o_totalprice FROM orders"
ORDERS: dict[str, tuple[str, str]] = {
    "load_orders": ("", _ORDERS),
    "delete_orders": ('delete from ORDERS where O_PRIORITY = "5-LOW" and O_PRICE < 150000;', f"SELECT * FROM ({_ORDERS}) WHERE NOT (o_orderpriority = '5-LOW' AND o_totalprice < 150000)"),
    "update_orders": (
        'update ORDERS set O_PRIORITY = "0-NOW" where O_PRICE >= 200000;',
        f"SELECT o_orderkey, o_custkey, CASE WHEN o_totalprice >= 200000 THEN '0-NOW' ELSE o_orderpriority END AS o_orderpriority, o_totalprice FROM ({_ORDERS})",
    ),
    "index_drop": ("create index ORDERS(O_CUSTKEY); drop index ORDERS(O_CUSTKEY);", _ORDERS),
}


def _order_rows(statements: str, spark: SparkSession, sf_dir: str) -> Session:
    """A session over a relation loaded from comma-separated text of all orders, after the statements."""
    session = _database(spark)
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("o_totalprice", F.expr("CAST(round(o_totalprice) AS BIGINT)"))
    orders.select(F.concat_ws(",", *ORDER_COLUMNS).alias("value")).write.text(f"{session.db.root}/orders.txt")
    text = 'create table ORDERS (O_ORDERKEY i4, O_CUSTKEY i4, O_PRIORITY c15, O_PRICE i4); load ORDERS ("orders.txt");'
    for result in session.execute(f"{text} {statements}"):
        if result.error:
            raise result.error
    return session


def _changed_orders(statements: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return _order_rows(statements, spark, sf_dir).query("select * from ORDERS").toDF(*ORDER_COLUMNS)


def _index_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An indexed scan of rows from before the index and from after it."""
    session = _order_rows('create index ORDERS(O_CUSTKEY); insert into ORDERS values (-1, 7, "9-NEW", 5); insert into ORDERS values (-2, 100000000, "9-NEW", 6);', spark, sf_dir)
    return session.query("select * from ORDERS where O_CUSTKEY <= 100").toDF(*ORDER_COLUMNS)


def _told(statement: str, names: list[str], spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that a statement shows, on a loaded relation with an index."""
    session = _nations(spark, sf_dir)
    for result in session.execute(f"create index NATION(N_REGIONKEY); {statement}"):
        if result.error:
            raise result.error
    return result.rows.toDF(*names)


def _placed(text: str, names: list[str], spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of an ordered statement with their places in its order, which is that of partitions and of rows in them."""
    rows = _select(text, names, spark, sf_dir).withColumn("at", F.monotonically_increasing_id())
    return rows.withColumn("place", F.row_number().over(Window.orderBy("at")).cast("long")).drop("at")


#: Ordered statements whose keys are unique, with the place of each row: name: (statement, columns, SQL).
PLACES: dict[str, tuple[str, list[str], str]] = {
    "order_asc_places": ("select c_name from customer order by c_custkey", ["c_name"], "SELECT c_name, row_number() OVER (ORDER BY c_custkey) AS place FROM customer"),
    "order_desc_places": (
        "select c_custkey, c_name from customer order by c_custkey desc", ["c_custkey", "c_name"],
        "SELECT c_custkey, c_name, row_number() OVER (ORDER BY c_custkey DESC) AS place FROM customer",
    ),
    "order_string_places": ("select n_nationkey from nation order by n_name", ["n_nationkey"], "SELECT n_nationkey, row_number() OVER (ORDER BY n_name) AS place FROM nation"),
    "order_hidden_key_places": ("select n_name from nation order by n_nationkey desc", ["n_name"], "SELECT n_name, row_number() OVER (ORDER BY n_nationkey DESC) AS place FROM nation"),
    "group_order_places": (
        "select l_suppkey, COUNT(*) from lineitem group by l_suppkey order by l_suppkey desc", ["l_suppkey", "n"],
        "SELECT l_suppkey, count(*) AS n, row_number() OVER (ORDER BY l_suppkey DESC) AS place FROM lineitem GROUP BY 1",
    ),
}

#: Statements that show rows: name: (statement, columns, SQL).
TOLD: dict[str, tuple[str, list[str], str]] = {
    "print_rows": ("print NATION;", NATION_COLUMNS, "SELECT n_nationkey, n_name, n_regionkey FROM nation"),
    "help_relations": ("help;", ["relation"], "SELECT * FROM (VALUES ('relcat'), ('attrcat'), ('NATION')) AS t(relation)"),
    "help_relation": (
        "help NATION;", ["attribute", "byte_offset", "kind", "byte_length", "index_number", "func"],
        "SELECT * FROM (VALUES ('N_NATIONKEY', 0, 0, 4, -1, 0), ('N_NAME', 4, 2, 25, -1, 0), ('N_REGIONKEY', 29, 0, 4, 29, 0)) AS t(attribute, byte_offset, kind, byte_length, index_number, func)",
    ),
}


def _indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A join of two relations on indexed attributes, merged."""
    session = _nations(spark, sf_dir)
    spark.read.parquet(f"{sf_dir}/region.parquet").select(F.concat_ws(",", "r_regionkey", "r_name").alias("value")).write.text(f"{session.db.root}/region.txt")
    for r in session.execute('create table REGION (R_REGIONKEY i4, R_NAME c25); load REGION ("region.txt"); create index REGION(R_REGIONKEY); create index NATION(N_REGIONKEY);'):
        if r.error:
            raise r.error
    return session.query("select N_NAME, R_NAME from NATION, REGION where N_REGIONKEY = R_REGIONKEY").toDF("n_name", "r_name")


def _catalog(which: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nations(spark, sf_dir).query(f"select * from {which}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict[str, Callable] = {k: partial(_select, text, names) for k, (text, names, _) in SELECTS.items()}
    found |= {k: partial(_changed, statements) for k, (statements, _) in CHANGES.items()}
    found |= {k: partial(_changed_orders, statements) for k, (statements, _) in ORDERS.items()}
    found |= {k: partial(_placed, text, names) for k, (text, names, _) in PLACES.items()}
    found |= {k: partial(_told, statement, names) for k, (statement, names, _) in TOLD.items()}
    found |= {"index_scan": _index_scan, "index_merge_join": _indexed, "catalog_relcat": partial(_catalog, "relcat"), "catalog_attrcat": partial(_catalog, "attrcat")}
    return found


def oracle_sql() -> dict[str, str]:
    found = {k: sql for k, (_, _, sql) in SELECTS.items()} | {k: sql for k, (_, sql) in CHANGES.items()}
    found |= {k: sql for k, (_, sql) in ORDERS.items()} | {k: sql for k, (_, _, sql) in (*PLACES.items(), *TOLD.items())}
    found["index_scan"] = f"SELECT * FROM ({_ORDERS}) WHERE o_custkey <= 100 UNION ALL SELECT -1, 7, '9-NEW', 5"
    found["catalog_relcat"] = """
SELECT 'relcat' AS relName, 41 AS recordSize, 5 AS attrCount, 2 AS numPages, 3 AS numRecords UNION ALL
SELECT 'attrcat', 70, 7, 2, 15 UNION ALL
SELECT 'NATION', 33, 3, 1 + CAST(ceil(count(*) * 33 / 4092) AS INTEGER), CAST(count(*) AS INTEGER) FROM nation
"""
    found["catalog_attrcat"] = """
SELECT * FROM (VALUES
  ('relcat', 'relName', 0, 2, 25, -1, 0), ('relcat', 'recordSize', 25, 0, 4, -1, 0), ('relcat', 'attrCount', 29, 0, 4, -1, 0),
  ('relcat', 'numPages', 33, 0, 4, -1, 0), ('relcat', 'numRecords', 37, 0, 4, -1, 0),
  ('attrcat', 'relName', 0, 2, 25, -1, 0), ('attrcat', 'attrName', 25, 2, 25, -1, 0), ('attrcat', 'offset', 50, 0, 4, -1, 0), ('attrcat', 'attrType', 54, 0, 4, -1, 0),
  ('attrcat', 'attrLength', 58, 0, 4, -1, 0), ('attrcat', 'indexNo', 62, 0, 4, -1, 0), ('attrcat', 'func', 66, 0, 4, -1, 0),
  ('NATION', 'N_NATIONKEY', 0, 0, 4, -1, 0), ('NATION', 'N_NAME', 4, 2, 25, -1, 0), ('NATION', 'N_REGIONKEY', 29, 0, 4, -1, 0)
) AS t("relName", "attrName", "offset", "attrType", "attrLength", "indexNo", "func")
"""
    found["index_merge_join"] = "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey"
    return found
