"""Whole sessions over small relations: golden counts, errors, changes, loading, differences from SQL."""

import datetime
import random
import subprocess
import sys
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from marlstone import printer
from marlstone.errors import EngineError, LineFault
from marlstone.operators import relational
from marlstone.session import Session
from marlstone.sources.catalog import Database

# Small relations with known results.
IN = ["1,2.1,a", "2,2.1,bb", "3,3.4,ggrgdg", "5,6,Max", "3333,3333,rrtrt"]
NETWORKS = ["1,NBC,70000", "2,ABC,80000", "3,CBS,60000", "4,HBO,30000"]
SOAPS = [
    "0,Days of Our Lives,NBC,7.02", "1,General Hospital,ABC,9.81", "2,Guiding Light,CBS,4.02", "3,One Life to Live,ABC,2.31", "4,Santa Barbara,NBC,6.44",
    "5,The Young and the Restless,CBS,5.50", "6,As the World Turns,CBS,7.00", "7,Another World,NBC,1.97", "8,All My Children,ABC,8.82",
]
STARS = [f"{i},star {i},part {i},{s}" for i, s in enumerate([6, 6, 4, 5, 5, 2, 4, 3, 5, 5, 3, 0, 8, 5, 7, 2, 2, 3, 3, 0, 4, 8, 7, 8, 8, 1, 1, 1, 0])]
SETUP = """
create table soaps(soapid i, sname c28, network c4, rating f);
create table stars(starid i, stname c20, plays c12, soapid i);
create table networks(nid i, name c4, viewers i);
create table in(in i, out f, bw c2);
load soaps("soaps.data"); load stars("stars.data"); load networks("networks.data"); load in("in.data");
"""


@pytest.fixture(scope="module")
def filled(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("db") / "soaps"
    Database.create(spark, str(root))
    for name, rows in (("soaps", SOAPS), ("stars", STARS), ("networks", NETWORKS), ("in", IN)):
        (root / f"{name}.data").write_text("\n".join(rows) + "\n")
    session = Session(spark, str(root))
    assert [r.error for r in session.execute(SETUP) if r.error] == []
    return session


@pytest.fixture
def own(spark, tmp_path):
    Database.create(spark, str(tmp_path / "own"))
    return Session(spark, str(tmp_path / "own"))


def run(session, text):
    results = list(session.execute(text))
    session.ended = False
    return results


def error_of(session, text):
    (result,) = run(session, text)
    return result.error.name if isinstance(result.error, EngineError) else result.error and type(result.error).__name__


@pytest.mark.parametrize("text, count", [
    ("select * from stars, soaps where stars.soapid = soaps.soapid", 29),
    ("select * from stars, soaps, networks where stars.soapid = soaps.soapid and soaps.network = networks.name", 29),
    ("select * from soaps, networks where soaps.network = networks.name", 9),
    ("select * from in, stars where in.in = stars.soapid", 15),
    ("select * from in, stars where in.in = stars.soapid and in.in > stars.starid", 2),
    ("select * from in, stars where in.bw = stars.stname", 0),
    ("select * from in, stars", 145),
    ('select * from in where bw > "c"', 2),
    ("select * from in where out = 2.1", 2),
    ("select * from soaps where rating = 4.02", 1),
    ("select * from stars where starid < soapid", 5),
    ("select * from stars, networks where starid < soapid and nid > 2", 10),
    ('select * from in where bw = "gglonger"', 1),
])
def test_golden_counts(filled, text, count):
    assert filled.query(text).count() == count


def test_condition_within_a_relation_next_to_a_join(filled):
    got = filled.query("select starid from stars, soaps where stars.soapid = soaps.soapid and starid < stars.soapid").collect()
    assert sorted(r[0] for r in got) == [i for i, x in enumerate(STARS) if i < int(x.split(",")[3])]


def test_strings_are_cut_and_compared_by_the_left_length(filled):
    assert sorted(r["bw"] for r in filled.query("select bw from in").collect()) == ["Ma", "a", "bb", "gg", "rr"]
    # c4 = c28: four bytes of the right side take part; the other way round all of them.
    assert filled.query("select soapid from soaps, networks where name = sname").count() == 0
    run(filled, 'create table long(t c8);')
    run(filled, 'insert into long values ("NBC_rest"); insert into long values ("NBC");')
    assert filled.query("select name, t from networks, long where name = t").count() == 1
    run(filled, 'insert into long values ("ABCDEFGH");')
    run(filled, 'create table four(s c4); ')
    run(filled, 'insert into four values ("ABCDEF");')
    assert filled.query("select s, t from four, long where s = t").count() == 1
    assert filled.query("select s, t from four, long where t = s").count() == 0
    run(filled, "drop table long; drop table four;")


def test_star_is_by_relation_name(filled):
    assert filled.query("select * from stars, soaps where stars.soapid = soaps.soapid").columns == ["soaps.soapid", "sname", "network", "rating", "starid", "stname", "plays", "stars.soapid"]


def test_order(filled):
    assert [r[0] for r in filled.query("select sname from soaps order by rating desc").collect()][:3] == ["General Hospital", "All My Children", "Days of Our Lives"]
    assert [r[0] for r in filled.query("select soapid from soaps order by sname").collect()] == [8, 7, 6, 0, 1, 2, 3, 4, 5]


def test_groups(filled):
    rows = filled.query("select network, COUNT(*), MIN(rating), MAX(soapid), sname from soaps group by network order by network").collect()
    assert [(r[0], r[1], round(r[2], 2), r[3], r[4]) for r in rows] == [("ABC", 3, 2.31, 8, "All My Children"), ("CBS", 3, 4.02, 6, "As the World Turns"), ("NBC", 3, 1.97, 7, "Another World")]
    # A group is ordered by the attribute's value in its last row, also where that attribute isn't selected.
    rows = filled.query("select network from soaps group by network order by rating desc").collect()
    assert [r[0] for r in rows] == ["ABC", "CBS", "NBC"]
    assert filled.query("select COUNT(sname), network from soaps where soapid > 99 group by network").collect() == []
    assert filled.query("select COUNT(sname) from soaps group by network").columns == ["COUNT(sname)"]


@pytest.mark.parametrize("text, name", [
    ("select a from nowhere;", "SM_NOSUCHTABLE"), ("select * from soaps, soaps;", "QL_DUPREL"), ("select soapid from soaps, stars;", "SM_AMBGATTR"), ("select nothing from soaps;", "SM_NOSUCHENTRY"),
    ("select soaps.nothing from soaps;", "SM_BADATTR"), ("select stars.starid from soaps;", "SM_BADATTR"), ("select sname from soaps where stars.starid = 1;", "QL_RELMISSINGFROMFROM"),
    ("select sname from soaps where soapid = rating;", "SM_TYPEMISMATCH"), ("select sname from soaps where rating = 4;", "SM_TYPEMISMATCH"), ('select sname from soaps where soapid = "4";', "SM_TYPEMISMATCH"),
    ("select AVG(rating) from soaps group by network;", "SM_BADAGGFUN"), ("select SUM(rating) from soaps group by network;", "SM_BADAGGFUN"), ("select COUNT(soapid) from soaps;", "SM_BADAGGFUN"),
    ("select MIN(*) from soaps group by network;", "SM_NOSUCHENTRY"), ("select sname from soaps order by nothing;", "SM_NOSUCHENTRY"), ("select sname from soaps group by stars.nothing;", "SM_BADATTR"),
    ("select sname from soaps, stars order by soapid;", "SM_AMBGATTR"), ("insert into soaps values (1, \"x\", \"y\");", "QL_INVALIDSIZE"), ('insert into soaps values (1, "x", "y", 4);', "QL_JOINKEYTYPEMISMATCH"),
    ("insert into nowhere values (1);", "SM_NOSUCHTABLE"), ("delete from soaps where stars.starid = 1;", "QL_BADATTR"), ("delete from soaps where nothing = 1;", "SM_BADATTR"), ("update soaps set nothing = 1;", "SM_BADATTR"),
    ("update soaps set rating = 1;", "SM_TYPEMISMATCH"), ("update soaps set rating = soapid;", "SM_TYPEMISMATCH"), ("update soaps set soapid = 1 where stars.starid = 1;", "QL_BADATTR"),
    ("create table relcat (a i);", "SM_BADTABLE"), ("create table twice (a i, a f);", "SM_BADATTR"), ("create table soaps (a i);", "PF_UNIX"), ("drop table nowhere;", "SM_NOSUCHTABLE"), ("drop table attrcat;", "SM_BADTABLE"),
    ("create index soaps(nothing);", "SM_BADATTR"), ("drop index soaps(nothing);", "SM_BADATTR"), ("drop index soaps(soapid);", "IX_NOSUCHINDEX"), ("print nowhere;", "SM_NOSUCHTABLE"), ("help nowhere;", "SM_NOSUCHTABLE"),
    ("load relcat(\"x\");", "SM_BADTABLE"), (f"create table {'x' * 25} (a i);", "FormatError"), ("create table wide (a c);", "FormatError"), ("select a from R order by a, b;", "SyntaxFault"),
])
def test_errors(filled, text, name):
    assert error_of(filled, text) == name


def test_errors_end_a_session_and_warnings_do_not(filled):
    assert [r.code for r in filled.execute("select nothing from soaps; select sname from soaps;")] == [304, 0]
    results = list(filled.execute("select x from nowhere; select sname from soaps;"))
    assert [r.code for r in results] == [-304] and filled.ended and filled.code == -304
    filled.ended = False


def test_failed_statements_leave_no_trace(own):
    run(own, "create table R (a i, a f);")
    assert own.db.relations == {}
    assert error_of(own, "create table R (a i, b f);") is None
    assert {r["relName"] for r in own.query("select relName from relcat").collect()} == {"relcat", "attrcat", "R"}


def test_changes(own, tmp_path):
    (tmp_path / "soaps.data").write_text("\n".join(SOAPS))
    run(own, f'create table soaps(soapid i, sname c28, network c4, rating f); load soaps("{tmp_path}/soaps.data"); insert into soaps values (133, "The Good Wife", "CBS", 4.0);')

    def shown(text):
        (r,) = run(own, text)
        assert r.error is None
        return r.rows.collect()

    assert [r["rating"] for r in shown("update soaps set rating = 5.5 where soapid = 133;")] == [5.5]
    assert [r["soapid"] for r in shown("update soaps set soapid = 132 where soapid = 133;")] == [132]
    assert [r["soapid"] for r in shown("update soaps set soapid = 133 where soapid = 132;")] == [133]
    assert [r["sname"] for r in shown("delete from soaps where soapid = 133;")] == ["The Good Wife"]
    assert len(shown('delete from soaps where network = "CBS" and rating > 1.0;')) == 3
    assert len(shown("delete from soaps where soapid > 3 and rating > 1.0;")) == 3
    assert own.query("select soapid from soaps").count() == 3
    assert len(shown("update soaps set rating = 1.5;")) == 3
    assert [r[0] for r in own.query("select numRecords from relcat where relName = \"soaps\"").collect()] == [3]
    assert len(shown("delete from soaps;")) == 3
    assert shown("print soaps;") == [] and shown("delete from soaps where soapid = 1;") == []


def test_update_by_attribute_and_on_itself(own):
    run(own, "create table R (a i, b i, s c3);")
    run(own, 'insert into R values (1, 10, "abc"); insert into R values (2, 20, "de");')
    run(own, "update R set a = b where a = 1;")
    assert sorted(tuple(r) for r in own.query("select a, b from R").collect()) == [(2, 20), (10, 10)]
    # The rows are chosen before any is changed.
    run(own, "update R set a = 2 where a >= 2;")
    assert [r[0] for r in own.query("select a from R").collect()] == [2, 2]
    run(own, 'update R set s = "longer than three";')
    assert {r[0] for r in own.query("select s from R").collect()} == {"lon"}


def test_results_of_before_stand_after_a_change(own):
    run(own, "create table R (a i);")
    run(own, "insert into R values (1); insert into R values (2);")
    before = own.query("select a from R")
    run(own, "delete from R where a = 1;")
    assert sorted(r[0] for r in before.collect()) == [1, 2]
    own.db.vacuum()
    assert [r[0] for r in own.query("select a from R").collect()] == [2]
    assert Session(own.spark, own.db.root).query("select a from R").count() == 1


def test_print_keeps_the_order_of_rows(own):
    run(own, "create table R (a i);")
    run(own, " ".join(f"insert into R values ({i});" for i in (5, 3, 9)))
    run(own, "update R set a = 4 where a = 3; create index R(a);")
    (r,) = run(own, "print R;")
    assert [x[0] for x in r.rows.collect()] == [5, 4, 9]


LINES = ["1,1.5,abc", "", "  7,2e1,", "x,y,toolong for it", "12abc,3.5xyz,q", ",,", "8", "-3,-0.5, lead", "99999999999,1,z", "+4,+.5,w"]
LOADED = [(1, 1.5, "abc"), (7, 20.0, ""), (0, 0.0, "toolo"), (12, 3.5, "q"), (0, 0.0, ""), (8, 0.0, ""), (-3, -0.5, " lead"), (2147483647, 1.0, "z"), (4, 0.5, "w")]


def test_load(own, tmp_path):
    (tmp_path / "own" / "r.data").write_text("\n".join(LINES))
    run(own, 'create table R (a i, b f, c c5); load R("r.data");')
    (r,) = run(own, "print R;")
    assert [tuple(x) for x in r.rows.collect()] == LOADED
    (tmp_path / "empty").write_text("")
    (r,) = run(own, f'load R("{tmp_path}/empty");')
    assert r.error is None and own.query("select a from R").count() == len(LOADED)


def test_load_with_too_many_fields_has_no_effect(own, tmp_path):
    (tmp_path / "bad").write_text("1,2\n1,2,3\n")
    run(own, "create table R (a i, b i);")
    with pytest.raises(Exception, match="too many fields"):
        run(own, f'load R("{tmp_path}/bad");')
    assert own.query("select a from R").collect() == []


def test_help_settings_and_plans(filled):
    (r,) = run(filled, "help;")
    assert [x[0] for x in r.rows.collect()][:2] == ["relcat", "attrcat"]
    (r,) = run(filled, "help in;")
    assert [x["attrName"] for x in r.rows.collect()] == ["in", "out", "bw"]
    (r,) = run(filled, 'set mergejoin = "no";')
    assert "mergejoin" in r.message
    on, shown, off = run(filled, "queryplans on; select sname from soaps where soapid > 3; queryplans off;")
    assert "PushedFilters: [IsNotNull(soapid), GreaterThan(soapid,3)]" in shown.plan and "ReadSchema: struct<soapid:int,sname:string>" in shown.plan


def test_index_shows_in_the_catalog_and_merges(own):
    run(own, "create table R (a i); create table S (b i);")
    run(own, "insert into R values (1); insert into S values (1); create index R(a); create index S(b);")
    assert error_of(own, "create index R(a);") == "SM_INDEXEXISTS"
    assert own.query('select indexNo from attrcat where relName = "R"').collect()[0][0] == 0
    assert own.query("select a from R, S where a = b")._jdf.queryExecution().optimizedPlan().toString().count("strategy=merge") == 1
    run(own, 'set mergejoin = "no";')
    assert "strategy=merge" not in own.query("select a from R, S where a = b")._jdf.queryExecution().optimizedPlan().toString()
    assert error_of(own, "drop index R(a);") is None and error_of(own, "drop index R(a);") == "IX_NOSUCHINDEX"


def test_printer(filled):
    got = list(printer.lines(filled.query("select network, rating from soaps where soapid < 2 order by soapid"), [4, 4]))
    assert got == ["network rating      ", "-" * 20, "NBC     7.020000    ", "ABC     9.810000    ", "", "2 tuple(s)."]


def test_command_line(spark, tmp_path):
    text = 'create table R (a i); insert into R values (7); select a from R; select b from R;'
    done = subprocess.run([sys.executable, "-m", "marlstone", "--create", str(tmp_path / "db")], input=text, capture_output=True, text=True, timeout=180)
    assert "7           " in done.stdout and "1 tuple(s)." in done.stdout and done.returncode == 304 & 255


def test_registered_tables_cannot_be_changed(spark):
    session = Session(spark).register("t", spark.range(3))
    for text in ("delete from t;", "insert into t values (1);", "create index t(id);"):
        assert error_of(session, text) in ("SM_BADTABLE", "SM_NOTOPEN")


def test_random_conjunctions_equal_sql(spark):
    """Random select-project-join statements over two to three relations, against SQL over the same rows."""
    rng = random.Random(11)
    con = duckdb.connect()
    session = Session(spark)
    columns = {"R": ["ra", "rb", "rs"], "S": ["sa", "sb", "ss"], "T": ["ta", "tb", "ts"]}
    for name, own in columns.items():
        rows = [(rng.randrange(6), rng.randrange(6), rng.choice("xyz")) for _ in range(12)]
        session.register(name, spark.createDataFrame(rows, f"{own[0]} int, {own[1]} long, {own[2]} string"))
        con.execute(f"CREATE TABLE {name} ({own[0]} INT, {own[1]} BIGINT, {own[2]} VARCHAR)")
        con.executemany(f"INSERT INTO {name} VALUES (?, ?, ?)", rows)
    for _ in range(30):
        relations = rng.sample(list(columns), rng.choice([1, 2, 2, 3]))
        numbers = [c for r in relations for c in columns[r][:2]]
        strings = [columns[r][2] for r in relations]
        tests = []
        for _ in range(rng.randrange(4)):
            op = rng.choice(["=", "<>", "<", ">", "<=", ">="])
            kind = rng.random()
            tests.append(f"{rng.choice(numbers)} {op} {rng.choice(numbers)}" if kind < 0.5 else f"{rng.choice(numbers)} {op} {rng.randrange(6)}" if kind < 0.8 else f"{rng.choice(strings)} {op} 'y'")
        chosen = rng.sample(numbers + strings, rng.randrange(1, 4))
        sql = f"select {', '.join(chosen)} from {', '.join(relations)}" + (f" where {' and '.join(tests)}" if tests else "")
        want = sorted(con.execute(sql).fetchall(), key=str)
        assert sorted((tuple(r) for r in session.query(sql.replace("'", '"')).collect()), key=str) == want, sql


def test_strings_are_measured_in_bytes(own, tmp_path):
    """Five letters of two bytes in a c4 column: two are kept, as in a literal and on loading."""
    (tmp_path / "own" / "e.data").write_text("1,ééééé\n2,abé\n3,aé\n4\n")
    results = run(own, 'create table R (a i, s c4); insert into R values (0, "ééééé"); load R ("e.data");')
    assert [r.error for r in results] == [None] * 3 and "1 string(s)" in results[2].message and results[2].message.startswith("4 ")
    assert sorted((r["a"], r["s"]) for r in own.query("select * from R").collect()) == [(0, "éé"), (1, "éé"), (2, "abé"), (3, "aé"), (4, "")]
    assert sorted(r[0] for r in own.query('select a from R where s = "ééX"').collect()) == [0, 1]
    run(own, 'update R set s = "éééé" where a = 4;')
    assert own.query('select a from R where s = "éé"').count() == 3
    # A character that the length cuts goes.
    (tmp_path / "own" / "t.data").write_text("éé\n")
    run(own, 'create table T (s c3); insert into T values ("éé"); load T ("t.data");')
    assert [r[0] for r in own.query('select s from T where s = "éé"').collect()] == ["é", "é"] and own.query('select s from T where s > "é"').count() == 0


def test_files_that_fail_end_with_a_code(own, tmp_path):
    run(own, "create table R (a i, s c4);")
    (tmp_path / "own" / "wide.data").write_text("1,a,more\n")
    (result,) = own.execute('load R ("nowhere.data");')
    assert result.error.name == "SM_BADTABLE" and own.ended and own.code == result.code < 0
    own.ended = False
    with pytest.raises(LineFault, match="wide.data"):
        run(own, 'load R ("wide.data");')
    assert own.db.relation("R").records == 0
    # A file that is lost is told by a code.
    run(own, 'insert into R values (1, "x");')
    own.db.storage.delete(own.db.relation("R").parts[0])
    (result,) = own.execute("delete from R where a = 1;")
    assert result.error.name == "PF_UNIX" and own.ended


def test_a_second_writer_is_refused_with_a_code(own):
    run(own, "create table R (a i);")
    other = Session(own.spark, own.db.root)
    run(own, "insert into R values (1);")
    (result,) = other.execute("insert into R values (2);")
    assert result.error.name == "PF_UNIX" and other.ended
    assert [r[0] for r in Session(own.spark, own.db.root).query("select a from R").collect()] == [1]


def test_many_inserts_are_compacted_and_stay_sorted(own):
    import glob

    import pyarrow.parquet as pq

    from marlstone.sources.catalog import MANY_PARTS

    run(own, "create table R (a i, b i); insert into R values (5, 0); create index R(a);")
    for i in range(MANY_PARTS + 2):
        run(own, f"insert into R values ({(i * 7) % 20}, {i + 1});")
    r = own.db.relation("R")
    assert r.records == MANY_PARTS + 3 and len(r.parts) < 5
    for part in r.parts:
        values = [x for f in sorted(glob.glob(f"{own.db.root}/{part}/*.parquet")) for x in pq.read_table(f)["a"].to_pylist()]
        assert values == sorted(values)
    assert [r[0] for r in own._utility(type("S", (), {"action": "print", "what": "R"})).rows.select("b").collect()] == list(range(MANY_PARTS + 3))
    assert "PushedFilters: [IsNotNull(a), EqualTo(a,7)" in "".join(own.query("select b from R where a = 7")._jdf.queryExecution().toString())


def small_deals(monkeypatch):
    """Few pairs a task, so that small joins are dealt."""
    for name, value in (("PAIRS", 256), ("HELD", 16), ("MANY", 2)):
        monkeypatch.setattr(relational, name, value, raising=False)


def test_join_of_many_pairs_is_dealt_to_tasks(spark, monkeypatch):
    """Two values, files of one part: no task has more than a small share of the pairs, and there are as many tasks as the pairs ask for."""
    small_deals(monkeypatch)
    session = Session(spark)
    for name, n in (("R", 400), ("S", 90)):
        columns = (f"id AS {name}_id", f"CAST(id % 2 AS INT) AS {name}_k", f"CAST(id % 7 AS DOUBLE) AS {name}_x")
        session.register(name, spark.range(0, n, 1, 1).selectExpr(*columns), (f"{name}_id",))
    for where, n in (("where R_k = S_k", 400 * 45), ("where R_k = S_k and R_x <> S_x", None), ("where R_x <> S_x", None), ("", 400 * 90)):
        rows = session.query(f"select R_id, S_id from R, S {where}")
        parts = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
        assert len(parts) > 20 and max(parts) < sum(parts) / 8 and n in (None, sum(parts)), where


def test_joins_to_unique_columns_are_not_counted(spark, monkeypatch):
    small_deals(monkeypatch)
    monkeypatch.setattr(relational, "dealt", lambda *_: pytest.fail("counted"))
    session = Session(spark).register("R", spark.range(9).selectExpr("id AS a", "id % 2 AS b", "1 AS c"), ("a",)).register("S", spark.range(9).selectExpr("id AS d", "id AS e"), ("d",))
    session.register("T", spark.range(9).selectExpr("id AS f", "id AS g"), ("f",))
    assert session.query("select a, f from R, S, T where b = d and e = f").count() == 9
    assert session.query("select a, f from S, R, T where b = d and a = g").count() == 9


@pytest.mark.parametrize("where", [
    "ka = kb", "ka = kb and xa < xb", "xa = xb", "sa = sb and xa >= xb", "xa < xb", "ka = kb and sa = sb", "ka = xi and xa <> xb", "da = tb and ka = kb", "na = nb", "",
    "ka = kb and kb = kc", "ka = kc and xb <= xc", "sa = sb and ka <> kc",
])
def test_dealt_joins_equal_sql(spark, monkeypatch, where):
    """Nulls, -0.0, NaN, values of two types, one value for most rows and copies of rows."""
    small_deals(monkeypatch)
    rng = random.Random(5)
    con, session, made = duckdb.connect(), Session(spark), []
    deal = relational.dealt
    monkeypatch.setattr(relational, "dealt", lambda *given: made.append(deal(*given)) or made[-1])
    floats, days = [0.0, -0.0, float("nan"), 1.5, -2.0, None], [datetime.date(2020, 1, 1 + i) for i in range(2)]
    for t, n, k in (("A", 150, "INT"), ("B", 120, "BIGINT"), ("C", 12, "INT")):
        c = t.lower()
        rows = [(i, rng.choice([1, 1, 1, 1, 2, 3, None]), rng.choice(floats), rng.choice(["x", "x", "é", "", None]), rng.choice(days), 0) for i in range(n)]
        rows += [(7, 1, 0.0, "x", days[0], 0)] * (60 if t != "C" else 3)
        names = [f"{x}{c}" for x in "ikxsdn"]
        if t == "B":
            rows, names = [(*r, r[1]) for r in rows], [*(f"{x}b" for x in "ikxstn"), "xi"]
        kinds = ["INT", k, "DOUBLE", "STRING", "TIMESTAMP" if t == "B" else "DATE", "INT", "SMALLINT"][: len(names)]
        if t == "B":
            rows = [(*r[:4], datetime.datetime(r[4].year, 1, r[4].day), *r[5:]) for r in rows]
        session.register(t, spark.createDataFrame(rows, ", ".join(f"{a} {b}" for a, b in zip(names, kinds))))
        con.execute(f"CREATE TABLE {t} ({', '.join(f'{a} {b}' for a, b in zip(names, kinds))})")
        con.executemany(f"INSERT INTO {t} VALUES ({', '.join('?' * len(names))})", rows)
    relations = "A, B, C" if "c" in where else "A, B"
    text = f"select ia, ib from {relations}" + (f" where {where}" if where else "")
    assert Counter(tuple(r) for r in session.query(text).collect()) == Counter(con.execute(text).fetchall())
    assert [m is not None for m in made].count(True) == 1
