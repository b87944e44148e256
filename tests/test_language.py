"""Tokens, statements, types and headings; no Spark."""

import pytest

from marlstone.errors import CODES, EngineError, FormatError, SyntaxFault
from marlstone.operators.relational import headings
from marlstone.plans import parser
from marlstone.plans import syntax as S
from marlstone.plans.lexer import Token, tokens
from marlstone.types import FLOAT, INT, STRING, Attribute, parse_type


def one(text):
    (made,) = parser.parse(text)
    return made


def test_tokens():
    text = 'SeLeCt a_1 /* not * this */ , "x ""y" -5 +6 1.5 -2.5e-3 != <> <= >= < > = . ; ~ b'
    got = [(t.kind, t.value) for t in tokens(text)]
    assert got == [
        ("select", None), ("name", "a_1"), (",", None), ("quoted", 'x ""y'), ("int", -5), ("int", 6), ("real", 1.5), ("real", -0.0025),
        *(("op", x) for x in ("<>", "<>", "<=", ">=", "<", ">", "=")), (".", None), (";", None), ("name", "b"),
    ]
    assert [t.kind for t in tokens("1. .5")] == ["int", ".", ".", "int"]
    assert list(tokens("a /* open")) == [Token("name", "a")]
    assert list(tokens("x" * 300))[0].kind == "bad" and list(tokens('"open\nx'))[0].kind == "bad"


def test_names_keep_their_case_and_keywords_do_not():
    assert one("SELECT Ab FROM Cd;") == S.Select((S.Item("", S.Name(None, "Ab")),), ("Cd",))


def test_clauses_in_either_order():
    a, b = one("select a from R order by a desc group by b;"), one("select a from R group by b order by a desc;")
    assert a == b and a.descending and a.group == S.Name(None, "b")
    assert not one("select a from R order by R.a asc;").descending


def test_statements():
    assert one("create table R (a i, b c10);") == S.CreateTable("R", (("a", "i"), ("b", "c10")))
    assert one("drop table R;") == S.DropTable("R")
    assert one("create index R(a);") == S.CreateIndex("R", "a")
    assert one("drop index R(a);") == S.DropIndex("R", "a")
    assert one('load R("f.data");') == S.Load("R", "f.data")
    assert one('insert into R values (1, 2.5, "x");') == S.Insert("R", (S.Literal(INT, 1), S.Literal(FLOAT, 2.5), S.Literal(STRING, "x")))
    assert one("delete from R where a = b;") == S.Delete("R", (S.Condition(S.Name(None, "a"), "=", S.Name(None, "b")),))
    assert one("update R set a = 3 where R.a <> 4;") == S.Update("R", S.Name(None, "a"), S.Literal(INT, 3), (S.Condition(S.Name("R", "a"), "<>", S.Literal(INT, 4)),))
    assert one('set mergejoin = "no";') == S.Setting("mergejoin", "no")
    for text, action, what in [("help;", "help", ""), ("help R;", "help", "R"), ("print R;", "print", "R"), ("print io;", "print io", ""), ("reset buffer;", "reset buffer", ""), ("queryplans on;", "queryplans", "on"), (";", "nothing", ""), ("exit;", "exit", "")]:
        assert one(text) == S.Utility(action, what)
    assert one("resize buffer 50;") == S.Utility("resize buffer", number=50)
    assert one("select COUNT(*), MIN(R.a), max(b) from R group by c;").items == (S.Item("COUNT", S.Name(None, "*")), S.Item("MIN", S.Name("R", "a")), S.Item("MAX", S.Name(None, "b")))


@pytest.mark.parametrize("text", [
    "select a from R order by a, b;", "select a from R group by a, b;", "select a from R order by a order by b;", "select from R;", "select a R;", "select a from R where 3 = a;",
    "select a from R where a = 1 or b = 2;", "select a + 1 from R;", "insert into R values ();", "create table R ();", "foo;", "select GAVG(a) from R group by a;", "select a from R", "!ls\n",
    "update R set a = 1, b = 2;", "select *, a from R;", 'set "a" = "b";', "select a as b from R;",
])
def test_faults(text):
    assert isinstance(one(text), SyntaxFault)


def test_parsing_goes_on_after_a_fault():
    kinds = [type(x).__name__ for x in parser.parse("select a from R; nonsense here; help; exit;")]
    assert kinds == ["Select", "SyntaxFault", "Utility", "Utility"]


def test_types():
    assert [parse_type(t) for t in ("i", "i4", "f", "f4", "r", "r4", "c1", "s255")] == [(INT, 4)] * 2 + [(FLOAT, 4)] * 4 + [(STRING, 1), (STRING, 255)]
    for t in ("i8", "f8", "c", "s", "c0", "c256", "x", "x4"):
        with pytest.raises(FormatError):
            parse_type(t)


def test_too_many_elements():
    with pytest.raises(FormatError):
        parser.limits(one("select " + ", ".join(f"a{i}" for i in range(41)) + " from R;"))
    parser.limits(one("select " + ", ".join(f"a{i}" for i in range(40)) + " from R;"))


def test_headings():
    a, b, c = Attribute("R", "x", INT, 4), Attribute("S", "x", INT, 4), Attribute("R", "y", INT, 4)
    assert headings([("", a), ("", c)]) == ["x", "y"]
    assert headings([("", a), ("", b), ("MIN", c)]) == ["R.x", "S.x", "MIN(y)"]
    assert headings([("", a), ("COUNT", a)]) == ["R.x", "COUNT(R.x)"]


def test_codes():
    assert EngineError("SM_NOSUCHENTRY").is_warning and not EngineError("SM_AMBGATTR").is_warning
    assert CODES["SM_BADAGGFUN"] == -314 and CODES["QL_JOINKEYTYPEMISMATCH"] == -407 and len(set(CODES.values())) == len(CODES)
