import pytest

from keystrata.errors import SqlError
from keystrata.plans.access import FULL, POINT, RANGE, access_path
from keystrata.sql.lexer import tokenize
from keystrata.sql.parser import Comparison, CreateTable, Delete, Insert, Select, parse
from keystrata.types import INT64_MAX, Column, TableSchema

T = TableSchema("t", (Column("id", "INTEGER"), Column("name", "TEXT"), Column("age", "INTEGER")))


def test_tokens():
    assert [(t.kind, t.text) for t in tokenize("a <= -5, 'x y';")] == [("name", "a"), ("symbol", "<="), ("int", "-5"), ("symbol", ","), ("text", "'x y'"), ("symbol", ";"), ("end", "")]


@pytest.mark.parametrize("sql", [
    "'unterminated", "SELECT # FROM t", "CREATE TABLE t (name TEXT)", "UPDATE users SET x = 1", "SELECT * FROM users WHERE id = 1 garbage", "SELECT * users",
    "SELECT * FROM t WHERE id <> 1", "SELECT * FROM t WHERE 1 = id", "SELECT * FROM t WHERE id = id", "SELECT count(*) FROM t", "SELECT * FROM t WHERE a = 'it''s'",
    "SELECT * FROM t WHERE id = 99999999999999999999", "INSERT INTO t VALUES ()", "", "CREATE TABLE t (id FLOAT)", "SELECT * FROM t WHERE id = 1 OR id = 2",
])
def test_rejected(sql):
    with pytest.raises(SqlError):
        parse(sql)


def test_statements():
    assert parse("create table t (id integer, v text);") == CreateTable("t", (Column("id", "INTEGER"), Column("v", "TEXT")))
    assert parse("INSERT INTO t VALUES (1, 'a')") == Insert("t", (1, "a"))
    assert parse("SELECT v, id, v FROM t WHERE id > 5 AND id <= 10") == Select("t", ("v", "id", "v"), (Comparison("id", ">", 5), Comparison("id", "<=", 10)))
    assert parse("DELETE FROM t") == Delete("t")


def where(sql):
    return access_path(parse(f"SELECT * FROM t{sql}").where, T)


def test_access_paths():
    assert where("").kind == FULL
    assert (where(" WHERE id = 5").kind, where(" WHERE id = 5").key, where(" WHERE id = 5").residual) == (POINT, 5, ())
    assert where(" WHERE id = 5 AND age > 10").residual == (Comparison("age", ">", 10),)
    assert (where(" WHERE age = 10").kind, len(where(" WHERE age = 10").residual)) == (FULL, 1)
    p = where(" WHERE id > 5 AND id <= 20")
    assert (p.kind, p.low, p.high) == (RANGE, 6, 20)
    assert (where(" WHERE id >= 5").low, where(" WHERE id >= 5").high) == (5, INT64_MAX)
    assert (where(" WHERE id < 5").low, where(" WHERE id < 5").high) == (0, 4)
    for bad in (" WHERE bogus = 1", " WHERE id = 'oops'"):
        with pytest.raises(SqlError):
            where(bad)


@pytest.mark.parametrize("row", [(-1, "a", 1), (1 << 48, "a", 1), ("x", "a", 1), (1, "a"), (1, 2, 3), (1, "x" * 63, 1), (True, "a", 1), ()])
def test_rows_rejected(row):
    with pytest.raises(SqlError):
        T.check_row(row)
    with pytest.raises(SqlError):
        TableSchema("d", (Column("id", "INTEGER"), Column("id", "TEXT")))
