"""CSV files in and out, the printer and the shell."""

import io
import json

import pytest

from quillframe import Engine, SqlError
from quillframe.plans.lexer import statements
from quillframe.printer import render
from quillframe.shell import Shell

LOADS = [
    ("id,name,active\n1,Alice,true\n2,Bob,false", ["INTEGER", "STRING", "BOOLEAN"], [(1, "Alice", True), (2, "Bob", False)]),
    ("value\n1\n2.5\n3", ["DOUBLE"], [(1.0,), (2.5,), (3.0,)]),
    ("value\n1\nhello\n3", ["STRING"], [("1",), ("hello",), ("3",)]),
    ("id,name\n1,Alice\n2,\n3,Charlie", ["INTEGER", "STRING"], [(1, "Alice"), (2, None), (3, "Charlie")]),
    ('name,city\n"Smith, John","New York"\nJane,Boston', ["STRING", "STRING"], [("Smith, John", "New York"), ("Jane", "Boston")]),
    ('name\n"She said ""hello"""', ["STRING"], [('She said "hello"',)]),
    ("flag\ntrue\nFALSE", ["BOOLEAN"], [(True,), (False,)]),
    ("a,b\n1,\n2,", ["INTEGER", "INTEGER"], [(1, None), (2, None)]),
    ("d\n2020-01-02\n2021-03-04", ["STRING"], [("2020-01-02",), ("2021-03-04",)]),
    ("a,b,c\n1,2\n3,4,5,6\n\n7,8,9", ["INTEGER"] * 3, [(1, 2, None), (3, 4, 5), (7, 8, 9)]),
    ("a,b\r\n1,x\r\n2,y\r\n", ["INTEGER", "STRING"], [(1, "x"), (2, "y")]),
    ('a,b\n1,"two\nlines"\n2," x "', ["INTEGER", "STRING"], [(1, "two\nlines"), (2, "x")]),
    ("x\n1e5\n-2", ["DOUBLE"], [(100000.0,), (-2.0,)]),
    ("x\n99999999999999999999\n+7", ["INTEGER"], [(None,), (7,)]),
    ("x\n1\ntrue", ["STRING"], [("1",), ("true",)]),
    ("﻿x,y\n1,2", ["INTEGER", "INTEGER"], [(1, 2)]),
    ("x,y\n", ["INTEGER", "INTEGER"], []),
]


@pytest.mark.parametrize("text, kinds, rows", LOADS)
def test_load(spark, tmp_path, text, kinds, rows):
    path = tmp_path / "f.csv"
    path.write_bytes(text.encode())
    e = Engine(spark)
    assert e.query(f"LOAD '{path}' AS t").message == f"Loaded {len(rows)} row(s) into 't'."
    assert [r[2] for r in e.query("DESCRIBE t").rows()] == kinds
    assert e.query("SELECT * FROM t").rows() == rows


def test_load_errors(spark, tmp_path):
    (tmp_path / "empty.csv").write_text("")
    with pytest.raises(SqlError):
        Engine(spark).query(f"LOAD '{tmp_path}/empty.csv' AS t")


@pytest.fixture
def db(spark):
    e = Engine(spark)
    e.query("CREATE TABLE t (id INT, s STRING, x DOUBLE, b BOOL)")
    e.query("""INSERT INTO t VALUES (1, 'a,"b"', 1.23456789, true), (2, NULL, 3, false), (3, 'l
l\\', NULL, NULL)""")
    return e


def test_export_csv_and_back(db, tmp_path):
    path = tmp_path / "o.csv"
    assert db.query(f"EXPORT (SELECT * FROM t ORDER BY id) TO '{path}'").message == f"Exported 3 row(s) to '{path}' (CSV)."
    assert path.read_text() == 'id,s,x,b\n1,"a,""b""",1.23456789,true\n2,,3,false\n3,"l\nl\\",,\n'
    db.query(f"LOAD '{path}' AS u")
    assert db.query("SELECT * FROM u ORDER BY id").rows() == db.query("SELECT * FROM t ORDER BY id").rows()


def test_export_json(db, tmp_path):
    path = tmp_path / "o.json"
    assert db.query(f"EXPORT (SELECT id, s, x AS y FROM t ORDER BY id) TO '{path}'").message.endswith("(JSON).")
    assert json.loads(path.read_text()) == [{"id": 1, "s": 'a,"b"', "y": 1.23456789}, {"id": 2, "s": None, "y": 3.0}, {"id": 3, "s": "l\nl\\", "y": None}]
    db.query(f"EXPORT (SELECT id FROM t WHERE id > 9) TO '{path}'")
    assert json.loads(path.read_text()) == []
    db.query(f"EXPORT (SELECT id FROM t ORDER BY id) TO '{tmp_path}/x.dat' FORMAT JSON")
    assert len(json.loads((tmp_path / "x.dat").read_text())) == 3


def test_render():
    text = render(["n", "name"], [(1, "a"), (2.5, None), (10.0, "bb")])
    assert text.splitlines() == ["+-----+------+", "| n   | name |", "+-----+------+", "|   1 | a    |", "| 2.5 | NULL |", "|  10 | bb   |", "+-----+------+"]


def test_statements():
    assert statements("a; b ';' c;\n-- x;\n d") == (["a", " b ';' c"], "\n-- x;\n d")


def test_shell(db):
    out = io.StringIO()
    shell = Shell(db, out)
    for line in ("SELECT id", "FROM t WHERE id = 1;", "SELECT nope FROM t;", "INSERT INTO t (id) VALUES (9); DELETE FROM t WHERE id = 9;", ".stats", ".tables", ".help", ".nope", ".clear", "SHOW TABLES;"):
        assert shell.line(line)
    assert not shell.line(".quit") and not shell.line(".exit")
    text = out.getvalue()
    assert "|  1 |" in text and "1 row (" in text and "Error: no column nope" in text and "1 row(s) deleted from 't'." in text and "Error: unknown command .nope" in text


def test_export_leaves_the_target_until_it_is_done(db, tmp_path):
    path = tmp_path / "o.csv"
    path.write_text("before")
    with pytest.raises(Exception, match="Division by zero"):
        db.query(f"EXPORT (SELECT 1 / (id - id) AS x FROM t) TO '{path}'")
    assert path.read_text() == "before" and list(tmp_path.iterdir()) == [path]


def test_json_has_no_nan(spark, tmp_path):
    engine = Engine(spark)
    engine.register("f", spark.createDataFrame([(float("nan"), 1.5), (float("-inf"), 2.0)], "a double, b double"))
    engine.query(f"EXPORT (SELECT a, b FROM f ORDER BY b) TO '{tmp_path}/f.json'")
    read = json.loads((tmp_path / "f.json").read_text(), parse_constant=lambda x: pytest.fail(x))
    assert read == [{"a": None, "b": 1.5}, {"a": None, "b": 2.0}]


def test_export_folder(db, tmp_path):
    done = db.query(f"EXPORT (SELECT id, x FROM t) TO '{tmp_path}/out/' FORMAT CSV")
    assert done.message == f"Exported 3 row(s) to '{tmp_path}/out/' (CSV)."
    db.query(f"LOAD '{tmp_path}/out' AS back")
    assert sorted(db.query("SELECT id FROM back").rows()) == [(1,), (2,), (3,)]


@pytest.mark.parametrize("x, digits, want", [(1e20, None, 1e20), (3e16, 4, 3e16), (-1e300, 2, -1e300), (2.5, None, 3.0), (-2.5, None, -3.0), (1.005e3, 1, 1005.0), (9007199254740991.0, None, 9007199254740991.0)])
def test_round_of_large_numbers(spark, x, digits, want):
    engine = Engine(spark)
    engine.register("r", spark.createDataFrame([(x,)], "x double"))
    assert engine.query(f"SELECT ROUND(x{'' if digits is None else f', {digits}'}) AS r FROM r").rows() == [(want,)]
