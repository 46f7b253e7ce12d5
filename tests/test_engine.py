"""Statements end to end on small tables."""

import pytest

from quillframe import Engine, SqlError


@pytest.fixture
def db(spark):
    e = Engine(spark)
    e.query("CREATE TABLE employees (id INTEGER, name STRING, department_id INTEGER, salary INTEGER, is_active BOOLEAN)")
    e.query("INSERT INTO employees VALUES (1,'Alice',1,85000,true),(2,'Bob',2,72000,true),(3,'Charlie',1,92000,true),(4,'Diana',3,68000,false),(5,'Eve',2,78000,true)")
    e.query("CREATE TABLE departments (id INT, name VARCHAR, location TEXT)")
    e.query("INSERT INTO departments VALUES (1,'Engineering','SF'),(2,'Marketing','NY'),(3,'Sales','Chicago')")
    return e


@pytest.fixture
def edge(spark):
    e = Engine(spark)
    rows = [
        (1, "alice", 1.001, True), (2, "Alice", 1.004, False), (3, "NULL", 1.005, None), (4, "", -1.005, True), (5, " x ", 2.5, True),
        (6, "a%b", -2.5, False), (7, "a\\b", None, True), (8, None, 0.0, True), (None, "é", 3.0, False),
    ]
    e.register("edge", spark.createDataFrame(rows, "k long, s string, d double, b boolean"))
    return e


def q(e, sql):
    return e.query(sql).rows()


def col(e, sql):
    return [r[0] for r in q(e, sql)]


SELECTS = [
    ("SELECT COUNT(*) FROM employees", [(5,)]),
    ("SELECT SUM(salary), AVG(salary), MIN(salary), MAX(salary) FROM employees", [(395000, 79000.0, 68000, 92000)]),
    ("SELECT name FROM employees WHERE department_id = 1 ORDER BY name", [("Alice",), ("Charlie",)]),
    ("SELECT name FROM employees WHERE salary > 70000 AND department_id = 2 ORDER BY id", [("Bob",), ("Eve",)]),
    ("SELECT name FROM employees WHERE name LIKE 'a%'", [("Alice",)]),
    ("SELECT COUNT(*) FROM employees WHERE salary BETWEEN 70000 AND 86000", [(3,)]),
    ("SELECT COUNT(*) FROM employees WHERE salary NOT BETWEEN 70000 AND 86000", [(2,)]),
    ("SELECT name FROM employees WHERE id IN (1, 3, 5) ORDER BY id", [("Alice",), ("Charlie",), ("Eve",)]),
    ("SELECT COUNT(*) FROM employees WHERE name IS NOT NULL", [(5,)]),
    ("SELECT name FROM employees ORDER BY salary DESC LIMIT 2", [("Charlie",), ("Alice",)]),
    ("SELECT DISTINCT department_id FROM employees ORDER BY department_id", [(1,), (2,), (3,)]),
    ("SELECT DISTINCT department_id FROM employees ORDER BY salary DESC", [(1,), (2,), (3,)]),
    ("SELECT department_id, COUNT(*) AS n FROM employees GROUP BY department_id HAVING COUNT(*) > 1 ORDER BY department_id", [(1, 2), (2, 2)]),
    ("SELECT department_id FROM employees GROUP BY department_id HAVING AVG(salary) > 70000 ORDER BY MAX(salary)", [(2,), (1,)]),
    ("SELECT department_id d, COUNT(*) AS n FROM employees GROUP BY department_id HAVING n > 1 ORDER BY d", [(1, 2), (2, 2)]),
    ("SELECT COUNT(DISTINCT department_id) FROM employees", [(3,)]),
    ("SELECT e.name, d.name FROM employees e JOIN departments d ON e.department_id = d.id WHERE d.location = 'ny' ORDER BY e.id", [("Bob", "Marketing"), ("Eve", "Marketing")]),
    ("SELECT d.name, COUNT(*) FROM employees e JOIN departments d ON e.department_id = d.id GROUP BY d.name ORDER BY d.name", [("Engineering", 2), ("Marketing", 2), ("Sales", 1)]),
    ("SELECT UPPER(name), LENGTH(name) FROM employees WHERE id = 1", [("ALICE", 5)]),
    ("SELECT salary * 12 AS annual FROM employees WHERE id = 1", [(1020000,)]),
    ("SELECT name FROM employees WHERE department_id IN (SELECT id FROM departments WHERE location = 'NY') ORDER BY id", [("Bob",), ("Eve",)]),
    ("SELECT COUNT(*) FROM employees WHERE department_id NOT IN (SELECT id FROM departments WHERE location = 'NY')", [(3,)]),
    ("SELECT name FROM employees WHERE salary = (SELECT MAX(salary) FROM employees)", [("Charlie",)]),
    ("SELECT COUNT(*) FROM employees WHERE salary > (SELECT AVG(salary) FROM employees)", [(2,)]),
    ("SELECT COUNT(*) AS n FROM (SELECT DISTINCT department_id FROM employees) AS sub", [(3,)]),
    ("SELECT sub.name FROM (SELECT name, salary FROM employees WHERE salary > 80000) AS sub ORDER BY sub.salary", [("Alice",), ("Charlie",)]),
    ("SELECT MAX(salary) - MIN(salary) AS spread, SUM(salary * 2), SUM(salary + 1) FROM employees", [(24000, 790000, 395005)]),
    ("SELECT ROUND(AVG(salary) / 7, 2) FROM employees GROUP BY is_active ORDER BY is_active", [(9714.29,), (11678.57,)]),
    ("SELECT name FROM employees WHERE salary > (SELECT AVG(salary) FROM employees) OR id IN (SELECT id FROM departments WHERE location = 'NY') ORDER BY id", [("Alice",), ("Bob",), ("Charlie",)]),
    ("SELECT department_id FROM employees GROUP BY department_id HAVING SUM(salary) > (SELECT AVG(salary) FROM employees) AND department_id IN (SELECT id FROM departments) ORDER BY 1, department_id", [(1,), (2,)]),
    ("SELECT (SELECT MAX(id) FROM departments) AS m, name FROM employees WHERE id = 2", [(3, "Bob")]),
    ("SELECT name n FROM employees WHERE is_active ORDER BY n DESC LIMIT 0", []),
    ("SELECT d.* FROM employees e RIGHT JOIN departments d ON e.department_id = d.id AND e.salary > 80000 WHERE e.id IS NULL ORDER BY d.id", [(2, "Marketing", "NY"), (3, "Sales", "Chicago")]),
    ("SELECT e.name FROM employees e LEFT JOIN departments d ON e.department_id = d.id AND d.id IN (SELECT id FROM departments WHERE name = 'sales') WHERE d.id IS NOT NULL", [("Diana",)]),
    ("SELECT COUNT(*) FROM employees CROSS JOIN departments", [(15,)]),
    ("SELECT a.name, b.name FROM employees a JOIN employees b ON a.salary < b.salary AND a.department_id = b.department_id ORDER BY a.id", [("Alice", "Charlie"), ("Bob", "Eve")]),
    ("SELECT e.name FROM employees e RIGHT JOIN departments d ON e.id > d.id + 10 ORDER BY d.id", [(None,), (None,), (None,)]),
    ("SELECT COUNT(*) c, SUM(salary) s, MIN(name) m FROM employees WHERE id > 100", [(0, None, None)]),
    ("SELECT UPPER(name) FROM employees GROUP BY UPPER(name) ORDER BY UPPER(name) LIMIT 1", [("ALICE",)]),
    ("SELECT e.department_id, name FROM employees e GROUP BY department_id, e.name ORDER BY name LIMIT 1", [(1, "Alice")]),
]


@pytest.mark.parametrize("sql, rows", SELECTS)
def test_select(db, sql, rows):
    assert q(db, sql) == rows


def test_output_names(db):
    assert db.sql("SELECT e.name, COUNT(DISTINCT salary), MAX(id) - 1 x, salary + 1 FROM employees e GROUP BY e.name, salary").columns == ["name", "COUNT(DISTINCT salary)", "x", "(salary + 1)"]
    assert db.sql("SELECT * FROM employees e JOIN departments d ON e.department_id = d.id").columns == ["id", "name", "department_id", "salary", "is_active", "id", "name", "location"]


EDGE = [
    ("V1", "SELECT k FROM edge WHERE s = 'ALICE' ORDER BY k", [(1,), (2,)]),
    ("V1", "SELECT k FROM edge WHERE s IN ('ALICE', 'zz') ORDER BY k", [(1,), (2,)]),
    ("V2", "SELECT COUNT(DISTINCT s) FROM edge WHERE s LIKE 'alice'", [(2,)]),
    ("V3", "SELECT CONCAT(d, '') FROM edge WHERE k IN (1, 5, 8) ORDER BY k", [("1.00",), ("2.50",), ("0",)]),
    ("V3 key", "SELECT COUNT(*) FROM (SELECT d FROM edge WHERE k < 3 GROUP BY d) AS g", [(2,)]),
    ("V4", "SELECT COUNT(*) FROM edge a JOIN edge b ON a.s = b.s WHERE a.k = 8", [(0,)]),
    ("V6", "SELECT k FROM edge WHERE k > '5' ORDER BY k", [(6,), (7,), (8,)]),
    ("V7", "SELECT COUNT(*) FROM edge WHERE b = 1", [(0,)]),
    ("V8", "SELECT k FROM edge WHERE s ORDER BY k LIMIT 2", [(None,), (1,)]),
    ("V8", "SELECT COUNT(*) FROM edge WHERE d", [(7,)]),
    ("V9", "SELECT SUM(b + 1) FROM edge", [(13,)]),
    ("V10", "SELECT COUNT(*) FROM edge WHERE NOT (b AND k = 3)", [(9,)]),
    ("V10", "SELECT k FROM edge WHERE NOT (k = 1 OR k > 1)", [(None,)]),
    ("V11", "SELECT COUNT(*) FROM edge WHERE k NOT IN (1, NULL)", [(7,)]),
    ("V11", "SELECT COUNT(*) FROM edge WHERE k NOT IN (SELECT k FROM edge WHERE k IS NULL OR k < 3)", [(6,)]),
    ("V11", "SELECT COUNT(*) FROM edge WHERE NOT (k IN (SELECT k FROM edge WHERE k IS NULL OR k < 3))", [(6,)]),
    ("V13", "SELECT 5 / 2, 7 % 3, -7 % 3 FROM edge WHERE k = 1", [(2.5, 1, -1)]),
    ("V14", "SELECT k FROM edge ORDER BY k LIMIT 1", [(None,)]),
    ("V14", "SELECT k FROM edge ORDER BY k DESC LIMIT 1", [(8,)]),
    ("F5", "SELECT COUNT(*) FROM edge WHERE k NOT BETWEEN NULL AND 3", [(0,)]),
    ("F9", "SELECT k FROM edge WHERE s LIKE 'A\\b'", [(7,)]),
    ("F9", "SELECT k FROM edge WHERE s LIKE 'a_b' ORDER BY k", [(6,), (7,)]),
    ("F9", "SELECT k FROM edge WHERE s NOT LIKE '%' ", []),
    ("F9", "SELECT k FROM edge WHERE d LIKE '2.5%'", [(5,)]),
    ("A8", "SELECT MIN(s), MAX(s) FROM edge WHERE k IN (1, 2)", [("Alice", "alice")]),
    ("A13", "SELECT SUM(DISTINCT b + 1), AVG(DISTINCT b + 1) FROM edge", [(3, 1.5)]),
    ("O3s", "SELECT k FROM edge WHERE k IS NOT NULL ORDER BY 1, k DESC LIMIT 1", [(8,)]),
    ("U4", "SELECT TRIM(s), LENGTH(s) FROM edge WHERE k = 5", [("x", 3)]),
    ("U5", "SELECT ABS(0 - k) FROM edge WHERE k = 3", [(3.0,)]),
    ("U6", "SELECT ROUND(d), ROUND(d, 1), ROUND(2.345, 2) FROM edge WHERE k = 6", [(-3.0, -2.5, 2.35)]),
    ("U6", "SELECT ROUND(d, k) FROM edge WHERE k = 1", [(1.0,)]),
    ("U7", "SELECT COALESCE(s, k), COALESCE(NULL, d, 1) FROM edge WHERE k = 8", [("8", 0.0)]),
    ("U8", "SELECT CONCAT(s, '-', b, NULL, k) FROM edge WHERE k = 8", [("-true8",)]),
    ("U9", "SELECT SUBSTRING('hello', 2, 3), SUBSTRING('hello', 0, 3), SUBSTRING('hello', -4), SUBSTRING('hello', 9, 2), SUBSTRING('hello', 2, -1) FROM edge WHERE k = 1", [("ell", "hel", "hello", "", "ello")]),
    ("U1", "SELECT UPPER(s), LOWER(k), LENGTH(s) FROM edge WHERE k IS NULL", [("É", None, 1)]),
    ("Q1", "SELECT COUNT(*) FROM edge WHERE k = (SELECT k FROM edge WHERE k > 1000)", [(0,)]),
    ("Q1", "SELECT (SELECT k FROM edge ORDER BY k DESC) x FROM edge WHERE k = 1", [(8,)]),
]


@pytest.mark.parametrize("rule, sql, rows", EDGE)
def test_dialect(edge, rule, sql, rows):
    assert q(edge, sql) == rows


BAD = [
    "SELECT", "SELECT * FROM", "SELECT * FROM nowhere", "SELECT missing FROM employees", "SELECT id FROM employees e JOIN departments d ON e.department_id = d.id",
    "SELECT * FROM employees a FULL OUTER JOIN departments b ON a.id = b.id", "SELECT id FROM employees LIMIT 5 OFFSET 2", "SELECT id FROM employees UNION SELECT id FROM departments",
    "SELECT name, COUNT(*) FROM employees", "SELECT NOPE(id) FROM employees", "SELECT id FROM employees WHERE COUNT(*) > 1", "SELECT 'open FROM employees", "SELECT id FROM (SELECT id FROM employees)",
    "INSERT INTO employees VALUES (1)", "INSERT INTO employees (nope) VALUES (1)", "INSERT INTO employees (id) VALUES ('x')", "UPDATE employees SET nope = 1", "UPDATE employees SET salary = 'x'",
    "ALTER TABLE employees DROP nope", "ALTER TABLE employees ADD id INT", "ALTER TABLE employees RENAME id TO name", "CREATE TABLE t (a DECIMAL(10,2))", "CREATE TABLE t (a INT, A INT)", "CREATE INDEX i ON employees(nope)",
    "DROP INDEX nope", "DROP TABLE nope", "DESCRIBE nope", "LOAD '/nowhere/x.csv' AS t", "EXPORT (SELECT id FROM employees) TO '/nowhere/x.csv'", "SELECT id FROM employees WHERE id IN (SELECT id, name FROM departments)", "FROB x",
    "SELECT SUBSTRING(name) FROM employees", "SELECT SUM(*) FROM employees",
]


@pytest.mark.parametrize("sql", BAD)
def test_errors(db, sql):
    with pytest.raises(SqlError):
        db.query(sql)


def test_division_by_zero(db):
    for op in "/%":
        with pytest.raises(Exception, match="Division by zero"):
            q(db, f"SELECT id {op} (id - 1) FROM employees")


def test_update_delete_alter(db):
    assert db.query("UPDATE employees SET salary = salary * 1.10, name = CONCAT(name, '!') WHERE department_id = 1").message == "2 row(s) updated in 'employees'."
    assert q(db, "SELECT name, salary FROM employees WHERE id IN (1, 2) ORDER BY id") == [("Alice!", pytest.approx(93500.0)), ("Bob", 72000.0)]
    db.query("UPDATE employees SET id = salary, salary = id WHERE id = 5")
    assert q(db, "SELECT id, salary FROM employees WHERE name = 'eve'") == [(78000.0, 5.0)]
    db.query("UPDATE employees SET salary = (SELECT MAX(id) FROM departments) WHERE id IN (SELECT id FROM departments WHERE location = 'NY')")
    assert col(db, "SELECT salary FROM employees WHERE id = 2") == [3]
    db.query("UPDATE employees SET is_active = NULL")
    assert col(db, "SELECT COUNT(is_active) FROM employees") == [0]
    assert db.query("DELETE FROM employees WHERE department_id = 2").message == "2 row(s) deleted from 'employees'."
    assert col(db, "SELECT COUNT(*) FROM employees") == [3]
    db.query("ALTER TABLE employees ADD COLUMN email STRING")
    assert col(db, "SELECT COUNT(email) FROM employees") == [0]
    db.query("ALTER TABLE employees RENAME COLUMN email TO mail")
    db.query("ALTER TABLE employees DROP name")
    assert db.sql("SELECT * FROM employees").columns == ["id", "department_id", "salary", "is_active", "mail"]
    db.query("ALTER TABLE employees RENAME TO staff")
    assert [r[0] for r in db.query("SHOW TABLES").rows()] == ["staff", "departments"]
    assert db.query("DELETE FROM staff").message == "3 row(s) deleted from 'staff'."
    assert q(db, "DESCRIBE staff") == [(1, "id", "DOUBLE"), (2, "department_id", "INTEGER"), (3, "salary", "DOUBLE"), (4, "is_active", "BOOLEAN"), (5, "mail", "STRING")]
    db.query("CREATE TABLE one (a INT)")
    with pytest.raises(SqlError):
        db.query("ALTER TABLE one DROP a")
    db.query("DROP TABLE staff")
    with pytest.raises(SqlError):
        db.query("SELECT * FROM staff")


def test_insert_values(db):
    db.query("CREATE TABLE p (name STRING, price DOUBLE, n INTEGER, ok BOOL)")
    db.query("INSERT INTO p (name, price) VALUES ('it''s', 1), ('', -2.5)")
    db.query("INSERT INTO p VALUES ('x', NULL, 9.99, 'yes'), ('y', '2.5', '7', 0)")
    assert q(db, "SELECT * FROM p ORDER BY price DESC, name") == [("y", 2.5, 7, False), ("it's", 1.0, None, None), (None, -2.5, None, None), ("x", None, 9, True)]


def test_many_versions(db):
    for i in range(20):
        db.query(f"INSERT INTO departments VALUES ({100 + i}, 'd{i}', NULL)")
    assert col(db, "SELECT COUNT(*) FROM departments") == [23]


def test_indexes(db):
    db.query("CREATE INDEX idx ON employees(department_id)")
    assert q(db, "SHOW INDEXES") == [("idx", "employees", "department_id", 3)]
    assert q(db, "SELECT COUNT(*) FROM employees WHERE department_id = 1") == [(2,)]
    with pytest.raises(SqlError):
        db.query("CREATE INDEX idx ON employees(id)")
    db.query("INSERT INTO employees VALUES (6, 'Zed', 1, 1, true)")
    assert q(db, "SELECT COUNT(*) FROM employees WHERE department_id = 1") == [(3,)]
    db.query("ALTER TABLE employees RENAME department_id TO dept")
    assert q(db, "SHOW INDEXES") == [("idx", "employees", "dept", 3)]
    db.query("DROP INDEX idx")
    assert q(db, "SHOW INDEXES") == []


def test_filters_reach_the_files(spark, tmp_path):
    spark.createDataFrame([(i, f"n{i}", i * 1.5) for i in range(100)], "id long, name string, x double").write.parquet(str(tmp_path / "t"))
    e = Engine(spark, string_compare="binary")
    e.register("t", spark.read.parquet(str(tmp_path / "t")))
    plan = e.explain("SELECT id FROM t WHERE x > 10 AND name = 'n50' AND id IN (1, 50)")
    pushed = plan[plan.rindex("PushedFilters") :].splitlines()[0]
    assert "GreaterThan(x,10" in pushed and "EqualTo(name,n50)" in pushed and "In(id, [1,50])" in pushed
    plan = e.explain("SELECT id FROM t")
    assert "struct<id:bigint>" in plan
    assert e.query("SELECT id FROM t WHERE name = 'N50'").rows() == []


def test_text_filters_reach_the_files_in_any_case(spark, tmp_path):
    names = ["Brand#3", "BRAND#3", "brand#3", "brand#4", "bRand#35", "\u212aiwi", "kiwi", "KIWI", "k\u0130wi", "kiwis", "\u0130x", "ix", "IX", "zebra", "", None, "straße"]
    rows = list(enumerate(names))
    spark.createDataFrame(rows, "id long, name string").write.parquet(str(tmp_path / "t"))
    e = Engine(spark)
    e.register("t", spark.read.parquet(str(tmp_path / "t")))
    for where, keep in (
        ("name = 'Brand#3'", lambda s: s.lower() == "brand#3"),
        ("'KIWI' = name", lambda s: s.lower() == "kiwi"),
        ("name IN ('kiwi', 'Zebra')", lambda s: s.lower() in ("kiwi", "zebra")),
        ("name LIKE 'ki%'", lambda s: s.lower().startswith("ki")),
        ("name LIKE 'I%X'", lambda s: s.lower().startswith("i") and s.lower().endswith("x")),
        ("name LIKE 'brand__' OR name = 'IX'", lambda s: s.lower().startswith("brand") and len(s) == 7 or s == "ix" or s == "IX"),
        ("name = ''", lambda s: s == ""),
        ("name = 'STRAßE'", lambda s: s.lower() == "straße"),
        ("NOT name = 'kiwi'", lambda s: s.lower() != "kiwi"),
        ("name LIKE '%a'", lambda s: s.lower().endswith("a")),
    ):
        got = [r[0] for r in e.query(f"SELECT id FROM t WHERE {where} ORDER BY id").rows()]
        assert got == [i for i, s in rows if s is not None and keep(s)], where
    for where, bounds in (("name = 'Brand#3'", ("GreaterThanOrEqual(name,BRAND#3)", "LessThanOrEqual(name,brand#3)")), ("name LIKE 'bra%'", ("GreaterThanOrEqual(name,BRA)", "LessThan(name,brb)"))):
        plan = e.explain(f"SELECT id FROM t WHERE {where}")
        pushed = plan[plan.rindex("PushedFilters") :].splitlines()[0]
        assert all(x in pushed for x in bounds), pushed


def test_rows_scanned(spark, tmp_path):
    spark.range(100).write.parquet(str(tmp_path / "t"))
    e = Engine(spark)
    e.register("t", spark.read.parquet(str(tmp_path / "t")))
    done = e.query("SELECT COUNT(*) AS n FROM t")
    assert done.rows() == [(100,)] and done.scanned() == 100
    done = e.query("SELECT a.id FROM t a JOIN (SELECT id FROM t ORDER BY id LIMIT 5) b ON a.id = b.id")
    assert len(done.rows()) == 5 and done.scanned() >= 100
