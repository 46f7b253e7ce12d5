"""The registered queries of the dialect, one or more per operator, each with ANSI SQL for the same rows."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from quillframe.engine import Engine
from quillframe.plans.lexer import SqlError
from quillframe.sources.shared import shared_folder

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
Query = Callable[[SparkSession, str], DataFrame]


def engine(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = TABLES) -> Engine:
    e = Engine(spark)
    for name in names:
        e.register(name, spark.read.parquet(f"{sf_dir}/{name}.parquet"), f"{sf_dir}/{name}.parquet")
    return e


def used(sql: str) -> tuple[str, ...]:
    words = set(sql.lower().replace("(", " ").replace(")", " ").replace(";", " ").split())
    return tuple(x for x in TABLES if x in words)


#: The dialect's SQL, and the ANSI SQL where it differs (texts compare without case, nulls come first, division is of doubles).
SQL: dict[str, tuple[str, str | None]] = {
    # scans and projections
    "scan_star": ("SELECT * FROM nation", None),
    "scan_derived": ("SELECT d.k, d.n FROM (SELECT c_custkey AS k, c_name AS n FROM customer WHERE c_acctbal > 5000) AS d", None),
    "project_expr": ("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS revenue FROM lineitem WHERE l_quantity < 5", None),
    "project_alias": ("SELECT n_name nation_name, n_regionkey AS region FROM nation", None),
    "table_star": ("SELECT n.*, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey", None),
    "literals": ("SELECT n_nationkey, 7 AS i, 1.5 AS d, 'it''s' AS s, TRUE AS b FROM nation", "SELECT n_nationkey, CAST(7 AS BIGINT) AS i, CAST(1.5 AS DOUBLE) AS d, 'it''s' AS s, TRUE AS b FROM nation"),
    # filters
    "filter_cmp": ("SELECT o_orderkey FROM orders WHERE o_totalprice >= 100000 AND o_orderkey <> 7 AND o_custkey < 900", None),
    "filter_text_nocase": ("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'f'", "SELECT o_orderkey FROM orders WHERE lower(o_orderstatus) = 'f'"),
    "filter_text_order": ("SELECT p_partkey FROM part WHERE p_brand < 'BRAND#3'", "SELECT p_partkey FROM part WHERE lower(p_brand) < 'brand#3'"),
    "filter_and_or": ("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity < 3 OR l_discount > 0.09 AND l_tax < 0.01", None),
    "filter_not": ("SELECT c_custkey FROM customer WHERE NOT (c_acctbal > 0 OR c_nationkey = 3)", None),
    "filter_not_null_logic": (
        "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE NOT (l.toxic = 1 AND d.doc_id > 10)",
        "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE NOT (coalesce(l.toxic = 1, FALSE) AND d.doc_id > 10)",
    ),
    "filter_between": ("SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 50000 AND 60000.5", None),
    "filter_not_between": ("SELECT s_suppkey FROM supplier WHERE s_acctbal NOT BETWEEN 0 AND 9000", None),
    "filter_in": ("SELECT c_custkey FROM customer WHERE c_nationkey IN (1, 5, 9) AND c_mktsegment IN ('building', 'Machinery')", "SELECT c_custkey FROM customer WHERE c_nationkey IN (1, 5, 9) AND lower(c_mktsegment) IN ('building', 'machinery')"),
    "filter_not_in": ("SELECT p_partkey FROM part WHERE p_size NOT IN (1, 2, 3, NULL)", "SELECT p_partkey FROM part WHERE p_size NOT IN (1, 2, 3)"),
    "filter_is_null": ("SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NULL", None),
    "filter_is_not_null": ("SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NOT NULL", None),
    "filter_like": ("SELECT p_partkey, p_name FROM part WHERE p_name LIKE 'S%RING' OR p_brand LIKE 'brand#_'", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE 'S%RING' OR p_brand ILIKE 'brand#_'"),
    "filter_not_like": ("SELECT p_partkey FROM part WHERE p_type NOT LIKE '%e%'", "SELECT p_partkey FROM part WHERE p_type NOT ILIKE '%e%'"),
    "filter_truth": ("SELECT doc_id FROM labels WHERE toxic", "SELECT doc_id FROM labels WHERE toxic <> 0"),
    "filter_number_text": ("SELECT n_nationkey FROM nation WHERE n_nationkey > '3'", "SELECT n_nationkey FROM nation WHERE CAST(n_nationkey AS VARCHAR) > '3'"),
    "index_eq": ("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 42", None),
    # joins
    "join_inner": ("SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_acctbal > 9000", None),
    "join_left": ("SELECT d.doc_id, l.quality, l.toxic FROM documents d LEFT OUTER JOIN labels l ON d.doc_id = l.doc_id", None),
    "join_left_gap": ("SELECT o.o_orderkey FROM orders o LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey WHERE l.l_orderkey IS NULL", None),
    "join_right": ("SELECT l.quality, d.doc_id FROM labels l RIGHT JOIN documents d ON l.doc_id = d.doc_id", None),
    "join_compound": ("SELECT c.c_custkey, s.s_suppkey FROM customer c JOIN supplier s ON c.c_nationkey = s.s_nationkey AND c.c_acctbal < s.s_acctbal - 5000", None),
    "join_theta": ("SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey - 20", None),
    "join_left_theta": ("SELECT r.r_regionkey, n.n_nationkey FROM region r LEFT JOIN nation n ON n.n_nationkey < r.r_regionkey", None),
    "join_right_theta": ("SELECT n.n_nationkey, r.r_regionkey FROM nation n RIGHT JOIN region r ON n.n_nationkey < r.r_regionkey - 1", None),
    "join_cross": ("SELECT r.r_name, n.n_name FROM region r CROSS JOIN nation n", None),
    "join_chain": (
        "SELECT r.r_name, COUNT(*) AS n FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name",
        None,
    ),
    "join_self": ("SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey", None),
    "join_on_subquery": (
        "SELECT s.s_suppkey, n.n_name FROM supplier s LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey AND s.s_acctbal > (SELECT AVG(c_acctbal) FROM customer)",
        None,
    ),
    # aggregates
    "agg_global": (
        "SELECT COUNT(*) AS n, SUM(l_linenumber) AS s, MIN(l_quantity) AS lo, MAX(l_quantity) AS hi, ROUND(AVG(l_quantity), 4) AS a FROM lineitem",
        "SELECT COUNT(*) AS n, CAST(SUM(l_linenumber) AS BIGINT) AS s, MIN(l_quantity) AS lo, MAX(l_quantity) AS hi, ROUND(AVG(l_quantity), 4) AS a FROM lineitem",
    ),
    "agg_empty": (
        "SELECT COUNT(*) AS n, SUM(o_custkey) AS s, AVG(o_totalprice) AS a, MIN(o_orderstatus) AS m FROM orders WHERE o_orderkey < 0",
        "SELECT COUNT(*) AS n, CAST(SUM(o_custkey) AS BIGINT) AS s, AVG(o_totalprice) AS a, MIN(o_orderstatus) AS m FROM orders WHERE o_orderkey < 0",
    ),
    "agg_group": (
        "SELECT l_returnflag, l_linestatus, SUM(l_quantity) AS q, ROUND(AVG(l_discount), 6) AS d, COUNT(*) AS n FROM lineitem WHERE l_quantity < 40 GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus",
        None,
    ),
    "agg_null_group": ("SELECT l.quality, COUNT(*) AS n, COUNT(l.toxic) AS t FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY l.quality", None),
    "agg_expr_group": ("SELECT o_custkey % 7 AS k, COUNT(*) AS n FROM orders GROUP BY o_custkey % 7", None),
    "agg_count_distinct": ("SELECT o_orderpriority, COUNT(DISTINCT o_custkey) AS n FROM orders GROUP BY o_orderpriority", None),
    "agg_sum_distinct": ("SELECT SUM(DISTINCT p_size) AS s FROM part", "SELECT CAST(SUM(DISTINCT p_size) AS BIGINT) AS s FROM part"),
    "agg_having": ("SELECT c_nationkey, COUNT(*) AS n FROM customer GROUP BY c_nationkey HAVING COUNT(*) > 55 AND MIN(c_acctbal) < 0", None),
    "agg_expr_of_agg": ("SELECT s_nationkey, ROUND(MAX(s_acctbal) - MIN(s_acctbal), 2) AS spread FROM supplier GROUP BY s_nationkey", None),
    "agg_of_expr": (
        "SELECT l_returnflag, ROUND(SUM(l_extendedprice * l_discount), 2) AS a, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS b FROM lineitem GROUP BY l_returnflag",
        None,
    ),
    "agg_min_max_text": ("SELECT p_size, MIN(p_name) AS lo, MAX(p_type) AS hi FROM part GROUP BY p_size", None),
    # order, limit, distinct
    "sort_multi": ("SELECT n_regionkey, n_name FROM nation ORDER BY n_regionkey DESC, n_name", None),
    "sort_nulls_first": (
        "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id ORDER BY l.quality, d.doc_id LIMIT 50",
        "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id ORDER BY l.quality NULLS FIRST, d.doc_id LIMIT 50",
    ),
    "topk": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10", None),
    "limit_zero": ("SELECT o_orderkey FROM orders LIMIT 0", None),
    "sort_constant": ("SELECT c_custkey FROM customer ORDER BY 1, c_custkey DESC LIMIT 5", "SELECT c_custkey FROM customer ORDER BY c_custkey DESC LIMIT 5"),
    "distinct": ("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem", None),
    "distinct_order_hidden": (
        "SELECT DISTINCT c_nationkey FROM customer ORDER BY c_acctbal DESC LIMIT 3",
        "SELECT c_nationkey FROM customer GROUP BY c_nationkey ORDER BY MAX(c_acctbal) DESC LIMIT 3",
    ),
    # subqueries
    "subq_scalar": ("SELECT c_custkey FROM customer WHERE c_acctbal > (SELECT AVG(s_acctbal) FROM supplier)", None),
    "subq_scalar_empty": ("SELECT COUNT(*) AS n FROM customer WHERE c_custkey = (SELECT s_suppkey FROM supplier WHERE s_suppkey < 0)", None),
    "subq_first_row": ("SELECT n_name FROM nation WHERE n_regionkey = (SELECT r_regionkey FROM region ORDER BY r_name DESC)", "SELECT n_name FROM nation WHERE n_regionkey = (SELECT r_regionkey FROM region ORDER BY r_name DESC LIMIT 1)"),
    "subq_in": ("SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)", None),
    "subq_not_in": ("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)", None),
    "subq_not_in_null": (
        "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT l.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)",
        "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    ),
    "subq_in_or": ("SELECT s_suppkey FROM supplier WHERE s_acctbal > 9000 OR s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)", None),
    "subq_derived_agg": ("SELECT COUNT(*) AS n FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 150000) AS t", None),
    "subq_having": ("SELECT c_mktsegment, COUNT(*) AS n FROM customer GROUP BY c_mktsegment HAVING AVG(c_acctbal) > (SELECT AVG(c_acctbal) FROM customer)", None),
    "subq_select": ("SELECT r_name, (SELECT COUNT(*) FROM nation) AS n FROM region", None),
    # arithmetic and functions
    "arith": ("SELECT p_partkey, p_size + 1 AS a, p_size - 2 AS b, p_size * 3 AS c FROM part", "SELECT p_partkey, CAST(p_size + 1 AS BIGINT) AS a, CAST(p_size - 2 AS BIGINT) AS b, CAST(p_size * 3 AS BIGINT) AS c FROM part"),
    "div": ("SELECT p_partkey, p_size / 4 AS q FROM part", None),
    "mod": ("SELECT p_partkey, p_size % 7 AS r, (0 - p_size) % 7 AS m FROM part", "SELECT p_partkey, CAST(p_size % 7 AS BIGINT) AS r, CAST((0 - p_size) % 7 AS BIGINT) AS m FROM part"),
    "neg": ("SELECT s_suppkey, -s_acctbal AS x, -(1 + 2) * 3 AS y FROM supplier", "SELECT s_suppkey, -s_acctbal AS x, CAST(-9 AS BIGINT) AS y FROM supplier"),
    "fn_case": ("SELECT n_nationkey, UPPER(n_name) AS u, LOWER(n_name) AS l FROM nation", None),
    "fn_length": ("SELECT doc_id, LENGTH(lang) AS n, LENGTH(text) AS m FROM documents", None),
    "fn_trim": ("SELECT p_partkey, TRIM(CONCAT('  ', p_name, ' ')) AS t FROM part", "SELECT p_partkey, trim('  ' || p_name || ' ') AS t FROM part"),
    "fn_abs": ("SELECT s_suppkey, ABS(s_acctbal) AS a, ABS(0 - s_suppkey) AS b FROM supplier", "SELECT s_suppkey, abs(s_acctbal) AS a, CAST(s_suppkey AS DOUBLE) AS b FROM supplier"),
    "fn_round_large": ("SELECT o_orderkey, ROUND(o_totalprice * 100000000000000000, 2) AS r FROM orders WHERE o_totalprice > 100000", "SELECT o_orderkey, o_totalprice * CAST(100000000000000000 AS DOUBLE) AS r FROM orders WHERE o_totalprice > 100000"),
    "fn_round": (
        "SELECT o_orderkey, ROUND(o_totalprice) AS a, ROUND(o_totalprice / 7, 2) AS b, ROUND(0 - o_totalprice, 1) AS c FROM orders",
        "SELECT o_orderkey, floor(o_totalprice + 0.5) AS a, floor(o_totalprice / 7 * 100.0::DOUBLE + 0.5) / 100.0::DOUBLE AS b, -floor(o_totalprice * 10.0::DOUBLE + 0.5) / 10.0::DOUBLE AS c FROM orders",
    ),
    "fn_coalesce": (
        "SELECT d.doc_id, COALESCE(l.quality, -1) AS q, COALESCE(l.quality, d.lang) AS t FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
        "SELECT d.doc_id, CAST(coalesce(l.quality, -1) AS BIGINT) AS q, coalesce(CAST(l.quality AS VARCHAR), d.lang) AS t FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    ),
    "fn_concat": (
        "SELECT d.doc_id, CONCAT(d.lang, '-', l.quality, NULL, d.source) AS t FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
        "SELECT d.doc_id, concat(d.lang, '-', l.quality, d.source) AS t FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    ),
    "fn_substring": ("SELECT doc_id, SUBSTRING(text, 3, 20) AS s, SUBSTRING(source, 2) AS r FROM documents", "SELECT doc_id, substring(text, 3, 20) AS s, substring(source, 2) AS r FROM documents"),
    # bigger ones
    "report_revenue": (
        "SELECT n.n_name AS nation, COUNT(*) AS n, ROUND(SUM(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey WHERE l.l_returnflag = 'R' AND l.l_quantity BETWEEN 5 AND 45 GROUP BY n.n_name HAVING COUNT(*) > 1 ORDER BY revenue DESC LIMIT 10",
        None,
    ),
    "report_customers": (
        "SELECT c.c_mktsegment AS segment, COUNT(DISTINCT o.o_orderkey) AS orders, ROUND(AVG(o.o_totalprice), 2) AS mean FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey WHERE o.o_orderpriority LIKE '1%' OR c.c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 2) GROUP BY c.c_mktsegment ORDER BY mean",
        "SELECT c.c_mktsegment AS segment, COUNT(DISTINCT o.o_orderkey) AS orders, ROUND(AVG(o.o_totalprice), 2) AS mean FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey WHERE o.o_orderpriority ILIKE '1%' OR c.c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 2) GROUP BY c.c_mktsegment ORDER BY mean",
    ),
}

#: Statements to run before a last one that gives the rows, and the ANSI SQL of those rows.
SCRIPTS: dict[str, tuple[tuple[str, ...], str]] = {
    "create_insert": (
        ("CREATE TABLE t (id INTEGER, name STRING, price DOUBLE, ok BOOLEAN)", "INSERT INTO t VALUES (1, 'a', 2, TRUE), (2, 'it''s', NULL, 'no')", "INSERT INTO t (name, id) VALUES ('', '3')", "SELECT * FROM t"),
        "SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'a', CAST(2 AS DOUBLE), TRUE), (2, 'it''s', NULL, FALSE), (3, NULL, NULL, NULL)) t(id, name, price, ok)",
    ),
    "update_expr": (
        ("UPDATE supplier SET s_acctbal = s_acctbal * 2, s_nationkey = 0 - s_nationkey WHERE s_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)", "SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier"),
        "SELECT s_suppkey, CAST(CASE WHEN s_acctbal > 5000 THEN -s_nationkey ELSE s_nationkey END AS BIGINT) AS s_nationkey, CASE WHEN s_acctbal > 5000 THEN s_acctbal * 2 ELSE s_acctbal END AS s_acctbal FROM supplier",
    ),
    "update_widen": (("UPDATE part SET p_size = p_size * 1.5 WHERE p_size > 40", "SELECT p_partkey, p_size FROM part"), "SELECT p_partkey, CASE WHEN p_size > 40 THEN p_size * 1.5::DOUBLE ELSE p_size END AS p_size FROM part"),
    "delete_where": (("DELETE FROM orders WHERE o_totalprice < 100000", "SELECT o_orderkey FROM orders"), "SELECT o_orderkey FROM orders WHERE o_totalprice >= 100000"),
    "delete_all": (("DELETE FROM nation", "SELECT COUNT(*) AS n, COUNT(n_name) AS m FROM nation"), "SELECT CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS m"),
    "alter_add": (("ALTER TABLE region ADD COLUMN note STRING", "SELECT * FROM region"), "SELECT *, CAST(NULL AS VARCHAR) AS note FROM region"),
    "alter_drop": (("ALTER TABLE nation DROP COLUMN n_regionkey", "SELECT * FROM nation"), "SELECT n_nationkey, n_name FROM nation"),
    "alter_rename": (("ALTER TABLE nation RENAME COLUMN n_name TO title", "ALTER TABLE nation RENAME TO lands", "SELECT title FROM lands"), "SELECT n_name AS title FROM nation"),
    "drop_table": (("DROP TABLE region", "SELECT COUNT(*) AS n FROM nation"), "SELECT COUNT(*) AS n FROM nation"),
    "index_lifecycle": (("CREATE INDEX i ON nation(n_regionkey)", "CREATE INDEX j ON region(r_name)", "DROP INDEX j", "SHOW INDEXES"), "SELECT 'i' AS index_name, 'nation' AS table_name, 'n_regionkey' AS column_name, COUNT(DISTINCT n_regionkey) AS distinct_values FROM nation"),
    "describe": (("DESCRIBE region",), """SELECT CAST(i AS INTEGER) AS "#", n AS column_name, t AS type FROM (VALUES (1, 'r_regionkey', 'INTEGER'), (2, 'r_name', 'STRING')) v(i, n, t)"""),
}


def _sql(sql: str) -> Query:
    return lambda spark, sf_dir: engine(spark, sf_dir, used(sql)).sql(sql)


def _script(statements: tuple[str, ...]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = engine(spark, sf_dir, used(" ".join(statements)) + used(statements[-1]))
        for s in statements[:-1]:
            e.query(s)
        return e.sql(statements[-1])

    return run


def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers exported to CSV files in a folder that the cluster shares, and back with inferred types."""
    e = engine(spark, sf_dir, ("customer",))
    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    e.query(f"EXPORT (SELECT * FROM customer) TO '{path}/' FORMAT CSV")
    e.query(f"LOAD '{path}' AS back")
    return e.sql("SELECT * FROM back")


def export_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON file that the driver writes and reads again."""
    e = engine(spark, sf_dir, ("nation",))
    with tempfile.TemporaryDirectory() as folder:
        path = f"{folder}/nations.json"
        e.query(f"EXPORT (SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey) TO '{path}'")
        rows = json.loads(Path(path).read_text(encoding="utf-8"))
    return spark.createDataFrame([(r["n_nationkey"], r["n_name"]) for r in rows], "n_nationkey int, n_name string")


#: A file with a short, a long and a blank row, empty cells, and quotes, line ends and separators inside cells.
RAGGED = 'id,name,score,ok\n1,"Smith, J",2,true\n2,,"3.5"\n\n3,"two\nlines",,FALSE,more\n4,"a ""b""",7,\n'


def csv_ragged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``RAGGED`` as a table."""
    path = f"{shared_folder(spark)}/ragged-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    target = hadoop.Path(f"{path}/ragged.csv")
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target)
    out.write(bytearray(RAGGED.encode()))
    out.close()
    e = Engine(spark)
    e.query(f"LOAD '{path}' AS t")
    return e.sql("SELECT * FROM t")


def export_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One CSV file that the driver writes, line by line."""
    e = engine(spark, sf_dir, ("nation",))
    with tempfile.TemporaryDirectory() as folder:
        path = Path(f"{folder}/nations.csv")
        e.query(f"EXPORT (SELECT n_nationkey, n_name, NULL AS none, CONCAT(n_name, ',x') AS t FROM nation ORDER BY n_nationkey) TO '{path}' FORMAT CSV")
        lines = path.read_text(encoding="utf-8").splitlines()
    return spark.createDataFrame(list(enumerate(lines)), "row int, line string")


#: Statements that are errors.
ERRORS = {
    "ambiguous": "SELECT n_name FROM nation a JOIN nation b ON a.n_nationkey = b.n_nationkey",
    "function": "SELECT NOSUCH(n_name) FROM nation",
    "column": "SELECT nothing FROM nation",
    "table": "SELECT * FROM nothing",
    "load": "LOAD '/nothing/here.csv' AS t",
    "export": "EXPORT (SELECT nothing FROM nation) TO '/nothing/here.csv'",
    "rest": "SELECT n_name FROM nation LIMIT 1 1",
}


def errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each of ``ERRORS`` is refused."""
    e = engine(spark, sf_dir, ("nation",))
    rows = []
    for name, statement in ERRORS.items():
        try:
            e.query(statement)
            rows.append((name, False))
        except SqlError:
            rows.append((name, True))
    return spark.createDataFrame(rows, "name string, refused boolean")


def show_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir, ("region", "nation")).sql("SHOW TABLES").drop("source")


def queries() -> dict[str, Query]:
    found = {name: _sql(sql) for name, (sql, _) in SQL.items()} | {name: _script(s) for name, (s, _) in SCRIPTS.items()}
    return found | {"csv_roundtrip": csv_roundtrip, "csv_ragged": csv_ragged, "export_csv_lines": export_csv, "export_json_roundtrip": export_json, "errors": errors, "show_tables": show_tables}


def oracle_sql() -> dict[str, str]:
    found = {name: ansi or sql for name, (sql, ansi) in SQL.items()} | {name: ansi for name, (_, ansi) in SCRIPTS.items()}
    return found | {
        "csv_roundtrip": "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer",
        "csv_ragged": "SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'Smith, J', CAST(2 AS DOUBLE), TRUE), (2, NULL, 3.5, NULL), (3, 'two' || chr(10) || 'lines', NULL, FALSE), (4, 'a \"b\"', 7, NULL)) t(id, name, score, ok)",
        "export_csv_lines": "SELECT 0 AS row, 'n_nationkey,n_name,none,t' AS line UNION ALL SELECT n_nationkey + 1, n_nationkey || ',' || n_name || ',,\"' || n_name || ',x\"' FROM nation",
        "errors": "SELECT name, TRUE AS refused FROM (VALUES " + ", ".join(f"('{x}')" for x in ERRORS) + ") t(name)",
        "export_json_roundtrip": "SELECT n_nationkey, n_name FROM nation",
        "show_tables": "SELECT 'region' AS table_name, COUNT(*) AS rows, CAST(2 AS INTEGER) AS columns FROM region UNION ALL SELECT 'nation', COUNT(*), CAST(3 AS INTEGER) FROM nation",
    }
