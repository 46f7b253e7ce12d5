"""Compound joins whose pairs are dealt to many tasks."""

from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quillframe import Engine
from quillframe.operators import spread


def test_pairs_of_few_keys_are_dealt_to_many_tasks(spark, tmp_path):
    e = Engine(spark)
    for name, n, step in (("l", 75_000, 7919), ("r", 25_000, 6007)):
        rows = spark.range(n, numPartitions=1).select("id", (F.col("id") % 5).cast("int").alias("k"), (F.col("id") * step % n / n).alias("x"))
        rows.write.parquet(f"{tmp_path}/{name}")
        e.register(name, spark.read.parquet(f"{tmp_path}/{name}"))
    df = e.sql("SELECT l.id AS a, r.id AS b FROM l JOIN r ON l.k = r.k AND l.x < r.x - 0.99")
    found = [tuple(x) for x in df.select("a", "b", F.spark_partition_id()).collect()]
    l, r = ([(i, i % 5, i * step % n / n) for i in range(n)] for n, step in ((75_000, 7919), (25_000, 6007)))
    low, high = [x for x in l if x[2] < 0.01], [x for x in r if x[2] > 0.99]
    assert sorted(x[:2] for x in found) == sorted((i, j) for i, k, x in low for j, m, y in high if k == m and x < y - 0.99)
    at = Counter(x[2] for x in found)
    assert max(at.values()) < 0.6 * len(found)


LEFT = [(i, i % 3 if i % 10 else None, float(i * 37 % 101) if i % 7 else None, f"t{i % 4}") for i in range(200)] + [(7, 1, 5.0, "t")] * 30
RIGHT = [(i, i % 4 if i % 9 else None, float(i * 53 % 97) if i % 8 else None, f"T{i % 4}") for i in range(120)] + [(8, 1, 9.0, "u")] * 25
TO = {"int": int, "bigint": int, "double": float, "decimal(5, 0)": Decimal, "string": str}
#: Types of the keys, pairs of a cell, rows of a block, the fan-out, a condition.
JOINS = [
    ("int", "int", 100, 8, 64, "r.k = l.k AND l.x + r.x > 90 AND l.id > 3"),
    ("int", "bigint", 1, 1, 64, "l.k = r.k AND l.id = r.id AND l.x < r.x"),
    ("int", "double", 10**6, 8, 0, "l.k = r.k AND l.x < r.x"),
    ("int", "decimal(5, 0)", 100, 8, 64, "l.k = r.k AND l.x < r.x"),
    ("string", "string", 1500, 10**6, 64, "l.k = r.k AND l.x < r.x - (SELECT MIN(x) FROM r) AND l.id IN (SELECT id FROM r)"),
]


@pytest.mark.parametrize("left, right, pairs, block, fan_out, on", JOINS)
def test_dealt_joins_keep_their_rows(spark, monkeypatch, left, right, pairs, block, fan_out, on):
    e = Engine(spark)
    for name, rows, kind in (("l", LEFT, left), ("r", RIGHT, right)):
        e.register(name, spark.createDataFrame([(i, None if k is None else TO[kind](k), x, t) for i, k, x, t in rows], f"id int, k {kind}, x double, t string"))
    monkeypatch.setattr(spread, "PAIRS", pairs)
    monkeypatch.setattr(spread, "BLOCK", block)
    monkeypatch.setattr(spread, "FAN_OUT", fan_out)
    monkeypatch.setattr(spread, "COPIES", 800)
    for join in ("JOIN", "LEFT JOIN", "RIGHT JOIN"):
        found = []
        for small in (1 << 200, 0):
            monkeypatch.setattr(spread, "SMALL", small)
            found.append(Counter(tuple(x) for x in e.sql(f"SELECT l.id AS a, l.k AS k, r.id AS b, r.t AS t FROM l {join} r ON {on}").collect()))
        assert found[0] == found[1], join


@pytest.mark.parametrize("n, m", [(1, 10**9), (10**9, 1), (10**6, 10**6), (216_000, 14_400), (9_000, 9_000), (8_193, 8_192)])
def test_cells_hold_a_bounded_number_of_pairs(n, m):
    a, b = spread.blocks(n, m, "inner")
    assert -(-n // a) * -(-m // b) <= 1.01 * spread.PAIRS
    assert a * b <= 4 * n * m / spread.PAIRS + 2
    assert spread.blocks(n, m, "left")[1] == 1 and spread.blocks(n, m, "right")[0] == 1
