"""Joins on equal columns and a further condition: where few keys have most rows, their pairs are dealt to many tasks.

Spark deals an equi-join's rows by key and sizes its tasks by bytes read. A few
keys shared by all rows make pairs with the product of the tables, which then
meet in one or a few tasks. Here the rows of such a key are cut into blocks on
both sides, each pair of blocks is a cell, and key and cell are joined on.
Every pair of rows meets in exactly one cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillframe.operators.scope import fresh

#: Pairs of one key that a cell holds at most, but for uneven hashes.
PAIRS = 1 << 26
#: Rows of a block where both sides have more.
BLOCK = 1 << 13
#: Pairs for each row from which a join without such a key is dealt, too.
FAN_OUT = 64
#: Copies of rows that are made where the rows are, and in each of more tasks otherwise a quarter of it.
COPIES = 1 << 22
#: Tables of which the sizes in bytes have a smaller product are not counted.
SMALL = 1 << 33
#: Partitions at most.
TASKS = 20_000


def spread(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], kind: str) -> tuple[DataFrame, DataFrame, Column] | None:
    """Both sides with cells, and the condition on keys and cells; None where the join is best left as it is.

    Rows are counted by key at once, for which a job runs. The side that an
    outer join keeps whole is dealt and never copied, so that each of its rows
    is in one cell. Rows are dealt by the hash of their columns, which a retried
    task finds again; rows that are alike in all of them stay together.
    """
    if _bytes(left) * _bytes(right) < SMALL:
        return None
    typed = _common(left, right, keys)
    if typed is None:
        return None
    left, right, keys = typed
    names = [f"k{i}" for i in range(len(keys))]
    n, m = _counts(left, [a for a, _ in keys], names, "n"), _counts(right, [b for _, b in keys], names, "m")
    counted = n.join(m, names).withColumn("pairs", F.col("n").cast("double") * F.col("m"))
    many = F.when(F.col("pairs") > PAIRS, F.struct(*names, "n", "m", "pairs"))
    found = counted.agg(F.coalesce(F.sum("pairs"), F.lit(0.0)), F.coalesce(F.sum(F.col("n") + F.col("m")), F.lit(0)), F.collect_list(many)).first()
    pairs, rows, heavy = found
    if not heavy and pairs <= max(PAIRS, FAN_OUT * rows):
        return None
    cut = [(*(r[k] for k in names), *blocks(r["n"], r["m"], kind)) for r in heavy]
    light = pairs - sum(r["pairs"] for r in heavy)
    wanted = sum(x[-1] * x[-2] for x in cut) + int(light // PAIRS)
    tasks = min(TASKS, max(wanted, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    schema = T.StructType([T.StructField(k, left.schema[a].dataType) for k, (a, _) in zip(names, keys)] + [T.StructField(x, T.LongType()) for x in ("a", "b")])
    table = left.sparkSession.createDataFrame(cut, schema)
    x, y = fresh("x"), fresh("x")
    copied = [sum(r[rows] * k[at] for r, k in zip(heavy, cut)) if any(k[at] > 1 for k in cut) else 0 for rows, at in (("n", -1), ("m", -2))]
    left = _dealt(left, [a for a, _ in keys], names, table, x, True, copied[0], tasks)
    right = _dealt(right, [b for _, b in keys], names, table, y, False, copied[1], tasks)
    on = F.col(x) == F.col(y)
    for a, b in keys:
        on = (F.col(a) == F.col(b)) & on
    # the copies are not in Spark's estimate of the size, so it is not asked whether to broadcast them
    return left, right.hint("merge"), on


def blocks(n: int, m: int, kind: str) -> tuple[int, int]:
    """Into how many blocks the ``n`` rows of a key on the left and the ``m`` on the right are cut."""
    up = lambda x, y: -(-x // y)
    if kind == "left":
        return min(up(n * m, PAIRS), up(n, BLOCK)), 1
    if kind == "right":
        return 1, min(up(n * m, PAIRS), up(m, BLOCK))
    rows = min(m, max(BLOCK, up(PAIRS, n)))
    return up(n * rows, PAIRS), up(m, rows)


def _bytes(df: DataFrame) -> int:
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def _common(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]]) -> tuple[DataFrame, DataFrame, list[tuple[str, str]]] | None:
    """Keys of one type on both sides, else rows would be dealt again for the join; None for types that have none here."""
    whole, binary = (T.ByteType, T.ShortType, T.IntegerType, T.LongType), (T.FloatType, T.DoubleType)
    out = []
    for a, b in keys:
        s, t = left.schema[a].dataType, right.schema[b].dataType
        if s != t:
            if not isinstance(s, whole + binary) or not isinstance(t, whole + binary):
                return None
            kind = "double" if isinstance(s, binary) or isinstance(t, binary) else "bigint"
            x, y = fresh("k"), fresh("k")
            left, right = left.withColumn(x, F.col(a).cast(kind)), right.withColumn(y, F.col(b).cast(kind))
            a, b = x, y
        out.append((a, b))
    return left, right, out


def _counts(df: DataFrame, keys: list[str], names: list[str], count: str) -> DataFrame:
    return df.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names)]).agg(F.count(F.lit(1)).alias(count))


def _dealt(df: DataFrame, keys: list[str], names: list[str], table: DataFrame, cell: str, first: bool, copied: int, tasks: int) -> DataFrame:
    """Each row in the cells of its block, ``tasks`` partitions by key and cell. Rows with many copies are dealt out before, too, as they may come from one file."""
    hashed = _hashed(df, keys)
    if copied > COPIES:
        df = df.repartition(min(TASKS, 4 * copied // COPIES), *hashed)
    mine, a, b = [fresh("k") for _ in names], fresh("a"), fresh("b")
    table = table.select(*[F.col(n).alias(k) for n, k in zip(names, mine)], F.col("a").alias(a), F.col("b").alias(b))
    same = [F.col(k) == F.col(x) for k, x in zip(keys, mine)]
    own, other = (a, b) if first else (b, a)
    block = F.pmod(F.xxhash64(*hashed), F.coalesce(F.col(own), F.lit(1)))
    copies = F.sequence(F.lit(0).cast("bigint"), F.coalesce(F.col(other), F.lit(1)) - 1)
    cells = F.transform(copies, (lambda j: block * F.coalesce(F.col(b), F.lit(1)) + j) if first else (lambda i: i * F.coalesce(F.col(b), F.lit(1)) + block))
    out = df.join(F.broadcast(table), same, "left").select(*df.columns, F.explode(cells).alias(cell))
    return out.repartition(tasks, *keys, cell)


def _hashed(df: DataFrame, keys: list[str]) -> list[str]:
    """The columns by whose hash rows are dealt: those of fixed width, or all that have a hash if there are none but the keys."""
    wide = (T.StringType, T.CharType, T.VarcharType, T.BinaryType, T.NullType)
    fixed = [f.name for f in df.schema.fields if isinstance(f.dataType, T.AtomicType) and not isinstance(f.dataType, wide + (T.VariantType,)) and f.name not in keys]
    return fixed or [f.name for f in df.schema.fields if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]
