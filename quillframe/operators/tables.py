"""Statements that make, change and describe tables. Every change is a new DataFrame version of the table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillframe.functions import values as v
from quillframe.operators.expressions import Lowering
from quillframe.operators.scope import Scope, fresh
from quillframe.operators.select import Planner
from quillframe.plans import tree as t
from quillframe.plans.catalog import Catalog, Table
from quillframe.plans.lexer import SqlError

SPARK_TYPES = {v.INT: T.LongType(), v.DOUBLE: T.DoubleType(), v.BOOL: T.BooleanType(), v.TEXT: T.StringType()}


def title(dtype: T.DataType) -> str:
    return v.TITLES.get(v.kind_of(dtype), dtype.simpleString().upper())


def create(catalog: Catalog, s: t.CreateTable) -> str:
    names = [n.lower() for n, _ in s.columns]
    if len(set(names)) < len(names):
        raise SqlError("a column is named twice")
    schema = T.StructType([T.StructField(n, SPARK_TYPES[v.DECLARED[k]]) for n, k in s.columns])
    catalog.put(s.name, catalog.spark.createDataFrame([], schema))
    return f"Table '{s.name}' created."


def _constant(x, dtype: T.DataType, column: str):
    """A given value as one of the column's type; empty text is null, decimals are cut for whole numbers."""
    if x is None or x == "":
        return None
    kind = v.kind_of(dtype)
    try:
        if kind == v.INT:
            return int(float(x)) if isinstance(x, str) and not x.lstrip("+-").isdigit() else int(x)
        if kind == v.DOUBLE:
            return float(x)
        if kind == v.BOOL:
            return x if isinstance(x, bool) else str(x).lower() in ("true", "1", "yes")
    except ValueError:
        raise SqlError(f"{x!r} is no value for column {column}") from None
    if kind == v.TEXT:
        return ("true" if x else "false") if isinstance(x, bool) else str(x)
    raise SqlError(f"cannot insert into column {column} of type {dtype.simpleString()}")


def insert(catalog: Catalog, s: t.Insert) -> str:
    table = catalog.get(s.table)
    columns = [table.column(c) for c in s.columns] if s.columns else table.df.columns
    if len(set(columns)) < len(columns):
        raise SqlError("a column is named twice")
    # whole and floating numbers of any width are given as long and double, then cast
    fields = {f.name: f for f in table.df.schema.fields}
    rows = []
    for row in s.rows:
        if len(row) != len(columns):
            raise SqlError(f"{len(columns)} values are needed, {len(row)} are given")
        given = {c: _constant(x, fields[c].dataType, c) for c, x in zip(columns, row)}
        rows.append(tuple(given.get(c) for c in fields))
    schema = T.StructType([T.StructField(f.name, SPARK_TYPES.get(v.kind_of(f.dataType), f.dataType)) for f in fields.values()])
    new = catalog.spark.createDataFrame(rows, schema)
    new = new.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in fields.values()])
    catalog.replace(table, table.df.union(new))
    return f"{len(rows)} row(s) inserted into '{table.name}'."


def _matching(catalog: Catalog, table: Table, where: t.Expr | None, nocase: bool, more: list[t.Expr]) -> tuple[Scope, object, list[v.Value]]:
    """The table's scope, the column of its filter and the values of other expressions, with their helper columns in place."""
    scope = Scope.of_table(table.df, table.name)
    low = Lowering(scope, Planner(catalog, nocase).run, nocase)
    hit = F.coalesce(v.as_truth(low.value(where)), F.lit(False)) if where is not None else F.lit(True)
    return scope, hit, [low.value(e) for e in more]


def delete(catalog: Catalog, s: t.Delete, nocase: bool) -> str:
    table = catalog.get(s.table)
    scope, hit, _ = _matching(catalog, table, s.where, nocase, [])
    n = scope.df.where(hit).count()
    if s.where is None:
        left = catalog.spark.createDataFrame([], table.df.schema)
    else:
        left = scope.df.where(~hit).select(*[f.value.col.alias(f.name) for f in scope.fields])
    catalog.replace(table, left)
    return f"{n} row(s) deleted from '{table.name}'."


def update(catalog: Catalog, s: t.Update, nocase: bool) -> str:
    """All right sides see the row as it was. A whole-number column becomes double where a double is set."""
    table = catalog.get(s.table)
    targets = [table.column(c) for c, _ in s.sets]
    if len(set(targets)) < len(targets):
        raise SqlError("a column is set twice")
    scope, hit, new = _matching(catalog, table, s.where, nocase, [e for _, e in s.sets])
    flag = fresh("u")
    df = scope.df.withColumn(flag, hit)
    sets = dict(zip(targets, new))
    out = []
    for f in scope.fields:
        x = sets.get(f.name)
        if x is None:
            out.append(f.value.col.alias(f.name))
            continue
        kind = _set_kind(f.name, f.kind, x.kind)
        old, value = f.value.col, x.col
        if kind != v.OTHER:
            old, value = old.cast(v.TYPES[kind]), v.as_text(x) if kind == v.TEXT else value.cast(v.TYPES[kind])
        out.append(F.when(F.col(flag), value).otherwise(old).alias(f.name))
    n = df.where(F.col(flag)).count()
    catalog.replace(table, df.select(*out))
    return f"{n} row(s) updated in '{table.name}'."


def _set_kind(column: str, old: str, new: str) -> str:
    if new in (v.NULL, old) or old == v.TEXT:
        return old
    if {old, new} <= set(v.NUMBERS):
        return v.DOUBLE
    raise SqlError(f"column {column} is {v.TITLES.get(old, old)}, not {v.TITLES.get(new, new)}")


def alter(catalog: Catalog, s: t.Alter) -> str:
    if s.action == "move":
        old = catalog.get(s.table).name
        catalog.rename(s.table, s.other)
        return f"Table '{old}' renamed to '{s.other}'."
    table = catalog.get(s.table)
    names = [c.lower() for c in table.df.columns]
    if s.action == "add":
        if s.column.lower() in names:
            raise SqlError(f"column {s.column} exists in table {table.name}")
        catalog.replace(table, table.df.withColumn(s.column, F.lit(None).cast(SPARK_TYPES[v.DECLARED[s.other]])))
        return f"Column '{s.column}' added to '{table.name}'."
    column = table.column(s.column)
    if s.action == "drop":
        if len(names) == 1:
            raise SqlError(f"column {column} is the last of table {table.name}")
        catalog.replace(table, table.df.drop(F.col(f"`{column}`")))
        catalog.indexes = {k: x for k, x in catalog.indexes.items() if (x.table.lower(), x.column.lower()) != (table.name.lower(), column.lower())}
        return f"Column '{column}' dropped from '{table.name}'."
    if s.other.lower() in names and s.other.lower() != column.lower():
        raise SqlError(f"column {s.other} exists in table {table.name}")
    catalog.replace(table, table.df.withColumnRenamed(column, s.other))
    for k, x in list(catalog.indexes.items()):
        if (x.table.lower(), x.column.lower()) == (table.name.lower(), column.lower()):
            catalog.indexes[k] = type(x)(x.name, x.table, s.other)
    return f"Column '{column}' renamed to '{s.other}'."


def show_tables(catalog: Catalog) -> DataFrame:
    rows = [(x.name, x.df.count(), len(x.df.columns), x.source) for x in catalog.tables.values()]
    return catalog.spark.createDataFrame(rows, "table_name string, rows long, columns int, source string")


def show_indexes(catalog: Catalog) -> DataFrame:
    """Indexes are names for columns; what they would speed up, the file format's statistics and pruning do."""
    rows = []
    for x in catalog.indexes.values():
        n = catalog.get(x.table).df.select(F.count_distinct(F.col(f"`{x.column}`"))).first()[0]
        rows.append((x.name, x.table, x.column, n))
    return catalog.spark.createDataFrame(rows, "index_name string, table_name string, column_name string, distinct_values long")


def describe(catalog: Catalog, name: str) -> DataFrame:
    rows = [(i, f.name, title(f.dataType)) for i, f in enumerate(catalog.get(name).df.schema.fields, 1)]
    return catalog.spark.createDataFrame(rows, "`#` int, column_name string, type string")
