"""Expressions of the dialect to Spark columns."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.functions import values as v
from quillframe.functions.scalar import AGGREGATES, scalar
from quillframe.operators.scope import Scope, fresh
from quillframe.plans import tree as t
from quillframe.plans.lexer import SqlError

#: Runs a subquery: its DataFrame and the kinds of its columns, in order.
Runner = Callable[[t.Select], tuple[DataFrame, list[str]]]


def _has_null_test(x: v.Value) -> bool:
    return not x.literal or x.kind == v.NULL


class Lowering:
    """Lowers expressions in one scope. ``made`` holds values that stand for whole expressions (group keys, aggregates)."""

    def __init__(self, scope: Scope, run: Runner, nocase: bool = True, made: dict[t.Expr, v.Value] | None = None, aliases: dict[str, t.Expr] | None = None):
        self.scope, self.run, self.nocase = scope, run, nocase
        self.made = made
        self.aliases = aliases or {}

    def value(self, e: t.Expr) -> v.Value:
        if self.made is not None and (found := self.made.get(self.canonical(e))) is not None:
            return found
        match e:
            case t.Literal(x):
                return v.constant(x)
            case t.Name():
                if not self.scope.has(e) and e.table is None and e.column.lower() in self.aliases:
                    return self.value(self.aliases[e.column.lower()])
                found = self.scope.find(e)
                if self.made is not None:
                    raise SqlError(f"column {t.show(e)} must be in GROUP BY or in an aggregate")
                return found.value
            case t.Unary("not", x):
                return v.Value(~v.as_truth(self.value(x)), v.BOOL)
            case t.Unary(_, x):
                inner = v.as_number(self.value(x))
                return replace(inner, col=-inner.col, constant=None if inner.constant is None else -inner.constant)
            case t.Binary("and" | "or" as op, a, b):
                a, b = v.certain(self.value(a)), v.certain(self.value(b))
                return v.Value(a & b if op == "and" else a | b, v.BOOL)
            case t.Binary("=" | "<>" | "<" | ">" | "<=" | ">=" as op, a, b):
                return v.compare(op, self.value(a), self.value(b), self.nocase)
            case t.Binary(op, a, b):
                return v.arithmetic(op, self.value(a), self.value(b))
            case t.Between():
                return self.between(e)
            case t.InList():
                return self.in_list(e)
            case t.InQuery():
                return self.in_query(e)
            case t.IsNull(x, negated):
                x = self.value(x).col
                return v.Value(x.isNotNull() if negated else x.isNull(), v.BOOL)
            case t.Like():
                return self.like(e)
            case t.Subquery(query):
                return self.subquery(query)
            case t.Call(name) if name in AGGREGATES:
                raise SqlError(f"{t.show(e)} is not allowed here")
            case t.Call(name, args):
                return scalar(name, [self.value(a) for a in args])
            case t.Star():
                raise SqlError("* is not allowed here")
        raise SqlError(f"cannot read {e}")

    def condition(self, e: t.Expr) -> Column:
        """A filter: in its outermost AND and OR null and false are the same, so that they stay as they are and can be pushed down."""
        if isinstance(e, t.Binary) and e.op in ("and", "or") and not (self.made and self.canonical(e) in self.made):
            a, b = self.condition(e.left), self.condition(e.right)
            return a & b if e.op == "and" else a | b
        found = v.as_truth(self.value(e))
        bounds = self.bounds(e) if self.nocase and self.made is None else None
        return found if bounds is None else bounds & found

    def bounds(self, e: t.Expr) -> Column | None:
        """A range that a text column lies in where the filter holds: unlike its folded form, the column itself is compared in the files."""
        match e:
            case t.Binary("=", t.Name() as name, t.Literal(str() as text)) | t.Binary("=", t.Literal(str() as text), t.Name() as name):
                texts, prefix = [text], False
            case t.InList(t.Name() as name, items, False) if items and all(isinstance(x, t.Literal) and isinstance(x.value, str) for x in items):
                texts, prefix = [x.value for x in items], False
            case t.Like(t.Name() as name, t.Literal(str() as pattern), False):
                texts, prefix = [re.split("[%_]", pattern)[0]], True
            case _:
                return None
        x = self.value(name)
        return v.case_range(x.col, texts, prefix) if x.kind == v.TEXT else None

    def between(self, e: t.Between) -> v.Value:
        x, low, high = (self.value(y) for y in (e.x, e.low, e.high))
        inside = v.compare(">=", x, low, self.nocase).col & v.compare("<=", x, high, self.nocase).col
        if any(_has_null_test(y) for y in (low, high)):
            # a null on any side makes the whole null
            inside = F.when(x.col.isNotNull() & low.col.isNotNull() & high.col.isNotNull(), inside)
        return v.Value(~inside if e.negated else inside, v.BOOL)

    def in_list(self, e: t.InList) -> v.Value:
        """Null members are passed over; only a null on the left makes the result null."""
        x = self.value(e.x)
        members = [m for m in map(self.value, e.items) if m.kind != v.NULL]
        plain = [m.constant for m in members]
        kinds = {m.kind for m in members}
        if members and None not in plain and (kinds <= set(v.NUMBERS) and x.kind in v.NUMBERS or kinds == {v.TEXT} and x.kind == v.TEXT):
            found = v.folded(x, self.nocase).isin([p.lower() if self.nocase and isinstance(p, str) else p for p in plain])
        else:
            found = F.lit(False)
            for m in members:
                same = v.compare("=", x, m, self.nocase).col
                found = found | (same if m.literal else F.coalesce(same, F.lit(False)))
            found = F.when(x.col.isNotNull(), found)
        return v.Value(~found if e.negated else found, v.BOOL)

    def keys(self, x: v.Value, query: t.Select) -> tuple[Column, DataFrame, str]:
        """The left side in comparable form, and the different non-null values of the subquery."""
        df, kinds = self.run(query)
        if len(kinds) != 1:
            raise SqlError("a subquery after IN has one column")
        key = fresh("k")
        left, right = v.alike(x, v.Value(F.col(df.columns[0]), kinds[0]), self.nocase)
        return left, df.select(right.alias(key)).where(F.col(key).isNotNull()).distinct(), key

    def in_query(self, e: t.InQuery) -> v.Value:
        x = self.value(e.x)
        left, keys, key = self.keys(x, e.query)
        flag = fresh("f")
        marked = keys.withColumn(flag, F.lit(True))
        self.scope.attach(self.ids(e.x), lambda df: df.join(marked, left == F.col(key), "left").drop(key))
        found = F.when(x.col.isNotNull(), F.coalesce(F.col(flag), F.lit(False)))
        return v.Value(~found if e.negated else found, v.BOOL)

    def semi(self, e: t.InQuery, df: DataFrame) -> DataFrame:
        """Keeps the rows for which an IN at the top of a filter holds."""
        x = self.value(e.x)
        left, keys, key = self.keys(x, e.query)
        if e.negated:
            return df.where(x.col.isNotNull()).join(keys, left == F.col(key), "left_anti")
        return df.join(keys, left == F.col(key), "left_semi")

    def subquery(self, query: t.Select) -> v.Value:
        """The first value of the subquery's first row; null without rows."""
        df, kinds = self.run(query)
        if len(kinds) != 1:
            raise SqlError("a subquery in an expression has one column")
        name = fresh("q")
        self.scope.attach(set(), lambda outer: outer.withColumn(name, df.limit(1).scalar()))
        return v.Value(F.col(name), kinds[0])

    def like(self, e: t.Like) -> v.Value:
        """% and _ are wild, a backslash is itself, case does not matter."""
        x, pattern = self.value(e.x), self.value(e.pattern)
        if isinstance(pattern.constant, str):
            found = v.as_text(x).ilike(pattern.constant.replace("\\", "\\\\"))
        else:
            found = F.ilike(v.as_text(x), F.replace(v.as_text(pattern), F.lit("\\"), F.lit("\\\\")))
        return v.Value(~found if e.negated else found, v.BOOL)

    def ids(self, e: t.Expr) -> set[str]:
        """The columns that an expression reads."""
        own = {self.scope.find(e).id} if isinstance(e, t.Name) else set()
        return own.union(*[self.ids(c) for c in t.children(e)])

    def canonical(self, e: t.Expr) -> t.Expr:
        """The expression with its names resolved, so that ``x`` and ``t.x`` are the same."""
        return canonical(e, self.scope)


def canonical(e: t.Expr, scope: Scope) -> t.Expr:
    go = lambda x: canonical(x, scope)
    match e:
        case t.Name() if scope.has(e):
            return t.Name(scope.find(e).id, "#")
        case t.Unary(op, x):
            return t.Unary(op, go(x))
        case t.Binary(op, a, b):
            return t.Binary(op, go(a), go(b))
        case t.Between(x, lo, hi, n):
            return t.Between(go(x), go(lo), go(hi), n)
        case t.InList(x, items, n):
            return t.InList(go(x), tuple(map(go, items)), n)
        case t.InQuery(x, q, n):
            return t.InQuery(go(x), q, n)
        case t.IsNull(x, n):
            return t.IsNull(go(x), n)
        case t.Like(x, p, n):
            return t.Like(go(x), go(p), n)
        case t.Call(name, args, d):
            return t.Call(name, tuple(map(go, args)), d)
    return e
