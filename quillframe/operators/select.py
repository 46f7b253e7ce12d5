"""SELECT to a DataFrame: source, joins, filter, groups, output, order, limit."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillframe.functions import values as v
from quillframe.functions.scalar import AGGREGATES, aggregate
from quillframe.operators.expressions import Lowering, canonical
from quillframe.operators.scope import Field, JoinScope, Scope, fresh
from quillframe.operators.spread import spread
from quillframe.plans import tree as t
from quillframe.plans.catalog import Catalog
from quillframe.plans.lexer import SqlError


@dataclass(frozen=True)
class Output:
    name: str
    value: v.Value


@dataclass
class Planned:
    """A query's DataFrame, with unique column names, and the names and kinds of its columns."""

    df: DataFrame
    names: list[str]
    kinds: list[str]

    def named(self) -> DataFrame:
        return self.df.toDF(*self.names)


def conjuncts(e: t.Expr) -> list[t.Expr]:
    if isinstance(e, t.Binary) and e.op == "and":
        return conjuncts(e.left) + conjuncts(e.right)
    return [e]


def calls(e: t.Expr) -> list[t.Call]:
    """The aggregates of an expression."""
    if isinstance(e, t.Call) and e.name in AGGREGATES:
        return [e]
    return [c for x in t.children(e) for c in calls(x)]


class Planner:
    def __init__(self, catalog: Catalog, nocase: bool = True):
        self.catalog, self.nocase = catalog, nocase

    def plan(self, q: t.Select) -> Planned:
        scope = self.source(q.source)
        for join in q.joins:
            scope = self.join(scope, join)
        if q.where is not None:
            self.filter(scope, Lowering(scope, self.run, self.nocase), q.where)
        aliases = {i.alias.lower(): i.expr for i in q.items if i.alias}
        grouped = q.group or q.having is not None or any(calls(x) for x in [*(i.expr for i in q.items), *(o.expr for o in q.order)])
        low = self.group(q, scope, aliases) if grouped else Lowering(scope, self.run, self.nocase)
        if q.having is not None:
            low.aliases = aliases
            self.filter(low.scope, low, q.having)
            low.aliases = {}
        outputs = [o for item in q.items for o in self.outputs(item, low)]
        return self.finish(q, low, outputs)

    def run(self, q: t.Select) -> tuple[DataFrame, list[str]]:
        done = self.plan(q)
        return done.df, done.kinds

    def source(self, ref: t.TableRef | t.Derived) -> Scope:
        if isinstance(ref, t.TableRef):
            return Scope.of_table(self.catalog.get(ref.name).df, ref.alias)
        done = self.plan(ref.query)
        return Scope(done.df, [Field(n, ref.alias, c, k) for n, c, k in zip(done.names, done.df.columns, done.kinds)])

    def join(self, left: Scope, join: t.Join) -> Scope:
        right = self.source(join.right)
        taken = {(f.table or "").lower() for f in left.fields}
        if {(f.table or "").lower() for f in right.fields} & taken:
            raise SqlError(f"table name {join.right.alias} is used twice")
        both = JoinScope(left, right)
        if join.kind == "cross":
            return Scope(left.df.crossJoin(right.df), both.fields)
        on = Lowering(both, self.run, self.nocase)
        keys, equal, rest, compares = [], [], [], False
        sides = [{f.id for f in side.fields} for side in (left, right)]
        for part in conjuncts(join.on):
            key, ids = self.join_key(on, part), on.ids(part)
            across = all(ids & side for side in sides)
            if key is not None and across:
                keys.append(tuple(next(iter(ids & side)) for side in sides))
                equal.append(key)
            else:
                rest.append(on.condition(part) if key is None else key)
                compares = compares or across
        dealt = spread(left.df, right.df, keys, join.kind) if keys and compares else None
        if dealt is None:
            df = left.df.join(right.df, reduce(and_, equal + rest), join.kind)
        else:
            df = dealt[0].join(dealt[1], reduce(and_, rest, dealt[2]), join.kind)
        return Scope(df.select(*[f.id for f in both.fields]), both.fields)

    def join_key(self, on: Lowering, part: t.Expr) -> Column | None:
        """``column = column`` joins on the columns as they are, with regard to case, so that it stays an equi-join; None for other conditions."""
        if isinstance(part, t.Binary) and part.op == "=" and isinstance(part.left, t.Name) and isinstance(part.right, t.Name):
            a, b = on.value(part.left), on.value(part.right)
            if a.kind == b.kind or a.kind in v.NUMBERS and b.kind in v.NUMBERS:
                return a.col == b.col
        return None

    def filter(self, scope: Scope, low: Lowering, where: t.Expr) -> None:
        plain = []
        for part in conjuncts(where):
            if isinstance(part, t.InQuery):
                scope.df = low.semi(part, scope.df)
            else:
                plain.append(low.condition(part))
        for c in plain:
            scope.df = scope.df.where(c)

    def group(self, q: t.Select, scope: Scope, aliases: dict[str, t.Expr]) -> Lowering:
        """Groups and aggregates; the result's lowering knows both by the expressions they stand for."""
        low = Lowering(scope, self.run, self.nocase, aliases=aliases)
        keys, fields, made = [], [], {}
        for e in q.group:
            if isinstance(e, t.Name) and not scope.has(e) and e.table is None and e.column.lower() in aliases:
                e = aliases[e.column.lower()]
            if calls(e):
                raise SqlError("aggregates are not allowed in GROUP BY")
            x, name = low.value(e), fresh("g")
            keys.append(x.col.alias(name))
            made[canonical(e, scope)] = v.Value(F.col(name), x.kind)
            if isinstance(e, t.Name):
                f = scope.find(e)
                fields.append(Field(f.name, f.table, name, x.kind))
        wanted = [e for i in q.items for e in calls(i.expr)] + [e for o in q.order for e in calls(o.expr)]
        if q.having is not None:
            wanted += calls(q.having)
            for x in self.names_in(q.having):
                wanted += calls(aliases.get(x, t.Literal(None)))
        low.aliases = {}
        aggregates = []
        for call in wanted:
            key = canonical(call, scope)
            if key in made:
                continue
            if len(call.args) > 1 or any(calls(a) for a in call.args):
                raise SqlError(f"cannot read {t.show(call)}")
            rows = not call.args or isinstance(call.args[0], t.Star)
            if rows and (call.name != "count" or call.distinct):
                raise SqlError(f"{t.show(call)} needs a column")
            x, name = aggregate(call.name, None if rows else low.value(call.args[0]), call.distinct, self.nocase), fresh("a")
            aggregates.append(x.col.alias(name))
            made[key] = v.Value(F.col(name), x.kind)
        if aggregates:
            df = scope.df.groupBy(*keys).agg(*aggregates)
        else:
            df = scope.df.select(*keys).distinct() if keys else scope.df.agg(F.lit(1).alias(fresh("a")))
        after = _Grouped(df, scope)
        return Lowering(after, self.run, self.nocase, made)

    def names_in(self, e: t.Expr) -> set[str]:
        own = {e.column.lower()} if isinstance(e, t.Name) and e.table is None else set()
        return own.union(*[self.names_in(c) for c in t.children(e)])

    def outputs(self, item: t.Item, low: Lowering) -> list[Output]:
        if isinstance(item.expr, t.Star):
            if low.made is not None:
                raise SqlError("* is not allowed with groups")
            return [Output(f.name, f.value) for f in low.scope.of(item.expr.table)]
        value = low.value(item.expr)
        return [Output(item.alias or (item.expr.column if isinstance(item.expr, t.Name) else t.show(item.expr)), value)]

    def finish(self, q: t.Select, low: Lowering, outputs: list[Output]) -> Planned:
        ids = [fresh("o") for _ in outputs]
        hidden: list[Column] = []
        keys: list[tuple[str, bool, str]] = []  # column, descending, kind
        for o in q.order:
            if isinstance(o.expr, t.Literal):
                continue  # a constant, no place in the list
            at = [i for i, out in enumerate(outputs) if isinstance(o.expr, t.Name) and out.name.lower() == o.expr.column.lower()]
            if at:
                keys.append((ids[at[0]], o.descending, outputs[at[0]].value.kind))
                continue
            x, name = low.value(o.expr), fresh("s")
            hidden.append(x.col.alias(name))
            keys.append((name, o.descending, x.kind))
        df = low.scope.df.select(*[o.value.col.alias(i) for o, i in zip(outputs, ids)], *hidden)
        order = []
        for name, descending, kind in keys:
            key = v.folded(v.Value(F.col(name), kind), self.nocase)
            order.append(key.desc() if descending else key.asc())
        if q.distinct and hidden:
            place = fresh("r")
            df = df.withColumn(place, F.row_number().over(W.partitionBy(*ids).orderBy(*order))).where(F.col(place) == 1)
        elif q.distinct:
            df = df.distinct()
        if order:
            df = df.orderBy(*order)
        if q.limit is not None:
            df = df.limit(q.limit)
        return Planned(df.select(*ids), [o.name for o in outputs], [o.value.kind for o in outputs])


class _Grouped(Scope):
    """After grouping, names are still resolved among the columns before it."""

    def __init__(self, df: DataFrame, before: Scope):
        super().__init__(df, before.fields)
