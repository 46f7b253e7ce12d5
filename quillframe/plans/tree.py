"""Syntax tree of the dialect. Expressions are frozen, so that equal ones compare equal."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any


class Expr:
    """An expression."""


@dataclass(frozen=True)
class Literal(Expr):
    value: Any


@dataclass(frozen=True)
class Name(Expr):
    column: str
    table: str | None = None


@dataclass(frozen=True)
class Star(Expr):
    table: str | None = None


@dataclass(frozen=True)
class Unary(Expr):
    op: str
    x: Expr


@dataclass(frozen=True)
class Binary(Expr):
    op: str
    left: Expr
    right: Expr


@dataclass(frozen=True)
class Between(Expr):
    x: Expr
    low: Expr
    high: Expr
    negated: bool = False


@dataclass(frozen=True)
class InList(Expr):
    x: Expr
    items: tuple[Expr, ...]
    negated: bool = False


@dataclass(frozen=True)
class InQuery(Expr):
    x: Expr
    query: Select
    negated: bool = False


@dataclass(frozen=True)
class IsNull(Expr):
    x: Expr
    negated: bool = False


@dataclass(frozen=True)
class Like(Expr):
    x: Expr
    pattern: Expr
    negated: bool = False


@dataclass(frozen=True)
class Call(Expr):
    name: str
    args: tuple[Expr, ...]
    distinct: bool = False


@dataclass(frozen=True)
class Subquery(Expr):
    query: Select


@dataclass(frozen=True)
class Item:
    expr: Expr
    alias: str | None = None


@dataclass(frozen=True)
class TableRef:
    name: str
    alias: str


@dataclass(frozen=True)
class Derived:
    query: Select
    alias: str


@dataclass(frozen=True)
class Join:
    kind: str  # inner, left, right, cross
    right: TableRef | Derived
    on: Expr | None = None


@dataclass(frozen=True)
class Order:
    expr: Expr
    descending: bool = False


@dataclass(frozen=True)
class Select:
    items: tuple[Item, ...]
    source: TableRef | Derived
    joins: tuple[Join, ...] = ()
    where: Expr | None = None
    group: tuple[Expr, ...] = ()
    having: Expr | None = None
    order: tuple[Order, ...] = ()
    limit: int | None = None
    distinct: bool = False


@dataclass(frozen=True)
class Load:
    path: str
    name: str


@dataclass(frozen=True)
class Show:
    what: str  # tables, indexes


@dataclass(frozen=True)
class Describe:
    table: str


@dataclass(frozen=True)
class CreateTable:
    name: str
    columns: tuple[tuple[str, str], ...]


@dataclass(frozen=True)
class CreateIndex:
    name: str
    table: str
    column: str


@dataclass(frozen=True)
class Drop:
    what: str  # table, index
    name: str


@dataclass(frozen=True)
class Insert:
    table: str
    columns: tuple[str, ...] | None
    rows: tuple[tuple[Any, ...], ...]


@dataclass(frozen=True)
class Delete:
    table: str
    where: Expr | None = None


@dataclass(frozen=True)
class Update:
    table: str
    sets: tuple[tuple[str, Expr], ...]
    where: Expr | None = None


@dataclass(frozen=True)
class Alter:
    table: str
    action: str  # add, drop, rename, move
    column: str = ""
    other: str = ""  # a type or a new name


@dataclass(frozen=True)
class Export:
    query: Select
    path: str
    format: str | None = None


Statement = Select | Load | Show | Describe | CreateTable | CreateIndex | Drop | Insert | Delete | Update | Alter | Export


def children(e: Expr) -> tuple[Expr, ...]:
    """Direct parts of an expression, without those of subqueries."""
    match e:
        case Unary(_, x) | IsNull(x, _):
            return (x,)
        case Binary(_, a, b):
            return (a, b)
        case Like(x, p, _):
            return (x, p)
        case Between(x, lo, hi, _):
            return (x, lo, hi)
        case InList(x, items, _):
            return (x, *items)
        case InQuery(x, _, _):
            return (x,)
        case Call(_, args, _):
            return args
    return ()


def show(e: Expr) -> str:
    """SQL text of an expression; names the columns of unnamed results."""
    match e:
        case Literal(v):
            return "NULL" if v is None else str(v).upper() if isinstance(v, bool) else f"'{v}'" if isinstance(v, str) else str(v)
        case Name(c, t):
            return f"{t}.{c}" if t else c
        case Star(t):
            return f"{t}.*" if t else "*"
        case Unary(op, x):
            return f"NOT {show(x)}" if op == "not" else f"-{show(x)}"
        case Binary(op, a, b):
            return f"({show(a)} {op.upper()} {show(b)})"
        case Between(x, lo, hi, n):
            return f"{show(x)}{' NOT' * n} BETWEEN {show(lo)} AND {show(hi)}"
        case InList(x, items, n):
            return f"{show(x)}{' NOT' * n} IN ({', '.join(map(show, items))})"
        case InQuery(x, _, n):
            return f"{show(x)}{' NOT' * n} IN (SELECT)"
        case IsNull(x, n):
            return f"{show(x)} IS{' NOT' * n} NULL"
        case Like(x, p, n):
            return f"{show(x)}{' NOT' * n} LIKE {show(p)}"
        case Call(name, args, distinct):
            return f"{name.upper()}({'DISTINCT ' * distinct}{', '.join(map(show, args))})"
        case Subquery():
            return "(SELECT)"
    return str(e)
