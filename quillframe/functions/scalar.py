"""Scalar functions and aggregates of the dialect as column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillframe.functions.values import DOUBLE, INT, NULL, OTHER, TEXT, TYPES, Value, as_number, as_text, common_kind, null
from quillframe.plans.lexer import SqlError

AGGREGATES = frozenset(("count", "sum", "avg", "min", "max"))


def _upper(s: Value) -> Value:
    return Value(F.upper(as_text(s)), TEXT)


def _lower(s: Value) -> Value:
    return Value(F.lower(as_text(s)), TEXT)


def _length(s: Value) -> Value:
    return Value(F.length(as_text(s)).cast("bigint"), INT)


def _trim(s: Value) -> Value:
    return Value(F.btrim(as_text(s), F.lit(" \t\n\r")), TEXT)


def _abs(x: Value) -> Value:
    return Value(F.abs(as_number(x).col).cast("double"), DOUBLE)


def _round(x: Value, digits: Value | None = None) -> Value:
    """Half away from zero at ``digits`` decimals, always a double; null digits count as none."""
    n = as_number(x).col.cast("double")
    if digits is None:
        scale = F.lit(1.0)
    elif digits.constant is not None:
        scale = F.lit(float(10.0 ** int(digits.constant)))
    else:
        scale = F.pow(F.lit(10.0), F.coalesce(as_number(digits).col.cast("double"), F.lit(0.0)))
    scaled = F.abs(n) * scale
    # from 2^52 on a double has no digits after the point
    return Value(F.when(scaled >= float(1 << 52), n).otherwise(F.signum(n) * F.floor(scaled + 0.5) / scale), DOUBLE)


def _coalesce(*values: Value) -> Value:
    kind = common_kind(list(values))
    if kind == NULL:
        return null()
    if kind == TEXT:
        return Value(F.coalesce(*map(as_text, values)), TEXT)
    return Value(F.coalesce(*[v.col if kind == OTHER else v.col.cast(TYPES[kind]) for v in values]), kind)


def _concat(*values: Value) -> Value:
    """Nulls are skipped; without any text left the result is empty."""
    return Value(F.concat_ws("", *map(as_text, values)), TEXT)


def _substring(s: Value, start: Value, size: Value | None = None) -> Value:
    """From the first character on where ``start`` lies before it; a negative size reaches to the end."""
    text, first = as_text(s), F.greatest(as_number(start).col.cast("int"), F.lit(1))
    if size is None:
        return Value(F.substr(text, first), TEXT)
    n = as_number(size).col.cast("int")
    return Value(F.when(n < 0, F.substr(text, first)).otherwise(F.substr(text, first, n)), TEXT)


#: By name: the builder, least and most arguments.
SCALARS = {
    "upper": (_upper, 1, 1),
    "lower": (_lower, 1, 1),
    "length": (_length, 1, 1),
    "trim": (_trim, 1, 1),
    "abs": (_abs, 1, 1),
    "round": (_round, 1, 2),
    "coalesce": (_coalesce, 1, None),
    "concat": (_concat, 1, None),
    "substring": (_substring, 2, 3),
}


def scalar(name: str, args: list[Value]) -> Value:
    if name not in SCALARS:
        raise SqlError(f"unknown function {name.upper()}")
    build, least, most = SCALARS[name]
    if len(args) < least or most is not None and len(args) > most:
        raise SqlError(f"wrong number of arguments for {name.upper()}")
    return build(*args)


def _extreme(name: str, x: Value, nocase: bool) -> Column:
    """The least or greatest value; of texts by their folded form, and of those alike by themselves."""
    if x.kind != TEXT or not nocase:
        return (F.min if name == "min" else F.max)(x.col)
    order = F.when(x.col.isNotNull(), F.struct(F.lower(x.col).alias("a"), x.col.alias("b")))
    return (F.min if name == "min" else F.max)(order)["b"]


def aggregate(name: str, x: Value | None, distinct: bool, nocase: bool) -> Value:
    """An aggregate of ``x``; None counts rows."""
    if name == "count":
        if x is None:
            return Value(F.count(F.lit(1)), INT)
        return Value(F.count_distinct(x.col) if distinct else F.count(x.col), INT)
    if x is None:
        raise SqlError(f"{name.upper()} needs an argument")
    if name in ("min", "max"):
        return Value(_extreme(name, x, nocase), x.kind)
    if x.kind == NULL:
        return null(DOUBLE)
    n = as_number(x)
    if name == "sum":
        return Value((F.sum_distinct if distinct else F.sum)(n.col), n.kind if n.kind in (INT, DOUBLE) else DOUBLE)
    if distinct:
        return Value(F.sum_distinct(n.col.cast("double")) / F.nullif(F.count_distinct(n.col), F.lit(0)), DOUBLE)
    return Value(F.avg(n.col), DOUBLE)
