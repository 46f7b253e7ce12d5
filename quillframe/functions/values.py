"""Values of the dialect: kinds, text form, truth, numbers and comparison, as Spark columns.

A column's kind is known from the schema, so the dialect's rules are chosen
while the plan is built and cost nothing per row.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

INT, DOUBLE, BOOL, TEXT, NULL, OTHER = "int", "double", "bool", "text", "null", "other"
NUMBERS = (INT, DOUBLE)
TYPES = {INT: "bigint", DOUBLE: "double", BOOL: "boolean", TEXT: "string", NULL: "string"}
#: Names a statement may give a column's type.
DECLARED = {
    "integer": INT, "int": INT, "double": DOUBLE, "float": DOUBLE, "decimal": DOUBLE, "numeric": DOUBLE,
    "boolean": BOOL, "bool": BOOL, "string": TEXT, "varchar": TEXT, "text": TEXT,
}
TITLES = {INT: "INTEGER", DOUBLE: "DOUBLE", BOOL: "BOOLEAN", TEXT: "STRING"}


@dataclass(frozen=True)
class Value:
    """A column and its kind; ``constant`` holds the value of a literal."""

    col: Column
    kind: str
    constant: object = None

    @property
    def literal(self) -> bool:
        return self.constant is not None or self.kind == NULL


def kind_of(dtype: T.DataType) -> str:
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return INT
    if isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
        return DOUBLE
    if isinstance(dtype, T.BooleanType):
        return BOOL
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return TEXT
    return NULL if isinstance(dtype, T.NullType) else OTHER


def constant(value: object) -> Value:
    kinds = {bool: BOOL, int: INT, float: DOUBLE, str: TEXT, type(None): NULL}
    kind = kinds[type(value)]
    col = F.lit(value).cast("bigint") if kind == INT else F.lit(value)
    return Value(col, kind, value)


def null(kind: str = TEXT) -> Value:
    return Value(F.lit(None).cast(TYPES.get(kind, "string")), kind)


def as_text(v: Value) -> Column:
    """A value as the dialect prints it: whole doubles without decimals, others with two."""
    if v.kind == TEXT:
        return v.col
    if v.kind == DOUBLE:
        x = v.col.cast("double")
        whole = (x == F.floor(x)) & (F.abs(x) < 1e15)
        return F.when(whole, F.when(whole, x).cast("bigint").cast("string")).when(x.isNotNull(), F.format_string("%.2f", x))
    return v.col.cast("string")


def as_number(v: Value) -> Value:
    """A value in arithmetic: truth values count 1 and 0, text is read as a double."""
    if v.kind in NUMBERS:
        return v
    if v.kind == BOOL:
        return Value(v.col.cast("int").cast("bigint"), INT)
    return Value(v.col.cast("double"), DOUBLE)


def as_truth(v: Value) -> Column:
    """A value as a condition: numbers but 0 and text but the empty one hold; null stays null."""
    if v.kind == BOOL:
        return v.col
    if v.kind in NUMBERS:
        return v.col != 0
    if v.kind == NULL:
        return F.lit(None).cast("boolean")
    return F.length(as_text(v)) > 0


def certain(v: Value) -> Column:
    """A condition in which null counts as false."""
    return F.coalesce(as_truth(v), F.lit(False))


def folded(v: Value, nocase: bool) -> Column:
    """The form in which texts are compared and ordered."""
    return F.lower(v.col) if nocase and v.kind == TEXT else v.col


def case_range(x: Column, texts: list[str], prefix: bool = False) -> Column | None:
    """What holds for every ``x`` that equals one of the texts, or begins with one, but for case; None where that is unknown.

    Of ASCII letters capitals come first. Two other letters have an ASCII letter
    in their small form; they come after all of ASCII.
    """
    if not all(p.isascii() and p for p in texts):
        return None
    first = min(p.upper() for p in texts)
    last = max(p.lower().replace("i", "\u0130").replace("k", "\u212a") for p in texts)
    if prefix:
        return (x >= first) & (x < last[:-1] + chr(ord(last[-1]) + 1))
    return (x >= first) & (x <= last)


def alike(a: Value, b: Value, nocase: bool) -> tuple[Column, Column]:
    """Both sides of a comparison in one comparable form.

    Numbers compare as numbers, truth values as truth values, text without
    regard to case; a number or truth value meets text, and a truth value a
    number, as text.
    """
    if NULL in (a.kind, b.kind) or OTHER in (a.kind, b.kind):
        return a.col, b.col
    if a.kind in NUMBERS and b.kind in NUMBERS or a.kind == b.kind == BOOL:
        return a.col, b.col
    x, y = (replace(v, col=as_text(v), kind=TEXT) for v in (a, b))
    return folded(x, nocase), folded(y, nocase)


def compare(op: str, a: Value, b: Value, nocase: bool) -> Value:
    x, y = alike(a, b, nocase)
    made = {"=": lambda: x == y, "<>": lambda: x != y, "<": lambda: x < y, ">": lambda: x > y, "<=": lambda: x <= y, ">=": lambda: x >= y}[op]()
    return Value(made, BOOL)


def common_kind(values: list[Value]) -> str:
    """The kind that holds all of the values: one that they share, double for mixed numbers, else text."""
    kinds = {v.kind for v in values} - {NULL}
    if not kinds:
        return NULL
    if len(kinds) == 1:
        return kinds.pop()
    return DOUBLE if kinds == {INT, DOUBLE} else TEXT


def arithmetic(op: str, a: Value, b: Value) -> Value:
    """Whole numbers stay whole but in division, which is of doubles; dividing by zero is an error."""
    if NULL in (a.kind, b.kind):
        return null(DOUBLE if op == "/" else INT)
    a, b = as_number(a), as_number(b)
    if op in ("/", "%"):
        divisor = F.when(b.col == 0, F.raise_error(F.lit("Division by zero")).cast(TYPES[b.kind])).otherwise(b.col)
        if b.constant not in (None, 0):
            divisor = b.col
        if op == "/":
            return Value(a.col.cast("double") / divisor.cast("double"), DOUBLE)
        return Value(a.col % divisor, INT if a.kind == b.kind == INT else DOUBLE)
    kind = INT if a.kind == b.kind == INT else DOUBLE
    return Value({"+": lambda: a.col + b.col, "-": lambda: a.col - b.col, "*": lambda: a.col * b.col}[op](), kind)
