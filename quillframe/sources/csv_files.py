"""CSV files as tables: read as text once, types inferred from all rows in one aggregate."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.functions.values import BOOL, DOUBLE, INT, TEXT, TYPES
from quillframe.plans.lexer import SqlError

INTEGER_FORM = r"^[+-]?[0-9]+$"
DOUBLE_FORM = r"^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|inf)$"
BOOLEAN_FORM = r"^(?i:true|false)$"


def _cell(name: str) -> Column:
    """A cell without the blanks around it; null if nothing is left."""
    return F.nullif(F.btrim(F.col(f"`{name}`"), F.lit(" \t")), F.lit(""))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """All cells as text: short rows are padded with null, long ones cut, blank lines passed over."""
    reader = spark.read.options(header=True, quote='"', escape='"', multiLine=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, nullValue="", emptyValue="", enforceSchema=True, inferSchema=False)
    try:
        df = reader.csv(path)
    except AnalysisException as e:
        raise SqlError(f"cannot open {path}: {e.getMessage() if hasattr(e, 'getMessage') else e}") from e
    if not df.columns:
        raise SqlError(f"{path} is empty")
    names = [c.strip() for c in df.columns]
    plain = df.toDF(*[f"_{i}" for i in range(len(names))])
    return plain.select(*[_cell(f"_{i}").alias(f"_{i}") for i in range(len(names))]).toDF(*names)


def infer(df: DataFrame) -> list[str]:
    """The kind of each text column: whole numbers, else doubles, else truth values, else text; without values whole numbers."""
    plain = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    tests = []
    for i in range(len(df.columns)):
        x = F.col(f"_{i}")
        tests += [F.every(x.isNull() | x.rlike(form)).alias(f"{kind}{i}") for kind, form in ((INT, INTEGER_FORM), (DOUBLE, DOUBLE_FORM), (BOOL, BOOLEAN_FORM))]
    row = plain.agg(*tests).first()
    # no row at all gives null tests
    return [next((kind for kind in (INT, DOUBLE, BOOL) if row[f"{kind}{i}"] in (True, None)), TEXT) for i in range(len(df.columns))]


def load(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file, or folder or pattern of files, with a header, as a typed table. Whole numbers beyond 64 bits become null."""
    text = read_text(spark, path)
    names = text.columns
    if len({n.lower() for n in names}) < len(names):
        raise SqlError(f"{path} names a column twice")
    plain = text.toDF(*[f"_{i}" for i in range(len(names))])
    return plain.select(*[F.col(f"_{i}").try_cast(TYPES[kind]).alias(f"_{i}") for i, kind in enumerate(infer(text))]).toDF(*names)
