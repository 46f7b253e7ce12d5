"""A SQL dialect for analytics on Spark DataFrames."""

from quillframe.engine import Engine, Result
from quillframe.plans.lexer import SqlError

__all__ = ["Engine", "Result", "SqlError"]
