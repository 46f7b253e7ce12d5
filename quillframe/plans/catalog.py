"""Tables and indexes by name, without regard to case. A table is a DataFrame version; statements replace it."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from quillframe.plans.lexer import SqlError
from quillframe.sources.shared import shared_folder

#: Versions after which a table is written out, so that its plan does not grow without end.
VERSIONS = 16


@dataclass
class Table:
    name: str
    df: DataFrame
    source: str = ""
    version: int = 0

    def column(self, name: str) -> str:
        """A column's own spelling."""
        for c in self.df.columns:
            if c.lower() == name.lower():
                return c
        raise SqlError(f"no column {name} in table {self.name}")


@dataclass(frozen=True)
class Index:
    name: str
    table: str
    column: str


@dataclass
class Catalog:
    spark: SparkSession
    tables: dict[str, Table] = field(default_factory=dict)
    indexes: dict[str, Index] = field(default_factory=dict)

    def get(self, name: str) -> Table:
        try:
            return self.tables[name.lower()]
        except KeyError:
            raise SqlError(f"no table {name}") from None

    def put(self, name: str, df: DataFrame, source: str = "") -> Table:
        """Registers a table; one of that name is replaced and its indexes go."""
        self.indexes = {k: x for k, x in self.indexes.items() if x.table.lower() != name.lower()}
        self.tables[name.lower()] = out = Table(name, df, source)
        return out

    def replace(self, table: Table, df: DataFrame) -> None:
        """The next version of a table."""
        table.version += 1
        table.df = self._written(df) if table.version % VERSIONS == 0 else df

    def drop(self, name: str) -> None:
        del self.tables[self.get(name).name.lower()]
        self.indexes = {k: x for k, x in self.indexes.items() if x.table.lower() != name.lower()}

    def rename(self, old: str, new: str) -> None:
        table = self.get(old)
        if new.lower() in self.tables and new.lower() != old.lower():
            raise SqlError(f"table {new} exists")
        self.tables = {(new.lower() if t is table else k): t for k, t in self.tables.items()}
        self.indexes = {k: Index(x.name, new, x.column) if x.table.lower() == old.lower() else x for k, x in self.indexes.items()}
        table.name = new

    def index(self, name: str) -> Index:
        try:
            return self.indexes[name.lower()]
        except KeyError:
            raise SqlError(f"no index {name}") from None

    def add_index(self, name: str, table: str, column: str) -> Index:
        if name.lower() in self.indexes:
            raise SqlError(f"index {name} exists")
        found = self.get(table)
        self.indexes[name.lower()] = out = Index(name, found.name, found.column(column))
        return out

    def drop_index(self, name: str) -> None:
        del self.indexes[self.index(name).name.lower()]

    def clear(self) -> None:
        self.tables.clear()
        self.indexes.clear()

    def _written(self, df: DataFrame) -> DataFrame:
        """Cuts the lineage with a table in the folder that the cluster shares."""
        path = f"{shared_folder(self.spark)}/table-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)
