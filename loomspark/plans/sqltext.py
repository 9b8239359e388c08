"""A mutable builder of parameterised SQL text."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession

from ..functions.expressions import bound, quoted
from ..schema import ColumnRef, TableDef


class SqlText:
    """Text and bound values in order; terminals run it on the session."""

    def __init__(self, spark: SparkSession | None = None, query: str = "", params: list[Any] | tuple = ()):
        self.spark, self.query, self.params = spark, query, list(params)

    def append(self, text: str) -> SqlText:
        self.query += text
        return self

    raw = append

    def identifier(self, x: str | ColumnRef | TableDef) -> SqlText:
        if isinstance(x, TableDef):
            return self.append(".".join(map(quoted, x.full_name.split("."))))
        return self.append(f"{quoted(x.table)}.{quoted(x.name)}" if isinstance(x, ColumnRef) else ".".join(map(quoted, x.split("."))))

    column = table = identifier

    def value(self, v: Any) -> SqlText:
        self.params.append(v)
        return self.append("?")

    def values(self, vs: list[Any], sep: str = ", ") -> SqlText:
        self.params += vs
        return self.append(sep.join("?" * len(vs)))

    def in_(self, vs: list[Any]) -> SqlText:
        """An empty list matches nothing."""
        return self.append(" IN (").values(vs).append(")") if vs else self.append(" IN (NULL)")

    def when(self, condition: Any, text: str, params: list[Any] | tuple = ()) -> SqlText:
        if condition:
            self.params += params
            self.append(text)
        return self

    def join(self, parts: list[SqlText], sep: str = " ") -> SqlText:
        self.append(sep.join(p.query for p in parts))
        for p in parts:
            self.params += p.params
        return self

    def merge(self, other: SqlText) -> SqlText:
        self.params += other.params
        return self.append(other.query)

    def __str__(self) -> str:
        return self.query

    def get_query(self) -> str:
        return self.query

    def get_params(self) -> list[Any]:
        return list(self.params)

    def df(self) -> DataFrame:
        if self.spark is None:
            raise RuntimeError("not bound to a session")
        return self.spark.sql(bound(self.query, self.params))

    execute = df

    def all(self) -> list[Row]:
        return self.df().collect()

    def one(self) -> Row | None:
        return self.df().first()

    def scalar(self, column: int = 0) -> Any:
        row = self.one()
        return None if row is None else row[column]

    def row_count(self) -> int:
        return self.df().count()

    @classmethod
    def select(cls, *columns: str, spark: SparkSession | None = None) -> SqlText:
        return cls(spark, "SELECT " + (", ".join(columns) or "*"))

    @classmethod
    def insert_into(cls, name: str, spark: SparkSession | None = None) -> SqlText:
        return cls(spark, "INSERT INTO ").identifier(name)

    @classmethod
    def update_table(cls, name: str, spark: SparkSession | None = None) -> SqlText:
        return cls(spark, "UPDATE ").identifier(name)

    @classmethod
    def delete_from(cls, name: str, spark: SparkSession | None = None) -> SqlText:
        return cls(spark, "DELETE FROM ").identifier(name)

    @classmethod
    def raw_sql(cls, text: str, params: list[Any] | tuple = (), spark: SparkSession | None = None) -> SqlText:
        return cls(spark, text, params)

    @classmethod
    def param(cls, v: Any) -> SqlText:
        return cls(None, "?", [v])

    @classmethod
    def empty(cls) -> SqlText:
        return cls()
