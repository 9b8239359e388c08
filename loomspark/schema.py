"""Typed table definitions and their Spark schemas."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import types as T

#: Logical type -> Spark type; length and precision come from the column.
SPARK_TYPES: dict[str, Any] = {
    "integer": T.IntegerType(), "bigint": T.LongType(), "smallint": T.ShortType(), "tinyint": T.ByteType(), "text": T.StringType(), "varchar": T.StringType(), "char": T.StringType(),
    "boolean": T.BooleanType(), "timestamp": T.TimestampNTZType(), "datetime": T.TimestampNTZType(), "date": T.DateType(), "time": T.StringType(), "json": T.StringType(), "jsonb": T.StringType(),
    "uuid": T.StringType(), "real": T.FloatType(), "double": T.DoubleType(), "blob": T.BinaryType(), "binary": T.BinaryType(), "varbinary": T.BinaryType(), "enum": T.StringType(),
}


@dataclass(frozen=True)
class ForeignKey:
    """Delete and update actions: cascade, set null, restrict, no action."""

    columns: tuple[str, ...]
    table: str
    references: tuple[str, ...]
    on_delete: str = "cascade"
    on_update: str = "cascade"
    name: str | None = None


@dataclass(frozen=True)
class ColumnDef:
    """A column: code name, stored name, type and constraints. Setters return copies."""

    type: str
    name: str = ""
    db_name: str | None = None
    length: int | None = None
    precision: int | None = None
    scale: int | None = None
    is_nullable: bool = True
    is_primary: bool = False
    identity: bool = False
    is_unique: bool = False
    default_value: Any = None
    has_default: bool = False
    references: tuple[str, str] | None = None
    values: tuple[str, ...] = ()
    unsigned: bool = False
    comment: str | None = None

    def not_null(self) -> ColumnDef:
        return replace(self, is_nullable=False)

    def nullable(self, on: bool = True) -> ColumnDef:
        return replace(self, is_nullable=on)

    def primary_key(self) -> ColumnDef:
        return replace(self, is_primary=True, is_nullable=False)

    def auto_increment(self) -> ColumnDef:
        return replace(self, identity=True)

    def unique(self) -> ColumnDef:
        return replace(self, is_unique=True)

    def default(self, value: Any) -> ColumnDef:
        return replace(self, default_value=value, has_default=True)

    def stored_as(self, db_name: str) -> ColumnDef:
        return replace(self, db_name=db_name)

    def refers_to(self, table: str, column: str) -> ColumnDef:
        return replace(self, references=(table, column))

    @property
    def stored(self) -> str:
        return self.db_name or self.name

    @property
    def spark_type(self) -> T.DataType:
        if self.type in ("decimal", "numeric"):
            return T.DecimalType(self.precision or 10, 2 if self.scale is None else self.scale)
        return SPARK_TYPES[self.type]


def _factory(kind: str, **fixed: Any):
    def make(**more: Any) -> ColumnDef:
        return ColumnDef(kind, **{**fixed, **more})

    make.__name__ = kind
    return make


integer, bigint, smallint, text, boolean = map(_factory, ("integer", "bigint", "smallint", "text", "boolean"))
timestamp, datetime, date, time, json, jsonb, uuid = map(_factory, ("timestamp", "datetime", "date", "time", "json", "jsonb", "uuid"))
real, double_precision, blob = _factory("real"), _factory("double"), _factory("blob")
serial = _factory("integer", is_primary=True, identity=True, is_nullable=False)
bigserial = _factory("bigint", is_primary=True, identity=True, is_nullable=False)


def varchar(length: int = 255) -> ColumnDef:
    return ColumnDef("varchar", length=length)


def char(length: int = 1) -> ColumnDef:
    return ColumnDef("char", length=length)


def decimal(precision: int = 10, scale: int = 2) -> ColumnDef:
    return ColumnDef("decimal", precision=precision, scale=scale)


def numeric(precision: int = 10, scale: int = 2) -> ColumnDef:
    return ColumnDef("numeric", precision=precision, scale=scale)


def binary(length: int = 255) -> ColumnDef:
    return ColumnDef("binary", length=length)


def varbinary(length: int = 255) -> ColumnDef:
    return ColumnDef("varbinary", length=length)


@dataclass(frozen=True)
class ColumnRef:
    """A table's column in a query."""

    table: str
    column: ColumnDef

    @property
    def name(self) -> str:
        return self.column.name


@dataclass(frozen=True)
class TableDef:
    """A table: ordered columns by code name, keys and metadata; ``t.c.name`` or ``t["name"]`` is a column reference."""

    name: str
    columns: dict[str, ColumnDef]
    schema: str | None = None
    uniques: tuple[tuple[str, ...], ...] = ()
    indexes: tuple[tuple[str, ...], ...] = ()
    foreign_keys: tuple[ForeignKey, ...] = ()
    comment: str | None = None
    _: Any = field(default=None, repr=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "columns", {n: replace(c, name=n) for n, c in self.columns.items()})

    def __hash__(self) -> int:
        return hash((self.schema, self.name))

    @property
    def full_name(self) -> str:
        return f"{self.schema}.{self.name}" if self.schema else self.name

    @property
    def c(self) -> _Columns:
        return _Columns(self)

    def __getitem__(self, name: str) -> ColumnRef:
        if name not in self.columns:
            raise KeyError(f"{self.name} has no column {name}")
        return ColumnRef(self.name, self.columns[name])

    @property
    def primary_key(self) -> tuple[str, ...]:
        return tuple(n for n, c in self.columns.items() if c.is_primary)

    @property
    def identity(self) -> str | None:
        return next((n for n, c in self.columns.items() if c.identity), None)

    @property
    def unique_keys(self) -> list[tuple[str, ...]]:
        """The primary key first, then unique columns and composite keys."""
        own = [self.primary_key] if self.primary_key else []
        return own + [(n,) for n, c in self.columns.items() if c.is_unique] + list(self.uniques)

    @property
    def references(self) -> list[ForeignKey]:
        own = [ForeignKey((n,), c.references[0], (c.references[1],)) for n, c in self.columns.items() if c.references]
        return own + list(self.foreign_keys)

    @property
    def spark_schema(self) -> T.StructType:
        return T.StructType([T.StructField(n, c.spark_type, c.is_nullable) for n, c in self.columns.items()])


class _Columns:
    def __init__(self, table: TableDef):
        self._table = table

    def __getattr__(self, name: str) -> ColumnRef:
        try:
            return self._table[name]
        except KeyError as e:
            raise AttributeError(str(e)) from e


def table(name: str, columns: dict[str, ColumnDef], **more: Any) -> TableDef:
    return TableDef(name, columns, **more)
