"""Predicates, aggregates, ordering and raw fragments as Spark columns.

Literals are cast to the declared type of the column they meet; a literal that can't be cast makes the predicate false
instead of failing the query. Comparisons with null are never true.
"""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass, replace
from decimal import Decimal
from functools import reduce
from typing import Any

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import ColumnRef

_CALLS = re.compile(r"\b([a-z_]\w*)\s*\(", re.I)
_known: dict[str, bool] = {}


def _aggregates(name: str) -> bool:
    """Whether Spark's function registry, the session's own functions included, has an aggregate of that name."""
    name = name.lower()
    if name not in _known:
        spark = SparkSession.getActiveSession()
        if spark is None:
            return name in ("count", "sum", "avg", "min", "max", "any_value", "first", "collect_list", "collect_set")
        found = spark._jsparkSession.sessionState().functionRegistry().lookupFunction(spark._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(name))
        _known[name] = found.isDefined() and found.get().getGroup() == "agg_funcs"
    return _known[name]


@dataclass(frozen=True)
class Expr:
    """A Spark column with what a query must know of it; ``as_`` names it."""

    column: Column
    aggregate: bool = False
    alias: str | None = None
    text: str | None = None

    def as_(self, alias: str) -> Expr:
        return replace(self, alias=alias)

    @property
    def named(self) -> Column:
        return self.column.alias(self.alias) if self.alias else self.column


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def column_of(x: Any) -> Column:
    """Column of a reference, an expression, a Spark column, or the text of a SQL scalar."""
    if isinstance(x, ColumnRef):
        return F.col(f"{quoted(x.table)}.{quoted(x.name)}")
    if isinstance(x, Expr):
        return x.column
    return x if isinstance(x, Column) else F.expr(x)


def _is_aggregate(*xs: Any) -> bool:
    return any(isinstance(x, Expr) and x.aggregate for x in xs)


def literal_sql(value: Any) -> str:
    """SQL text of a bound value; text goes in as hexadecimal, so nothing in it is ever read as SQL."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int | Decimal):
        return f"({value})"
    if isinstance(value, float):
        return f"cast('{value!r}' as double)"
    if isinstance(value, dt.datetime):
        return f"timestamp_ntz'{value:%Y-%m-%d %H:%M:%S.%f}'"
    if isinstance(value, dt.date):
        return f"date'{value:%Y-%m-%d}'"
    if isinstance(value, bytes):
        return f"X'{value.hex()}'"
    if isinstance(value, str):
        return f"decode(X'{value.encode().hex()}', 'UTF-8')"
    raise TypeError(f"can't bind {type(value).__name__}")


def bound(sql: str, bindings: list[Any] | tuple = ()) -> str:
    """Puts bound values where ``?`` stands outside of quotes and comments."""
    values, out = list(bindings), []
    for part in re.split(r"('(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`(?:[^`]|``)*`|--[^\n]*|/\*(?:[^*]|\*(?!/))*\*/|\?)", sql):
        if part == "?":
            if not values:
                raise ValueError("more placeholders than values")
            part = literal_sql(values.pop(0))
        out.append(part)
    if values:
        raise ValueError("more values than placeholders")
    return "".join(out)


def raw(sql: str, bindings: list[Any] | tuple = ()) -> Expr:
    """A SQL scalar as it is; ``?`` are bound in order."""
    text = bound(sql, bindings)
    return Expr(F.expr(text), any(map(_aggregates, _CALLS.findall(re.sub(r"'[^']*'", "", sql)))) and " over " not in sql.lower() and "select" not in sql.lower(), text=text)


def coerced(left: Any, value: Any) -> Column:
    """A literal in the type of the column it is compared with."""
    if isinstance(value, ColumnRef | Expr | Column):
        return column_of(value)
    if not isinstance(left, ColumnRef):
        return F.lit(value)
    kind = left.column.spark_type
    if isinstance(kind, T.BooleanType) and isinstance(value, int):
        return F.lit(bool(value))
    if isinstance(value, bool) and isinstance(kind, T.NumericType):
        return F.lit(int(value))
    if isinstance(kind, T.IntegerType | T.LongType | T.ShortType | T.ByteType) and isinstance(value, float | Decimal):
        return F.lit(value)  # 2.5 must not become 2
    if isinstance(kind, T.IntegerType | T.LongType | T.ShortType | T.ByteType) and isinstance(value, int):
        return F.lit(value)
    return F.lit(value).try_cast(kind)


def _compare(op: str):
    def make(left: Any, value: Any) -> Expr:
        return Expr(getattr(column_of(left), op)(coerced(left, value)), _is_aggregate(left, value))

    return make


eq, ne, gt, gte, lt, lte = map(_compare, ("__eq__", "__ne__", "__gt__", "__ge__", "__lt__", "__le__"))


def and_(*xs: Any) -> Expr:
    return Expr(reduce(lambda a, b: a & b, map(column_of, xs), F.lit(True)) if xs else F.lit(True), _is_aggregate(*xs))


def or_(*xs: Any) -> Expr:
    return Expr(reduce(lambda a, b: a | b, map(column_of, xs)) if xs else F.lit(False), _is_aggregate(*xs))


def not_(x: Any) -> Expr:
    return Expr(~column_of(x), _is_aggregate(x))


def in_(left: Any, values: list[Any]) -> Expr:
    """An empty list is false for every row."""
    return Expr(column_of(left).isin([coerced(left, v) for v in values]) if values else F.lit(False))


def not_in(left: Any, values: list[Any]) -> Expr:
    """An empty list is true for every row, nulls included; a null in the list leaves no row."""
    return Expr(~column_of(left).isin([coerced(left, v) for v in values]) if values else F.lit(True))


in_array, not_in_array = in_, not_in


def between(left: Any, low: Any, high: Any) -> Expr:
    return Expr(column_of(left).between(coerced(left, low), coerced(left, high)))


def not_between(left: Any, low: Any, high: Any) -> Expr:
    return Expr(~column_of(left).between(coerced(left, low), coerced(left, high)))


def like(left: Any, pattern: str) -> Expr:
    """Case-sensitive; a backslash escapes."""
    return Expr(column_of(left).like(pattern))


def not_like(left: Any, pattern: str) -> Expr:
    return Expr(~column_of(left).like(pattern))


def ilike(left: Any, pattern: str) -> Expr:
    return Expr(column_of(left).ilike(pattern))


def not_ilike(left: Any, pattern: str) -> Expr:
    return Expr(~column_of(left).ilike(pattern))


def is_null(left: Any) -> Expr:
    return Expr(column_of(left).isNull())


def is_not_null(left: Any) -> Expr:
    return Expr(column_of(left).isNotNull())


@dataclass(frozen=True)
class Order:
    by: Any
    descending: bool = False

    def column(self, col: Column | None = None) -> Column:
        """Ascending has nulls first, descending nulls last."""
        c = column_of(self.by) if col is None else col
        return c.desc() if self.descending else c.asc()


def asc(x: Any) -> Order:
    return Order(x)


def desc(x: Any) -> Order:
    return Order(x, True)


def order_of(x: Any) -> Order:
    return x if isinstance(x, Order) else Order(x)


def sql_count(x: Any = None, distinct: bool = False) -> Expr:
    if x is None:
        return Expr(F.count(F.lit(1)), True)
    return Expr((F.count_distinct if distinct else F.count)(column_of(x)), True)


def sql_count_distinct(x: Any) -> Expr:
    return sql_count(x, True)


def sql_sum(x: Any) -> Expr:
    return Expr(F.sum(column_of(x)), True)


def sql_avg(x: Any) -> Expr:
    return Expr(F.avg(column_of(x)), True)


def sql_min(x: Any) -> Expr:
    return Expr(F.min(column_of(x)), True)


def sql_max(x: Any) -> Expr:
    return Expr(F.max(column_of(x)), True)
