"""Declared relations and their eager loading as one plan: children become structs and arrays of structs by joins."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions.expressions import Order, column_of, eq, order_of, quoted
from ..schema import ColumnRef, TableDef

if TYPE_CHECKING:
    from ..sources.database import Database


@dataclass(frozen=True)
class One:
    target: TableDef
    fields: tuple[str, ...]
    references: tuple[str, ...]


@dataclass(frozen=True)
class Many:
    """With ``through`` a many-to-many relation; ``through_where`` filters the junction."""

    target: TableDef
    fields: tuple[str, ...] = ()
    references: tuple[str, ...] = ()
    through: TableDef | None = None
    through_fields: tuple[str, ...] = ()
    target_fields: tuple[str, ...] = ()
    through_where: Any = None


@dataclass(frozen=True)
class PolyOne:
    type_column: str
    id_column: str
    targets: dict[str, TableDef]


@dataclass(frozen=True)
class PolyMany:
    target: TableDef
    type_column: str
    id_column: str
    type_value: str
    references: tuple[str, ...] = ()


class Registry:
    """Relations by table name."""

    def __init__(self) -> None:
        self.of: dict[str, dict[str, Any]] = {}

    def define(self, table: TableDef, relations: dict[str, Any]) -> None:
        for r in relations.values():
            if not isinstance(r, One | Many | PolyOne | PolyMany):
                raise ValueError(f"not a relation: {r!r}")
        self.of[table.name] = relations

    def get(self, table: TableDef) -> dict[str, Any]:
        return self.of.get(table.name, {})

    def clear(self) -> None:
        self.of.clear()


@dataclass(frozen=True)
class TableQuery:
    """Immutable query of one table with its relations."""

    db: Database
    table: TableDef
    names: tuple[str, ...] = ()
    condition: Any = None
    orders: tuple[Order, ...] = ()
    n: int | None = None
    skip: int | None = None
    relations: dict[str, Any] = field(default_factory=dict)

    def columns(self, *names: str) -> TableQuery:
        return replace(self, names=tuple(x.name if isinstance(x, ColumnRef) else x for x in names))

    def where(self, condition: Any) -> TableQuery:
        return replace(self, condition=condition)

    def order_by(self, *xs: Any) -> TableQuery:
        return replace(self, orders=(*self.orders, *map(order_of, xs)))

    def limit(self, n: int) -> TableQuery:
        return replace(self, n=n)

    def offset(self, n: int) -> TableQuery:
        return replace(self, skip=n)

    def with_(self, relations: dict[str, Any]) -> TableQuery:
        """{name or 'alias:name': True or {columns, where, order_by, limit, limit_per_parent, with, with_pivot}}."""
        return replace(self, relations=relations)

    def options(self, columns: Any = (), where: Any = None, order_by: Any = (), limit: int | None = None, offset: int | None = None, with_: dict[str, Any] | None = None) -> TableQuery:
        return replace(self, names=tuple(columns), condition=where, orders=tuple(map(order_of, order_by)), n=limit, skip=offset, relations=with_ or {})

    def find_many(self) -> DataFrame:
        loaded = self._loaded()
        df = self._rows(bool(loaded))
        few = self.condition is not None or self.n is not None
        for key in loaded:
            df = _attach(self.db, df, self.table, *key, few)
        if loaded and self.orders:  # joins keep no order
            df = df.orderBy(*(o.column(F.col(f"__o{i}")) for i, o in enumerate(self.orders)))
        return df.select(*(F.col(quoted(c)) for c in [*(self.names or self.table.columns), *(k for k, _, _ in loaded)]))

    def _rows(self, more: bool = False) -> DataFrame:
        """``more``: joins follow, so what the rows are ordered by goes along, and they are ordered only to be cut."""
        df = self.db.scan(self.table).alias(self.table.name)
        if self.condition is not None:
            df = df.filter(column_of(self.condition))
        if more:
            df = df.select("*", *(column_of(o.by).alias(f"__o{i}") for i, o in enumerate(self.orders)))
        if self.orders and not (more and self.n is None and self.skip is None):
            df = df.orderBy(*(o.column() for o in self.orders))
        if self.skip is not None:
            df = df.offset(self.skip)
        return df if self.n is None else df.limit(self.n)

    def _loaded(self) -> list[tuple[str, Any, dict[str, Any]]]:
        """Unknown relations are skipped."""
        known, out = self.db.registry.get(self.table), []
        for key, config in self.relations.items():
            alias, _, name = key.rpartition(":")
            if name in known:
                out.append((alias or name, known[name], config if isinstance(config, dict) else {}))
        return out

    def find_first(self) -> Row | None:
        return self.limit(1).find_many().first()

    find_one = find_first

    def find(self, key: Any) -> Row | None:
        """By primary key; a tuple for a composite one."""
        pk = self.table.primary_key
        if not pk:
            raise ValueError(f"{self.table.name} has no primary key")
        values = key if isinstance(key, tuple) else (key,)
        from ..functions.expressions import and_

        return self.where(and_(*(eq(self.table[k], v) for k, v in zip(pk, values)))).find_first()


def _child(db: Database, target: TableDef, config: dict[str, Any]) -> tuple[DataFrame, list[str]]:
    """Filtered child rows with nested relations and the key columns; and the names that the result shows."""
    q = TableQuery(db, target, condition=config.get("where"), relations=config.get("with", {}))
    added = [k for k, _, _ in q._loaded()]
    shown = [x.name if isinstance(x, ColumnRef) else x for x in config.get("columns") or target.columns] + added
    return q.find_many(), shown


def _compare(orders: list[tuple[str, bool]]):
    """Comparator of structs: ascending nulls first, descending nulls last."""

    def of(a: Column, b: Column) -> Column:
        out = F.lit(0)
        for name, down in reversed(orders):
            x, y = (b[name], a[name]) if down else (a[name], b[name])
            out = F.when(x.isNull() & y.isNotNull(), -1).when(x.isNotNull() & y.isNull(), 1).when(x < y, -1).when(x > y, 1).otherwise(out)
        return out

    return of


def _order_names(config: dict[str, Any], target: TableDef) -> list[tuple[str, bool]]:
    asked = config.get("order_by", ())
    asked = asked if isinstance(asked, list | tuple) else [asked]
    own = [(o.by if isinstance(o.by, str) else o.by.name, o.descending) for o in map(order_of, asked)]
    return own + [(k, False) for k in target.primary_key if k not in {n for n, _ in own}]


def _gather(child: DataFrame, key: str, shown: list[str], orders: list[tuple[str, bool]], per_parent: int | None, extra: list[Column] | None = None) -> DataFrame:
    """(key, items): one ordered array of structs for each key; of more than ``per_parent`` rows only the first are gathered."""
    if per_parent is not None:
        own = Window.partitionBy(quoted(key)).orderBy(*(F.desc(quoted(n)) if d else F.asc(quoted(n)) for n, d in orders) if orders else [F.lit(0)])
        child = child.withColumn("__rank", F.row_number().over(own)).filter(F.col("__rank") <= per_parent)
    payload = F.struct(*(F.col(quoted(c)).alias(c) for c in shown), *(extra or []))
    sort = F.struct(*(F.col(quoted(n)).alias(f"o{i}") for i, (n, _) in enumerate(orders)), payload.alias("p"))
    items = F.collect_list(sort)
    if orders:
        items = F.array_sort(items, _compare([(f"o{i}", d) for i, (_, d) in enumerate(orders)]))
    return child.groupBy(F.col(quoted(key)).alias("__k")).agg(F.transform(items, lambda s: s["p"]).alias("__items"))


def _attach(db: Database, df: DataFrame, table: TableDef, name: str, relation: Any, config: dict[str, Any], few: bool = False) -> DataFrame:
    """``few``: the parents are filtered, so children of others are left out before they are gathered."""
    keep = [F.col(quoted(c)) for c in df.columns]

    def of_parents(child: DataFrame, key: str, own: str) -> DataFrame:
        if not few:
            return child
        parents = df.select(F.col(quoted(own)).alias("__parent")).distinct()
        return child.join(parents, F.col(quoted(key)) == F.col("__parent"), "left_semi")

    if isinstance(relation, One):
        child, shown = _child(db, relation.target, config)
        ref = relation.references[0]
        if (ref,) in relation.target.unique_keys:  # one row for each key already
            one = child.select(F.col(quoted(ref)).alias("__k"), F.struct(*(F.col(quoted(c)).alias(c) for c in shown)).alias("__one"))
            return df.join(one, F.col(quoted(relation.fields[0])) == F.col("__k"), "left").select(*keep, F.col("__one").alias(name))
        child = of_parents(child, ref, relation.fields[0])
        last = F.max_by(F.struct(*(F.col(quoted(c)).alias(c) for c in shown)), F.struct(*(F.col(quoted(c)) for c in relation.target.primary_key or (ref,))))
        one = child.groupBy(F.col(quoted(ref)).alias("__k")).agg(last.alias("__one"))
        return df.join(one, F.col(quoted(relation.fields[0])) == F.col("__k"), "left").select(*keep, F.col("__one").alias(name))
    if isinstance(relation, PolyOne):
        fields = []
        for i, (kind, target) in enumerate(relation.targets.items()):
            child, shown = _child(db, target, config)
            side = child.select(F.col(quoted(target.primary_key[0])).alias(f"__k{i}"), F.struct(*(F.col(quoted(c)).alias(c) for c in shown)).alias(f"__t{i}"))
            df = df.join(side, (F.col(quoted(relation.type_column)) == F.lit(kind)) & (F.col(quoted(relation.id_column)) == F.col(f"__k{i}")), "left")
            fields.append(F.col(f"__t{i}").alias(kind))
        some = F.coalesce(*(F.col(f"__k{i}").isNotNull() | F.lit(None) for i in range(len(fields))), F.lit(False))
        return df.select(*keep, F.when(some, F.struct(*fields)).alias(name))
    pk = table.primary_key[0] if table.primary_key else None
    if isinstance(relation, PolyMany):
        child, shown = _child(db, relation.target, config)
        child = child.filter(F.col(quoted(relation.type_column)) == F.lit(relation.type_value))
        own, key = (relation.references or (pk,))[0], relation.id_column
        found = _gather(of_parents(child, key, own), key, shown, _order_names(config, relation.target), config.get("limit_per_parent"))
    elif relation.through is not None:
        own = (relation.fields or (pk,))[0]
        child, shown = _child(db, relation.target, config)
        junction = db.scan(relation.through).alias(relation.through.name)
        if relation.through_where is not None:
            junction = junction.filter(column_of(relation.through_where))
        left, right = relation.through_fields[0], relation.target_fields[0]
        pivot = [c for c in relation.through.columns if c not in (left, right)]
        side = junction.select(F.col(quoted(left)).alias("__own"), F.col(quoted(right)).alias("__other"), *(F.col(quoted(c)).alias(f"__p_{c}") for c in pivot))
        met = of_parents(side, "__own", own).join(child, F.col("__other") == F.col(quoted(relation.target.primary_key[0])))
        extra = [F.struct(*(F.col(f"__p_{c}").alias(c) for c in pivot)).alias("_pivot")] if config.get("with_pivot") else []
        orders = _order_names(config, relation.target) + [(f"__p_{c}", False) for c in pivot]
        found = _gather(met, "__own", shown, orders, config.get("limit_per_parent"), extra)
    else:
        own = (relation.fields or (pk,))[0]
        key = (relation.references or (f"{table.name.rstrip('s')}_id",))[0]
        if key not in relation.target.columns:
            return df.select(*keep, F.array().alias(name))
        child, shown = _child(db, relation.target, config)
        if config.get("limit") is not None:  # over all parents together
            orders = _order_names(config, relation.target)
            child = child.join(df.select(F.col(quoted(own)).alias("__parent")).distinct(), F.col(quoted(key)) == F.col("__parent"), "left_semi")
            child = child.orderBy(*(F.desc(quoted(n)) if d else F.asc(quoted(n)) for n, d in orders)).limit(config["limit"])
        else:
            child = of_parents(child, key, own)
        found = _gather(child, key, shown, _order_names(config, relation.target), config.get("limit_per_parent"))
    empty = F.coalesce(F.col("__items"), F.array().cast(found.schema["__items"].dataType))
    return df.join(found, F.col(quoted(own)) == F.col("__k"), "left").select(*keep, empty.alias(name))
