"""An immutable query builder that compiles to one DataFrame."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import Expr, column_of, order_of, quoted
from ..schema import ColumnRef, TableDef

if TYPE_CHECKING:
    from ..sources.database import Database


@dataclass(frozen=True)
class Query:
    """Setters return copies. ``where`` and ``having`` hold one condition, the last one set; the others accumulate."""

    db: Database
    kind: str = "select"
    items: tuple[Any, ...] = ()
    table: TableDef | None = None
    joins: tuple[tuple[str, TableDef, Any], ...] = ()
    condition: Any = None
    groups: tuple[Any, ...] = ()
    group_condition: Any = None
    orders: tuple[Any, ...] = ()
    n: int | None = None
    skip: int | None = None
    rows: Any = None
    changes: tuple[tuple[str, Any], ...] = ()
    conflict: tuple[str, tuple[str, ...] | None, tuple[tuple[str, Any], ...]] | None = None
    wanted: tuple[Any, ...] | None = None

    def select(self, *items: Any) -> Query:
        return replace(self, kind="select", items=items)

    def from_(self, table: TableDef) -> Query:
        return replace(self, table=table)

    def where(self, condition: Any) -> Query:
        return replace(self, condition=condition)

    def _join(self, how: str, table: TableDef, on: Any) -> Query:
        return replace(self, joins=(*self.joins, (how, table, on)))

    def inner_join(self, table: TableDef, on: Any) -> Query:
        return self._join("inner", table, on)

    def left_join(self, table: TableDef, on: Any) -> Query:
        return self._join("left", table, on)

    def right_join(self, table: TableDef, on: Any) -> Query:
        return self._join("right", table, on)

    def full_join(self, table: TableDef, on: Any) -> Query:
        return self._join("full", table, on)

    def cross_join(self, table: TableDef) -> Query:
        return self._join("cross", table, None)

    def group_by(self, *xs: Any) -> Query:
        return replace(self, groups=(*self.groups, *xs))

    def having(self, condition: Any) -> Query:
        return replace(self, group_condition=condition)

    def order_by(self, *xs: Any) -> Query:
        return replace(self, orders=(*self.orders, *map(order_of, xs)))

    def limit(self, n: int) -> Query:
        return replace(self, n=n)

    def offset(self, n: int) -> Query:
        return replace(self, skip=n)

    # data changes
    def insert(self, table: TableDef) -> Query:
        return replace(self, kind="insert", table=table)

    def values(self, rows: Any) -> Query:
        """A mapping, a list of mappings, or a DataFrame."""
        return replace(self, rows=[rows] if isinstance(rows, dict) else rows)

    def on_conflict_do_nothing(self, *target: str) -> Query:
        return replace(self, conflict=("nothing", target or None, ()))

    def on_conflict_do_update(self, target: list[str], changes: dict[str, Any]) -> Query:
        """In raw values the new row is ``excluded``."""
        return replace(self, conflict=("update", tuple(target), tuple(changes.items())))

    def update(self, table: TableDef) -> Query:
        return replace(self, kind="update", table=table)

    def set(self, changes: dict[str, Any]) -> Query:
        return replace(self, changes=(*self.changes, *changes.items()))

    def delete(self, table: TableDef) -> Query:
        return replace(self, kind="delete", table=table)

    def returning(self, *items: Any) -> Query:
        return replace(self, wanted=items)

    def execute(self) -> Any:
        """A DataFrame for SELECT and RETURNING, the last id of INSERT, the number of rows of UPDATE and DELETE."""
        if self.table is None:
            raise ValueError("no table")
        if self.kind == "select":
            return self.df()
        from ..sources import dml

        return dml.execute(self)

    def df(self) -> DataFrame:
        """The query as a lazy DataFrame."""
        if self.table is None:
            raise ValueError("no table")
        out = self.db.scan(self.table).alias(self.table.name)
        for how, table, on in self.joins:
            right = self.db.scan(table).alias(table.name)
            out = out.crossJoin(right) if how == "cross" else out.join(right, column_of(on), how)
        if self.condition is not None:
            out = out.filter(column_of(self.condition))
        if self.groups or any(isinstance(x, Expr) and x.aggregate for x in self.items):
            out = self._grouped(out)
        else:
            aliases = {x.alias for x in self.items if isinstance(x, Expr) and x.alias}
            late = [o for o in self.orders if isinstance(o.by, str) and o.by in aliases]
            if self.orders and not late:
                out = out.orderBy(*(o.column() for o in self.orders))
            out = out.select(*self._projection())
            if late:
                out = out.orderBy(*(o.column(F.col(o.by if isinstance(o.by, str) else o.by.name)) for o in self.orders))
        if self.skip is not None:
            out = out.offset(self.skip)
        return out if self.n is None else out.limit(self.n)

    def _projection(self) -> list:
        if self.items:
            return [_item(x) for x in self.items]
        if not self.joins:
            return ["*"]
        # of equal names the right-most stays, at the place of the first
        owner = {c: t.name for t in (self.table, *(t for _, t, _ in self.joins)) for c in t.columns}
        return [F.col(f"{quoted(t)}.{quoted(c)}") for c, t in owner.items()]

    def _grouped(self, df: DataFrame) -> DataFrame:
        """Columns that are neither grouped nor aggregated take any value of their group."""
        keys = [column_of(g).alias(f"__g{i}") for i, g in enumerate(self.groups)]
        of = {_key(g): f"__g{i}" for i, g in enumerate(self.groups)}
        made, shown, hidden = [], [], []
        for i, x in enumerate(self.items or self.groups):
            name = _name(x)
            if _key(x) in of:
                shown.append(F.col(of[_key(x)]).alias(name))
            else:
                own = column_of(x)
                made.append((own if isinstance(x, Expr) and (x.aggregate or x.text) or isinstance(x, str) else F.any_value(own)).alias(f"__a{i}"))
                shown.append(F.col(f"__a{i}").alias(name))
        names = {_name(x) for x in (self.items or self.groups)}
        orders = []
        for i, o in enumerate(self.orders):
            if _key(o.by) in of:
                orders.append((o, of[_key(o.by)]))
            elif isinstance(o.by, str) and o.by in names:
                orders.append((o, o.by))
            else:
                own = column_of(o.by)
                hidden.append((own if isinstance(o.by, Expr | str) else F.any_value(own)).alias(f"__o{i}"))
                orders.append((o, f"__o{i}"))
        late = None
        if self.group_condition is not None:
            if isinstance(self.group_condition, Expr) and self.group_condition.aggregate:
                hidden.append(self.group_condition.column.alias("__h"))
                late = F.col("__h")
            else:
                late = column_of(self.group_condition)
        if not made + hidden:
            hidden.append(F.count(F.lit(1)).alias("__n"))
        out = df.groupBy(*keys).agg(*made, *hidden)
        extra = [F.col(c) for c in out.columns if c.startswith("__")]
        out = out.select(*shown, *extra)
        if late is not None:
            out = out.filter(late)
        if orders:
            out = out.orderBy(*(o.column(F.col(quoted(c))) for o, c in orders))
        return out.select(*(F.col(quoted(_name(x))) for x in (self.items or self.groups)))


def _item(x: Any):
    return x.named if isinstance(x, Expr) else column_of(x)


def _key(x: Any) -> Any:
    if isinstance(x, ColumnRef):
        return (x.table, x.name)
    return x.text if isinstance(x, Expr) and x.text else x if isinstance(x, str) else id(x)


def _name(x: Any) -> str:
    if isinstance(x, ColumnRef):
        return x.name
    if isinstance(x, Expr) and x.alias:
        return x.alias
    if isinstance(x, str):
        return x
    raise ValueError("an expression of a grouped query needs a name")
