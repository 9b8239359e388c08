"""Type hierarchies over a base table and a table for each type, joined in one plan."""

from __future__ import annotations

from dataclasses import dataclass
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import eq, quoted
from ..functions.text import citation
from ..schema import TableDef

if TYPE_CHECKING:
    from ..sources.database import Database


@dataclass(frozen=True)
class TypeNode:
    """A type's own table; ``fk`` refers to the parent level's key; children are types below it."""

    name: str
    table: TableDef
    fk: str
    children: tuple[TypeNode, ...] = ()
    key: str = "id"


def is_type(name: str, column: str = "type") -> Column:
    return F.col(column) == name


def is_in_hierarchy(ancestor: str, column: str = "type_path", strict: bool = False) -> Column:
    """Whether the path contains the text; strictly: has it as a level."""
    return F.array_contains(F.split(column, "/"), ancestor) if strict else F.contains(F.col(column), F.lit(ancestor))


def _below(node: TypeNode) -> list[str]:
    return [node.name, *(x for c in node.children for x in _below(c))]


def with_delegates(db: Database, base: TableDef, nodes: list[TypeNode], depth: int = 10, key: str = "id", type_column: str = "type") -> DataFrame:
    """Base rows with one nullable struct column ``_<type>`` for each type of the tree; the last row of a key wins.

    Where the base has a type column, a row gets the levels of its own type and of those above it alone, whatever other
    tables hold under its key.
    """
    df = db.scan(base)
    typed = type_column in base.columns

    def attach(df: DataFrame, nodes: tuple[TypeNode, ...] | list[TypeNode], parent: Column, left: int) -> DataFrame:
        for n in nodes if left else ():
            rows = db.scan(n.table)
            order = F.col(quoted(n.key)) if n.key in n.table.columns else F.lit(0)
            own = rows.groupBy(F.col(quoted(n.fk)).alias("__k")).agg(F.max_by(F.struct(*(F.col(quoted(c)).alias(c) for c in n.table.columns)), order).alias(f"_{n.name}"))
            mine = F.col(quoted(type_column)).isin(_below(n)) if typed else F.lit(True)
            df = df.join(own, mine & (parent == F.col("__k")), "left").drop("__k")
            if n.children:
                df = attach(df, n.children, F.col(f"_{n.name}.{n.key}"), left - 1)
        return df

    return attach(df, nodes, F.col(quoted(key)), depth)


def coalesced(nodes: list[TypeNode] | tuple[TypeNode, ...], name: str, base: TableDef | None = None) -> Column:
    """First non-null value of a column from the root to the leaves; null where no level has it."""
    found = [F.col(quoted(name))] if base is not None and name in base.columns else []

    def walk(nodes) -> None:
        for n in nodes:
            if name in n.table.columns:
                found.append(F.col(f"_{n.name}.{quoted(name)}"))
            walk(n.children)

    walk(nodes)
    return F.coalesce(*found) if found else F.lit(None)


def create_chain(db: Database, levels: list[tuple[str, TableDef, str | None, dict]]) -> list[int]:
    """Inserts a row for each level in one transaction: (type, table, foreign key or None for the root, values)."""
    if len(levels) < 2:
        raise ValueError("a chain has two levels or more")
    ids: list[int] = []

    def work(db: Database) -> None:
        for i, (_, table, fk, values) in enumerate(levels):
            row = {**values, **({fk: ids[-1]} if fk else {"type": levels[-1][0], "type_path": "/".join(x[0] for x in levels)} if i == 0 else {})}
            ids.append(db.insert(table).values(row).execute())

    db.transaction(work)
    return ids


def update_chain(db: Database, levels: list[tuple[TableDef, int, dict]], key: str = "id") -> int:
    """Sets values on the rows of a chain in one transaction: (table, key, values); levels without values stay."""
    return db.transaction(lambda db: sum(db.update(table).set(values).where(eq(table[key], at)).execute() for table, at, values in levels if values))


def delete_chain(db: Database, levels: list[tuple[TableDef, int]], key: str = "id") -> int:
    """Deletes the rows of a chain in one transaction, from the leaf to the root; levels come from the root."""
    return db.transaction(lambda db: sum(db.delete(table).where(eq(table[key], at)).execute() for table, at in reversed(levels)))


def serialized(base: TableDef, nodes: list[TypeNode] | tuple[TypeNode, ...]) -> Column:
    """JSON of a row of ``with_delegates``: ``_type``, ``_data`` and ``_delegate`` by level; null values are left out."""

    def delegate(nodes) -> Column:
        found = [F.when(F.col(f"_{n.name}").isNotNull(), F.parse_json(F.to_json(F.struct(*level(n.name, F.col(f"_{n.name}"), n.children))))) for n in nodes]
        return F.coalesce(*found)

    def level(name: str, data: Column, nodes) -> list[Column]:
        return [F.lit(name).alias("_type"), data.alias("_data"), *([delegate(nodes).alias("_delegate")] if nodes else [])]

    return F.to_json(F.struct(*level(base.name, F.struct(*(F.col(quoted(c)) for c in base.columns)), nodes)))


def parsed(text: Column, base: TableDef, nodes: list[TypeNode] | tuple[TypeNode, ...]) -> Column:
    """The struct of a row of ``with_delegates`` (base columns and ``_<type>`` of each type) from JSON of ``serialized``.

    Types that no node names, and levels that the text lacks, are null; text that is no JSON gives null.
    """

    def level(json: Column, table: TableDef) -> Column:
        return F.from_json(F.get_json_object(json, "$._data"), T.StructType([T.StructField(f.name, f.dataType) for f in table.spark_schema]), {"mode": "PERMISSIVE"})

    def delegates(json: Column, nodes) -> list[Column]:
        own = F.get_json_object(json, "$._delegate")
        found = []
        for n in nodes:
            here = F.when(F.get_json_object(own, "$._type") == n.name, own)
            found += [level(here, n.table).alias(f"_{n.name}"), *delegates(here, n.children)]
        return found

    root = level(text, base)
    return F.when(root.isNotNull(), F.struct(*(root[c].alias(c) for c in base.columns), *delegates(text, nodes)))


def by_role(contributions: DataFrame, role: str, work: str = "work_id", position: str = "position") -> DataFrame:
    """Contributions of one role, numbered within their work in the order of ``position``."""
    w = Window.partitionBy(work).orderBy(F.col(quoted(position)).asc_nulls_first())
    return contributions.filter(F.col("role") == role).withColumn("place", F.row_number().over(w))


def citation_authors(contributions: DataFrame, agents: DataFrame, work: str = "work_id", agent: str = "agent_id", key: str = "id", name: str = "name", position: str = "position") -> DataFrame:
    """(work, citation): names of a work's agents in the order of ``position``, as *A, B & C*.

    One aggregation by work after the join; a work without agents has no row. An agent that contributes twice is named
    twice.
    """
    named = contributions.alias("c").join(agents.alias("a"), F.col(f"c.{quoted(agent)}") == F.col(f"a.{quoted(key)}"))
    one = F.struct(F.col(f"c.{quoted(position)}").alias("p"), F.col(f"c.{quoted(agent)}").alias("k"), F.col(f"a.{quoted(name)}").alias("n"))
    grouped = named.select(F.col(f"c.{quoted(work)}").alias(work), one.alias("x")).groupBy(work).agg(F.sort_array(F.collect_list("x")).alias("xs"))
    return grouped.select(work, citation(F.col("xs.n")).alias("citation"))
