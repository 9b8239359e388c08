"""INSERT, UPDATE, DELETE and upserts as copy-on-write plans, with the constraints of the table's definition."""

from __future__ import annotations

import datetime as dt
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import Expr, column_of, literal_sql, quoted
from ..operators.query import Query
from ..schema import TableDef

NOW = {"NOW()": "localtimestamp()", "CURRENT_TIMESTAMP": "localtimestamp()", "CURRENT_DATE": "current_date()", "UUID()": "uuid()"}


class ConstraintError(ValueError):
    """Not-null, unique or foreign-key violation."""


def _value(v: Any, kind: T.DataType) -> Column:
    if isinstance(v, Expr | Column):
        return column_of(v).cast(kind)
    if isinstance(v, bool) or v is None or isinstance(v, int | float | str | bytes | dt.date):
        return F.expr(literal_sql(v)).cast(kind)
    return F.lit(v).cast(kind)


def _default(c: Any) -> Column:
    if not c.has_default:
        return F.lit(None).cast(c.spark_type)
    if isinstance(c.default_value, str) and c.default_value.upper() in NOW:
        return F.expr(NOW[c.default_value.upper()]).cast(c.spark_type)
    return _value(c.default_value, c.spark_type)


PLAIN = {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType(), bytes: T.BinaryType(), dt.date: T.DateType(), dt.datetime: T.TimestampNTZType()}


def _local(spark: Any, rows: list[dict[str, Any]], given: list[str], table: TableDef) -> DataFrame:
    """Given values with their numbers: one local relation where each column's values are plain and of one type."""
    kinds = {k: {type(r.get(k)) for r in rows} - {type(None)} for k in given}
    if all(len(v) < 2 and v <= set(PLAIN) for v in kinds.values()) and all(abs(r.get(k) or 0) < 1 << 63 for r in rows for k in given if kinds[k] == {int}):
        schema = T.StructType([*(T.StructField(k, PLAIN[next(iter(kinds[k]))] if kinds[k] else T.StringType()) for k in given), T.StructField("__n", T.LongType())])
        return spark.createDataFrame([(*(r.get(k) for k in given), i) for i, r in enumerate(rows)], schema)
    one = spark.range(1)
    return reduce(DataFrame.unionByName, (one.select(*(_value(r.get(k), table.columns[k].spark_type).alias(k) for k in given), F.lit(i).cast("long").alias("__n")) for i, r in enumerate(rows)))


def _numbered(store: Any, df: DataFrame) -> tuple[DataFrame, str]:
    """A frame's rows as staged files with ``__n``, their numbers without gaps; and the folder. Counts come one a partition."""
    path = store.stage(df.withColumn("__at", F.monotonically_increasing_id()))
    staged = store.spark.read.parquet(path)
    part = F.shiftright("__at", 33)
    sizes = staged.groupBy(part.alias("part")).count().collect()  # a row for each partition
    first, at = {}, 0
    for r in sorted(sizes, key=lambda r: r.part):
        first[r.part], at = at, at + r["count"]
    if not first:
        return staged.withColumnRenamed("__at", "__n"), path
    offsets = F.broadcast(store.spark.createDataFrame([(k, v) for k, v in first.items()], "__part long, __first long"))
    rows = staged.join(offsets, part == F.col("__part")).withColumn("__n", F.col("__first") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)))
    return rows.drop("__part", "__first", "__at"), path


def _new_rows(query: Query, table: TableDef, store: Any, next_id: int) -> tuple[DataFrame, str | None]:
    """Rows in the table's columns and ``__n``, their order; the first row's keys are the columns, as in a multi-row INSERT."""
    spark, rows = query.db.spark, query.rows
    if rows is None or isinstance(rows, list) and not rows:
        raise ValueError("no values")
    ident, path = table.identity, None
    given = rows.columns if isinstance(rows, DataFrame) else list(rows[0])
    if unknown := [k for k in given if k not in table.columns]:
        raise ValueError(f"unknown columns {unknown}")
    if isinstance(rows, DataFrame):
        df, path = _numbered(store, rows)
    else:
        df = _local(spark, rows, given, table)
    out = []
    for n, c in table.columns.items():
        col = F.col(quoted(n)).cast(c.spark_type) if n in given else _default(c)
        if n == ident:
            col = F.coalesce(col, F.col("__n") + next_id).cast(c.spark_type)
        out.append(col.alias(n))
    return df.select(*out, "__n"), path


def _check(db: Any, table: TableDef, df: DataFrame, others: DataFrame | None) -> None:
    """df: changed rows; others: rows that stay."""
    need = [n for n, c in table.columns.items() if not c.is_nullable]
    limits = [(n, c.length) for n, c in table.columns.items() if c.type in ("varchar", "char") and c.length]
    bad = F.lit(False)
    for n in need:
        bad = bad | F.col(quoted(n)).isNull()
    for n, most in limits:
        bad = bad | F.coalesce(F.length(quoted(n)) > most, F.lit(False))
    if (need or limits) and df.filter(bad).limit(1).count():
        raise ConstraintError(f"{table.name}: null or too long value")
    for key in table.unique_keys:
        cols = [F.col(quoted(k)) for k in key]
        both = df.select(*cols) if others is None else df.select(*cols).unionByName(others.select(*cols))
        if both.dropna().groupBy(*cols).count().filter("count > 1").limit(1).count():
            raise ConstraintError(f"{table.name}: duplicate {', '.join(key)}")
    for fk in table.references:
        if db.store.exists(fk.table):
            there = db.store.read(fk.table).select(*(F.col(quoted(b)).alias(f"__{i}") for i, b in enumerate(fk.references)))
            mine = df.select(*(F.col(quoted(a)).alias(a) for a in fk.columns)).dropna()
            on = [F.col(quoted(a)) == F.col(f"__{i}") for i, a in enumerate(fk.columns)]
            if fk.table == table.name:  # its own rows, as they will be
                own = df if others is None else df.unionByName(others)
                there = own.select(*(F.col(quoted(b)).alias(f"__{i}") for i, b in enumerate(fk.references)))
            if mine.join(there, on, "left_anti").limit(1).count():
                raise ConstraintError(f"{table.name}: no such {fk.table}")


def execute(query: Query) -> Any:
    db, table = query.db, query.table
    store = db._store
    current = store.read(table.name).alias(table.name)
    if query.kind == "insert":
        return _insert(query, table, store, current)
    condition = F.coalesce(column_of(query.condition), F.lit(False)) if query.condition is not None else F.lit(True)
    if query.kind == "update":
        if not query.changes:
            raise ValueError("nothing to set")
        changes = dict(query.changes)
        if unknown := [k for k in changes if k not in table.columns]:
            raise ValueError(f"unknown columns {unknown}")
        new = current.select(*(F.when(condition, _value(changes[n], c.spark_type)).otherwise(F.col(f"{quoted(table.name)}.{quoted(n)}")).alias(n) if n in changes else F.col(f"{quoted(table.name)}.{quoted(n)}") for n, c in table.columns.items()), condition.alias("__hit"))
        new = new.persist()
        try:
            n = new.filter("__hit").count()
            if n:
                _check(db, table, new.filter("__hit").drop("__hit"), new.filter("not __hit").drop("__hit"))
                store.replace(table.name, new.drop("__hit"))
            return _returned(query, new.filter("__hit").drop("__hit"), n)
        finally:
            if query.wanted is None:
                new.unpersist()
    hit, stay = current.filter(condition), current.filter(~condition)
    if query.n is not None:  # by the given order, then by the key
        if not table.primary_key:
            raise ValueError(f"a limited DELETE needs a primary key of {table.name}")
        keys = hit.orderBy(*(o.column() for o in query.orders), *(quoted(k) for k in table.primary_key)).limit(query.n).select(*(F.col(quoted(k)).alias(f"__{i}") for i, k in enumerate(table.primary_key)))
        on = [F.col(quoted(k)) == F.col(f"__{i}") for i, k in enumerate(table.primary_key)]
        hit, stay = current.join(keys, on, "left_semi"), current.join(keys, on, "left_anti")
    n = hit.count()
    out = _returned(query, hit, n)
    if n:
        store.begin()
        try:
            hit, stay = _own_references(table, hit, stay)
            _cascade(db, table, hit)
            store.replace(table.name, stay)
        except Exception:
            store.rollback()
            raise
        store.commit()
    return out


def _own_references(table: TableDef, gone: DataFrame, stay: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Actions of the table's references to itself: all rows that go, and those that stay."""
    for fk in table.references:
        if fk.table != table.name:
            continue
        new, on = gone, [F.col(quoted(a)) == F.col(f"__{i}") for i, a in enumerate(fk.columns)]
        while True:
            keys = new.select(*(F.col(quoted(b)).alias(f"__{i}") for i, b in enumerate(fk.references))).distinct()
            new = stay.join(keys, on, "left_semi")
            if not new.limit(1).count():
                break
            if fk.on_delete in ("restrict", "no action"):
                raise ConstraintError(f"{table.name} refers to itself")
            if fk.on_delete == "set null":
                marked = stay.join(keys, on, "left")
                stay = marked.select(*(F.when(F.col("__0").isNotNull(), F.lit(None)).otherwise(F.col(quoted(n))).alias(n) if n in fk.columns else F.col(quoted(n)) for n in table.columns))
                break
            gone, stay = gone.unionByName(new), stay.join(keys, on, "left_anti")
    return gone, stay


def _cascade(db: Any, table: TableDef, gone: DataFrame) -> None:
    """Foreign-key actions of deleted rows, table by table."""
    store = db.store
    for name in store.names():
        child = store.definition(name)
        for fk in child.references:
            if fk.table != table.name or name == table.name:
                continue
            keys = gone.select(*(F.col(quoted(b)).alias(f"__{i}") for i, b in enumerate(fk.references))).distinct()
            rows = store.read(name)
            on = [F.col(quoted(a)) == F.col(f"__{i}") for i, a in enumerate(fk.columns)]
            hit = rows.join(keys, on, "left_semi")
            if not hit.limit(1).count():
                continue
            if fk.on_delete in ("restrict", "no action"):
                raise ConstraintError(f"{name} refers to {table.name}")
            if fk.on_delete == "set null":
                marked = rows.join(keys, on, "left")
                store.replace(name, marked.select(*(F.when(F.col("__0").isNotNull(), F.lit(None)).otherwise(F.col(quoted(n))).alias(n) if n in fk.columns else F.col(quoted(n)) for n in child.columns)))
            else:
                _cascade(db, child, hit)
                store.replace(name, rows.join(keys, on, "left_anti"))


def _returned(query: Query, df: DataFrame, n: int) -> Any:
    if query.wanted is None:
        return n
    return df.select(*[x if isinstance(x, str) else x.name for x in query.wanted] or ["*"])


def _insert(query: Query, table: TableDef, store: Any, current: DataFrame) -> Any:
    new, path = _new_rows(query, table, store, store.next_id(table.name))
    new = new.persist()
    try:
        return _insert_rows(query, table, store, current, new)
    finally:
        if query.wanted is None:  # what is returned reads them later
            new.unpersist()
            if path:
                store.unstage(path)


def _first_of(new: DataFrame, key: tuple[str, ...], names: list[str]) -> DataFrame:
    """Of rows with equal keys the first; rows with a null in the key are equal to none."""
    whole = reduce(lambda a, b: a & b, (F.col(quoted(k)).isNotNull() for k in key))
    row = F.struct("__n", *(F.col(quoted(n)) for n in names))
    first = new.filter(whole).groupBy(*(F.col(quoted(k)).alias(f"__k{i}") for i, k in enumerate(key))).agg(F.min_by(row, "__n").alias("__r"))
    return first.select("__r.*").unionByName(new.filter(~whole).select("__n", *map(quoted, names)))


def _insert_rows(query: Query, table: TableDef, store: Any, current: DataFrame, new: DataFrame) -> Any:
    ident, names = table.identity, list(table.columns)

    def last_of(df: DataFrame) -> int:
        return (df.agg(F.max(quoted(ident))).first()[0] if ident else None) or 0

    if query.conflict is None:
        rows = new.drop("__n")
        _check(query.db, table, rows, current)
        last = last_of(rows)
        store.append(table.name, rows, max(store.next_id(table.name), last + 1))
        return _returned(query, rows, last)
    kind, target, changes = query.conflict
    keys = [target] if target else table.unique_keys
    fresh = new
    for key in keys:  # the first of equal new rows stays; a null meets no stored row
        there = current.select(*(F.col(quoted(k)).alias(f"__k{i}") for i, k in enumerate(key)))
        fresh = _first_of(fresh, key, names).join(there, [F.col(quoted(k)) == F.col(f"__k{i}") for i, k in enumerate(key)], "left_anti")
    fresh = fresh.select(*map(quoted, names)).persist()
    try:
        last = last_of(fresh)
        nxt = max(store.next_id(table.name), last + 1)
        if kind == "nothing":
            _check(query.db, table, fresh, current)
            store.append(table.name, fresh, nxt)
            return _returned(query, fresh, last)
        key, changes = keys[0], dict(changes)
        if unknown := [k for k in changes if k not in table.columns]:
            raise ValueError(f"unknown columns {unknown}")
        excluded = _first_of(new, key, names).drop("__n").alias("excluded")
        on = [F.col(f"{quoted(table.name)}.{quoted(k)}") == F.col(f"excluded.{quoted(k)}") for k in key]
        met = F.col(f"excluded.{quoted(key[0])}").isNotNull()
        joined = current.join(excluded, on, "left").select(*(F.when(met, _value(changes[c], d.spark_type)).otherwise(F.col(f"{quoted(table.name)}.{quoted(c)}")).alias(c) if c in changes else F.col(f"{quoted(table.name)}.{quoted(c)}") for c, d in table.columns.items()), met.alias("__met"))
        whole = joined.drop("__met").unionByName(fresh)
        _check(query.db, table, whole, None)
        # rows as they are stored, under the ids of the rows that were there
        touched = joined.filter("__met").drop("__met").unionByName(fresh)
        last = last_of(touched)
        store.replace(table.name, whole)
        store.advance(table.name, nxt)
        return _returned(query, touched, last)
    finally:
        if query.wanted is None:
            fresh.unpersist()
