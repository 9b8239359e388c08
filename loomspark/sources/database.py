"""The session facade: table scans, queries, raw SQL and stores behind connection URLs."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from typing import Any
from urllib.parse import parse_qs, unquote, urlsplit

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import bound, column_of, quoted
from ..operators.query import Query
from ..operators.relations import Registry, TableQuery
from ..plans.sqltext import SqlText
from ..schema import TableDef
from .store import Store

DRIVERS = {"mysql": ("mysql", 3306), "postgres": ("postgresql", 5432), "postgresql": ("postgresql", 5432), "pgsql": ("postgresql", 5432)}


def parse_url(url: str) -> dict[str, Any]:
    """Parts of ``scheme://user:password@host:port/database?options``."""
    parts = urlsplit(url)
    if parts.scheme not in {*DRIVERS, "sqlite", "parquet", "memory", "supabase"}:
        raise ValueError(f"unknown scheme {parts.scheme!r}")
    return {"scheme": parts.scheme, "host": parts.hostname, "port": parts.port, "user": unquote(parts.username or ""), "password": unquote(parts.password or ""), "database": parts.path[1:] if parts.scheme in DRIVERS or parts.scheme == "supabase" else parts.path, "options": {k: v[-1] for k, v in parse_qs(parts.query).items()}}


def pooled_credentials(ref: str, password: str, database: str = "postgres", region: str = "us-east-1", pooling: bool = True) -> str:
    """JDBC URL of a hosted Postgres project: port 6543 behind the pooler, 5432 directly."""
    return f"postgresql://postgres.{ref}:{password}@aws-0-{region}.pooler.supabase.com:6543/{database}" if pooling else f"postgresql://postgres:{password}@db.{ref}.supabase.co:5432/{database}"


class Database:
    """Tables come from registered frames, from a folder of parquet files, from a versioned store or over JDBC."""

    def __init__(self, spark: SparkSession, folder: str | None = None, store: Store | None = None, jdbc: dict[str, Any] | None = None):
        self.spark, self.folder, self.store, self.jdbc = spark, folder, store, jdbc
        self.frames: dict[str, DataFrame] = {}
        self.registry = Registry()
        #: Table -> policy name -> condition; only tables in ``secured`` apply theirs.
        self.policies: dict[str, dict[str, Any]] = {}
        self.secured: set[str] = set()

    @classmethod
    def connect(cls, spark: SparkSession, url: str) -> Database:
        said = parse_url(url)
        if said["scheme"] in ("parquet", "sqlite"):
            return cls(spark, store=Store(spark, said["database"]))
        if said["scheme"] == "memory":
            shared = spark.conf.get("spark.checkpoint.dir", None)  # what all executors see; a local folder only where none is set
            if not shared:
                shared = tempfile.mkdtemp(prefix="loomspark-")
                atexit.register(shutil.rmtree, shared, True)
            return cls(spark, store=Store(spark, f"{shared}/memory-{uuid.uuid4().hex}"))
        kind, port = DRIVERS.get(said["scheme"], ("postgresql", 5432))
        return cls(spark, jdbc={"url": f"jdbc:{kind}://{said['host']}:{said['port'] or port}/{said['database']}", "user": said["user"], "password": said["password"], **said["options"]})

    def register(self, table: TableDef, df: DataFrame) -> None:
        self.frames[table.name] = df
        df.createOrReplaceTempView(table.name)

    def create_policy(self, table: TableDef, name: str, condition: Any) -> None:
        """Rows that any policy of a secured table lets through are visible in scans of it."""
        self.policies.setdefault(table.name, {})[name] = condition

    def enable_row_security(self, table: TableDef) -> None:
        self.secured.add(table.name)

    def disable_row_security(self, table: TableDef) -> None:
        self.secured.discard(table.name)

    def scan(self, table: TableDef) -> DataFrame:
        """The table with its columns under their code names; of a secured table, the visible rows."""
        df = self._whole(table)
        if table.name not in self.secured:
            return df
        visible = F.lit(False)
        for condition in self.policies.get(table.name, {}).values():
            visible = visible | column_of(condition)
        return df.alias(table.name).filter(visible)

    def _whole(self, table: TableDef) -> DataFrame:
        if table.name in self.frames:
            df = self.frames[table.name]
        elif self.store is not None and self.store.exists(table.name):
            return self.store.read(table.name)
        elif self.folder is not None:
            df = self.spark.read.parquet(f"{self.folder}/{table.name}.parquet")
        elif self.jdbc is not None:
            df = self.spark.read.format("jdbc").options(**self.jdbc, dbtable=table.full_name).load()
        else:
            df = self.spark.table(table.full_name)
        return df.select(*(F.col(quoted(c.stored)).alias(c.name) for c in table.columns.values()))

    def view(self, *tables: TableDef) -> None:
        """Makes tables known by name to raw SQL."""
        for t in tables:
            self.scan(t).createOrReplaceTempView(t.name)

    def select(self, *items: Any) -> Query:
        return Query(self).select(*items)

    def insert(self, table: TableDef) -> Query:
        return Query(self).insert(table)

    def update(self, table: TableDef) -> Query:
        return Query(self).update(table)

    def delete(self, table: TableDef) -> Query:
        return Query(self).delete(table)

    def sql(self, text: str = "", params: list[Any] | tuple = ()) -> SqlText:
        return SqlText(self.spark, text, params)

    def execute(self, text: str, params: list[Any] | tuple = ()) -> DataFrame:
        return self.spark.sql(bound(text, params))

    def query(self, text: str, params: list[Any] | tuple = ()) -> list[Row]:
        return self.execute(text, params).collect()

    def query_one(self, text: str, params: list[Any] | tuple = ()) -> Row | None:
        return self.execute(text, params).first()

    def query_table(self, table: TableDef) -> TableQuery:
        return TableQuery(self, table)

    def find_many(self, table: TableDef, **options: Any) -> DataFrame:
        return TableQuery(self, table).options(**options).find_many()

    def find_first(self, table: TableDef, **options: Any) -> Row | None:
        return TableQuery(self, table).options(**{k: v for k, v in options.items() if k not in ("limit", "offset")}).find_first()

    find_one = find_first

    def create_tables(self, *tables: TableDef) -> None:
        for t in tables:
            self._store.create(t)

    def drop_tables(self, *tables: TableDef) -> None:
        for t in tables:
            self._store.drop(t.name)

    def table_exists(self, name: str) -> bool:
        return name in self.frames or self.store is not None and self.store.exists(name) or self.spark.catalog.tableExists(name)

    @property
    def _store(self) -> Store:
        if self.store is None:
            raise RuntimeError("no store to write to")
        return self.store

    def begin_transaction(self) -> None:
        self._store.begin()

    def commit(self) -> None:
        self._store.commit()

    def rollback(self) -> None:
        self._store.rollback()

    def transaction(self, work: Any) -> Any:
        """Commits what ``work(db)`` did; rolls back and raises where it failed."""
        self.begin_transaction()
        try:
            out = work(self)
        except Exception:
            self.rollback()
            raise
        self.commit()
        return out
