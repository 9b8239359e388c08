"""Versioned changes of stored tables: blueprints, migrations with a ledger, differences and pushes.

A change that only touches metadata (a new nullable column without default, keys, comments) rewrites no rows; dropping,
renaming and retyping columns, and new columns with a default, rewrite the table in one distributed pass.
"""

from __future__ import annotations

import datetime as dt
import importlib.util
import os
import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import functions as F

from ..functions.expressions import asc, eq, quoted
from ..schema import ColumnDef, ForeignKey, TableDef, bigint, integer, serial, timestamp, varchar
from ..schema import table as table_of
from .dml import _default

LEDGER = table_of("migrations", {"id": serial(), "migration": varchar(255).not_null().unique(), "batch": integer().not_null(), "applied_at": timestamp().default("NOW()")})
#: Types that a database reports under several names.
SYNONYMS = {"int": "integer", "bool": "boolean", "serial": "integer", "bigserial": "bigint", "numeric": "decimal", "datetime": "timestamp"}


class Blueprint:
    """Collects the changes of one table."""

    def __init__(self, name: str):
        self.name = name
        self.added: dict[str, ColumnDef] = {}
        self.modified: dict[str, ColumnDef] = {}
        self.places: dict[str, str | None] = {}
        self.dropped: list[str] = []
        self.renamed: dict[str, str] = {}
        self.uniques: list[tuple[str, ...]] = []
        self.indexes: list[tuple[str, ...]] = []
        self.foreign: list[ForeignKey] = []
        self.keys: tuple[str, ...] = ()
        self.comment: str | None = None
        self.lost_indexes: list[tuple[str, ...]] = []
        self.lost_foreign: list[tuple[str, ...]] = []
        self.drop_key = False

    def column(self, name: str, column: ColumnDef, after: str | None = None, first: bool = False, change: bool = False) -> Blueprint:
        (self.modified if change else self.added)[name] = column
        if after or first:
            self.places[name] = after
        return self

    def id(self, name: str = "id") -> Blueprint:
        return self.column(name, replace(bigint().primary_key().auto_increment(), unsigned=True))

    def foreign_id(self, name: str, references: str | None = None, column: str = "id", on_delete: str = "cascade") -> Blueprint:
        """The table's name is inferred from ``x_id``: ``xs``, or ``ies`` in place of a final y."""
        stem = re.sub("_id$", "", name)
        there = references or (f"{stem[:-1]}ies" if stem.endswith("y") else f"{stem}s")
        self.foreign.append(ForeignKey((name,), there, (column,), on_delete))
        return self.column(name, replace(bigint(), unsigned=True))

    def timestamps(self) -> Blueprint:
        for name in ("created_at", "updated_at"):
            self.column(name, timestamp().default("NOW()"))
        return self

    def soft_deletes(self) -> Blueprint:
        return self.column("deleted_at", timestamp())

    def primary(self, *columns: str) -> Blueprint:
        self.keys = columns
        return self

    def unique(self, *columns: str) -> Blueprint:
        self.uniques.append(columns)
        return self

    def index(self, *columns: str) -> Blueprint:
        self.indexes.append(columns)
        return self

    def drop_columns(self, *names: str) -> Blueprint:
        self.dropped += names
        return self

    def rename_column(self, old: str, new: str) -> Blueprint:
        self.renamed[old] = new
        return self

    def drop_index(self, *columns: str) -> Blueprint:
        self.lost_indexes.append(columns)
        return self

    def drop_foreign(self, *columns: str) -> Blueprint:
        self.lost_foreign.append(columns)
        return self

    def drop_primary(self) -> Blueprint:
        self.drop_key = True
        return self

    def index_name(self, columns: tuple[str, ...], kind: str = "index") -> str:
        return f"{self.name}_{'_'.join(columns)}_{kind}"

    def applied(self, t: TableDef) -> TableDef:
        """The definition after the changes: foreign keys and indexes go first, then columns, then new keys."""
        foreign = tuple(f for f in t.foreign_keys if f.columns not in self.lost_foreign)
        indexes = tuple(i for i in t.indexes if i not in self.lost_indexes)
        uniques = tuple(u for u in t.uniques if u not in self.lost_indexes)
        if missing := [n for n in [*self.dropped, *self.renamed, *self.modified] if n not in t.columns]:
            raise ValueError(f"{t.name} has no columns {missing}")
        new = lambda names: tuple(self.renamed.get(n, n) for n in names)
        gone = lambda names: any(n in self.dropped for n in names)
        columns = {}
        for n, c in t.columns.items():
            if n not in self.dropped:
                c = self.modified.get(n, c)
                if (n,) in self.lost_foreign:
                    c = replace(c, references=None)
                if self.drop_key:
                    c = replace(c, is_primary=False)
                columns[self.renamed.get(n, n)] = replace(c, db_name=None) if n in self.renamed else c
        if clash := [n for n in self.added if n in columns]:
            raise ValueError(f"{t.name} already has columns {clash}")
        columns.update(self.added)
        for n in self.keys:
            columns[n] = columns[n].primary_key()
        for n, after in self.places.items():
            c = columns.pop(n)
            at = list(columns).index(after) + 1 if after else 0
            items = list(columns.items())
            columns = dict([*items[:at], (n, c), *items[at:]])
        return TableDef(
            t.name, columns, t.schema,
            tuple(new(u) for u in uniques if not gone(u)) + tuple(self.uniques),
            tuple(new(i) for i in indexes if not gone(i)) + tuple(self.indexes),
            tuple(replace(f, columns=new(f.columns)) for f in foreign if not gone(f.columns)) + tuple(self.foreign),
            self.comment or t.comment,
        )


class Schema:
    """Changes and inspects the tables of a database's store."""

    def __init__(self, db: Any):
        self.db, self.store = db, db._store

    def create(self, name: str, build: Callable[[Blueprint], Any]) -> TableDef:
        """Leaves a table that is there as it is."""
        build(b := Blueprint(name))
        t = b.applied(TableDef(name, {}))
        self.store.create(t)
        return t

    create_if_not_exists = create

    def alter(self, name: str, build: Callable[[Blueprint], Any]) -> TableDef:
        build(b := Blueprint(name))
        old = self.store.definition(name)
        t = b.applied(old)
        stays = not b.dropped and not b.renamed and all(c.spark_type == old.columns[n].spark_type for n, c in b.modified.items())
        if stays and not any(c.has_default for c in b.added.values()):
            self.store.redefine(name, t)
            return t
        rows, back = self.store.read(name), {new: old for old, new in b.renamed.items()}
        self.store.replace(name, rows.select(*((_default(c) if n in b.added else F.col(quoted(back.get(n, n)))).cast(c.spark_type).alias(n) for n, c in t.columns.items())), t)
        return t

    def drop(self, name: str) -> None:
        if not self.store.exists(name):
            raise ValueError(f"no table {name}")
        self.store.drop(name)

    def drop_if_exists(self, name: str) -> None:
        if self.store.exists(name):
            self.store.drop(name)

    def drop_all_tables(self) -> None:
        for name in self.store.names():
            self.store.drop(name)

    def rename(self, old: str, new: str) -> None:
        self.store.rename(old, new)

    def has_table(self, name: str) -> bool:
        return self.store.exists(name)

    def has_columns(self, name: str, *columns: str) -> bool:
        return self.store.exists(name) and set(columns) <= set(self.store.definition(name).columns)

    has_column = has_columns

    def get_tables(self) -> list[str]:
        return self.store.names()

    def get_columns(self, name: str) -> dict[str, ColumnDef]:
        return dict(self.store.definition(name).columns)

    def get_indexes(self, name: str) -> list[tuple[str, ...]]:
        return list(self.store.definition(name).indexes)

    def get_foreign_keys(self, name: str) -> list[ForeignKey]:
        return self.store.definition(name).references


class Migration:
    """One step: ``up`` and ``down`` change tables through ``self.schema``."""

    transactional = True

    def __init__(self, db: Any):
        self.db, self.schema = db, Schema(db)

    def up(self) -> None:
        raise NotImplementedError

    def down(self) -> None:
        raise NotImplementedError

    def seed(self, name: str, rows: list[dict[str, Any]]) -> None:
        self.db.insert(self.db.store.definition(name)).values(rows).execute()


class Migrator:
    """Runs migrations by sorted name, from a mapping or from the .py files of a folder (class ``Change`` in each)."""

    def __init__(self, db: Any, migrations: dict[str, type[Migration]] | str, ledger: TableDef = LEDGER):
        self.db, self.source, self.ledger = db, migrations, ledger
        db.create_tables(ledger)

    def known(self) -> dict[str, type[Migration]]:
        if not isinstance(self.source, str):
            return dict(sorted(self.source.items()))
        out = {}
        for file in sorted(f for f in os.listdir(self.source) if f.endswith(".py")):
            spec = importlib.util.spec_from_file_location(f"migration_{file[:-3]}", os.path.join(self.source, file))
            module = importlib.util.module_from_spec(spec)
            spec.loader.exec_module(module)
            out[file[:-3]] = module.Change
        return out

    def applied(self) -> list[Any]:
        return self.db.find_many(self.ledger, order_by=[asc(self.ledger["batch"]), asc(self.ledger["migration"])]).collect()

    def pending(self) -> list[str]:
        done = {r.migration for r in self.applied()}
        return [n for n in self.known() if n not in done]

    def _run(self, kind: type[Migration], down: bool, record: Callable[[], Any]) -> None:
        def work(_: Any = None) -> None:
            m = kind(self.db)
            m.down() if down else m.up()
            record()

        self.db.transaction(work) if kind.transactional else work()

    def migrate(self) -> list[str]:
        """Everything pending, as one batch."""
        batch, known, names = 1 + max((r.batch for r in self.applied()), default=0), self.known(), self.pending()
        for name in names:
            self._run(known[name], False, lambda name=name: self.db.insert(self.ledger).values({"migration": name, "batch": batch}).execute())
        return names

    def rollback(self, steps: int = 1) -> list[str]:
        """The last batches, latest first; 0: all. Names without a migration stay."""
        done, known = self.applied(), self.known()
        batches = sorted({r.batch for r in done}, reverse=True)[: steps or None]
        names = [r.migration for r in reversed(done) if r.batch in batches and r.migration in known]
        for name in names:
            self._run(known[name], True, lambda name=name: self.db.delete(self.ledger).where(eq(self.ledger["migration"], name)).execute())
        return names

    def reset(self) -> list[str]:
        return self.rollback(0)

    def refresh(self) -> list[str]:
        self.reset()
        return self.migrate()

    def status(self) -> list[dict[str, Any]]:
        done = {r.migration: r for r in self.applied()}
        return [{"name": n, "status": "Ran" if n in done else "Pending", "batch": done[n].batch if n in done else None, "ran_at": done[n].applied_at if n in done else None} for n in self.known()]

    def create(self, name: str, table: str | None = None) -> str:
        """Writes an empty migration file and returns its path."""
        os.makedirs(self.source, exist_ok=True)
        path = os.path.join(self.source, f"{dt.datetime.now():%Y_%m_%d_%H%M%S}_{name}.py")
        up = f'self.schema.create("{table}", lambda t: t.id().timestamps())' if table else "pass"
        down = f'self.schema.drop_if_exists("{table}")' if table else "pass"
        with open(path, "w") as file:
            file.write(f"from loomspark.sources.migrations import Migration\n\n\nclass Change(Migration):\n    def up(self):\n        {up}\n\n    def down(self):\n        {down}\n")
        return path


@dataclass
class Difference:
    """What turns stored definitions into wanted ones."""

    created: list[TableDef] = field(default_factory=list)
    dropped: list[str] = field(default_factory=list)
    added: dict[str, dict[str, ColumnDef]] = field(default_factory=dict)
    removed: dict[str, list[str]] = field(default_factory=dict)
    modified: dict[str, dict[str, tuple[ColumnDef, ColumnDef]]] = field(default_factory=dict)

    def __bool__(self) -> bool:
        return bool(self.created or self.dropped or self.added or self.removed or self.modified)

    def summary(self) -> list[str]:
        return [
            *(f"create table {t.name}" for t in self.created),
            *(f"drop table {n}" for n in self.dropped),
            *(f"add column {t}.{c}" for t, cs in self.added.items() for c in cs),
            *(f"drop column {t}.{c}" for t, cs in self.removed.items() for c in cs),
            *(f"modify column {t}.{c}" for t, cs in self.modified.items() for c in cs),
        ]


def _kind(c: ColumnDef) -> tuple:
    return SYNONYMS.get(c.type, c.type), c.length, c.is_nullable


def diff(db: Any, *wanted: TableDef) -> Difference:
    """Compares tables and columns (type, length, nullable); keys and indexes are not compared."""
    store, out = db._store, Difference()
    have = [n for n in store.names() if n != LEDGER.name]
    out.dropped = [n for n in have if n not in {t.name for t in wanted}]
    for t in wanted:
        if t.name not in have:
            out.created.append(t)
            continue
        old = store.definition(t.name).columns
        for target, found in (
            (out.added, {n: c for n, c in t.columns.items() if n not in old}),
            (out.removed, [n for n in old if n not in t.columns]),
            (out.modified, {n: (old[n], c) for n, c in t.columns.items() if n in old and _kind(old[n]) != _kind(c)}),
        ):
            if found:
                target[t.name] = found
    return out


def push(db: Any, *wanted: TableDef, force: bool = False, preview: bool = False) -> list[str]:
    """Applies the difference and returns what was done; only ``force`` drops anything, and changed types are only reported."""
    d, schema, said = diff(db, *wanted), Schema(db), []
    said += [f"create table {t.name}" for t in d.created]
    said += [f"add column {t}.{c}" for t, cs in d.added.items() for c in cs]
    said += [f"modify column {t}.{c} by hand" for t, cs in d.modified.items() for c in cs]
    if force:
        said += [f"drop column {t}.{c}" for t, cs in d.removed.items() for c in cs] + [f"drop table {n}" for n in d.dropped]
    if preview:
        return said

    def work(_: Any) -> None:
        db.create_tables(*d.created)
        for name in {**d.added, **(d.removed if force else {})}:

            def build(b: Blueprint, name: str = name) -> None:
                for n, c in d.added.get(name, {}).items():
                    b.column(n, c)
                if force:
                    b.drop_columns(*d.removed.get(name, []))

            schema.alter(name, build)
        for name in d.dropped if force else []:
            schema.drop(name)

    db.transaction(work)
    return said


def table_code(t: TableDef) -> str:
    """Python source of a definition."""
    shown = {n: replace(c, name="") for n, c in t.columns.items()}
    fields = {n: {k: v for k in c.__dataclass_fields__ if k != "type" and (v := getattr(c, k)) != c.__dataclass_fields__[k].default} for n, c in shown.items()}
    lines = [f"    {n!r}: ColumnDef({', '.join([repr(shown[n].type), *(f'{k}={v!r}' for k, v in f.items())])})," for n, f in fields.items()]
    more = "".join(f", {k}={v!r}" for k in ("schema", "uniques", "indexes", "foreign_keys", "comment") if (v := getattr(t, k)))
    return "\n".join([f"{re.sub(r'\W', '_', t.name).upper()} = TableDef({t.name!r}, {{", *lines, f"}}{more})"])


def squash(migrator: Migrator) -> str:
    """One migration file that makes all stored tables, in place of those in the folder, which move to ``archived``.

    The ledger then holds the new migration alone, as its work is done.
    """
    db, folder = migrator.db, migrator.source
    if not isinstance(folder, str):
        raise ValueError("only a folder of migrations can be squashed")
    if waiting := migrator.pending():
        raise RuntimeError(f"not applied yet: {waiting}")
    tables = [db.store.definition(n) for n in db.store.names() if n != migrator.ledger.name]
    code = "\n\n".join(map(table_code, tables))
    names = [re.sub(r"\W", "_", t.name).upper() for t in tables]
    os.makedirs(os.path.join(folder, "archived"), exist_ok=True)
    for name in migrator.known():
        os.rename(os.path.join(folder, f"{name}.py"), os.path.join(folder, "archived", f"{name}.py"))
    new = f"{dt.datetime.now():%Y_%m_%d_%H%M%S}_squashed"
    path = os.path.join(folder, f"{new}.py")
    with open(path, "w") as file:
        file.write(f"from loomspark.schema import ColumnDef, ForeignKey, TableDef\nfrom loomspark.sources.migrations import Migration\n\n{code}\n\nTABLES = [{', '.join(names)}]\n\n\nclass Change(Migration):\n    def up(self):\n        self.db.create_tables(*TABLES)\n\n    def down(self):\n        self.db.drop_tables(*TABLES)\n")

    def work(_: Any) -> None:
        db.delete(migrator.ledger).execute()
        db.insert(migrator.ledger).values({"migration": new, "batch": 1}).execute()

    db.transaction(work)
    return path
