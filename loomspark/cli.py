"""Command line: ``python -m loomspark.cli --store DIR --migrations DIR COMMAND``."""

from __future__ import annotations

import argparse
import importlib.util
import os
import sys
from typing import Any

from pyspark.sql import SparkSession

from .schema import TableDef
from .sources.database import Database
from .sources.migrations import LEDGER, Migrator, diff, push, squash, table_code

HEADER = "from loomspark.schema import ColumnDef, ForeignKey, TableDef\n\n"


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="loomspark")
    out.add_argument("--store", required=True, help="folder of the versioned tables")
    out.add_argument("--migrations", default="migrations", help="folder of migration files")
    out.add_argument("-q", "--quiet", action="store_true")
    commands = out.add_subparsers(dest="command", required=True)
    for name in ("migrate", "migrate:status"):
        commands.add_parser(name)
    commands.add_parser("migrate:rollback").add_argument("--steps", type=int, default=1)
    for name in ("migrate:reset", "migrate:refresh"):
        commands.add_parser(name).add_argument("--force", action="store_true")
    make = commands.add_parser("make:migration")
    make.add_argument("name")
    make.add_argument("--table")
    commands.add_parser("db:pull").add_argument("--output")
    for name in ("db:push", "db:diff"):
        one = commands.add_parser(name)
        one.add_argument("--schema", required=True, help="Python file of table definitions")
        if name == "db:push":
            one.add_argument("--dry-run", action="store_true")
            one.add_argument("--force", action="store_true")
    commands.add_parser("db:squash").add_argument("--force", action="store_true")
    return out


def definitions(path: str) -> list[TableDef]:
    """The table definitions at the top level of a Python file."""
    spec = importlib.util.spec_from_file_location("loomspark_schema_file", path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return [x for x in vars(module).values() if isinstance(x, TableDef)]


def run(spark: SparkSession, arguments: list[str]) -> list[str]:
    """Carries out a command and returns the lines it prints."""
    said = parser().parse_args(arguments)
    db = Database.connect(spark, f"parquet://{os.path.abspath(said.store)}")
    name: str = said.command
    if name in ("migrate:reset", "migrate:refresh", "db:squash") and not said.force:
        return [f"{name} needs --force"]
    if name.startswith(("migrate", "make", "db:squash")):
        return _migrations(name, Migrator(db, said.migrations) if name == "make:migration" or os.path.isdir(said.migrations) else Migrator(db, {}), said)
    if name == "db:pull":
        code = HEADER + "\n\n".join(table_code(db.store.definition(n)) for n in db.store.names() if n != LEDGER.name) + "\n"
        if not said.output:
            return code.splitlines()
        with open(said.output, "w") as file:
            file.write(code)
        return [f"wrote {said.output}"]
    wanted = definitions(said.schema)
    lines = diff(db, *wanted).summary() if name == "db:diff" else push(db, *wanted, force=said.force, preview=said.dry_run)
    return lines or ["no difference"]


def _migrations(name: str, m: Migrator, said: Any) -> list[str]:
    if name == "make:migration":
        return [m.create(said.name, said.table)]
    if name == "migrate:status":
        return [f"{s['status']:8}{s['name']}" for s in m.status()]
    if name == "db:squash":
        return [squash(m)]
    names = {"migrate": m.migrate, "migrate:reset": m.reset, "migrate:refresh": m.refresh}.get(name, lambda: m.rollback(said.steps))()
    return names or ["nothing to do"]


def main() -> None:
    spark = SparkSession.builder.appName("loomspark").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    lines = run(spark, sys.argv[1:])
    if "-q" not in sys.argv and "--quiet" not in sys.argv:
        print("\n".join(lines))


if __name__ == "__main__":
    main()
