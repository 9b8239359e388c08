import pytest

from loomspark.schema import ColumnDef, ForeignKey, TableDef, integer, serial, table, varchar
from loomspark.sources.database import Database
from loomspark.sources.migrations import Migration, Migrator, Schema, diff, push, table_code


@pytest.fixture()
def db(spark, tmp_path):
    return Database.connect(spark, f"parquet://{tmp_path}/store")


class First(Migration):
    def up(self):
        self.schema.create("tags", lambda t: t.id().column("name", varchar(20)).unique("name"))
        self.seed("tags", [{"name": "x"}, {"name": "y"}])

    def down(self):
        self.schema.drop("tags")


class Second(Migration):
    def up(self):
        self.schema.alter("tags", lambda t: t.rename_column("name", "label").column("rank", integer().default(7), after="id"))

    def down(self):
        self.schema.alter("tags", lambda t: t.rename_column("label", "name").drop_columns("rank"))


class Fails(Migration):
    def up(self):
        self.schema.drop("tags")
        raise RuntimeError

    down = up


def test_migrator(db, tmp_path):
    m = Migrator(db, {"1": First})
    assert m.pending() == ["1"] and m.migrate() == ["1"] and m.migrate() == []
    m.source = {"1": First, "2": Second}
    assert m.migrate() == ["2"] and [s["batch"] for s in m.status()] == [1, 2]
    rows = db.store.read("tags")
    assert rows.columns == ["id", "rank", "label"] and sorted(tuple(r) for r in rows.collect()) == [(1, 7, "x"), (2, 7, "y")]
    assert db.store.definition("tags").uniques == (("label",),)
    m.source["3"] = Fails
    with pytest.raises(RuntimeError):
        m.migrate()
    assert Schema(db).has_table("tags") and m.pending() == ["3"]
    del m.source["3"]
    assert m.rollback() == ["2"] and Schema(db).has_columns("tags", "name") and m.reset() == ["1"] and not Schema(db).has_table("tags")
    assert m.refresh() == ["1", "2"]
    made = Migrator(db, str(tmp_path / "steps"))
    made.create("add_pages", "pages")
    assert len(made.pending()) == 1 and len(made.migrate()) == 1 and Schema(db).has_columns("pages", "id", "created_at")


def test_alter_without_rewrite(db):
    s = Schema(db)
    s.create("a", lambda t: t.column("k", serial()).column("v", varchar(5)))
    db.insert(db.store.definition("a")).values({"v": "x"}).execute()
    parts = db.store.manifest["a"]["parts"]
    s.alter("a", lambda t: t.soft_deletes().index("v"))
    assert db.store.manifest["a"]["parts"] == parts and db.store.read("a").first().deleted_at is None and s.get_indexes("a") == [("v",)]
    with pytest.raises(ValueError):
        s.alter("a", lambda t: t.drop_columns("none"))
    with pytest.raises(ValueError):
        s.alter("a", lambda t: t.soft_deletes())
    s.create("b", lambda t: t.id().foreign_id("category_id"))
    assert s.get_foreign_keys("b")[0].table == "categories"


def test_push(db):
    old = table("t", {"id": serial(), "a": varchar(5), "b": integer()})
    new = table("t", {"id": serial(), "a": varchar(9), "c": integer().default(1)})
    db.create_tables(old, table("u", {"id": serial()}))
    db.insert(old).values({"a": "x", "b": 2}).execute()
    assert sorted(diff(db, new).summary()) == ["add column t.c", "drop column t.b", "drop table u", "modify column t.a"]
    assert push(db, new, preview=True) == ["add column t.c", "modify column t.a by hand"]
    push(db, new)
    assert db.store.read("t").columns == ["id", "a", "b", "c"] and db.store.exists("u")
    push(db, new, force=True)
    assert tuple(db.store.read("t").first()) == (1, "x", 1) and not db.store.exists("u")
    scope = {"ColumnDef": ColumnDef, "TableDef": TableDef, "ForeignKey": ForeignKey}
    exec(table_code(new), scope)
    assert scope["T"] == new
