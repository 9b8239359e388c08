from loomspark.cli import run
from loomspark.functions.expressions import eq, gt
from loomspark.schema import integer, table
from loomspark.sources.database import Database


def test_commands(spark, tmp_path):
    def do(*words):
        return run(spark, ["--store", str(tmp_path / "store"), "--migrations", str(tmp_path / "steps"), *words])

    path = do("make:migration", "pages", "--table", "pages")[0]
    assert path.endswith("_pages.py") and do("migrate:status")[0].startswith("Pending")
    assert len(do("migrate")) == 1 and do("migrate") == ["nothing to do"] and do("migrate:status")[0].startswith("Ran")
    assert len(do("migrate:rollback")) == 1 and len(do("migrate")) == 1
    assert do("migrate:reset") == ["migrate:reset needs --force"]
    pulled = tmp_path / "tables.py"
    do("db:pull", "--output", str(pulled))
    assert do("db:diff", "--schema", str(pulled)) == ["no difference"]
    with open(pulled, "a") as file:
        file.write("\nMORE = TableDef('more', {'id': ColumnDef('integer')})\n")
    assert do("db:push", "--schema", str(pulled), "--dry-run") == do("db:push", "--schema", str(pulled)) == ["create table more"]
    assert do("db:squash", "--force")[0].endswith("_squashed.py") and do("migrate:status")[0].startswith("Ran")
    assert len(do("migrate:refresh", "--force")) == 1 and do("db:diff", "--schema", str(pulled)) == ["no difference"]


def test_row_security(spark):
    t = table("t", {"id": integer(), "owner": integer()})
    db = Database(spark)
    db.register(t, spark.createDataFrame([(1, 1), (2, 2), (3, None)], "id int, owner int"))
    db.enable_row_security(t)
    assert db.scan(t).count() == 0
    db.create_policy(t, "own", eq(t["owner"], 1))
    db.create_policy(t, "late", gt(t["id"], 2))
    assert sorted(r.id for r in db.select(t["id"]).from_(t).execute().collect()) == [1, 3]
    db.disable_row_security(t)
    assert db.scan(t).count() == 3
