import pytest

from loomspark.functions.expressions import and_, eq, gt, like, ne, not_, not_like, or_, raw, sql_count
from loomspark.schema import integer, serial, table, varchar
from loomspark.sources.database import Database, parse_url
from loomspark.sources.dml import ConstraintError

USERS = table("test_users", {"id": serial(), "name": varchar(100).not_null(), "email": varchar(255).unique(), "status": varchar(20).default("active")})
POSTS = table("test_posts", {"id": serial(), "user_id": integer().refers_to("test_users", "id"), "title": varchar(50)})


@pytest.fixture()
def db(spark, tmp_path):
    db = Database.connect(spark, f"parquet://{tmp_path}")
    db.create_tables(USERS, POSTS)
    rows = [{"name": n, "email": f"{n.lower()}@test.com", "status": s} for n, s in (("Alice", "active"), ("Bob", "active"), ("Charlie", "inactive"), ("Diana", "active"))]
    assert db.insert(USERS).values(rows).execute() == 4
    return db


def names(db, condition):
    return sorted(r.name for r in db.select(USERS["name"]).from_(USERS).where(condition).execute().collect())


def test_predicates(db):
    u = USERS
    assert names(db, eq(u["name"], "Alice")) == ["Alice"]
    assert len(names(db, ne(u["name"], "Alice"))) == 3
    assert len(names(db, gt(u["id"], 2))) == 2
    assert names(db, not_(eq(u["status"], "active"))) == ["Charlie"]
    assert names(db, like(u["name"], "A%")) == ["Alice"] and len(names(db, not_like(u["name"], "A%"))) == 3
    assert names(db, and_(eq(u["status"], "active"), or_(like(u["name"], "A%"), like(u["name"], "D%")))) == ["Alice", "Diana"]
    assert names(db, eq(u["name"], "x' OR '1'='1")) == [] and names(db, raw("name = ?", ["x' OR '1'='1"])) == []
    assert db.select(sql_count().as_("n")).from_(u).execute().first().n == 4


def test_changes(db):
    assert db.update(USERS).set({"status": "gone"}).where(eq(USERS["name"], "Bob")).execute() == 1
    assert names(db, eq(USERS["status"], "gone")) == ["Bob"]
    db.insert(USERS).values({"name": "Bobby", "email": "bob@test.com"}).on_conflict_do_update(["email"], {"name": raw("excluded.name")}).execute()
    assert names(db, eq(USERS["email"], "bob@test.com")) == ["Bobby"]
    db.insert(USERS).values({"name": "X", "email": "bob@test.com"}).on_conflict_do_nothing("email").execute()
    assert len(names(db, and_())) == 4
    with pytest.raises(ConstraintError):
        db.insert(USERS).values({"name": "X", "email": "bob@test.com"}).execute()
    with pytest.raises(ConstraintError):
        db.insert(USERS).values({"name": None, "email": "n@test.com"}).execute()
    db.insert(POSTS).values([{"user_id": 1, "title": "a"}, {"user_id": 2, "title": "b"}]).execute()
    assert db.delete(USERS).where(eq(USERS["id"], 1)).execute() == 1
    assert [r.title for r in db.scan(POSTS).collect()] == ["b"]


def test_transaction(db):
    def fails(db):
        db.delete(USERS).execute()
        raise RuntimeError

    with pytest.raises(RuntimeError):
        db.transaction(fails)
    assert len(names(db, and_())) == 4


def test_urls():
    assert parse_url("postgres://u:p@h:5433/d?ssl=1")["port"] == 5433
    with pytest.raises(ValueError):
        parse_url("oracle://h/d")
