"""Keys, ids, references and nested transactions of changes of stored tables; records with keys of their own."""

import datetime as dt
from decimal import Decimal

import pytest

from loomspark.functions.expressions import bound, desc, eq, raw
from loomspark.operators.relations import Many, One
from loomspark.operators.records import Record
from loomspark.schema import ForeignKey, bigint, decimal, integer, serial, table, timestamp, varchar
from loomspark.sources.database import Database
from loomspark.sources.dml import ConstraintError

MAIL = table("mail", {"id": serial(), "address": varchar(50).unique(), "name": varchar(50)})


def tree(action):
    return table("tree", {"id": integer().primary_key(), "up": integer()}, foreign_keys=(ForeignKey(("up",), "tree", ("id",), action),))


@pytest.fixture()
def db(spark, tmp_path):
    out = Database.connect(spark, f"parquet://{tmp_path}")
    out.create_tables(MAIL)
    return out


def rows(db, t=MAIL):
    return sorted((tuple(r) for r in db.scan(t).collect()), key=repr)


def test_null_keys_meet_nothing(db):
    db.insert(MAIL).values([{"address": None, "name": "a"}, {"address": None, "name": "b"}, {"address": "x", "name": "c"}, {"address": "x", "name": "d"}]).on_conflict_do_nothing().execute()
    assert [r[1:] for r in rows(db)] == [(None, "a"), (None, "b"), ("x", "c")]
    db.insert(MAIL).values([{"address": None, "name": "e"}]).on_conflict_do_update(["address"], {"name": raw("excluded.name")}).execute()
    assert len(rows(db)) == 4


def test_returning_and_last_id(db):
    assert db.insert(MAIL).values({"address": "x", "name": "a"}).execute() == 1
    got = db.insert(MAIL).values({"address": "x", "name": "b"}).on_conflict_do_update(["address"], {"name": raw("excluded.name")}).returning("id", "name").execute()
    assert [tuple(r) for r in got.collect()] == [(1, "b")]
    assert db.insert(MAIL).values({"address": "x", "name": "c"}).on_conflict_do_nothing("address").execute() == 0
    assert db.insert(MAIL).values({"address": "x", "name": "c"}).on_conflict_do_update(["address"], {"name": raw("excluded.name")}).execute() == 1
    assert rows(db) == [(1, "x", "c")]


def test_frames_are_numbered_without_gaps(db, spark):
    db.insert(MAIL).values(spark.range(100).selectExpr("cast(id as string) as name").repartition(5)).execute()
    assert sorted(r[0] for r in rows(db)) == list(range(1, 101))
    db.insert(MAIL).values([{"name": "z"}]).execute()
    assert max(r[0] for r in rows(db)) == 101
    assert db.insert(MAIL).values(spark.range(0).selectExpr("cast(id as string) as name")).execute() == 0


def test_many_rows_are_one_relation(db):
    db.insert(MAIL).values([{"address": f"a{i}", "name": None if i % 2 else "n"} for i in range(3000)]).execute()
    assert len(rows(db)) == 3000
    db.insert(MAIL).values([{"address": 5, "name": raw("upper('q')")}, {"address": "6", "name": "r"}]).execute()
    assert ("Q", "r") == tuple(r.name for r in db.scan(MAIL).where("address in ('5', '6')").orderBy("address").collect())


def test_rows_that_refer_to_their_own_table(spark, tmp_path):
    for action, left in (("cascade", [(5, None)]), ("set null", [(2, None), (3, 2), (4, 3), (5, None)])):
        db, t = Database.connect(spark, f"parquet://{tmp_path}/{action.replace(' ', '')}"), tree(action)
        db.create_tables(t)
        db.insert(t).values([{"id": 1, "up": None}, {"id": 2, "up": 1}, {"id": 3, "up": 2}, {"id": 4, "up": 3}, {"id": 5, "up": None}]).execute()
        with pytest.raises(ConstraintError):
            db.insert(t).values({"id": 9, "up": 8}).execute()
        db.delete(t).where(eq(t["id"], 1)).execute()
        assert rows(db, t) == left
    db, t = Database.connect(spark, f"parquet://{tmp_path}/r"), tree("restrict")
    db.create_tables(t)
    db.insert(t).values([{"id": 1, "up": None}, {"id": 2, "up": 1}]).execute()
    with pytest.raises(ConstraintError):
        db.delete(t).where(eq(t["id"], 1)).execute()
    assert db.delete(t).execute() == 2


def test_limited_delete(db):
    db.insert(MAIL).values([{"name": x} for x in "abcd"]).execute()
    assert db.delete(MAIL).order_by(desc(MAIL["name"])).limit(2).execute() == 2
    assert [r[2] for r in rows(db)] == ["a", "b"]


def test_inner_transaction_fails_alone(db):
    def inner(db):
        db.insert(MAIL).values({"name": "gone"}).execute()
        raise RuntimeError

    def outer(db):
        db.insert(MAIL).values({"name": "stays"}).execute()
        with pytest.raises(RuntimeError):
            db.transaction(inner)
        db.insert(MAIL).values({"name": "too"}).execute()

    db.transaction(outer)
    assert [r[2] for r in rows(db)] == ["stays", "too"]
    with pytest.raises(RuntimeError):
        db.commit()


def test_definitions_are_json(db):
    t = table("kinds", {"id": serial(), "at": timestamp().default(dt.datetime(2020, 1, 2)), "price": decimal(8, 3).default(Decimal("1.250")), "owner": integer().refers_to("mail", "id")}, uniques=(("at", "price"),), indexes=(("owner",),), foreign_keys=(ForeignKey(("owner",), "mail", ("id",), "set null"),), comment="x")
    db.create_tables(t)
    assert db.store.definition("kinds") == t
    db.insert(t).values({"owner": None}).execute()
    assert rows(db, t) == [(1, dt.datetime(2020, 1, 2), Decimal("1.250"), None)]


def test_records_with_keys(db):
    class Mail(Record):
        pass

    kind = Mail.bind(db, MAIL)
    one = kind({"id": 7, "name": "own"}).save()
    assert one.exists and kind.find(7)["name"] == "own" and not kind({"id": 8}).exists
    assert kind.upsert({"id": 9}, {"name": "up"}).key == 9 and kind.upsert({"id": 9}, {"name": "down"})["name"] == "down"
    assert kind.create({"name": "next"}).key == 10
    with pytest.raises(ConstraintError):
        kind({"id": 7}).save()
    kind.find(7).delete()
    one["name"] = "late"
    with pytest.raises(RuntimeError):
        one.save()


def test_relations(db, spark):
    up, low = table("up", {"id": bigint().primary_key(), "x": integer()}), table("low", {"id": bigint().primary_key(), "up_id": bigint(), "y": integer()})
    db.register(up, spark.createDataFrame([(1, 3), (2, None), (3, 1), (4, 3)], "id long, x int").repartition(4))
    db.register(low, spark.createDataFrame([(10, 1, 5), (11, 1, None), (12, 1, 7), (13, 3, 1), (14, None, 1)], "id long, up_id long, y int").repartition(4))
    db.registry.define(up, {"lows": Many(low, ("id",), ("up_id",))})
    db.registry.define(low, {"up": One(up, ("up_id",), ("id",))})
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = db.query_table(up).order_by(desc(up["x"]), desc(up["id"])).with_({"lows": {"order_by": desc(low["y"]), "limit_per_parent": 2}}).find_many().collect()
        assert [(r.id, [x.id for x in r.lows]) for r in got] == [(4, []), (1, [12, 10]), (3, [13]), (2, [])]
        assert got[1].lows[0].asDict() == {"id": 12, "up_id": 1, "y": 7}
        got = db.query_table(up).columns("id").order_by(up["x"]).limit(2).with_({"lows": {"order_by": low["y"]}}).find_many().collect()
        assert [(r.id, [x.id for x in r.lows]) for r in got] == [(2, []), (3, [13])]
        got = db.query_table(low).order_by(low["id"]).with_({"up": True}).find_many().collect()
        assert [(r.id, r.up and r.up.x) for r in got] == [(10, 3), (11, 3), (12, 3), (13, 1), (14, None)]
        one = db.query_table(up).with_({"lows": True}).find(1)
        assert [x.id for x in one.lows] == [10, 11, 12]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_placeholders_in_comments():
    assert bound("SELECT ? /* why? * / ? */ -- and?\n, '?'", [1]) == "SELECT (1) /* why? * / ? */ -- and?\n, '?'"
