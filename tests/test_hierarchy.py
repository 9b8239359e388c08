import json

import pytest
from pyspark.sql import functions as F

from loomspark.operators.hierarchy import TypeNode, by_role, citation_authors, create_chain, delete_chain, parsed, serialized, update_chain, with_delegates
from loomspark.operators.records import Author, Record
from loomspark.schema import integer, serial, table, varchar
from loomspark.sources.database import Database

THING = table("things", {"id": serial(), "type": varchar(), "type_path": varchar(), "title": varchar()})
WORK = table("works", {"id": serial(), "thing_id": integer(), "year": integer()})
BOOK = table("books", {"id": serial(), "work_id": integer(), "isbn": varchar()})
TREE = [TypeNode("Work", WORK, "thing_id", (TypeNode("Book", BOOK, "work_id"),))]


def test_chain(spark, tmp_path):
    db = Database.connect(spark, f"parquet://{tmp_path}")
    db.create_tables(THING, WORK, BOOK)
    ids = create_chain(db, [("Thing", THING, None, {"title": "a"}), ("Work", WORK, "thing_id", {"year": 1999}), ("Book", BOOK, "work_id", {"isbn": "x"})])
    assert ids == [1, 1, 1]
    db.insert(THING).values({"title": "alone"}).execute()
    assert update_chain(db, [(THING, 1, {"title": "b"}), (WORK, 1, {}), (BOOK, 1, {"isbn": "y"})]) == 2
    got = {r.id: json.loads(r.j) for r in with_delegates(db, THING, TREE).select("id", serialized(THING, TREE).alias("j")).collect()}
    assert got[1]["_data"]["title"] == "b" and got[1]["_data"]["type_path"] == "Thing/Work/Book"
    assert got[1]["_delegate"]["_type"] == "Work" and got[1]["_delegate"]["_delegate"]["_data"]["isbn"] == "y"
    assert "_delegate" not in got[2]
    with pytest.raises(ValueError):
        update_chain(db, [(THING, 1, {"title": "c"}), (WORK, 1, {"none": 1})])
    assert db.scan(THING).where("title = 'b'").count() == 1
    assert delete_chain(db, [(THING, 1), (WORK, 1), (BOOK, 1)]) == 3 and db.scan(BOOK).count() == 0 and db.scan(THING).count() == 1


def test_parsed(spark, tmp_path):
    db = Database.connect(spark, f"parquet://{tmp_path}")
    db.create_tables(THING, WORK, BOOK)
    create_chain(db, [("Thing", THING, None, {"title": "a \"quoted\" é"}), ("Work", WORK, "thing_id", {"year": 1999}), ("Book", BOOK, "work_id", {"isbn": "x"})])
    db.insert(THING).values({"title": None}).execute()
    before = with_delegates(db, THING, TREE)
    after = before.select(parsed(serialized(THING, TREE), THING, TREE).alias("x")).select("x.*")
    assert after.columns == before.columns and sorted(map(str, after.collect())) == sorted(map(str, before.collect()))
    bad = spark.createDataFrame([("no json",), (None,), ('{"_type":"things","_data":{"id":5},"_delegate":{"_type":"Other","_data":{}}}',)], "j string")
    got = [r.x for r in bad.select(parsed(bad.j, THING, TREE).alias("x")).collect()]
    assert got[:2] == [None, None] and got[2].id == 5 and got[2]._Work is None


def test_citations(spark):
    links = spark.createDataFrame([(1, 1, 2), (1, 2, 1), (1, 3, 3), (2, 1, 1), (3, 2, None), (3, 1, 2), (4, 9, 1), (5, 4, 1)], "work_id int, agent_id int, position int")
    agents = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C"), (4, None)], "id int, name string")
    assert dict(map(tuple, citation_authors(links, agents).collect())) == {1: "B, A & C", 2: "A", 3: "B & A", 5: ""}
    roles = links.withColumn("role", F.when(F.col("agent_id") < 3, "author").otherwise("editor"))
    assert [(r.agent_id, r.place) for r in by_role(roles, "author").where("work_id = 1").orderBy("place").collect()] == [(2, 1), (1, 2)]


def test_author():
    class PersonRow(Record, Author):
        pass

    p = PersonRow({"name": "Ada"})
    assert p.is_person and not p.is_organization and p.author_meta == {"type": "person", "name": "Ada", "citation_name": "Ada"}
