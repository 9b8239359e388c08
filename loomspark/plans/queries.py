"""Registered queries over the given tables, with equal DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.expressions import (and_, asc, between, desc, eq, gt, gte, ilike, in_, is_not_null, is_null, like, lt, lte, ne, not_, not_between, not_ilike, not_in, not_like, or_, raw, sql_avg, sql_count, sql_count_distinct, sql_max, sql_min, sql_sum)
from ..operators.relations import Many, One, PolyMany, PolyOne
from ..schema import TableDef, bigint, boolean, double_precision, integer, serial, table, text, timestamp, varchar
from ..sources.database import Database

region = table("region", {"r_regionkey": integer().primary_key(), "r_name": text()})
nation = table("nation", {"n_nationkey": integer().primary_key(), "n_name": text(), "n_regionkey": integer()})
customer = table("customer", {"c_custkey": bigint().primary_key(), "c_name": text(), "c_nationkey": integer(), "c_acctbal": double_precision(), "c_mktsegment": text()})
supplier = table("supplier", {"s_suppkey": bigint().primary_key(), "s_name": text(), "s_nationkey": integer(), "s_acctbal": double_precision()})
part = table("part", {"p_partkey": bigint().primary_key(), "p_name": text(), "p_brand": text(), "p_type": text(), "p_size": integer(), "p_retailprice": double_precision()})
orders = table("orders", {"o_orderkey": bigint().primary_key(), "o_custkey": bigint(), "o_orderstatus": text(), "o_totalprice": double_precision(), "o_orderdate": timestamp(), "o_orderpriority": text()})
lineitem = table("lineitem", {"l_orderkey": bigint(), "l_partkey": bigint(), "l_suppkey": bigint(), "l_linenumber": integer(), "l_quantity": double_precision(), "l_extendedprice": double_precision(), "l_discount": double_precision(), "l_tax": double_precision(), "l_returnflag": text(), "l_linestatus": text(), "l_shipdate": timestamp()})
TABLES = (region, nation, customer, supplier, part, orders, lineitem)

QUERIES: dict = {}
ORACLES: dict = {}


def open_db(spark: SparkSession, sf_dir: str) -> Database:
    db = Database(spark, folder=sf_dir)
    db.registry.define(nation, {"region": One(region, ("n_regionkey",), ("r_regionkey",)), "customers": Many(customer, ("n_nationkey",), ("c_nationkey",))})
    db.registry.define(region, {"nations": Many(nation, ("r_regionkey",), ("n_regionkey",))})
    db.registry.define(customer, {"orders": Many(orders, ("c_custkey",), ("o_custkey",))})
    db.registry.define(orders, {"parts": Many(part, ("o_orderkey",), through=lineitem, through_fields=("l_orderkey",), target_fields=("l_partkey",))})
    return db


def query(sql: str):
    """Registers a query over an open database under its function's name."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(open_db(spark, sf_dir))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__], ORACLES[f.__name__] = run, sql
        return run

    return register


def _simple(name: str, of, condition, sql: str, *columns: str) -> None:
    def f(db: Database) -> DataFrame:
        return db.select(*(of[c] for c in columns)).from_(of).where(condition()).execute()

    f.__name__ = name
    query(f"SELECT {', '.join(columns)} FROM {of.name} WHERE {sql}")(f)


O, C, L, P = orders, customer, lineitem, part
for _name, _of, _condition, _sql, *_columns in (
    ("filter_eq", O, lambda: eq(O["o_orderstatus"], "F"), "o_orderstatus = 'F'", "o_orderkey"),
    ("filter_ne", O, lambda: ne(O["o_orderstatus"], "F"), "o_orderstatus <> 'F'", "o_orderkey"),
    ("filter_gt", O, lambda: gt(O["o_totalprice"], 100000), "o_totalprice > 100000", "o_orderkey"),
    ("filter_gte", O, lambda: gte(O["o_custkey"], 500), "o_custkey >= 500", "o_orderkey"),
    ("filter_lt", O, lambda: lt(O["o_totalprice"], "5000"), "o_totalprice < 5000", "o_orderkey"),
    ("filter_lte", O, lambda: lte(O["o_custkey"], 20), "o_custkey <= 20", "o_orderkey"),
    ("filter_col_vs_col", L, lambda: lt(L["l_partkey"], L["l_suppkey"]), "l_partkey < l_suppkey", "l_orderkey", "l_linenumber"),
    ("filter_eq_null", C, lambda: eq(C["c_name"], None), "c_name = NULL", "c_custkey"),
    ("filter_uncastable", C, lambda: eq(C["c_custkey"], "abc"), "false", "c_custkey"),
    ("filter_and_or_not_nested", C, lambda: and_(gt(C["c_acctbal"], 0), or_(eq(C["c_mktsegment"], "BUILDING"), not_(lt(C["c_nationkey"], 20)))), "c_acctbal > 0 AND (c_mktsegment = 'BUILDING' OR NOT c_nationkey < 20)", "c_custkey"),
    ("filter_empty_and", C, lambda: and_(), "1 = 1", "c_custkey"),
    ("filter_empty_or", C, lambda: or_(), "1 = 0", "c_custkey"),
    ("filter_in", C, lambda: in_(C["c_nationkey"], [1, 2, 3]), "c_nationkey IN (1, 2, 3)", "c_custkey"),
    ("filter_not_in", C, lambda: not_in(C["c_nationkey"], [1, 2, 3]), "c_nationkey NOT IN (1, 2, 3)", "c_custkey"),
    ("filter_in_empty", C, lambda: in_(C["c_nationkey"], []), "1 = 0", "c_custkey"),
    ("filter_not_in_empty", C, lambda: not_in(C["c_nationkey"], []), "1 = 1", "c_custkey"),
    ("filter_not_in_null", C, lambda: not_in(C["c_nationkey"], [1, None]), "c_nationkey NOT IN (1, NULL)", "c_custkey"),
    ("filter_between", L, lambda: between(L["l_quantity"], 10, 20), "l_quantity BETWEEN 10 AND 20", "l_orderkey", "l_linenumber"),
    ("filter_not_between", L, lambda: not_between(L["l_quantity"], 10, 20), "l_quantity NOT BETWEEN 10 AND 20", "l_orderkey", "l_linenumber"),
    ("filter_like", P, lambda: like(P["p_name"], "%a%"), "p_name LIKE '%a%'", "p_partkey"),
    ("filter_not_like", P, lambda: not_like(P["p_name"], "%a%"), "p_name NOT LIKE '%a%'", "p_partkey"),
    ("filter_ilike", P, lambda: ilike(P["p_type"], "%STEEL%"), "p_type ILIKE '%STEEL%'", "p_partkey"),
    ("filter_not_ilike", P, lambda: not_ilike(P["p_type"], "%STEEL%"), "p_type NOT ILIKE '%STEEL%'", "p_partkey"),
    ("filter_raw_bound", O, lambda: raw("o_totalprice * ? > ? AND o_orderpriority <> '?'", [2, 300000]), "o_totalprice * 2 > 300000", "o_orderkey"),
    ("filter_raw_year", O, lambda: raw("year(o_orderdate) = ?", [1995]), "year(o_orderdate) = 1995", "o_orderkey"),
):
    _simple(_name, _of, _condition, _sql, *_columns)


@query("SELECT * FROM nation")
def scan_all(db):
    return db.select().from_(nation).execute()


@query("SELECT p_partkey, p_name, p_size * 2 AS twice FROM part")
def project_string_expr(db):
    return db.select(P["p_partkey"], P["p_name"], "p_size * 2 AS twice").from_(part).execute()


@query("SELECT c_custkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT') o ON c_custkey = o_custkey WHERE o_orderkey IS NULL")
def filter_is_null(db):
    db.register(table("urgent", dict(orders.columns)), db.scan(orders).filter("o_orderpriority = '1-URGENT'"))
    u = table("urgent", dict(orders.columns))
    return db.select(C["c_custkey"]).from_(customer).left_join(u, eq(C["c_custkey"], u["o_custkey"])).where(is_null(u["o_orderkey"])).execute()


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT') o ON c_custkey = o_custkey WHERE o_orderkey IS NOT NULL")
def filter_is_not_null(db):
    u = table("urgent", dict(orders.columns))
    db.register(u, db.scan(orders).filter("o_orderpriority = '1-URGENT'"))
    return db.select(C["c_custkey"], u["o_orderkey"]).from_(customer).left_join(u, eq(C["c_custkey"], u["o_custkey"])).where(is_not_null(u["o_orderkey"])).execute()


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)")
def filter_scalar_subquery(db):
    db.view(orders)
    return db.select(O["o_orderkey"]).from_(orders).where(gt(O["o_totalprice"], raw("(SELECT avg(o_totalprice) FROM orders)"))).execute()


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 25")
def order_multi(db):
    return db.select(O["o_orderkey"], O["o_custkey"]).from_(orders).order_by(asc(O["o_orderpriority"]), desc(O["o_totalprice"]), O["o_orderkey"]).limit(25).execute()


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def topk(db):
    return db.select(O["o_orderkey"], O["o_totalprice"]).from_(orders).order_by(desc(O["o_totalprice"]), O["o_orderkey"]).limit(10).execute()


@query("SELECT n_name FROM nation ORDER BY n_nationkey LIMIT 5 OFFSET 7")
def limit_offset(db):
    return db.select(nation["n_name"]).from_(nation).order_by(nation["n_nationkey"]).limit(5).offset(7).execute()


@query("SELECT n_name FROM nation ORDER BY n_nationkey OFFSET 20")
def offset_only(db):
    return db.select(nation["n_name"]).from_(nation).order_by(nation["n_nationkey"]).offset(20).execute()


def _joined(name: str, how: str) -> None:
    def f(db: Database) -> DataFrame:
        few = table("few", {**supplier.columns})
        db.register(few, db.scan(supplier).filter("s_nationkey < 5"))
        some = table("some", {**nation.columns})
        db.register(some, db.scan(nation).filter("n_nationkey >= 3"))
        q = db.select(some["n_name"], few["s_name"]).from_(some)
        return getattr(q, f"{how}_join")(few, eq(some["n_nationkey"], few["s_nationkey"])).execute()

    f.__name__ = name
    query(f"SELECT n_name, s_name FROM (SELECT * FROM nation WHERE n_nationkey >= 3) n {how.upper()} JOIN (SELECT * FROM supplier WHERE s_nationkey < 5) s ON n_nationkey = s_nationkey")(f)


for _how in ("inner", "left", "right", "full"):
    _joined(f"join_{_how}", _how)


@query("SELECT n_name, r_name FROM nation CROSS JOIN region")
def join_cross(db):
    return db.select(nation["n_name"], region["r_name"]).from_(nation).cross_join(region).execute()


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey < r_regionkey")
def join_theta(db):
    return db.select(nation["n_name"], region["r_name"]).from_(nation).inner_join(region, lt(nation["n_regionkey"], region["r_regionkey"])).execute()


@query("SELECT n_nationkey, n_name, n_regionkey, r_regionkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def join_star_dedup(db):
    return db.select().from_(nation).inner_join(region, eq(nation["n_regionkey"], region["r_regionkey"])).execute()


@query("SELECT r_name, n_name, c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def join_multi(db):
    return db.select(region["r_name"], nation["n_name"], C["c_custkey"]).from_(customer).inner_join(nation, eq(C["c_nationkey"], nation["n_nationkey"])).inner_join(region, eq(nation["n_regionkey"], region["r_regionkey"])).execute()


@query("SELECT n_name, round(sum(o_totalprice), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name ORDER BY revenue DESC, n_name LIMIT 10")
def revenue_by_nation(db):
    q = db.select(nation["n_name"], raw("round(sum(o_totalprice), 2)").as_("revenue")).from_(customer).inner_join(orders, eq(C["c_custkey"], O["o_custkey"]))
    return q.inner_join(nation, eq(C["c_nationkey"], nation["n_nationkey"])).group_by(nation["n_name"]).order_by(desc("revenue"), nation["n_name"]).limit(10).execute()


@query("SELECT count(*) AS n, count(l_tax) AS taxes, count(DISTINCT l_returnflag) AS flags, round(sum(l_quantity), 2) AS s, round(avg(l_quantity), 6) AS a, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem")
def agg_global(db):
    return db.select(sql_count().as_("n"), sql_count(L["l_tax"]).as_("taxes"), sql_count_distinct(L["l_returnflag"]).as_("flags"), raw("round(sum(l_quantity), 2)").as_("s"), raw("round(avg(l_quantity), 6)").as_("a"), sql_min(L["l_extendedprice"]).as_("lo"), sql_max(L["l_extendedprice"]).as_("hi")).from_(lineitem).execute()


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS lines, avg(l_linenumber) AS mean FROM lineitem GROUP BY l_returnflag, l_linestatus")
def group_by(db):
    return db.select(L["l_returnflag"], L["l_linestatus"], sql_count().as_("n"), sql_sum(L["l_linenumber"]).as_("lines"), sql_avg(L["l_linenumber"]).as_("mean")).from_(lineitem).group_by(L["l_returnflag"], L["l_linestatus"]).execute()


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
def group_by_having_raw(db):
    return db.select(O["o_custkey"], sql_count().as_("n")).from_(orders).group_by(O["o_custkey"]).having(raw("COUNT(*) > ?", [12])).execute()


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) >= 14")
def group_by_having_alias(db):
    return db.select(O["o_custkey"], sql_count().as_("n")).from_(orders).group_by(O["o_custkey"]).having(gte(raw("n"), 14)).execute()


@query("SELECT n_nationkey, any_value(n_name) AS n_name, count(*) AS n FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY n_nationkey")
def group_by_pk_dependent(db):
    return db.select(nation["n_nationkey"], nation["n_name"], sql_count().as_("n")).from_(nation).inner_join(customer, eq(nation["n_nationkey"], C["c_nationkey"])).group_by(nation["n_nationkey"]).execute()


@query("SELECT l_returnflag, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY l_returnflag")
def sum_raw_expr(db):
    return db.select(L["l_returnflag"], raw("round(sum(l_extendedprice * (1 - l_discount)), 2)").as_("revenue")).from_(lineitem).group_by(L["l_returnflag"]).execute()


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_custkey IN (1, 2, 3, 5) AND o_totalprice > 1000")
def sql_text(db):
    db.view(orders)
    q = db.sql("SELECT ").identifier("o_orderkey").append(" FROM ").table(orders).append(" WHERE o_orderstatus = ").value("O").append(" AND o_custkey").in_([1, 2, 3, 5])
    return q.when(True, " AND o_totalprice > ?", [1000]).when(False, " AND false").df()


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def rel_one(db):
    return db.query_table(nation).with_({"region": True}).find_many().select("n_name", "region.r_name")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
def rel_many_flat(db):
    return db.query_table(customer).with_({"orders": True}).find_many().select("c_custkey", F.explode_outer("orders").alias("o")).select("c_custkey", "o.o_orderkey")


@query("SELECT c_custkey, CAST(count(o_orderkey) AS INTEGER) AS n FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT') o ON c_custkey = o_custkey GROUP BY c_custkey")
def rel_many_filtered(db):
    return db.query_table(customer).with_({"orders": {"where": eq(O["o_orderpriority"], "1-URGENT")}}).find_many().select("c_custkey", F.size("orders").alias("n"))


@query("SELECT o_custkey AS c_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 2")
def rel_many_top_per_parent(db):
    got = db.query_table(customer).with_({"orders": {"columns": ["o_orderkey"], "order_by": desc(O["o_totalprice"]), "limit_per_parent": 2}}).find_many()
    return got.select("c_custkey", F.explode("orders").alias("o")).select("c_custkey", "o.o_orderkey")


@query("SELECT o_custkey AS c_custkey, o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 7")
def rel_many_global_limit(db):
    got = db.query_table(customer).with_({"orders": {"order_by": desc(O["o_totalprice"]), "limit": 7}}).find_many()
    return got.select("c_custkey", F.explode("orders").alias("o")).select("c_custkey", "o.o_orderkey")


@query("SELECT l_orderkey AS o_orderkey, p_name, l_linenumber FROM lineitem JOIN part ON l_partkey = p_partkey")
def rel_m2m_pivot(db):
    got = db.query_table(orders).with_({"parts": {"with_pivot": True}}).find_many()
    return got.select("o_orderkey", F.explode("parts").alias("p")).select("o_orderkey", "p.p_name", "p._pivot.l_linenumber")


@query("SELECT r_name, n_name, c_custkey FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON n_nationkey = c_nationkey WHERE c_acctbal > 5000")
def rel_nested(db):
    got = db.query_table(region).with_({"all:nations": {"with": {"customers": {"columns": ["c_custkey"], "where": gt(C["c_acctbal"], 5000)}}}}).find_many()
    return got.select("r_name", F.explode("all").alias("n")).select("r_name", "n.n_name", F.explode("n.customers").alias("c")).select("r_name", "n_name", "c.c_custkey")


_subject = table("subject", {"event_id": bigint().primary_key(), "kind": varchar(), "ref": bigint()})
_SUBJECT = "SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'customer' ELSE 'supplier' END AS kind, user_id AS ref FROM events"


def _poly(db: Database) -> None:
    events = db.spark.read.parquet(f"{db.folder}/events.parquet")
    db.register(_subject, events.select("event_id", F.when(F.col("user_id") % 2 == 0, "customer").otherwise("supplier").alias("kind"), F.col("user_id").alias("ref")))


@query(f"SELECT event_id, c_name, s_name FROM ({_SUBJECT}) e LEFT JOIN customer ON kind = 'customer' AND ref = c_custkey LEFT JOIN supplier ON kind = 'supplier' AND ref = s_suppkey")
def rel_poly_one(db):
    _poly(db)
    db.registry.define(_subject, {"of": PolyOne("kind", "ref", {"customer": customer, "supplier": supplier})})
    return db.query_table(_subject).with_({"of": True}).find_many().select("event_id", "of.customer.c_name", "of.supplier.s_name")


@query(f"SELECT c_custkey, CAST(count(event_id) AS INTEGER) AS n FROM customer LEFT JOIN (SELECT * FROM ({_SUBJECT}) WHERE kind = 'customer') e ON ref = c_custkey GROUP BY c_custkey")
def rel_poly_many(db):
    _poly(db)
    db.registry.define(customer, {"events": PolyMany(_subject, "kind", "ref", "customer")})
    return db.query_table(customer).with_({"events": True}).find_many().select("c_custkey", F.size("events").alias("n"))


@query("SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug, CASE WHEN length(p_name) <= 12 THEN p_name ELSE substr(p_name, 1, 9) || '...' END AS short FROM part")
def slug_and_truncated(db):
    return db.scan(part).select("p_partkey", tx.slug(F.col("p_name")).alias("slug"), tx.truncated(F.col("p_name"), 12).alias("short"))


@query("SELECT 'customer' AS type, c_custkey AS id, c_name AS name FROM customer WHERE c_acctbal > 9000 UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier WHERE s_acctbal > 9000")
def hierarchy_from_chain(db):
    from ..operators.hierarchy import TypeNode, coalesced, with_delegates

    things = table("things", {"id": bigint().primary_key(), "key": bigint(), "type": varchar(), "type_path": varchar()})
    c, s = db.scan(customer), db.scan(supplier)
    base = c.select((F.col("c_custkey") * 2).alias("id"), F.col("c_custkey").alias("key"), F.lit("customer").alias("type"), F.lit("thing/customer").alias("type_path"))
    base = base.unionByName(s.select((F.col("s_suppkey") * 2 + 1).alias("id"), F.col("s_suppkey").alias("key"), F.lit("supplier").alias("type"), F.lit("thing/supplier").alias("type_path")))
    db.register(things, base)
    cs, ss = (table(n, {"thing_id": bigint(), "name": varchar(), "balance": double_precision(), "active": boolean()}) for n in ("customer_part", "supplier_part"))
    db.register(cs, c.select((F.col("c_custkey") * 2).alias("thing_id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.lit(True).alias("active")))
    own = s.select((F.col("s_suppkey") * 2 + 1).alias("thing_id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"), F.lit(True).alias("active"))
    stale = c.select((F.col("c_custkey") * 2).alias("thing_id"), F.lit("stale").alias("name"), F.lit(10000.0).alias("balance"), F.lit(False).alias("active"))
    db.register(ss, own.unionByName(stale))  # rows under the keys of things of the other type
    nodes = [TypeNode("customer", cs, "thing_id"), TypeNode("supplier", ss, "thing_id")]
    got = with_delegates(db, things, nodes)
    return got.withColumn("name", coalesced(nodes, "name")).filter(coalesced(nodes, "balance") > 9000).select("type", F.col("key").alias("id"), "name")


@query("SELECT o_orderkey, 'o_totalprice' AS changed FROM orders WHERE o_orderstatus = 'F' AND o_totalprice <> 0")
def records_changed(db):
    from ..operators.records import changed_rows

    before = db.scan(orders)
    after = before.withColumn("o_totalprice", F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice") * 2).otherwise(F.col("o_totalprice")))
    return changed_rows(before, after, "o_orderkey").select("o_orderkey", F.array_join("changed", ",").alias("changed"))


def _marked(db: Database) -> DataFrame:
    return db.scan(customer).withColumn("deleted_at", F.when(F.col("c_acctbal") < 0, F.lit("2020-01-01 00:00:00")))


@query("SELECT c_custkey FROM customer WHERE NOT c_acctbal < 0")
def records_active(db):
    from ..operators.records import active

    return active(_marked(db)).select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def records_soft_deleted(db):
    from ..operators.records import soft_deleted

    return soft_deleted(_marked(db)).select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_nationkey = 3 OR c_mktsegment = 'BUILDING'")
def row_security(db):
    db.create_policy(customer, "nation", eq(C["c_nationkey"], 3))
    db.create_policy(customer, "segment", eq(C["c_mktsegment"], "BUILDING"))
    db.enable_row_security(customer)
    return db.select(C["c_custkey"]).from_(customer).execute()


@query("SELECT p_partkey, array_to_string([upper(w[1]) FOR w IN string_split(p_name, ' ')[1:2]], '') AS initials, trim(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9 -]', '', 'g'), '[ -]+', '-', 'g'), '-') AS slug FROM part")
def display_names(db):
    return db.scan(part).select("p_partkey", tx.initials(F.col("p_name")).alias("initials"), tx.display_slug(F.col("p_name")).alias("slug"))


@query("SELECT n_nationkey, CASE WHEN len(x) = 1 THEN x[1] ELSE array_to_string(x[1:len(x) - 1], ', ') || ' & ' || x[len(x)] END AS citation FROM (SELECT s_nationkey AS n_nationkey, list(s_name ORDER BY s_suppkey) AS x FROM supplier GROUP BY s_nationkey)")
def citations(db):
    from ..operators.hierarchy import citation_authors

    s = db.scan(supplier)
    links = s.select(F.col("s_nationkey").alias("work_id"), F.col("s_suppkey").alias("agent_id"), F.col("s_suppkey").alias("position"))
    return citation_authors(links, s, key="s_suppkey", name="s_name").withColumnRenamed("work_id", "n_nationkey")


@query("SELECT n_nationkey, n_name, r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey AND r_name <> 'ASIA'")
def hierarchy_json(db):
    from ..operators.hierarchy import TypeNode, parsed, serialized, with_delegates

    below = table("place", {"n_key": integer(), "r_name": text()})
    joined = db.scan(nation).join(db.scan(region), F.col("n_regionkey") == F.col("r_regionkey"))
    db.register(below, joined.filter("r_name <> 'ASIA'").select(F.col("n_nationkey").alias("n_key"), "r_name"))
    nodes = [TypeNode("place", below, "n_key")]
    written = with_delegates(db, nation, nodes, key="n_nationkey").select(serialized(nation, nodes).alias("j"))
    return written.select(parsed(F.col("j"), nation, nodes).alias("x")).select("x.n_nationkey", "x.n_name", "x._place.r_name")


def _stored(db: Database) -> tuple[Database, TableDef]:
    """A fresh store that holds the customers."""
    own = Database.connect(db.spark, "memory:///")
    own.create_tables(customer)
    own.insert(customer).values(db.scan(customer)).execute()
    return own, customer


def _started(db: Database) -> tuple[Database, TableDef]:
    """A fresh store that holds the customers of the first ten nations."""
    own = Database.connect(db.spark, "memory:///")
    own.create_tables(customer)
    own.insert(customer).values(db.scan(customer).filter("c_nationkey < 10")).execute()
    return own, customer


_ALL = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"


@query(_ALL)
def dml_insert(db):
    own, t = _stored(db)
    return own.select().from_(t).execute()


@query("SELECT c_custkey, c_name FROM customer")
def dml_upsert_nothing(db):
    own, t = _started(db)
    more = db.scan(customer).filter("c_nationkey >= 5").withColumn("c_name", F.when(F.col("c_nationkey") < 10, "other").otherwise(F.col("c_name")))
    own.insert(t).values(more).on_conflict_do_nothing("c_custkey").execute()
    return own.select(t["c_custkey"], t["c_name"]).from_(t).execute()


@query("SELECT c_custkey, CASE WHEN c_nationkey BETWEEN 5 AND 9 THEN 'twice ' || c_name ELSE c_name END AS c_name FROM customer")
def dml_upsert_update(db):
    own, t = _started(db)
    more = db.scan(customer).filter("c_nationkey >= 5")
    more = more.withColumn("c_name", F.when(F.col("c_nationkey") < 10, F.concat(F.lit("twice "), F.col("c_name"))).otherwise(F.col("c_name")))
    own.insert(t).values(more).on_conflict_do_update(["c_custkey"], {"c_name": raw("excluded.c_name")}).execute()
    return own.select(t["c_custkey"], t["c_name"]).from_(t).execute()


@query(f"SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN c_nationkey + 100 ELSE c_nationkey END AS c_nationkey FROM ({_ALL})")
def dml_update(db):
    own, t = _stored(db)
    own.update(t).set({"c_nationkey": raw("c_nationkey + 100")}).where(eq(t["c_mktsegment"], "BUILDING")).execute()
    return own.select(t["c_custkey"], t["c_nationkey"]).from_(t).execute()


@query(f"SELECT c_custkey FROM ({_ALL}) WHERE NOT c_acctbal < 0")
def dml_delete(db):
    own, t = _stored(db)
    own.delete(t).where(lt(t["c_acctbal"], 0)).execute()
    return own.select(t["c_custkey"]).from_(t).execute()


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 1000 ORDER BY c_acctbal DESC, c_custkey LIMIT 7)")
def dml_delete_limit(db):
    own, t = _stored(db)
    own.delete(t).where(lt(t["c_acctbal"], 1000)).order_by(desc(t["c_acctbal"])).limit(7).execute()
    return own.select(t["c_custkey"]).from_(t).execute()


_mail = table("mail", {"id": serial(), "owner": bigint(), "address": varchar().unique()})


@query("SELECT c_custkey AS owner, CASE WHEN c_nationkey < 5 THEN NULL ELSE c_name END AS address FROM customer")
def dml_null_keys(db):
    """Rows without a unique value are equal to no other row; all stay."""
    own = Database.connect(db.spark, "memory:///")
    own.create_tables(_mail)
    rows = db.scan(customer).select(F.col("c_custkey").alias("owner"), F.when(F.col("c_nationkey") >= 5, F.col("c_name")).alias("address"))
    own.insert(_mail).values(rows).on_conflict_do_nothing("address").execute()
    return own.select(_mail["owner"], _mail["address"]).from_(_mail).execute()


@query("SELECT count(*) AS n, min(i) AS low, max(i) AS high, CAST(count(DISTINCT i) AS BIGINT) AS ids FROM (SELECT row_number() OVER () AS i FROM customer)")
def dml_serial_ids(db):
    """Ids of an inserted frame are numbered without gaps, however it is partitioned."""
    own = Database.connect(db.spark, "memory:///")
    own.create_tables(_mail)
    own.insert(_mail).values(db.scan(customer).select(F.col("c_custkey").alias("owner")).repartition(7)).execute()
    i = F.col("id").cast("long")
    return own.scan(_mail).agg(F.count(F.lit(1)).alias("n"), F.min(i).alias("low"), F.max(i).alias("high"), F.count_distinct(i).alias("ids"))


@query("SELECT c_custkey AS owner, c_name AS address FROM customer WHERE c_nationkey >= 5")
def dml_returning(db):
    """An upsert returns the rows as they are stored, under the ids of the rows that were there."""
    own = Database.connect(db.spark, "memory:///")
    own.create_tables(_mail)
    rows = db.scan(customer).select(F.col("c_custkey").alias("owner"), F.col("c_name").alias("address"), "c_nationkey")
    own.insert(_mail).values(rows.filter("c_nationkey < 10").withColumn("owner", F.lit(-1).cast("long")).drop("c_nationkey")).execute()
    more = rows.filter("c_nationkey >= 5").drop("c_nationkey")
    got = own.insert(_mail).values(more).on_conflict_do_update(["address"], {"owner": raw("excluded.owner")}).returning("id", "owner", "address").execute()
    return got.join(own.scan(_mail).select("id", F.col("owner").alias("o"), F.col("address").alias("a")), "id").filter("o = owner AND a = address").select("owner", "address")


@query("SELECT 7 AS n_nationkey, 'kept' AS n_name UNION ALL SELECT 901, 'new' UNION ALL SELECT 902, 'upserted'")
def records_save(db):
    """Records with keys of their own are inserted; stored ones are updated."""
    from ..operators.records import Record

    own = Database.connect(db.spark, "memory:///")
    own.create_tables(nation)
    own.insert(nation).values(db.scan(nation)).execute()

    class Nation(Record):
        pass

    kind = Nation.bind(own, nation)
    kind({"n_nationkey": 901, "n_name": "new", "n_regionkey": 1}).save()
    kind.upsert({"n_nationkey": 902}, {"n_name": "upserted", "n_regionkey": 1})
    kind.find(7).update_with({"n_name": "kept"})
    return own.scan(nation).filter("n_nationkey = 7 OR n_nationkey > 900").select("n_nationkey", "n_name")


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 25")
def rel_ordered(db):
    """Parents keep the order that they were asked in though a relation is joined to them."""
    got = db.query_table(customer).order_by(desc(C["c_acctbal"]), C["c_custkey"]).with_({"orders": True}).find_many()
    return got.limit(25).select("c_custkey", "c_name")


@query("SELECT c_custkey, array_to_string(list(o_orderkey ORDER BY o_totalprice DESC, o_orderkey), ',') AS keys FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE c_nationkey = 3 GROUP BY c_custkey")
def rel_array_order(db):
    """The order within arrays; parents without children have an empty one, and none has null."""
    got = db.query_table(customer).where(eq(C["c_nationkey"], 3)).with_({"orders": {"order_by": desc(O["o_totalprice"])}}).find_many()
    keys = F.array_join(F.transform("orders", lambda o: o["o_orderkey"].cast("string")), ",")
    return got.select("c_custkey", F.when(F.size("orders") == 0, F.lit(None)).otherwise(keys).alias("keys"))


@query("SELECT n_regionkey, stddev_samp(n_nationkey) > 1 AS wide FROM nation GROUP BY n_regionkey HAVING stddev_samp(n_nationkey) > 1")
def having_any_aggregate(db):
    t = nation
    return db.select(t["n_regionkey"], raw("stddev(n_nationkey) > 1").as_("wide")).from_(t).group_by(t["n_regionkey"]).having(raw("stddev(n_nationkey) > 1")).execute()
