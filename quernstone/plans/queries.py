"""The registered queries over the test tables, each with the SQL of its rows."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .. import acl as A
from ..actions import Action, Assign, Step, violation_counts
from ..engine import Engine
from ..errors import EngineError, Validation
from ..functions import expr as E
from ..functions.rendering import ndjson, pairs, tree
from ..lineage import binding_events, closure, edges, runs
from ..ontology import Constraint, Derived, Link, ObjectType, Property, VectorIndex, infer_type
from ..operators.fold import BUCKET, KIND, OFFSET, bounds, emit_cdc, feed, fold, frame_log, lookup_join, precedence_fold, strip
from ..sources.arrow import decode_stream, encode_stream
from ..sources.catalog import Catalog
from ..sources.scratch import shared_dir
from ..streaming.streams import batch_sink, structured
from ..transforms import Transform, cron_next
from . import search, sqlgate

IDS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "lineitem": None, "events": "event_id", "embeddings": "vec_id"}
NAMES = {"orders": "Order", "lineitem": "LineItem", "events": "Event", "embeddings": "Embedding"}
DERIVED = {
    "Customer": (Derived("order_count", "count", "~placedBy"), Derived("total_spend", "sum", "~placedBy", "o_totalprice"), Derived("avg_spend", "avg", "~placedBy", "o_totalprice"), Derived("least_spend", "min", "~placedBy", "o_totalprice"), Derived("most_spend", "max", "~placedBy", "o_totalprice")),
    "Part": (Derived("supply_count", "count", "suppliedBy"), Derived("supplier_balance", "sum", "suppliedBy", "s_acctbal")),
}
LINKS = [
    Link("inRegion", "Nation", "Region", "n_regionkey", "r_regionkey", cardinality="one"),
    Link("inNation", "Customer", "Nation", "c_nationkey", "n_nationkey", cardinality="one"),
    Link("basedIn", "Supplier", "Nation", "s_nationkey", "n_nationkey", cardinality="one"),
    Link("placedBy", "Order", "Customer", "o_custkey", "c_custkey", cardinality="one"),
    Link("ofOrder", "LineItem", "Order", "l_orderkey", "o_orderkey", cardinality="one"),
    Link("suppliedBy", "Part", "Supplier", "p_partkey", "s_suppkey", "lineitem", "l_partkey", "l_suppkey"),
    Link("home", "Supplier", "Supplier", "s_nationkey", "s_suppkey"),
    Link("refersTo", "Event", "Event", "user_id", "event_id"),
]


_SCHEMAS: dict[str, object] = {}  # by path: a table's footers are read once


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def engine(spark: SparkSession, sf_dir: str, warehouse: str | None = None) -> Engine:
    """Types, links and three subjects: admin sees all, analyst some customers
    without their names and no balances, clerk masks supplier names."""
    eng = Engine(spark, warehouse, {n: table(spark, sf_dir, n) for n in IDS})
    for name, identity in IDS.items():
        t = infer_type(NAMES.get(name, name.capitalize()), eng.tables[name].schema, identity, {"embedding": 64})
        eng.registry.define_type(ObjectType(t.name, name, t.properties, identity, DERIVED.get(t.name, ())))
    for link in LINKS:
        eng.registry.define_link(link)
    for kind in ("flat", "ivf_flat", "hnsw"):
        eng.registry.define_index(VectorIndex(kind, "Embedding", "embedding", "cosine", kind))
    for role in ("admin", "analyst", "clerk"):
        eng.acl.add_role(role)
        eng.acl.assign(role, role)
        for t in eng.registry.types:
            eng.acl.grant(role, t)
    eng.acl.set_policy("analyst", "Customer", A.Policy((A.Compare("c_mktsegment", "in", ["BUILDING", "AUTOMOBILE"]),), frozenset({"c_acctbal"}), frozenset({"c_name"})))
    eng.acl.set_policy("analyst", "Order", A.Policy((A.Not(A.Compare("o_orderstatus", "eq", "P")),)))
    eng.acl.set_policy("clerk", "Supplier", A.Policy(mask=frozenset({"s_name"})))
    eng.acl.set_policy("clerk", "Event", A.Policy((A.Compare("event_type", "ne", "error"),)))
    return eng


def _r(column: str, digits: int = 2):
    return F.round(column, digits).alias(column)


QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# --- flat reads


@query("r1_governed_read", "SELECT c_custkey, '***' AS c_name, c_nationkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'AUTOMOBILE')")
def _(spark, d):
    return engine(spark, d).objects("analyst", "Customer", limit=None)


@query("r2_scalar_predicates", "SELECT * FROM customer WHERE c_custkey > 10 AND c_custkey <= 1200 AND c_nationkey != 3 AND c_acctbal >= -500.5 AND c_acctbal < 9000")
def _(spark, d):
    df = engine(spark, d).objects("admin", "Customer", filters={"c_custkey": "gt:10", "c_nationkey": "ne:3", "c_acctbal": "ge:-500.5"}, limit=None)
    return df.where("c_custkey <= 1200 AND c_acctbal < 9000")


@query("r3_set_null_range", "SELECT * FROM orders WHERE o_orderstatus IN ('O', 'F') AND o_orderpriority NOT IN ('1-URGENT', 'a,b') AND o_orderdate IS NOT NULL AND o_totalprice BETWEEN 1000 AND 150000.5")
def _(spark, d):
    return engine(spark, d).objects("admin", "Order", filters={"o_orderstatus": "in:O,F", "o_orderpriority": "nin:1-URGENT,a\\,b", "o_orderdate": "isnotnull:", "o_totalprice": "between:1000,150000.5"}, limit=None)


@query("r4_text_patterns", r"SELECT p_partkey, p_name, p_brand FROM part WHERE p_name ILIKE '%A%' AND p_brand ILIKE 'brand%' AND p_type ILIKE '%L' AND NOT p_name ILIKE '%\%%' ESCAPE '\'")
def _(spark, d):
    return engine(spark, d).objects("admin", "Part", filters={"p_name": "contains:A", "p_brand": "startswith:brand", "p_type": "endswith:L"}, limit=None).select("p_partkey", "p_name", "p_brand")


@query("r5_or_group", "SELECT * FROM part WHERE (p_size < 5 OR p_retailprice > 1500 OR p_brand = 'Brand#11') AND p_partkey > 3")
def _(spark, d):
    return engine(spark, d).objects("admin", "Part", filters={"p_partkey": "gt:3"}, any_of=[["p_size:lt:5", "p_retailprice:gt:1500", "p_brand:eq:Brand#11"]], limit=None)


@query("r6_object_set", "SELECT * FROM supplier WHERE s_suppkey IN (1, 2, 3, 5, 8, 13, 21, 999999)")
def _(spark, d):
    return engine(spark, d).objects("admin", "Supplier", ids=[1, 2, 3, 5, 8, 13, 21, 999999])


@query("r7_keyset_page", "SELECT * FROM orders WHERE o_orderkey > 100 AND o_totalprice > 1000 ORDER BY o_orderkey LIMIT 51")
def _(spark, d):
    return engine(spark, d).page("admin", "Order", size=50, cursor="100", filters={"o_totalprice": "gt:1000"})


_DERIVED_SQL = """SELECT c.c_custkey, count(o.o_orderkey) AS order_count, round(coalesce(sum(o.o_totalprice), 0), 2) AS total_spend, round(avg(o.o_totalprice), 8) AS avg_spend,
  min(o.o_totalprice) AS least_spend, max(o.o_totalprice) AS most_spend FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey {} GROUP BY c.c_custkey"""


@query("r8_derived_over_link", _DERIVED_SQL.format(""))
def _(spark, d):
    df = engine(spark, d).objects("admin", "Customer", derived=True, limit=None)
    return df.select("c_custkey", "order_count", _r("total_spend"), _r("avg_spend", 8), "least_spend", "most_spend")


@query("r8b_derived_governed", _DERIVED_SQL.format("AND NOT o.o_orderstatus = 'P'").replace("FROM customer c", "FROM (SELECT * FROM customer WHERE c_mktsegment IN ('BUILDING', 'AUTOMOBILE')) c"))
def _(spark, d):
    df = engine(spark, d).objects("analyst", "Customer", derived=True, limit=None)
    return df.select("c_custkey", "order_count", _r("total_spend"), _r("avg_spend", 8), "least_spend", "most_spend")


@query("r9_derived_over_join_table", "SELECT p_partkey, count(s_suppkey) AS supply_count, round(coalesce(sum(s_acctbal), 0), 2) AS supplier_balance FROM part LEFT JOIN (lineitem JOIN supplier ON l_suppkey = s_suppkey) ON l_partkey = p_partkey GROUP BY p_partkey")
def _(spark, d):
    return engine(spark, d).objects("admin", "Part", derived=True, limit=None).select("p_partkey", "supply_count", _r("supplier_balance"))


# --- traversal


@query("t1_one_hop", "SELECT * FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def _(spark, d):
    return engine(spark, d).linked("admin", "Order", ["placedBy"], seeds={"o_totalprice": "gt:200000"}, limit=None)


@query(
    "t2_three_hops",
    "SELECT * FROM orders WHERE o_totalprice > 50000 AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0 AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_nationkey != 7 AND n_regionkey IN (SELECT r_regionkey FROM region WHERE r_regionkey <= 2)))",
)
def _(spark, d):
    return engine(spark, d).linked("admin", "Region", ["~inRegion", "~inNation", "~placedBy"], seeds={"r_regionkey": "le:2"}, filters={"inRegion.n_nationkey": "ne:7", "inNation.c_acctbal": "gt:0", "placedBy.o_totalprice": "gt:50000"}, limit=None)


@query("t3_inverse_hop", "SELECT * FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def _(spark, d):
    return engine(spark, d).linked("admin", "Nation", ["~basedIn"], seeds={"n_regionkey": "eq:1"}, limit=None)


@query("t4_join_table_hop", "SELECT s_suppkey, '***' AS s_name, s_nationkey, s_acctbal FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size = 7)")
def _(spark, d):
    return engine(spark, d).linked("clerk", "Part", ["suppliedBy"], seeds={"p_size": "eq:7"}, limit=None)


@query("t5_association", "SELECT DISTINCT p_partkey AS from_id, s_suppkey AS to_id FROM part JOIN lineitem ON l_partkey = p_partkey JOIN supplier ON s_suppkey = l_suppkey WHERE p_size < 10")
def _(spark, d):
    return engine(spark, d).association("admin", "Part", "suppliedBy", seeds={"p_size": "lt:10"})


@query("t6_without_identity", "SELECT DISTINCT l.* FROM lineitem l WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderkey <= 300)")
def _(spark, d):
    return engine(spark, d).linked("admin", "Order", ["~ofOrder"], seeds={"o_orderkey": "le:300"}, limit=None)


# --- graphs

_HOME = "SELECT s_suppkey AS u, t.s AS v FROM supplier JOIN (SELECT s_suppkey AS s FROM supplier) t ON t.s = s_nationkey"
_REACH = "WITH RECURSIVE e AS ({edges}), r AS (SELECT v AS id, 1 AS depth FROM e WHERE u {seeds} UNION SELECT v, depth + 1 FROM r JOIN e ON u = id WHERE depth < {depth}) "


@query("g1_reach", _REACH.format(edges=_HOME, seeds="> 2", depth=3) + "SELECT * FROM supplier WHERE s_suppkey IN (SELECT id FROM r)")
def _(spark, d):
    return engine(spark, d).graph("admin", "Supplier", path="home", seeds={"s_suppkey": "gt:2"}, depth=3, limit=None)


@query("g2_path_cycle", "SELECT * FROM nation WHERE n_regionkey IN (SELECT n_regionkey FROM nation WHERE n_nationkey < 3)")
def _(spark, d):
    return engine(spark, d).graph("admin", "Nation", path="inRegion,~inRegion", seeds={"n_nationkey": "lt:3"}, limit=None)


@query("g3_link_union", _REACH.format(edges=f"{_HOME} UNION SELECT v, u FROM ({_HOME})", seeds="= 3", depth=4) + "SELECT * FROM supplier WHERE s_suppkey IN (SELECT id FROM r)")
def _(spark, d):
    return engine(spark, d).graph("admin", "Supplier", links=["home", "~home"], seeds={"s_suppkey": "eq:3"}, depth=4, limit=None)


@query("g4_core_and_tail", _REACH.format(edges=_HOME, seeds="> 3", depth=5) + "SELECT * FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_suppkey IN (SELECT id FROM r))")
def _(spark, d):
    return engine(spark, d).graph("admin", "Supplier", path="home*,basedIn", seeds={"s_suppkey": "gt:3"}, limit=None)


@query(
    "g5_shortest_path_tree",
    """WITH RECURSIVE live AS (SELECT * FROM events WHERE event_type != 'error'), e AS (SELECT a.event_id AS u, b.event_id AS v FROM live a JOIN live b ON b.event_id = a.user_id),
r AS (SELECT event_id AS id, 0 AS depth, CAST(NULL AS BIGINT) AS parent FROM live WHERE event_id > 500 UNION SELECT v, depth + 1, id FROM r JOIN e ON u = id WHERE depth < 4),
s AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY depth, parent ASC NULLS FIRST) AS n FROM r)
SELECT event_id, user_id, depth AS _depth, parent AS _parent FROM s JOIN live ON id = event_id WHERE n = 1""",
)
def _(spark, d):
    return engine(spark, d).tree("clerk", "Event", "refersTo", seeds={"event_id": "gt:500"}, depth=4).select("event_id", "user_id", "_depth", "_parent")


# --- SQL through the gate

STATEMENTS = {
    "s1_pricing_summary": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_quantity), 4) AS avg_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY l_returnflag, l_linestatus",
    "s2_join_aggregate": "SELECT n_name, count(DISTINCT o_orderkey) AS orders, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name HAVING count(*) > 10",
    "s3_semi_anti": "SELECT c_custkey, c_name FROM customer c WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)",
    "s4_rollup_cube": "SELECT o_orderstatus, o_orderpriority, count(*) AS n, grouping(o_orderpriority) AS g FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "s5_windows": "SELECT o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rk, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS n3 FROM orders",
    "s6_set_operations": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 0 UNION ALL SELECT r_regionkey FROM region",
    "s7_correlated_subquery": "SELECT p_partkey, (SELECT count(*) FROM lineitem WHERE l_partkey = p_partkey) AS n FROM part WHERE p_retailprice > (SELECT avg(p_retailprice) FROM part)",
    "s8_outer_joins": "SELECT n_nationkey, count(s_suppkey) AS n FROM nation FULL OUTER JOIN supplier ON n_nationkey = s_nationkey AND s_acctbal > 0 GROUP BY n_nationkey",
    "s9_top_k": "WITH best AS (SELECT o_custkey, max(o_totalprice) AS top FROM orders GROUP BY o_custkey) SELECT c_custkey, c_mktsegment, top FROM best JOIN customer ON c_custkey = o_custkey ORDER BY top DESC, c_custkey LIMIT 20",
    "s10_grouping_sets": "SELECT p_brand, p_size, count(*) AS n, min(p_retailprice) AS low FROM part GROUP BY GROUPING SETS ((p_brand), (p_size), ())",
    "s11_case_dates_strings": "SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'high' ELSE 'low' END AS tier, extract(year FROM o_orderdate) AS y, upper(substring(o_orderpriority, 1, 3)) AS p, coalesce(nullif(o_orderstatus, 'O'), 'none') AS st FROM orders",
    "s12_cross_and_range_join": "SELECT r_name, n_name FROM region CROSS JOIN nation WHERE n_nationkey BETWEEN r_regionkey * 5 AND r_regionkey * 5 + 4",
    "s15_recursive": "WITH RECURSIVE reach(id, depth) AS (SELECT n_nationkey, 0 FROM nation WHERE n_nationkey < 2 UNION ALL SELECT n_nationkey, depth + 1 FROM reach JOIN nation ON n_nationkey = (id * 7 + 3) % 25 WHERE depth < 6) SELECT id, depth, count(*) AS n FROM reach GROUP BY id, depth",
    "s13_cube": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
}
for _name, _text in STATEMENTS.items():
    QUERIES[_name] = lambda spark, d, text=_text: engine(spark, d).sql("admin", text)
    SQL[_name] = _text
SQL["s11_case_dates_strings"] = STATEMENTS["s11_case_dates_strings"].replace("extract(year FROM o_orderdate)", "CAST(extract(year FROM o_orderdate) AS INTEGER)")
SQL["s4_rollup_cube"] = STATEMENTS["s4_rollup_cube"].replace("grouping(o_orderpriority)", "CAST(grouping(o_orderpriority) AS TINYINT)")


@query("s14_governed_sql", "SELECT c_mktsegment, c_name, count(*) AS n FROM (SELECT c_mktsegment, '***' AS c_name FROM customer WHERE c_mktsegment IN ('BUILDING', 'AUTOMOBILE')) GROUP BY 1, 2")
def _(spark, d):
    return engine(spark, d).sql("analyst", "SELECT c_mktsegment, c_name, count(*) AS n FROM customer GROUP BY c_mktsegment, c_name")


# --- change streams

_CDC = "CASE event_type WHEN 'error' THEN '-D' WHEN 'signup' THEN '+I' ELSE '+U' END"


def _events(spark, d) -> DataFrame:
    kind = F.expr(_CDC)
    return table(spark, d, "events").select("event_id", "user_id", "event_type", "ts", "value", kind.alias(KIND), F.col("event_id").alias(OFFSET))


def _fold_sql(order: str) -> str:
    return f"SELECT event_id, user_id, event_type FROM (SELECT *, {_CDC} AS k, row_number() OVER (PARTITION BY user_id ORDER BY {order}) AS n FROM events) WHERE n = 1 AND k != '-D'"


for _name, _engine, _order in (("f1_fold_last_row", "last_row", "event_id DESC"), ("f2_fold_first_row", "first_row", "event_id"), ("f3_fold_versioned", "versioned", "ts DESC NULLS LAST, event_id DESC")):
    QUERIES[_name] = lambda spark, d, e=_engine: fold(_events(spark, d), "user_id", e, "ts").select("event_id", "user_id", "event_type")
    SQL[_name] = _fold_sql(_order)


@query("f4_log_framing", "SELECT event_id, '+I' AS chg_kind, CAST((row_number() OVER (ORDER BY event_id) - 1) % 4 AS INTEGER) AS chg_bucket, 10 + CAST(floor((row_number() OVER (ORDER BY event_id) - 1) / 4) AS BIGINT) AS chg_offset FROM events")
def _(spark, d):
    rows = frame_log(table(spark, d, "events").select("event_id"), 4, ["event_id"], {b: 10 for b in range(4)})
    return rows.select("event_id", *[F.col(c).alias(c[1:]) for c in (KIND, BUCKET, OFFSET)])


_FRAMED = "SELECT event_id, event_type, CAST((row_number() OVER (ORDER BY event_id) - 1) % 3 AS INTEGER) AS b, CAST(floor((row_number() OVER (ORDER BY event_id) - 1) / 3) AS BIGINT) AS o FROM events"


@query("f5_feed_page", f"SELECT event_id, event_type, b, o FROM ({_FRAMED}) WHERE (b = 0 AND o >= 5) OR (b = 1 AND o >= 100) OR (b = 2 AND o >= 0) ORDER BY b, o LIMIT 256")
def _(spark, d):
    rows = frame_log(table(spark, d, "events").select("event_id", "event_type"), 3, ["event_id"])
    return feed(rows, {0: 5, 1: 100, 2: 0}, 256).select("event_id", "event_type", F.col(BUCKET).alias("b"), F.col(OFFSET).alias("o"))


@query("f6_precedence_merge", "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN -1.0 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 10 != 0 OR o_orderkey % 70 = 0")
def _(spark, d):
    base = table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.lit("+I").alias(KIND), F.lit(0).alias("_prec"))
    gone = base.where("o_orderkey % 10 = 0").withColumns({KIND: F.lit("-D"), "_prec": F.lit(1)})
    new = base.where("o_orderkey % 7 = 0").withColumns({"o_totalprice": F.lit(-1.0), KIND: F.lit("+U"), "_prec": F.lit(2)})
    return precedence_fold(base.unionByName(gone).unionByName(new), "o_orderkey")


@query("f7_offset_bounds", f"SELECT b AS bucket, min(o) AS first_offset, max(o) AS last_offset FROM ({_FRAMED}) GROUP BY b")
def _(spark, d):
    return bounds(frame_log(table(spark, d, "events").select("event_id"), 3, ["event_id"])).withColumnRenamed(BUCKET, "bucket")


def _view(spark, d, sql: str, schema: str, enrich: dict | None = None) -> DataFrame:
    """A view over a log of the events, run to its end in two batches."""
    eng = Engine(spark, shared_dir(spark))
    s = eng.streams
    rows = table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    s.declare("main.log", rows.schema, "log", 2)
    for t, key in (enrich or {}).items():
        eng.catalog.land(t, table(spark, d, t.rsplit(".", 1)[-1]))
    from pyspark.sql.types import StructType

    s.append("main.log", rows.where("event_id % 2 = 0"), ["event_id"])
    s.define_view("v", "main.log", "main.out", sql, StructType.fromDDL(schema), 1, enrich)
    s.run_view("v")
    s.append("main.log", rows.where("event_id % 2 = 1"), ["event_id"])
    s.run_view("v")
    s.run_view("v")
    return strip(s.events("main.out"))


@query("m1_view_over_delta", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type, event_id % 2")
def _(spark, d):
    return _view(spark, d, "SELECT event_type, count(*) AS n FROM delta GROUP BY event_type", "event_type string, n long")


@query("m2_view_lookup_join", "SELECT event_id, c_mktsegment FROM events JOIN customer ON c_custkey = user_id")
def _(spark, d):
    return _view(spark, d, "SELECT event_id, c_mktsegment FROM delta JOIN customer ON c_custkey = user_id", "event_id long, c_mktsegment string", {"main.customer": "user_id=c_custkey"})


@query("m3_view_state_join", "SELECT c_nationkey, event_type, count(*) AS n FROM events JOIN customer ON c_custkey = user_id GROUP BY c_nationkey, event_type, event_id % 2")
def _(spark, d):
    return _view(spark, d, "SELECT c_nationkey, event_type, count(*) AS n FROM delta JOIN customer ON c_custkey = user_id GROUP BY c_nationkey, event_type", "c_nationkey int, event_type string, n long", {"main.customer": None})


@query("m4_stream_to_log", "SELECT event_id, user_id FROM events WHERE event_type = 'click'")
def _(spark, d):
    """Files through Structured Streaming into a log; a batch sent twice counts once."""
    eng, folder = Engine(spark, shared_dir(spark)), shared_dir(spark)
    rows = table(spark, d, "events").where("event_type = 'click'").select("event_id", "user_id")
    rows.repartitionByRange(3, "event_id").write.parquet(folder)
    eng.streams.declare("main.clicks", rows.schema, "log", 2)
    write = batch_sink(eng.streams, "main.clicks", "clicks", ["event_id"])

    def twice(df, batch):
        write(df, batch)
        write(df, batch)

    stream = structured(spark, folder, rows.schema).writeStream.foreachBatch(twice).option("checkpointLocation", shared_dir(spark)).trigger(availableNow=True).start()
    stream.awaitTermination()
    return strip(eng.streams.events("main.clicks"))


# --- vectors

def _nearest_sql(far: str) -> str:
    """The ten nearest rows of every query: each row whose id is divisible by 50."""
    return f"""SELECT query_id, vec_id, round(d, 5) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS n FROM (
SELECT q.vec_id AS query_id, e.vec_id, round({far}, 12) AS d FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0)) WHERE n <= 10"""


_COSINE = _nearest_sql("1 - list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))")
_L2 = _nearest_sql("list_distance(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))")


def _vector_queries(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def _indexed(spark, d, *names: str) -> Engine:
    """An engine whose embeddings are landed in a catalog, with these indexes built."""
    eng = engine(spark, d, shared_dir(spark))
    rows = eng.tables.pop("embeddings")
    eng.catalog.create("embeddings", rows.schema, identity="vec_id")
    eng.catalog.land("embeddings", rows)
    for name in names:
        eng.build_index("Embedding", name)
    return eng


def _found(df: DataFrame) -> DataFrame:
    return df.select("query_id", "vec_id", _r("distance", 5))


@query("v1_knn_cosine", _COSINE)
def _(spark, d):
    return _found(engine(spark, d).search_many("admin", "Embedding", "flat", _vector_queries(spark, d), 10))


@query("v2_knn_l2", _L2)
def _(spark, d):
    return _found(search.knn_many(table(spark, d, "embeddings"), "vec_id", "embedding", _vector_queries(spark, d), 10, "l2"))


@query("v3_ivf_all_probes", _COSINE)
def _(spark, d):
    return _found(_indexed(spark, d, "ivf_flat").search_many("admin", "Embedding", "ivf_flat", _vector_queries(spark, d), 10, nprobe=10**6))


@query("v4_ivf")
def _(spark, d):
    return _found(_indexed(spark, d, "ivf_flat").search_many("admin", "Embedding", "ivf_flat", _vector_queries(spark, d), 10))


@query("v5_hnsw")
def _(spark, d):
    return _found(_indexed(spark, d, "hnsw").search_many("admin", "Embedding", "hnsw", _vector_queries(spark, d), 10))


@query("v6_recall", "SELECT kind, count(*) FILTER (vec_id % 50 = 0) AS queries, true AS nine_of_ten FROM embeddings, (SELECT unnest(['hnsw', 'ivf_flat']) AS kind) GROUP BY kind")
def _(spark, d):
    """Recall of both indexes against brute force, over all queries."""
    eng, asked = _indexed(spark, d, "ivf_flat", "hnsw"), _vector_queries(spark, d)
    want = eng.search_many("admin", "Embedding", "flat", asked, 10).select("query_id", "vec_id")
    out = None
    for kind in ("hnsw", "ivf_flat"):
        hit = eng.search_many("admin", "Embedding", kind, asked, 10).select("query_id", "vec_id", F.lit(True).alias("hit"))
        one = want.join(hit, ["query_id", "vec_id"], "left").agg(F.lit(kind).alias("kind"), F.count_distinct("query_id").alias("queries"), (F.count("hit") >= 0.9 * F.count("*")).alias("nine_of_ten"))
        out = one if out is None else out.unionByName(one)
    return out


_HOT = _nearest_sql("1 - list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))").replace("FROM embeddings e,", "FROM (SELECT vec_id, CASE WHEN vec_id % 20 = 3 THEN list_transform(embedding, lambda x: -x) ELSE embedding END AS embedding FROM embeddings WHERE vec_id % 20 != 7) e,")


@query("v7_cold_and_hot", _HOT)
def _(spark, d):
    """Rows changed, deleted and landed after the build are searched as they are now."""
    eng = engine(spark, d, shared_dir(spark))
    rows = eng.tables.pop("embeddings")
    eng.catalog.create("embeddings", rows.schema, identity="vec_id")
    eng.catalog.land("embeddings", rows.where("vec_id % 3 != 0 OR vec_id % 20 = 3 OR vec_id % 20 = 7"))
    eng.build_index("Embedding", "ivf_flat")
    eng.catalog.land("embeddings", rows.where("vec_id % 3 = 0 AND vec_id % 20 != 3 AND vec_id % 20 != 7"))
    turned = rows.where("vec_id % 20 = 3").withColumn("embedding", F.transform("embedding", lambda x: -x))
    eng.catalog.mutate("embeddings", turned.withColumn(KIND, F.lit("+U")))
    eng.catalog.mutate("embeddings", rows.where("vec_id % 20 = 7").withColumn(KIND, F.lit("-D")))
    return _found(eng.search_many("admin", "Embedding", "ivf_flat", _vector_queries(spark, d), 10, nprobe=10**6))


# --- catalog, lineage, constraints, expressions


@query("p1_pruned_scan", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 1000 AND 1200 AND o_totalprice > 1000")
def _(spark, d):
    from ..functions.predicates import parse

    cat = Catalog(spark, shared_dir(spark))
    rows = table(spark, d, "orders")
    cat.land("main.orders", rows.repartitionByRange(8, "o_orderkey"))
    preds = [parse("o_orderkey", "between:1000,1200", "long"), parse("o_totalprice", "gt:1000", "double")]
    df = cat.scan("main.orders", predicates=preds)
    for p in preds:
        df = df.where(p.condition())
    return df.select("o_orderkey", "o_totalprice")


@query("l1_lineage_closure", "WITH RECURSIVE e AS (SELECT DISTINCT 'c' || o_custkey AS u, 'o' || o_orderkey AS v FROM orders UNION SELECT DISTINCT 'o' || l_orderkey, 'p' || l_partkey FROM lineitem), r AS (SELECT 'c1' AS id, 0 AS depth UNION SELECT v, depth + 1 FROM r JOIN e ON u = id WHERE depth < 4) SELECT id AS dataset, min(depth) AS depth FROM r WHERE depth > 0 GROUP BY id")
def _(spark, d):
    a = table(spark, d, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("u"), F.concat(F.lit("o"), "o_orderkey").alias("v"))
    b = table(spark, d, "lineitem").select(F.concat(F.lit("o"), "l_orderkey").alias("u"), F.concat(F.lit("p"), "l_partkey").alias("v"))
    return closure(a.unionByName(b).distinct(), spark.createDataFrame([("c1",)], "dataset string"), 4)


_RULES = ObjectType(
    "Checked",
    "customer",
    (
        Property("c_custkey", "long", True),
        Property("c_name", "string", constraints=(Constraint("length", max=18), Constraint("pattern", pattern="[0-4]$"))),
        Property("c_acctbal", "double", constraints=(Constraint("range", min=0, max=9000),)),
        Property("c_mktsegment", "string", constraints=(Constraint("one_of", values=("BUILDING", "MACHINERY")),)),
    ),
    "c_custkey",
)


@query(
    "c1_constraint_violations",
    """SELECT 'c_custkey:required' AS rule, count(*) FILTER (c_custkey IS NULL) AS violations FROM customer UNION ALL SELECT 'c_name:length', count(*) FILTER (length(c_name) > 18) FROM customer
UNION ALL SELECT 'c_name:pattern', count(*) FILTER (NOT regexp_matches(c_name, '[0-4]$')) FROM customer UNION ALL SELECT 'c_acctbal:range', count(*) FILTER (c_acctbal < 0 OR c_acctbal > 9000) FROM customer
UNION ALL SELECT 'c_mktsegment:one_of', count(*) FILTER (c_mktsegment NOT IN ('BUILDING', 'MACHINERY')) FROM customer""",
)
def _(spark, d):
    return violation_counts(_RULES, table(spark, d, "customer"))


@query("x1_expressions", "SELECT p_partkey, p_brand || '-' || upper(p_name) AS a, CASE WHEN p_size > 25 AND p_retailprice < 1500 THEN p_size // 7 ELSE -(p_size % 7) END AS b, length(substr(p_type, 2, 2)) AS c FROM part")
def _(spark, d):
    df = table(spark, d, "part")
    props = {f.name: {"bigint": "long", "int": "integer"}.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema}
    make = lambda s: E.compile_column(E.parse(s), props)
    return df.select("p_partkey", make("@p_brand ++ '-' ++ upper(@p_name)").alias("a"), make("if @p_size > 25 and @p_retailprice < 1500 then @p_size / 7 else -(@p_size % 7)").cast("long").alias("b"), make("length(substr(@p_type, 2, 2))").alias("c"))


# --- changes, snapshots, policies


def _repriced(df: DataFrame) -> DataFrame:
    return df.where("o_orderkey % 10 != 0").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 7 == 0, F.lit(-1.0)).otherwise(F.col("o_totalprice")))


@query(
    "f8_change_emission",
    """SELECT o_orderkey, o_totalprice, '-D' AS chg_kind FROM orders WHERE o_orderkey % 10 = 0
UNION ALL SELECT o_orderkey, o_totalprice, '-U' FROM orders WHERE o_orderkey % 10 != 0 AND o_orderkey % 7 = 0 AND o_totalprice != -1.0
UNION ALL SELECT o_orderkey, -1.0, '+U' FROM orders WHERE o_orderkey % 10 != 0 AND o_orderkey % 7 = 0 AND o_totalprice != -1.0""",
)
def _(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return emit_cdc(rows, _repriced(rows), "o_orderkey").select("o_orderkey", "o_totalprice", F.col(KIND).alias("chg_kind"))


@query("f9_lookup_join", "SELECT event_id, c_name FROM events JOIN customer ON c_custkey = user_id WHERE event_type = 'purchase'")
def _(spark, d):
    delta = table(spark, d, "events").where("event_type = 'purchase'")
    return lookup_join(delta, table(spark, d, "customer"), {"user_id": "c_custkey"}).select("event_id", "c_name")


def _orders_catalog(spark, d) -> tuple[Catalog, int]:
    """Orders landed, then some deleted and repriced in the inline tier."""
    cat = Catalog(spark, shared_dir(spark))
    rows = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    cat.create("main.orders", rows.schema, identity="o_orderkey")
    first = cat.land("main.orders", rows)
    cat.mutate("main.orders", rows.where("o_orderkey % 10 = 0").withColumn(KIND, F.lit("-D")))
    cat.mutate("main.orders", _repriced(rows).where("o_orderkey % 7 = 0").withColumn(KIND, F.lit("+U")))
    return cat, first


_AFTER = "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN -1.0 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 10 != 0"


@query("p2_merge_on_read", _AFTER)
def _(spark, d):
    return _orders_catalog(spark, d)[0].scan("main.orders")


@query("p3_consolidated", _AFTER)
def _(spark, d):
    cat, _ = _orders_catalog(spark, d)
    cat.consolidate("main.orders")
    cat.land("main.orders", cat.scan("main.orders").limit(0))
    cat.compact("main.orders")
    return cat.scan("main.orders")


@query("p4_time_travel", "SELECT o_orderkey, o_totalprice FROM orders")
def _(spark, d):
    cat, first = _orders_catalog(spark, d)
    cat.land("main.orders", cat.scan("main.orders").limit(0), mode="overwrite")
    return cat.scan("main.orders", cat.as_of(first))


@query("p5_file_statistics", "SELECT 'o_orderkey' AS column, count(*) AS rows, CAST(0 AS BIGINT) AS nulls, min(o_orderkey) AS low, max(o_orderkey) AS high FROM orders")
def _(spark, d):
    cat = Catalog(spark, shared_dir(spark))
    cat.land("main.orders", table(spark, d, "orders").repartitionByRange(4, "o_orderkey"))
    s = cat.statistics("main.orders").where("column = 'o_orderkey'")
    return s.groupBy("column").agg(F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls"), F.min(F.col("low").cast("long")).alias("low"), F.max(F.col("high").cast("long")).alias("high"))


@query("w1_write_policy", "SELECT o_orderkey, coalesce(NOT o_orderstatus = 'P' AND (o_orderpriority IN ('1-URGENT', '2-HIGH') OR o_orderkey < 100), false) AS admitted FROM orders")
def _(spark, d):
    policy = A.Policy((A.Not(A.Compare("o_orderstatus", "eq", "P")), A.Or((A.Compare("o_orderpriority", "in", ["1-URGENT", "2-HIGH"]), A.Compare("o_orderkey", "lt", 100)))))
    return table(spark, d, "orders").select("o_orderkey", F.coalesce(policy.condition(), F.lit(False)).alias("admitted"))


@query("w2_governed_view", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_totalprice > 100000 AND o_orderstatus != 'F'")
def _(spark, d):
    eng = engine(spark, d)
    eng.define_view("large_orders", "orders", "o_totalprice > 100000", ["o_orderkey", "o_orderpriority"])
    eng.acl.grant("analyst", "large_orders")
    eng.acl.set_policy("analyst", "large_orders", A.Policy((A.Compare("o_orderstatus", "ne", "F"),)))
    return eng.sql("analyst", "SELECT * FROM large_orders")


@query("l2_run_history", "SELECT CAST(user_id AS VARCHAR) AS run, max(event_id) AS time, bool_or(event_type = 'purchase') AS wrote FROM events GROUP BY user_id")
def _(spark, d):
    log = table(spark, d, "events").select(F.col("user_id").cast("string").alias("run"), F.col("event_id").alias("time"), F.lit("complete").alias("state"), F.lit("x").alias("dataset"), F.when(F.col("event_type") == "purchase", "output").otherwise("input").alias("direction"))
    return runs(log).select("run", "time", "wrote")


@query("l3_visible_closure", "WITH RECURSIVE e AS (SELECT DISTINCT 'c' || o_custkey AS u, 'o' || o_orderkey AS v FROM orders WHERE o_orderstatus != 'F'), r AS (SELECT 'c1' AS id, 0 AS depth UNION SELECT v, depth + 1 FROM r JOIN e ON u = id WHERE depth < 3) SELECT id AS dataset, min(depth) AS depth FROM r WHERE depth > 0 GROUP BY id")
def _(spark, d):
    o = table(spark, d, "orders")
    steps = o.select(F.concat(F.lit("c"), "o_custkey").alias("u"), F.concat(F.lit("o"), "o_orderkey").alias("v")).distinct()
    readable = o.where("o_orderstatus != 'F'").select(F.concat(F.lit("o"), "o_orderkey").alias("dataset")).unionByName(spark.createDataFrame([("c1",)], "dataset string"))
    return closure(steps, spark.createDataFrame([("c1",)], "dataset string"), 3, readable=readable)


# --- lifecycles: jobs, actions, streams, maintenance, metadata


def _warehouse(spark, d, *names: str) -> Engine:
    """An engine whose named tables are empty in a catalog, to be landed."""
    eng = engine(spark, d, shared_dir(spark))
    for n in names:
        eng.catalog.create(n, eng.tables.pop(n).schema, identity=IDS[n])
    return eng


def _chain(spark, d) -> Engine:
    """Orders landed; two transforms run as jobs, each triggered by the commit before."""
    eng = _warehouse(spark, d, "orders")
    eng.transforms.define(Transform("spend", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey", ("orders",), "main.spend", triggers=("orders",)))
    eng.transforms.define(Transform("often", "SELECT o_custkey, n FROM spend WHERE n > 10", ("main.spend",), "main.often", triggers=("main.spend",)))
    eng.land("orders", table(spark, d, "orders"))
    eng.transforms.tick()
    return eng


@query("j1_triggered_transforms", "SELECT o_custkey, n FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) WHERE n > 10")
def _(spark, d):
    return _chain(spark, d).catalog.scan("main.often")


@query("j2_lineage_of_commits", "SELECT 'main.spend' AS dataset, 1 AS depth UNION ALL SELECT 'main.often', 2")
def _(spark, d):
    log = _chain(spark, d).lineage.frame(spark)
    return closure(edges(log), spark.createDataFrame([("orders",)], "dataset string"), 5)


@query("j3_compaction_job", "SELECT n_nationkey, n_name, 1 AS files FROM nation")
def _(spark, d):
    """Small files make a job, which makes one file of them."""
    eng, rows = _warehouse(spark, d, "nation"), table(spark, d, "nation")
    for i in range(8):
        eng.land("nation", rows.where(F.col("n_nationkey") % 8 == i).coalesce(1))
    eng.transforms.tick()
    return eng.catalog.scan("nation").select("n_nationkey", "n_name", F.lit(len(eng.catalog.entry("nation")["files"])).alias("files"))


@query("a1_write_actions", "SELECT s_suppkey, s_name, CASE WHEN s_suppkey = 3 THEN 1.5 ELSE s_acctbal END AS s_acctbal FROM supplier WHERE s_suppkey != 5 UNION ALL SELECT 900001, 'NEW-900001', -2.0")
def _(spark, d):
    """An insert with an expression, an update and a delete, then the read fold."""
    eng = _warehouse(spark, d, "supplier")
    eng.acl.grant("admin", "Supplier", "write")
    eng.land("supplier", table(spark, d, "supplier"))
    define = eng.registry.define_action
    define(Action("open", {"key": ("long", True)}, (Step("Supplier", binds=(("s_suppkey", "key"),), assigns=(Assign("s_name", const="NEW-900001"), Assign("s_nationkey", const=1), Assign("s_acctbal", expr="-2.0"))),)))
    define(Action("set", {"key": ("long", True), "to": ("double", True)}, (Step("Supplier", "update", (("s_acctbal", "to"),), locate="key"),)))
    define(Action("close", {"key": ("long", True)}, (Step("Supplier", "delete", locate="key"),)))
    eng.actions.run("admin", "open", {"key": 900001})
    eng.actions.run("admin", "set", {"key": 3, "to": 1.5})
    eng.actions.run("admin", "close", {"key": 5})
    return eng.catalog.scan("supplier").select("s_suppkey", "s_name", "s_acctbal")


@query("a2_inherited_role", "SELECT c_custkey, '***' AS c_name, c_nationkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'AUTOMOBILE') AND c_nationkey < 10")
def _(spark, d):
    """A role inherits another's grants and policies, and adds a row filter."""
    eng = engine(spark, d)
    eng.acl.add_role("intern", "analyst")
    eng.acl.assign("ina", "intern")
    eng.acl.set_policy("intern", "Customer", A.Policy((A.Compare("c_nationkey", "lt", 10),)))
    return eng.objects("ina", "Customer", limit=None)


@query("r10_default_limit", "SELECT event_id, user_id FROM events ORDER BY event_id LIMIT 1000")
def _(spark, d):
    return engine(spark, d).objects("admin", "Event").select("event_id", "user_id")


def _changes(spark, d) -> Engine:
    """A change stream of orders: all of them, then some gone and repriced."""
    eng, rows = Engine(spark, shared_dir(spark)), table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    eng.streams.declare("main.changes", rows.schema, "cdc", 2, "o_orderkey")
    eng.streams.change("main.changes", rows)
    eng.streams.change("main.changes", _repriced(rows))
    return eng


@query("m5_change_stream_state", _AFTER)
def _(spark, d):
    eng = _changes(spark, d)
    eng.streams.consolidate("main.changes")
    return eng.streams.state("main.changes")


@query(
    "m6_change_events",
    """SELECT kind, count(*) AS n, true AS gapless FROM (SELECT unnest(CASE WHEN o_orderkey % 10 = 0 THEN ['+I', '-D'] WHEN o_orderkey % 7 = 0 THEN ['+I', '-U', '+U'] ELSE ['+I'] END) AS kind FROM orders) GROUP BY kind""",
)
def _(spark, d):
    events = _changes(spark, d).streams.events("main.changes")
    whole = events.groupBy(BUCKET).agg((F.count_distinct(OFFSET) == F.max(OFFSET) + 1).alias("fine")).agg(F.bool_and("fine").alias("gapless"))
    return events.groupBy(F.col(KIND).alias("kind")).agg(F.count("*").alias("n")).crossJoin(F.broadcast(whole))


@query("m7_feed_by_cursor", "SELECT n_nationkey, CAST((row_number() OVER (ORDER BY n_nationkey) - 1) % 2 AS INTEGER) AS bucket, CAST(floor((row_number() OVER (ORDER BY n_nationkey) - 1) / 2) AS BIGINT) AS at FROM nation")
def _(spark, d):
    """All pages of a feed, one after another by their cursors."""
    s, rows = Engine(spark, shared_dir(spark)).streams, table(spark, d, "nation").select("n_nationkey")
    s.declare("main.log", rows.schema, "log", 2)
    s.append("main.log", rows, ["n_nationkey"])
    out, (page, cursor) = [], s.page("main.log", limit=10)
    while page:
        out += [(r["n_nationkey"], r[BUCKET], r[OFFSET]) for r in page]
        page, cursor = s.page("main.log", cursor, limit=10)
    return spark.createDataFrame(out, "n_nationkey int, bucket int, at long")


@query("p6_inline_tier_flushed", "SELECT o_orderkey, o_totalprice FROM orders")
def _(spark, d):
    cat, rows = Catalog(spark, shared_dir(spark)), table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    cat.land("main.log", rows.where("o_orderkey % 2 = 0"))
    cat.land("main.log", rows.where("o_orderkey % 2 != 0"), size=10)
    cat.flush("main.log")
    return cat.scan("main.log")


@query("p7_counts_and_history", "SELECT count(*) FILTER (o_orderkey % 2 = 0) AS rows_in_files, 3 AS versions FROM orders")
def _(spark, d):
    cat, rows = Catalog(spark, shared_dir(spark)), table(spark, d, "orders").select("o_orderkey")
    cat.land("main.log", rows.where("o_orderkey % 2 = 0"))
    cat.land("main.log", rows.where("o_orderkey % 2 != 0"), size=10)
    return spark.createDataFrame([(cat.row_count("main.log"), len(cat.history("main.log")))], "rows_in_files long, versions int")


@query("p8_garbage_and_orphans", "SELECT r_regionkey, r_name, true AS older_gone FROM region WHERE r_regionkey > 1")
def _(spark, d):
    """Files out of the retention and files no version names go; the rest reads on."""
    now = [1000.0]
    cat, rows = Catalog(spark, shared_dir(spark), lambda: now[0]), table(spark, d, "region")
    cat.land("main.region", rows)
    cat.land("main.region", rows.where("r_regionkey > 1"), mode="overwrite")
    now[0] += 30 * 86400
    cat.land("main.region", rows.limit(0))
    now[0] += 1
    gone = cat.gc()
    cat.write_files("main.region", rows)
    now[0] = 10.0**11
    gone += cat.sweep_orphans()
    return cat.scan("main.region").select("r_regionkey", "r_name", F.lit(len(gone) >= 2).alias("older_gone"))


@query("p9_pruned_with_inline_rows", "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN -1.0 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey BETWEEN 1000 AND 1200 AND o_orderkey % 10 != 0")
def _(spark, d):
    """Files are pruned although the inline tier changes some of their rows."""
    from ..functions.predicates import parse

    p = parse("o_orderkey", "between:1000,1200", "long")
    return _orders_catalog(spark, d)[0].scan("main.orders", predicates=[p]).where(p.condition())


@query("d1_dataset_list", "SELECT 'nation' AS name, count(*) AS rows FROM nation UNION ALL SELECT 'region', count(*) FROM region")
def _(spark, d):
    eng = _warehouse(spark, d, "nation", "region")
    for n in ("nation", "region"):
        eng.land(n, table(spark, d, n))
    return spark.createDataFrame([(x["name"], x["rows"]) for x in eng.datasets("admin", "rows") if x["rows"] is not None], "name string, rows long")


@query("d2_links_of_a_type", "SELECT * FROM (VALUES ('basedIn', 'Nation'), ('home', 'Supplier'), ('~home', 'Supplier'), ('~suppliedBy', 'Part')) t(link, target)")
def _(spark, d):
    return spark.createDataFrame([(n, x.target) for n, x in engine(spark, d).type_detail("Supplier")["links"]], "link string, target string")


@query("d3_arrow_stream", "SELECT r_regionkey, r_name FROM region")
def _(spark, d):
    return decode_stream(spark, encode_stream(engine(spark, d).sql("admin", "SELECT r_regionkey, r_name FROM region")))


@query("d4_exported_rows", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2")
def _(spark, d):
    rows = sqlgate.export(engine(spark, d).sql("admin", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2"))
    return spark.createDataFrame(list(rows), "n_nationkey int, n_name string")


@query("p10_schema_evolution", "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 1 THEN n_name END AS note, true AS drop_refused FROM nation")
def _(spark, d):
    """A landing may bring nullable columns, but not leave any out."""
    cat, rows = Catalog(spark, shared_dir(spark)), table(spark, d, "nation")
    cat.land("main.n", rows.where("n_nationkey % 2 = 0").select("n_nationkey"))
    cat.land("main.n", rows.where("n_nationkey % 2 = 1").select("n_nationkey", F.col("n_name").alias("note")))
    strict = StructType([StructField("a", LongType(), False), StructField("b", LongType(), False)])
    cat.create("main.strict", strict)
    return cat.scan("main.n").withColumn("drop_refused", F.lit(_refusal(lambda: cat.land("main.strict", spark.range(1).select(F.col("id").alias("a")))) == "Validation"))


def _refusal(call) -> str:
    """The name of the error that a call raises, or done."""
    try:
        call()
        return "done"
    except EngineError as e:
        return type(e).__name__


@query("p11_empty_live_table", "SELECT r_regionkey, r_name FROM region WHERE false")
def _(spark, d):
    cat = Catalog(spark, shared_dir(spark))
    cat.create("main.region", table(spark, d, "region").schema)
    return cat.scan("main.region").select("r_regionkey", "r_name")


@query("p12_additive_tiers", "SELECT r_regionkey, r_name FROM region UNION ALL SELECT r_regionkey, r_name FROM region WHERE r_regionkey < 3")
def _(spark, d):
    """Without an identity, inline rows add to those of files."""
    cat, rows = Catalog(spark, shared_dir(spark)), table(spark, d, "region").select("r_regionkey", "r_name")
    cat.land("main.region", rows)
    cat.land("main.region", rows.where("r_regionkey < 3"), size=10)
    return cat.scan("main.region")


@query("p13_pinned_snapshot", "SELECT r_name, count(n_nationkey) AS nations FROM region LEFT JOIN nation ON n_regionkey = r_regionkey AND n_nationkey % 2 = 0 GROUP BY r_name")
def _(spark, d):
    """Two tables read at one snapshot, whatever is landed meanwhile."""
    eng, rows = _warehouse(spark, d, "nation", "region"), table(spark, d, "nation")
    eng.land("region", table(spark, d, "region"))
    eng.land("nation", rows.where("n_nationkey % 2 = 0"))
    at = eng.at()
    eng.land("nation", rows.where("n_nationkey % 2 = 1"))
    eng.land("region", table(spark, d, "region").limit(0), mode="overwrite")
    n = eng.table("nation", at)
    r = eng.table("region", at)
    return r.join(n, n["n_regionkey"] == r["r_regionkey"], "left").groupBy("r_name").agg(F.count("n_nationkey").alias("nations"))


@query("p14_concurrent_commits", "SELECT n_nationkey, n_name FROM nation")
def _(spark, d):
    """A commit that finds its version taken is made again on the newer one."""
    root, rows = shared_dir(spark), table(spark, d, "nation").select("n_nationkey", "n_name")
    one, other = Catalog(spark, root), Catalog(spark, root)
    one.land("main.n", rows.where("n_nationkey < 10"))
    new = one.write_files("main.n", rows.where("n_nationkey >= 20"))
    late = []

    def change(tx):
        if not late:
            late.append(other.land("main.n", rows.where("n_nationkey BETWEEN 10 AND 19")))
        tx.edit("main.n")["files"] += new

    one.commit(change)
    return other.scan("main.n")


@query("a3_two_objects_one_commit", "SELECT 'nation' AS type, 900 AS id, 1 AS commits UNION ALL SELECT 'supplier', 900001, 1")
def _(spark, d):
    """Two steps, the second with the first one's key, in one version."""
    eng = _warehouse(spark, d, "nation", "supplier")
    for t in ("Nation", "Supplier"):
        eng.acl.grant("admin", t, "write")
    first = Step("Nation", binds=(("n_nationkey", "nation"),), assigns=(Assign("n_name", const="NEW"), Assign("n_regionkey", const=1)), bind="n")
    second = Step("Supplier", binds=(("s_suppkey", "key"),), assigns=(Assign("s_name", const="x"), Assign("s_nationkey", ref="n.n_nationkey"), Assign("s_acctbal", const=1.0)))
    eng.registry.define_action(Action("both", {"nation": ("integer", True), "key": ("long", True)}, (first, second)))
    before = eng.catalog.current().id
    eng.actions.run("admin", "both", {"nation": 900, "key": 900001})
    n = eng.catalog.scan("nation").select(F.lit("nation").alias("type"), F.col("n_nationkey").alias("id"))
    s = eng.catalog.scan("supplier").where("s_nationkey = 900").select(F.lit("supplier").alias("type"), F.col("s_suppkey").cast("int").alias("id"))
    return n.unionByName(s).withColumn("commits", F.lit(eng.catalog.current().id - before))


@query("a4_refused_writes", "SELECT * FROM (VALUES ('allowed update', 'done'), ('denied column', 'Forbidden'), ('hidden row', 'NotFound'), ('row leaves the filter', 'Forbidden'), ('insert outside the filter', 'Forbidden'), ('unknown parameter', 'Validation'), ('no grant', 'Forbidden')) t(case_name, outcome)")
def _(spark, d):
    """The three legs of the write policy: the row as it is, the columns, the row as it will be."""
    eng = _warehouse(spark, d, "supplier")
    eng.land("supplier", table(spark, d, "supplier"))
    eng.acl.add_role("keeper")
    eng.acl.assign("kim", "keeper")
    for what in ("read", "write"):
        eng.acl.grant("keeper", "Supplier", what)
    eng.acl.set_policy("keeper", "Supplier", A.Policy((A.Compare("s_acctbal", "lt", 10_000_000), A.Compare("s_suppkey", "ne", 5)), frozenset({"s_name"})))
    params = {"key": ("long", True), "to": ("double", False), "name": ("string", False)}
    eng.registry.define_action(Action("set", params, (Step("Supplier", "update", (("s_acctbal", "to"), ("s_name", "name")), locate="key"),)))
    eng.registry.define_action(Action("add", params, (Step("Supplier", binds=(("s_suppkey", "key"), ("s_acctbal", "to"), ("s_name", "name"))),)))
    run = lambda who, name, given: _refusal(lambda: eng.actions.run(who, name, given))
    rows = [
        ("allowed update", run("kim", "set", {"key": 3, "to": 2.0})), ("denied column", run("kim", "set", {"key": 3, "name": "x"})), ("hidden row", run("kim", "set", {"key": 5, "to": 2.0})),
        ("row leaves the filter", run("kim", "set", {"key": 3, "to": 1e9})), ("insert outside the filter", run("kim", "add", {"key": 900002, "to": 1e9})), ("unknown parameter", run("kim", "set", {"key": 3, "odd": 1})), ("no grant", run("clerk", "set", {"key": 3, "to": 2.0})),
    ]
    return spark.createDataFrame(rows, "case_name string, outcome string")


@query("a5_visible_datasets", "SELECT * FROM (VALUES ('admin', 2), ('nobody', 0), ('reader', 1)) t(subject, datasets)")
def _(spark, d):
    eng = _warehouse(spark, d, "nation", "region")
    eng.tables = {}
    eng.acl.add_role("reader")
    eng.acl.assign("reader", "reader")
    eng.acl.grant("reader", "Nation")
    return spark.createDataFrame([(s, len(eng.datasets(s))) for s in ("admin", "nobody", "reader")], "subject string, datasets int")


@query("r11_refused_filters", "SELECT * FROM (VALUES ('denied', 'BadFilter'), ('masked', 'BadFilter'), ('unknown', 'BadFilter'), ('bad operand', 'BadFilter'), ('bad operator', 'BadFilter'), ('no grant', 'Forbidden'), ('fine', 'done')) t(case_name, outcome)")
def _(spark, d):
    """Visibility comes before the operand is looked at."""
    eng = engine(spark, d)
    ask = lambda f, who="analyst": _refusal(lambda: eng.objects(who, "Customer", filters=f))
    rows = [("denied", ask({"c_acctbal": "gt:1"})), ("masked", ask({"c_name": "eq:x"})), ("unknown", ask({"nothing": "eq:1"})), ("bad operand", ask({"c_custkey": "gt:abc"})), ("bad operator", ask({"c_custkey": "like:1"})), ("no grant", ask({}, "nobody")), ("fine", ask({"c_custkey": "gt:1"}))]
    return spark.createDataFrame(rows, "case_name string, outcome string")


@query("r12_refused_pages_and_graphs", "SELECT * FROM (VALUES ('no identity', 'BadPagination'), ('object set', 'BadPagination'), ('bad cursor', 'BadPagination'), ('depth', 'BadGraphPath'), ('path and links', 'BadGraphPath'), ('two stars', 'BadGraphPath'), ('long chain', 'BadChain'), ('unknown link', 'UnknownLink')) t(case_name, outcome)")
def _(spark, d):
    eng = engine(spark, d)
    rows = [
        ("no identity", _refusal(lambda: eng.page("admin", "LineItem"))), ("object set", _refusal(lambda: eng.page("admin", "Nation", ids=[1]))), ("bad cursor", _refusal(lambda: eng.page("admin", "Nation", cursor="x"))),
        ("depth", _refusal(lambda: eng.graph("admin", "Supplier", path="home", depth=11))), ("path and links", _refusal(lambda: eng.graph("admin", "Supplier", path="home", links=["home"]))), ("two stars", _refusal(lambda: eng.graph("admin", "Supplier", path="home*,home*"))),
        ("long chain", _refusal(lambda: eng.linked("admin", "Supplier", ["home"] * 5))), ("unknown link", _refusal(lambda: eng.linked("admin", "Supplier", ["nowhere"]))),
    ]
    return spark.createDataFrame(rows, "case_name string, outcome string")


@query("r13_previewed_rows", "SELECT c_custkey, '***' AS c_name, c_nationkey, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_custkey LIMIT 7")
def _(spark, d):
    return engine(spark, d).preview("analyst", "Customer", {"c_mktsegment": "eq:BUILDING"}, 7)


@query("d5_rendered_rows", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def _(spark, d):
    """Objects as JSON clients get them, read back."""
    eng = engine(spark, d)
    lines = [json.dumps(r) for r in eng.rendered("admin", "Nation", eng.objects("admin", "Nation"))]
    return spark.createDataFrame([(x,) for x in lines], "j string").select(F.from_json("j", "n_nationkey int, n_name string, n_regionkey int").alias("r")).select("r.*")


@query("d6_rendered_pairs", "SELECT n_nationkey AS nation, n_regionkey AS region FROM nation WHERE n_regionkey < 3")
def _(spark, d):
    eng = engine(spark, d)
    rows = pairs(eng.association("admin", "Nation", "inRegion").where("to_id < 3").collect())
    return spark.createDataFrame([(r["from"], r["to"]) for r in rows], "nation int, region int")


@query("d7_rendered_tree", "SELECT n_nationkey AS id, 1 AS depth, n_nationkey % 5 AS parent FROM nation WHERE n_nationkey BETWEEN 5 AND 9 UNION ALL SELECT n_nationkey, 0, NULL FROM nation WHERE n_nationkey < 5")
def _(spark, d):
    """A two-level tree of nations, each of which refers to its number modulo five."""
    eng = engine(spark, d)
    rows = table(spark, d, "nation").where("n_nationkey < 10").select(F.col("n_nationkey").alias("id"), F.when(F.col("n_nationkey") >= 5, F.col("n_nationkey") % 5).alias("under"))
    eng.tables["tree"] = rows
    eng.registry.define_type(ObjectType("Leaf", "tree", (Property("id", "integer", True), Property("under", "integer")), "id"))
    eng.registry.define_link(Link("under", "Leaf", "Leaf", "id", "under"))
    eng.acl.grant("admin", "Leaf")
    got = tree(eng.tree("admin", "Leaf", "under", seeds={"id": "lt:5"}).collect(), "id")
    return spark.createDataFrame([(n["id"], n["depth"], n["parent"]) for n in got["nodes"]], "id int, depth int, parent int")


@query("d8_feed_as_lines", "SELECT n_nationkey, '+I' AS kind, n_name FROM nation WHERE n_regionkey != 1")
def _(spark, d):
    """A governed change feed as JSON lines, to its end."""
    eng, rows = engine(spark, d, shared_dir(spark)), table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    eng.streams.declare("main.feed", rows.schema, "cdc", 2, "n_nationkey")
    eng.streams.change("main.feed", rows)
    eng.registry.define_type(ObjectType("Feed", "main.feed", tuple(Property(p.name, p.type) for p in infer_type("x", rows.schema).properties), "n_nationkey"))
    eng.acl.grant("clerk", "Feed")
    eng.acl.set_policy("clerk", "Feed", A.Policy((A.Compare("n_regionkey", "ne", 1),)))
    lines = [json.loads(x) for x in ndjson(eng, "clerk", "Feed", batch=7)]
    return spark.createDataFrame([(x["n_nationkey"], x["_kind"], x["n_name"]) for x in lines if "cursor" not in x], "n_nationkey int, kind string, n_name string")


@query("d9_inferred_type", "SELECT * FROM (VALUES ('event_id', 'long'), ('ts', 'timestamp'), ('user_id', 'long'), ('event_type', 'string'), ('value', 'double'), ('props', 'string')) t(property, type)")
def _(spark, d):
    return spark.createDataFrame([(p.name, p.type) for p in infer_type("Event", table(spark, d, "events").schema, "event_id").properties], "property string, type string")


@query("s16_console", "SELECT c_custkey, true AS more FROM customer WHERE c_mktsegment IN ('BUILDING', 'AUTOMOBILE') ORDER BY c_custkey LIMIT 5")
def _(spark, d):
    rows, more = engine(spark, d).console("analyst", "SELECT c_custkey FROM customer ORDER BY c_custkey", limit=5)
    return spark.createDataFrame([(r[0], more) for r in rows], "c_custkey long, more boolean")


@query("s17_validated_statements", "SELECT * FROM (VALUES (0, 0), (1, 1), (2, 1), (3, 1), (4, 1), (5, 0)) t(statement, problems)")
def _(spark, d):
    eng = engine(spark, d)
    statements = ["SELECT c_custkey FROM customer", "SELECT nothing FROM customer", "SELEC 1", "DROP TABLE customer", "EXPLAIN SELECT 1", "WITH a AS (SELECT 1 AS x) SELECT x FROM a"]
    return spark.createDataFrame([(i, len(eng.validate("analyst", s))) for i, s in enumerate(statements)], "statement int, problems int")


@query("j4_typed_transform", "SELECT o_custkey AS c, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey")
def _(spark, d):
    """Object types in, an object type out, which the result must match exactly."""
    eng = _warehouse(spark, d, "orders")
    eng.land("orders", table(spark, d, "orders"))
    eng.registry.define_type(ObjectType("Spend", "main.spend", (Property("c", "long"), Property("total", "double")), "c"))
    eng.transforms.define(Transform("spend", "SELECT o_custkey AS c, sum(o_totalprice) AS total FROM Order GROUP BY o_custkey".replace("Order ", "`Order` "), ("Order",), "Spend", "typed"))
    eng.transforms.run("spend")
    return eng.catalog.scan("main.spend").select("c", _r("total"))


@query("j5_refused_definitions", "SELECT * FROM (VALUES ('cycle', 'Conflict'), ('bad cron', 'Validation'), ('name', 'Validation'), ('two inputs of a name', 'Validation'), ('another type', 'Validation'), ('fine', 'done')) t(case_name, outcome)")
def _(spark, d):
    eng = _warehouse(spark, d, "nation")
    define = lambda *a, **k: _refusal(lambda: eng.transforms.define(Transform(*a, **k)))
    rows = [("fine", define("a", "SELECT * FROM nation", ("nation",), "main.a", triggers=("main.b",))), ("cycle", define("b", "SELECT 1", (), "main.b", triggers=("main.a",))), ("bad cron", define("c", "SELECT 1", (), "main.c", cron="61 * * * *")), ("name", define("run", "SELECT 1", (), "main.c")), ("two inputs of a name", define("d", "SELECT 1", ("x.t", "y.t"), "main.c"))]
    eng.land("nation", table(spark, d, "nation"))
    define("typed", "SELECT n_name FROM Nation", ("Nation",), "Region", "typed")
    rows.append(("another type", _refusal(lambda: eng.transforms.run("typed"))))
    return spark.createDataFrame(rows, "case_name string, outcome string")


@query("j6_cron", "SELECT * FROM (VALUES ('30 4 * * 1', TIMESTAMP '2024-03-04 04:30:00'), ('0 0 29 2 *', TIMESTAMP '2024-02-29 00:00:00'), ('*/15 8-9 1,15 * 7', TIMESTAMP '2024-03-01 08:00:00')) t(cron, due)")
def _(spark, d):
    after = dt.datetime(2024, 2, 28, 23, 59, 30)
    return spark.createDataFrame([(c, cron_next(c, after)) for c in ("30 4 * * 1", "0 0 29 2 *", "*/15 8-9 1,15 * 7")], "cron string, due timestamp_ntz")


@query("c2_landing_gate", "SELECT rule || ': ' || n || ' rows' AS violation FROM (SELECT 'c_name:length' AS rule, count(*) FILTER (length(c_name) > 17) AS n FROM customer UNION ALL SELECT 'c_acctbal:range', count(*) FILTER (c_acctbal < 0 OR c_acctbal > 9000) FROM customer) WHERE n > 0")
def _(spark, d):
    """A landing that breaks constraints is refused with all of them counted."""
    eng, rows = Engine(spark, shared_dir(spark)), table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    rules = (Property("c_custkey", "long"), Property("c_name", "string", constraints=(Constraint("length", max=17),)), Property("c_acctbal", "double", constraints=(Constraint("range", min=0, max=9000),)))
    eng.registry.define_type(ObjectType("Checked", "main.checked", rules, "c_custkey"))
    found: list[str] = []
    try:
        eng.land_model("Checked", rows)
    except Validation as e:
        found = list(e.violations)
    return spark.createDataFrame([(v,) for v in found], "violation string")


@query("l4_lineage_of_bindings", "SELECT 'quern:type/Nation' AS dataset UNION ALL SELECT 'quern:view/small'")
def _(spark, d):
    eng = engine(spark, d)
    eng.define_view("small", "nation", "n_nationkey < 5", ["n_nationkey"])
    rows = binding_events(eng.registry.types, eng.views, 1.0)
    log = spark.createDataFrame(rows, "run string, time double, state string, dataset string, direction string")
    return closure(edges(log), spark.createDataFrame([("quern:table/nation",)], "dataset string"), 3).select("dataset")


@query("x2_expression_functions", "SELECT p_partkey, CAST(p_size AS DOUBLE) AS a, coalesce(nullif(p_size, p_size), p_size + 1) AS b, lower(p_brand) AS c, p_size >= 10 OR NOT p_size != 3 AS d FROM part")
def _(spark, d):
    df = table(spark, d, "part").withColumn("none", F.lit(None).cast("int"))
    props = {f.name: {"bigint": "long", "int": "integer"}.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema}
    make = lambda s: E.compile_column(E.parse(s), props)
    return df.select("p_partkey", make("cast(@p_size as double)").alias("a"), make("coalesce(@none, @p_size + 1)").cast("int").alias("b"), make("lower(@p_brand)").alias("c"), make("@p_size >= 10 or not @p_size != 3").alias("d"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of an analyst's customers with what they spent."""
    df = engine(spark, sf_dir).page("analyst", "Customer", size=20, derived=True)
    return df.withColumns({"total_spend": F.round("total_spend", 2), "avg_spend": F.round("avg_spend", 8)})


QUERIES["flagship_page"] = flagship
SQL["flagship_page"] = "SELECT c_custkey, '***' AS c_name, c_nationkey, c_mktsegment, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus != 'P') AS order_count, (SELECT round(coalesce(sum(o_totalprice), 0), 2) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus != 'P') AS total_spend, (SELECT round(avg(o_totalprice), 8) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus != 'P') AS avg_spend, (SELECT min(o_totalprice) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus != 'P') AS least_spend, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus != 'P') AS most_spend FROM customer WHERE c_mktsegment IN ('BUILDING', 'AUTOMOBILE') ORDER BY c_custkey LIMIT 21"
