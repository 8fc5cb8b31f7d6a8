"""Lifecycles on a small warehouse."""

import datetime as dt

import pytest
from pyspark.sql import functions as F, types as T

from quernstone import acl as A
from quernstone.actions import Action, Assign, Step
from quernstone.engine import Engine
from quernstone.errors import AsOfNotFound, BadFilter, BadGraphPath, BadPagination, Conflict, Forbidden, Gone, NoIdentity, NotFound, ResourceExhausted, UnknownType, Validation
from quernstone.lineage import closure, edges, runs
from quernstone.ontology import Constraint, Derived, Link, ObjectType, Property, VectorIndex
from quernstone.operators.fold import emit_cdc, fold
from quernstone.plans import sqlgate
from quernstone.plans.read import cursor_of
from quernstone.transforms import Transform


def ids(df, c="id"):
    return sorted(r[c] for r in df.collect())


@pytest.fixture()
def eng(spark, tmp_path):
    now = [1000.0]
    e = Engine(spark, f"file://{tmp_path}/wh", clock=lambda: now[0])
    e.now = now
    e.registry.define_type(ObjectType("Person", "main.person", (Property("id", "long", True), Property("name", "string", constraints=(Constraint("length", max=8),)), Property("age", "long", constraints=(Constraint("range", min=0),)), Property("boss", "long")), "id"))
    e.registry.define_link(Link("boss", "Person", "Person", "boss", "id"))
    e.acl.add_role("r")
    e.acl.assign("u", "r")
    e.acl.grant("r", "Person")
    e.acl.grant("r", "Person", "write")
    e.catalog.create("main.person", e.registry.type("Person").schema(), identity="id")
    e.land("main.person", people(spark, [(1, "ann", 30, 2), (2, "bob", 40, 3), (3, "cy", 50, 1), (4, "dee", None, 3)]))
    return e


def people(spark, rows):
    return spark.createDataFrame(rows, "id long, name string, age long, boss long")


def test_catalog_lifecycle(eng, spark):
    cat = eng.catalog
    v1 = cat.current().id
    read = lambda at=None: sorted((r.id, r.name) for r in cat.scan("main.person", at).collect())
    first = read()
    cat.land("main.person", people(spark, [(5, "eve", 1, None)]), size=10)
    assert len(cat.entry("main.person")["inline"]) == 1 and len(read()) == 5 and cat.row_count("main.person") == 4
    assert cat.flush("main.person") is None  # inline rows shadow files
    before = read()
    cat.consolidate("main.person")
    assert not cat.entry("main.person")["inline"] and read() == before
    for i in range(6, 9):
        cat.land("main.person", people(spark, [(i, f"p{i}", i, None)]))
    before = read()
    assert cat.compact("main.person") and read() == before and cat.compact("main.person") is None
    assert read(cat.as_of(v1)) == first
    eng.now[0] = 2000.0
    cat.land("main.person", people(spark, []).limit(0), mode="overwrite")
    assert read() == [] and read(cat.as_of(timestamp=1500.0)) == before
    with pytest.raises(AsOfNotFound):
        cat.as_of(timestamp=1.0)
    with pytest.raises(AsOfNotFound):
        cat.as_of(99999)
    with pytest.raises(Validation):
        cat.as_of()
    eng.now[0] = 2000.0 + 30 * 86400
    cat.land("main.person", people(spark, [(1, "x", 1, None)]))
    eng.now[0] += 1
    gone = cat.gc()
    assert gone and read() == [(1, "x")]
    with pytest.raises(Gone):
        cat.as_of(v1)
    assert len(cat.history("main.person")) > 3


def test_plain_inline_rows_flush(eng, spark):
    cat = eng.catalog
    cat.land("main.log", spark.range(3))
    cat.land("main.log", spark.range(3), size=5)
    assert ids(cat.scan("main.log")) == [0, 0, 1, 1, 2, 2]
    assert cat.flush("main.log") and ids(cat.scan("main.log")) == [0, 0, 1, 1, 2, 2] and not cat.entry("main.log")["inline"]


def test_orphans(eng, spark):
    eng.catalog.write_files("main.person", people(spark, [(9, "lost", 1, 1)]))
    import time

    eng.catalog.clock = lambda: time.time() + 7200
    assert len(eng.catalog.sweep_orphans()) >= 1 and len(ids(eng.catalog.scan("main.person"))) == 4


def test_commits_compare_and_swap(eng, spark):
    cat, other = eng.catalog, Engine(spark, eng.catalog.root).catalog
    calls = []

    def change(tx):
        if not calls:
            other.land("main.person", people(spark, [(7, "g", 1, None)]))
        calls.append(tx.base.id)
        tx.edit("main.person")["meta"]["seen"] = tx.base.id

    cat.commit(change)
    assert len(calls) == 2 and 7 in ids(cat.scan("main.person"))
    at = cat.current().id
    rows = people(spark, [(1, "new", 1, 1)]).selectExpr("*", "'+U' AS _chg_kind")
    cat.mutate("main.person", rows, expect=at)
    with pytest.raises(Conflict):
        cat.mutate("main.person", rows, expect=at)


def test_evolution(eng, spark):
    cat = eng.catalog
    cat.land("main.person", spark.createDataFrame([(9, "i", 1, 1, "x")], "id long, name string, age long, boss long, extra string"))
    assert cat.schema("main.person").names[-1] == "extra"
    assert {r.id: r.extra for r in cat.scan("main.person").collect()}[1] is None
    with pytest.raises(Validation, match="is missing"):
        cat.land("main.person", spark.createDataFrame([("q",)], "name string"))
    from quernstone.sources.catalog import evolve

    a = T.StructType.fromDDL("a long, b string")
    for ddl in ("a long", "b string, a long", "a int, b string", "a long not null, b string", "a long, b string, c long not null"):
        with pytest.raises(Validation, match="schema evolution unsupported"):
            evolve(a, T.StructType.fromDDL(ddl))


def test_pruned_scan_reads_fewer_files(eng, spark):
    from quernstone.functions.predicates import parse

    eng.catalog.land("main.wide", spark.range(1000).repartitionByRange(8, "id"))
    p = [parse("id", "between:10,20", "long")]
    few = eng.catalog.scan("main.wide", predicates=p)
    assert len(few.inputFiles()) == 1 and ids(few.where(p[0].condition())) == list(range(10, 21))


def test_governed_reads(eng, spark):
    for bad, name in (("nobody", "Person"), ("u", "Nothing")):
        with pytest.raises(Forbidden):
            eng.objects(bad, name)
    eng.acl.grant("r", "Nothing")
    with pytest.raises(UnknownType):
        eng.objects("u", "Nothing")
    eng.acl.set_policy("r", "Person", A.Policy((A.Compare("age", "gt", 35),), frozenset({"boss"}), frozenset({"name"})))
    rows = eng.objects("u", "Person").collect()
    assert [(r.id, r.name, r.age) for r in rows] == [(2, "***", 40), (3, "***", 50)] and "boss" not in rows[0]
    for f in ({"boss": "gt:x"}, {"name": "eq:bob"}, {"none": "1"}, {"age": "gt:x"}):
        with pytest.raises(BadFilter):
            eng.objects("u", "Person", filters=f)
    assert eng.rendered("u", "Person", eng.objects("u", "Person", ids=[3])) == [{"id": "3", "name": "***", "age": "50"}]
    plan = eng.objects("u", "Person", filters={"id": "gt:1"})._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull" in plan and "boss" not in plan.split("ReadSchema")[-1]


def test_pages(eng):
    got, cursor = [], None
    while True:
        rows, cursor = cursor_of(eng.page("u", "Person", size=3, cursor=cursor).collect(), 3, "id")
        got += [r.id for r in rows]
        if cursor is None:
            break
    assert got == [1, 2, 3, 4]
    for kw in ({"ids": [1]}, {"cursor": "x"}):
        with pytest.raises(BadPagination):
            eng.page("u", "Person", **kw)
    eng.acl.set_policy("r", "Person", A.Policy(mask=frozenset({"id"})))
    with pytest.raises(BadPagination):
        eng.page("u", "Person")
    with pytest.raises(NoIdentity):
        eng.objects("u", "Person", ids=[1])


def test_graphs(eng):
    # 1 -> 2 -> 3 -> 1 is a cycle, 4 leads into it
    assert ids(eng.graph("u", "Person", path="boss", ids=[1], depth=2)) == [2, 3]
    assert ids(eng.graph("u", "Person", path="boss", ids=[1], depth=3)) == [1, 2, 3]
    assert ids(eng.graph("u", "Person", links=["boss", "~boss"], ids=[4], depth=2)) == [1, 2, 3, 4]
    t = {r.id: (r._depth, r._parent) for r in eng.tree("u", "Person", "boss", ids=[4]).collect()}
    assert t == {4: (0, None), 3: (1, 4), 1: (2, 3), 2: (3, 1)}
    eng.acl.set_policy("r", "Person", A.Policy((A.Compare("id", "ne", 3),)))
    assert ids(eng.graph("u", "Person", path="boss", ids=[1], depth=5)) == [2]
    for kw in ({"path": "boss", "links": ["boss"]}, {"path": "boss", "depth": 11}, {}):
        with pytest.raises(BadGraphPath):
            eng.graph("u", "Person", **kw)


def test_sql_gate(eng, spark):
    spark.range(1).createOrReplaceTempView("secret")
    eng.acl.set_policy("r", "Person", A.Policy((A.Compare("age", "gt", 35),), frozenset({"boss"}), frozenset({"name"})))
    assert [(r.id, r.name) for r in eng.sql("u", 'SELECT "id", name FROM person ORDER BY id').collect()] == [(2, "***"), (3, "***")]
    for bad in ("DROP TABLE person", "INSERT INTO person VALUES (1)", "SET a=b", "SHOW TABLES", "CREATE TABLE x AS SELECT 1", "SELECT * FROM secret", "SELECT * FROM parquet.`/etc`", "EXPLAIN SELECT 1", "CACHE TABLE person", "SELECT * FROM default.person", "WITH secret2 AS (SELECT 1) SELECT * FROM secret", "SELECT * FROM range(5)", "DESCRIBE person", "USE default", "SELECT (SELECT max(id) FROM secret) FROM person", "SELECT id FROM person WHERE id IN (SELECT id FROM secret)"):
        with pytest.raises((Forbidden, Validation)):
            eng.sql("u", bad).collect()
    for bad in (
        "SELECT reflect('java.lang.System', 'getProperty', 'user.dir') FROM person", "SELECT java_method('java.lang.System', 'getenv', 'HOME')", "SELECT max(id) FROM person HAVING max(try_reflect('java.lang.System', 'getenv')) > '1'",
        "SELECT * FROM secret -- , secret as (", "SELECT * FROM secret WHERE '1' = ', secret as (select 1)'", "SELECT * FROM secret /* with secret as (select 1) */", "WITH secret AS (SELECT * FROM secret) SELECT * FROM secret",
        "SELECT * FROM (WITH secret AS (SELECT 1 AS x) SELECT x FROM secret) JOIN secret", "SELECT (WITH secret AS (SELECT 1) SELECT count(*) FROM secret), (SELECT max(id) FROM secret)", "SELECT * FROM IDENTIFIER('secret')", "SELECT IDENTIFIER('reflect')('a', 'b')",
        "VALUES (1, (SELECT max(id) FROM secret))", "SELECT input_file_name() FROM person", "SELECT current_user()", "SELECT rand()", "SELECT id FROM person ORDER BY uuid()", "SELECT row_number() OVER w FROM person WINDOW w AS (ORDER BY (SELECT max(id) FROM secret))",
        "SELECT id FROM person WHERE EXISTS (SELECT 1 FROM secret)", "SELECT * FROM person, LATERAL (SELECT * FROM secret)", "SELECT * FROM person LATERAL VIEW java_method('a', 'b') t AS x", "SELECT TRANSFORM (id) USING 'cat' FROM person", "SELECT * FROM person TIMESTAMP AS OF '2020-01-01'", "SELECT default.f(id) FROM person", "FROM secret |> SELECT id", "SELECT current_user FROM person",
    ):
        with pytest.raises((Forbidden, Validation)):
            eng.sql("u", bad)
    assert [r.n for r in eng.sql("u", "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 3) SELECT n FROM t ORDER BY n").collect()] == [1, 2, 3]
    assert eng.sql("u", "SELECT e FROM person LATERAL VIEW explode(array(1, 2)) x AS e WHERE id IN (SELECT id FROM Person)").count() == 4
    assert eng.sql("u", "SELECT sum(id) OVER w AS s, upper(name), coalesce(age, 1) FROM person WINDOW w AS (ORDER BY id)").count() == 2
    with pytest.raises(Exception, match="boss"):
        eng.sql("u", "SELECT boss FROM person")
    assert eng.sql("u", "WITH p AS (SELECT id FROM person) SELECT count(*) AS n FROM p").collect()[0].n == 2
    rows, more = eng.console("u", "SELECT id FROM person", limit=1)
    assert len(rows) == 1 and more
    assert eng.validate("u", "SELECT id FROM person") == []
    assert eng.validate("u", "SELECT nope FROM person")[0]["line"] == 1 and eng.validate("u", "SELEC 1") and eng.validate("u", "/* x */ explain select 1")
    # a predicate that would fail on hidden rows doesn't tell of them
    assert eng.sql("u", "SELECT id FROM person WHERE 100 / (age - 30) > 0").count() == 2
    eng.define_view("grown", "main.person", "age >= 40", ["id", "age"])
    eng.acl.grant("r", "grown")
    assert ids(eng.sql("u", "SELECT * FROM grown")) == [2, 3]
    assert [d["name"] for d in eng.datasets("u")] == ["grown", "person"]
    with pytest.raises(ResourceExhausted):
        list(sqlgate.export(eng.sql("u", "SELECT * FROM person"), 1))


def test_actions(eng, spark):
    eng.registry.define_action(Action("hire", {"id": ("long", True), "name": ("string", False), "age": ("long", False)}, (Step("Person", binds=(("id", "id"), ("name", "name"), ("age", "age")), assigns=(Assign("boss", expr="if @age > 20 then 1 else 2"),)),), jobs=(("mail", {"to": "@self.id"}),)))
    eng.registry.define_action(Action("older", {"id": ("long", True), "age": ("long", False), "name": ("string", False)}, (Step("Person", "update", (("age", "age"), ("name", "name")), locate="id"),)))
    eng.registry.define_action(Action("fire", {"id": ("long", True)}, (Step("Person", "delete", locate="id"),)))
    state = lambda: {r.id: (r.name, r.age, r.boss) for r in eng.catalog.scan("main.person").collect()}
    assert eng.actions.run("u", "hire", {"id": 10, "name": "jo", "age": 25})["boss"] == 1
    eng.actions.run("u", "older", {"id": 1, "age": 31})
    eng.actions.run("u", "fire", {"id": 4})
    got = state()
    assert got[10] == ("jo", 25, 1) and got[1] == ("ann", 31, 2) and 4 not in got
    eng.catalog.consolidate("main.person")
    assert state() == got
    for given, error in (({"id": 11, "odd": 1}, Validation), ({}, Validation), ({"id": 12, "name": "far too long"}, Validation), ({"id": 13, "age": -1}, Validation)):
        with pytest.raises(error):
            eng.actions.run("u", "hire", given)
    with pytest.raises(NotFound):
        eng.actions.run("u", "older", {"id": 77})
    with pytest.raises(Forbidden):
        eng.actions.run("nobody", "fire", {"id": 1})
    eng.acl.set_policy("r", "Person", A.Policy((A.Compare("age", "lt", 45),), frozenset({"name"})))
    for name, given, error in (("hire", {"id": 20, "age": 50}, Forbidden), ("hire", {"id": 20}, Forbidden), ("hire", {"id": 20, "age": 20, "name": "x"}, Forbidden), ("older", {"id": 3, "age": 1}, NotFound), ("older", {"id": 1, "age": 60}, Forbidden), ("older", {"id": 1, "name": "x"}, Forbidden)):
        with pytest.raises(error):
            eng.actions.run("u", name, given)
    assert state() == got
    both = Action("two", {"id": ("long", True)}, (Step("Person", binds=(("id", "id"),), assigns=(Assign("age", const=1),), bind="a"), Step("Person", assigns=(Assign("id", expr="500"), Assign("age", const=2), Assign("boss", ref="a.id")))))
    eng.registry.define_action(both)
    eng.actions.run("u", "two", {"id": 100})
    assert state()[500] == (None, 2, 100)


def test_landing_gate(eng, spark):
    with pytest.raises(Validation) as e:
        eng.land_model("Person", people(spark, [(None, "x", -1, 1), (8, "very long name", 1, 1)]))
    assert len(e.value.violations) == 3
    with pytest.raises(Validation, match="missing"):
        eng.land_model("Person", spark.range(1))
    eng.land_model("Thing", spark.createDataFrame([(1, 2.5)], "id long, x double"), identity="id")
    assert eng.registry.type("Thing").identity == "id" and ids(eng.catalog.scan("main.Thing")) == [1]


def test_change_streams(eng, spark):
    s = eng.streams
    schema = T.StructType.fromDDL("id long, v long, seq long")
    rows = lambda *r: spark.createDataFrame(list(r), schema)
    s.declare("main.cdc", schema, "cdc", 2, "id")
    s.declare("main.cdc", schema, "cdc", 5, "id")
    assert s.meta("main.cdc")["buckets"] == 2
    with pytest.raises(Conflict):
        s.declare("main.person", schema, "log", 1)
    s.change("main.cdc", rows((1, 1, 1), (2, 2, 1)))
    s.change("main.cdc", rows((1, 5, 2), (3, 3, 1)))
    state = lambda: sorted(tuple(r) for r in s.state("main.cdc").collect())
    assert state() == [(1, 5, 2), (3, 3, 1)]
    events = s.events("main.cdc").collect()
    assert sorted(r._chg_kind for r in events) == ["+I", "+I", "+I", "+U", "-D", "-U"]
    for b in (0, 1):
        assert sorted(r._chg_offset for r in events if r._chg_bucket == b) == list(range(sum(r._chg_bucket == b for r in events)))
    s.consolidate("main.cdc")
    assert state() == [(1, 5, 2), (3, 3, 1)]
    with pytest.raises(Validation):
        eng.catalog.land("main.cdc", s.events("main.cdc"), mode="overwrite")
    s.declare("main.ver", schema, "cdc", 1, "id", "versioned", "seq")
    k = lambda r, kind: rows(r).selectExpr("*", f"'{kind}' AS _chg_kind")
    for r, kind in (((1, 9, 5), "+I"), ((1, 1, 2), "+U"), ((2, 1, 1), "+I"), ((2, 1, 3), "-D"), ((2, 7, 2), "+U")):
        s.ingest("main.ver", k(r, kind), ["id"])
    assert sorted(tuple(r) for r in s.state("main.ver").collect()) == [(1, 9, 5)]


def test_emit_and_fold(spark):
    old = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "id long, v string")
    new = spark.createDataFrame([(1, "a"), (2, "b"), (4, "d")], "id long, v string")
    got = sorted((r.id, r._chg_kind, r._step, r.v) for r in emit_cdc(old, new, "id").collect())
    assert got == [(2, "+U", 1, "b"), (2, "-U", 0, None), (3, "-D", 0, "c"), (4, "+I", 0, "d")]
    with pytest.raises(Validation):
        fold(old, "id", "sum")


def test_feed_and_views(eng, spark):
    s = eng.streams
    rows = lambda a, b: spark.range(a, b).selectExpr("id", "id % 3 AS k")
    s.declare("main.log", T.StructType.fromDDL("id long, k long"), "log", 2)
    s.append("main.log", rows(0, 5), ["id"])
    page, cursor = s.page("main.log", limit=3)
    assert [(r._chg_bucket, r._chg_offset) for r in page] == [(0, 0), (0, 1), (0, 2)]
    page, cursor = s.page("main.log", cursor)
    assert [r.id for r in page] == [1, 3] and s.page("main.log", cursor)[0] == []
    with pytest.raises(Validation):
        s.page("main.person", cursor)
    assert s.page("main.log", start="latest")[0] == []
    out = T.StructType.fromDDL("k long, n long")
    s.define_view("v", "main.log", "main.out", "SELECT k, count(*) AS n FROM delta WHERE id != 1 GROUP BY k", out)
    total = lambda: {r.k: r["sum(n)"] for r in s.state("main.out").groupBy("k").sum("n").collect()}
    s.run_view("v")
    assert total() == {0: 2, 1: 1, 2: 1} and s.run_view("v") is None
    spec = s.view("v")
    s.append("main.log", rows(5, 9), ["id"])
    s.run_view("v")
    assert total() == {0: 3, 1: 2, 2: 3}
    # a batch that is tried again from an old position is refused, not doubled
    real, s.view = s.view, lambda name: spec
    with pytest.raises(Conflict):
        s.run_view("v")
    s.view = real
    assert total() == {0: 3, 1: 2, 2: 3}
    s.append("main.log", rows(1, 2), ["id"])
    s.run_view("v")  # nothing comes of it, but it moves on
    assert total() == {0: 3, 1: 2, 2: 3} and s.run_view("v") is None
    for bad in (("main.log", "main.log"), ("main.person", "main.o2")):
        with pytest.raises(Validation):
            s.define_view("w", *bad, "SELECT 1", out)


def test_type_feed(eng, spark):
    s = eng.streams
    schema = T.StructType.fromDDL("id long, v long, w long")
    s.declare("main.item", schema, "cdc", 1, "id")
    eng.registry.define_type(ObjectType("Item", "main.item", (Property("id", "long"), Property("v", "long"), Property("w", "long")), "id"))
    eng.acl.grant("r", "Item")
    s.change("main.item", spark.createDataFrame([(1, 5, 1), (2, 50, 2)], schema))
    eng.acl.set_policy("r", "Item", A.Policy((A.Compare("v", "lt", 10),), frozenset({"w"}), frozenset({"v"})))
    rows, cursor = eng.changes("u", "Item")
    assert rows == [{"id": 1, "v": "***", "_kind": "+I", "_bucket": 0, "_offset": 0}] and eng.changes("u", "Item", cursor)[0] == []
    with pytest.raises(Forbidden):
        eng.changes("u", "Item", fields=["w"])
    assert ids(eng.objects("u", "Item")) == [1]


def test_transforms(eng, spark):
    eng.registry.define_type(ObjectType("Stat", "main.stat", (Property("boss", "long", False), Property("n", "long", False)), "boss"))
    eng.transforms.define(Transform("count", "SELECT boss, count(*) AS n FROM Person GROUP BY boss", ("Person",), "Stat", "typed", cron="*/5 * * * *"))
    eng.transforms.define(Transform("copy", "SELECT boss, n + 1 AS n FROM stat", ("main.stat",), "main.copy", mode="append", triggers=("main.stat",)))
    with pytest.raises(Conflict):
        eng.transforms.define(Transform("loop", "SELECT 1", ("main.copy",), "main.stat", triggers=("main.copy",)))
    eng.now[0] = 1300.0
    assert eng.transforms.tick() == ["count", "copy"]
    assert {r.boss: r.n for r in eng.catalog.scan("main.copy").collect()} == {1: 2, 2: 2, 3: 3}
    eng.transforms.define(Transform("bad", "SELECT boss, 1.5D AS n, 1 AS x FROM Person", ("Person",), "Stat", "typed"))
    with pytest.raises(Validation) as e:
        eng.transforms.run("bad")
    assert len(e.value.violations) == 2
    log = eng.lineage.frame(spark)
    down = closure(edges(log), spark.createDataFrame([("Person",)], "dataset string"), 5)
    assert {r.dataset: r.depth for r in down.collect()} == {"main.stat": 1, "main.copy": 2}
    cutoff = spark.createDataFrame([("Person",), ("main.copy",)], "dataset string")
    assert closure(edges(log), spark.createDataFrame([("Person",)], "dataset string"), 5, readable=cutoff).count() == 0
    up = closure(edges(log), spark.createDataFrame([("main.copy",)], "dataset string"), 5, upstream=True)
    assert sorted(r.dataset for r in up.collect()) == ["Person", "main.stat"]
    assert {r.state for r in runs(log).collect()} <= {"complete", "start"}


def test_derived_rules(eng, spark):
    t = eng.registry.type("Person")
    eng.registry.types["Person"] = ObjectType(t.name, t.table, t.properties, t.identity, (Derived("staff", "count", "~boss"), Derived("years", "sum", "~boss", "age"), Derived("eldest", "max", "~boss", "age"), Derived("lost", "count", "nolink"), Derived("names", "sum", "~boss", "name")))
    got = {r.id: (r.staff, r.years, r.eldest) for r in eng.objects("u", "Person", derived=True).collect()}
    assert got == {1: (1, 50, 50), 2: (1, 30, 30), 3: (2, 40, 40), 4: (0, 0, None)}


def test_vector_search(eng, spark):
    import numpy as np

    rng = np.random.default_rng(0)
    centre = rng.normal(size=(10, 8)) * 5
    v = [(i, [float(x) for x in (centre[i % 10] + rng.normal(size=8)).astype("float32")]) for i in range(600)] + [(600, None)]
    schema = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("e", T.ArrayType(T.FloatType(), False))])
    eng.tables["vecs"] = spark.createDataFrame(v, schema)
    eng.registry.define_type(ObjectType("Doc", "vecs", (Property("id", "long", True), Property("e", "vector(8)")), "id"))
    eng.acl.grant("r", "Doc")
    for kind in ("flat", "ivf_flat", "hnsw"):
        eng.registry.define_index(VectorIndex(kind, "Doc", "e", "l2", kind))
    q = v[3][1]
    want = ids(eng.search("u", "Doc", "flat", q, 10))
    assert len(set(want) & set(ids(eng.search("u", "Doc", "ivf_flat", q, 10, nprobe=3)))) >= 9
    assert len(set(want) & set(ids(eng.search("u", "Doc", "hnsw", q, 10)))) >= 9
    assert want == ids(eng.search("u", "Doc", "ivf_flat", q, 10, nprobe=1000))
    eng.acl.set_policy("r", "Doc", A.Policy((A.Compare("id", "ne", 3),)))
    assert ids(eng.search("u", "Doc", "flat", q, 10)) == [i for i in want if i != 3]
    from quernstone.errors import DimensionMismatch, NoIndex

    for kw, error in (({"index": "none", "query": q}, NoIndex), ({"index": "flat", "query": q[:3]}, DimensionMismatch), ({"index": "flat", "query": q, "nprobe": 2}, Validation)):
        with pytest.raises(error):
            eng.search("u", "Doc", k=5, **kw)


def test_hnsw_codec():
    import numpy as np

    from quernstone.plans.search import Hnsw

    rng = np.random.default_rng(1)
    g = Hnsw("l2", 4, 20)
    for v in rng.normal(size=(80, 5)):
        g.add(v)
    back = Hnsw.decode(g.encode())
    assert back.links == g.links and back.search(g.x[7], 5, 20) == g.search(g.x[7], 5, 20) and Hnsw.decode(Hnsw().encode()).search([1.0], 3, 3) == []


def vectors(spark, x):
    schema = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("e", T.ArrayType(T.FloatType(), False))])
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], schema)


@pytest.mark.parametrize("copies", [1, 60])
def test_hnsw_recall(eng, spark, copies):
    """A sparse graph over vectors without clusters, and one over copies, find nine of ten without being told an ef_search."""
    import numpy as np

    x = np.repeat(np.random.default_rng(4).normal(size=(1500 // copies, 32)), copies, axis=0)
    rows = vectors(spark, x).coalesce(1)
    eng.registry.define_type(ObjectType("Doc", "main.vecs", (Property("id", "long", True), Property("e", "vector(32)")), "id"))
    eng.acl.grant("r", "Doc")
    for kind in ("flat", "hnsw"):
        eng.registry.define_index(VectorIndex(kind, "Doc", "e", "cosine", kind, m=4, ef_construction=12))
    eng.catalog.create("main.vecs", rows.schema, identity="id")
    eng.land("main.vecs", rows)
    eng.build_index("Doc", "hnsw")
    asked = rows.where("id % 30 = 0").selectExpr("id AS query_id", "e AS vector")
    pairs = lambda kind: {(r.query_id, r.id) for r in eng.search_many("u", "Doc", kind, asked, 10).collect()}
    want = pairs("flat")
    assert len(want) == 500 and len(want & pairs("hnsw")) >= 0.9 * len(want)


def test_hnsw_scan():
    """A graph that no ef_search helps is scanned."""
    import numpy as np

    from quernstone.plans.search import Hnsw, Nearest, unit

    x = np.random.default_rng(2).normal(size=(300, 4))
    g, names = Hnsw("cosine", 4, 20), np.arange(300).astype(object)
    for v in x:
        g.add(v)
    g.links = [[[] for _ in node] for node in g.links]  # nothing leads anywhere
    g.fit(names)
    back, best = Hnsw.decode(g.encode()), Nearest(1, 5)
    back.find(best, unit(x[7:8], "cosine"), 5, None, names)
    assert back.ef_search == 0 and best.ids[0].tolist() == np.argsort(-unit(x, "cosine") @ unit(x[7:8], "cosine")[0])[:5].tolist()


def test_hnsw_memory(spark):
    """What a task holds follows the shard, not the queries: k rows a query, in pieces, from a graph of a few times its bytes."""
    import tracemalloc

    import numpy as np

    from quernstone.plans import search as S

    x = np.random.default_rng(3).normal(size=(500, 8))
    shards = S.build_hnsw(vectors(spark, x).coalesce(1), "id", "e", shard_rows=200).cache()
    graphs, asked = shards.orderBy(F.col("ids")[0]).collect(), vectors(spark, x[:40]).selectExpr("id AS query_id", "e AS vector")
    assert [len(r.ids) for r in graphs] == [200, 200, 100]
    assert S.hnsw_many(shards, asked, 10, "cosine").count() == 3 * 40 * 10
    assert S.hnsw_many(shards, asked, 10, "cosine", spare=True).count() == 3 * 40 * 64
    shards.unpersist()
    raw = bytes(graphs[0].graph)
    tracemalloc.start()
    try:
        g = S.Hnsw.decode(raw)
        assert len(g.links) == 200 and tracemalloc.get_traced_memory()[0] < 4 * len(raw)
        tracemalloc.reset_peak()
        best, q = S.Nearest(3000, 10), np.ones((3000, 8))
        best.meet(np.arange(3000), q, np.ones((10_000, 8)), np.arange(10_000).astype(object), "cosine")
        assert max(b.num_rows for b in best.batches(list(range(3000)), [S.pa.int64(), S.pa.int64()])) <= 10 * S.FOUND
        assert tracemalloc.get_traced_memory()[1] < 50 << 20  # all distances at once take 240 MB
    finally:
        tracemalloc.stop()


def test_kept_indexes(eng, spark):
    schema = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("e", T.ArrayType(T.FloatType(), False))])
    rows = lambda a, b, s=1.0: spark.createDataFrame([(i, [float(i) * s, 1.0]) for i in range(a, b)], schema)
    eng.registry.define_type(ObjectType("Doc", "main.vecs", (Property("id", "long", True), Property("e", "vector(2)")), "id"))
    eng.acl.grant("r", "Doc")
    for kind in ("ivf_flat", "hnsw"):
        eng.registry.define_index(VectorIndex(kind, "Doc", "e", "l2", kind))
    eng.catalog.create("main.vecs", schema, identity="id")
    eng.land("main.vecs", rows(0, 60))
    before = eng.catalog.current()
    for kind in ("ivf_flat", "hnsw"):
        assert eng.build_index("Doc", kind)["snapshot"] >= before.id
    built = eng.catalog.current()
    hit = lambda kind, at=None: ids(eng.search("u", "Doc", kind, [30.0, 1.0], 3, at=at))
    assert [hit(k) for k in ("ivf_flat", "hnsw")] == [[29, 30, 31]] * 2
    eng.land("main.vecs", rows(100, 101, 0.3))  # (30, 1) once more
    assert [j.name for j in eng.transforms.queue.jobs] == ["build_index", "build_index"]
    eng.catalog.mutate("main.vecs", rows(29, 30).withColumn("_chg_kind", eng_lit("-D")))
    assert [hit(k) for k in ("ivf_flat", "hnsw")] == [[30, 31, 100]] * 2
    assert [hit(k, built) for k in ("ivf_flat", "hnsw")] == [[29, 30, 31]] * 2
    assert len(eng.transforms.tick()) == 2 and not eng.transforms.queue.jobs
    assert [hit(k) for k in ("ivf_flat", "hnsw")] == [[30, 31, 100]] * 2


def eng_lit(x):
    from pyspark.sql import functions as F

    return F.lit(x)


def test_model_in_the_catalog(eng, spark):
    eng.registry.define_action(Action("hire", {"id": ("long", True)}, (Step("Person", binds=(("id", "id"),), assigns=(Assign("age", const=3),)),), jobs=(("mail", {"to": "@self.id"}),)))
    eng.define_view("grown", "main.person", "age >= 40", ["id", "age"])
    eng.save_model()
    other = Engine(spark, eng.catalog.root)
    other.load_model()
    assert other.registry.to_dict() == eng.registry.to_dict() and other.registry.action("hire") == eng.registry.action("hire") and other.views == {"grown": ("main.person", "age >= 40", ["id", "age"])}
    other.registry.delete_action("hire")
    other.registry.delete_link("Person", "boss")
    other.delete_view("grown")
    assert not other.registry.actions and not other.registry.links and not other.views
    eng.actions.run("u", "hire", {"id": 70})
    assert [(j.name, j.args) for j in eng.transforms.queue.jobs] == [("mail", {"to": "70"})] and eng.transforms.tick() == []
    sent = []
    eng.transforms.handlers["mail"] = sent.append
    eng.transforms.tick()
    assert sent == [{"to": "70"}] and not eng.transforms.queue.jobs


def test_budget_and_wakeup(eng, spark):
    import threading

    with pytest.raises(ResourceExhausted):
        eng.console("u", "SELECT id FROM person", scan_bytes=1)
    assert len(eng.console("u", "SELECT id FROM person", scan_bytes=1 << 40)[0]) == 4
    eng.streams.declare("main.wake", T.StructType.fromDDL("id long"), "log", 1)
    _, cursor = eng.streams.page("main.wake")
    late = threading.Timer(0.3, lambda: eng.streams.append("main.wake", spark.range(2), ["id"]))
    late.start()
    rows, _ = eng.streams.await_page("main.wake", cursor, 20)
    late.join()
    assert [r.id for r in rows] == [0, 1]


def test_conditions_on_the_identity_reach_the_scans(eng, spark):
    eng.catalog.mutate("main.person", people(spark, [(2, "ben", 41, 3)]).selectExpr("*", "'+U' AS _chg_kind"))
    df = eng.catalog.scan("main.person").where("id = 2")
    assert [(r.id, r.name) for r in df.collect()] == [(2, "ben")]
    assert df._jdf.queryExecution().toString().count("EqualTo(id,2)") >= 2


def test_state_survives_the_process(eng, spark):
    """Definitions, jobs and lineage are read back by another engine on the warehouse."""
    eng.transforms.define(Transform("copy", "SELECT id FROM person", ("main.person",), "main.copy", mode="overwrite", triggers=("main.person",)))
    eng.land("main.person", people(spark, [(9, "zed", 1, 1)]))
    other = Engine(spark, eng.catalog.root, clock=lambda: eng.now[0])
    assert [j.name for j in other.transforms.queue.jobs] == ["transform"] and other.transforms.tick() == ["copy"]
    assert eng.catalog.scan("main.copy").count() == 5 and not eng.transforms.queue.jobs
    version = eng.catalog._version(eng.catalog.entry("main.copy") and eng.catalog.current().tables["main.copy"])
    assert [(e[2], e[3]) for e in version["lineage"]] == [("complete", "main.person"), ("complete", "main.copy")]
    assert {r.state for r in other.lineage.frame(spark).where("dataset = 'main.copy'").collect()} == {"complete"}
    for i in range(10, 18):
        eng.land("main.copy", spark.createDataFrame([(i,)], "id long"))
    assert [j.name for j in eng.transforms.queue.jobs] == ["compact"] and eng.transforms.tick() == ["compact"]
    assert len(eng.catalog.entry("main.copy")["files"]) < 8 and eng.catalog.scan("main.copy").count() == 13


def test_footers(eng, spark):
    from pyspark.sql import functions as F

    df = spark.range(100).select("id", F.when(F.col("id") < 50, F.concat(F.lit("s"), "id")).alias("s"), F.when(F.col("id") == 3, F.lit(float("nan"))).otherwise(F.col("id") / 2).alias("d"), F.lit(None).cast("long").alias("n"), F.array("id").alias("a"))
    (f,) = eng.catalog.write_files("main.foot", df.coalesce(1))
    assert f["rows"] == 100 and f["stats"]["id"] == {"nulls": 0, "min": 0, "max": 99} and f["stats"]["s"] == {"nulls": 50, "min": "s0", "max": "s9"}
    assert "min" not in f["stats"]["d"] and f["stats"]["n"]["nulls"] == 100


def test_memory_sources(spark):
    from quernstone.sources.arrow import batches, decode_stream, encode_stream

    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, s string")
    assert sorted(decode_stream(spark, encode_stream(df)).collect()) == sorted(df.collect())
    with pytest.raises(Validation):
        decode_stream(spark, b"nonsense")
    assert batches(spark, "nothing", [], df.schema).columns == ["id", "s"] and spark.table("nothing").count() == 0
    assert batches(spark, "some", df.toArrow().to_batches()).count() == 2


def test_rendering(eng, spark):
    from quernstone.functions.rendering import ndjson, pairs, tree
    from quernstone.lineage import binding_events, dataset_of

    assert pairs(eng.association("u", "Person", "boss", seeds={"id": "lt:3"}).collect()) == [{"from": 1, "to": 2}, {"from": 2, "to": 3}]
    t = tree(eng.tree("u", "Person", "boss", ids=[4], depth=1).collect(), "id")
    assert t["roots"] == [4] and [(n["id"], n["depth"], n["parent"]) for n in t["nodes"]] == [(4, 0, None), (3, 1, 4)]
    eng.streams.declare("main.item", T.StructType.fromDDL("id long, v long"), "cdc", 1, "id")
    eng.registry.define_type(ObjectType("Item", "main.item", (Property("id", "long"), Property("v", "long")), "id"))
    eng.acl.grant("r", "Item")
    eng.streams.change("main.item", spark.createDataFrame([(1, 5), (2, 6), (3, 7)], "id long, v long"))
    lines = list(ndjson(eng, "u", "Item", batch=2))
    assert len([x for x in lines if "_kind" in x]) == 3 and "cursor" in lines[-1]
    assert dataset_of("other:x") == ("external", "other:x") and dataset_of("quern:table/a.b") == ("table", "a.b")
    with pytest.raises(Validation):
        dataset_of("quern:table/ab")
    assert len(binding_events(eng.registry.types, {"v": ("a", "", [])}, 0.0)) == 6


def test_inline_variants(eng, spark):
    cat = eng.catalog
    cat.mutate("main.person", people(spark, [(1, "x", 1, 1)]).selectExpr("*", "'-U' AS _chg_kind"))
    cat.mutate("main.person", people(spark, [(1, "y", 1, 1)]).selectExpr("*", "'+U' AS _chg_kind"))
    assert [r.name for r in cat.inline("main.person").collect()] == ["y"]
    assert cat.inline("main.person", variant="full").count() == 2
    assert len({r._prec for r in cat.inline("main.person", variant="shadow").collect()}) == 2
    files = [f["path"] for f in cat.entry("main.person")["files"]]
    assert cat.file_rows("main.person", files).count() == 4
    with pytest.raises(Conflict):
        cat.file_rows("main.person", ["data/none.parquet"])


def test_repeated_identities(eng, spark):
    eng.tables["twice"] = people(spark, [(1, "a", 1, 2), (2, "b", 2, 1), (2, "c", 3, 1)])
    t = eng.registry.type("Person")
    for unique, want in ((True, [2, 2]), (False, [2])):
        eng.registry.types["Twice"] = ObjectType("Twice", "twice", t.properties, "id", unique=unique)
        eng.acl.grant("r", "Twice")
        eng.registry.links[:] = [Link("boss", "Twice", "Twice", "boss", "id")]
        assert ids(eng.linked("u", "Twice", ["boss"], ids=[1])) == want


def test_intermediate_folders(spark):
    """What a step leaves on its way is deleted; its result and others' results stay."""
    from quernstone.sources.scratch import cut, discard, settled

    inner, outer = [], cut(spark.range(3))

    def make():
        inner.append(cut(spark.range(5)))
        return settled(spark, lambda: cut(inner[0].where("id > 1"))).where("id > 2")

    done = settled(spark, make)
    assert ids(done) == [3, 4] and ids(outer) == [0, 1, 2]
    with pytest.raises(Exception):
        spark.read.parquet(inner[0]._quern_path)
    discard(spark, done)
    with pytest.raises(Exception):
        spark.read.parquet(done._quern_path)
