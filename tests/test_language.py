"""Grammars and rules that need no cluster."""

import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quernstone import acl as A
from quernstone import types as L
from quernstone.errors import AmbiguousLink, BadFilter, BadGraphPath, Conflict, UnknownLink, Validation
from quernstone.functions import expr as E
from quernstone.functions import predicates as P
from quernstone.ontology import Constraint, Derived, Link, ObjectType, Property, Registry, VectorIndex
from quernstone.plans.chain import position_filters
from quernstone.plans.graph import check_depth, parse_path
from quernstone.sources.catalog import file_count, may_match
from quernstone.transforms import Queue, Transform, check, cron_next, trigger_cycles
from pyspark.sql import types as T


def test_types():
    assert L.base("EmailAddress") == "string" and L.base("Vector(3)") == "vector(3)"
    for bad in ("decimal", "vector(0)", "vector", ""):
        with pytest.raises(Validation):
            L.base(bad)
    assert not L.satisfies(T.IntegerType(), "long") and L.satisfies(T.LongType(), "long")
    assert L.render(2**60, "long") == str(2**60) and L.render(dt.datetime(2020, 1, 2, 3, 4, 5), "timestamp") == "2020-01-02T03:04:05"


def test_predicates():
    p = lambda t, k="long": P.parse("c", t, k)
    assert p("gt:5") == P.Predicate("c", "gt", (5,)) and p("5") == P.Predicate("c", "eq", (5,))
    assert p("foo:bar", "string") == P.Predicate("c", "eq", ("foo:bar",))
    assert p("in:a\\,b,c\\\\", "string").values == ("a,b", "c\\")
    assert p("isnull:").op == "isnull" and p("between:2020-01-01,2020-02-01", "date").values[1] == dt.date(2020, 2, 1)
    for text, kind in [("gt:x", "long"), ("in:", "long"), ("between:1", "long"), ("contains:a", "long"), ("eq:1", "vector(3)"), ("eq:2020-1-1", "date"), ("eq:99999999999", "integer"), ("in:a\\b", "string"), ("gt:true", "boolean"), ("isnull:x", "long"), ("eq:nan", "double"), ("eq:2020-01-01 00:00:00", "timestamp")]:
        with pytest.raises(BadFilter):
            P.parse("c", text, kind)
    with pytest.raises(BadFilter, match="can't be filtered"):
        P.parse_visible("hidden", "gt:x", {"c": "long"})
    with pytest.raises(BadFilter):
        P.parse_or(["c:eq:1"], {"c": "long"})
    assert P.split_params([("a", "1"), ("_limit", "5"), ("a", "2"), ("type", "x")], {"type"}) == ({"_limit": "5", "type": "x"}, {"a": "2"})


@given(st.lists(st.text(max_size=8), min_size=1, max_size=5))
@settings(deadline=None, max_examples=200)
def test_sets_round_trip(parts):
    text = ",".join(p.replace("\\", "\\\\").replace(",", "\\,") for p in parts)
    if text:
        assert P.split_set(text) == parts


def test_roles_and_policies():
    a = A.Acl()
    a.add_role("base")
    a.add_role("mid", "base")
    with pytest.raises(Conflict):
        a.add_role("base", "mid")
    a.assign("u", "mid")
    assert not a.allowed("u", "T") and not a.allowed("nobody", "T")
    a.grant("base", "T")
    assert a.allowed("u", "T")
    a.grant("mid", "T", effect="deny")
    assert not a.allowed("u", "T")
    a.set_policy("base", "T", A.Policy((A.Compare("x", "gt", 1),), frozenset({"d"})))
    a.set_policy("mid", "T", A.Policy((A.Compare("y", "in", ["a"]),), mask=frozenset({"m"})))
    p = a.policy("u", "T")
    assert len(p.row_filters) == 2 and p.deny == {"d"} and p.mask == {"m"}
    for bad in (A.Compare("x", "in", 1), A.Compare("x", "eq", [1]), A.Compare("x", "contains", "a"), A.Compare("x", "eq", 1.5)):
        with pytest.raises(Validation):
            a.set_policy("base", "T", A.Policy((bad,)))


def test_three_valued_logic():
    eq = lambda v: A.Compare("x", "eq", v)
    assert A.holds(A.And(()), {}) is True and A.holds(A.Or(()), {}) is False
    assert A.holds(eq(1), {"x": None}) is None and A.holds(A.Not(eq(1)), {"x": None}) is None
    assert A.holds(A.Or((eq(1), A.Compare("x", "isnull"))), {"x": None}) is True
    assert A.holds(A.Compare("x", "nin", [1, 2]), {"x": None}) is None
    assert A.holds(A.Compare("x", "nin", ["a", 2]), {"x": 1}) is None
    assert A.holds(A.Compare("x", "in", ["a", 1]), {"x": 1}) is True


def ev(src, props=None, params=None, now=None):
    e = E.parse(src)
    kinds = lambda d: {k: {bool: "boolean", int: "long", float: "double", str: "string"}.get(type(v), "long") for k, v in (d or {}).items()}
    E.typecheck(e, kinds(props), kinds(params))
    return E.evaluate(e, props or {}, params or {}, now)


@pytest.mark.parametrize(
    "src,want",
    [
        ("1 + 2 * 3", 7), ("7 / 2", 3), ("-7 / 2", -3), ("-7 % 2", -1), ("7.0 / 2", 3.5), ("9223372036854775807 + 1", -(2**63)), ("'a' ++ 'b''c'", "ab'c"),
        ("null ++ 'a'", None), ("false and null", None), ("true or null", None), ("not null", None), ("1 = 1.0", True), ("null = null", None), ("if null then 1 else 2", 2),
        ("cast('  12 ' as integer)", 12), ("cast(-2.9 as long)", -2), ("upper('é') ++ lower('AB')", "Éab"), ("length('é😀')", 2), ("substr('hello', 2, 3)", "ell"), ("coalesce(null, 2, 3)", 2),
        ("1 < 2 and not 2 < 1", True), ("-(3 - 5)", 2), ("2 - 3 - 4", -5), ("cast(true as string)", "true"), ("cast('2020-01-02' as date)", dt.date(2020, 1, 2)),
    ],
)
def test_expressions(src, want):
    assert ev(src) == want


@pytest.mark.parametrize("src", ["1 +", "foo(1)", "1 / 0", "substr('abc', 0, 1)", "substr('abc', 2, 3)", "'a' + 1", "@later", "unknown", "if 1 then 2 else 3", "if true then 1 else 'a'", "cast('x' as long)", "cast(1 as boolean)", "cast(1 as vector(2))", "(1", "1 2", "cast(3000000000 as integer)", "1 = 'a'"])
def test_bad_expressions(src):
    with pytest.raises(Validation):
        ev(src)


def test_props_and_now():
    now = dt.datetime(2024, 1, 1)
    assert ev("@a + b", {"a": 1}, {"b": 2.5}) == 3.5 and ev("now()", now=now) == now


def registry():
    r = Registry()
    p = lambda *n: tuple(Property(x, "long") for x in n)
    r.define_type(ObjectType("A", "a", p("id", "b"), "id"))
    r.define_type(ObjectType("B", "b", p("id", "a"), "id"))
    r.define_link(Link("x", "A", "B", "b", "id"))
    r.define_link(Link("y", "B", "A", "a", "id"))
    return r


def test_links():
    r = registry()
    assert r.link("B", "~x").inverse() == r.link("A", "x")
    with pytest.raises(UnknownLink):
        r.link("A", "z")
    r.define_link(Link("x", "B", "B", "a", "id"))
    with pytest.raises(AmbiguousLink):
        r.link("B", "~x")
    with pytest.raises(Validation) as e:
        r.define_link(Link("q", "A", "C", "nope", "id"))
    assert len(e.value.violations) == 2
    with pytest.raises(Conflict):
        r.delete_type("A")


def test_declarations(tmp_path):
    bad = ObjectType("T", "t", (Property("_r", "long"), Property("s", "string", constraints=(Constraint("range", min=1), Constraint("pattern", pattern="("))), Property("v", "vector(2)"), Property("s", "odd")), "none", (Derived("s", "median", "l"),), "s")
    with pytest.raises(Validation) as e:
        Registry().define_type(bad)
    assert len(e.value.violations) >= 7
    r = registry()
    with pytest.raises(Validation):
        r.define_index(VectorIndex("i", "A", "b"))
    r.define_type(ObjectType("V", "v", (Property("id", "long"), Property("s", "string", constraints=(Constraint("one_of", values=("a",)),)), Property("e", "vector(2)")), "id"))
    r.define_index(VectorIndex("i", "V", "e"))
    r.save(f"{tmp_path}/o.json")
    back = Registry.load(f"{tmp_path}/o.json")
    assert back.types == r.types and back.links == r.links and back.indexes == r.indexes


def test_paths():
    assert parse_path("a,~b") == (["a", "~b"], []) and parse_path("a*,b") == (["a"], ["b"])
    for bad in ("", "a,,b", "a,b*", "a*,b*"):
        with pytest.raises(BadGraphPath):
            parse_path(bad)
    for bad in (0, 11):
        with pytest.raises(BadGraphPath):
            check_depth(bad)
    x = Link("x", "A", "B", "b", "id")
    assert position_filters([x], {"x.id": "gt:1"}) == [{"id": "gt:1"}]
    for links, f in (([x], {"id": "1"}), ([x, x], {"x.id": "1"})):
        with pytest.raises(BadFilter):
            position_filters(links, f)


def test_pruning_keeps_in_doubt():
    s = {"a": {"nulls": 0, "min": 5, "max": 9}, "b": {"nulls": 3}}
    k = T.LongType()
    assert not may_match(s, "a", "eq", (4,), k) and may_match(s, "a", "in", (1, 5), k) and not may_match(s, "a", "between", (10, 12), k)
    assert not may_match(s, "a", "gt", (9,), k) and may_match(s, "a", "ge", (9,), k) and not may_match(s, "a", "lt", (5,), k)
    assert may_match(s, "a", "eq", ("4",), k) and may_match(s, "b", "eq", (1,), k) and may_match(s, "c", "eq", (1,), k) and may_match(s, "a", "ne", (7,), k)


@given(st.lists(st.integers(-20, 20), min_size=1), st.sampled_from(["eq", "lt", "le", "gt", "ge", "between", "in"]), st.integers(-25, 25), st.integers(-25, 25))
def test_pruning_never_loses_rows(values, op, x, y):
    hit = {"eq": lambda v: v == x, "lt": lambda v: v < x, "le": lambda v: v <= x, "gt": lambda v: v > x, "ge": lambda v: v >= x, "between": lambda v: x <= v <= y, "in": lambda v: v in (x, y)}[op]
    args = (x, y) if op in ("between", "in") else (x,)
    if any(map(hit, values)):
        assert may_match({"a": {"min": min(values), "max": max(values), "nulls": 0}}, "a", op, args, T.LongType())


def test_files_by_size():
    assert file_count(0) == 1 and file_count(1 << 30) == 3 and file_count(1 << 50) == 2516583 and file_count(1 << 50, 64) == 64


def test_cron():
    t = dt.datetime(2024, 2, 28, 23, 59, 30)
    assert cron_next("* * * * *", t) == dt.datetime(2024, 2, 29)
    assert cron_next("30 4 * * 1", t) == dt.datetime(2024, 3, 4, 4, 30)
    assert cron_next("0 0 29 2 *", dt.datetime(2024, 3, 1)) == dt.datetime(2028, 2, 29)
    assert cron_next("*/15 8-9 1,15 * 7", dt.datetime(2024, 3, 1, 9, 45)) == dt.datetime(2024, 3, 3, 8)
    for bad in ("* * * *", "60 * * * *", "a * * * *", "*/0 * * * *", "0 0 31 2 *"):
        with pytest.raises(Validation):
            cron_next(bad, t)


def test_triggers_and_queue():
    assert trigger_cycles({"a": ({"x"}, "y"), "b": ({"y"}, "x"), "c": ({"y"}, "z")}) == ["a", "b", "c"]
    assert trigger_cycles({"a": ({"x"}, "x")}) == ["a"] and trigger_cycles({"a": ({"x"}, "x")}, allow_self=True) == []
    with pytest.raises(Validation):
        check(Transform("run", "", ("a.t", "b.t"), "o", "odd"))
    now = [0.0]
    q = Queue(lambda: now[0], max_attempts=2)
    q.put("j", {"n": 1})
    assert q.put("j", {"n": 1}, dedupe=True) is None
    high = q.put("k", priority=5)
    q.put("later", run_at=10)
    assert q.claim().id == high.id and q.claim().name == "j" and q.claim() is None
    now[0] = 100
    assert [j.name for j in q.reconcile(50)] == ["j", "k"] and q.claim(["other"]) is None
    high = q.claim()
    assert high.name == "k" and high.attempts == 2
    q.failed(high)
    assert high.state == "abandoned"
    q.done(q.claim())
    assert [j.name for j in q.jobs] == ["k", "later"] or [j.name for j in q.jobs] == ["j", "k"]
