"""Read-only SQL over a closed world: a session of its own with nothing but the
governed views of what the subject may read."""

from __future__ import annotations

import re
import threading
import uuid

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession

from ..errors import EngineError, Forbidden, ResourceExhausted, Validation
from ..streaming.streams import view_of
from .governed import Context, governed

CONSOLE_DEFAULT, CONSOLE_MAX, EXPORT_MAX, DEADLINE_S = 1000, 10_000, 1_000_000, 60.0


def session_for(ctx: Context, subject: str, views: dict[str, tuple[str, str, list[str]]] | None = None, at=None) -> tuple[SparkSession, set[str]]:
    """A session, and its views' names, with the governed form of each readable type under its bare
    table name (the first type of a table wins) and its type name; views: name
    to (base table, predicate, columns), granted by their own name."""
    session = ctx.spark.newSession()
    session.conf.set("spark.sql.ansi.doubleQuotedIdentifiers", "true")
    session.conf.set("spark.sql.ansi.enabled", "true")
    session.conf.set("spark.sql.legacy.ctePrecedencePolicy", "CORRECTED")
    known: set[str] = set()
    for table, t in ctx.registry.typed_tables().items():
        try:
            g = governed(ctx, subject, t.name, at)
        except EngineError:
            continue
        for name in {table.rsplit(".", 1)[-1].lower(), t.name.lower()}:
            view_of(session, g.raw.select(*g.projection()), name)
            known.add(name)
    for name, (base, predicate, columns) in (views or {}).items():
        if ctx.acl.allowed(subject, name):
            policy = ctx.acl.policy(subject, name)
            rows = ctx.table(base, at).where(predicate)
            if policy.row_filters:
                rows = rows.where(policy.condition())
            view_of(session, rows.select([c for c in columns if c not in policy.deny]), name)
            known.add(name)
    return session, known


# What a query's parsed plan may be made of; anything else is refused.
NODES = set(
    "Project Filter Aggregate Join LateralJoin Sort GlobalLimit LocalLimit Offset Distinct Union Intersect Except SubqueryAlias UnresolvedSubqueryColumnAliases"
    " UnresolvedWith UnresolvedRelation UnresolvedInlineTable OneRowRelation OneRowRelation$ WithWindowDefinition UnresolvedHaving UnresolvedHint Generate Pivot Unpivot Sample PipeOperator".split()
)
UNRESOLVED = set("UnresolvedAttribute UnresolvedStar UnresolvedStarExceptOrReplace UnresolvedAlias UnresolvedFunction UnresolvedExtractValue UnresolvedNamedLambdaVariable UnresolvedGenerator UnresolvedWindowExpression UnresolvedRegex UnresolvedOrdinal".split())
GROUPS = set("agg_funcs array_funcs bitwise_funcs collection_funcs conditional_funcs conversion_funcs csv_funcs datetime_funcs generator_funcs hash_funcs json_funcs lambda_funcs map_funcs math_funcs predicate_funcs string_funcs struct_funcs url_funcs variant_funcs window_funcs".split())
RANDOM = set("rand randn random randstr uniform shuffle".split())
OUTSIDE = set("CurrentUser SessionUser CurrentCatalog CurrentDatabase InputFileName InputFileBlockStart InputFileBlockLength CallMethodViaReflection TryReflect VariableReference PythonUDF ScalaUDF HiveSimpleUDF HiveGenericUDF".split())


def _all(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _name(x) -> str:
    return x.getClass().getSimpleName()


def _check_function(session: SparkSession, name: str) -> None:
    """Only Spark's own deterministic functions of data, by their group."""
    known = session._jvm.org.apache.spark.sql.catalyst.analysis.FunctionRegistry.builtin()
    info = known.lookupFunction(session._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(name.lower()))
    if name.lower() in RANDOM or not info.isDefined() or (info.get().getGroup() not in GROUPS and name.lower() != "typeof"):
        raise Forbidden(f"function {name} isn't callable")


def _check_expression(session: SparkSession, e, names: frozenset[str], views: frozenset[str]) -> None:
    kind = _name(e)
    if "Unresolved" in kind and kind not in UNRESOLVED or kind in OUTSIDE:
        raise Forbidden(f"{kind} isn't readable")
    if kind == "UnresolvedFunction":
        parts = _all(e.nameParts())
        if len(parts) != 1:
            raise Forbidden(f"function {'.'.join(parts)} isn't callable")
        _check_function(session, parts[0])
    elif kind == "UnresolvedGenerator":
        if e.name().database().isDefined():
            raise Forbidden(f"function {e.name()} isn't callable")
        _check_function(session, e.name().funcName())
    elif kind.endswith("Subquery") or kind in ("Exists", "ListQuery"):
        if kind != "InSubquery":
            _check_plan(session, e.plan(), names, views)
    for c in _all(e.children()):
        _check_expression(session, c, names, views)


def _check_plan(session: SparkSession, node, names: frozenset[str], views: frozenset[str]) -> None:
    """names: the common table expressions in scope."""
    kind = _name(node)
    if kind not in NODES:
        raise Forbidden(f"{kind} is no query")
    if kind == "UnresolvedRelation":
        parts = [p.lower() for p in _all(node.multipartIdentifier())]
        if len(parts) != 1 or parts[0] not in names | views:
            raise Forbidden(f"{'.'.join(parts)} isn't readable")
    elif kind == "UnresolvedWith":
        for cte in _all(node.cteRelations()):
            own = cte._1().lower()
            _check_plan(session, cte._2(), names | {own} if node.allowRecursion() else names, views)
            names = names | {own}
    elif kind == "WithWindowDefinition":
        for definition in _all(node.windowDefinitions().values().toSeq()):
            _check_expression(session, definition, names, views)
    for e in _all(node.expressions()):
        _check_expression(session, e, names, views)
    for c in _all(node.children()):
        _check_plan(session, c, names, views)


def _check_leaves(node) -> None:
    """Of the analysed plan: data comes from the session's views alone."""
    kind = _name(node)
    if kind == "View":
        if not node.isTempView():
            raise Forbidden("a stored view isn't readable")
        return
    children = _all(node.children()) + _all(node.innerChildren() if kind == "WithCTE" else node.subqueries())
    if not children and kind.rstrip("$") not in ("OneRowRelation", "LocalRelation", "CTERelationRef", "UnionLoopRef"):
        raise Forbidden(f"{kind} isn't readable")
    for e in _all(node.expressions()):
        todo = [e]
        while todo:
            x = todo.pop()
            if _name(x) in OUTSIDE:
                raise Forbidden(f"{_name(x)} isn't readable")
            todo += _all(x.children())
    for c in children:
        _check_leaves(c)


def checked(session: SparkSession, sql: str, views: set[str]) -> DataFrame:
    """The query's DataFrame.  Its parsed plan is walked before it is analysed:
    only nodes, functions and names of a closed world pass, with the scopes of
    common table expressions; its analysed plan is walked once more."""
    try:
        plan = session._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except ParseException as e:
        raise Validation(f"syntax error: {e.getMessage()}") from None
    if _name(plan).startswith("OneRowRelation"):
        raise Forbidden("no query")
    _check_plan(session, plan, frozenset(), frozenset(v.lower() for v in views))
    df = session.sql(sql)
    _check_leaves(df._jdf.queryExecution().analyzed())
    return df


def query(ctx: Context, subject: str, sql: str, views=None, at=None) -> DataFrame:
    session, names = session_for(ctx, subject, views, at)
    return checked(session, sql, names)


def console(ctx: Context, subject: str, sql: str, limit: int = CONSOLE_DEFAULT, deadline_s: float = DEADLINE_S, views=None, scan_bytes: int | None = None) -> tuple[list, bool]:
    """(rows, whether there were more), stopped at the deadline; a statement that
    would read more than scan_bytes, after pruning, is refused before it runs."""
    n = max(1, min(limit, CONSOLE_MAX))
    df = query(ctx, subject, sql, views).limit(n + 1)
    if scan_bytes is not None and (size := scanned(df)) > scan_bytes:
        raise ResourceExhausted(f"the statement reads {size} bytes, more than {scan_bytes}")
    rows = with_deadline(df, deadline_s)
    return rows[:n], len(rows) > n


def scanned(df: DataFrame) -> int:
    """Bytes of the sources that the optimised plan reads, as far as Spark knows them."""
    return sum(int(str(leaf.stats().sizeInBytes())) for leaf in _all(df._jdf.queryExecution().optimizedPlan().collectLeaves()))


def with_deadline(df: DataFrame, seconds: float) -> list:
    sc, tag = df.sparkSession.sparkContext, f"quern-{uuid.uuid4().hex}"
    late = threading.Event()

    def stop():
        late.set()
        sc.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds, stop)
    sc.addJobTag(tag)
    timer.start()
    try:
        return df.collect()
    except Exception as e:
        if late.is_set():
            raise ResourceExhausted(f"stopped after {seconds} s") from e
        raise
    finally:
        timer.cancel()
        sc.removeJobTag(tag)


def export(df: DataFrame, most: int = EXPORT_MAX):
    """The rows one by one; an error, not a shorter result, beyond the cap."""
    for i, r in enumerate(df.limit(most + 1).toLocalIterator()):
        if i == most:
            raise ResourceExhausted(f"more than {most} rows")
        yield r


def validate(ctx: Context, subject: str, sql: str, views=None) -> list[dict]:
    """Problems (message, line, column) without running anything."""
    if re.match(r"(?is)^\s*(?:--[^\n]*\n|/\*.*?\*/|\s)*explain\b", sql):
        return [{"message": "EXPLAIN is no query", "line": 1, "column": 0}]
    try:
        query(ctx, subject, sql, views)
        return []
    except (ParseException, AnalysisException) as e:
        m = re.search(r"line (\d+), pos (\d+)", str(e))
        return [{"message": str(e).split("\n")[0], "line": int(m[1]) if m else 1, "column": int(m[2]) if m else 0}]
    except EngineError as e:
        m = re.search(r"line (\d+), pos (\d+)", str(e))
        return [{"message": str(e).split("\n")[0], "line": int(m[1]) if m else 1, "column": int(m[2]) if m else 0}]
