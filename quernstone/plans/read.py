"""Flat reads: filters, derived aggregates over links, paging."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import types as L
from ..errors import BadPagination, Forbidden, UnknownLink
from ..ontology import Derived
from .governed import DEFAULT_LIMIT, Context, Governed, governed

PAGE_DEFAULT, PAGE_MAX = 20, 200
FEW = 10_000  # rows whose keys may go to every task


def _aggregate(d: Derived):
    c = F.col("__value")
    if d.fn == "count":
        return F.count(F.lit(1))
    if d.fn == "sum":
        return F.sum(c)
    return {"avg": F.avg, "min": F.min, "max": F.max}[d.fn](c)


def with_derived(ctx: Context, subject: str, g: Governed, df: DataFrame, at=None, few: bool = False) -> tuple[DataFrame, list[str]]:
    """df with the type's derived columns, each aggregated over its link's target
    first and then joined; those whose target, column or link isn't readable are
    left out.  Rows of a mapping count as often as they stand there.  few: df is
    a page, so only what its keys (sent to every task) link to is aggregated."""
    names = []
    grouped: dict[str, list[Derived]] = {}
    for d in g.type.derived:
        grouped.setdefault(d.link, []).append(d)
    for link_name, wanted in grouped.items():
        try:
            link = ctx.registry.link(g.type.name, link_name)
            target = governed(ctx, subject, link.target, at)
        except (UnknownLink, Forbidden):
            continue
        wanted = [d for d in wanted if d.fn == "count" or (d.column in target.filterable and (L.numeric(target.filterable[d.column]) if d.fn in ("sum", "avg") else L.ordered(target.filterable[d.column])))]
        if not wanted:
            continue
        rows = target.raw
        key = link.to_column
        if link.join_table:
            mapping = ctx.table(link.join_table, at).select(F.col(link.join_from).alias("__from"), F.col(link.join_to).alias("__to"))
            if few:
                mapping = mapping.join(F.broadcast(df.select(F.col(link.from_column).alias("__own"))), F.col("__from") == F.col("__own"), "left_semi")
            rows = mapping.join(rows, F.col("__to") == F.col(link.to_column))
            key = "__from"
        elif few:
            rows = rows.join(F.broadcast(df.select(F.col(link.from_column).alias("__own"))), F.col(key) == F.col("__own"), "left_semi")
        aggs = [_aggregate(Derived(d.name, d.fn, d.link)).alias(d.name) if d.fn == "count" else _over(d) for d in wanted]
        sums = rows.groupBy(F.col(key).alias("__key")).agg(*aggs)
        df = df.join(sums, df[link.from_column] == sums["__key"], "left").drop("__key")
        zero = {d.name: F.coalesce(F.col(d.name), F.lit(0)) for d in wanted if d.fn in ("count", "sum")}
        df = df.withColumns(zero) if zero else df
        names += [d.name for d in wanted]
    order = [d.name for d in g.type.derived]
    return df, sorted(names, key=order.index)


def _over(d: Derived):
    return {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[d.fn](F.col(d.column)).alias(d.name)


def select(ctx: Context, subject: str, name: str, filters: dict[str, str] | None = None, ids: list | None = None, any_of: list[list[str]] | None = None, derived: bool = False, limit: int | None = DEFAULT_LIMIT, at=None) -> DataFrame:
    """Objects of a type as the subject may see them; by identity if it is
    visible, as a limit without an order would give any rows."""
    g = governed(ctx, subject, name, at)
    df = g.where(filters, ids, any_of)
    more: list[str] = []
    if limit is not None:
        df = df.orderBy(F.col(g.type.identity).asc_nulls_first()).limit(limit) if g.type.identity in g.filterable else df.limit(limit)
    if derived and g.type.derived:
        df, more = with_derived(ctx, subject, g, df, at, few=limit is not None and limit <= FEW)
    return df.select(*g.projection(), *more)


def page(ctx: Context, subject: str, name: str, size: int | None = None, cursor=None, filters: dict[str, str] | None = None, ids: list | None = None, derived: bool = False, at=None) -> DataFrame:
    """The next size objects after the cursor by identity, and one more row if
    there are more (see cursor_of)."""
    if ids is not None:
        raise BadPagination("an object set has no pages")
    g = governed(ctx, subject, name, at)
    i = g.type.identity
    if i is None:
        raise BadPagination(f"{name} has no identity")
    if i not in g.filterable:
        raise BadPagination("the identity isn't visible")
    if L.base(g.filterable[i]) not in ("integer", "long", "string"):
        raise BadPagination("the identity's type has no cursor")
    df = g.where(filters)
    if cursor is not None:
        try:
            df = df.where(F.col(i) > F.lit(L.parse_literal(str(cursor), g.filterable[i])))
        except ValueError as e:
            raise BadPagination(f"bad cursor: {e}") from None
    n = max(1, min(size or PAGE_DEFAULT, PAGE_MAX))
    df = df.orderBy(F.col(i).asc_nulls_first()).limit(n + 1)
    more: list[str] = []
    if derived and g.type.derived:
        df, more = with_derived(ctx, subject, g, df, at, few=True)
        df = df.orderBy(F.col(i).asc_nulls_first())
    return df.select(*g.projection(), *more)


def cursor_of(rows: list, size: int | None, identity: str):
    """(rows of the page, next cursor or None) of page()'s collected rows."""
    n = max(1, min(size or PAGE_DEFAULT, PAGE_MAX))
    return (rows[:n], rows[n - 1][identity]) if len(rows) > n else (rows, None)
