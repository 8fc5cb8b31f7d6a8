"""Traversal of links: chains of up to four hops, and associations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..errors import BadChain, BadFilter
from ..ontology import Link
from .governed import DEFAULT_LIMIT, Context, Governed, governed

MAX_HOPS = 4


def hop(ctx: Context, source: DataFrame, link: Link, target: DataFrame, at=None) -> DataFrame:
    """The target rows that a source row links to, each once."""
    keys = source.select(F.col(link.from_column).alias("__k")).where("__k IS NOT NULL")
    if link.join_table:
        mapping = ctx.table(link.join_table, at).select(F.col(link.join_from).alias("__f"), F.col(link.join_to).alias("__t"))
        keys = mapping.join(keys, F.col("__f") == F.col("__k"), "left_semi").select(F.col("__t").alias("__k"))
    return target.join(keys, target[link.to_column] == F.col("__k"), "left_semi")


def resolve(ctx: Context, source: str, path: list[str]) -> list[Link]:
    out, at = [], source
    for name in path:
        out.append(ctx.registry.link(at, name))
        at = out[-1].target
    return out


def finish(g: Governed, df: DataFrame, limit: int | None) -> DataFrame:
    """Final objects: by raw identity below the mask, else distinct visible rows.
    Semi-joins give each row once, so unique identities need no shuffle."""
    if g.type.identity:
        df = df if g.type.unique else df.dropDuplicates([g.type.identity])
        if limit is not None:
            df = df.orderBy(F.col(g.type.identity).asc_nulls_first()).limit(limit)
        return df.select(*g.projection())
    out = df.select(*g.projection()).distinct()
    if limit is not None:
        clear = [F.col(c).asc_nulls_first() for c in g.visible if c not in g.policy.mask]
        out = (out.orderBy(*clear) if clear else out).limit(limit)
    return out


def position_filters(links: list[Link], filters: dict[str, str] | None) -> list[dict[str, str]]:
    """`link.column` addresses the type that the link reaches."""
    out: list[dict[str, str]] = [{} for _ in links]
    for name, text in (filters or {}).items():
        link, dot, column = name.partition(".")
        at = [i for i, x in enumerate(links) if x.name == link.removeprefix("~")]
        if not dot or not at:
            raise BadFilter(f"{name} addresses no link of the chain")
        if len(at) > 1:
            raise BadFilter(f"link {link} stands in the chain {len(at)} times")
        out[at[0]][column] = text
    return out


def chain(ctx: Context, subject: str, source: str, path: list[str], seeds: dict[str, str] | None = None, ids: list | None = None, filters: dict[str, str] | None = None, limit: int | None = DEFAULT_LIMIT, at=None) -> DataFrame:
    """Objects at the end of the path from the seeds; every position is governed.
    Semi-joins forward: no hop multiplies rows."""
    if not 1 <= len(path) <= MAX_HOPS:
        raise BadChain(f"a chain has 1 to {MAX_HOPS} links")
    start = governed(ctx, subject, source, at)
    df = start.where(seeds, ids)
    links = resolve(ctx, source, path)
    g = start
    for link, own in zip(links, position_filters(links, filters)):
        g = governed(ctx, subject, link.target, at)
        df = hop(ctx, df, link, g.where(own), at)
    return finish(g, df, limit)


def association(ctx: Context, subject: str, source: str, link_name: str, seeds: dict[str, str] | None = None, at=None) -> DataFrame:
    """Distinct (from_id, to_id) over a link; both identities must be visible."""
    a = governed(ctx, subject, source, at)
    link = ctx.registry.link(source, link_name)
    b = governed(ctx, subject, link.target, at)
    left = a.where(seeds).select(F.col(a.identity()).alias("from_id"), F.col(link.from_column).alias("__k"))
    right = b.raw.select(F.col(b.identity()).alias("to_id"), F.col(link.to_column).alias("__t"))
    if link.join_table:
        mapping = ctx.table(link.join_table, at).select(F.col(link.join_from).alias("__f"), F.col(link.join_to).alias("__g")).distinct()
        left = left.join(mapping, F.col("__k") == F.col("__f")).select("from_id", F.col("__g").alias("__k"))
    return left.join(right, F.col("__k") == F.col("__t")).select("from_id", "to_id").distinct().orderBy("from_id", "to_id")
