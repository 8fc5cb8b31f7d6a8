"""Bounded reachability and shortest-path trees over cyclic link paths.

The edges of one repeat of the path are composed once, governed at every
landing; then a frontier goes level by level.  Each level is written to the
shared folder, so the plan stays flat and a lost executor costs one level."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..errors import BadGraphPath, NotCyclicPath
from ..ontology import Link
from ..sources.scratch import cut
from .chain import finish, hop, position_filters, resolve
from .governed import DEFAULT_LIMIT, Context, Governed, governed

DEPTH_DEFAULT, DEPTH_MAX = 5, 10


def check_depth(depth: int | None) -> int:
    depth = DEPTH_DEFAULT if depth is None else depth
    if not 1 <= depth <= DEPTH_MAX:
        raise BadGraphPath(f"depth is 1 to {DEPTH_MAX}")
    return depth


def parse_path(text: str) -> tuple[list[str], list[str]]:
    """`a,~b*,c`: names between commas, ~ for inverse; * ends the cyclic core,
    once and only before the tail.  Without * all of it is core."""
    parts = [p.strip() for p in text.split(",")]
    if not all(p.rstrip("*").lstrip("~") for p in parts):
        raise BadGraphPath("an empty link name")
    stars = [i for i, p in enumerate(parts) if p.endswith("*")]
    if len(stars) > 1 or (stars and stars[0] != 0):
        raise BadGraphPath("* stands once, at the first link")
    if stars:
        return [parts[0][:-1]], parts[1:]
    return parts, []


def path_edges(ctx: Context, subject: str, source: str, links: list[Link], at=None) -> DataFrame:
    """Distinct (u, v): identities joined by one repeat of the path."""
    if not links or links[-1].target != source:
        raise NotCyclicPath(f"the path from {source} ends at {links[-1].target if links else 'nothing'}")
    g = governed(ctx, subject, source, at)
    i = g.identity()
    now = g.raw.select(F.col(i).alias("u"), F.col(links[0].from_column).alias("__k"))
    for n, link in enumerate(links):
        if link.join_table:
            mapping = ctx.table(link.join_table, at).select(F.col(link.join_from).alias("__f"), F.col(link.join_to).alias("__g")).distinct()
            now = now.join(mapping, F.col("__k") == F.col("__f")).select("u", F.col("__g").alias("__k"))
        t = governed(ctx, subject, link.target, at)
        leave = links[n + 1].from_column if n + 1 < len(links) else t.type.identity
        t_rows = t.raw.select(F.col(link.to_column).alias("__t"), F.col(leave).alias("__next")).distinct()
        now = now.distinct().join(t_rows, F.col("__k") == F.col("__t")).select("u", F.col("__next").alias("__k"))
    return now.select("u", F.col("__k").alias("v")).where("u IS NOT NULL AND v IS NOT NULL").distinct()


def levels(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(id, depth) with the least depth >= 1 of all ids reached from seeds (id);
    a seed only counts if it is reached again."""
    edges = cut(edges)
    frontier = cut(seeds.select("id").distinct())
    seen: DataFrame | None = None
    for d in range(1, depth + 1):
        new = edges.join(frontier, edges["u"] == frontier["id"], "left_semi").select(F.col("v").alias("id")).distinct()
        if seen is not None:
            new = new.join(seen.select("id"), "id", "left_anti")
        new = cut(new.withColumn("depth", F.lit(d)))
        seen = new if seen is None else seen.unionByName(new)
        if new.limit(1).count() == 0:
            break
        frontier = new.select("id")
    return seen


def _core(ctx: Context, subject: str, source: str, path: str | None, links: list[str] | None, at) -> tuple[DataFrame, list[str]]:
    if (path is None) == (not links):
        raise BadGraphPath("give a path or links, not both")
    if path is not None:
        core, tail = parse_path(path)
        return path_edges(ctx, subject, source, resolve(ctx, source, core), at), tail
    arms = [path_edges(ctx, subject, source, [ctx.registry.link(source, n)], at) for n in dict.fromkeys(links)]
    return reduce(DataFrame.unionByName, arms).distinct(), []


def reach(ctx: Context, subject: str, source: str, path: str | None = None, links: list[str] | None = None, seeds: dict[str, str] | None = None, ids: list | None = None, depth: int | None = None, filters: dict[str, str] | None = None, limit: int | None = DEFAULT_LIMIT, at=None) -> DataFrame:
    """Objects reachable in 1 to depth repeats of a cyclic path (or over any of
    several self-links), then along the path's tail."""
    depth = check_depth(depth)
    g = governed(ctx, subject, source, at)
    edges, tail = _core(ctx, subject, source, path, links, at)
    start = g.where(seeds, ids).select(F.col(g.identity()).alias("id"))
    found = levels(edges, start, depth).select("id")
    df = g.raw.join(found, g.raw[g.type.identity] == found["id"], "left_semi")
    tail_links = resolve(ctx, source, tail)
    end: Governed = g
    for link, own in zip(tail_links, position_filters(tail_links, filters)):
        end = governed(ctx, subject, link.target, at)
        df = hop(ctx, df, link, end.where(own), at)
    return finish(end, df, limit)


def tree(ctx: Context, subject: str, source: str, path: str, seeds: dict[str, str] | None = None, ids: list | None = None, depth: int | None = None, at=None) -> DataFrame:
    """Shortest-path tree: visible columns, depth (roots 0) and the least parent
    at the depth before; ordered by depth and identity."""
    depth = check_depth(depth)
    g = governed(ctx, subject, source, at)
    i = g.identity()
    if "*" in path:
        raise BadGraphPath("a tree takes no *")
    edges = cut(path_edges(ctx, subject, source, resolve(ctx, source, parse_path(path)[0]), at))
    kind = dict(edges.dtypes)["v"]
    settled = cut(g.where(seeds, ids).select(F.col(i).alias("id")).distinct().select("id", F.lit(0).alias("depth"), F.lit(None).cast(kind).alias("parent")))
    frontier = settled
    for d in range(1, depth + 1):
        step = edges.join(frontier.select(F.col("id").alias("u")), "u").groupBy(F.col("v").alias("id")).agg(F.min("u").alias("parent"))
        new = cut(step.join(settled.select("id"), "id", "left_anti").select("id", F.lit(d).alias("depth"), "parent"))
        if new.limit(1).count() == 0:
            break
        settled = settled.unionByName(new)
        frontier = new
    found = settled.select(F.col("id").alias("_node"), F.col("depth").alias("_depth"), F.col("parent").alias("_parent"))
    rows = g.raw.join(found, F.col(i) == F.col("_node"))
    return rows.select(*g.projection(), "_depth", "_parent").orderBy("_depth", i)
