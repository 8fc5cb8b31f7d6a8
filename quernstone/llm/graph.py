"""Connected components by alternating large and small stars.

Each round joins every node to the least node it knows; rounds go on until the
edges stay the same, which takes about log(n) of them.  Nothing is collected:
the least neighbour is an aggregate summed before the shuffle; the edges of a
node with very many of them meet it by broadcast, the others in a shuffle; each
round's edges are written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .spark_util import cut, discard, settled, skew_join


def components(edges: DataFrame) -> DataFrame:
    """(node, root): for edges (a long, b long) every node with the least node
    of its component, itself included."""
    e = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct())
    mark = _mark(e)

    def round_(e: DataFrame) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        met = skew_join(both, least, ["a"], "n", 2 * mark[0])
        large = cut(met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        met = skew_join(large, least, ["a"], "n", 2 * mark[0])
        small = met.select(F.inline(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))))
        return small.where("a != b").distinct()

    while True:
        before, e = e, settled(edges.sparkSession, lambda: round_(e))
        discard(edges.sparkSession, before)
        now = _mark(e)
        if now == mark:
            break
        mark = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def _mark(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a") % 1000003)).first())
