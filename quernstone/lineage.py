"""Lineage events, run history and closures over datasets."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from .errors import Validation
from .sources.scratch import cut

DEPTH_MAX, VISITED_MAX = 32, 10_000
SCHEMA = "run string, time double, state string, dataset string, direction string"


@dataclass
class Lineage:
    """Events, a row for each dataset of a run's event.  With a catalog they are
    part of its commits (the one of the data that they tell of, where there is
    one) and read from its log; without one they stay in memory."""

    catalog: object = None
    rows: list[tuple] = field(default_factory=list)

    def emit(self, run: str, time: float, state: str, inputs: list[str], outputs: list[str], tx=None) -> None:
        """tx: the commit that the event belongs to, else it makes one."""
        if state not in ("start", "complete", "fail"):
            raise Validation(f"unknown state {state}")
        new = [(run, time, state, d, "input") for d in inputs] + [(run, time, state, d, "output") for d in outputs]
        if tx is not None:
            tx.lineage += [list(r) for r in new]
        elif self.catalog is None:
            self.rows += new
        else:
            self.catalog.commit(lambda tx: tx.lineage.extend(list(r) for r in new))

    def frame(self, spark: SparkSession) -> DataFrame:
        if self.catalog is None or not self.catalog.current().id:
            return spark.createDataFrame(self.rows, SCHEMA)
        log = spark.read.schema("lineage array<array<string>>").json(f"{self.catalog.root}/_log")
        e = log.select(F.explode("lineage").alias("e"))
        return e.select(*[F.col("e")[i].cast(k).alias(n) for i, (n, k) in enumerate(c.split() for c in SCHEMA.split(", "))])


def edges(events: DataFrame) -> DataFrame:
    """(u, v): an input and an output of one run."""
    ins = events.where("direction = 'input'").select("run", F.col("dataset").alias("u"))
    outs = events.where("direction = 'output'").select("run", F.col("dataset").alias("v"))
    return ins.join(outs, "run").select("u", "v").where("u != v").distinct()


def closure(links: DataFrame, seeds: DataFrame, depth: int, upstream: bool = False, readable: DataFrame | None = None) -> DataFrame:
    """(dataset, depth) within depth steps of seeds (dataset), which don't
    count.  readable (dataset): the walk ends where it leaves that set, and an
    unreadable seed gives nothing."""
    if not 1 <= depth <= DEPTH_MAX:
        raise Validation(f"depth is 1 to {DEPTH_MAX}")
    a, b = ("v", "u") if upstream else ("u", "v")
    steps = links.select(F.col(a).alias("u"), F.col(b).alias("v"))
    start = seeds.select("dataset").distinct()
    if readable is not None:
        ok = readable.select("dataset").distinct()
        steps = steps.join(ok, steps["v"] == ok["dataset"], "left_semi")
        start = start.join(ok, "dataset", "left_semi")
    steps = cut(steps)
    seen = cut(start.withColumn("depth", F.lit(0)))
    frontier = seen
    for d in range(1, depth + 1):
        new = steps.join(frontier, steps["u"] == frontier["dataset"], "left_semi").select(F.col("v").alias("dataset")).distinct()
        new = cut(new.join(seen.select("dataset"), "dataset", "left_anti").withColumn("depth", F.lit(d)))
        if new.limit(1).count() == 0:
            break
        seen, frontier = seen.unionByName(new), new
    return seen.where("depth > 0")


def runs(events: DataFrame) -> DataFrame:
    """Each run's newest state, its time, and whether it wrote; newest first."""
    return (
        events.groupBy("run")
        .agg(F.max(F.struct("time", "state")).alias("last"), F.bool_or(F.col("direction") == "output").alias("wrote"))
        .select("run", F.col("last.time").alias("time"), F.col("last.state").alias("state"), "wrote")
        .orderBy(F.col("time").desc(), "run")
    )


OWN = "quern"


def dataset_of(name: str, own: str = OWN) -> tuple[str, str]:
    """(kind, name) of a lineage dataset `namespace:name`: a table or a type of
    our own namespace, else external.  A name of our own that can't be read is
    an error, never external."""
    space, colon, rest = name.partition(":")
    if not colon or space != own:
        return "external", name
    kind, slash, inner = rest.partition("/")
    if kind == "table" and slash and inner.count(".") == 1 and all(inner.split(".")):
        return "table", inner
    if kind == "type" and slash and inner:
        return "type", inner
    raise Validation(f"can't read dataset {name}")


def binding_events(types: dict, views: dict, time: float, own: str = OWN) -> list[tuple]:
    """Lineage rows of type bindings (table to type) and views (base to view)."""
    out = []
    for t in types.values():
        out += [(f"bind:{t.name}", time, "complete", f"{own}:table/{t.table}", "input"), (f"bind:{t.name}", time, "complete", f"{own}:type/{t.name}", "output")]
    for name, (base, _, _) in views.items():
        out += [(f"view:{name}", time, "complete", f"{own}:table/{base}", "input"), (f"view:{name}", time, "complete", f"{own}:view/{name}", "output")]
    return out
