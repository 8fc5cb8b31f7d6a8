"""The engine: one object with everything a client calls."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession, functions as F

from .acl import Acl
from .actions import Actions, violation_counts
from .errors import Forbidden, NotFound, Validation
from .lineage import Lineage
from .ontology import ObjectType, Registry, bind_violations, infer_type
from .plans import chain, graph, read, search, sqlgate
from .plans.governed import Context, governed
from .sources.catalog import Catalog, Snapshot
from .streaming.streams import Streams
from .transforms import Transforms
from .types import render


class Engine:
    """warehouse: folder of the catalog; tables: further DataFrames by name."""

    def __init__(self, spark: SparkSession, warehouse: str | None = None, tables: dict[str, DataFrame] | None = None, clock=time.time):
        self.spark, self.clock = spark, clock
        self.registry, self.acl = Registry(), Acl()
        self.catalog = Catalog(spark, warehouse, clock) if warehouse else None
        self.lineage = Lineage(self.catalog)
        self.streams = Streams(self.catalog) if warehouse else None
        self.tables = dict(tables or {})
        self.views: dict[str, tuple[str, str, list[str]]] = {}
        self.actions, self.transforms = Actions(self), Transforms(self)
        self.transforms.handlers |= {"compact": lambda args: self.catalog.compact(args["table"]), "build_index": lambda args: self.build_index(args["type"], args["index"])}
        self.ctx = Context(spark, self.registry, self.acl, self.table, self.catalog)

    def table(self, name: str, at: Snapshot | None = None) -> DataFrame:
        if name in self.tables:
            return self.tables[name]
        if self.catalog is None:
            raise NotFound(f"table {name}")
        if self.catalog.entry(name, at)["meta"].get("stream"):
            return self.streams.state(name, at)
        return self.catalog.scan(name, at)

    def at(self, snapshot: int | None = None, timestamp: float | None = None) -> Snapshot | None:
        """One pinned snapshot for all tables of a request."""
        if snapshot is None and timestamp is None:
            return self.catalog.current() if self.catalog else None
        return self.catalog.as_of(snapshot, timestamp)

    # --- reads

    def objects(self, subject: str, name: str, **options) -> DataFrame:
        return read.select(self.ctx, subject, name, **options)

    def page(self, subject: str, name: str, **options) -> DataFrame:
        return read.page(self.ctx, subject, name, **options)

    def linked(self, subject: str, name: str, path: list[str], **options) -> DataFrame:
        return chain.chain(self.ctx, subject, name, path, **options)

    def association(self, subject: str, name: str, link: str, **options) -> DataFrame:
        return chain.association(self.ctx, subject, name, link, **options)

    def graph(self, subject: str, name: str, **options) -> DataFrame:
        return graph.reach(self.ctx, subject, name, **options)

    def tree(self, subject: str, name: str, path: str, **options) -> DataFrame:
        return graph.tree(self.ctx, subject, name, path, **options)

    def search(self, subject: str, name: str, index: str, query: list[float], k: int, **options) -> DataFrame:
        return search.governed_knn(self.ctx, subject, name, index, query, k, **options)

    def search_many(self, subject: str, name: str, index: str, queries: DataFrame, k: int, **options) -> DataFrame:
        return search.governed_knn_many(self.ctx, subject, name, index, queries, k, **options)

    def sql(self, subject: str, text: str) -> DataFrame:
        return sqlgate.query(self.ctx, subject, text, self.views)

    def console(self, subject: str, text: str, **options) -> tuple[list, bool]:
        return sqlgate.console(self.ctx, subject, text, views=self.views, **options)

    def validate(self, subject: str, text: str) -> list[dict]:
        return sqlgate.validate(self.ctx, subject, text, self.views)

    def rendered(self, subject: str, name: str, df: DataFrame) -> list[dict]:
        """Rows as JSON clients get them; df has the size of a page."""
        kinds = {p.name: p.type for p in self.registry.type(name).properties}
        masked = self.acl.policy(subject, name).mask
        return [{k: v if k in masked else render(v, kinds.get(k)) for k, v in r.asDict().items()} for r in df.collect()]

    def changes(self, subject: str, name: str, cursor: str | None = None, start: str = "earliest", fields: list[str] | None = None, limit: int = 256) -> tuple[list[dict], str]:
        """A page of a type's change feed, governed like its rows."""
        g = governed(self.ctx, subject, name)
        if fields is not None and not set(fields) <= set(g.visible):
            raise Forbidden("a field isn't readable")
        kept, after = self.streams.page(g.type.table, cursor, start, limit, g.policy.condition() if g.policy.row_filters else None)
        wanted = fields or g.visible
        return [{**{c: "***" if c in g.policy.mask else r[c] for c in wanted}, "_kind": r["_chg_kind"], "_bucket": r["_chg_bucket"], "_offset": r["_chg_offset"]} for r in kept], after

    # --- landing

    def land(self, table: str, df: DataFrame, size: int | None = None, mode: str = "append") -> int:
        def also(tx):
            self.lineage.emit(f"land@{tx.next}", self.clock(), "complete", [], [table], tx)
            self.transforms.fire(tx, table)

        return self.catalog.land(table, df, size, mode, also=also)

    def land_model(self, name: str, df: DataFrame, identity: str | None = None, mode: str = "append") -> int:
        """Lands rows of a type: inferred if unknown, else gated by schema and by
        every constraint, with all violations reported."""
        if name not in self.registry.types:
            t = infer_type(name, df.schema, identity)
            if t.table not in self.catalog.current().tables:
                self.catalog.create(t.table, t.schema(), identity=identity)
            self.registry.define_type(t)
        t = self.registry.type(name)
        bad = bind_violations(t, df.schema)
        if bad:
            raise Validation(*bad)
        counts = [r for r in violation_counts(t, df).collect() if r["violations"]]  # a row for each rule
        if counts:
            raise Validation(*[f"{r['rule']}: {r['violations']} rows" for r in counts])
        if t.table not in self.catalog.current().tables:
            self.catalog.create(t.table, t.schema(), identity=t.identity)
        return self.land(t.table, df.select(t.names), mode=mode)

    def define_view(self, name: str, base: str, predicate: str, columns: list[str]) -> None:
        """A subset of rows and columns of one base table; no view of a view."""
        if name in self.views or base in self.views:
            raise Validation(f"{name} exists or {base} is a view")
        have = self.table(base).columns
        if not set(columns) <= set(have):
            raise Validation(*[f"{base} has no column {c}" for c in columns if c not in have])
        self.table(base).where(F.expr(predicate))
        self.views[name] = (base, predicate, columns)

    def views_of(self, subject: str) -> list[str]:
        return sorted(v for v in self.views if self.acl.allowed(subject, v))

    def delete_view(self, name: str) -> None:
        if name not in self.views:
            raise NotFound(f"view {name}")
        del self.views[name]

    def save_model(self) -> int:
        """Types, links, indexes, actions and views as state of the catalog."""
        model = {**self.registry.to_dict(), "views": {n: list(v) for n, v in self.views.items()}}
        return self.catalog.commit(lambda tx: tx.state.update(model=json.loads(json.dumps(model))))

    def load_model(self) -> None:
        """What save_model kept last, in place of what is defined here."""
        now = self.catalog.current()
        model = self.catalog._version(now.id)["state"].get("model") if now.id else None
        if model is None:
            raise NotFound("no model is kept")
        new = Registry.from_dict(model)
        self.registry.__dict__.update(new.__dict__)
        self.views = {n: tuple(v) for n, v in model["views"].items()}

    # --- vector indexes

    def build_index(self, type_name: str, index: str) -> dict:
        """Builds a type's index at the current snapshot and keeps it."""
        return search.IndexStore(self.ctx).build(type_name, index)

    # --- metadata

    def types(self, subject: str) -> list[str]:
        """The types that the subject may read."""
        return sorted(t for t in self.registry.types if self.acl.allowed(subject, t))

    def readable(self, subject: str, table: str) -> bool:
        return self.acl.allowed(subject, table) or any(self.acl.allowed(subject, t.name) for t in self.registry.types.values() if t.table == table)

    def datasets(self, subject: str, sort: str = "name", descending: bool = False) -> list[dict]:
        """Tables and views that the subject may read, by name, project, updated or rows."""
        out = []
        now = self.catalog.current() if self.catalog else None
        for table in sorted({*self.tables, *(now.tables if now else ())}):
            if self.readable(subject, table):
                at = now.tables.get(table) if now else None
                schema, _, bare = table.rpartition(".")
                out.append({"schema": schema, "name": bare, "project": schema, "updated": self.catalog._version(at)["time"] if at else 0.0, "rows": self.catalog.row_count(table, now) if at else None})
        out += [{"schema": "", "name": v, "project": "", "updated": 0.0, "rows": None} for v in sorted(self.views) if self.acl.allowed(subject, v)]
        if sort not in ("name", "project", "updated", "rows"):
            raise Validation(f"unknown sort key {sort}")
        out.sort(key=lambda d: (d["schema"], d["name"]))
        return sorted(out, key=lambda d: (d[sort] is None, d[sort] if d[sort] is not None else 0), reverse=descending)

    def preview(self, subject: str, name: str, filters: dict[str, str] | None = None, limit: int = 20) -> DataFrame:
        return read.select(self.ctx, subject, name, filters=filters, limit=limit)

    def type_detail(self, name: str) -> dict:
        t: ObjectType = self.registry.type(name)
        return {"type": t, "links": self.registry.links_of(name), "derived": t.derived, "indexes": [i for (n, _), i in self.registry.indexes.items() if n == name]}
