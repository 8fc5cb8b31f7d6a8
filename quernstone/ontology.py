"""Object types, links, derived properties, constraints, actions and vector
indexes, and the registry that checks and keeps them."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field, replace
from pathlib import Path

from pyspark.sql import types as T

from . import types as L
from .errors import AmbiguousLink, Conflict, NotFound, UnknownLink, UnknownType, Validation

CONSTRAINTS = {"range": ("integer", "long", "double"), "length": ("string",), "pattern": ("string",), "one_of": ("string",)}


@dataclass(frozen=True)
class Constraint:
    """kind: range (min, max), length (min, max), pattern (found anywhere) or one_of."""

    kind: str
    min: float | None = None
    max: float | None = None
    pattern: str | None = None
    values: tuple[str, ...] = ()


@dataclass(frozen=True)
class Property:
    name: str
    type: str
    required: bool = False
    constraints: tuple[Constraint, ...] = ()


@dataclass(frozen=True)
class Derived:
    """fn (count, sum, avg, min, max) of column over a link's target."""

    name: str
    fn: str
    link: str
    column: str | None = None


@dataclass(frozen=True)
class ObjectType:
    """unique: no two rows of the table have one identity (else traversal keeps
    one of them)."""

    name: str
    table: str
    properties: tuple[Property, ...]
    identity: str | None = None
    derived: tuple[Derived, ...] = ()
    version: str | None = None
    unique: bool = True

    def prop(self, name: str) -> Property | None:
        return next((p for p in self.properties if p.name == name), None)

    @property
    def names(self) -> list[str]:
        return [p.name for p in self.properties]

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(p.name, L.spark_type(p.type), not p.required) for p in self.properties])


@dataclass(frozen=True)
class Link:
    """source.from_column = target.to_column; with a join table, source.from_column
    = join_from and join_to = target.to_column."""

    name: str
    source: str
    target: str
    from_column: str
    to_column: str
    join_table: str | None = None
    join_from: str | None = None
    join_to: str | None = None
    cardinality: str = "many"

    def inverse(self) -> Link:
        return replace(self, source=self.target, target=self.source, from_column=self.to_column, to_column=self.from_column, join_from=self.join_to, join_to=self.join_from)


@dataclass(frozen=True)
class VectorIndex:
    name: str
    type: str
    property: str
    metric: str = "cosine"
    kind: str = "flat"
    nlist: int | None = None
    m: int = 16
    ef_construction: int = 200


def infer_type(name: str, schema: T.StructType, identity: str | None = None, dims: dict[str, int] | None = None) -> ObjectType:
    """An object type of a schema, bound to table main.<name>; its identity is required."""
    props = tuple(Property(f.name, L.logical_of(f.dataType, (dims or {}).get(f.name)), not f.nullable or f.name == identity) for f in schema.fields)
    return ObjectType(name, f"main.{name}", props, identity)


def type_violations(t: ObjectType) -> list[str]:
    """Everything that is wrong with a declared type by itself."""
    out = []
    seen = set()
    for p in t.properties:
        if p.name in seen:
            out.append(f"property {p.name} is declared twice")
        seen.add(p.name)
        if p.name.startswith("_"):
            out.append(f"property {p.name}: names that start with _ are reserved")
        try:
            b = L.base(p.type)
        except Validation as e:
            out.append(f"property {p.name}: {e}")
            continue
        for c in p.constraints:
            if c.kind not in CONSTRAINTS:
                out.append(f"property {p.name}: unknown constraint {c.kind}")
            elif b not in CONSTRAINTS[c.kind]:
                out.append(f"property {p.name}: {c.kind} doesn't apply to {b}")
            elif c.kind == "pattern":
                try:
                    re.compile(c.pattern or "")
                except re.error as e:
                    out.append(f"property {p.name}: bad pattern ({e})")
            elif c.min is not None and c.max is not None and c.min > c.max:
                out.append(f"property {p.name}: {c.kind} is empty")
    if t.identity is not None and t.identity not in seen:
        out.append(f"identity {t.identity} is no property")
    if t.version is not None:
        p = t.prop(t.version)
        if p is None:
            out.append(f"version {t.version} is no property")
        elif not L.version_orderable(p.type):
            out.append(f"version {t.version} can't be ordered by")
    for d in t.derived:
        if d.name in seen:
            out.append(f"derived {d.name} has a property's name")
        if d.fn not in ("count", "sum", "avg", "min", "max"):
            out.append(f"derived {d.name}: unknown function {d.fn}")
        if d.fn != "count" and not d.column:
            out.append(f"derived {d.name}: {d.fn} needs a column")
    return out


def bind_violations(t: ObjectType, schema: T.StructType) -> list[str]:
    """Why a type can't be bound to a table of that schema; all reasons."""
    out = type_violations(t)
    have = {f.name: f for f in schema.fields}
    for p in t.properties:
        f = have.get(p.name)
        if f is None:
            out.append(f"column {p.name} is missing")
        elif not L.satisfies(f.dataType, p.type):
            out.append(f"column {p.name} is {f.dataType.simpleString()}, not {p.type}")
    return out


def conformance_violations(t: ObjectType, schema: T.StructType) -> list[str]:
    """Exact conformance of a result: missing, extra, mistyped, nullable where required."""
    out = []
    have = {f.name: f for f in schema.fields}
    for p in t.properties:
        f = have.pop(p.name, None)
        if f is None:
            out.append(f"missing column {p.name}")
        elif not L.satisfies(f.dataType, p.type):
            out.append(f"column {p.name} is {f.dataType.simpleString()}, not {p.type}")
        elif p.required and f.nullable:
            out.append(f"column {p.name} may be null")
    return out + [f"extra column {n}" for n in have]


@dataclass
class Registry:
    types: dict[str, ObjectType] = field(default_factory=dict)
    links: list[Link] = field(default_factory=list)
    indexes: dict[tuple[str, str], VectorIndex] = field(default_factory=dict)
    actions: dict[str, object] = field(default_factory=dict)

    def define_type(self, t: ObjectType, schema: T.StructType | None = None) -> None:
        bad = bind_violations(t, schema) if schema is not None else type_violations(t)
        if bad:
            raise Validation(*bad)
        self.types[t.name] = t

    def type(self, name: str) -> ObjectType:
        if name not in self.types:
            raise UnknownType(name)
        return self.types[name]

    def delete_type(self, name: str) -> None:
        self.type(name)
        if any(name in (x.source, x.target) for x in self.links):
            raise Conflict(f"links refer to {name}")
        del self.types[name]

    def define_link(self, link: Link, join_schema: T.StructType | None = None) -> None:
        out = []
        for end, column in ((link.source, link.from_column), (link.target, link.to_column)):
            t = self.types.get(end)
            if t is None:
                out.append(f"unknown type {end}")
            elif t.prop(column) is None:
                out.append(f"{end} has no property {column}")
        if link.join_table is not None:
            if not (link.join_from and link.join_to):
                out.append("a join table needs join_from and join_to")
            elif join_schema is not None:
                out += [f"{link.join_table} has no column {c}" for c in (link.join_from, link.join_to) if c not in join_schema.names]
        if any(x.name == link.name and x.source == link.source for x in self.links):
            out.append(f"{link.source} has a link {link.name}")
        if out:
            raise Validation(*out)
        self.links.append(link)

    def link(self, source: str, name: str) -> Link:
        """The outbound link, or with ~ before the name the only inbound one, inverted."""
        if name.startswith("~"):
            found = [x for x in self.links if x.target == source and x.name == name[1:]]
            if len(found) > 1:
                raise AmbiguousLink(f"{len(found)} links {name[1:]} lead to {source}")
            if not found:
                raise UnknownLink(f"no link {name[1:]} leads to {source}")
            return found[0].inverse()
        for x in self.links:
            if x.source == source and x.name == name:
                return x
        raise UnknownLink(f"{source} has no link {name}")

    def links_of(self, name: str) -> list[tuple[str, Link]]:
        """Outbound links, then inbound ones with ~ before the name."""
        return [(x.name, x) for x in self.links if x.source == name] + [("~" + x.name, x.inverse()) for x in self.links if x.target == name]

    def define_index(self, index: VectorIndex) -> None:
        p = self.type(index.type).prop(index.property)
        if p is None or L.dimension(p.type) is None:
            raise Validation(f"{index.type}.{index.property} is no vector")
        if index.metric not in ("cosine", "l2") or index.kind not in ("flat", "ivf_flat", "hnsw"):
            raise Validation(f"unknown metric {index.metric} or kind {index.kind}")
        self.indexes[index.type, index.name] = index

    def delete_link(self, source: str, name: str) -> None:
        self.links.remove(self.link(source, name))

    def delete_index(self, kind: str, name: str) -> None:
        if (kind, name) not in self.indexes:
            raise NotFound(f"{kind} has no index {name}")
        del self.indexes[kind, name]

    def delete_action(self, name: str) -> None:
        self.action(name)
        del self.actions[name]

    def define_action(self, action) -> None:
        self.actions[action.name] = action

    def action(self, name: str):
        if name not in self.actions:
            raise NotFound(f"action {name}")
        return self.actions[name]

    def typed_tables(self) -> dict[str, ObjectType]:
        """Table name to the first type bound to it."""
        out: dict[str, ObjectType] = {}
        for t in self.types.values():
            out.setdefault(t.table, t)
        return out

    def to_dict(self) -> dict:
        return {"types": [asdict(t) for t in self.types.values()], "links": [asdict(x) for x in self.links], "indexes": [asdict(i) for i in self.indexes.values()], "actions": [asdict(a) for a in self.actions.values()]}

    @classmethod
    def from_dict(cls, raw: dict) -> Registry:
        from .actions import Action, Assign, Step

        out = cls()
        for t in raw["types"]:
            props = tuple(Property(**p | {"constraints": tuple(Constraint(**c | {"values": tuple(c["values"])}) for c in p["constraints"])}) for p in t["properties"])
            out.define_type(ObjectType(**t | {"properties": props, "derived": tuple(Derived(**d) for d in t["derived"])}))
        for x in raw["links"]:
            out.define_link(Link(**x))
        for i in raw["indexes"]:
            out.define_index(VectorIndex(**i))
        for a in raw.get("actions", []):
            steps = tuple(Step(**s | {"binds": tuple(map(tuple, s["binds"])), "assigns": tuple(Assign(**x) for x in s["assigns"])}) for s in a["steps"])
            out.define_action(Action(**a | {"params": {k: tuple(v) for k, v in a["params"].items()}, "steps": steps, "jobs": tuple((n, args) for n, args in a["jobs"])}))
        return out

    def save(self, path: str) -> None:
        """As a local file; an engine keeps it in its catalog (save_model)."""
        Path(path).write_text(json.dumps(self.to_dict(), indent=1))

    @classmethod
    def load(cls, path: str) -> Registry:
        return cls.from_dict(json.loads(Path(path).read_text()))
