"""Deny-by-default access: roles that inherit, grants, and policies with row
filters, denied and masked columns."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, functions as F

from .errors import Conflict, Forbidden, Validation

MASK = "***"
SCALAR_OPS = ("eq", "ne", "lt", "le", "gt", "ge")
LIST_OPS = ("in", "nin")
NULL_OPS = ("isnull", "isnotnull")


@dataclass(frozen=True)
class Compare:
    column: str
    op: str
    value: object = None


@dataclass(frozen=True)
class And:
    parts: tuple


@dataclass(frozen=True)
class Or:
    parts: tuple


@dataclass(frozen=True)
class Not:
    part: object


def validate_filter(f, columns: set[str] | None = None) -> None:
    """Lists for in and nin, scalars for the rest, operators of policies only."""
    if isinstance(f, (And, Or)):
        for p in f.parts:
            validate_filter(p, columns)
    elif isinstance(f, Not):
        validate_filter(f.part, columns)
    elif isinstance(f, Compare):
        if columns is not None and f.column not in columns:
            raise Validation(f"row filter on unknown column {f.column}")
        values = f.value if isinstance(f.value, (list, tuple)) else [f.value]
        if f.op in LIST_OPS and not isinstance(f.value, (list, tuple)):
            raise Validation(f"{f.op} needs a list")
        if f.op in SCALAR_OPS and (isinstance(f.value, (list, tuple)) or f.value is None):
            raise Validation(f"{f.op} needs a scalar")
        if f.op not in SCALAR_OPS + LIST_OPS + NULL_OPS:
            raise Validation(f"{f.op} is no operator of a row filter")
        if f.op not in NULL_OPS and not all(isinstance(v, (str, int, bool)) for v in values):
            raise Validation("row filters compare with text, integers and booleans")
    else:
        raise Validation(f"{f!r} is no row filter")


def comparison(c: Column, op: str, value=None) -> Column:
    """SQL's three-valued comparison; an empty list is in nothing."""
    if op == "isnull":
        return c.isNull()
    if op == "isnotnull":
        return c.isNotNull()
    if op == "in":
        return c.isin(list(value)) if value else F.lit(False)
    if op == "nin":
        return ~c.isin(list(value)) if value else F.lit(True)
    v = F.lit(value)
    return {"eq": c == v, "ne": c != v, "lt": c < v, "le": c <= v, "gt": c > v, "ge": c >= v}[op]


def compile_filter(f, column=F.col) -> Column:
    """The row filter as a condition; no parts: And is true, Or is false."""
    if isinstance(f, And):
        return reduce(lambda a, b: a & b, [compile_filter(p, column) for p in f.parts], F.lit(True))
    if isinstance(f, Or):
        return reduce(lambda a, b: a | b, [compile_filter(p, column) for p in f.parts], F.lit(False))
    if isinstance(f, Not):
        return ~compile_filter(f.part, column)
    return comparison(column(f.column), f.op, f.value)


def holds(f, row: dict) -> bool | None:
    """The same over one row in Python: True, False, or None for unknown."""
    if isinstance(f, (And, Or)):
        got = [holds(p, row) for p in f.parts]
        stop = isinstance(f, Or)
        return stop if stop in got else None if None in got else not stop
    if isinstance(f, Not):
        got = holds(f.part, row)
        return None if got is None else not got
    v = row.get(f.column)
    if f.op in NULL_OPS:
        return (v is None) == (f.op == "isnull")
    if v is None:
        return None
    alike = lambda a, b: isinstance(a, bool) == isinstance(b, bool) and isinstance(a, str) == isinstance(b, str)
    if f.op in LIST_OPS:
        if any(alike(v, x) and v == x for x in f.value):
            return f.op == "in"
        return (f.op == "nin") if all(alike(v, x) for x in f.value) else None
    if not alike(v, f.value):
        return None
    x = f.value
    return {"eq": v == x, "ne": v != x, "lt": v < x, "le": v <= x, "gt": v > x, "ge": v >= x}[f.op]


@dataclass(frozen=True)
class Policy:
    """What holds for a resource: row filters are anded, the rest united."""

    row_filters: tuple = ()
    deny: frozenset = frozenset()
    mask: frozenset = frozenset()

    def union(self, other: Policy) -> Policy:
        return Policy(self.row_filters + other.row_filters, self.deny | other.deny, self.mask | other.mask)

    def condition(self, column=F.col) -> Column:
        return compile_filter(And(self.row_filters), column)


@dataclass
class Acl:
    """Resources are names of types, views and tables; actions are read, write."""

    inherits: dict[str, set[str]] = field(default_factory=dict)
    members: dict[str, set[str]] = field(default_factory=dict)
    grants: dict[tuple[str, str, str], str] = field(default_factory=dict)
    policies: dict[tuple[str, str], Policy] = field(default_factory=dict)

    def add_role(self, role: str, *parents: str) -> None:
        for p in parents:
            if role in self.closure({p}):
                raise Conflict(f"role {role} would inherit from itself")
        self.inherits.setdefault(role, set()).update(parents)

    def closure(self, roles: set[str]) -> set[str]:
        out, todo = set(), list(roles)
        while todo:
            r = todo.pop()
            if r not in out:
                out.add(r)
                todo += self.inherits.get(r, ())
        return out

    def assign(self, subject: str, *roles: str) -> None:
        self.members.setdefault(subject, set()).update(roles)

    def roles_of(self, subject: str) -> set[str]:
        return self.closure(self.members.get(subject, set()))

    def grant(self, role: str, resource: str, action: str = "read", effect: str = "allow") -> None:
        if effect not in ("allow", "deny"):
            raise Validation(f"unknown effect {effect}")
        self.grants[role, resource, action] = effect

    def set_policy(self, role: str, resource: str, policy: Policy) -> None:
        for f in policy.row_filters:
            validate_filter(f)
        self.policies[role, resource] = policy

    def allowed(self, subject: str, resource: str, action: str = "read") -> bool:
        """Some role allows it and none denies it."""
        effects = {self.grants.get((r, resource, action)) for r in self.roles_of(subject)}
        return "allow" in effects and "deny" not in effects

    def check(self, subject: str, resource: str, action: str = "read") -> None:
        if not self.allowed(subject, resource, action):
            raise Forbidden(f"{subject} may not {action} {resource}")

    def policy(self, subject: str, resource: str) -> Policy:
        out = Policy()
        for r in sorted(self.roles_of(subject)):
            if (r, resource) in self.policies:
                out = out.union(self.policies[r, resource])
        return out
