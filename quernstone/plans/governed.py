"""The one place where access rules meet data: every plan starts here."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..acl import MASK, Acl, Policy
from ..errors import BadFilter, Forbidden, NoIdentity
from ..functions import predicates as P
from ..ontology import ObjectType, Registry

DEFAULT_LIMIT = 1000
SMALL_SET = 1000


@dataclass
class Context:
    """table: name and snapshot (None: the current one) to its DataFrame; catalog:
    where kept indexes are, if there is one."""

    spark: SparkSession
    registry: Registry
    acl: Acl
    table: Callable[[str, object], DataFrame]
    catalog: object = None


@dataclass
class Governed:
    """A readable type: its rows with all raw columns, row filters applied."""

    type: ObjectType
    raw: DataFrame
    policy: Policy
    visible: list[str] = field(default_factory=list)

    @property
    def filterable(self) -> dict[str, str]:
        """Columns a caller may filter on: visible and unmasked."""
        return {p.name: p.type for p in self.type.properties if p.name in self.visible and p.name not in self.policy.mask}

    def show(self, column: str) -> Column:
        """The column as a caller sees it."""
        return F.lit(MASK).alias(column) if column in self.policy.mask else F.col(column)

    def projection(self) -> list[Column]:
        return [self.show(c) for c in self.visible]

    def identity(self) -> str:
        """The identity, which must be visible unmasked."""
        i = self.type.identity
        if i is None or i not in self.filterable:
            raise NoIdentity(f"{self.type.name} has no visible identity")
        return i

    def where(self, filters: dict[str, str] | None = None, ids: list | None = None, any_of: list[list[str]] | None = None) -> DataFrame:
        """raw under the caller's predicates, ids and or-groups, all anded."""
        out = self.raw
        for column, text in (filters or {}).items():
            out = out.where(P.parse_visible(column, text, self.filterable).condition())
        if ids is not None:
            out = keep_ids(out, self.identity(), self.filterable[self.identity()], ids)
        for group in any_of or []:
            out = out.where(P.any_of(P.parse_or(group, self.filterable)))
        return out


def keep_ids(df: DataFrame, column: str, logical: str, ids: list) -> DataFrame:
    """Rows of an object set: a list in the condition while small, else a semi-join."""
    try:
        values = [P.parse_literal(str(i), logical) for i in ids]
    except ValueError as e:
        raise BadFilter(str(e)) from None
    if len(values) <= SMALL_SET:
        return df.where(F.col(column).isin(values))
    kind = df.schema[column].dataType.simpleString()
    wanted = df.sparkSession.createDataFrame([(v,) for v in set(values)], f"{column} {kind}")
    return df.join(wanted, column, "left_semi")


def governed(ctx: Context, subject: str, name: str, at=None) -> Governed:
    """Access is checked before it shows whether the type exists."""
    ctx.acl.check(subject, name)
    t = ctx.registry.type(name)
    policy = ctx.acl.policy(subject, name)
    visible = [c for c in t.names if c not in policy.deny]
    if not visible:
        raise Forbidden(f"no column of {name} is readable")
    full = ctx.table(t.table, at)
    have = set(full.columns)
    raw = full.select([F.col(p.name) if p.name in have else F.lit(None).cast(t.schema()[p.name].dataType).alias(p.name) for p in t.properties])
    if policy.row_filters:
        raw = raw.where(policy.condition())
    return Governed(t, raw, policy, visible)
