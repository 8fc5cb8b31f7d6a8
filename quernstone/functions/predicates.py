"""The callers' predicate grammar, `op:operand`, as conditions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, functions as F

from ..acl import comparison
from ..errors import BadFilter
from ..types import base, dimension, parse_literal

# The operators' names.
SCALAR = ("eq", "ne", "lt", "le", "gt", "ge")
SETS = ("in", "nin")
NULLS = ("isnull", "isnotnull")
TEXT = ("contains", "startswith", "endswith")
OPS = SCALAR + SETS + NULLS + TEXT + ("between",)


@dataclass(frozen=True)
class Predicate:
    column: str
    op: str
    values: tuple = ()

    def condition(self, column=F.col) -> Column:
        c = column(self.column)
        if self.op in TEXT:
            return c.ilike(pattern_of(self.op, self.values[0]))
        if self.op == "between":
            return (c >= F.lit(self.values[0])) & (c <= F.lit(self.values[1]))
        if self.op in SETS:
            return comparison(c, self.op, self.values)
        return comparison(c, self.op, self.values[0] if self.values else None)


def pattern_of(op: str, operand: str) -> str:
    """An ILIKE pattern in which the operand's own wildcards are literal."""
    own = operand.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return ("" if op == "startswith" else "%") + own + ("" if op == "endswith" else "%")


def split_set(operand: str) -> list[str]:
    """Parts between commas; a backslash escapes a comma or itself, nothing else."""
    if operand == "":
        raise BadFilter("a set needs a value")
    out, now, i = [], "", 0
    while i < len(operand):
        ch = operand[i]
        if ch == "\\":
            if i + 1 >= len(operand) or operand[i + 1] not in "\\,":
                raise BadFilter(f"bad escape in {operand!r}")
            now += operand[i + 1]
            i += 2
            continue
        if ch == ",":
            out.append(now)
            now = ""
        else:
            now += ch
        i += 1
    return [*out, now]


def parse(column: str, text: str, logical: str) -> Predicate:
    """`op:operand`; without a known operator the whole text is an eq operand."""
    if dimension(logical) is not None:
        raise BadFilter(f"{column} is a vector")
    head, colon, rest = text.partition(":")
    op, operand = (head, rest) if colon and head in OPS else (text, "") if text in NULLS else ("eq", text)

    def value(x: str):
        try:
            return parse_literal(x, logical)
        except ValueError as e:
            raise BadFilter(f"{column}: {e}") from None

    if op in NULLS:
        if operand:
            raise BadFilter(f"{op} takes no operand")
        return Predicate(column, op)
    if op in TEXT:
        if base(logical) != "string":
            raise BadFilter(f"{op} needs a string, {column} is {logical}")
        return Predicate(column, op, (operand,))
    if op in SETS:
        return Predicate(column, op, tuple(value(x) for x in split_set(operand)))
    if op == "between":
        parts = split_set(operand)
        if len(parts) != 2:
            raise BadFilter("between needs two values")
        return Predicate(column, op, tuple(value(x) for x in parts))
    if base(logical) == "boolean" and op not in ("eq", "ne"):
        raise BadFilter(f"{op} doesn't order booleans")
    return Predicate(column, op, (value(operand),))


def parse_visible(column: str, text: str, visible: dict[str, str]) -> Predicate:
    """Visibility comes before the value is even looked at."""
    if column not in visible:
        raise BadFilter(f"{column} can't be filtered on")
    return parse(column, text, visible[column])


def parse_or(members: list[str], visible: dict[str, str]) -> list[Predicate]:
    """The members `column:op:rest` of a disjunction, two at least."""
    if len(members) < 2:
        raise BadFilter("an or-group needs two members")
    out = []
    for m in members:
        column, colon, rest = m.partition(":")
        if not colon:
            raise BadFilter(f"{m!r} is no column:op:operand")
        out.append(parse_visible(column, rest, visible))
    return out


def any_of(members: list[Predicate], column=F.col) -> Column:
    return reduce(lambda a, b: a | b, [m.condition(column) for m in members])


def split_params(params: list[tuple[str, str]], route: set[str]) -> tuple[dict[str, str], dict[str, str]]:
    """(reserved, filters): names that start with _ and the route's own are
    reserved; of equal names the last value wins."""
    reserved, filters = {}, {}
    for k, v in params:
        (reserved if k.startswith("_") or k in route else filters)[k] = v
    return reserved, filters
