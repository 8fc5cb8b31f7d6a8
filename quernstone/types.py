"""The closed vocabulary of logical types and its Spark types."""

from __future__ import annotations

import datetime as dt
import math
import re

from pyspark.sql import types as T

from .errors import Validation

# The vocabulary and its aliases (case-insensitive).
SCALARS = {
    "integer": T.IntegerType(),
    "long": T.LongType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "string": T.StringType(),
    "date": T.DateType(),
    "timestamp": T.TimestampNTZType(),
}
ALIASES = {"emailaddress": "string", "url": "string", "phonenumber": "string"}
_VECTOR = re.compile(r"^vector\((\d+)\)$")
_INT_RANGE = {"integer": 31, "long": 63}


def base(name: str) -> str:
    """The canonical logical type, or an error: there are no unknown types."""
    k = name.strip().lower()
    k = ALIASES.get(k, k)
    if k in SCALARS:
        return k
    m = _VECTOR.match(k.replace(" ", ""))
    if m and int(m[1]) > 0:
        return f"vector({int(m[1])})"
    raise Validation(f"unknown logical type {name!r}")


def dimension(name: str) -> int | None:
    m = _VECTOR.match(base(name))
    return int(m[1]) if m else None


def numeric(name: str) -> bool:
    return base(name) in ("integer", "long", "double")


def ordered(name: str) -> bool:
    return base(name) in SCALARS and base(name) != "boolean"


def version_orderable(name: str) -> bool:
    return base(name) in ("integer", "long", "timestamp")


def spark_type(name: str) -> T.DataType:
    b = base(name)
    return SCALARS.get(b) or T.ArrayType(T.FloatType(), containsNull=False)


def logical_of(kind: T.DataType, dim: int | None = None) -> str:
    """The logical type of a Spark type; types outside the vocabulary are refused."""
    if isinstance(kind, T.TimestampType):
        return "timestamp"
    for name, t in SCALARS.items():
        if type(t) is type(kind):
            return name
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) and dim:
        return f"vector({dim})"
    raise Validation(f"no logical type for {kind.simpleString()}")


def satisfies(kind: T.DataType, name: str) -> bool:
    """Exactly the declared type: there is no implicit widening."""
    want = spark_type(name)
    if isinstance(want, T.ArrayType):
        return isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    if base(name) == "timestamp":
        return isinstance(kind, (T.TimestampNTZType, T.TimestampType))
    return type(kind) is type(want)


def parse_literal(text: str, name: str):
    """A caller's operand as a value of the logical type; raises ValueError."""
    b = base(name)
    if b in _INT_RANGE:
        if not re.fullmatch(r"[+-]?\d+", text):
            raise ValueError(f"{text!r} is no {b}")
        v = int(text)
        if not -(1 << _INT_RANGE[b]) <= v < 1 << _INT_RANGE[b]:
            raise ValueError(f"{text} is out of range for {b}")
        return v
    if b == "double":
        v = float(text)
        if math.isnan(v):
            raise ValueError("NaN is no operand")
        return v
    if b == "boolean":
        if text not in ("true", "false"):
            raise ValueError(f"{text!r} is no boolean")
        return text == "true"
    if b == "string":
        return text
    if b == "date":
        if not re.fullmatch(r"\d{4}-\d\d-\d\d", text):
            raise ValueError(f"{text!r} is no ISO date")
        return dt.date.fromisoformat(text)
    if b == "timestamp":
        if not re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d(:\d\d(\.\d{1,6})?)?", text):
            raise ValueError(f"{text!r} is no ISO timestamp")
        return dt.datetime.fromisoformat(text)
    raise ValueError("vectors can't be filtered on")


def render(value, name: str | None):
    """A value as JSON clients get it: long as text, times as ISO text."""
    if value is None:
        return None
    b = base(name) if name else None
    if b == "long" and isinstance(value, int) and not isinstance(value, bool):
        return str(value)
    if isinstance(value, dt.datetime):
        return value.isoformat(timespec="microseconds" if value.microsecond else "seconds")
    if isinstance(value, dt.date):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return [render(v, None) for v in value]
    return value
