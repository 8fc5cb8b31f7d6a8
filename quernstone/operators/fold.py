"""Merge folds, framing and feeds of change streams.

Framing columns stand after the user's: kind (+I, -U, +U, -D), bucket, offset.
Folds rank first and drop deleted winners after, as a delete that is filtered
out before would bring older rows back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..errors import Validation
from ..sources.scratch import cut

KIND, BUCKET, OFFSET = "_chg_kind", "_chg_bucket", "_chg_offset"
FRAME = (KIND, BUCKET, OFFSET)
ENGINES = ("last_row", "first_row", "versioned")


def strip(df: DataFrame) -> DataFrame:
    """User columns only."""
    return df.drop(*FRAME)


def fold(df: DataFrame, identity: str, engine: str = "last_row", version: str | None = None, kind: str = KIND, offset: str = OFFSET) -> DataFrame:
    """The live row of each identity.  last_row: greatest offset; first_row:
    least; versioned: greatest version (nulls last), then offset.  Images before
    an update don't count.  An aggregate picks the winner, so each task sends a
    row for each identity and no hot identity meets in one task."""
    if engine not in ENGINES:
        raise Validation(f"unknown merge engine {engine}")
    # nulls are least in a struct's order
    order = F.struct(F.col(version) if engine == "versioned" and version else F.lit(0), F.col(offset))
    pick = F.min_by if engine == "first_row" else F.max_by
    rows = df.where(F.col(kind) != "-U")
    won = rows.groupBy(F.col(identity).alias("_id")).agg(pick(F.struct(*df.columns), order).alias("_row"))
    return _winners(won, df.columns, identity).where(F.col(kind) != "-D")


def _winners(won: DataFrame, columns: list[str], identity: str) -> DataFrame:
    """The winning rows; the identity is the key itself, so conditions on it reach the scans."""
    return won.select([(F.col("_id") if c == identity else F.col(f"_row.{c}")).alias(c) for c in columns])


def precedence_fold(df: DataFrame, identity: str, kind: str = KIND, prec: str = "_prec") -> DataFrame:
    """The row of greatest precedence of each identity (of equal ones that of the
    greatest hash of all columns, so any order of reading gives the same); a
    tombstone hides it."""
    won = df.groupBy(F.col(identity).alias("_id")).agg(F.max_by(F.struct(*df.columns), F.struct(F.col(prec), F.xxhash64(*df.columns))).alias("_row"))
    return _winners(won, df.columns, identity).where(F.col(kind) != "-D").drop(kind, prec)


def ordinal(df: DataFrame, order: list, name: str = "_n") -> DataFrame:
    """df with the rows' numbers from 0 in a total order.  Rows are dealt by
    range and numbered in their parts; the parts' first numbers, one for each
    part, go to all tasks."""
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order)
    marked = cut(parts.select("*", F.monotonically_increasing_id().alias("_m")))
    part, own = F.shiftright("_m", 33), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    counts = marked.groupBy(part.alias("_p")).agg(F.count("*").alias("_c"))
    first = counts.select("_p", (F.sum("_c").over(Window.orderBy("_p")) - F.col("_c")).alias("_f"))
    return marked.withColumn("_p", part).join(F.broadcast(first), "_p").withColumn(name, F.col("_f") + own).drop("_m", "_p", "_f")


def frame_log(df: DataFrame, buckets: int, order: list, base: dict[int, int] | None = None) -> DataFrame:
    """Appended rows with bucket = ordinal modulo buckets and gapless offsets."""
    rows = ordinal(df, order).withColumn(BUCKET, (F.col("_n") % buckets).cast("int"))
    start = F.lit(0)
    for b, first in (base or {}).items():
        start = F.when(F.col(BUCKET) == b, F.lit(first)).otherwise(start)
    return rows.withColumn(KIND, F.lit("+I")).withColumn(OFFSET, (start + F.floor(F.col("_n") / buckets)).cast("long")).drop("_n").select(*df.columns, *FRAME)


def cdc_bucket(identity: Column, buckets: int) -> Column:
    """One bucket holds all of an identity's history."""
    return F.pmod(F.xxhash64(identity), F.lit(buckets)).cast("int")


def emit_cdc(before: DataFrame, after: DataFrame, identity: str) -> DataFrame:
    """Change events from a table before and after: +I, adjacent -U and +U, -D
    with the full prior image; unchanged rows give none.  _step orders a pair."""
    cols = before.columns
    a, b = F.struct(*cols).alias("old"), F.struct(*cols).alias("new")
    both = before.select(F.col(identity).alias("_id"), a).join(after.select(F.col(identity).alias("_id"), b), "_id", "full_outer")
    event = lambda kind, image, step: F.struct(F.lit(kind).alias(KIND), F.lit(step).alias("_step"), F.col(image).alias("row"))
    events = (
        F.when(F.col("old").isNull(), F.array(event("+I", "new", 0)))
        .when(F.col("new").isNull(), F.array(event("-D", "old", 0)))
        .when(~F.col("old").eqNullSafe(F.col("new")), F.array(event("-U", "old", 0), event("+U", "new", 1)))
    )
    out = both.select(F.explode(events).alias("e"))
    return out.select(*[F.col(f"e.row.{c}").alias(c) for c in cols], f"e.{KIND}", "e._step")


def feed(df: DataFrame, positions: dict[int, int], limit: int | None = None, bucket: str = BUCKET, offset: str = OFFSET) -> DataFrame:
    """Events from the next offset of each bucket on, in bucket and offset order."""
    if not positions:
        return df.limit(0)
    due = reduce(lambda a, b: a | b, [(F.col(bucket) == b) & (F.col(offset) >= p) for b, p in positions.items()])
    out = df.where(due).orderBy(bucket, offset)
    return out.limit(limit) if limit is not None else out


def bounds(df: DataFrame, bucket: str = BUCKET, offset: str = OFFSET) -> DataFrame:
    """Least and greatest offset of each bucket."""
    return df.groupBy(bucket).agg(F.min(offset).alias("first_offset"), F.max(offset).alias("last_offset"))


def lookup_join(delta: DataFrame, state: DataFrame, keys: dict[str, str], how: str = "inner", prefilter: bool = True) -> DataFrame:
    """A delta joined with a table's folded state; with prefilter only the
    delta's keys of the state take part."""
    if prefilter:
        own = delta.select([F.col(a).alias(f"_k{i}") for i, a in enumerate(keys)]).distinct()
        cond = reduce(lambda a, b: a & b, [F.col(b) == F.col(f"_k{i}") for i, b in enumerate(keys.values())])
        state = state.join(own, cond, "left_semi")
    on = reduce(lambda a, b: a & b, [delta[a] == state[b] for a, b in keys.items()])
    return delta.join(state, on, how)
