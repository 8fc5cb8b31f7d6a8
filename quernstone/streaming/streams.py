"""Log and change streams on the catalog, their feeds, and micro-batch views.

A stream's table keeps framing columns behind the user's.  Offsets are gapless
for each bucket; the next ones are state of the catalog, so an append and its
offsets are one commit.  A view's output and its consumed offsets are one
commit too, which makes it exactly-once whatever is tried again."""

from __future__ import annotations

import base64
import json
import time

from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from ..errors import Conflict, NotFound, Validation
from ..operators.fold import BUCKET, ENGINES, FRAME, KIND, OFFSET, cdc_bucket, emit_cdc, feed, fold, frame_log, ordinal, strip
from ..ontology import ObjectType
from ..sources.catalog import Catalog, Snapshot
from ..types import version_orderable

BATCH, POLL_S, LOOKUP_KEYS = 256, 1.0, 10_000
_FRAME_FIELDS = [T.StructField(KIND, T.StringType()), T.StructField(BUCKET, T.IntegerType()), T.StructField(OFFSET, T.LongType())]


class Streams:
    def __init__(self, catalog: Catalog):
        self.catalog = catalog

    # --- declaration

    def declare(self, table: str, schema: T.StructType, kind: str = "log", buckets: int = 1, identity: str | None = None, engine: str = "last_row", version: str | None = None) -> None:
        """The first declaration wins; never over existing data."""
        if kind not in ("log", "cdc") or buckets < 1:
            raise Validation("a stream is log or cdc and has a bucket at least")
        if kind == "cdc" and (identity not in schema.names or engine not in ENGINES):
            raise Validation("a change stream needs an identity column and a merge engine")
        if engine == "versioned" and (version not in schema.names):
            raise Validation("the versioned engine needs a version column")
        meta = {"stream": kind, "buckets": buckets, "identity_key": identity, "engine": engine, "version": version}
        now = self.catalog.current()
        if table in now.tables:
            have = self.catalog.entry(table, now)["meta"]
            if not have.get("stream"):
                raise Conflict(f"{table} holds data that isn't a stream")
            return
        self.catalog.create(table, T.StructType([*schema.fields, *_FRAME_FIELDS]), **meta, next={str(b): 0 for b in range(buckets)})

    def meta(self, table: str, at: Snapshot | None = None) -> dict:
        meta = self.catalog.entry(table, at)["meta"]
        if not meta.get("stream"):
            raise Validation(f"{table} is no stream")
        return meta

    # --- appending

    def _store(self, table: str, make, with_commit=None) -> int:
        """make(next offsets) gives framed rows; they and the new offsets are
        one commit, which is made again from the start if another was faster."""
        for _ in range(5):
            at = self.catalog.current()
            first = {int(b): n for b, n in self.meta(table, at)["next"].items()}
            new = self.catalog.write_files(table, make(first))
            ahead: dict[int, int] = dict(first)
            meta = self.meta(table, at)
            framed = T.StructType.fromJson(self.catalog.entry(table, at)["schema"])
            if meta["stream"] == "log":  # rows are dealt to buckets in turn
                n, rows = meta["buckets"], sum(f["rows"] for f in new)
                ahead = {b: first[b] + max(0, rows - b + n - 1) // n for b in first}
            elif new:
                for r in self.catalog.spark.read.schema(framed).parquet(*self.catalog.paths(new)).groupBy(BUCKET).agg(F.max(OFFSET).alias("m")).collect():  # a row for each bucket
                    ahead[r[BUCKET]] = r["m"] + 1

            def change(tx, first=first, new=new, ahead=ahead):
                e = tx.edit(table)
                if {int(b): n for b, n in e["meta"]["next"].items()} != first:
                    raise Conflict(f"{table} was appended to")
                e["files"] += new
                e["meta"]["next"] = {str(b): n for b, n in ahead.items()}
                if with_commit:
                    with_commit(tx)

            try:
                return self.catalog.commit(change)
            except Conflict:
                if with_commit:
                    raise
        raise Conflict(f"{table}: other appends were faster")

    def append(self, table: str, df: DataFrame, order: list, with_commit=None) -> int:
        meta = self.meta(table)
        if meta["stream"] != "log":
            raise Validation("rows are appended to logs; a change stream gets changes")
        schema = self.user_schema(table)
        rows = self.catalog.aligned(df, schema)
        return self._store(table, lambda first: frame_log(rows, meta["buckets"], order, first), with_commit)

    def change(self, table: str, after: DataFrame) -> int:
        """The change events from the folded state to the given one."""
        meta = self.meta(table)
        i, n = meta["identity_key"], meta["buckets"]

        def make(first):
            events = emit_cdc(self.state(table), self.catalog.aligned(after, self.user_schema(table)), i)
            return self._frame(events.withColumn(BUCKET, cdc_bucket(F.col(i), n)), [i, "_step"], first)

        return self._store(table, make)

    def ingest(self, table: str, events: DataFrame, order: list) -> int:
        """Given change events (with KIND), in order, as they come."""
        meta = self.meta(table)
        b = events.withColumn(BUCKET, cdc_bucket(F.col(meta["identity_key"]), meta["buckets"]))
        return self._store(table, lambda first: self._frame(b, order, first))

    def _frame(self, events: DataFrame, order: list, first: dict[int, int]) -> DataFrame:
        """Offsets by bucket: the number among all, less the bucket's first."""
        named = ordinal(events, [F.col(BUCKET), *[F.col(c) if isinstance(c, str) else c for c in order]])
        low = named.groupBy(BUCKET).agg(F.min("_n").alias("_low"))  # a row for each bucket
        start = F.lit(0)
        for b, n in first.items():
            start = F.when(F.col(BUCKET) == b, F.lit(n)).otherwise(start)
        out = named.join(F.broadcast(low), BUCKET).withColumn(OFFSET, (start + F.col("_n") - F.col("_low")).cast("long"))
        user = [c for c in events.columns if c not in (*FRAME, "_step")]
        return out.select(*user, KIND, F.col(BUCKET).cast("int").alias(BUCKET), OFFSET)

    # --- reading

    def user_schema(self, table: str) -> T.StructType:
        return T.StructType([f for f in self.catalog.schema(table).fields if f.name not in FRAME])

    def events(self, table: str, at: Snapshot | None = None) -> DataFrame:
        return self.catalog.scan(table, at)

    def state(self, table: str, at: Snapshot | None = None) -> DataFrame:
        """The folded rows of a change stream, a log's rows."""
        meta = self.meta(table, at)
        rows = self.events(table, at)
        if meta["stream"] == "log":
            return strip(rows)
        return strip(fold(rows, meta["identity_key"], meta["engine"], meta["version"]))

    def consolidate(self, table: str) -> int:
        """The fold as the base, framing kept: reads before and after are equal."""
        at = self.catalog.current()
        meta = self.meta(table, at)
        if meta["stream"] != "cdc":
            raise Validation("only change streams fold")
        old = {f["path"] for f in self.catalog.entry(table, at)["files"]}
        new = self.catalog.write_files(table, fold(self.events(table, at), meta["identity_key"], meta["engine"], meta["version"]))

        def change(tx):
            e = tx.edit(table)
            readers = [m for m in tx.state.get("views", {}).values() if m["source"] == table]
            for m in readers:
                if any(m["next"].get(b, 0) < n for b, n in meta["next"].items()):
                    raise Validation(f"{table} has rows that a view hasn't read")
            e["files"] = new + [f for f in e["files"] if f["path"] not in old]

        return self.catalog.commit(change)

    def page(self, table: str, cursor: str | None = None, start: str = "earliest", limit: int = BATCH, condition=None) -> tuple[list, str]:
        """(events in bucket and offset order, cursor for the next page) at one
        snapshot.  A cursor names the table; buckets it lacks start at 0.  Of a
        page's events only those under condition are collected; the cursor moves
        past the others too."""
        at = self.catalog.current()
        meta = self.meta(table, at)
        live = {int(b): n for b, n in meta["next"].items()}
        if cursor is not None:
            try:
                raw = json.loads(base64.urlsafe_b64decode(cursor.encode()))
            except ValueError:
                raise Validation("bad cursor") from None
            if raw.get("t") != table:
                raise Validation("the cursor is for another stream")
            at_offset = {b: int(raw["b"].get(str(b), 0)) for b in live}
        elif start in ("earliest", "latest"):
            at_offset = {b: 0 if start == "earliest" else n for b, n in live.items()}
        else:
            raise Validation(f"unknown start {start}")
        page = feed(self.events(table, at), at_offset, limit)
        if condition is not None:
            page = page.select("*", F.coalesce(condition, F.lit(False)).alias("_fine"))
            ends = page.groupBy(BUCKET).agg(F.max(OFFSET).alias("m")).collect()  # a row for each bucket
            at_offset |= {r[BUCKET]: r["m"] + 1 for r in ends}
            rows = page.where("_fine").drop("_fine").collect() if ends else []
        else:
            rows = page.collect()  # limit rows
            for r in rows:
                at_offset[r[BUCKET]] = r[OFFSET] + 1
        raw = json.dumps({"t": table, "b": {str(b): n for b, n in at_offset.items()}})
        return rows, base64.urlsafe_b64encode(raw.encode()).decode()

    def await_page(self, table: str, cursor: str, timeout_s: float = 10.0, limit: int = BATCH) -> tuple[list, str]:
        """page(), until there are events or time is up: again at once after each
        commit of this process, and every POLL_S for those of others."""
        end = time.time() + timeout_s
        while True:
            seen = self.catalog.current().id
            rows, after = self.page(table, cursor, limit=limit)
            if rows or time.time() >= end:
                return rows, after
            with self.catalog.committed:
                if self.catalog.current().id == seen:
                    self.catalog.committed.wait(min(POLL_S, max(0.0, end - time.time())))

    # --- micro-batch views

    def define_view(self, name: str, source: str, output: str, sql: str, output_schema: T.StructType, buckets: int = 1, enrich: dict[str, str | None] | None = None) -> None:
        """sql runs over `delta` (new source rows) and the enrich tables' state;
        enrich: table to the key column whose delta values suffice, or None."""
        if source == output:
            raise Validation("a view can't feed itself")
        if self.meta(source)["stream"] != "log":
            raise Validation("a view reads a log")
        self.declare(output, output_schema, "log", buckets)
        first = {r[BUCKET]: r["m"] for r in self.events(source).groupBy(BUCKET).agg(F.min(OFFSET).alias("m")).collect()}  # a row for each bucket

        def change(tx):
            tx.state.setdefault("views", {}).setdefault(name, {"source": source, "output": output, "sql": sql, "enrich": enrich or {}, "next": {str(b): first.get(b, 0) for b in range(self.meta(source)["buckets"])}})

        self.catalog.commit(change)

    def view(self, name: str) -> dict:
        now = self.catalog.current()
        views = self.catalog._version(now.id)["state"].get("views", {}) if now.id else {}
        if name not in views:
            raise NotFound(f"view {name}")
        return views[name]

    def run_view(self, name: str) -> int | None:
        """One batch: the source's rows since the last one.  None if there are
        none; an empty result still moves on."""
        spec = self.view(name)
        at = self.catalog.current()
        to = {b: n for b, n in self.meta(spec["source"], at)["next"].items()}
        begin = {b: spec["next"].get(b, 0) for b in to}
        if all(begin[b] >= to[b] for b in to):
            return None
        delta = feed_range(self.events(spec["source"], at), begin, to)
        session = self.catalog.spark.newSession()
        rows = strip(delta)
        view_of(session, rows, "delta")
        for table, key in spec["enrich"].items():
            state = self.state(table, at) if self.catalog.entry(table, at)["meta"].get("stream") else self.catalog.scan(table, at)
            if key is not None:
                delta_key, _, state_key = key.partition("=")
                wanted = rows.select(F.col(delta_key).alias("_k")).where("_k IS NOT NULL").distinct()
                state = state.join(wanted, F.col(state_key or delta_key) == F.col("_k"), "left_semi")
            view_of(session, state, table.rsplit(".", 1)[-1])
        out = session.sql(spec["sql"])
        order = [F.col(f"`{c}`").asc_nulls_first() for c, t in out.dtypes if not t.startswith(("map", "array", "struct"))]

        def advance(tx):
            now = tx.state.get("views", {}).get(name)
            if now is None or now["next"] != spec["next"]:
                raise Conflict(f"view {name} has moved on")
            now["next"] = to

        return self.append(spec["output"], out, order, advance)


def view_of(session, df: DataFrame, name: str) -> None:
    """df as a temporary view of another session of the same application."""
    session._jsparkSession  # noqa: B018  the session must be live
    DataFrame(session._jvm.org.apache.spark.sql.classic.Dataset.ofRows(session._jsparkSession, df._jdf.queryExecution().analyzed()), session).createOrReplaceTempView(name)


def feed_range(events: DataFrame, begin: dict[str, int], to: dict[str, int]) -> DataFrame:
    due = F.lit(False)
    for b, n in to.items():
        due = due | ((F.col(BUCKET) == int(b)) & (F.col(OFFSET) >= begin[b]) & (F.col(OFFSET) < n))
    return events.where(due)


def stream_of(t: ObjectType) -> dict:
    """What a type's declaration says of its change stream."""
    version = t.version
    if version is not None and not version_orderable(t.prop(version).type):
        raise Validation(f"{version} can't be ordered by")
    return {"kind": "cdc", "identity": t.identity, "engine": "versioned" if version else "last_row", "version": version}


def structured(spark, folder: str, schema: T.StructType) -> DataFrame:
    """The Parquet files that come into a folder as a streaming DataFrame."""
    return spark.readStream.schema(schema).parquet(folder)


def batch_sink(streams: Streams, table: str, name: str, order: list):
    """A foreachBatch function that appends micro-batches to a log.  The batch
    number is committed with the rows, so a batch that comes again does nothing."""

    def write(df: DataFrame, batch: int) -> None:
        def mark(tx):
            sinks = tx.state.setdefault("sinks", {})
            if sinks.get(name, -1) >= batch:
                raise Conflict(f"batch {batch} of {name} is in")
            sinks[name] = batch

        now = streams.catalog.current()
        if streams.catalog._version(now.id)["state"].get("sinks", {}).get(name, -1) < batch:
            streams.append(table, df, order, mark)

    return write
