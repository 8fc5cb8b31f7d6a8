"""Vector search: exact distances, IVF-Flat, HNSW shards, governed.

An index is built once, at a snapshot, and kept as Parquet in the warehouse (rows
sorted by cluster and the centroids, or the encoded graphs of the shards); its
description is state of the catalog.  A search at a later snapshot takes the
index's rows that haven't changed since (cold) and, exactly, those that have (hot).
Accumulates in double; ties go by identity."""

from __future__ import annotations

import heapq
import json
import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..errors import DimensionMismatch, NoIndex, Validation
from ..ontology import VectorIndex
from ..sources.arrow import arrow_map
from ..types import dimension
from .governed import Context, governed

K_MAX = 1000


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def distance(column: Column, query: list[float], metric: str) -> Column:
    """Cosine distance (1 for a zero vector) or L2, in whole-row expressions."""
    q = F.array(*[F.lit(float(np.float32(x))) for x in query])
    if metric == "l2":
        return F.sqrt(F.aggregate(F.zip_with(column, q, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x))
    if metric != "cosine":
        raise Validation(f"unknown metric {metric}")
    norm = F.sqrt(_dot(column, column)) * F.lit(math.sqrt(sum(float(np.float32(x)) ** 2 for x in query)))
    return F.when(norm == 0, F.lit(1.0)).otherwise(1 - _dot(column, q) / norm)


def knn(df: DataFrame, id_col: str, vector_col: str, query: list[float], k: int, metric: str = "cosine") -> DataFrame:
    """(id_col, distance) of the k nearest; each task keeps k rows."""
    if not 1 <= k <= K_MAX:
        raise Validation(f"k is 1 to {K_MAX}")
    wrong = F.size(vector_col) != len(query)
    near = F.when(wrong, F.raise_error(F.lit("vectors of another dimension")).cast("double")).otherwise(distance(F.col(vector_col), query, metric))
    return df.where(F.col(vector_col).isNotNull()).select(id_col, near.alias("distance")).orderBy("distance", id_col).limit(k)


QUERY_BYTES = 32 << 20  # of queries that go to every task at once
CELLS = 1 << 19  # distances that a task works on at once
FOUND = 1024  # queries whose rows a task hands over at once


def unit(x: np.ndarray, metric: str) -> np.ndarray:
    return x if metric == "l2" else x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def distances(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """All distances of unit() vectors, so rounded that equal vectors tie."""
    if metric == "cosine":
        return np.round(1 - q @ x.T, 12)
    return np.round(np.sqrt(np.maximum((q * q).sum(1)[:, None] - 2 * q @ x.T + (x * x).sum(1), 0)), 12)


class Nearest:
    """The k nearest rows of each query among what has been seen."""

    def __init__(self, n: int, k: int):
        self.k, self.d, self.ids = k, [np.zeros(0)] * n, [np.zeros(0, object)] * n

    def add(self, which: np.ndarray, d: np.ndarray, ids: np.ndarray) -> None:
        """d: a row for each of the queries in which, a column for each id, sorted by id."""
        order = np.argsort(d, axis=1, kind="stable")[:, : self.k]
        for r, q in enumerate(which.tolist()):
            far = np.concatenate([self.d[q], d[r, order[r]]])
            all_ids = np.concatenate([self.ids[q], ids[order[r]]])
            best = sorted(range(len(far)), key=lambda i: (far[i], all_ids[i]))[: self.k]
            self.d[q], self.ids[q] = far[best], all_ids[best]

    def meet(self, which: np.ndarray, q: np.ndarray, x: np.ndarray, ids: np.ndarray, metric: str) -> None:
        """The queries in which against rows x, sorted by ids; CELLS distances at once."""
        step = max(1, CELLS // max(len(x), 1))
        for lo in range(0, len(which), step):
            some = which[lo : lo + step]
            self.add(some, distances(q[some], x, metric), ids)

    def batches(self, qids: list, kinds: list):
        for lo in range(0, len(qids), FOUND):
            d, found = self.d[lo : lo + FOUND], self.ids[lo : lo + FOUND]
            columns = [[q for q, x in zip(qids[lo : lo + FOUND], d) for _ in range(len(x))], [i for x in found for i in x.tolist()], np.concatenate(d)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [*kinds, pa.float64()])], ["query_id", "id", "distance"])


def matrix(column, dim: int) -> np.ndarray:
    """The vectors of an Arrow list column without nulls."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(flat) != len(column) * dim or (np.diff(column.offsets.to_numpy()) != dim).any():
        raise ValueError("vectors of another dimension")
    return flat.reshape(-1, dim)


def query_blocks(queries: DataFrame):
    """(ids, vectors) of a stated query set (query_id, vector), in blocks of about
    QUERY_BYTES each, measured first."""
    real = queries.where("vector IS NOT NULL")
    size = 8 * (real.agg(F.sum(F.size("vector"))).first()[0] or 0)
    parts = max(1, -(-size // QUERY_BYTES))
    for p in range(parts):
        rows = real.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == p).select("query_id", "vector").collect()
        if rows:
            rows.sort(key=lambda r: r[0])
            yield [r[0] for r in rows], np.array([r[1] for r in rows], np.float64)


def knn_many(df: DataFrame, id_col: str, vector_col: str, queries: DataFrame, k: int, metric: str = "cosine", probes=None) -> DataFrame:
    """(query_id, id_col, distance) of each query's k nearest rows: a block of
    queries meets every row once, each task keeps k rows a query, and the tasks'
    rows are merged.  probes: gives, for queries' vectors, the clusters each looks
    into; rows then have a column cluster."""
    if not 1 <= k <= K_MAX:
        raise Validation(f"k is 1 to {K_MAX}")
    spark = df.sparkSession
    columns = [id_col, vector_col] + ["cluster"] * (probes is not None)
    rows = df.where(F.col(vector_col).isNotNull()).select(*columns)
    qkind, ikind = queries.schema["query_id"].dataType, rows.schema[id_col].dataType
    schema = f"query_id {qkind.simpleString()}, id {ikind.simpleString()}, distance double"
    from pyspark.sql.pandas.types import to_arrow_type

    kinds, found = [to_arrow_type(qkind), to_arrow_type(ikind)], None
    for ids, vectors in query_blocks(queries):
        q = unit(vectors, metric)
        looks = probes(vectors) if probes is not None else None
        part = rows if looks is None else rows.where(F.col("cluster").isin(sorted({int(c) for x in looks for c in x})))
        shared = spark.sparkContext.broadcast((ids, q, looks))  # QUERY_BYTES about

        def run(batches, shared=shared):
            ids, q, looks = shared.value
            best = Nearest(len(ids), k)
            by: dict[int, list[int]] = {}
            for i, x in enumerate(looks or []):
                for c in x:
                    by.setdefault(int(c), []).append(i)
            for b in batches:
                if not b.num_rows:
                    continue
                x, names = unit(matrix(b.column(1), q.shape[1]), metric), np.array(b.column(0).to_pylist(), object)
                order = np.array(sorted(range(len(names)), key=names.__getitem__))
                x, names = x[order], names[order]
                if looks is None:
                    best.meet(np.arange(len(ids)), q, x, names, metric)
                else:
                    cluster = np.asarray(b.column(2).to_pylist())[order]
                    for c in np.unique(cluster).tolist():
                        if c in by:
                            mine = cluster == c
                            best.meet(np.array(by[c]), q, x[mine], names[mine], metric)
            yield from best.batches(ids, kinds)

        got = arrow_map(part, run, schema)
        found = got if found is None else found.unionByName(got)
    if found is None:
        found = spark.createDataFrame([], schema)
    return top(found, k).withColumnRenamed("id", id_col)


def top(found: DataFrame, k: int) -> DataFrame:
    """Each query's k nearest, an id once."""
    once = found.groupBy("query_id", "id").agg(F.min("distance").alias("distance"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return once.withColumn("_r", rank).where(F.col("_r") <= k).drop("_r")


def kmeans(x: np.ndarray, k: int, seed: int = 17, rounds: int = 20) -> np.ndarray:
    """k-means++ and Lloyd's rounds; an empty cluster keeps its centre."""
    rng = np.random.default_rng(seed)
    centres = [x[rng.integers(len(x))]]
    d = ((x - centres[0]) ** 2).sum(1)
    while len(centres) < k:
        centres.append(x[rng.choice(len(x), p=d / d.sum())] if d.sum() > 0 else x[rng.integers(len(x))])
        d = np.minimum(d, ((x - centres[-1]) ** 2).sum(1))
    c = np.array(centres)
    for _ in range(rounds):
        at = nearest(x, c)
        new = np.array([x[at == j].mean(0) if (at == j).any() else c[j] for j in range(k)])
        if np.allclose(new, c):
            break
        c = new
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(1) - 2 * x @ c.T).argmin(1)


SAMPLE = 20_000  # vectors that centroids are fitted on, at most


def build_ivf(df: DataFrame, id_col: str, vector_col: str, metric: str = "cosine", nlist: int | None = None, sample: int = SAMPLE) -> tuple[np.ndarray, DataFrame]:
    """(centroids, every row with its cluster).  nlist: the root of the count."""
    rows = df.where(F.col(vector_col).isNotNull()).select(id_col, vector_col)
    n = rows.count()
    nlist = min(nlist or max(1, round(math.sqrt(n))), max(n, 1))
    some = rows.select(vector_col, F.xxhash64(id_col).alias("h")).orderBy("h").limit(sample).collect()
    x = np.array([r[0] for r in some], np.float64) if some else np.zeros((1, 1))
    if metric == "cosine":
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    centres = kmeans(x, min(nlist, len(x)))
    shared = df.sparkSession.sparkContext.broadcast(centres)  # nlist vectors

    def assign(batches):
        for b in batches:
            v = unit(matrix(b.column(1), shared.value.shape[1]), metric) if b.num_rows else np.zeros((0, 1))
            cluster = nearest(v, shared.value) if len(v) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cluster, pa.int32())], [*b.schema.names, "cluster"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return centres, arrow_map(rows, assign, f"{schema}, cluster int")


def probe(centres: np.ndarray, query: list[float], metric: str, nprobe: int | None = None) -> list[int]:
    """The clusters to look into; nprobe: the root of their number."""
    q = unit(np.array([query], np.float64), metric)[0]
    d = ((centres - q) ** 2).sum(1)
    return np.argsort(d, kind="stable")[: nprobe or max(1, round(math.sqrt(len(centres))))].tolist()


def ivf_search(centres: np.ndarray, clustered: DataFrame, id_col: str, vector_col: str, query: list[float], k: int, metric: str = "cosine", nprobe: int | None = None) -> DataFrame:
    return knn(clustered.where(F.col("cluster").isin(probe(centres, query, metric, nprobe))), id_col, vector_col, query, k, metric)


CALIBRATION, TARGET = 200, 0.95  # queries that fix an index's default effort (nprobe, ef_search), and the recall they must reach
EF, EF_MAX = 64, 1024  # least and greatest fitted ef_search


class Hnsw:
    """A hierarchical navigable small world graph over one shard's vectors."""

    def __init__(self, metric: str = "cosine", m: int = 16, ef_construction: int = 200, seed: int = 3):
        self.metric, self.m, self.ef, self.rng = metric, m, max(ef_construction, m), np.random.default_rng(seed)
        self.x = np.zeros((0, 0))  # len(links) vectors, and room
        self.links: list[list[list[int]]] = []
        self.entry = -1
        self.ef_search = EF  # by fit(); 0: the graph misses too many, its vectors are scanned

    def _far(self, q: np.ndarray, ids: list[int]) -> np.ndarray:
        v = self.x[ids]
        return ((v - q) ** 2).sum(1) if self.metric == "l2" else 1 - v @ q

    def _unit(self, v) -> np.ndarray:
        v = np.asarray(v, np.float64)
        return v if self.metric == "l2" else v / max(np.linalg.norm(v), 1e-300)

    def _layer(self, q: np.ndarray, start: list[tuple[float, int]], ef: int, level: int, skip: int = -1) -> list[tuple[float, int]]:
        seen, todo = {skip, *(i for _, i in start)}, list(start)
        heapq.heapify(todo)
        best = [(-d, i) for d, i in start]
        heapq.heapify(best)
        while todo:
            d, i = heapq.heappop(todo)
            if len(best) >= ef and d > -best[0][0]:
                break
            new = [j for j in self.links[i][level] if j not in seen]
            if not new:
                continue
            seen.update(new)
            for dj, j in zip(self._far(q, new).tolist(), new):
                if len(best) < ef or dj < -best[0][0]:
                    heapq.heappush(todo, (dj, j))
                    heapq.heappush(best, (-dj, j))
                    if len(best) > ef:
                        heapq.heappop(best)
        return sorted((-d, i) for d, i in best)

    def _choose(self, near: list[tuple[float, int]], m: int) -> list[int]:
        """Neighbours that are nearer to the point than to one another."""
        kept: list[int] = []
        for d, i in near:
            if len(kept) >= m:
                break
            if not kept or d <= self._far(self.x[i], kept).min():
                kept.append(i)
        for _, i in near:
            if len(kept) >= m:
                break
            if i not in kept:
                kept.append(i)
        return kept

    def add(self, vector) -> None:
        q, me = self._unit(vector), len(self.links)
        top = int(-math.log(max(self.rng.random(), 1e-12)) / math.log(self.m))
        if me == len(self.x):
            room = np.zeros((max(64, 2 * me), len(q)))
            if me:
                room[:me] = self.x
            self.x = room
        self.x[me] = q
        self.links.append([[] for _ in range(top + 1)])
        if self.entry < 0:
            self.entry = me
            return
        at = [(float(self._far(q, [self.entry])[0]), self.entry)]
        height = len(self.links[self.entry]) - 1
        for level in range(height, top, -1):
            at = self._layer(q, at[:1], 1, level)
        for level in range(min(top, height), -1, -1):
            at = self._layer(q, at, self.ef, level)
            most = 2 * self.m if level == 0 else self.m
            for j in self._choose(at, self.m):
                self.links[me][level].append(j)
                own = self.links[j][level]
                own.append(me)
                if len(own) > most:
                    self.links[j][level] = self._choose(sorted(zip(self._far(self.x[j], own).tolist(), own)), most)
        if top > height:
            self.entry = me

    def search(self, query, k: int, ef: int, skip: int = -1) -> list[int]:
        """skip: a point that is passed by, unless the search starts there."""
        if self.entry < 0:
            return []
        q = self._unit(query)
        at = [(float(self._far(q, [self.entry])[0]), self.entry)]
        for level in range(len(self.links[self.entry]) - 1, 0, -1):
            at = self._layer(q, at[:1], 1, level, skip)
        return [i for _, i in self._layer(q, at, max(ef, k), 0, skip)[:k]]

    def find(self, best: Nearest, q: np.ndarray, k: int, ef_search: int | None, names: np.ndarray, skip: list[int] | None = None) -> None:
        """Adds, by name, what is found for each of q, unit() vectors."""
        ef = ef_search or self.ef_search
        if not ef:
            return self.scan(best, q, names)
        for i in range(len(q)):
            hits = sorted(self.search(q[i], max(k, ef), max(k, ef), skip[i] if skip else -1), key=names.__getitem__)
            if hits:
                best.add(np.array([i]), distances(q[i : i + 1], self.x[hits], self.metric), names[hits])

    def scan(self, best: Nearest, q: np.ndarray, names: np.ndarray) -> None:
        """Adds the nearest of all vectors for each of q."""
        order = np.array(sorted(range(len(names)), key=names.__getitem__), np.int64)
        for lo in range(0, len(order), 4096):
            some = order[lo : lo + 4096]
            best.meet(np.arange(len(q)), q, self.x[some], names[some], self.metric)

    def fit(self, names: np.ndarray) -> None:
        """The least ef_search (of EF and steps of half) with which CALIBRATION of the rows, each
        as if it weren't in the graph (as queries of other shards aren't), find
        TARGET of the ten nearest to them; 0 if EF_MAX
        doesn't do."""
        rows = np.sort(np.random.default_rng(5).permutation(len(names))[:CALIBRATION]).tolist()
        q, near = self.x[rows], Nearest(len(rows), 11)
        self.scan(near, q, names)
        want = [[i for i in ids if i != names[r]][:10] for ids, r in zip(near.ids, rows)]
        self.ef_search = EF
        while self.ef_search:
            got = Nearest(len(rows), 11)
            self.find(got, q, 11, None, names, rows)
            if sum(len(set(a).intersection(b)) for a, b in zip(want, got.ids)) >= TARGET * sum(map(len, want)):
                return
            self.ef_search = self.ef_search * 3 // 2 if self.ef_search < EF_MAX else 0

    def encode(self) -> bytes:
        """Header (JSON), vectors, and the links level by level."""
        flat = [j for node in self.links for level in node for j in level]
        counts = [len(level) for node in self.links for level in node]
        x = self.x[: len(self.links)]
        head = json.dumps({"v": 1, "metric": self.metric, "m": self.m, "ef": self.ef, "ef_search": self.ef_search, "entry": self.entry, "n": len(x), "dim": x.shape[1], "levels": [len(node) for node in self.links]}).encode()
        return len(head).to_bytes(4, "little") + head + x.astype("<f8").tobytes() + np.array(counts, "<i4").tobytes() + np.array(flat, "<i4").tobytes()

    @classmethod
    def decode(cls, raw: bytes | memoryview) -> Hnsw:
        size = int.from_bytes(raw[:4], "little")
        head = json.loads(bytes(raw[4 : 4 + size]))
        if head.get("v") != 1:
            raise Validation("unknown index format")
        out = cls(head["metric"], head["m"], head["ef"])
        at = 4 + size
        x = np.frombuffer(raw, "<f8", head["n"] * head["dim"], at).reshape(head["n"], -1) if head["n"] else np.zeros((0, 0))
        at += x.size * 8
        counts = np.frombuffer(raw, "<i4", sum(head["levels"]), at).tolist()
        flat, nodes = np.frombuffer(raw, "<i4", -1, at + 4 * len(counts)), np.array(range(head["n"]), object)  # a number once for all its links
        out.x, out.entry, out.ef_search, c, f = x.astype(np.float64), head["entry"], head.get("ef_search", EF), 0, 0
        for levels in head["levels"]:
            node = []
            for n in counts[c : c + levels]:
                node.append(nodes[flat[f : f + n]].tolist())
                f += n
            out.links.append(node)
            c += levels
        return out


SHARD_BYTES = 32 << 20  # of a shard's vectors


def _graphs(batches, shard_rows: int, metric: str, m: int, ef_construction: int):
    """(ids, fitted graph) of each shard of rows."""

    def shard():
        names = np.array(ids, object)
        graph.fit(names)
        return names, graph

    ids, graph = [], Hnsw(metric, m, ef_construction)
    for b in batches:
        if not b.num_rows:
            continue
        dim = len(b.column(1)[0])
        most = max(1, min(shard_rows, SHARD_BYTES // (8 * max(dim, 1))))
        for i, v in zip(b.column(0).to_pylist(), matrix(b.column(1), dim)):
            ids.append(i)
            graph.add(v)
            if len(ids) >= most:
                yield shard()
                ids, graph = [], Hnsw(metric, m, ef_construction)
    if ids:
        yield shard()


def build_hnsw(df: DataFrame, id_col: str, vector_col: str, metric: str = "cosine", m: int = 16, ef_construction: int = 200, shard_rows: int = 20_000) -> DataFrame:
    """(ids, graph): the encoded graph of each shard of rows."""
    rows = df.where(F.col(vector_col).isNotNull()).select(id_col, vector_col)
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(rows.schema[id_col].dataType)

    def run(batches):
        for names, graph in _graphs(batches, shard_rows, metric, m, ef_construction):
            yield pa.RecordBatch.from_arrays([pa.array([names.tolist()], pa.list_(kind)), pa.array([graph.encode()], pa.binary())], ["ids", "graph"])

    return arrow_map(rows, run, f"ids array<{rows.schema[id_col].dataType.simpleString()}>, graph binary")


def hnsw_many(shards: DataFrame, queries: DataFrame, k: int, metric: str, ef_search: int | None = None, spare: bool = False) -> DataFrame:
    """(query_id, id, distance): each shard's k best for each query, with the
    shard's own ef_search unless one is given.  spare: all that was found on the way."""
    spark = shards.sparkSession
    qkind, ikind = queries.schema["query_id"].dataType, shards.schema["ids"].dataType.elementType
    schema = f"query_id {qkind.simpleString()}, id {ikind.simpleString()}, distance double"
    from pyspark.sql.pandas.types import to_arrow_type

    kinds, found = [to_arrow_type(qkind), to_arrow_type(ikind)], spark.createDataFrame([], schema)
    for ids, vectors in query_blocks(queries):
        shared = spark.sparkContext.broadcast((ids, vectors))  # QUERY_BYTES about

        def run(batches, shared=shared):
            qids, vectors = shared.value
            for b in batches:
                for names, raw in zip(b.column(0), b.column(1)):
                    graph, names = Hnsw.decode(memoryview(raw.as_buffer())), np.array(names.as_py(), object)
                    most = max(k, ef_search or graph.ef_search or EF) if spare else k
                    for lo in range(0, len(qids), FOUND):
                        q = unit(vectors[lo : lo + FOUND], metric)
                        best = Nearest(len(q), most)
                        graph.find(best, q, k, ef_search, names)
                        yield from best.batches(qids[lo : lo + FOUND], kinds)

        found = found.unionByName(arrow_map(shards, run, schema))
    return found


def hnsw_search(df: DataFrame, id_col: str, vector_col: str, query: list[float], k: int, metric: str = "cosine", m: int = 16, ef_construction: int = 200, ef_search: int | None = None, shard_rows: int = 20_000) -> DataFrame:
    """(id_col, distance): each shard of rows builds its graph and gives k
    candidates, which are merged."""
    if not 1 <= k <= K_MAX:
        raise Validation(f"k is 1 to {K_MAX}")
    rows = df.where(F.col(vector_col).isNotNull()).select(id_col, vector_col)
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(rows.schema[id_col].dataType)

    def run(batches):
        q = unit(np.array([query], np.float32).astype(np.float64), metric)
        for names, graph in _graphs(batches, shard_rows, metric, m, ef_construction):
            best = Nearest(1, k)
            graph.find(best, q, k, ef_search, names)
            yield pa.RecordBatch.from_arrays([pa.array(best.ids[0].tolist(), kind), pa.array(best.d[0])], [id_col, "distance"])

    near = arrow_map(rows, run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, distance double")
    return near.orderBy("distance", id_col).limit(k)


class IndexStore:
    """Kept indexes of a catalog's tables."""

    def __init__(self, ctx: Context):
        self.ctx, self.catalog = ctx, ctx.catalog

    def build(self, type_name: str, name: str) -> dict:
        """Builds the index at the current snapshot; its description (kind, metric,
        snapshot, rows, path and knobs) is committed once its files are there."""
        index: VectorIndex | None = self.ctx.registry.indexes.get((type_name, name))
        if index is None:
            raise NoIndex(f"{type_name} has no index {name}")
        t, at = self.ctx.registry.type(type_name), self.catalog.current()
        rows = self.ctx.table(t.table, at).select(t.identity, index.property)
        path = f"{self.catalog.root}/indexes/{type_name}-{name}/{uuid.uuid4().hex}"
        spark, about = rows.sparkSession, {}
        if index.kind == "ivf_flat":
            centres, clustered = build_ivf(rows, t.identity, index.property, index.metric, index.nlist)
            clustered.repartitionByRange("cluster", t.identity).sortWithinPartitions("cluster").write.parquet(f"{path}/rows")
            spark.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(centres)], "cluster int, centre array<double>").coalesce(1).write.parquet(f"{path}/centres")
            kept = spark.read.schema(clustered.schema).parquet(f"{path}/rows")
            about = {"nlist": len(centres), "nprobe": self._calibrated(kept, centres, t.identity, index)}
        elif index.kind == "hnsw":
            shards = build_hnsw(rows, t.identity, index.property, index.metric, index.m, index.ef_construction)
            shards.write.parquet(f"{path}/shards")
        meta = {"kind": index.kind, "metric": index.metric, "property": index.property, "identity": t.identity, "table": t.table, "snapshot": at.id, "path": path, **about}

        def change(tx):
            have = tx.state.setdefault("indexes", {})
            old = have.get(f"{type_name}/{name}")
            if old is None or old["snapshot"] <= meta["snapshot"]:
                have[f"{type_name}/{name}"] = meta

        self.catalog.commit(change)
        return meta

    def _calibrated(self, kept: DataFrame, centres: np.ndarray, identity: str, index: VectorIndex) -> int:
        """The least nprobe with which CALIBRATION rows as queries find TARGET of
        their ten nearest; the root of nlist at least."""
        queries = kept.select(F.col(identity).alias("query_id"), F.col(index.property).alias("vector")).orderBy(F.xxhash64("query_id")).limit(CALIBRATION)
        near = knn_many(kept, identity, index.property, queries, 10, index.metric)
        where = kept.select(identity, "cluster")
        pairs = near.join(F.broadcast(queries.select("query_id", "vector")), "query_id").join(where, identity).select("vector", "cluster").collect()  # ten for each query
        least = max(1, round(math.sqrt(len(centres))))
        if not pairs:
            return least
        q = unit(np.array([r[0] for r in pairs], np.float64), index.metric)
        d = (centres * centres).sum(1) - 2 * q @ centres.T
        own = d[np.arange(len(pairs)), [r[1] for r in pairs]]
        rank = np.sort((d < own[:, None]).sum(1))
        return max(least, int(rank[min(len(rank) - 1, math.ceil(TARGET * len(rank)) - 1)]) + 1)

    def meta(self, type_name: str, name: str, at) -> dict | None:
        """The index as known at a snapshot."""
        if self.catalog is None or not at.id:
            return None
        return self.catalog._version(at.id)["state"].get("indexes", {}).get(f"{type_name}/{name}")

    def changed(self, meta: dict, at) -> DataFrame | None:
        """The identities of rows landed, changed or deleted after the build; None if none are."""
        cat, table = self.catalog, meta["table"]
        now = cat.entry(table, at)
        before = {f["path"] for f in cat._version(cat._version(meta["snapshot"])["tables"][table])["entries"][table]["files"]}
        paths = cat.paths([f for f in now["files"] if f["path"] not in before] + [f for f in now["inline"] if f["begin"] > meta["snapshot"]])
        if not paths:
            return None
        return self.ctx.spark.read.schema(cat.schema(table, at)).parquet(*paths).select(meta["identity"]).distinct()

    def centres(self, meta: dict) -> np.ndarray:
        rows = self.ctx.spark.read.parquet(f"{meta['path']}/centres").collect()  # nlist of them
        return np.array([r["centre"] for r in sorted(rows, key=lambda r: r["cluster"])])

    def cold(self, meta: dict, queries: DataFrame, k: int, changed: DataFrame | None, nprobe: int | None, ef_search: int | None) -> DataFrame:
        """(query_id, id, distance) among the index's rows that haven't changed."""
        spark, i = self.ctx.spark, meta["identity"]
        if meta["kind"] == "hnsw":
            found = hnsw_many(spark.read.parquet(f"{meta['path']}/shards"), queries, k, meta["metric"], ef_search, changed is not None)
            return found if changed is None else found.join(changed.select(F.col(i).alias("id")), "id", "left_anti")
        rows = spark.read.parquet(f"{meta['path']}/rows")
        if changed is not None:
            rows = rows.join(changed, i, "left_anti")
        centres = self.centres(meta)
        probes = lambda x: [probe(centres, q, meta["metric"], nprobe or meta["nprobe"]) for q in x]
        return knn_many(rows, i, meta["property"], queries, k, meta["metric"], probes).withColumnRenamed(i, "id")

    def search(self, meta: dict, queries: DataFrame, k: int, at, nprobe: int | None = None, ef_search: int | None = None) -> DataFrame:
        """Cold and hot hits merged: (query_id, id, distance)."""
        changed = self.changed(meta, at)
        found = self.cold(meta, queries, k, changed, nprobe, ef_search)
        if changed is not None:
            i = meta["identity"]
            hot = self.ctx.table(meta["table"], at).join(changed, i, "left_semi")
            found = found.unionByName(knn_many(hot, i, meta["property"], queries, k, meta["metric"]).withColumnRenamed(i, "id").select("query_id", "id", "distance"))
        return top(found, k)


def _index_for(ctx: Context, g, type_name: str, index_name: str, nprobe, ef_search) -> VectorIndex:
    index: VectorIndex | None = ctx.registry.indexes.get((type_name, index_name))
    if index is None:
        raise NoIndex(f"{type_name} has no index {index_name}")
    if nprobe is not None and index.kind != "ivf_flat":
        raise Validation("nprobe is for ivf_flat")
    if ef_search is not None and index.kind != "hnsw":
        raise Validation("ef_search is for hnsw")
    return index


def governed_knn_many(ctx: Context, subject: str, type_name: str, index_name: str, queries: DataFrame, k: int, nprobe: int | None = None, ef_search: int | None = None, at=None) -> DataFrame:
    """(query_id, identity, distance) for each of queries (query_id, vector): the
    nearest objects that the subject may see; may be fewer than k.  A flat index
    needs no build; the others must have been built."""
    g = governed(ctx, subject, type_name, at)
    index = _index_for(ctx, g, type_name, index_name, nprobe, ef_search)
    i = g.identity()
    if index.kind == "flat":
        found = knn_many(ctx.table(g.type.table, at), i, index.property, queries, k, index.metric)
    else:
        store = IndexStore(ctx)
        now = at or (ctx.catalog.current() if ctx.catalog is not None else None)
        meta = store.meta(type_name, index_name, now) if now else None
        if meta is None:
            raise NoIndex(f"{index_name} of {type_name} isn't built")
        found = store.search(meta, queries, k, now, nprobe, ef_search).withColumnRenamed("id", i)
    return found.join(g.raw.select(i).distinct(), i, "left_semi").select("query_id", i, "distance")


def governed_knn(ctx: Context, subject: str, type_name: str, index_name: str, query: list[float], k: int, nprobe: int | None = None, ef_search: int | None = None, at=None) -> DataFrame:
    """Nearest objects that the subject may see, once each; may be fewer than k.
    An index that was never built is made for the one search."""
    g = governed(ctx, subject, type_name, at)
    index = _index_for(ctx, g, type_name, index_name, nprobe, ef_search)
    if dimension(g.type.prop(index.property).type) != len(query):
        raise DimensionMismatch(f"the index has vectors of {g.type.prop(index.property).type}")
    i = g.identity()
    if index.kind != "flat" and ctx.catalog is not None:
        store, now = IndexStore(ctx), at or ctx.catalog.current()
        meta = store.meta(type_name, index_name, now)
        if meta is not None and meta["table"] == g.type.table:
            one = ctx.spark.createDataFrame([(0, [float(x) for x in query])], "query_id int, vector array<double>")
            hits = store.search(meta, one, k, now, nprobe, ef_search).select(F.col("id").alias(i), "distance")
            return hits.join(g.raw.select(i), i, "left_semi").groupBy(i).agg(F.min("distance").alias("distance")).orderBy("distance", i)
    all_rows = ctx.table(g.type.table, at)
    if index.kind == "ivf_flat":
        centres, clustered = build_ivf(all_rows, i, index.property, index.metric, index.nlist)
        hits = ivf_search(centres, clustered, i, index.property, query, k, index.metric, nprobe)
    elif index.kind == "hnsw":
        hits = hnsw_search(all_rows, i, index.property, query, k, index.metric, index.m, index.ef_construction, ef_search)
    else:
        hits = knn(all_rows, i, index.property, query, k, index.metric)
    kept = hits.join(g.raw.select(i), i, "left_semi")
    return kept.groupBy(i).agg(F.min("distance").alias("distance")).orderBy("distance", i)
