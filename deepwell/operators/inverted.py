"""Inverted lists: coarse centroids, probing, product quantisation with exact rescoring.

Centroids are trained on a bounded sample; every vector is assigned. Stored tables are partitioned by ``list_id``, so
that a query reads the lists it probes and no others (dynamic partition pruning).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dense import ROWS, Rough, Top, key_type, keys_from, keys_of, matrix, unit, usable
from .rank import top_k

SAMPLE = 20_000
ROUNDS = 8
LEAST = 256
TASK_HITS = 1 << 20


def lists_for(n: int) -> int:
    return max(16, min(1024, int(math.sqrt(n))))


def lloyd(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """k-means; a centroid that loses all its points restarts at a random one."""
    r = np.random.default_rng(seed)
    k = min(k, len(x))
    c = x[r.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        own = ((c * c).sum(1) - 2 * x @ c.T).argmin(1)
        n = np.bincount(own, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], x[r.integers(0, len(x), k)])
    return c


def sample(vectors: DataFrame, key: str, embedding: str, dim: int, n: int = SAMPLE) -> np.ndarray:
    """The ``n`` vectors with the smallest hash of the key: a bounded training sample that doesn't depend on layout."""
    rows = vectors.where(F.size(embedding) == dim).select(key, embedding).orderBy(F.xxhash64(key), key).limit(n)
    return matrix(rows.toArrow().column(1), dim)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The number of each row's nearest centroid (the first on a tie), in blocks of 4 MB of distances: lists grow with the vectors."""
    square, step = (c * c).sum(1), max(1, (1 << 19) // max(1, len(c)))
    return np.concatenate([np.zeros(0, np.int64), *((square - 2 * x[i : i + step] @ c.T).argmin(1) for i in range(0, len(x), step))])


def train_lists(vectors: DataFrame, dim: int, n: int, key: str = "chunk_id", embedding: str = "embedding", metric: str = "cosine") -> np.ndarray:
    x = sample(vectors, key, embedding, dim)
    return lloyd(unit(x) if metric == "cosine" else x, lists_for(n))


def assign(vectors: DataFrame, centroids: np.ndarray, embedding: str = "embedding", metric: str = "cosine") -> DataFrame:
    """``vectors`` with ``list_id``, the nearest centroid (the first on a tie)."""
    at = vectors.columns.index(embedding)
    dim = centroids.shape[1]
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def own_list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(at), dim)
                x = unit(x) if metric == "cosine" else x
                own = nearest(x, c)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32))], [*batch.schema.names, "list_id"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema)
    return vectors.where(F.size(embedding) == dim).mapInArrow(own_list, f"{fields}, list_id int")


def probes(queries: DataFrame, centroids: np.ndarray, nprobe: int, metric: str = "cosine", always: int | None = None) -> DataFrame:
    """(list_id, qid, q): each query, as bytes of float64, with its ``nprobe`` nearest lists; ``always``: one more list for all."""
    shared = queries.sparkSession.sparkContext.broadcast(centroids)
    dim = centroids.shape[1]
    few = max(1, min(1024, (1 << 22) // (dim * 8 * (nprobe + 1))))  # a query leaves once for each list

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            for rows in (batch.slice(i, few) for i in range(0, batch.num_rows, few)):
                q = matrix(rows.column(1), dim)
                q = unit(q) if metric == "cosine" else q
                near = np.argsort((c * c).sum(1) - 2 * q @ c.T, axis=1, kind="stable")[:, :nprobe]
                if always is not None:
                    near = np.concatenate([near, np.full((len(q), 1), always)], 1)
                raw = [v.tobytes() for v in q]
                yield pa.RecordBatch.from_arrays([pa.array(near.reshape(-1).astype(np.int32)), rows.column(0).take(pa.array(np.repeat(np.arange(len(q)), near.shape[1]))), pa.array([r for r in raw for _ in range(near.shape[1])], pa.binary())], ["list_id", "qid", "q"])

    asked = queries.select(F.col("qid").cast("long").alias("qid"), F.col("vector").cast("array<double>").alias("vector")).where(F.size("vector") == dim)
    return asked.mapInArrow(ask, "list_id int, qid long, q binary")


class _Best:
    """The k best so far of the queries that a task has met, in whatever list: a later list need only return what is better."""

    def __init__(self, k: int, more: int):
        self.k, self.more = k, more
        self.clear()

    def clear(self) -> None:
        self.rows: dict[int, int] = {}
        self.value, self.keys, self.rest = np.full((0, self.k), -np.inf), np.zeros((0, self.k), np.int64), np.zeros((0, self.k, self.more))

    def begin(self, qids: list[int]) -> tuple[np.ndarray, Top]:
        """Where the queries are kept, and a ``Top`` that knows their best."""
        at = np.array([self.rows.setdefault(i, len(self.rows)) for i in qids], np.int64)
        if len(self.rows) > len(self.value):
            grow = lambda a, fill: np.concatenate([a, np.full((max(len(self.rows), 2 * len(a)) - len(a), *a.shape[1:]), fill, a.dtype)])
            self.value, self.keys, self.rest = grow(self.value, -np.inf), grow(self.keys, 0), grow(self.rest, 0)
        top, value = Top(len(qids), self.k, self.more), self.value[at]
        of, place = np.nonzero(value > -np.inf)
        if len(of):
            top.kept = (of, self.keys[at[of], place], value[of, place], self.rest[at[of], place])
            top.bound = np.round(value, 9).min(1)  # -inf where fewer than k are known
        return at, top

    def end(self, at: np.ndarray, top: Top) -> None:
        of, keys, value, rest = top.best()
        place = np.arange(len(of)) - np.searchsorted(of, of)
        if len(of):
            self.keys = self.keys.astype(keys.dtype if self.keys.dtype.kind != keys.dtype.kind else np.promote_types(self.keys.dtype, keys.dtype), copy=False)
            self.value[at] = -np.inf
            self.value[at[of], place], self.keys[at[of], place], self.rest[at[of], place] = value, keys, rest

    def out(self, kind: pa.DataType | None) -> Iterator[pa.RecordBatch]:
        ids, step = np.array(list(self.rows), np.int64), max(1, (1 << 16) // self.k)
        for lo in range(0, len(ids), step):
            of, place = np.nonzero(self.value[lo : lo + step][: len(ids) - lo] > -np.inf)
            score, rest = self.value[lo + of, place], self.rest[lo + of, place]
            yield pa.RecordBatch.from_arrays([pa.array(ids[lo + of]), keys_from(self.keys[lo + of, place], kind), pa.array(score), pa.array(rest[:, 0] if self.more else score)], ["qid", "key", "score", "exact"])
        self.clear()


def _in_lists(k: int, dim: int, metric: str, decoded=None):
    """Rows (list_id, part, kind, qid, q, key, v, ..) in order of list and part, queries first -> k best per query, of all lists of
    a task while these are no more than ``TASK_HITS`` rows.

    ``decoded``: batch -> the vectors that are scored, by default its own; ``exact``: the scores of its own.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, asked, qids, q, top, kind, own = None, [], [], None, None, None, None
        best = _Best(k, 1 if decoded else 0)

        for batch in batches:
            kind = batch.schema.field(5).type
            spot = np.stack([batch.column(i).to_numpy() for i in range(3)]) if batch.num_rows else np.zeros((3, 0))
            edges = np.flatnonzero(np.concatenate([[True], (spot[:, 1:] != spot[:, :-1]).any(0)])) if batch.num_rows else []
            for lo, hi in zip(edges, [*edges[1:], batch.num_rows], strict=True):
                now = tuple(spot[:2, lo].tolist())
                if now != at:
                    if top is not None:
                        best.end(own, top)
                    at, asked, qids, q, top = now, [], [], None, None
                rows = batch.slice(lo, hi - lo)
                if spot[2, lo] == 0:
                    qids += rows.column(3).to_pylist()
                    asked += rows.column(4).to_pylist()
                    continue
                if not qids:
                    continue
                if q is None:
                    q, asked = Rough(np.frombuffer(b"".join(asked), np.float64).reshape(-1, dim), metric), []
                    if len(best.rows.keys() | set(qids)) * k > TASK_HITS:
                        yield from best.out(kind)
                    own, top = best.begin(qids)
                for i in range(0, rows.num_rows, ROWS):
                    some = rows.slice(i, ROWS)
                    x, keys = matrix(some.column(6), dim), keys_of(some.column(5))
                    x = unit(x) if metric == "cosine" else x
                    if decoded is None:
                        q.add_to(top, x, keys)
                    else:
                        q.add_to(top, decoded(some), keys, more=lambda at, of, x=x, q=q: q.pairs(at, x, of)[:, None])
        if top is not None:
            best.end(own, top)
        yield from best.out(kind)

    return scan


def _met(members: DataFrame, asked: DataFrame, per_list: int, dim: int, kept: int) -> DataFrame:
    """Members and the queries that probe their list, in one order. Queries of a list beyond 16 MB are split into parts, to each
    of which its members go. Tasks aren't joined, however small their input: each returns up to all ``kept`` rows."""
    tasks = max(2 * members.sparkSession.sparkContext.defaultParallelism, -(-kept // TASK_HITS))
    parts = max(1, -(-per_list * dim * 8 // (16 << 20)))
    more = [c for c in members.columns if c not in ("list_id", "key", "v")]
    left = asked.select("list_id", F.pmod(F.xxhash64("qid"), F.lit(parts)).cast("int").alias("part"), F.lit(0).alias("kind"), "qid", "q", F.lit(None).cast(members.schema["key"].dataType).alias("key"), F.lit(None).cast("array<float>").alias("v"), *[F.lit(None).cast(members.schema[c].dataType).alias(c) for c in more])
    right = members.select("list_id", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("qid"), F.lit(None).cast("binary").alias("q"), "key", "v", *more)
    return left.union(right).repartition(tasks, "list_id", "part").sortWithinPartitions("list_id", "part", "kind")


def list_top_k(assigned: DataFrame, queries: DataFrame, centroids: np.ndarray, k: int, nprobe: int, metric: str = "cosine", key: str = "chunk_id", embedding: str = "embedding", fresh: DataFrame | None = None) -> DataFrame:
    """Exact scores within the probed lists, and of all ``fresh`` vectors that no list has yet.

    Vectors and queries meet once, by list; a task holds a list's queries, streams its vectors through a matrix product and
    returns its k best for each.
    """
    dim = centroids.shape[1]
    members = usable(assigned, dim, key, embedding, "list_id").select(F.col("list_id").cast("int").alias("list_id"), "key", "v")
    if fresh is not None:
        members = members.unionByName(usable(fresh, dim, key, embedding).withColumn("list_id", F.lit(-1)))
    n = queries.count()
    per_list = n * (1 if fresh is not None else min(1.0, nprobe / len(centroids)))
    met = _met(members, probes(queries, centroids, nprobe, metric, -1 if fresh is not None else None), int(per_list), dim, n * k)
    hits = met.mapInArrow(_in_lists(k, dim, metric), f"qid long, key {key_type(assigned, key)}, score double, exact double").drop("exact")
    return top_k(hits.withColumnRenamed("key", key), k, key)


def enough_probes(assigned: DataFrame, centroids: np.ndarray, k: int, recall: float = 0.9, queries: int = 200, metric: str = "cosine", key: str = "chunk_id", embedding: str = "embedding") -> int:
    """The fewest probes at which ``queries`` of the vectors (smallest hashes) find a share ``recall`` of their k nearest among all vectors."""
    from .dense import dense_top_k

    dim = centroids.shape[1]
    asked = assigned.where(F.size(embedding) == dim).orderBy(F.xxhash64(key), key).limit(queries).select(F.xxhash64(key).alias("qid"), F.col(embedding).cast("array<double>").alias("vector"))
    near = dense_top_k(assigned, asked, k, dim, metric, key, embedding).join(assigned.select(key, "list_id"), key).select("qid", "list_id").toPandas()
    vectors = asked.toPandas()
    q = np.array(vectors["vector"].tolist(), float).reshape(-1, dim)
    q = unit(q) if metric == "cosine" else q
    order = np.argsort((centroids * centroids).sum(1) - 2 * q @ centroids.T, axis=1, kind="stable")
    place = {qid: np.argsort(line, kind="stable") for qid, line in zip(vectors["qid"].tolist(), order, strict=True)}
    seen = np.sort([place[a][b] for a, b in zip(near["qid"], near["list_id"], strict=True)])
    return int(seen[min(len(seen) - 1, math.ceil(recall * len(seen)) - 1)]) + 1 if len(seen) else len(centroids)


def subspaces(dim: int) -> int:
    """The largest divisor of ``dim`` up to min(64, dim / 4)."""
    return next(m for m in range(max(1, min(64, dim // 4)), 0, -1) if dim % m == 0)


def train_codes(vectors: DataFrame, dim: int, key: str = "chunk_id", embedding: str = "embedding", metric: str = "cosine", m: int | None = None) -> np.ndarray:
    """Codebooks (m, up to 256, dim / m)."""
    x = sample(vectors, key, embedding, dim)
    x = unit(x) if metric == "cosine" else x
    m = m or subspaces(dim)
    return np.stack([lloyd(x[:, i * dim // m : (i + 1) * dim // m], min(256, len(x))) for i in range(m)])


def encode(assigned: DataFrame, books: np.ndarray, embedding: str = "embedding", metric: str = "cosine") -> DataFrame:
    """With ``codes`` BINARY, a byte for each subspace."""
    at = assigned.columns.index(embedding)
    m, _, width = books.shape
    shared = assigned.sparkSession.sparkContext.broadcast(books)

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(at), m * width)
                x = (unit(x) if metric == "cosine" else x).reshape(-1, m, width)
                own = np.stack([((c[i] * c[i]).sum(1) - 2 * x[:, i] @ c[i].T).argmin(1) for i in range(m)], 1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([r.tobytes() for r in own], pa.binary())], [*batch.schema.names, "codes"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in assigned.schema)
    return assigned.mapInArrow(codes, f"{fields}, codes binary")


def code_top_k(encoded: DataFrame, queries: DataFrame, centroids: np.ndarray, books: np.ndarray, k: int, nprobe: int, metric: str = "cosine", key: str = "chunk_id", embedding: str = "embedding") -> DataFrame:
    """Distances of what the codes stand for within the probed lists, then exact scores of the ``max(8 k, k + 32)`` best.

    The products of decoded vectors are the sums of a look-up table's entries, without a pass over all pairs for each subspace.
    """
    m, _, width = books.shape
    dim, wide = m * width, max(8 * k, k + 32)
    shared = encoded.sparkSession.sparkContext.broadcast(books)

    def decoded(rows: pa.RecordBatch) -> np.ndarray:
        c = shared.value
        code = np.frombuffer(b"".join(rows.column(7).to_pylist()), np.uint8).reshape(-1, m)
        return np.concatenate([c[i][code[:, i]] for i in range(m)], 1)

    members = usable(encoded, dim, key, embedding, "list_id", "codes").select(F.col("list_id").cast("int").alias("list_id"), "key", "v", "codes")
    n, share = queries.count(), min(1.0, nprobe / len(centroids))
    met = _met(members, probes(queries, centroids, nprobe, metric), int(n * share), dim, n * wide)
    rough = met.mapInArrow(_in_lists(wide, dim, metric, decoded), f"qid long, key {key_type(encoded, key)}, score double, exact double")
    near = top_k(rough.withColumnRenamed("key", key), wide, key)
    return top_k(near.select("qid", key, F.col("exact").alias("score")), k, key)
