"""Near-duplicate embeddings by an inverted multi-index.

``near_vectors(vectors)`` returns one row per vector with a near one, that is of a cosine similarity of ``threshold`` or more:

    vec_id BIGINT, class_id BIGINT (smallest id with the same vector), copies BIGINT (other ids with the same vector),
    links BIGINT (different vectors near this one), group_id BIGINT (smallest id that links and copies lead to), keep BOOLEAN
    (vec_id = group_id)

Equal vectors are one class, searched once; ``links`` counts every near pair of classes, which aren't expanded into pairs.

Vectors are normalised and split in halves, each with its own codebook of k centroids (k-means on at most ``SAMPLE``
vectors, those with the smallest hash of the id); a vector lives in the cell (nearest in the first, nearest in the
second) of the k x k grid, with k the square root of a ``PER_CELL``-th of the number of vectors. Every vector is a query: a
multi-sequence traversal of its two sorted distance lists visits cells from the nearest on, until the summed distance
exceeds the nearest cell's by a bound. The bound is the one that finds a share ``recall`` of partners, the larger of two:
of partners made at the threshold itself, in a random direction from each of ``QUERIES`` sampled vectors, and of the true
partners of these vectors among all rows, each vector's weighing the same. A pair is sought from the smaller of its two
cells, so each is met once, and every met pair is verified by its exact cosine.

Members travel once, to the grid's row of their first centroid, and a query once to each row in which it visits cells, with
their numbers. A row of more than ``ROW_BLOCK`` members is split, and its queries go to each part, so that no task holds more.
A part reports the number of links of a vector and a forest of its links, not the pairs.

Defined cases: a vector that is null, empty, zero, has a null or non-finite element, or another length than most (the
smaller length on a tie) has no partners; rows without an id are left out; an id with several vectors has a row for each
that has a near one; repeated rows are one; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import broadcast_if_small, written
from .superminhash import components

THRESHOLD = 0.9
RECALL = 0.97
SAMPLE = 32_768
QUERIES = 1000
PER_CELL = 8
MOST_CENTROIDS = 2048
ROW_BLOCK = 1 << 15
BINS = 256
SEED = 11


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = SEED) -> np.ndarray:
    """Lloyd's algorithm; an empty centroid moves to the point farthest from its own."""
    if not len(x):
        return np.zeros((1, x.shape[1]))
    r = np.random.default_rng(seed)
    c = x[r.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        d = (c * c).sum(1) - 2 * x @ c.T
        own = d.argmin(1)
        far = np.argsort(-(d[np.arange(len(x)), own] + (x * x).sum(1)))
        n = np.bincount(own, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
        empty = np.flatnonzero(n == 0)
        c[empty] = x[far[: len(empty)]]
    return c


def multi_sequence(a: list[float], b: list[float]) -> Iterator[tuple[float, int, int]]:
    """(a[i] + b[j], i, j) in ascending order; ``a`` and ``b`` ascend. A cell enters the queue when both before it left."""
    left = [0] * len(a)  # of row i, cells that left
    queue = [(a[0] + b[0], 0, 0)]
    while queue:
        d, i, j = heapq.heappop(queue)
        yield d, i, j
        left[i] = j + 1
        if i + 1 < len(a) and left[i + 1] == j:
            heapq.heappush(queue, (a[i + 1] + b[j], i + 1, j))
        if j + 1 < len(b) and (i == 0 or left[i - 1] > j + 1):
            heapq.heappush(queue, (a[i] + b[j + 1], i, j + 1))


class Index:
    def __init__(self, first: np.ndarray, second: np.ndarray, bound: float = 0.0):
        self.first, self.second, self.bound = first, second, bound

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = self.first.shape[1]
        return tuple(np.maximum(0, ((p * p).sum(1)[:, None] + (c * c).sum(1) - 2 * p @ c.T)) for p, c in ((x[:, :h], self.first), (x[:, h:], self.second)))  # type: ignore[return-value]

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = self.distances(x)
        return a.argmin(1).astype(np.int64) * len(self.second) + b.argmin(1)

    def excess(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How far beyond its nearest cell the seeking side of each pair (of the smaller cell) must go to reach the other."""
        cx, cy = self.cells(x), self.cells(y)
        a, b = self.distances(np.where((cx <= cy)[:, None], x, y))
        goal, line = np.maximum(cx, cy), np.arange(len(x))
        return a[line, goal // len(self.second)] + b[line, goal % len(self.second)] - a.min(1) - b.min(1)

    def visits(self, a: np.ndarray, b: np.ndarray, own: int) -> dict[int, list[int]]:
        """The cells from ``own`` up whose summed distance is within the bound of the nearest cell's: by first centroid, the second ones."""
        p, q = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        sa, sb = a[p].tolist(), b[q].tolist()
        p, q, k = p.tolist(), q.tolist(), len(self.second)
        limit = sa[0] + sb[0] + self.bound
        out: dict[int, list[int]] = {}
        for d, i, j in multi_sequence(sa, sb):
            if d > limit:
                break
            if p[i] * k + q[j] >= own:
                out.setdefault(p[i], []).append(q[j])
        return out


def _matrix(column: pa.Array) -> np.ndarray:
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), np.float32).reshape(len(raw), -1).astype(np.float64)


def _normal(dim: int):
    """(id, array) -> (id, normalised float32 bytes) of the rows that are vectors."""

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            rows = np.flatnonzero(np.asarray(lists.value_lengths().fill_null(0)) == dim)
            x = lists.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            with np.errstate(over="ignore", invalid="ignore"):
                size = np.linalg.norm(x, axis=1)
            good = np.isfinite(size) & (size > 0)
            x = (x[good] / size[good, None] + 0.0).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows[good])), pa.array([v.tobytes() for v in x], pa.binary())], ["vec_id", "v"])

    return normal


# --- calibration ----------------------------------------------------------------------------------


def _true_partners(index: Index, queries: bytes, dim: int, threshold: float, step: float):
    """Every vector against the sampled queries: (query, bin of excess, partners)."""

    def partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = np.frombuffer(queries, np.float32).reshape(-1, dim).astype(np.float64)
        total = np.zeros((len(q), BINS), np.int64)
        for batch in batches:
            for rows in (batch.slice(i, 1024) for i in range(0, batch.num_rows, 1024)):
                x = _matrix(rows.column(0))
                at, of = np.nonzero(x @ q.T >= threshold)
                for lo in range(0, len(at), 4096):
                    i, j = at[lo : lo + 4096], of[lo : lo + 4096]
                    other = (x[i] != q[j]).any(1)
                    i, j = i[other], j[other]
                    np.add.at(total, (j, np.minimum(BINS - 1, np.ceil(index.excess(q[j], x[i]) / step).astype(np.int64))), 1)
        of, at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(of.astype(np.int64)), pa.array(at.astype(np.int64)), pa.array(total[of, at])], ["q", "bin", "n"])

    return partners


def made_partners(x: np.ndarray, threshold: float, seed: int = SEED) -> np.ndarray:
    """A vector at the threshold from each of ``x``, in a random direction."""
    g = np.random.default_rng(seed).normal(size=x.shape)
    g -= (g * x).sum(1)[:, None] * x
    return threshold * x + (1 - threshold**2) ** 0.5 * g / np.maximum(np.linalg.norm(g, axis=1), 1e-12)[:, None]


def train(vectors: DataFrame, dim: int, n: int, threshold: float, recall: float) -> Index:
    """``vectors``: a written table (place, v) of distinct normalised vectors."""
    sample = vectors.orderBy(F.xxhash64("v"), "v").limit(SAMPLE).select("v").toPandas()
    x = np.frombuffer(b"".join(sample["v"]), np.float32).reshape(-1, dim).astype(np.float64)
    k = int(min(MOST_CENTROIDS, len(x), max(2, round((n / PER_CELL) ** 0.5)))) if len(x) > 1 else 1
    h = max(1, dim // 2)
    index = Index(kmeans(x[:, :h], k), kmeans(x[:, h:], k) if dim > 1 else np.zeros((1, 0)))
    if not len(x):
        return index
    asked = x[:QUERIES]
    made = float(np.quantile(index.excess(asked, made_partners(asked, threshold)), recall)) if dim > 1 else 0.0
    top = max(1e-9, max(float(d.max()) for d in index.distances(asked)) * 2)
    found = vectors.select("v").mapInArrow(_true_partners(index, asked.astype(np.float32).tobytes(), dim, threshold, top / BINS), "q long, bin long, n long")
    found = found.groupBy("q", "bin").agg(F.sum("n").alias("n")).toPandas()  # QUERIES x BINS rows at most
    true = 0.0
    if len(found):
        weight = (found["n"] / found.groupby("q")["n"].transform("sum")).groupby(found["bin"]).sum().sort_index()
        true = float(weight.index[int(np.searchsorted(weight.cumsum() / weight.sum(), recall))]) * top / BINS
    index.bound = max(made, true) * 1.02 + 1e-9
    return index


# --- search ---------------------------------------------------------------------------------------


def _members(shared):
    """(place, v) -> (line, cell, place, v)."""

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            if batch.num_rows:
                a, b = index.distances(_matrix(batch.column(1)))
                yield pa.RecordBatch.from_arrays([pa.array(a.argmin(1).astype(np.int32)), pa.array(b.argmin(1).astype(np.int32)), batch.column(0), batch.column(1)], ["line", "cell", "place", "v"])

    return members


def _probe(shared):
    """Members -> (line, whether the query lives in it, cells to visit in it, place, v) for each row of the grid that a query visits."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            for rows in (batch.slice(i, 1024) for i in range(0, batch.num_rows, 1024)):
                home, second = rows.column(0).to_numpy(), rows.column(1).to_numpy()
                a, b = index.distances(_matrix(rows.column(3)))
                at, line, cells = [], [], []
                for i in range(len(home)):
                    for row, seen in index.visits(a[i], b[i], int(home[i]) * len(index.second) + int(second[i])).items():
                        at.append(i)
                        line.append(row)
                        cells.append(np.array(seen, np.uint16).tobytes())
                line, at = np.array(line, np.int32), np.array(at, np.int64)
                own = np.where(line == home[at], second[at], -1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(line), pa.array(own), pa.array(cells, pa.binary()), rows.column(2).take(pa.array(at)), rows.column(3).take(pa.array(at))], ["line", "own", "cells", "place", "v"])

    return probe


def forest(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of (x, y) pairs' components, one for each node but a component's smallest."""
    node, at = np.unique(np.concatenate([x, y]), return_inverse=True)
    a, b = at[: len(x)], at[len(x) :]
    label = np.arange(len(node))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    rest = np.flatnonzero(label != np.arange(len(node)))
    return node[label[rest]], node[rest]


def _verify(threshold: float):
    """Rows of one part of the grid's row after the other, members first -> (a, b, links): links of a where b is null, else an edge."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, matrix = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
            edges = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(0)])) if batch.num_rows else []
            for lo, hi in zip(edges, [*edges[1:], batch.num_rows], strict=True):
                if (now := tuple(keys[:, lo].tolist())) != part:
                    part, held, matrix = now, [], None
                rows = batch.slice(lo, hi - lo)
                member = rows.column(4).is_null().to_numpy(zero_copy_only=False)
                if member.any():
                    own = rows.filter(pa.array(member))
                    held.append((own.column(3).to_numpy(), own.column(5).to_numpy(), _matrix(own.column(6))))
                if member.all() or not held:
                    continue
                if matrix is None:
                    cell, place, matrix = (np.concatenate(c) for c in zip(*held, strict=True))
                    order = np.argsort(cell, kind="stable")
                    cell, place, matrix = cell[order], place[order], matrix[order]
                    held = [(cell, place, matrix)]
                ask = rows.filter(pa.array(~member))
                for i in range(0, ask.num_rows, 2048):
                    yield from _near(ask.slice(i, 2048), cell, place, matrix, threshold)

    return verify


def _near(ask: pa.RecordBatch, cell: np.ndarray, place: np.ndarray, matrix: np.ndarray, threshold: float) -> Iterator[pa.RecordBatch]:
    q, names, own = _matrix(ask.column(6)), ask.column(5).to_numpy(), ask.column(3).to_numpy()
    seen = [np.frombuffer(c, np.uint16) for c in ask.column(4).to_pylist()]
    who, goal = np.repeat(np.arange(len(seen)), [len(s) for s in seen]), np.concatenate(seen)
    order = np.argsort(goal, kind="stable")
    who, goal = who[order], goal[order]
    cells, first = np.unique(goal, return_index=True)
    lo, hi = np.searchsorted(cell, cells, "left"), np.searchsorted(cell, cells, "right")
    for c, at, until, a, b in zip(cells.tolist(), first.tolist(), [*first[1:].tolist(), len(goal)], lo.tolist(), hi.tolist(), strict=True):
        for a1 in range(a, b, 4096):
            b1 = min(b, a1 + 4096)
            some = who[at:until]
            near = q[some] @ matrix[a1:b1].T >= threshold
            near &= (own[some] != c)[:, None] | (names[some][:, None] < place[None, a1:b1])  # within a cell, once
            i, j = np.nonzero(near)
            if len(i):
                x, y = names[some[i]], place[a1 + j]
                node, n = np.unique(np.concatenate([x, y]), return_counts=True)
                low, high = forest(x, y)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([node, low])), pa.array(np.concatenate([node, high]), mask=np.arange(len(node) + len(low)) < len(node)), pa.array(np.concatenate([n, np.zeros(len(low), np.int64)]))], ["a", "b", "links"])


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id IS NOT NULL AND size(embedding) > 0")
    common = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim = common["d"] if common else 1
    normal = written(rows.mapInArrow(_normal(dim), "vec_id long, v binary").distinct(), "vectors")
    one = normal.groupBy("v").agg(F.min("vec_id").alias("class_id"), F.count("*").alias("n"))
    # an id may have several vectors; the search runs over places, not ids
    one = written(one.withColumn("place", F.monotonically_increasing_id()), "places")
    index = train(one.select("place", "v"), dim, one.count(), threshold, recall)
    shared = spark.sparkContext.broadcast(index)
    members = written(one.select("place", "v").mapInArrow(_members(shared), "line int, cell int, place long, v binary"), "members")
    parts = members.groupBy("line").agg(F.ceil(F.count("*") / ROW_BLOCK).cast("int").alias("parts"))  # MOST_CENTROIDS rows at most
    parts = F.broadcast(parts)
    held = members.join(parts, "line").select("line", F.pmod(F.xxhash64("place"), "parts").cast("int").alias("part"), F.lit(0).alias("asks"), F.col("cell").alias("own"), F.lit(None).cast("binary").alias("cells"), "place", "v")
    asks = members.mapInArrow(_probe(shared), "line int, own int, cells binary, place long, v binary").join(parts, "line")
    asks = asks.select("line", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(1).alias("asks"), "own", "cells", "place", "v")
    met = held.union(asks).repartition("line", "part").sortWithinPartitions("line", "part", "asks")
    met = written(met.select("line", "part", "asks", "own", "cells", "place", "v").mapInArrow(_verify(threshold), "a long, b long, links long"), "met")
    links = met.where("b IS NULL").groupBy("a").agg(F.sum("links").alias("links"))
    groups = components(written(met.where("b IS NOT NULL").select("a", "b").distinct(), "links"))
    linked = groups.join(links, F.col("a") == F.col("node")).select(F.col("node").alias("place"), "root", "links")
    classes = one.select("place", "class_id", "n", "v").join(linked, "place", "left").where("n > 1 OR links IS NOT NULL")
    classes = written(classes.select("class_id", "n", "v", F.coalesce("root", "place").alias("root"), F.coalesce("links", F.lit(0)).alias("links")), "classes")
    ends = classes.groupBy("root").agg(F.min("class_id").alias("group_id"))
    out = normal.join(broadcast_if_small(classes), "v").join(broadcast_if_small(written(ends, "groups")), "root")
    return out.select("vec_id", "class_id", (F.col("n") - 1).alias("copies"), "links", "group_id", (F.col("vec_id") == F.col("group_id")).alias("keep"))
