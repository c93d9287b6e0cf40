"""Dense top-k: exact scans with a matrix product per Arrow batch, int8 codes, inverted lists, product quantisation.

Every search takes a table of queries (qid, vector). Queries travel to the vectors in blocks of at most
``BLOCK_BYTES``; a task returns its own k best per query, and one window over those picks the result, so what is
shuffled is tasks x queries x k rows whatever the number of vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import DimensionMismatchError, InvalidInputError
from .rank import top_k

METRICS = ("cosine", "dot", "l2")
BLOCK_BYTES = 16 << 20
TILE = 1 << 22
ROWS = 4096


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Rows of an ARRAY column without nulls, as float64."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), np.float64).reshape(len(column), dim)


def unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1)


def scores(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """(queries, rows); higher is nearer. Cosine takes unit rows; l2 is the negated square of the distance."""
    s = q @ x.T
    return s if metric != "l2" else 2 * s - (q * q).sum(1)[:, None] - (x * x).sum(1)[None, :]


def keys_of(column: pa.Array) -> np.ndarray:
    """Integers, or strings of a fixed width: both sort as Spark sorts them."""
    return column.to_numpy() if pa.types.is_integer(column.type) else np.array(column.to_pylist(), str)


def keys_from(keys: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.array(keys).cast(kind) if keys.dtype.kind in "iu" else pa.array(keys.tolist(), kind)


class Top:
    """The k best keys of each of n queries, by (score to 9 digits, key), with ``more`` other numbers for each.

    Tiles of scores are compared with each query's k-th best so far; what passes waits until as much waits as is kept.
    """

    def __init__(self, n: int, k: int, more: int = 0):
        self.n, self.k = n, k
        self.bound = np.full(n, -np.inf)
        self.kept: tuple = ()
        self.waiting: list[tuple] = []
        self.size = 0
        self.none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros((0, more)))

    def add(self, s: np.ndarray, keys: np.ndarray, lo: int = 0, slack: np.ndarray | float = 0.0, exact: Callable | None = None) -> None:
        """``s``: (queries from ``lo`` on, keys); -inf and NaN are no scores. ``exact``: (queries, columns) -> their scores, -inf for none,
        and the other numbers, if there are any; ``s`` may then be off by ``slack`` for each query."""
        if not s.size:
            return
        slack = np.broadcast_to(np.asarray(slack, float), len(s))
        cut = self.bound[lo : lo + len(s)].copy()
        if s.shape[1] > self.k and (open_ := np.flatnonzero(cut == -np.inf)).size:
            # with few scores a row's k-th is -inf, and all of them pass; NaN would sort as the best
            some = s[open_] if len(open_) < len(s) else s
            cut[open_] = np.partition(np.where(np.isnan(some), -np.inf, some), -self.k, axis=1)[:, -self.k] - slack[open_]
        cut = np.maximum(cut - slack - 1e-9, -np.finfo(s.dtype).max)
        least = cut.astype(s.dtype)
        above = least > cut
        least[above] = np.nextafter(least[above], s.dtype.type(-np.inf))
        passed = np.flatnonzero(s >= least[:, None])
        for i in range(0, len(passed), 1 << 16):
            at, of = np.divmod(passed[i : i + (1 << 16)], s.shape[1])
            value, rest = (s[at, of].astype(float), self.none[3][:0]) if exact is None else exact(at + lo, of)
            ok = value > -np.inf
            if not ok.all():
                at, of, value, rest = at[ok], of[ok], value[ok], rest[ok] if len(rest) else rest
            if len(at):
                self.waiting.append((at + lo, keys[of], value, rest if len(rest) else np.zeros((len(at), self.none[3].shape[1]))))
                self.size += len(at)
            if self.size > max(self.n * self.k, 1 << 16):
                self._merge()

    def _merge(self) -> None:
        if not self.waiting:
            return
        at, keys, value, rest = (np.concatenate(p) for p in zip(*([self.kept] if self.kept else []), *self.waiting, strict=True))
        digits = np.round(value, 9)
        order = np.lexsort((keys, -digits, at))
        own = at[order]
        place = np.arange(len(own)) - np.searchsorted(own, own)
        order = order[place < self.k]
        last = own[place == self.k - 1]
        self.kept = (at[order], keys[order], value[order], rest[order])
        self.waiting, self.size = [], 0
        self.bound[last] = digits[order][place[place < self.k] == self.k - 1]

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Query numbers, keys, scores and the other numbers."""
        self._merge()
        return self.kept or self.none


class Rough:
    """Products in single precision, where they can't overflow, with a bound of their error; exact scores of pairs are in double."""

    def __init__(self, q: np.ndarray, metric: str, present: np.ndarray | None = None):
        """``present``: (queries, dimensions), 1 where a query has one; a row that shares none with it then has no score."""
        self.q, self.metric, self.present = q, metric, present
        self.wide = np.concatenate([2 * q, np.full((len(q), 1), -1.0)], 1) if metric == "l2" else q
        self.norm = np.linalg.norm(self.wide, axis=1)
        self.single = self.wide.astype(np.float32) if len(q) and self.norm.max() < 1e15 else None
        self.constant = (q * q).sum(1) if metric == "l2" else None

    def add_to(self, top: Top, x: np.ndarray, keys: np.ndarray, present: np.ndarray | None = None, more: Callable | None = None) -> None:
        """All rows of ``x``, of unit length for cosine. ``present``: which dimensions each has. ``more``: (queries, rows) -> other numbers."""
        wide = np.concatenate([x, (x * x).sum(1)[:, None]], 1) if self.metric == "l2" else x
        far = np.nan_to_num(np.linalg.norm(wide, axis=1), nan=0, posinf=np.inf).max(initial=0)  # of the rows that have a score
        q, x_ = (self.single, wide.astype(np.float32)) if self.single is not None and far < 1e15 else (self.wide, wide)
        unit_ = 2.0**-23 if q.dtype == np.float32 else 2.0**-52
        step = max(1, min(4096, TILE // max(1, len(x))))
        for lo in range(0, len(q), step):
            some = slice(lo, lo + step)
            s = q[some] @ x_.T
            if self.constant is not None:
                s -= self.constant[some, None].astype(s.dtype)
            slack = (wide.shape[1] + 8) * unit_ * (self.norm[some] * far + (0 if self.constant is None else self.constant[some]))
            if present is not None and self.present is not None and (top.bound[some] <= slack + 2e-9).any():  # else no 0 passes
                s[self.present[some] @ present.T == 0] = -np.inf
            top.add(s, keys, lo, slack, lambda at, of: (self.pairs(at, x, of), more(at, of) if more else np.zeros((0, 0))))

    def exact(self, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        q = self.q[at]
        s = np.einsum("ij,ij->i", q, x)
        return s if self.metric != "l2" else 2 * s - np.einsum("ij,ij->i", q, q) - np.einsum("ij,ij->i", x, x)

    def pairs(self, at: np.ndarray, x: np.ndarray, of: np.ndarray) -> np.ndarray:
        few = max(1, TILE // max(1, x.shape[1]))
        return np.concatenate([self.exact(at[i : i + few], x[of[i : i + few]]) for i in range(0, len(at), few)])


def best_rows(top: Top, qids: np.ndarray, kind: pa.DataType | None) -> Iterator[pa.RecordBatch]:
    at, keys, value, _ = top.best()
    for lo in range(0, len(at), 1 << 16):
        some = slice(lo, lo + (1 << 16))
        yield pa.RecordBatch.from_arrays([pa.array(qids[at[some]]), keys_from(keys[some], kind), pa.array(value[some])], ["qid", "key", "score"])


def _scan(shared, k: int, dim: int, metric: str):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, raw = shared.value
        q = Rough(np.frombuffer(raw, np.float64).reshape(-1, dim), metric)
        top, kind = Top(len(qids), k), None
        for batch in batches:
            kind = batch.schema.field(0).type
            for lo in range(0, batch.num_rows, ROWS):
                rows = batch.slice(lo, ROWS)
                x = matrix(rows.column(1), dim)
                q.add_to(top, unit(x) if metric == "cosine" else x, keys_of(rows.column(0)))
        yield from best_rows(top, qids, kind)

    return scan


def codes_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """int8 codes of rows, and their scales; halves go away from zero."""
    scale = np.abs(x).max(1, initial=0) / 127
    y = x / np.where(scale > 0, scale, 1)[:, None]
    return np.clip(np.sign(y) * np.floor(np.abs(y) + 0.5), -127, 127), scale


def _scan_codes(shared, k: int, dim: int, metric: str, stored: bool):
    """As ``_scan``, by the products of codes; a hit brings its exact score along."""
    kind = np.float32 if dim <= 1024 else np.float64  # exact: 127 * 127 * dim < 2^24

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, raw = shared.value
        full = Rough(np.frombuffer(raw, np.float64).reshape(-1, dim), metric)
        q, q_scale = codes_of(full.q)
        q = q.astype(kind)
        top, key_type = Top(len(qids), k, 1), None
        for batch in batches:
            key_type = batch.schema.field(0).type
            for lo in range(0, batch.num_rows, ROWS):
                rows = batch.slice(lo, ROWS)
                v = matrix(rows.column(1), dim)
                v = unit(v) if metric == "cosine" else v
                code, scale = (matrix(rows.column(2), dim), rows.column(3).to_numpy()) if stored else codes_of(v)
                keys, code = keys_of(rows.column(0)), code.astype(kind)
                step = max(1, min(4096, TILE // len(keys)))
                for at in range(0, len(q), step):
                    some = slice(at, at + step)
                    s = (q[some] @ code.T).astype(np.float64) * q_scale[some, None] * scale[None, :]
                    top.add(s, keys, at, 0.0, lambda i, j, s=s, at=at, v=v, full=full: (s[i - at, j], full.pairs(i, v, j)[:, None]))
        at, keys, value, rest = top.best()
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(qids[at]), keys_from(keys, key_type), pa.array(value), pa.array(rest[:, 0])], ["qid", "key", "score", "exact"])

    return scan


def check_metric(metric: str) -> None:
    if metric not in METRICS:
        raise InvalidInputError(f"metric {metric!r}; expected one of {', '.join(METRICS)}")


def _packed(dim: int):
    """Queries (qid, vector) -> (qids, vectors) as bytes of int64 and float64, at most BLOCK_BYTES a row; ``wrong``: a query that isn't finite of ``dim``."""
    per = max(1, BLOCK_BYTES // (8 * dim))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in (batch.slice(i, per) for i in range(0, batch.num_rows, per)):
                qids, lists = rows.column(0), rows.column(1)
                good = pc.fill_null(pc.equal(pc.list_value_length(lists), dim), False).to_numpy(zero_copy_only=False)
                if good.all():
                    x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)  # nulls become NaN
                    good = np.isfinite(x).all(1)
                if not good.all():
                    yield pa.RecordBatch.from_arrays([pa.array([b""]), pa.array([b""]), pa.array([str(qids[int(np.argmin(good))].as_py())])], ["qids", "vectors", "wrong"])
                    return
                yield pa.RecordBatch.from_arrays([pa.array([qids.to_numpy().astype(np.int64).tobytes()]), pa.array([x.tobytes()]), pa.array([None], pa.string())], ["qids", "vectors", "wrong"])

    return pack


def query_blocks(queries: DataFrame, dim: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(qids, matrix) of the queries, in blocks of at most BLOCK_BYTES each; qids are integers."""
    per = max(1, BLOCK_BYTES // (8 * dim))
    asked = queries.select(F.col("qid").cast("long").alias("qid"), F.col("vector").cast("array<double>").alias("vector"))
    qids, x = np.zeros(0, np.int64), np.zeros((0, dim))
    for row in asked.mapInArrow(_packed(dim), "qids binary, vectors binary, wrong string").toLocalIterator(prefetchPartitions=True):
        if row["wrong"] is not None:
            raise DimensionMismatchError(f"query {row['wrong']}: a finite vector of {dim} is needed")
        qids = np.concatenate([qids, np.frombuffer(row["qids"], np.int64)])
        x = np.concatenate([x, np.frombuffer(row["vectors"], np.float64).reshape(-1, dim)])
        while len(qids) >= per:
            yield qids[:per], x[:per]
            qids, x = qids[per:], x[per:]
    if len(qids):
        yield qids, x


def _shared_blocks(rows: DataFrame, queries: DataFrame, dim: int, metric: str) -> tuple[DataFrame, list]:
    """The queries' blocks as broadcasts, and ``rows`` in so few partitions as keep all cores busy with that many blocks: each
    partition returns k rows for each query."""
    context = rows.sparkSession.sparkContext
    blocks = [context.broadcast((qids, (unit(q) if metric == "cosine" else q).tobytes())) for qids, q in query_blocks(queries, dim)]
    return gathered(rows, len(blocks)), blocks


def gathered(rows: DataFrame, blocks: int) -> DataFrame:
    return rows.coalesce(max(1, -(-4 * rows.sparkSession.sparkContext.defaultParallelism // max(1, blocks))))


def key_type(df: DataFrame, key: str) -> str:
    return "string" if df.schema[key].dataType.simpleString() == "string" else "long"


def usable(vectors: DataFrame, dim: int, key: str, embedding: str, *more: str) -> DataFrame:
    """(key, v, more..) of the rows with a key and a finite vector of ``dim``."""
    rows = vectors.where(F.size(embedding) == dim).select(F.col(key).cast(key_type(vectors, key)).alias("key"), F.col(embedding).cast("array<float>").alias("v"), *more)
    return rows.where("key IS NOT NULL AND NOT exists(v, x -> x IS NULL OR isnan(x))")


def dense_top_k(vectors: DataFrame, queries: DataFrame, k: int, dim: int, metric: str = "cosine", key: str = "chunk_id", embedding: str = "embedding") -> DataFrame:
    """(qid, key, score, rank), exact. Vectors that are null or of another length are left out; filter ``vectors`` beforehand."""
    check_metric(metric)
    spark = vectors.sparkSession
    rows, kind = usable(vectors, dim, key, embedding), key_type(vectors, key)
    out = None
    rows, blocks = _shared_blocks(rows, queries, dim, metric)
    for shared in blocks:
        hits = rows.mapInArrow(_scan(shared, k, dim, metric), f"qid long, key {kind}, score double")
        out = hits if out is None else out.unionByName(hits)
    if out is None:
        out = spark.createDataFrame([], f"qid long, key {kind}, score double")
    return top_k(out.withColumnRenamed("key", key), k, key)


def rescore(candidates: DataFrame, vectors: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", key: str = "chunk_id", embedding: str = "embedding") -> DataFrame:
    """Exact scores of (qid, key) candidates, and their k best."""
    from ..functions.vectors import cosine, dot, l2_squared

    a, b = F.col("vector"), F.col(embedding)
    value = {"cosine": lambda: cosine(a, b), "dot": lambda: dot(a, b), "l2": lambda: -l2_squared(a, b)}[metric]()
    rows = candidates.select("qid", key).join(vectors.select(key, embedding), key).join(queries.select("qid", "vector"), "qid")
    return top_k(rows.select("qid", key, value.alias("score")), k, key)


def int8_top_k(vectors: DataFrame, queries: DataFrame, k: int, pool: int | None = None, key: str = "chunk_id", embedding: str = "embedding", metric: str = "cosine") -> DataFrame:
    """Scan of int8 codes, then exact scores of the ``max(4 pool, pool + 16)`` best. Not for l2.

    ``vectors`` may carry stored columns ``codes`` and ``scale``; otherwise they are computed.
    """
    check_metric(metric)
    if metric == "l2":
        raise InvalidInputError("int8 codes don't order l2 distances")
    pool = pool or k
    wide = max(4 * pool, pool + 16)
    first = queries.select(F.size("vector")).first()
    dim = first[0] if first else 1
    stored = "codes" in vectors.columns
    rows, kind = usable(vectors, dim, key, embedding, *(["codes", "scale"] if stored else [])), key_type(vectors, key)
    schema = f"qid long, key {kind}, score double, exact double"
    out = None
    rows, blocks = _shared_blocks(rows, queries, dim, metric)
    for shared in blocks:
        hits = rows.mapInArrow(_scan_codes(shared, wide, dim, metric, stored), schema)
        out = hits if out is None else out.unionByName(hits)
    if out is None:
        out = vectors.sparkSession.createDataFrame([], schema)
    near = top_k(out.withColumnRenamed("key", key), wide, key)
    return top_k(near.select("qid", key, F.col("exact").alias("score")), k, key)


def max_sim_top_k(hits: DataFrame, queries: DataFrame, encode: Callable[[list[str]], list[np.ndarray]], k: int, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """(qid, key, score, rank): hits (qid, key, text) ordered anew by late interaction.

    ``encode`` gives each text's token vectors (tokens x dimension); a score is the sum over the query's tokens of the largest
    product with a token of the hit. A text without tokens scores 0. Texts are encoded once for each batch.
    """
    kind = key_type(hits, key)
    rows = hits.select("qid", F.col(key).cast(kind).alias("key"), F.col(text).alias("_hit")).join(queries.select("qid", F.col("text").alias("_asked")), "qid").select(F.col("qid").cast("long").alias("qid"), "key", "_hit", "_asked")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, asked = ([t or "" for t in batch.column(i).to_pylist()] for i in (2, 3))
            names = list(dict.fromkeys(found + asked))
            of = dict(zip(names, encode(names), strict=True))
            value = [float((of[q] @ of[d].T).max(1).sum()) if len(of[q]) and len(of[d]) else 0.0 for q, d in zip(asked, found, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(value, pa.float64())], ["qid", "key", "score"])

    return top_k(rows.mapInArrow(score, f"qid long, key {kind}, score double").withColumnRenamed("key", key), k, key)
