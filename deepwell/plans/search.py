"""Search over a batch of queries: filter, signals, fusion."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidInputError
from ..operators import dense, filters, lexical, rank, sparse
from .config import Config
from .indexes import Index

Searcher = Callable[[DataFrame, DataFrame, int], DataFrame]
MODES = ("dense", "keyword", "sparse", "hybrid", "auto")


def resolve_mode(mode: str, columns: list[str]) -> str:
    """``auto`` by what the queries carry: text and vector hybrid, else the one there is."""
    if mode not in MODES:
        raise InvalidInputError(f"mode {mode!r}; expected one of {', '.join(MODES)}")
    if mode != "auto":
        return mode
    text, vector, thin = ("text" in columns, "vector" in columns, "sparse" in columns)
    if text and vector:
        return "hybrid"
    if vector or text or thin:
        return "dense" if vector else "keyword" if text else "sparse"
    raise InvalidInputError("a query needs a text, a vector or a sparse vector")


def signals(chunks: DataFrame, queries: DataFrame, pool: int, config: Config = Config(), mode: str | None = None, spec: dict | str | None = None, dim: int | None = None, index: Index | None = None, allowed: DataFrame | None = None, searcher: Searcher | None = None, vectors: DataFrame | None = None) -> dict[str, tuple[DataFrame, float]]:
    """By name (dense, keyword, sparse): (qid, chunk_id, score, rank) to ``pool``, and its weight."""
    if vectors is not None and index is not None:
        raise InvalidInputError("an index is of chunks that hold their vectors")
    mode = resolve_mode(mode or config.mode, queries.columns)
    kept = filters.filtered(chunks, spec) if allowed is None else allowed
    narrowed = kept.select("chunk_id") if spec or allowed is not None else None
    holds = chunks if vectors is None else vectors
    near = kept if vectors is None else vectors if narrowed is None else vectors.join(narrowed, "chunk_id", "left_semi")
    out: dict[str, tuple[DataFrame, float]] = {}
    if mode in ("dense", "hybrid") and "vector" in queries.columns:
        q = queries.where("vector IS NOT NULL").select("qid", "vector")
        width = dim or (first[0] if (first := holds.where("embedding IS NOT NULL").select(F.size("embedding")).first()) else 0)
        if width:
            if searcher is not None:
                hits = rank.top_k(searcher(near, q, pool).select("qid", "chunk_id", "score"), pool)
            elif config.index != "flat" and index is not None and index.centroids is not None and index.dim == width and index.metric == config.metric:
                hits = index.dense(chunks, q, pool, config.nprobe, narrowed)
            elif config.quantization == "sq8":
                hits = dense.int8_top_k(near, q, pool, pool, metric=config.metric)
            else:
                hits = dense.dense_top_k(near, q, pool, width, config.metric)
            out["dense"] = (hits, config.dense_weight)
    if mode in ("keyword", "hybrid") and "text" in queries.columns:
        asked = queries.where("text IS NOT NULL").select("qid", "text")
        by = lexical.bm25_top_k if index is None else index.bm25
        out["keyword"] = (by(chunks, asked, pool, narrowed), config.bm25_weight)
    if "sparse" in queries.columns and "sparse" in chunks.columns:
        asked = sparse.sparse_postings(queries.where("sparse IS NOT NULL"), "qid")
        out["sparse"] = (sparse.sparse_top_k(sparse.sparse_postings(kept.where("sparse IS NOT NULL")), asked, pool), config.sparse_weight)
    if not out:
        raise InvalidInputError(f"mode {mode!r} has nothing to search with")
    return out


def search(chunks: DataFrame, queries: DataFrame, k: int, config: Config = Config(), mode: str | None = None, spec: dict | str | None = None, dim: int | None = None, index: Index | None = None, allowed: DataFrame | None = None, searcher: Searcher | None = None, vectors: DataFrame | None = None) -> DataFrame:
    """(qid, chunk_id, score, rank). ``chunks``: chunk_id, text, embedding, sparse and metadata; ``queries``: qid and any of text, vector, sparse.

    The filter (``spec`` over the chunks' columns, or ``allowed``, the chunks that may be returned) applies to every signal
    before scores, statistics stay those of all chunks. A sparse query joins the fusion in every mode. With an ``index``,
    postings come from it, and vectors from ``config.nprobe`` of its lists unless ``config.index`` is ``flat``. A ``searcher`` of the caller's takes the dense part:
    (chunks that may be returned, queries (qid, vector), k) -> (qid, chunk_id, score). ``vectors``: (chunk_id, embedding) where these
    lie in a table apart; texts then meet no vector. Without a filter all of them are searched, also those without a chunk.
    """
    found = list(signals(chunks, queries, max(4 * k, 50), config, mode, spec, dim, index, allowed, searcher, vectors).values())
    if len(found) == 1:
        return found[0][0].where(F.col("rank") <= k)
    return rank.top_k(rank.fuse(found), k)


def explained(chunks: DataFrame, queries: DataFrame, k: int, config: Config = Config(), **options: object) -> DataFrame:
    """The hits of ``search`` with where each signal ranked and scored them, and what it added: (qid, chunk_id, score, rank, signals)."""
    found = signals(chunks, queries, max(4 * k, 50), config, **options)  # type: ignore[arg-type]
    parts = [hits.select("qid", "chunk_id", F.struct(F.lit(name).alias("signal"), F.col("rank").alias("rank"), F.col("score").alias("score"), (F.lit(float(w)) / (rank.RRF_K + F.col("rank"))).alias("part")).alias("s")) for name, (hits, w) in found.items()]
    rows = parts[0]
    for other in parts[1:]:
        rows = rows.unionByName(other)
    fused = rows.groupBy("qid", "chunk_id").agg(F.sum("s.part").alias("score"), F.array_sort(F.collect_list("s")).alias("signals"))
    return rank.top_k(fused, k)
