"""Questions in parts: subqueries, fusion across them with coverage, boosts, recall-safe reranking."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window as W

from ..errors import ConfigurationError
from ..functions.text import query_key
from .filters import flag, typed
from .rank import DIGITS, RRF_K, fuse_queries

MOST_SUBQUERIES = 6
RERANK_WINDOW = 32


def subqueries(questions: DataFrame, parts: Callable[[Column], Column], most: int = MOST_SUBQUERIES) -> DataFrame:
    """(qid, sub_idx, sub_id, text, weight): each question itself first, then its distinct parts, ``most`` of them.

    ``parts`` maps the question's column to an ARRAY<STRING>; blank parts and repetitions are left out, and a question
    without parts is one query.
    """
    some = F.filter(F.coalesce(parts(F.col("question")), F.array().cast("array<string>")), lambda s: F.length(F.trim(s)) > 0)
    rows = questions.select("qid", F.posexplode(F.concat(F.array("question"), some)).alias("at", "text"))
    first = W.partitionBy("qid", "_key").orderBy("at")
    rows = rows.withColumn("_key", query_key(F.col("text"))).withColumn("_n", F.row_number().over(first)).where("_n = 1")
    rows = rows.withColumn("sub_idx", F.row_number().over(W.partitionBy("qid").orderBy("at")) - 1).where(F.col("sub_idx") <= most)
    return rows.select("qid", "sub_idx", (F.col("qid").cast("long") * 64 + F.col("sub_idx")).alias("sub_id"), F.trim("text").alias("text"), F.lit(1.0).alias("weight"))


def split_words(question: Column) -> Column:
    """At " and ", commas, semicolons and colons; parts of three words or more."""
    return F.filter(F.split(question, "(?i)\\s+and\\s+|[,;:]"), lambda s: F.regexp_count(s, F.lit("\\S+")) >= 3)


def _reserved(hits: list[tuple[int, int, str]], coverage: int) -> list[str]:
    """Ids that stand for their subquery: its first ones that stand for no other yet. ``hits``: (sub_idx, rank, id), sorted."""
    taken: dict[int, int] = {}
    out: dict[str, None] = {}
    for sub, _, key in hits:
        if taken.get(sub, 0) < coverage and key not in out:
            out[key] = None
            taken[sub] = taken.get(sub, 0) + 1
    return list(out)


def reservations(hits: DataFrame, coverage: int = 1, key: str = "chunk_id") -> DataFrame:
    """(qid, key): reserved for coverage. Which ids a subquery reserves depends on those before it, so a question is one group."""
    kind = hits.schema["qid"].dataType.simpleString()
    arrow = to_arrow_schema(StructType.fromDDL(f"qid {kind}, `{key}` string"))

    def one(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("sub_idx", "rank", key)), strict=True))
        qid = table.column("qid")[0].as_py()
        alone = len({r[0] for r in rows}) < 2
        return pa.Table.from_pylist([{"qid": qid, key: k} for k in ([] if alone else _reserved(rows, coverage))], schema=arrow)

    return hits.select("qid", "sub_idx", "rank", F.col(key).cast("string").alias(key)).groupBy("qid").applyInArrow(one, f"qid {kind}, `{key}` string")


def fused(hits: DataFrame, coverage: int = 1, k: int | None = None, key: str = "chunk_id") -> DataFrame:
    """(qid, key, score, reserved, rank, best_score, best_sub). ``hits``: (qid, sub_idx, weight, key, score, rank).

    Reserved ids rise above all others by the question's largest score plus 1; ties fall to the key as a string.
    """
    rows = fuse_queries(hits, key, RRF_K).withColumn("_key", F.col(key).cast("string"))
    if coverage > 0:
        kept = reservations(hits, coverage, key).withColumnsRenamed({key: "_key"}).withColumn("reserved", F.lit(True))
        rows = rows.join(kept, ["qid", "_key"], "left").withColumn("reserved", F.coalesce("reserved", F.lit(False)))
    else:
        rows = rows.withColumn("reserved", F.lit(False))
    lift = F.max("score").over(W.partitionBy("qid")) + 1
    rows = rows.withColumn("score", F.col("score") + F.when(F.col("reserved"), lift).otherwise(0.0))
    rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(F.round("score", DIGITS).desc(), "_key")))
    rows = rows if k is None else rows.where(F.col("rank") <= k)
    return rows.select("qid", key, "score", "reserved", "rank", "best_score", "best_sub")


def boosted(hits: DataFrame, boosts: Sequence[dict], key: str = "chunk_id") -> DataFrame:
    """Scores times the weight of each boost whose filter a hit meets; ranked anew. Hits carry the metadata columns."""
    resolve = typed(hits)
    score = F.col("score")
    for boost in boosts:
        if "filter" not in boost:
            raise ConfigurationError("a boost needs a filter")
        score = score * F.when(flag(boost["filter"], resolve), float(boost.get("weight", 1.0))).otherwise(1.0)
    rows = hits.withColumn("score", score)
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(F.round("score", DIGITS).desc(), F.col(key).cast("string"))))


def reranked(hits: DataFrame, rerank: Callable[[int, list[dict]], list[dict]], k: int, window: int = RERANK_WINDOW, key: str = "chunk_id") -> DataFrame:
    """With ``rank`` replaced, and ``rerank_error``. ``rerank(qid, rows)`` may only reorder the first max(window, k): what it
    leaves out follows in the old order, the rest stays behind; if it fails the old order is kept."""
    fields = [f for f in hits.schema if f.name != "rerank_error"]
    schema = StructType(fields).add("rerank_error", "string")
    arrow = to_arrow_schema(schema)

    def one(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["rank"])
        head, tail = rows[: max(window, k)], rows[max(window, k) :]
        error = None
        try:
            got = list(rerank(rows[0]["qid"], [dict(r) for r in head]))
            by = {r[key]: r for r in head}
            names = list(dict.fromkeys(r[key] for r in got if r[key] in by))
            head = [by[n] | {"score": s} for n in names for s in [next(r["score"] for r in got if r[key] == n)]] + [r for r in head if r[key] not in set(names)]
        except Exception as e:  # a reranker that fails must not lose results
            error = f"{type(e).__name__}: {e}"
        return pa.Table.from_pylist([r | {"rank": i, "rerank_error": error} for i, r in enumerate(head + tail, 1)], schema=arrow)

    return hits.groupBy("qid").applyInArrow(one, schema)
