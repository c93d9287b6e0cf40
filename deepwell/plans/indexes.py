"""Stored indexes of a set of chunks: postings clustered by term, inverted lists of vectors.

``build`` writes them to a folder once; searches read the postings of the asked terms and the lists that are probed (both are
sorted or partitioned by what is asked, so that Parquet skips the rest). The chunks may move on: rows whose chunk is gone or
has other content are left out, and chunks that the index lacks are searched as they are, so results are those of the
current chunks.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import inverted, lexical
from ..sources.scratch import small, written


def _stamped(chunks: DataFrame) -> DataFrame:
    """With a digest of what is indexed."""
    return chunks.withColumn("_stamp", F.xxhash64("text", *(["embedding"] if "embedding" in chunks.columns else [F.lit("")])))


def build(chunks: DataFrame, folder: str, dim: int | None, metric: str = "cosine") -> Index:
    """``chunks``: chunk_id, text, and embedding if there is one."""
    spark = chunks.sparkSession
    rows = written(_stamped(chunks).select("chunk_id", "text", "_stamp", *(["embedding"] if dim else [])), "indexed")
    every = written(lexical.counted(rows, ("chunk_id", "_stamp")), "terms")  # ranges are drawn from a sample, which would make them twice
    every.where("term IS NULL").select("chunk_id", "dl", "_stamp").write.parquet(f"{folder}/lengths")
    every.where("term IS NOT NULL").repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{folder}/postings")
    settings = {"dim": dim, "metric": metric, "centroids": None}
    if dim and (n := rows.where(F.size("embedding") == dim).count()):
        centroids = inverted.train_lists(rows, dim, n, metric=metric)
        inverted.assign(rows.select("chunk_id", "embedding", "_stamp"), centroids, metric=metric).repartition("list_id").write.partitionBy("list_id").parquet(f"{folder}/lists")
        settings["centroids"] = centroids.tolist()
    spark.createDataFrame([(json.dumps(settings),)], "settings string").coalesce(1).write.parquet(f"{folder}/settings")
    return Index(spark, folder)


class Index:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._asked: tuple[DataFrame, DataFrame, DataFrame] | None = None
        settings = json.loads(spark.read.parquet(f"{folder}/settings").first()[0])
        self.dim, self.metric = settings["dim"], settings["metric"]
        self.centroids = np.array(settings["centroids"], float) if settings["centroids"] else None

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def _parts(self, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(chunk_id, _stamp) of the chunks that the index has as they are, and the chunks that it lacks. Both signals of a search ask once."""
        if self._asked is None or self._asked[0] is not chunks:
            now = _stamped(chunks)
            marks = written(now.select("chunk_id", "_stamp"), "now")
            have = self._read("lengths").select("chunk_id", "_stamp")
            kept = small(written(marks.join(have, ["chunk_id", "_stamp"], "left_semi"), "kept"))
            new = written(marks.join(have, ["chunk_id", "_stamp"], "left_anti").select("chunk_id"), "new")
            if new.head(1):
                fresh = written(now.join(have, ["chunk_id", "_stamp"], "left_anti"), "fresh")
            else:
                fresh = self.spark.createDataFrame([], now.schema)
            self._asked = (chunks, kept, fresh)
        return self._asked[1:]

    def bm25(self, chunks: DataFrame, queries: DataFrame, k: int, accept: DataFrame | None = None) -> DataFrame:
        """(qid, chunk_id, score, rank): that of ``lexical.bm25_top_k`` over the current chunks."""
        kept, fresh = self._parts(chunks)
        asked = small(written(lexical.query_terms(queries).select("term").distinct(), "asked"))
        same = ["chunk_id", "_stamp"]
        old = self._read("postings").join(asked, "term", "left_semi").join(kept, same, "left_semi").drop("_stamp")
        new = lexical.postings(fresh).join(asked, "term", "left_semi")
        lengths = self._read("lengths").join(kept, same, "left_semi").select("dl").union(lexical.lengths(fresh).select("dl"))
        stats = lengths.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total_len"))
        stats = stats.withColumn("avg_len", F.when(F.col("n") > 0, F.col("total_len") / F.col("n")).otherwise(0.0))
        return lexical.bm25_best(old.unionByName(new.select(*old.columns)), stats, queries, k, accept)

    def dense(self, chunks: DataFrame, queries: DataFrame, k: int, nprobe: int, accept: DataFrame | None = None) -> DataFrame:
        """(qid, chunk_id, score, rank) within the probed lists and all that no list has yet. A query that a filter starves of k
        hits is asked again in every list."""
        kept, fresh = self._parts(chunks)
        lists = self._read("lists").join(kept, ["chunk_id", "_stamp"], "left_semi")
        if accept is not None:
            lists, fresh = lists.join(accept.select("chunk_id"), "chunk_id", "left_semi"), fresh.join(accept.select("chunk_id"), "chunk_id", "left_semi")
        fresh = fresh.select("chunk_id", "embedding")
        hits = written(inverted.list_top_k(lists, queries, self.centroids, k, nprobe, self.metric, fresh=fresh), "hits")
        full = hits.groupBy("qid").count().where(F.col("count") >= k).select("qid")
        starved = queries.join(full, "qid", "left_anti")
        if nprobe >= len(self.centroids) or not starved.head(1):
            return hits
        again = inverted.list_top_k(lists, starved, self.centroids, k, len(self.centroids), self.metric, fresh=fresh)
        return hits.join(full, "qid", "left_semi").unionByName(again)
