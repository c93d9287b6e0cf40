"""The registered queries of the library's own operators, and the SQL they are held against.

Each runs over its whole tables. Scores are rounded at the end only, as floats are summed in another order elsewhere.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .functions import text as X
from .functions import vectors as V
from .functions.embedding import HashedNgrams, embed
from .operators import chunking, context, dense, evaluation, filters, inverted, lexical, multiquery, rank, sparse, verification, versions
from .plans import indexes
from .plans.config import Config
from .plans.search import search
from .sources import files, parsers
from .sources.scratch import folder, small, written
from .sources.store import Store

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
DIM = 64


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; its texts reach Python in batches of bounded bytes, not only of rows."""
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    have = (spark.conf.get(limit, None) or "").rstrip("b")
    if not have.isdigit() or not 0 < int(have) <= BATCH_BYTES:
        spark.conf.set(limit, str(BATCH_BYTES))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").withColumn("chunk_id", F.col("doc_id"))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").withColumn("chunk_id", F.col("vec_id"))


def _benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")


def _class_means(vectors: DataFrame) -> DataFrame:
    """(qid, vector): the mean vector of each label."""
    means = vectors.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy(F.col("label").cast("long").alias("qid")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda p: p["m"]).alias("vector"))


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


_TOKENS = r"list_transform(regexp_extract_all(text, '[\p{L}\p{N}]+'), lambda x: lower(x))"
_MEANS = "means AS (SELECT label::BIGINT AS qid, list(m ORDER BY i) AS vector FROM (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, range(1, 65) t(i) GROUP BY label, i) GROUP BY label)"
_BM25 = rf"""
tokens AS (SELECT doc_id, {_TOKENS} AS ts FROM documents),
post AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(ts) AS dl, unnest(ts) AS term FROM tokens) GROUP BY doc_id, dl, term),
stats AS (SELECT count(*) AS n, avg(len(ts)) AS avg_len FROM tokens),
terms AS (SELECT DISTINCT item_id AS qid, unnest({_TOKENS}) AS term FROM benchmark),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
scored AS (SELECT qid, doc_id, sum(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avg_len))) AS score
           FROM terms JOIN post USING (term) JOIN df USING (term), stats GROUP BY qid, doc_id)"""


def _sql_top(source: str, k: int, key: str = "doc_id", out: str = "chunk_id") -> str:
    return f"SELECT qid, {key} AS {out}, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, {key}) AS rank FROM {source}) WHERE rank <= {k}"


# ---- lexical


@query(f"SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({_TOKENS}) AS term FROM documents) GROUP BY term")
def term_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.document_frequency(lexical.postings(_documents(spark, sf_dir)))


@query(f"SELECT doc_id AS chunk_id, len({_TOKENS}) AS dl FROM documents")
def doc_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.lengths(_documents(spark, sf_dir))


@query(f"SELECT count(*) AS n, sum(len({_TOKENS}))::BIGINT AS total_len, round(avg(len({_TOKENS})), 6) AS avg_len FROM documents")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(lexical.corpus_stats(_documents(spark, sf_dir)), "avg_len")


@query(f"WITH {_BM25} {_sql_top('scored', 10)}")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(lexical.bm25_top_k(_documents(spark, sf_dir), _benchmark_queries(spark, sf_dir), 10), "score")


@query(f"WITH {_BM25}, ok AS (SELECT s.* FROM scored s JOIN documents d USING (doc_id) WHERE d.lang = 'en' AND d.n_chars >= 200) {_sql_top('ok', 10)}")
def bm25_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    accept = filters.filtered(docs, {"lang": "en", "n_chars": {"$gte": 200}})
    return _rounded(lexical.bm25_top_k(docs, _benchmark_queries(spark, sf_dir), 10, accept), "score")


# ---- dense, sparse, hybrid

_SCORE = {"cosine": "list_dot_product(vector, v) / (sqrt(list_dot_product(vector, vector)) * sqrt(list_dot_product(v, v)))", "dot": "list_dot_product(vector, v)", "l2": "-(list_dot_product(vector, vector) + list_dot_product(v, v) - 2 * list_dot_product(vector, v))"}


def _dense_sql(metric: str, k: int, where: str = "true", queries: str = _MEANS, name: str = "means") -> str:
    return f"WITH {queries}, scored AS (SELECT qid, vec_id, {_SCORE[metric]} AS score FROM {name}, (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE {where})) {_sql_top('scored', k, 'vec_id')}"


_ALL = "everyone AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS vector FROM embeddings)"


def _dense(spark: SparkSession, sf_dir: str, metric: str, where: dict | None = None) -> DataFrame:
    vectors = _vectors(spark, sf_dir)
    return _rounded(dense.dense_top_k(filters.filtered(vectors, where), _class_means(vectors), 10, DIM, metric), "score")


@query(_dense_sql("cosine", 10))
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dense(spark, sf_dir, "cosine")


@query(_dense_sql("dot", 10))
def dot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dense(spark, sf_dir, "dot")


@query(_dense_sql("l2", 10))
def l2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dense(spark, sf_dir, "l2")


@query(_dense_sql("cosine", 10, "label IN (1, 3, 5) AND label <> 3"))
def dense_filtered_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dense(spark, sf_dir, "cosine", {"label": {"$in": [1, 3, 5], "$ne": 3}})


@query(_dense_sql("cosine", 5, queries=_ALL, name="everyone"))
def batch_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _vectors(spark, sf_dir)
    everyone = vectors.select(F.col("vec_id").alias("qid"), F.col("embedding").cast("array<double>").alias("vector"))
    return _rounded(dense.dense_top_k(vectors, everyone, 5, DIM), "score")


_CODES = "coded AS (SELECT vec_id, embedding, list_transform(v, lambda x: greatest(-127, least(127, round(x / scale)))) AS codes, scale FROM (SELECT vec_id, embedding, v, list_max(list_transform(v, lambda x: abs(x))) / 127 AS scale FROM (SELECT vec_id, embedding, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings)))"


@query(f"WITH {_CODES} SELECT vec_id, list_transform(codes, lambda x: x::INT) AS codes, round(scale, 9) AS scale FROM coded")
def sq8_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = V.normalize(F.col("embedding"))
    return _vectors(spark, sf_dir).withColumn("v", v).select("vec_id", V.int8_codes(F.col("v")).cast("array<int>").alias("codes"), F.round(V.int8_scale(F.col("v")), 9).alias("scale"))


@query(_dense_sql("cosine", 10))
def sq8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _vectors(spark, sf_dir)
    return _rounded(dense.int8_top_k(vectors, _class_means(vectors), 10), "score")


_LISTS = f"{_MEANS}, units AS (SELECT qid AS list_id, list_transform(vector, lambda x: x / sqrt(list_dot_product(vector, vector))) AS c FROM means), near AS (SELECT vec_id, embedding::DOUBLE[] AS v, list_id, row_number() OVER (PARTITION BY vec_id ORDER BY round(list_dot_product(embedding::DOUBLE[], c), 9) DESC, list_id) AS r FROM embeddings, units)"


def _asking(vectors: DataFrame) -> DataFrame:
    return vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").cast("array<double>").alias("vector"))


def _centroids(vectors: DataFrame):
    import numpy as np

    return dense.unit(np.array([r["vector"] for r in _class_means(vectors).orderBy("qid").collect()]))  # ten classes


@query(f"WITH {_LISTS} SELECT vec_id, list_id FROM near WHERE r = 1")
def ivf_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _vectors(spark, sf_dir)
    return inverted.assign(vectors, _centroids(vectors)).select("vec_id", F.col("list_id").cast("long").alias("list_id"))


@query(
    f"WITH {_LISTS}, {_ALL}, probe AS (SELECT qid, list_id FROM (SELECT e.qid, u.list_id, row_number() OVER (PARTITION BY e.qid ORDER BY round(list_dot_product(e.vector, c), 9) DESC, u.list_id) AS r FROM everyone e, units u WHERE e.qid % 50 = 0) WHERE r <= 8), "
    f"scored AS (SELECT p.qid, n.vec_id, {_SCORE['cosine']} AS score FROM probe p JOIN near n ON n.r = 1 AND n.list_id = p.list_id JOIN everyone e ON e.qid = p.qid) {_sql_top('scored', 5, 'vec_id')}"
)
def ivf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fiftieth vector against all, in 8 of 10 lists: recall at 5 is above 0.9 (tests/test_search.py)."""
    vectors = _vectors(spark, sf_dir)
    centroids = _centroids(vectors)
    return _rounded(inverted.list_top_k(inverted.assign(vectors, centroids), _asking(vectors), centroids, 5, 8), "score")


@query()
def ivf_pq_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fiftieth vector against all; the probes are the fewest that measure a recall of 0.95 on sampled vectors."""
    vectors = _vectors(spark, sf_dir)
    centroids = inverted.train_lists(vectors, DIM, vectors.count())
    books = inverted.train_codes(vectors, DIM)
    coded = written(inverted.encode(inverted.assign(vectors, centroids), books), "coded")
    return _rounded(inverted.code_top_k(coded, _asking(vectors), centroids, books, 10, inverted.enough_probes(coded, centroids, 10, 0.95)), "score")


_SPARSE = "post AS (SELECT vec_id, i AS dim, embedding[i + 1]::DOUBLE AS value FROM embeddings, range(64) t(i) WHERE abs(embedding[i + 1]) > 0.15::FLOAT)"


def _sparse(vectors: DataFrame) -> DataFrame:
    """Components beyond 0.15 as struct(indices, values)."""
    big = F.filter(F.transform("embedding", lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda p: F.abs(p["x"]) > F.lit(0.15).cast("float"))
    return vectors.withColumn("sparse", F.struct(F.transform(big, lambda p: p["i"]).alias("indices"), F.transform(big, lambda p: p["x"]).alias("values")))


@query(f"WITH {_SPARSE}, scored AS (SELECT a.vec_id AS qid, b.vec_id, sum(a.value * b.value) AS score FROM post a JOIN post b USING (dim) GROUP BY ALL) {_sql_top('scored', 5, 'vec_id')}")
def sparse_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    post = sparse.sparse_postings(_sparse(_vectors(spark, sf_dir)))
    return _rounded(sparse.sparse_top_k(post, post.withColumnRenamed("chunk_id", "qid"), 5), "score")


_HYBRID = f"""{_BM25},
lex AS (SELECT qid, doc_id AS id, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS r FROM scored),
dscored AS (SELECT item_id AS qid, e.vec_id AS id, list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) / (sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[]))) AS score
            FROM benchmark JOIN embeddings q ON q.vec_id = item_id, embeddings e),
den AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS r FROM dscored)"""


def _hybrid_sql(dense_weight: float, lexical_weight: float, source: str = "both_") -> str:
    return f"{source} AS (SELECT qid, id, sum(w / (60 + r)) AS score FROM (SELECT qid, id, r, {lexical_weight}::DOUBLE AS w FROM lex WHERE r <= 50 UNION ALL SELECT qid, id, r, {dense_weight}::DOUBLE FROM den WHERE r <= 50) GROUP BY qid, id)"


def _signals(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    vectors, asked = _vectors(spark, sf_dir), _benchmark_queries(spark, sf_dir)
    near = asked.join(vectors, asked["qid"] == vectors["vec_id"]).select("qid", F.col("embedding").cast("array<double>").alias("vector"))
    return dense.dense_top_k(vectors, near, 50, DIM), lexical.bm25_top_k(_documents(spark, sf_dir), asked, 50)


@query(f"WITH {_HYBRID}, {_hybrid_sql(1, 1)} {_sql_top('both_', 10, 'id')}")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages against texts and vectors, fused by reciprocal rank: the library's search plan."""
    chunks, vectors, asked = _both(spark, sf_dir)
    return _rounded(search(chunks, asked, 10, dim=DIM, vectors=vectors), "score")


def _both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents as chunks, the vectors of their numbers, and benchmark passages as queries with text and vector."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    chunks = _documents(spark, sf_dir).select("chunk_id", "text", "lang", "n_chars")
    passages = written(_benchmark_queries(spark, sf_dir), "passages")
    own = vectors.select(F.col("chunk_id").alias("qid"), F.col("embedding").cast("array<double>").alias("vector")).join(small(passages.select("qid")), "qid", "left_semi")
    return chunks, vectors, passages.join(small(written(own, "own")), "qid", "left")


@query(f"WITH {_HYBRID}, {_hybrid_sql(1, 1)} {_sql_top('both_', 10, 'id')}")
def hybrid_search_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from stored postings and inverted lists, all of which are probed."""
    chunks, vectors, asked = _both(spark, sf_dir)
    chunks = written(chunks.join(vectors, "chunk_id", "left"), "chunks")  # the index and the search read them again and again
    index = indexes.build(chunks, f"{folder(spark)}/index-{uuid.uuid4().hex}", DIM)
    return _rounded(search(chunks, asked, 10, Config(index="ivf", nprobe=len(index.centroids)), index=index), "score")


@query(f"WITH {_HYBRID.replace('embeddings e),', 'embeddings e JOIN documents o ON o.doc_id = e.vec_id WHERE o.lang = ' + chr(39) + 'en' + chr(39) + '),')}, {_hybrid_sql(1, 1, 'mixed').replace('FROM lex', 'FROM elex')} {_sql_top('mixed', 10, 'id')}".replace(", mixed AS", ", elex AS (SELECT s.qid, s.doc_id AS id, row_number() OVER (PARTITION BY s.qid ORDER BY round(score, 9) DESC, s.doc_id) AS r FROM scored s JOIN documents o USING (doc_id) WHERE o.lang = 'en'), mixed AS", 1))
def hybrid_search_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Under a filter, which narrows both signals before they are ranked."""
    chunks, vectors, asked = _both(spark, sf_dir)
    return _rounded(search(chunks, asked, 10, spec={"lang": "en"}, dim=DIM, vectors=vectors), "score")


@query(f"WITH {_HYBRID}, {_hybrid_sql(0.3, 0.7)} {_sql_top('both_', 10, 'id')}")
def weighted_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    near, words = _signals(spark, sf_dir)
    return _rounded(rank.top_k(rank.fuse([(near, 0.3), (words, 0.7)]), 10), "score")


_GRID = [(0.5, 1.5), (1.0, 1.0), (1.5, 0.5)]


@query(
    f"WITH {_HYBRID}, "
    + ", ".join(_hybrid_sql(d, w, f"g{i}") for i, (d, w) in enumerate(_GRID))
    + f", g AS ({' UNION ALL '.join(f'SELECT {i} AS config, * FROM g{i}' for i in range(len(_GRID)))}) SELECT config, qid, id AS chunk_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY config, qid ORDER BY round(score, 9) DESC, id) AS rank FROM g) WHERE rank <= 5"
)
def rrf_weight_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All configurations of a tuning grid in one job: both signals are ranked once, the grid multiplies their short lists."""
    near, words = _signals(spark, sf_dir)
    hits = near.select("qid", "chunk_id", "rank", F.lit(0).alias("signal")).union(words.select("qid", "chunk_id", "rank", F.lit(1)))
    grid = spark.createDataFrame([(i, s, float(w)) for i, pair in enumerate(_GRID) for s, w in enumerate(pair)], "config int, signal int, weight double")
    fused = hits.join(F.broadcast(grid), "signal").groupBy("config", "qid", "chunk_id").agg(F.sum(F.col("weight") / (60 + F.col("rank"))).alias("score"))
    return _rounded(rank.top_k(fused, 5, by=("config", "qid")), "score")


@query(
    "WITH m AS (SELECT vec_id, label, list_transform(range(8), lambda r: list_slice(embedding::DOUBLE[], r * 8 + 1, r * 8 + 8)) AS parts FROM embeddings), "
    "q AS (SELECT qid, list_transform(range(8), lambda r: list_slice(vector, r * 8 + 1, r * 8 + 8)) AS qp FROM means), "
    "scored AS (SELECT qid, vec_id, list_sum(list_transform(qp, lambda a: list_max(list_transform(parts, lambda b: list_dot_product(a, b))))) AS score FROM q, m) ".replace("WITH ", f"WITH {_MEANS}, ", 1) + _sql_top("scored", 10, "vec_id")
)
def maxsim_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as eight token vectors of eight."""
    vectors = _vectors(spark, sf_dir)
    cut = lambda c: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.slice(F.col(c), r * 8 + 1, F.lit(8)))
    q = _class_means(vectors).select("qid", cut("vector").alias("qp"))
    rows = vectors.select("chunk_id", cut("embedding").alias("parts")).crossJoin(F.broadcast(q))
    return _rounded(rank.top_k(rows.select("qid", "chunk_id", V.max_sim(F.col("qp"), F.col("parts")).alias("score")), 10), "score")


# ---- filters

_LABELLED = "(SELECT d.doc_id, d.lang, d.source, d.n_chars, d.text, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))"


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their labels, absent for most."""
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").dropDuplicates(["doc_id"]), "doc_id", "left")


_FILTERS: dict[str, tuple[dict, str]] = {
    "filter_eq": ({"quality": 1}, "quality = 1"),
    "filter_ne": ({"quality": {"$ne": 1}}, "NOT coalesce(quality = 1, false)"),
    "filter_in": ({"lang": {"$in": ["de", "fr"]}}, "lang IN ('de', 'fr')"),
    "filter_nin": ({"quality": {"$nin": [0]}}, "NOT coalesce(quality IN (0), false)"),
    "filter_range": ({"n_chars": {"$gte": 300, "$lt": 900}}, "n_chars >= 300 AND n_chars < 900"),
    "filter_contains": ({"text": {"contains": "the "}}, "contains(text, 'the ')"),
    "filter_contains_any": ({"text": {"contains_any": ["ß", "ñ"]}}, "contains(text, 'ß') OR contains(text, 'ñ')"),
    "filter_contains_all": ({"text": {"contains_all": ["e", "."]}}, "contains(text, 'e') AND contains(text, '.')"),
    "filter_exists": ({"toxic": {"exists": False}}, "toxic IS NULL"),
    "filter_prefix": ({"source": {"prefix": "s"}, "lang": {"prefix": "e"}}, "starts_with(source, 's') AND starts_with(lang, 'e')"),
    "filter_not": ({"$not": {"$or": [{"toxic": 1}, {"lang": "en"}]}}, "NOT (coalesce(toxic = 1, false) OR coalesce(lang = 'en', false))"),
    "filter_and_or": ({"$and": [{"n_chars": {"gt": 100}}, {"$or": [{"quality": 0}, {"lang": "es"}]}]}, "n_chars > 100 AND (coalesce(quality = 0, false) OR coalesce(lang = 'es', false))"),
}


def _filter_query(name: str, spec: dict) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return filters.filtered(_labelled(spark, sf_dir), spec).select("doc_id", "lang")

    run.__name__ = name
    return run


for _name, (_spec, _where) in _FILTERS.items():
    query(f"SELECT doc_id, lang FROM {_LABELLED} WHERE {_where}")(_filter_query(_name, _spec))


@query("SELECT event_id, event_type FROM events WHERE CAST(json_extract(props, '$.k') AS DOUBLE) >= 50 AND event_type <> 'error'")
def filter_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dynamic metadata: the DSL over a VARIANT column."""
    events = table(spark, sf_dir, "events").withColumn("m", F.try_parse_json("props"))
    return events.where(filters.compile_filter({"k": {"$gte": 50}}, filters.variant("m")) & filters.compile_filter({"event_type": {"$ne": "error"}}, filters.typed(events))).select("event_id", "event_type")


@query("SELECT source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents WHERE source = (SELECT min(source) FROM documents) AND lang = 'en' GROUP BY source")
def tenant_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    name = docs.agg(F.min("source")).first()[0]
    return filters.filtered(docs, filters.tenant({"lang": "en"}, name, "source")).groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


# ---- documents


@query("SELECT 'status' AS field, CASE WHEN n_chars % 3 = 0 THEN 'vague' ELSE 'odd' END AS value FROM documents WHERE n_chars % 3 < 2 GROUP BY ALL UNION ALL SELECT DISTINCT 'date', 'soon ' || (n_chars % 5) FROM documents WHERE n_chars % 2 = 0")
def version_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses of neither class, and dates that can't be ordered."""
    docs = table(spark, sf_dir, "documents").select(
        F.when(F.col("n_chars") % 3 == 0, "vague").when(F.col("n_chars") % 3 == 1, "odd").otherwise("active").alias("status"),
        F.when(F.col("n_chars") % 2 == 0, F.concat(F.lit("soon "), (F.col("n_chars") % 5).cast("string"))).otherwise("2020-05").alias("effective_date"),
    )
    return versions.unrecognized_statuses(docs).select(F.lit("status").alias("field"), F.col("status").alias("value")).union(versions.unparseable_dates(docs).select(F.lit("date"), "date"))


@query(
    "SELECT doc_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS key, substring(sha256(text), 1, 16) AS id, (1 + doc_id % 3)::INT AS level, lang || ' title' AS title, "
    "'It ' || lang || ' holds.' AS hypothesis, 'See [1].' AS sanitized FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL"
)
def text_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query keys, content ids, headings, hypotheses and sanitised citations."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL AND lang IS NOT NULL")
    block = F.concat(F.repeat(F.lit("#"), (1 + F.col("doc_id") % 3).cast("int")), F.lit(" "), "lang", F.lit(" title\n\nand a body"))
    claim = F.concat(F.lit("It [3] "), "lang", F.lit(" holds [12] ."))
    return docs.select("doc_id", X.query_key(F.col("text")).alias("key"), X.content_id(F.col("text")).alias("id"), X.heading(block)["level"].alias("level"), X.heading(block)["title"].alias("title"), F.regexp_replace(X.without_markers(claim), " +", " ").alias("hypothesis"), X.sanitize_citations(F.lit("See [1] [7]."), F.lit(3)).alias("sanitized"))


@query(f"WITH {_MEANS} SELECT vec_id, qid, round(list_dot_product(v, vector), 6) AS dot, round(list_dot_product(v, v) + list_dot_product(vector, vector) - 2 * list_dot_product(v, vector), 6) AS l2_squared, round(sqrt(list_dot_product(v, v)), 6) AS norm, round(list_dot_product(v, vector) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(vector, vector))), 6) AS cosine, len(v) = 64 AS valid FROM means JOIN (SELECT vec_id, label::BIGINT AS qid, embedding::DOUBLE[] AS v FROM embeddings) USING (qid)")
def vector_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector against the mean of its label."""
    vectors = _vectors(spark, sf_dir)
    rows = vectors.withColumn("qid", F.col("label").cast("long")).join(F.broadcast(_class_means(vectors)), "qid")  # ten means
    a, b = F.col("embedding").cast("array<double>"), F.col("vector")
    return _rounded(rows.select("vec_id", "qid", V.dot(a, b).alias("dot"), V.l2_squared(a, b).alias("l2_squared"), V.norm(a).alias("norm"), V.cosine(a, b).alias("cosine"), V.is_valid(F.col("embedding"), DIM).alias("valid")), "dot", "l2_squared", "norm", "cosine")


_REGION_CSV = "'n_name: ' || n_name || '; n_regionkey: ' || n_regionkey"


@query(
    f"SELECT 'r' || n_regionkey || '.csv' AS path, 'csv' AS format, 'r' || n_regionkey AS title, string_agg({_REGION_CSV}, chr(10) || chr(10) ORDER BY n_name) AS text FROM nation GROUP BY n_regionkey "
    "UNION ALL SELECT 'r' || r_regionkey || '.jsonl', 'jsonl', 'r' || r_regionkey, r_name || chr(10) || chr(10) || '{\"n\": ' || r_regionkey || '}' FROM region "
    "UNION ALL SELECT 'r' || r_regionkey || '.json', 'json', 'r' || r_regionkey, '{' || chr(10) || '  \"name\": \"' || r_name || '\"' || chr(10) || '}' FROM region "
    "UNION ALL SELECT 'r' || r_regionkey || '.md', 'markdown', r_name, '## ' || r_name || chr(10) || 'text' FROM region "
    "UNION ALL SELECT 'r' || r_regionkey || '.py', 'code', 'r' || r_regionkey, 'x = ' || r_regionkey FROM region "
    "UNION ALL SELECT 'r' || r_regionkey || '.txt', 'text', 'r' || r_regionkey, r_name FROM region "
    "UNION ALL SELECT 'r' || r_regionkey || '.html', 'html', r_name, 'one' || chr(10) || r_name FROM region"
)
def parsed_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parser registry over the bytes of files of seven formats."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    line = F.concat_ws(",", "n_name", F.col("n_regionkey").cast("string"))
    csv = nation.groupBy("n_regionkey").agg(F.concat(F.lit("n_name,n_regionkey\n"), F.concat_ws("\n", F.array_sort(F.collect_list(line)))).alias("raw")).select(F.concat(F.lit("r"), "n_regionkey", F.lit(".csv")).alias("path"), "raw")
    key, name = F.col("r_regionkey").cast("string"), F.col("r_name")
    made = {
        "jsonl": F.concat(F.lit('{"text": "'), name, F.lit('"}\n\n{"n": '), key, F.lit("}")),
        "json": F.concat(F.lit('{"name": "'), name, F.lit('"}')),
        "md": F.concat(F.lit("## "), name, F.lit("\ntext")),
        "py": F.concat(F.lit("x = "), key),
        "txt": name,
        "html": F.concat(F.lit("<html><head><title>"), name, F.lit("</title><script>no()</script></head><body><p>one</p><p>"), name, F.lit("</p></body></html>")),
    }
    rows = csv
    for suffix, raw in made.items():
        rows = rows.union(region.select(F.concat(F.lit("r"), key, F.lit(f".{suffix}")), raw))
    return parsers.parsed(rows.select("path", F.col("raw").cast("binary").alias("content"))).where("error IS NULL").select("path", "format", "title", "text")


_TABLES = ("benchmark", "conversations", "customer", "documents", "embeddings", "events", "labels", "lineitem", "nation", "orders", "pages", "part", "region", "supplier")


@query("SELECT unnest([" + ", ".join(f"'{t}.parquet'" for t in _TABLES if t not in ("part", "labels")) + "]) AS name")
def discovered_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = files.discover(spark, sf_dir, include=("*.parquet",), exclude=("*part.parquet", "*labels.parquet"), content=False)
    return found.select(F.regexp_replace("relative", "^/", "").alias("name"))


# ---- the store


def _stored(spark: SparkSession, sf_dir: str) -> Store:
    """Conversations as documents: all written, every third written again, every fifth deleted."""
    store = Store(spark, f"{folder(spark)}/store-{uuid.uuid4().hex}")
    turns = written(_turns(spark, sf_dir).drop("document_version", "chunk_id"), "turns")
    for some in (turns, turns.where("document_id % 3 = 0")):
        store.upsert(some.select("document_id").distinct(), some)
    store.delete(turns.where("document_id % 5 = 0").select("document_id"))
    return store


@query("SELECT conv_id::VARCHAR || '#' || turn AS chunk_id, CASE WHEN conv_id % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS document_version, text FROM conversations WHERE conv_id % 5 <> 0")
def store_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live chunks after two writes, a deletion and a compaction."""
    store = _stored(spark, sf_dir)
    store.compact()
    store.verify()
    return store.chunks().select("chunk_id", "document_version", "text")


@query("SELECT conv_id::VARCHAR AS document_id, max(CASE WHEN conv_id % 3 = 0 THEN 2 ELSE 1 END)::BIGINT AS versions FROM conversations GROUP BY conv_id")
def store_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document was written."""
    return _stored(spark, sf_dir).entries().where("NOT deleted").groupBy("document_id").agg(F.count("*").alias("versions"))


# ---- contexts

_HITS = f"{_BM25}, lex AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scored), t AS (SELECT qid, doc_id, source, rank, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS key FROM lex JOIN documents USING (doc_id) WHERE rank <= 50)"


def _hits(spark: SparkSession, sf_dir: str, document: str) -> DataFrame:
    """Fifty documents for each benchmark passage."""
    docs = _documents(spark, sf_dir)
    hits = small(written(lexical.bm25_top_k(docs, _benchmark_queries(spark, sf_dir), 50), "hits"))  # few: texts stay where they are
    return hits.join(docs.select("chunk_id", "text", F.col(document).cast("string").alias("document_id")), "chunk_id").withColumn("chunk_id", F.col("chunk_id").cast("string"))


@query(f"WITH {_HITS} SELECT qid, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY qid, key ORDER BY rank) AS copy FROM t) WHERE copy = 1")
def context_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of equal texts among a query's hits, white space aside."""
    return context.cap_hits(_hits(spark, sf_dir, "doc_id"), 1).select("qid", F.col("chunk_id").cast("long").alias("doc_id"))


@query(f"WITH {_HITS}, u AS (SELECT *, count(*) OVER (PARTITION BY qid, key) AS n FROM t) SELECT qid, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY qid, source ORDER BY rank) AS r FROM u WHERE n = 1) WHERE r <= 3")
def context_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most three hits of a document, here of a source, among texts that a query finds once."""
    hits = _hits(spark, sf_dir, "source").withColumn("_n", F.count("*").over(W.partitionBy("qid", F.sha2(X.collapse(F.col("text")), 256)))).where("_n = 1")
    return context.cap_hits(hits, 3).select("qid", F.col("chunk_id").cast("long").alias("doc_id"))


@query("SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE greatest(1, floor(0.6::DOUBLE * len(regexp_extract_all(text, '[^\\s]+')) + 0.4::DOUBLE * (length(text) / 4.0::DOUBLE))::INT) END AS tokens FROM documents")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.estimate_tokens(F.col("text")).alias("tokens"))


@query("SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY trim(regexp_replace(text, '\\s+', ' ', 'g'))")
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of each text, white space aside; the key that is shuffled is a digest, not the text."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.sha2(X.collapse(F.col("text")), 256).alias("digest"))
    return docs.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).drop("digest")


@query("SELECT source, doc_id, rank FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents) WHERE rank <= 3")
def per_document_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    return table(spark, sf_dir, "documents").select("source", "doc_id", F.row_number().over(w).alias("rank")).where("rank <= 3").withColumn("rank", F.col("rank").cast("long"))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    return versions.latest(rows, "user_id", F.desc("ts"), F.desc("event_id")).drop("ts")


@query(
    "WITH d AS (SELECT doc_id, source || '/' || lang AS doc_group, CASE quality WHEN 1 THEN 'active' WHEN 0 THEN 'retired' END AS status, CASE WHEN n_chars % 11 = 0 THEN NULL ELSE printf('%04d-%02d', 2000 + n_chars % 20, 1 + n_chars % 12) END AS day, n_chars AS version FROM " + _LABELLED + "), "
    "r AS (SELECT *, CASE status WHEN 'active' THEN 0 WHEN 'retired' THEN 2 ELSE 1 END AS status_rank FROM d), "
    "p AS (SELECT *, rank() OVER (PARTITION BY doc_group ORDER BY status_rank, day DESC NULLS LAST, version DESC) AS place FROM r), "
    "t AS (SELECT *, sum((place = 1)::INT) OVER (PARTITION BY doc_group) AS firsts, count(*) OVER (PARTITION BY doc_group) AS n FROM p) "
    "SELECT doc_id, doc_group, status_rank, place, place = 1 AND firsts > 1 AND n > 1 AS tied, NOT (status_rank = 2 OR place > 1) AS keep FROM t"
)
def version_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _labelled(spark, sf_dir).select(
        "doc_id",
        F.concat_ws("/", "source", "lang").alias("doc_group"),
        F.when(F.col("quality") == 1, "active").when(F.col("quality") == 0, "retired").alias("status"),
        F.when(F.col("n_chars") % 11 == 0, F.when(F.col("n_chars") % 2 == 0, "soon")).otherwise(F.format_string("%04d-%02d", (2000 + F.col("n_chars") % 20).cast("int"), (1 + F.col("n_chars") % 12).cast("int"))).alias("effective_date"),
        F.col("n_chars").alias("version"),
    )
    return versions.precedence(docs).select("doc_id", "doc_group", "status_rank", F.col("place").cast("long").alias("place"), "tied", "keep")


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents, their turns as chunks."""
    turns = table(spark, sf_dir, "conversations").dropDuplicates(["conv_id", "turn"])
    return turns.select(F.col("conv_id").cast("string").alias("document_id"), F.lit(1).cast("long").alias("document_version"), F.col("turn").cast("int").alias("chunk_index"), F.concat_ws("#", "conv_id", "turn").alias("chunk_id"), "role", "text")


@query("SELECT a.conv_id || '#' || a.turn AS neighbor_of, b.conv_id || '#' || b.turn AS chunk_id FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn BETWEEN a.turn - 1 AND a.turn + 2 AND b.turn <> a.turn WHERE a.role = 'assistant'")
def neighbor_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _turns(spark, sf_dir)
    hits = chunks.where("role = 'assistant'").withColumns({"qid": F.lit(0), "score": F.lit(1.0)})
    return context.neighbors(hits, chunks, 1, 2).select("neighbor_of", "chunk_id")


@query("SELECT conv_id || '#' || turn AS chunk_id, lag(conv_id || '#' || turn) OVER w AS previous_chunk_id, lead(conv_id || '#' || turn) OVER w AS next_chunk_id FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def prev_next_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.linked(_turns(spark, sf_dir)).select("chunk_id", "previous_chunk_id", "next_chunk_id")


@query("SELECT conv_id::VARCHAR AS document_id, min(turn)::INT AS first, max(turn)::INT AS last, count(*) AS chunks FROM (SELECT conv_id, turn, turn - row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM conversations WHERE role <> 'system' AND length(text) > 120) GROUP BY conv_id, run")
def adjacent_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = _turns(spark, sf_dir).where((F.col("role") != "system") & (F.length("text") > 120))
    return context.adjacent_runs(chosen).groupBy("document_id", "run").agg(F.min("chunk_index").alias("first"), F.max("chunk_index").alias("last"), F.count("*").alias("chunks")).drop("run")


_OLD = "(SELECT doc_id, sha256(text) AS h FROM documents WHERE lang <> 'de')"
_NEW = "(SELECT doc_id, sha256(CASE WHEN lang = 'es' THEN text || '.' ELSE text END) AS h FROM documents WHERE lang <> 'fr')"


def _two_states(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """What a store held and what a folder holds now: German documents came, French ones went, Spanish ones changed."""
    docs = table(spark, sf_dir, "documents")
    now = F.when(F.col("lang") == "es", F.concat("text", F.lit("."))).otherwise(F.col("text"))
    old = docs.where("lang <> 'de'").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    return old, docs.where("lang <> 'fr'").select("doc_id", F.sha2(now, 256).alias("content_hash"))


@query(f"SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'deleted' WHEN o.h = n.h THEN 'unchanged' ELSE 'updated' END AS action FROM {_OLD} o FULL JOIN {_NEW} n ON o.doc_id = n.doc_id")
def sync_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.sync_plan(*_two_states(spark, sf_dir), "doc_id")


@query(f"SELECT count(n.doc_id) AS discovered, count(*) FILTER (o.doc_id IS NULL) AS added, count(*) FILTER (o.h <> n.h) AS updated, count(*) FILTER (o.h = n.h) AS unchanged, count(*) FILTER (n.doc_id IS NULL) AS deleted FROM {_OLD} o FULL JOIN {_NEW} n ON o.doc_id = n.doc_id")
def sync_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.sync_counts(files.sync_plan(*_two_states(spark, sf_dir), "doc_id"))


@query("SELECT sha256(text) AS content_hash, count(*) AS texts FROM documents WHERE text IS NOT NULL AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE lang = 'en' AND text IS NOT NULL) GROUP BY text")
def cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    cache = docs.where("lang = 'en'").select(F.sha2("text", 256).alias("content_hash"), F.lit("m").alias("fingerprint"))
    misses = files.cache_misses(docs, cache, "m")
    return misses.select("content_hash").join(docs.select(F.sha2("text", 256).alias("content_hash")), "content_hash").groupBy("content_hash").agg(F.count("*").alias("texts"))


@query(
    "WITH q AS (SELECT item_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS q FROM benchmark), d AS (SELECT doc_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS t FROM documents), "
    "hits AS (SELECT item_id, doc_id, ((length(t) - length(replace(t, q, ''))) / length(q))::INT AS n FROM q, d WHERE contains(t, q)) "
    "SELECT q.item_id, count(h.doc_id) AS documents, coalesce(min(h.n), 0) AS occurrences, count(h.doc_id) > 0 AND coalesce(min(h.n), 0) <= 8 AS grounded FROM q LEFT JOIN hits h USING (item_id) GROUP BY q.item_id"
)
def quote_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many documents each benchmark passage stands word for word, and how well the best one pins it down."""
    quotes = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("quote"))
    return verification.ground_quotes(quotes, table(spark, sf_dir, "documents"), "item_id", "doc_id").select("item_id", "documents", "occurrences", "grounded")


@query(
    f"WITH t AS (SELECT item_id, list_distinct({_TOKENS}) AS s FROM benchmark) SELECT a.item_id AS a, b.item_id AS b, round(len(list_intersect(a.s, b.s)) / least(len(a.s), len(b.s)), 6) AS overlap FROM t a JOIN t b ON a.item_id < b.item_id"
)
def overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "benchmark").select("item_id", F.array_distinct(X.tokenize(F.col("text"))).alias("s"))
    a, b = t.select(F.col("item_id").alias("a"), F.col("s").alias("x")), t.select(F.col("item_id").alias("b"), F.col("s").alias("y"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", F.round(X.overlap(F.col("x"), F.col("y")), 6).alias("overlap"))


@query("SELECT n_nationkey, 'n_nationkey: ' || n_nationkey || '; n_name: ' || n_name || '; n_regionkey: ' || n_regionkey AS row FROM nation")
def csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    return nation.select("n_nationkey", parsers.csv_rows(nation).alias("row"))


@query("WITH t AS (SELECT conv_id % 5 <> 0 AS live, conv_id % 3 = 0 AS twice, conv_id FROM conversations) SELECT count(DISTINCT conv_id) FILTER (live) AS documents, count(*) FILTER (live) AS live_chunks, (count(*) + count(*) FILTER (twice))::BIGINT AS total_rows, (count(*) + count(*) FILTER (twice) - count(*) FILTER (live))::BIGINT AS tombstones, 3::BIGINT AS deltas FROM t")
def store_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _stored(spark, sf_dir).stats()
    names = ("documents", "live_chunks", "total_rows", "tombstones", "deltas")
    return spark.createDataFrame([tuple(got[n] for n in names)], ", ".join(f"{n} long" for n in names))


@query("SELECT o_orderkey, list_distinct([o_custkey % 7, o_custkey % 3]) AS markers FROM orders".replace("list_distinct([o_custkey % 7, o_custkey % 3])", "CASE WHEN o_custkey % 7 = o_custkey % 3 THEN [(o_custkey % 7)::INT] ELSE [(o_custkey % 7)::INT, (o_custkey % 3)::INT] END"))
def citations_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    answer = F.concat(F.lit("So it is ["), (F.col("o_custkey") % 7).cast("string"), F.lit("]. And ["), (F.col("o_custkey") % 3).cast("string"), F.lit("][x]"))
    return table(spark, sf_dir, "orders").select("o_orderkey", X.citation_markers(answer).alias("markers"))


# ---- multi-part questions

_PARTS = f"{_BM25}, lex AS (SELECT qid // 4 AS qid, qid % 4 AS sub_idx, doc_id, round(score, 9) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS r FROM scored), f AS (SELECT qid, doc_id, sum(1.0::DOUBLE / (60 + r)) AS score, max(score) AS best_score FROM lex WHERE r <= 20 GROUP BY qid, doc_id)"


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four benchmark passages as the parts of one question, fused."""
    hits = lexical.bm25_top_k(_documents(spark, sf_dir), _benchmark_queries(spark, sf_dir), 20)
    return rank.fuse_queries(hits.select((F.col("qid") - F.col("qid") % 4).alias("q4"), (F.col("qid") % 4).cast("int").alias("sub_idx"), F.lit(1.0).alias("weight"), "chunk_id", "score", "rank").withColumn("qid", (F.col("q4") / 4).cast("long")).drop("q4"))


@query(f"WITH {_PARTS} SELECT qid, doc_id AS chunk_id, round(score, 6) AS score, round(best_score, 6) AS best_score FROM f")
def cross_query_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_parts(spark, sf_dir).select("qid", "chunk_id", "score", "best_score"), "score", "best_score")


@query(f"WITH {_PARTS}, b AS (SELECT qid, doc_id, score * CASE WHEN lang = 'en' THEN 1.5 ELSE 1 END * CASE WHEN n_chars >= 2000 THEN 0.5 ELSE 1 END AS score FROM f JOIN documents USING (doc_id)) SELECT qid, doc_id AS chunk_id, round(score, 6) AS score FROM b")
def boosted_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _parts(spark, sf_dir).join(_documents(spark, sf_dir).select("chunk_id", "lang", "n_chars"), "chunk_id")
    return _rounded(multiquery.boosted(rows, [{"filter": {"lang": "en"}, "weight": 1.5}, {"filter": {"n_chars": {"gte": 2000}}, "weight": 0.5}]).select("qid", "chunk_id", "score"), "score")


# ---- evaluation


@query(
    f"WITH {_ALL}, hits AS (SELECT qid, chunk_id FROM ({_dense_sql('cosine', 10, queries=_ALL, name='everyone')}) WHERE qid % 50 = 0), "
    "need AS (SELECT vec_id AS qid, unnest([vec_id, vec_id // 2]) AS id FROM embeddings WHERE vec_id % 50 = 0), "
    "per AS (SELECT n.qid, count(*) = count(h.chunk_id) AS ok FROM (SELECT DISTINCT * FROM need) n LEFT JOIN hits h ON h.qid = n.qid AND h.chunk_id = n.id GROUP BY n.qid) SELECT count(*) AS questions, round(avg(ok::INT), 6) AS full_recall FROM per"
)
def full_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fiftieth vector needs itself and another."""
    vectors = _vectors(spark, sf_dir)
    hits = dense.dense_top_k(vectors, _asking(vectors), 10, DIM).withColumn("document_id", F.col("chunk_id"))
    need = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.array(F.col("vec_id").cast("string"), F.expr("vec_id div 2").cast("string")).alias("relevant_ids"))
    return _rounded(evaluation.full_recall(hits, need), "full_recall")


@query(
    f"WITH {_ALL}, hits AS (SELECT qid, vec_id, rank FROM ({_dense_sql('cosine', 10, queries=_ALL, name='everyone').replace('AS chunk_id', 'AS vec_id')})), "
    "f AS (SELECT h.qid, h.rank, q.label = e.label AS ok FROM hits h JOIN embeddings q ON q.vec_id = h.qid JOIN embeddings e ON e.vec_id = h.vec_id), "
    "m AS (SELECT label, count(*) AS m FROM embeddings GROUP BY label), "
    "per AS (SELECT f.qid, count(*) FILTER (ok) AS found, count(*) AS n, min(rank) FILTER (ok) AS first, coalesce(sum(1 / log2(rank + 1)) FILTER (ok), 0) AS dcg FROM f GROUP BY f.qid) "
    "SELECT count(*) AS queries, round(avg(found / m), 6) AS recall, round(avg(found / n), 6) AS precision, round(avg((found > 0)::INT), 6) AS hit, round(avg(coalesce(1 / first, 0)), 6) AS mrr, "
    "round(avg(dcg / (SELECT sum(1 / log2(i + 1)) FROM range(1, 11) t(i) WHERE i <= m)), 6) AS ndcg FROM per JOIN embeddings e ON e.vec_id = per.qid JOIN m ON m.label = e.label"
)
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector as a query; those of its label are relevant."""
    vectors = _vectors(spark, sf_dir)
    everyone = vectors.select(F.col("vec_id").alias("qid"), F.col("embedding").cast("array<double>").alias("vector"))
    hits = dense.dense_top_k(vectors, everyone, 10, DIM)
    classes = vectors.select(F.col("vec_id").alias("id"), F.col("label").alias("class"))
    return _rounded(evaluation.summary(evaluation.per_query_of_class(hits, classes, 10)).select("queries", "recall", "precision", "hit", "mrr", "ndcg"), "recall", "precision", "hit", "mrr", "ndcg")


@query("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type")
def latency_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(evaluation.nearest_rank("value", 0.5).alias("p50"), evaluation.nearest_rank("value", 0.95).alias("p95"))


@query(
    "WITH s AS (SELECT toxic AS label, (n_chars % 100) / 100.0::DOUBLE AS score FROM documents JOIN labels USING (doc_id) WHERE toxic IS NOT NULL), "
    "t AS (SELECT i / 20.0::DOUBLE AS threshold FROM range(1, 20) t(i)) "
    "SELECT threshold, round(avg(recall), 6) AS accuracy FROM (SELECT threshold, label, avg(((score >= threshold) = (label = 1))::INT) AS recall FROM s, t GROUP BY ALL) GROUP BY threshold"
)
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select(F.col("toxic").alias("label"), (F.col("n_chars") % 100 / F.lit(100.0)).alias("score"))
    return _rounded(evaluation.balanced_accuracy(rows, spark.range(1, 20).select((F.col("id") / F.lit(20.0)).alias("threshold"))), "accuracy")


# ---- pipelines whose steps are sequential in Python: held against brute force in tests/


@query()
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", parsers.html_text(F.col("html")).alias("p")).select("page_id", "p.title", "p.text")


@query()
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_documents(table(spark, sf_dir, "documents"), key="doc_id")


@query()
def hashed_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", embed(F.col("text"), HashedNgrams(256)).alias("embedding"))


def _candidates(spark: SparkSession, sf_dir: str, k: int) -> tuple[DataFrame, DataFrame]:
    docs = _documents(spark, sf_dir)
    chunks = docs.select(F.col("chunk_id").cast("string").alias("chunk_id"), F.col("source").alias("document_id"), F.lit(1).cast("long").alias("document_version"), F.col("doc_id").cast("int").alias("chunk_index"), "text", F.col("lang").alias("title"))
    hits = small(written(lexical.bm25_top_k(docs, _benchmark_queries(spark, sf_dir), k), "hits")).withColumn("chunk_id", F.col("chunk_id").cast("string"))
    return hits.join(chunks, "chunk_id"), chunks


@query()
def context_assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits, chunks = _candidates(spark, sf_dir, 24)
    return context.assemble_contexts(hits, context.Budget(tokens=1200), chunks, 1, 1).select("qid", "context", "token_count", "truncated", "duplicates", "blocks")


@query()
def multi_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark passage as a question, its sentences as subqueries."""
    asked = multiquery.subqueries(_benchmark_queries(spark, sf_dir).select("qid", F.col("text").alias("question")), lambda t: X.split_sentences(t))
    docs = _documents(spark, sf_dir)
    hits = lexical.bm25_top_k(docs, asked.select(F.col("sub_id").alias("qid"), "text"), 20).withColumnRenamed("qid", "sub_id")
    hits = written(hits.join(asked.drop("text"), "sub_id"), "hits")  # fusion and coverage both read them
    return _rounded(multiquery.fused(hits, coverage=1, k=8), "score")


@query()
def verify_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns as answers: their claims, and whether each stands in the turns before it."""
    turns = table(spark, sf_dir, "conversations")
    before = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)
    answers = turns.withColumn("evidence", F.collect_list("text").over(before)).where("role = 'assistant'").select(F.concat_ws("#", "conv_id", "turn").alias("answer_id"), F.col("text").alias("answer"), "evidence")
    return verification.verify(answers, verification.overlap_judge(0.6))
