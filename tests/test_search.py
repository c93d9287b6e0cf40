import numpy as np
import pytest

from deepwell.errors import DimensionMismatchError, InvalidInputError
from deepwell.operators import dense, inverted, lexical, rank
from deepwell.plans.search import resolve_mode, search


@pytest.fixture(scope="module")
def vectors(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(400, 16))
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "chunk_id long, embedding array<float>").cache()


@pytest.fixture(scope="module")
def asked(spark):
    r = np.random.default_rng(5)
    q = r.normal(size=(6, 16))
    return q, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "qid long, vector array<double>").cache()


def exact(x, q, k, metric):
    x = x.astype(np.float32).astype(float)
    if metric == "cosine":
        x, q = dense.unit(x), dense.unit(q)
    s = dense.scores(q, x, metric)
    return {(i, int(j)) for i, line in enumerate(s) for j in np.argsort(-line, kind="stable")[:k]}


def found(df):
    return {(r.qid, r.chunk_id) for r in df.collect()}


@pytest.mark.parametrize("metric", ["cosine", "dot", "l2"])
def test_flat_equals_sort_and_blocks_change_nothing(vectors, asked, metric, monkeypatch):
    (x, df), (q, qs) = vectors, asked
    want = exact(x, q, 7, metric)
    assert found(dense.dense_top_k(df, qs, 7, 16, metric)) == want
    monkeypatch.setattr(dense, "BLOCK_BYTES", 8 * 16 * 2)
    monkeypatch.setattr(dense, "TILE", 100)
    assert found(dense.dense_top_k(df.repartition(5), qs, 7, 16, metric)) == want


def test_full_probe_equals_flat_and_recall_grows(vectors, asked):
    (x, df), (q, qs) = vectors, asked
    want = exact(x, q, 10, "cosine")
    c = inverted.train_lists(df, 16, 400)
    assigned = inverted.assign(df, c).cache()
    shares = [len(found(inverted.list_top_k(assigned, qs, c, 10, n)) & want) for n in (2, 8, len(c))]
    assert shares == sorted(shares) and shares[-1] == len(want)
    books = inverted.train_codes(df, 16)
    got = found(inverted.code_top_k(inverted.encode(assigned, books), qs, c, books, 10, len(c)))
    assert len(got & want) >= 0.9 * len(want)


def test_int8_recall_ties_and_errors(spark, vectors, asked):
    (x, df), (q, qs) = vectors, asked
    want = exact(x, q, 10, "cosine")
    assert len(found(dense.int8_top_k(df, qs, 10)) & want) >= 0.95 * len(want)
    with pytest.raises(InvalidInputError):
        dense.int8_top_k(df, qs, 10, metric="l2")
    with pytest.raises(DimensionMismatchError):
        dense.dense_top_k(df, qs, 3, 8)
    same = spark.createDataFrame([(i, [1.0, 0.0]) for i in (9, 4, 7)] + [(1, None)], "chunk_id long, embedding array<float>")
    one = spark.createDataFrame([(0, [1.0, 0.0])], "qid long, vector array<double>")
    assert [r.chunk_id for r in dense.dense_top_k(same, one, 2, 2).orderBy("rank").collect()] == [4, 7]


def test_bm25_edges(spark):
    chunks = spark.createDataFrame([(1, "red fox"), (2, "red red dog"), (3, None), (4, "")], "chunk_id long, text string")
    ask = lambda t: spark.createDataFrame([(0, t)], "qid long, text string")
    assert [r.chunk_id for r in lexical.bm25_top_k(chunks, ask("RED dog dog"), 5).orderBy("rank").collect()] == [2, 1]
    assert lexical.bm25_top_k(chunks, ask("!!"), 5).count() == lexical.bm25_top_k(chunks.limit(0), ask("red"), 5).count() == 0


def test_modes_and_batch_equals_single(spark, vectors):
    _, df = vectors
    chunks = df.selectExpr("concat('c', chunk_id) AS chunk_id", "embedding", "concat('word', chunk_id % 7, ' term', chunk_id % 5) AS text", "chunk_id % 3 AS part")
    qs = spark.createDataFrame([(i, f"word{i} term{i}", [float(i == j) for j in range(16)]) for i in range(4)], "qid long, text string, vector array<double>")
    whole = search(chunks, qs, 5, spec={"part": {"$ne": 1}})
    assert {r.part for r in whole.join(chunks, "chunk_id").select("part").collect()} <= {0, 2}
    each = [r for i in range(4) for r in search(chunks, qs.where(f"qid = {i}"), 5, spec={"part": {"$ne": 1}}).collect()]
    key = lambda r: (r.qid, r.rank, r.chunk_id)
    assert sorted(map(key, whole.collect())) == sorted(map(key, each)) and len(each) == 20
    assert resolve_mode("auto", ["qid", "text", "vector"]) == "hybrid" and resolve_mode("auto", ["sparse"]) == "sparse"
    for wrong in (("fast", ["text"]), ("auto", ["qid"])):
        with pytest.raises(InvalidInputError):
            resolve_mode(*wrong)


def test_top_k_drops_nan(spark):
    s = spark.createDataFrame([(0, 1, float("nan")), (0, 2, 1.0), (0, 3, 1.0), (0, 4, 2.0)], "qid long, chunk_id long, score double")
    assert [r.chunk_id for r in rank.top_k(s, 2).orderBy("rank").collect()] == [4, 2]


def test_a_searcher_and_a_token_encoder_of_the_callers(spark):
    from deepwell.operators.dense import dense_top_k, max_sim_top_k
    from deepwell.plans.search import search

    chunks = spark.createDataFrame([("a", "red apple", [1.0, 0.0]), ("b", "green pear", [0.0, 1.0]), ("c", None, None)], "chunk_id string, text string, embedding array<float>")
    queries = spark.createDataFrame([(1, "pear", [1.0, 0.2])], "qid long, text string, vector array<double>")
    asked = []

    def searcher(rows, q, k):
        asked.append(k)
        return dense_top_k(rows, q, k, 2)

    assert [tuple(r) for r in search(chunks, queries, 2, mode="dense", searcher=searcher).select("qid", "chunk_id", "rank").orderBy("rank").collect()] == [(1, "a", 1), (1, "b", 2)] and asked == [50]

    def encode(texts):
        import numpy as np

        return [np.array([[w == x for x in ("red", "apple", "green", "pear")] for w in t.split()], float).reshape(-1, 4) for t in texts]

    hits = chunks.select("chunk_id", "text").crossJoin(queries.select("qid"))
    assert [(r.chunk_id, r.score) for r in max_sim_top_k(hits, queries, encode, 2).orderBy("rank").collect()] == [("b", 1.0), ("a", 0.0)]


def test_registered_list_searches_reach_their_recall(spark, tmp_path):
    """Of ``ivf_topk`` and ``ivf_pq_topk`` as registered, against every vector."""
    import numpy as np

    from deepwell import queries as Q

    r = np.random.default_rng(3)
    label = r.integers(0, 10, 1500)
    x = (r.normal(size=(10, 64))[label] * 0.4 + r.normal(size=(1500, 64))).astype(np.float32)
    spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, label))], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    for name, k in (("ivf_topk", 5), ("ivf_pq_topk", 10)):
        got = {(row.qid, row.chunk_id) for row in Q.QUERIES[name](spark, str(tmp_path)).collect()}
        want = {(i, int(j)) for i in range(0, 1500, 50) for j in np.argsort(-(u[i] @ u.T), kind="stable")[:k]}
        assert len(got & want) >= 0.9 * len(want), name
