"""What a larger table or another layout must not change."""

import numpy as np

from deepwell.operators import dense, evaluation, lexical, sparse, verification
from deepwell.sources import files


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_sparse_search_is_exact_and_never_joins_keys_with_queries(spark, monkeypatch):
    r = np.random.default_rng(1)
    x = np.where(r.random((300, 12)) < 0.25, r.normal(size=(300, 12)), 0)
    x[7, 3] = 0
    some = [(i, j, float(x[i, j])) for i in range(300) for j in range(12) if x[i, j]] + [(500, 3, None), (501, 2, float("nan"))]
    post = spark.createDataFrame(some, "chunk_id long, dim int, value double")
    want = set()
    for q in range(300):
        pairs = [(-round(float(x[q] @ x[i]), 9), i) for i in range(300) if (x[q].astype(bool) & x[i].astype(bool)).any()]
        want |= {(q, i, rank) for rank, (_, i) in enumerate(sorted(pairs)[:40], 1)}
    asked = post.where("chunk_id < 500").withColumnRenamed("chunk_id", "qid")
    monkeypatch.setattr(sparse, "BLOCK_BYTES", 12 * 8 * 70)
    got = sparse.sparse_top_k(post.repartition(3), asked, 40)
    assert {(row.qid, row.chunk_id, row.rank) for row in got.collect()} == want
    fine = post.where("chunk_id < 500")
    assert "Join" not in plan(sparse.sparse_top_k(fine, asked, 5))


def test_metrics_of_classes_are_those_of_their_listed_members(spark):
    r = np.random.default_rng(2)
    label = [None if i == 5 else int(c) for i, c in enumerate(r.integers(0, 3, 40))] + [9]
    classes = spark.createDataFrame(list(enumerate(label)), "id long, class int")
    hits = spark.createDataFrame([(q, int(c), n) for q in range(41) if q != 3 for n, c in enumerate(r.permutation(41)[:8], 1)], "qid long, chunk_id long, rank int")
    relevant = spark.createDataFrame([(q, [str(i) for i, c in enumerate(label) if c == label[q]]) for q in range(41) if label[q] is not None], "qid long, relevant_ids array<string>")
    rows = lambda df: sorted(tuple(round(v, 9) for v in row) for row in df.collect())
    of_class = evaluation.per_query_of_class(hits, classes, 6)
    assert rows(of_class) == rows(evaluation.per_query(hits.selectExpr("*", "chunk_id AS document_id"), relevant, 6))
    assert "collect_list(cast(id" not in plan(of_class)


def test_a_chunk_stays_whole_under_a_filter(spark, tmp_path):
    """The filter's join has the partitioning that a shuffle by chunk asks for; Spark then left that shuffle out."""
    r = np.random.default_rng(3)
    texts = [(i, " ".join(f"w{w}" for w in r.integers(0, 60, 80))) for i in range(600)]
    spark.createDataFrame(texts, "chunk_id long, text string").repartition(6).write.parquet(f"{tmp_path}/chunks")
    chunks = spark.read.parquet(f"{tmp_path}/chunks")
    asked = spark.createDataFrame([(q, " ".join(f"w{w}" for w in r.integers(0, 60, 20))) for q in range(5)], "qid long, text string")
    key = lambda df: sorted((row.qid, row.chunk_id, round(row.score, 6)) for row in df.collect())
    whole = lexical.bm25_top_k(chunks, asked, 600).where("chunk_id % 2 = 0")
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        assert key(lexical.bm25_top_k(chunks, asked, 600, chunks.where("chunk_id % 2 = 0"))) == key(whole)
    finally:
        for name in settings:
            spark.conf.unset(name)


def test_bm25_by_numbers_equals_the_definition(spark, monkeypatch):
    """Blocks, many asked terms, and several texts of a key."""
    r = np.random.default_rng(4)
    texts = [(i if i else 1, " ".join(f"W{w}" for w in r.integers(0, 90, n))) for i, n in enumerate(r.integers(0, 60, 200))] + [(300, None)]
    chunks = spark.createDataFrame(texts, "chunk_id long, text string").repartition(5)
    asked = spark.createDataFrame([(q, " ".join(f"w{w}" for w in r.integers(0, 120, 12))) for q in range(9)], "qid long, text string")
    post = lexical.postings(chunks)
    stats = lexical.corpus_stats(chunks)
    want = {(row.qid, row.chunk_id, round(row.score, 6)) for row in lexical.bm25_scores(post, stats, asked).collect()}
    key = lambda df: {(row.qid, row.chunk_id, round(row.score, 6)) for row in df.collect()}
    assert key(lexical.bm25_top_k(chunks, asked, 500)) == want
    monkeypatch.setattr(lexical, "MOST_QUERIES", 2)
    monkeypatch.setattr(lexical, "SMALL", 0)
    assert key(lexical.bm25_top_k(chunks, asked, 500)) == want


def test_queries_do_not_pass_the_driver_a_row_each_and_tiles_change_nothing(spark, monkeypatch):
    r = np.random.default_rng(5)
    x = r.integers(-1, 2, (500, 4)).astype(float)  # many ties, and zero vectors
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "chunk_id long, embedding array<float>").repartition(3)
    asked = df.selectExpr("chunk_id AS qid", "cast(embedding AS array<double>) AS vector")
    monkeypatch.setattr(dense, "TILE", 1000)
    monkeypatch.setattr(dense, "ROWS", 40)
    monkeypatch.setattr(dense, "BLOCK_BYTES", 8 * 4 * 150)
    assert [len(q) for q, _ in dense.query_blocks(asked, 4)] == [150, 150, 150, 50]
    u = dense.unit(x)
    for metric, s in (("cosine", u @ u.T), ("l2", -((x[:, None] - x[None]) ** 2).sum(2))):
        got = {(row.qid, row.chunk_id) for row in dense.dense_top_k(df, asked, 6, 4, metric).collect()}
        assert got == {(i, int(j)) for i in range(500) for j in np.lexsort((np.arange(500), -np.round(s[i], 9)))[:6]}


def test_a_table_in_parts_is_one_file(spark, tmp_path):
    spark.range(9).repartition(3).write.parquet(f"{tmp_path}/in/a.parquet")
    spark.range(9).repartition(2).write.parquet(f"{tmp_path}/in/labels.parquet")
    (tmp_path / "in/b.parquet").write_bytes(b"12")
    got = files.discover(spark, f"{tmp_path}/in", ("*.parquet",), ("*labels.parquet",), content=False).collect()
    assert sorted(row.relative for row in got) == ["a.parquet", "b.parquet"]
    size = {row.relative: row.length for row in got}
    assert size["b.parquet"] == 2 and size["a.parquet"] == sum(p.stat().st_size for p in (tmp_path / "in/a.parquet").glob("part*"))
    assert {row.path.rsplit("/in/", 1)[1] for row in got} == {"a.parquet", "b.parquet"}


def test_evidence_is_split_into_terms_once(monkeypatch):
    seen, terms = [], verification.terms
    monkeypatch.setattr(verification, "terms", lambda t: seen.append(t) or terms(t))
    judge = verification.overlap_judge(0.6)
    evidence = ["The fee was cancelled in May.", "ΟΔΟΣ ΣΑΣ, 東京 x"]
    said = [verification.judged("The fee was cancelled. It rained all day. οδοσ σασ.", evidence[:n], judge) for n in (1, 2)]
    assert [[c["verdict"] for c in rows] for rows in said] == [["supported", "unsupported", "unsupported"], ["supported", "unsupported", "supported"]]
    assert all(seen.count(e) == 1 for e in evidence)


def test_tables_of_the_queries_reach_python_in_bounded_batches(spark, tmp_path):
    from deepwell import queries as Q

    spark.range(3).write.parquet(f"{tmp_path}/t.parquet")
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    assert Q.table(spark, str(tmp_path), "t").count() == 3
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) <= 4 << 20


def test_an_index_has_a_file_for_each_list(spark, tmp_path):
    from deepwell.plans import indexes

    r = np.random.default_rng(6)
    chunks = spark.createDataFrame([(i, f"w{i % 7} word", r.normal(size=4).tolist()) for i in range(400)], "chunk_id long, text string, embedding array<float>").repartition(4)
    index = indexes.build(chunks, f"{tmp_path}/index", 4)
    lists = list((tmp_path / "index/lists").glob("list_id=*"))
    assert lists and all(len(list(p.glob("part*"))) == 1 for p in lists)
    assert index._read("lengths").count() == 400 and index._read("postings").agg({"tf": "sum"}).first()[0] == 800


def test_codes_are_searched_by_their_definition_in_many_tasks(spark, monkeypatch):
    """Tables of distances are sums over subspaces; Spark joined the lists of small tables into few tasks, each with all their hits."""
    from deepwell.operators import inverted

    r = np.random.default_rng(8)
    x = r.normal(size=(900, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))], "chunk_id long, embedding array<float>")
    x = dense.unit(x.astype(np.float32).astype(float))
    centroids, books = inverted.train_lists(df, 8, 900), inverted.train_codes(df, 8)
    coded = inverted.encode(inverted.assign(df, centroids), books)
    q = dense.unit(r.normal(size=(7, 8)))
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "qid long, vector array<double>")
    code = {row.chunk_id: np.frombuffer(row.codes, np.uint8) for row in coded.collect()}
    parts = q.reshape(7, len(books), -1)
    s = np.array([[sum(p[i] @ books[i][code[j][i]] for i in range(len(books))) for j in range(900)] for p in parts])
    near = np.argsort(-s, axis=1, kind="stable")[:, :36]
    want = {(a, int(j)) for a in range(7) for j in sorted(near[a], key=lambda j: -(q[a] @ x[j]))[:4]}
    assert {(row.qid, row.chunk_id) for row in inverted.code_top_k(coded, asked, centroids, books, 4, len(centroids)).collect()} == want
    monkeypatch.setattr(inverted, "TASK_HITS", 100)  # what is kept from list to list leaves after every third query
    assert {(row.qid, row.chunk_id) for row in inverted.code_top_k(coded, asked, centroids, books, 4, len(centroids)).collect()} == want
    monkeypatch.undo()
    members = dense.usable(coded, 8, "chunk_id", "embedding", "list_id", "codes").select("list_id", "key", "v", "codes")
    met = inverted._met(members, inverted.probes(asked, centroids, 3), 1, 8, 40 << 20)
    assert met.rdd.getNumPartitions() == 40
    one = inverted._met(members, inverted.probes(asked, centroids, len(centroids)), 7, 8, 1).coalesce(1).sortWithinPartitions("list_id", "part", "kind")
    assert one.mapInArrow(inverted._in_lists(4, 8, "cosine"), "qid long, key long, score double, exact double").count() == 28  # not for each list


def test_distances_to_many_lists_are_held_in_blocks():
    import tracemalloc

    from deepwell.operators import inverted

    r = np.random.default_rng(9)
    x, c = r.normal(size=(10_000, 16)), r.normal(size=(1024, 16))
    tracemalloc.start()
    got = inverted.nearest(x, c)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 24 << 20  # all distances at once are 80 MB
    assert (got == [((c - v) ** 2).sum(1).argmin() for v in x]).all() and len(inverted.nearest(x[:0], c)) == 0


def test_contexts_leave_the_texts_where_they_are(spark):
    """Few hits go to the chunks; tokens are estimated of those that were found."""
    from deepwell import queries as Q
    from deepwell.operators import context

    hits, chunks = Q._candidates(spark, "/root/testdata/sf0.001", 24)
    assert "strategy=broadcast" in plan(hits) and "strategy=broadcast" in plan(Q._hits(spark, "/root/testdata/sf0.001", "doc_id"))
    assert "strategy=broadcast" in plan(context.neighbors(hits, chunks, 1, 1)) and "token_count" not in chunks.columns
    counts = {row.chunk_id: row.token_count for row in context._shape(hits, []).collect()}
    assert all(counts[row.chunk_id] == context.estimate(row.text) for row in hits.collect())


def test_subqueries_are_searched_once(spark, monkeypatch):
    from deepwell import queries as Q

    monkeypatch.setattr(Q, "_rounded", lambda df, *columns: df)
    got = plan(Q.multi_query(spark, "/root/testdata/sf0.001"))
    assert "MapInArrow" not in got and "_products" not in got and "scan(" not in got  # the search ran; its hits are read


def test_texts_meet_no_vector_and_vectors_without_a_text_are_found(spark, tmp_path, monkeypatch):
    from deepwell import queries as Q

    r = np.random.default_rng(10)
    x = r.normal(size=(30, 64)).astype(np.float32)
    spark.createDataFrame([(i, f"w{i % 5} word", "en" if i % 2 else "de", 9) for i in range(20)], "doc_id long, text string, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(25, "absent"), (3, "w3"), (99, "w1")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    seen, top = [], lexical.bm25_top_k
    monkeypatch.setattr(lexical, "bm25_top_k", lambda chunks, *rest: seen.append(plan(chunks)) or top(chunks, *rest))
    u = dense.unit(x.astype(float))
    got = {(row.qid, row.chunk_id) for row in Q.hybrid_search(spark, str(tmp_path)).collect()}
    assert {c for q, c in got if q == 25} == set(np.argsort(-u @ u[25])[:10].tolist())  # 20 to 29 have no text
    assert {c for q, c in got if q == 99} == {1, 6, 11, 16}
    odd = {c for q, c in ((row.qid, row.chunk_id) for row in Q.hybrid_search_filtered(spark, str(tmp_path)).collect()) if q == 25}
    assert odd == set(sorted(range(1, 20, 2), key=lambda i: -u[i] @ u[25])[:10])
    assert len(seen) == 2 and not any("Join" in p for p in seen)
