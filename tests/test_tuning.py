"""Evaluation, indexes, migration and typed metadata over a real knowledge base."""

import json

import numpy as np
import pytest

from deepwell.errors import CorruptStoreError, EvaluationError, InvalidInputError
from deepwell.functions.embedding import HashedNgrams
from deepwell.plans import tuning
from deepwell.plans.config import Config
from deepwell.plans.knowledge_base import KnowledgeBase

TEXTS = ["apples are red and round fruit", "pears are yellow fruit of autumn", "ships carry freight over the sea", "trains carry freight over land", "cancellation fees are ten euros", "the warehouse opens at nine"]


@pytest.fixture(scope="module")
def kb(spark, tmp_path_factory):
    kb = KnowledgeBase(spark, f"file://{tmp_path_factory.mktemp('kb')}/s", Config.resolve("offline"), HashedNgrams(64))
    rows = [(f"d{i}", t, json.dumps({"n": i, "tags": ["even" if i % 2 == 0 else "odd"], "draft": i == 5, "status": "active"})) for i, t in enumerate(TEXTS)]
    kb.add(spark.createDataFrame(rows, "document_id string, text string, metadata string"))
    return kb


@pytest.fixture(scope="module")
def dataset(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("data") / "questions.jsonl"
    path.write_text("\n".join(json.dumps({"question": q, "relevant_ids": [d]}) for q, d in (("red apples", "d0"), ("freight by sea ships", "d2"), ("cancellation fees", "d4"))))
    return tuning.read_dataset(spark, str(path))


def ask(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "qid long, text string")


def test_evaluate_compare_tune_apply_and_reports(spark, kb, dataset):
    report = tuning.evaluate(kb, dataset, 2)
    assert report.metrics["queries"] == 3 and report.metrics["recall"] == 1.0 and report.metrics["full_recall"] == 1.0
    best, all_of = tuning.tune(kb, dataset, {"dense_weight": [0.0, 1.0], "bm25_weight": [1.0]}, 1, "mrr")
    assert len(all_of) == 2 and best.metrics["mrr"] == max(r.metrics["mrr"] for r in all_of)
    new = tuning.apply(kb, best)
    assert new.config == best.config == tuning.applied(kb)
    assert "| recall |" in tuning.to_markdown(all_of) and "<th>recall</th>" in tuning.to_html(all_of) and json.loads(best.to_json())["metrics"]
    with pytest.raises(EvaluationError):
        tuning.tune(kb, dataset, {"dense_weight": [1.0]}, objective="speed")
    with pytest.raises(EvaluationError):
        tuning.evaluate(kb, dataset.where("false"))


def test_typed_metadata_filters(spark, kb):
    found = lambda spec: {r.chunk_id.split("#")[0] for r in kb.search(ask(spark, "freight fruit fees warehouse"), 6, "keyword", spec).collect()}
    assert found({"n": {"$gte": 3}}) == {"d3", "d4", "d5"}
    assert found({"tags": {"contains": "even"}}) == {"d0", "d2", "d4"} and found({"draft": True}) == {"d5"} and found({"n": "3"}) == set()


def test_an_index_gives_the_same_hits_and_follows_changes(spark, kb):
    asked = ask(spark, "freight over the sea", "yellow autumn fruit")
    flat = sorted(map(tuple, kb.search(asked, 4).collect()))
    kb.build_index()
    full = KnowledgeBase(spark, kb.path, Config.resolve("offline", nprobe=10_000), kb.embedder)
    assert sorted(map(tuple, full.search(asked, 4).collect())) == flat
    few = KnowledgeBase(spark, kb.path, Config.resolve("offline", nprobe=1), kb.embedder)
    starved = few.search(asked, 2, "dense", {"n": {"$lte": 3}}).collect()
    assert len(starved) == 4  # widened to all lists
    kb.add(spark.createDataFrame([("d6", "freight over the sea again", '{"n": 6}'), ("d0", "apples are green", '{"n": 0}')], "document_id string, text string, metadata string"))
    seen = full.search(asked, 8, "hybrid").collect()
    assert "d6#0" in {r.chunk_id for r in seen} or any(r.chunk_id.startswith("d6") for r in seen)
    bare = KnowledgeBase(spark, kb.path, Config.resolve("offline", index="flat"), kb.embedder)
    bare.index = lambda: None
    assert sorted(map(tuple, full.search(asked, 8).collect())) == sorted(map(tuple, bare.search(asked, 8).collect()))
    signals = kb.explain(asked, 2).first().signals
    assert {s.signal for s in signals} <= {"dense", "keyword"} and signals


def test_multi_with_given_subqueries_their_filters_and_reranking(spark, kb):
    rows = spark.createDataFrame([(0, "freight and fruit", ["freight over land", "yellow fruit"])], "qid long, question string, subqueries array<string>")
    got = kb.retrieve_multi(rows, 4, subquery_filters={2: {"n": 1}}).first()
    assert {"d1", "d3"} <= {c.document_id for c in got.citations}
    turned = kb.retrieve_multi(rows, 1, coverage=0, rerank=lambda qid, hits: hits[::-1]).first()
    assert turned is not None and len(turned.chunks) == 1
    out = kb.ask_multi("What carries freight? What is yellow?", lambda prompt: "Ships do [1].")
    assert out["answer"] == "Ships do [1]."


def test_tenants_keep_their_documents(spark, kb):
    one, two = kb.tenant("t1"), kb.tenant("t2")
    one.add(spark.createDataFrame([("own", "plums are blue", 3)], "document_id string, text string, n int").selectExpr("document_id", "text", "named_struct('n', n) AS metadata"))
    with pytest.raises(InvalidInputError):
        two.add(spark.createDataFrame([("own", "stolen")], "document_id string, text string"))
    assert [r.chunk_id.split("#")[0] for r in one.search(ask(spark, "blue plums"), 3, "keyword", {"n": 3}).collect()] == ["own"]
    assert two.search(ask(spark, "blue plums"), 3, "keyword").collect() == []


def test_vectors_migrate_export_and_import(spark, kb, tmp_path):
    kb.export_vectors(f"file://{tmp_path}/out")
    rows = spark.read.parquet(f"file://{tmp_path}/out")
    other = KnowledgeBase(spark, f"file://{tmp_path}/other", Config.resolve("offline"), HashedNgrams(64))
    other.import_vectors(rows)
    assert other.store.chunks().count() == rows.count()
    wide = other.migrate_embeddings(HashedNgrams(128))
    assert {len(r.embedding) for r in wide.store.chunks().collect()} == {128} and wide.store.state()["dim"] == 128
    assert wide.search(ask(spark, "cancellation fees"), 1).first().chunk_id.startswith("d4")
    wide.store.verify()
    name = wide.store.state()["base"]
    next((tmp_path / "other" / name / "chunks").glob("*.parquet")).unlink()
    with pytest.raises(CorruptStoreError):
        wide.store.verify()


def test_known_texts_are_not_embedded_again(spark, tmp_path):
    class Counted(HashedNgrams):
        def embed_documents(self, texts):
            assert not any("seen before" in t for t in texts) or not Counted.closed
            return super().embed_documents(texts)

    Counted.closed = False
    kb = KnowledgeBase(spark, f"file://{tmp_path}/s", Config.resolve("offline"), Counted(32))
    kb.add(spark.createDataFrame([("a", "a text seen before")], "document_id string, text string"))
    Counted.closed = True
    kb.embedder = Counted(32)
    kb.add(spark.createDataFrame([("b", "a text seen before"), ("c", "another")], "document_id string, text string"))
    got = {r.chunk_id.split("#")[0]: r.embedding for r in kb.store.chunks().collect()}
    assert np.allclose(got["a"], got["b"]) and got["c"] is not None
