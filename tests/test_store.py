import pytest

from deepwell.errors import DimensionMismatchError, InvalidInputError, LockedError
from deepwell.plans.collections import Collections
from deepwell.plans.config import Config
from deepwell.plans.knowledge_base import KnowledgeBase
from deepwell.sources.store import Store
from deepwell.streaming.ingest import ingest


def seen(store):
    docs = sorted((r.document_id, r.version) for r in store.documents().collect())
    return docs, sorted((r.chunk_id, r.text, tuple(r.embedding or ())) for r in store.chunks().collect())


def test_states_survive_compaction_and_reopening(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", 2)
    put = lambda rows: store.upsert(spark.createDataFrame([(i,) for i, _ in rows], "document_id string"), spark.createDataFrame([(i, n, t, [1.0, 2.0]) for i, ts in rows for n, t in enumerate(ts)], "document_id string, chunk_index int, text string, embedding array<float>"))
    put([("a", ["one", "two"]), ("b", ["three"])])
    put([("a", ["new"])])
    assert store.delete(spark.createDataFrame([("b",), ("zz",)], "document_id string")) == 1
    put([("c", ["four"])])
    before = seen(store)
    assert before[0] == [("a", 2), ("c", 1)] and [c[:2] for c in before[1]] == [("a#0", "new"), ("c#0", "four")]
    assert [r.version for r in store.versions("a").collect()] == [1, 2] and store.stats()["tombstones"] == 3
    store.compact()
    assert seen(store) == before == seen(Store(spark, f"file://{tmp_path}/s", 2)) and store.stats()["tombstones"] == 0
    with pytest.raises(DimensionMismatchError):
        Store(spark, f"file://{tmp_path}/s", 3)


def test_invalid_writes_change_nothing(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", 2)
    docs = spark.createDataFrame([("a",)], "document_id string")
    with pytest.raises(DimensionMismatchError):
        store.upsert(docs, spark.createDataFrame([("a", 0, "t", [1.0, float("nan")])], "document_id string, chunk_index int, text string, embedding array<float>"))
    with pytest.raises(InvalidInputError):
        store.upsert(docs.union(docs), spark.createDataFrame([], "document_id string, chunk_index int, text string"))
    assert store.state()["seq"] == 0
    (tmp_path / "s" / "_LOCK").touch()
    with pytest.raises(LockedError):
        store.compact()


def test_knowledge_base_end_to_end(spark, tmp_path):
    folder = tmp_path / "docs"
    folder.mkdir()
    (folder / "ship.md").write_text("# Shipping\n\nParcels leave the warehouse within two days.")
    (folder / "fees.txt").write_text("Cancellation fees are ten euros per booking.")
    (folder / "bad.json").write_text("{")
    kb = KnowledgeBase(spark, f"file://{tmp_path}/kb", Config.resolve("offline"))
    first = kb.sync(str(folder))
    assert first == {"discovered": 3, "added": 2, "updated": 0, "unchanged": 0, "deleted": 0, "failed": 1}
    got = kb.retrieve("cancellation fees", k=1)
    assert "ten euros" in got["context"] and got["citations"][0]["index"] == 1
    (folder / "fees.txt").write_text("Cancellation is free of charge now.")
    (folder / "ship.md").unlink()
    second = kb.sync(str(folder))
    assert second["updated"] == 1 and second["deleted"] == 1
    assert "free" in kb.retrieve("cancellation", k=1)["context"] and kb.store.stats()["documents"] == 1
    out = kb.ask("Is cancellation free?", lambda prompt: "It is free [1]. And [7].")
    assert out["answer"].startswith("It is free [1]") and "[7]" not in out["answer"]
    with pytest.raises(InvalidInputError):
        kb.retrieve("  ")


def test_tenants_collections_and_streams(spark, tmp_path):
    kb = Collections(spark, f"file://{tmp_path}/all").collection("main")
    assert Collections(spark, f"file://{tmp_path}/all").names() == ["main"]
    with pytest.raises(InvalidInputError):
        Collections(spark, f"file://{tmp_path}/all").collection("../up")
    rows = "document_id string, text string"
    kb.tenant("t1").add(spark.createDataFrame([("x", "apples are red")], rows))
    kb.tenant("t2").add(spark.createDataFrame([("y", "apples are green")], rows))
    assert "red" not in kb.tenant("t2").retrieve("apples", k=5)["context"]
    spark.createDataFrame([("s1", "pears are yellow"), ("s2", None)], rows).write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        ingest(spark.readStream.schema(rows).parquet(f"{tmp_path}/in"), kb, f"{tmp_path}/ck").awaitTermination(120)
    assert kb.store.stats()["documents"] == 3
