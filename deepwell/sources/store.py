"""A versioned store of documents and chunks on plain Parquet folders.

A commit writes data folders first, validates what was written, and then replaces the pointer file ``_CURRENT`` by a rename, so
readers see one generation or the next, and what isn't published (a writer that died) is never read. Each write is a delta;
readers take the latest entry of each document. Compaction rewrites live rows as a new base; the folders it replaces stay until
the next compaction, for readers that planned before. The pointer holds each folder's files and bytes, which ``verify``
checks; blocks have the file system's own checksums. One writer at a time, held by a lock file.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import CorruptStoreError, DimensionMismatchError, InvalidInputError, LockedError, NotFoundError
from ..functions.vectors import is_sparse, is_valid

DELTAS = 16
ENTRY = "document_id string, version long, content_hash string, title string, uri string, source_id string, metadata map<string,string>, attributes string, created_at timestamp, deleted boolean, seq long"
CHUNK = "document_id string, document_version long, chunk_index int, chunk_id string, text string, token_count int, section_path array<string>, page_number int, char_start int, char_end int, embedding array<float>, sparse struct<indices:array<int>,values:array<float>>, seq long"


class Store:
    def __init__(self, spark: SparkSession, path: str, dim: int | None = None, metric: str = "cosine"):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._p("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        state = self.state()
        if state is None:
            self._publish({"generation": 0, "seq": 0, "base": None, "deltas": [], "dim": dim, "metric": metric})
        elif dim is not None and state["dim"] not in (None, dim):
            raise DimensionMismatchError(f"the store's vectors have {state['dim']} components, not {dim}")
        elif metric != state["metric"]:
            raise InvalidInputError(f"the store's metric is {state['metric']}, not {metric}")

    # --- the pointer

    def _p(self, name: str) -> Any:
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def state(self) -> dict | None:
        at = self._p("_CURRENT")
        if not self._fs.exists(at):
            return None
        stream = self._fs.open(at)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _publish(self, state: dict) -> None:
        tmp = self._p(f"_CURRENT.{uuid.uuid4().hex}")
        out = self._fs.create(tmp, True)
        out.write(bytearray(json.dumps(state, sort_keys=True).encode()))
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._p("").toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(tmp, self._p("_CURRENT"), options)

    @contextmanager
    def _writer(self) -> Iterator[dict]:
        """The state, for one writer."""
        lock = self._p("_LOCK")
        try:
            self._fs.create(lock, False).close()
        except Exception as e:
            raise LockedError(f"{self.path} has a writer (remove _LOCK if it died)") from e
        try:
            state = self.state()
            if state is None:
                raise NotFoundError(self.path)
            yield state
        finally:
            self._fs.delete(lock, False)

    # --- reading

    def _read(self, kind: str, ddl: str) -> DataFrame:
        state = self.state() or {"base": None, "deltas": []}
        parts = [f"{self.path}/{d}/{kind}" for d in [state["base"], *state["deltas"]] if d and self._fs.exists(self._p(f"{d}/{kind}"))]
        return self.spark.read.schema(ddl).parquet(*parts) if parts else self.spark.createDataFrame([], ddl)

    def entries(self) -> DataFrame:
        """All versions and deletions ever written since the last compaction."""
        return self._read("documents", ENTRY)

    def documents(self) -> DataFrame:
        """The current version of each live document. The latest entry is an aggregate, so map-side combining comes first."""
        rows = self.entries()
        last = rows.groupBy("document_id").agg(F.max_by(F.struct(*rows.columns[1:]), "seq").alias("e")).select("document_id", "e.*")
        return last.where("NOT deleted")

    def chunks(self) -> DataFrame:
        """Chunks of current versions."""
        live = self.documents().select("document_id", F.col("version").alias("document_version"), "seq")
        return self._read("chunks", CHUNK).join(live, ["document_id", "document_version", "seq"], "left_semi").drop("seq")

    def versions(self, document_id: str) -> DataFrame:
        rows = self.entries().where((F.col("document_id") == document_id) & ~F.col("deleted"))
        return rows.select("version", "content_hash", "created_at").orderBy("version")

    def document(self, document_id: str) -> DataFrame:
        return self.documents().where(F.col("document_id") == document_id)

    def document_chunks(self, document_id: str) -> DataFrame:
        return self.chunks().where(F.col("document_id") == document_id).orderBy("chunk_index")

    def stats(self) -> dict:
        state = self.state() or {}
        live = self.chunks().agg(F.countDistinct("document_id"), F.count("*")).first()
        total = self._read("chunks", CHUNK).count()
        return {"documents": live[0], "live_chunks": live[1], "total_rows": total, "tombstones": total - live[1], "generation": state.get("generation"), "seq": state.get("seq"), "deltas": len(state.get("deltas", []))}

    # --- writing

    def _check(self, documents: DataFrame, chunks: DataFrame, state: dict) -> None:
        """Of written tables."""
        if documents.groupBy("document_id").count().where("count > 1 OR document_id IS NULL").head(1):
            raise InvalidInputError("document_id must be given and unique within a write")
        dim = state["dim"]
        if dim is None:
            first = chunks.where("embedding IS NOT NULL").select(F.size("embedding")).first()
            dim = state["dim"] = first[0] if first else None
        bad = F.col("sparse").isNotNull() & ~is_sparse(F.col("sparse.indices"), F.col("sparse.values"))
        if dim is not None and chunks.where(F.col("embedding").isNotNull() & ~is_valid(F.col("embedding"), dim)).head(1):
            raise DimensionMismatchError(f"an embedding isn't {dim} finite numbers")
        if chunks.where(bad).head(1):
            raise InvalidInputError("a sparse vector's indices must ascend and match its values")

    def _manifest(self, name: str) -> list[int]:
        """Files and bytes under a folder."""
        total = self._fs.getContentSummary(self._p(name))
        return [total.getFileCount(), total.getLength()]

    def verify(self) -> None:
        """Raises CorruptStoreError if a published folder isn't as it was written."""
        state = self.state() or {}
        for name, want in state.get("manifests", {}).items():
            have = self._manifest(name) if self._fs.exists(self._p(name)) else None
            if have != want:
                raise CorruptStoreError(f"{self.path}/{name} has {have} files and bytes, not {want}")

    @staticmethod
    def _shape(df: DataFrame, ddl: str, **values: Any) -> DataFrame:
        out = []
        for part in df.sparkSession.createDataFrame([], ddl).schema:
            c = values.get(part.name, F.col(part.name) if part.name in df.columns else F.lit(None))
            out.append(c.cast(part.dataType).alias(part.name))
        return df.select(*out)

    def upsert(self, documents: DataFrame, chunks: DataFrame) -> int:
        """Replaces whole documents: (document_id, ..), and their chunks (document_id, chunk_index, text, ..). Versions go up by one; what was written is checked before it is published. The commit's number."""
        with self._writer() as state:
            seq, name = state["seq"] + 1, f"delta-{state['seq'] + 1:08d}-{uuid.uuid4().hex[:8]}"
            try:
                have = self.documents().select("document_id", F.col("version").alias("_have"))
                asked = F.col("version") if "version" in documents.columns else F.lit(1)
                rows = documents.join(have, "document_id", "left").withColumn("version", F.greatest(F.coalesce("_have", F.lit(0)) + 1, F.coalesce(asked, F.lit(1)).cast("long"))).drop("_have")
                self._shape(rows, ENTRY, deleted=F.lit(False), seq=F.lit(seq), created_at=F.current_timestamp()).write.parquet(f"{self.path}/{name}/documents")
                put = self.spark.read.schema(ENTRY).parquet(f"{self.path}/{name}/documents")
                own = chunks.drop("document_version").join(put.select("document_id", F.col("version").alias("document_version")), "document_id")
                if "chunk_id" not in own.columns:
                    own = own.withColumn("chunk_id", F.concat_ws("#", "document_id", "chunk_index"))
                self._shape(own, CHUNK, seq=F.lit(seq)).write.parquet(f"{self.path}/{name}/chunks")
                self._check(put, self.spark.read.schema(CHUNK).parquet(f"{self.path}/{name}/chunks"), state)
            except Exception:
                self._fs.delete(self._p(name), True)
                raise
            manifests = state.get("manifests", {}) | {name: self._manifest(name)}
            self._publish(state | {"seq": seq, "deltas": [*state["deltas"], name], "manifests": manifests})
        if len(state["deltas"]) + 1 >= DELTAS:
            self.compact()
        return seq

    def delete(self, ids: DataFrame) -> int:
        """Of the documents in (document_id), how many there were."""
        with self._writer() as state:
            gone = self.documents().join(ids.select("document_id").distinct(), "document_id", "left_semi")
            n = gone.count()
            if n:
                seq, name = state["seq"] + 1, f"delta-{state['seq'] + 1:08d}-{uuid.uuid4().hex[:8]}"
                self._shape(gone.select("document_id"), ENTRY, deleted=F.lit(True), seq=F.lit(seq), created_at=F.current_timestamp(), version=F.lit(0)).write.parquet(f"{self.path}/{name}/documents")
                manifests = state.get("manifests", {}) | {name: self._manifest(name)}
                self._publish(state | {"seq": seq, "deltas": [*state["deltas"], name], "manifests": manifests})
        return n

    def compact(self) -> None:
        """Live rows only, as one base. The folders it replaces go with the next compaction."""
        self.rebuild()

    def rebuild(self, change: Callable[[DataFrame], DataFrame] | None = None, **settings: Any) -> None:
        """Compaction, with the chunks changed on the way and other ``settings`` (dim, model) published with them."""
        with self._writer() as state:
            name = f"base-{state['generation'] + 1:06d}-{uuid.uuid4().hex[:8]}"
            live = self.documents()
            live.write.parquet(f"{self.path}/{name}/documents")
            kept = self._read("chunks", CHUNK).join(live.select("document_id", F.col("version").alias("document_version"), "seq"), ["document_id", "document_version", "seq"], "left_semi")
            kept = kept if change is None else change(kept)
            self._shape(kept, CHUNK).repartition("document_id").sortWithinPartitions("document_id", "chunk_index").write.parquet(f"{self.path}/{name}/chunks")
            old = [d for d in [state["base"], *state["deltas"]] if d]
            self._publish(state | {"generation": state["generation"] + 1, "base": name, "deltas": [], "retired": old, "manifests": {name: self._manifest(name)}} | settings)
            for gone in state.get("retired", []):
                self._fs.delete(self._p(gone), True)

    def note(self, **settings: Any) -> None:
        """Publishes settings beside the data."""
        with self._writer() as state:
            self._publish(state | settings)

    def export_dense(self) -> DataFrame:
        return self.chunks().where("embedding IS NOT NULL").select("chunk_id", "embedding")
