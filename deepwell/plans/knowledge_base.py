"""The facade: documents in, contexts out."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType, StructType
from pyspark.sql.window import Window as W

from ..errors import InvalidInputError, NotFoundError
from ..functions.embedding import Embedder, embed, fingerprint, resolve_embedding
from ..functions.text import content_id, estimate_tokens, split_sentences
from ..operators import context, filters, multiquery, verification, versions
from ..operators.chunking import Chunking, chunk_documents
from ..sources import files, parsers
from ..sources.scratch import written
from ..sources.store import Store
from . import indexes
from .config import Config
from .search import Searcher, explained, search

_HIT = ("qid", "rank", "score", "chunk_id", "document_id", "document_version", "chunk_index", "text", "token_count", "title", "uri", "section_path", "page_number")


class KnowledgeBase:
    """Over one store. Queries come in batches; a single question is a batch of one."""

    def __init__(self, spark: SparkSession, path: str, config: Config | None = None, embedder: Embedder | None = None, tenant: str | None = None, searcher: Searcher | None = None):
        self.spark, self.config, self.tenant_id, self.searcher = spark, config or Config(), tenant, searcher
        self.embedder = embedder or resolve_embedding(self.config.embedding)
        self.store = Store(spark, path, self.embedder.dimension, self.config.metric)
        self.path = path

    def tenant(self, tenant_id: str) -> KnowledgeBase:
        """A view that writes and sees one tenant's documents only."""
        return KnowledgeBase(self.spark, self.path, self.config, self.embedder, tenant_id, self.searcher)

    @property
    def processing(self) -> str:
        """What content was processed with; a change of it makes every document an update."""
        c = self.config
        return fingerprint(embedding=self.embedder.model_id, strategy=c.strategy, target=c.target_tokens, most=c.max_tokens, overlap=c.overlap_tokens)

    # --- writing

    def add(self, documents: DataFrame) -> int:
        """(text, and where known document_id, title, uri, metadata, format). An id defaults to the text's digest. The number of the commit.

        ``metadata`` is a struct, a map or a JSON object as a string; numbers, booleans and arrays keep their type for filters.
        A tenant can't replace another tenant's document.
        """
        rows = documents
        if "document_id" not in rows.columns:
            rows = rows.withColumn("document_id", content_id(F.col("text")))
        rows = _typed_metadata(rows.where("text IS NOT NULL").withColumn("content_hash", F.sha2("text", 256)))
        if self.tenant_id is not None:
            rows = self._owned(rows)
            theirs = self.store.documents().where(~F.coalesce(F.col("metadata")["tenant_id"] == self.tenant_id, F.lit(False)))
            if rows.join(theirs, "document_id", "left_semi").head(1):
                raise InvalidInputError(f"a document_id belongs to another tenant than {self.tenant_id}")
        return self._write(rows.dropDuplicates(["document_id"]))

    def _owned(self, rows: DataFrame) -> DataFrame:
        """Rows with the tenant in their metadata, whatever they said of one."""
        if self.tenant_id is None:
            return rows
        own = F.create_map(F.lit("tenant_id"), F.lit(self.tenant_id))
        rows = rows.withColumn("metadata", F.map_concat(F.map_filter("metadata", lambda k, v: k != "tenant_id"), own) if "metadata" in rows.columns else own)
        if "attributes" in rows.columns:
            others = F.map_filter(F.from_json("attributes", "map<string,variant>"), lambda k, v: k != "tenant_id")
            named = F.create_map(F.lit("tenant_id"), F.parse_json(F.lit(json.dumps(self.tenant_id))))
            rows = rows.withColumn("attributes", F.to_json(F.map_concat(F.coalesce(others, F.map_filter(named, lambda k, v: F.lit(False))), named)))
        return rows

    def sync(self, folder: str, include: Sequence[str] = (), exclude: Sequence[str] = (), delete: bool = True) -> dict:
        """Mirrors a folder: new and changed files are added, missing ones deleted, failures counted. Files are parsed once."""
        got = written(parsers.parsed(files.discover(self.spark, folder, include, exclude)).withColumn("document_id", F.col("path")), "parsed")
        existing = self.store.documents().where(F.col("source_id") == folder)
        existing = existing.select("document_id", "content_hash", F.col("metadata")["processing"].alias("processing"))
        found = got.where("error IS NULL").withColumn("processing", F.lit(self.processing))
        plan = written(files.sync_plan(existing, got.withColumn("processing", F.lit(self.processing)), "document_id", fingerprint="processing"), "plan")
        broken = got.where("error IS NOT NULL").select("document_id")
        counts = files.sync_counts(plan.join(broken, "document_id", "left_anti")).first().asDict()
        counts["failed"] = broken.count()
        counts["discovered"] += counts["failed"]
        changed = found.join(plan.where("action IN ('added', 'updated')"), "document_id", "left_semi")
        meta = F.map_concat("metadata", F.create_map(F.lit("processing"), F.col("processing")))
        if counts["added"] or counts["updated"]:
            rows = changed.withColumns({"uri": F.col("path"), "source_id": F.lit(folder), "metadata": meta})
            self._write(self._owned(rows.withColumn("attributes", F.to_json("metadata"))))  # content_hash is that of the bytes
        if delete and counts["deleted"]:
            self.store.delete(plan.where("action = 'deleted'").select("document_id"))
        return counts

    def _write(self, rows: DataFrame) -> int:
        c = self.config
        rows = written(rows, "documents")
        chunks = chunk_documents(rows, Chunking(c.strategy, c.target_tokens, c.max_tokens, c.overlap_tokens), fmt="format" if "format" in rows.columns else None)
        return self.store.upsert(rows, self._embedded(chunks.drop("previous_chunk_id", "next_chunk_id")))

    def _embedded(self, chunks: DataFrame) -> DataFrame:
        """Chunks with embeddings: those of texts that the store has embedded with this model come from it, once each."""
        chunks = written(chunks, "chunks").withColumn("_hash", F.sha2("text", 256))
        known = self.store.chunks().where("embedding IS NOT NULL").groupBy(F.sha2("text", 256).alias("_hash")).agg(F.first("embedding").alias("embedding"))
        if (self.store.state() or {}).get("model", self.embedder.model_id) != self.embedder.model_id:
            known = known.where("false")
        new = chunks.join(known, "_hash", "left_anti").groupBy("_hash").agg(F.first("text").alias("text"))
        made = new.select("_hash", embed(F.col("text"), self.embedder).alias("embedding"))
        return chunks.join(known.unionByName(made.select("_hash", F.col("embedding").cast("array<float>").alias("embedding"))), "_hash", "left").drop("_hash")

    def import_vectors(self, rows: DataFrame) -> int:
        """Chunks with vectors of their own: (document_id, chunk_index, text, embedding, and metadata where known). The number of the commit."""
        rows = _typed_metadata(rows)
        documents = self._owned(rows.groupBy("document_id").agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("chunk_index", "text")))), 256).alias("content_hash"), *[F.first(c).alias(c) for c in ("metadata", "attributes", "title", "uri") if c in rows.columns]))
        chunks = rows.select("document_id", "chunk_index", "text", "embedding").withColumn("token_count", estimate_tokens(F.col("text")))
        return self.store.upsert(documents, chunks)

    def export_vectors(self, folder: str) -> None:
        """(chunk_id, document_id, chunk_index, text, embedding) as Parquet, which ``import_vectors`` and vector libraries read."""
        self.store.chunks().where("embedding IS NOT NULL").select("chunk_id", "document_id", "chunk_index", "text", "embedding").write.parquet(folder)

    def migrate_embeddings(self, embedder: Embedder) -> KnowledgeBase:
        """All live chunks embedded anew, published at once; a base that goes on with ``embedder``."""
        self.store.rebuild(lambda chunks: chunks.withColumn("embedding", embed(F.col("text"), embedder)), dim=embedder.dimension, model=embedder.model_id)
        return KnowledgeBase(self.spark, self.path, self.config, embedder, self.tenant_id)

    def build_index(self) -> None:
        """Postings and inverted lists of the live chunks, for searches from now on; what changes later is searched beside them."""
        name = f"index-{uuid.uuid4().hex[:12]}"
        indexes.build(self.store.chunks().select("chunk_id", "text", "embedding"), f"{self.path}/{name}", self.embedder.dimension, self.config.metric)
        self.store.note(index=name)

    def index(self) -> indexes.Index | None:
        name = (self.store.state() or {}).get("index")
        return indexes.Index(self.spark, f"{self.path}/{name}") if name else None

    # --- reading

    def chunks(self) -> DataFrame:
        """Chunks with their document's metadata, title, uri and source; a tenant's own."""
        rows = self._all_chunks()
        return rows if self.tenant_id is None else rows.where(F.col("metadata")["tenant_id"] == self.tenant_id)

    def _all_chunks(self) -> DataFrame:
        docs = self.store.documents().select("document_id", "title", "uri", "source_id", "metadata", "attributes")
        return self.store.chunks().join(docs, "document_id")

    def _allowed(self, rows: DataFrame, spec: dict | str | None) -> DataFrame | None:
        """The chunks that a filter and the tenant leave; None for all. Fields are the chunks' columns, else typed metadata."""
        spec = filters.parse_filter(spec)
        if self.tenant_id is not None:
            rows = rows.where(F.col("metadata")["tenant_id"] == self.tenant_id)
        if not spec:
            return None if self.tenant_id is None else rows
        rows = rows.withColumn("_meta", F.try_parse_json(F.coalesce("attributes", F.to_json("metadata"))))
        columns, dynamic = filters.typed(rows), filters.variant("_meta")
        own = set(rows.columns) - {"metadata", "attributes", "_meta"}
        return rows.where(filters.compile_filter(spec, lambda path: columns(path) if path.split(".")[0] in own else dynamic(path))).drop("_meta")

    def queries(self, questions: DataFrame) -> DataFrame:
        if questions.where("text IS NULL OR trim(text) = ''").head(1):
            raise InvalidInputError("a query is empty")
        return questions.withColumn("vector", embed(F.col("text"), self.embedder, queries=True))

    def search(self, questions: DataFrame, k: int = 8, mode: str | None = None, spec: dict | None = None) -> DataFrame:
        rows = self._all_chunks()
        return search(rows, self.queries(questions), k, self.config, mode, None, self.embedder.dimension, self.index(), self._allowed(rows, spec), self.searcher)

    def explain(self, questions: DataFrame, k: int = 8, mode: str | None = None, spec: dict | None = None) -> DataFrame:
        """The hits with each signal's rank, score and part."""
        rows = self._all_chunks()
        return explained(rows, self.queries(questions), k, self.config, mode=mode, dim=self.embedder.dimension, index=self.index(), allowed=self._allowed(rows, spec))

    def retrieve_many(self, questions: DataFrame, k: int = 8, token_budget: int | None = None, spec: dict | None = None, mode: str | None = None, rerank: Callable | None = None) -> DataFrame:
        """(qid, context, ...) for (qid, text)."""
        hits = self.search(questions, max(self.config.candidates, k), mode, spec).where(F.col("rank") <= 3 * k)
        rows = hits.join(self.chunks(), "chunk_id")
        if rerank is not None:
            rows = multiquery.reranked(rows.select(*_HIT), rerank, k)
        before, after = self.config.neighbors
        budget = context.Budget(token_budget or self.config.token_budget, k, self.config.max_chunks_per_document, self.config.diversity)
        return context.assemble_contexts(rows, budget, self.chunks(), before, after)

    def retrieve(self, question: str, **options: object) -> dict:
        out = self.retrieve_many(self.spark.createDataFrame([(0, question)], "qid long, text string"), **options).first()
        return out.asDict(recursive=True) if out else {"context": "", "chunks": [], "citations": [], "token_count": 0, "truncated": False}

    def retrieve_multi(self, questions: DataFrame, k: int = 8, coverage: int = 1, resolve: bool = False, boosts: Sequence[dict] = (), spec: dict | None = None, decompose: Callable[[Column], Column] = split_sentences, subquery_filters: Mapping[int, dict] | None = None, rerank: Callable | None = None) -> DataFrame:
        """(qid, context, ...) for (qid, question): subqueries by ``decompose`` (given ones in an array column ``subqueries`` win), each
        under ``spec`` and its own filter by number; fused, versions resolved, boosted, reranked, assembled.

        Versions are resolved among all candidates, and those left are ranked anew, so what takes a dropped document's place
        has been resolved too: a second pass would drop nothing.
        """
        given = "subqueries" in questions.columns
        parts = (lambda q: F.coalesce(F.col("subqueries"), decompose(q))) if given else decompose
        asked = written(multiquery.subqueries(questions, parts), "subqueries")
        own = dict(subquery_filters or {})
        some = lambda where, f: self.search(asked.where(where).select(F.col("sub_id").alias("qid"), "text"), self.config.candidates, None, f)
        hits = some(~F.col("sub_idx").isin(list(own)) if own else F.lit(True), spec)
        for number, extra in own.items():
            hits = hits.unionByName(some(F.col("sub_idx") == number, filters.both(filters.parse_filter(spec), filters.parse_filter(extra))))
        rows = multiquery.fused(written(hits.withColumnRenamed("qid", "sub_id").join(asked.drop("text"), "sub_id"), "fused"), coverage).join(self.chunks(), "chunk_id")
        if resolve:
            names = ("doc_group", "status", "effective_date", "version", "valid_from")
            docs = rows.select("qid", "document_id", *[F.col("metadata")[n].alias(n) for n in names]).distinct()
            rows = rows.join(versions.precedence(docs, by=("qid",)).where("keep").select("qid", "document_id"), ["qid", "document_id"], "left_semi")
            rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy("rank")))
        if boosts:
            rows = multiquery.boosted(rows.withColumns({n: F.col("metadata")[n] for b in boosts for n in _paths(b.get("filter")) if n not in rows.columns}), boosts)
        if rerank is not None:
            rows = multiquery.reranked(rows.select(*_HIT), rerank, k)
        budget = context.Budget(self.config.token_budget, k, self.config.max_chunks_per_document, self.config.diversity)
        return context.assemble_contexts(rows.where(F.col("rank") <= 3 * k), budget)

    def ask(self, question: str, llm: Callable[[str], str], judge: verification.Judge | None = None, mode: str = "report", **options: object) -> dict:
        """An answer with citations from the caller's model; checked if a judge is given."""
        return self._answered(question, self.retrieve(question, **options), llm, judge, mode)

    def ask_multi(self, question: str, llm: Callable[[str], str], judge: verification.Judge | None = None, mode: str = "report", **options: object) -> dict:
        """As ``ask``, over ``retrieve_multi``."""
        row = self.retrieve_multi(self.spark.createDataFrame([(0, question)], "qid long, question string"), **options).first()  # type: ignore[arg-type]
        return self._answered(question, row.asDict(recursive=True) if row else {"context": ""}, llm, judge, mode)

    def _answered(self, question: str, got: dict, llm: Callable[[str], str], judge: verification.Judge | None, mode: str) -> dict:
        from ..functions.text import sanitize_citations

        if not got["context"]:
            raise NotFoundError("nothing was found to answer from")
        answer = llm(f"Answer from the numbered sources alone and cite them as [n].\n\n{got['context']}\n\nQuestion: {question}")
        row = self.spark.createDataFrame([(0, answer, [c["text"] for c in got["citations"]], question)], "answer_id long, answer string, evidence array<string>, question string")
        row = row.withColumn("answer", sanitize_citations(F.col("answer"), F.size("evidence")))
        out = got | {"answer": row.first()["answer"]}
        if judge is not None:
            claims = verification.verify(row, judge)
            report = verification.apply_mode(claims, mode).first()
            out |= {"claims": [r.asDict() for r in claims.orderBy("claim_no").collect()], "answer": report["text"] if report else out["answer"], "ok": bool(report and report["ok"])}
        return out


def _typed_metadata(rows: DataFrame) -> DataFrame:
    """``metadata`` as a map of strings, and ``attributes``, the same as a JSON object with its types."""
    if "metadata" not in rows.columns:
        return rows
    kind = rows.schema["metadata"].dataType
    if isinstance(kind, StringType):
        return rows.withColumn("attributes", F.col("metadata")).withColumn("metadata", F.coalesce(F.from_json("metadata", "map<string,string>"), F.from_json(F.lit("{}"), "map<string,string>")))
    if isinstance(kind, (StructType, MapType)):
        rows = rows.withColumn("attributes", F.to_json("metadata"))
        return rows.withColumn("metadata", F.from_json("attributes", "map<string,string>")) if isinstance(kind, StructType) or not isinstance(kind.valueType, StringType) else rows
    raise InvalidInputError("metadata is a struct, a map or a JSON object")


def _paths(spec: object) -> list[str]:
    """Field paths of a filter."""
    if isinstance(spec, list):
        return [p for s in spec for p in _paths(s)]
    if not isinstance(spec, dict):
        return []
    out: list[str] = []
    for key, x in spec.items():
        out += _paths(x) if key.lstrip("$") in ("and", "or", "not") else [key]
    return list(dict.fromkeys(out))
