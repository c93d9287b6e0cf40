"""Contexts within a token budget, one per query, from ranked candidates.

Each step depends on what the steps before chose, so a query's candidates (a few thousand rows at most) are one Arrow
group; queries are independent and run side by side.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window as W

from ..functions.text import estimate_tokens
from ..sources.scratch import small, written
from .chunking import estimate

_U = "぀-ヿ㐀-䶿一-鿿豈-﫿가-힯฀-໿က-႟ក-៿"
_RUN = re.compile(f"[{_U}]+|(?:(?![{_U}])[^\\W_])+")
_UNSPACED, _SPACED_RUN = re.compile(f"[{_U}]"), re.compile(r"[^\W_]+")
_FIELDS = {"chunk_id": "string", "document_id": "string", "document_version": "bigint", "chunk_index": "int", "text": "string", "score": "double", "token_count": "int", "title": "string", "section_path": "array<string>", "page_number": "int", "uri": "string"}
_CHUNK = "struct<chunk_id:string,document_id:string,document_version:bigint,chunk_index:int,text:string,score:double,token_count:int,expanded:boolean,reason:string>"
_CITATION = "struct<index:int,document_id:string,document_version:bigint,chunk_ids:array<string>,title:string,uri:string,section:string,page_number:int,score:double,text:string>"
SCHEMA = f"context string, token_count int, truncated boolean, chunks array<{_CHUNK}>, citations array<{_CITATION}>, duplicates int, blocks int"


def terms(text: str) -> list[str]:
    """The Python twin of ``functions.text.tokenize``."""
    if not _UNSPACED.search(text):
        return [_folded(run) for run in _SPACED_RUN.findall(text)]
    out = []
    for run in _RUN.findall(text):
        if re.match(f"[{_U}]", run):
            out += [run] if len(run) == 1 else [run[i : i + 2] for i in range(len(run) - 1)]
        else:
            out.append(_folded(run))
    return out


def _folded(run: str) -> str:
    """Per character: a final capital sigma becomes another letter within a word."""
    return "".join(c.lower() for c in run) if "Σ" in run else run.lower()


def overlap(a: set[str], b: set[str]) -> float:
    return len(a & b) / min(len(a), len(b)) if a and b else 0.0


@dataclass(frozen=True)
class Budget:
    tokens: int = 4000
    max_chunks: int = 8
    per_document: int = 3
    diversity: float = 0.7  # weight of the score against redundancy


def capped(rows: list[dict], per_document: int) -> tuple[list[dict], int]:
    """Without texts seen before (white space aside) and beyond a document's share; a chunk over its share isn't "seen"."""
    seen: set[str] = set()
    of: dict[str, int] = {}
    out, doubles = [], 0
    for r in rows:
        key = " ".join(r["text"].split())
        if key in seen:
            doubles += 1
        elif of.get(r["document_id"], 0) < per_document:
            seen.add(key)
            of[r["document_id"]] = of.get(r["document_id"], 0) + 1
            out.append(r)
    return out, doubles


def cap_hits(hits: DataFrame, per_document: int) -> DataFrame:
    """(qid, chunk_id, duplicates): ``capped`` over each query's few hits (qid, document_id, chunk_id, text, rank)."""
    kind = hits.schema["qid"].dataType.simpleString()
    schema = f"qid {kind}, chunk_id string, duplicates int"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def one(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["rank"])
        kept, doubles = capped(rows, per_document)
        return pa.Table.from_pylist([{"qid": r["qid"], "chunk_id": r["chunk_id"], "duplicates": doubles} for r in kept], schema=arrow)

    return hits.groupBy("qid").applyInArrow(one, schema)


def diverse(rows: list[dict], weight: float) -> list[dict]:
    """Greedy maximal marginal relevance over all candidates; the first of equals goes first."""
    words = [set(terms(r["text"])) for r in rows]
    redundant = [0.0] * len(rows)
    left, out = list(range(len(rows))), []
    while left:
        best = max(left, key=lambda i: (weight * rows[i]["score"] - (1 - weight) * redundant[i], -i))
        left.remove(best)
        out.append(rows[best])
        for i in left:
            redundant[i] = max(redundant[i], overlap(words[i], words[best]))
    return out


def within_budget(rows: list[dict], budget: Budget) -> tuple[list[dict], int]:
    """Chunks that don't fit are passed over, save that the first is cut to fit; and the tokens that are left."""
    out: list[dict] = []
    left = budget.tokens
    for r in rows:
        if len(out) >= budget.max_chunks or left <= 0 and out:
            break
        n = r["token_count"] or estimate(r["text"])
        if n > left:
            if out:
                continue
            short = r["text"][: max(1, len(r["text"]) * left // n)]
            r = r | {"text": short.rsplit(" ", 1)[0] or short, "reason": "truncated to token budget"}
            n = estimate(r["text"])
        out.append(r | {"token_count": n})
        left -= n
    return out, left


def with_neighbors(rows: list[dict], near: dict[str, list[dict]], left: int) -> list[dict]:
    have = {r["chunk_id"] for r in rows}
    out = list(rows)
    for r in rows:
        for other in near.get(r["chunk_id"], []):
            n = other["token_count"] or estimate(other["text"])
            if other["chunk_id"] not in have and n <= left:
                have.add(other["chunk_id"])
                left -= n
                out.append(other | {"token_count": n, "expanded": True, "reason": "expanded neighbor"})
    return out


def rendered(rows: list[dict]) -> dict[str, Any]:
    """Documents by their best score, chunks in reading order, adjacent ones merged; one citation per document."""
    best: dict[str, float] = {}
    for r in rows:
        best[r["document_id"]] = max(best.get(r["document_id"], float("-inf")), r["score"])
    rows = sorted(rows, key=lambda r: (-best[r["document_id"]], r["document_id"], r["chunk_index"]))
    runs: list[list[dict]] = []
    for r in rows:
        last = runs[-1][-1] if runs else None
        if last and (last["document_id"], last["document_version"], last["chunk_index"] + 1) == (r["document_id"], r["document_version"], r["chunk_index"]):
            runs[-1].append(r)
        else:
            runs.append([r])
    citations: dict[str, dict] = {}
    blocks = []
    for run in runs:
        first = run[0]
        section = " > ".join(first["section_path"] or [])
        c = citations.setdefault(
            first["document_id"],
            {"index": len(citations) + 1, "document_id": first["document_id"], "document_version": first["document_version"], "chunk_ids": [], "title": first["title"], "uri": first["uri"], "section": section or None, "page_number": first["page_number"], "score": first["score"], "text": ""},
        )
        c["chunk_ids"] += [r["chunk_id"] for r in run]
        c["score"] = max(c["score"], *(r["score"] for r in run))
        body = "\n".join(r["text"].strip() for r in run)
        c["text"] = f"{c['text']}\n{body}" if c["text"] else body
        head = f"[{c['index']}]" + (f" {first['title']}" if first["title"] else "") + (f" — {section}" if section else "")
        head += f" (page {first['page_number']})" if first["page_number"] is not None else ""
        head += " [truncated to fit token budget]" if any("truncated" in r["reason"] for r in run) else ""
        blocks.append(f"{head}\n{body}")
    keys = ("chunk_id", "document_id", "document_version", "chunk_index", "text", "score", "token_count", "expanded", "reason")
    return {
        "context": "\n\n".join(blocks),
        "token_count": sum(r["token_count"] for r in rows),
        "truncated": any("truncated" in r["reason"] for r in rows),
        "chunks": [{k: r[k] for k in keys} for r in rows],
        "citations": list(citations.values()),
        "blocks": len(runs),
    }


def assemble(rows: list[dict], budget: Budget, near: dict[str, list[dict]] | None = None) -> dict[str, Any]:
    """``rows``: candidates, best first."""
    rows = [{"expanded": False, "reason": "", **r} for r in rows]
    kept, doubles = capped(rows, budget.per_document)
    chosen, left = within_budget(diverse(kept, budget.diversity), budget)
    if near:
        chosen = with_neighbors(chosen, near, left)
    return rendered(chosen) | {"duplicates": doubles}


def _shape(df: DataFrame, extra: list[str]) -> DataFrame:
    columns = [F.col(c).cast(t).alias(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in _FIELDS.items()]
    if "token_count" not in df.columns:  # of the chunks that were found, not of all
        df, columns = df.withColumn("token_count", estimate_tokens(F.col("text"))), [F.col(c) if c == "token_count" else column for c, column in zip(_FIELDS, columns, strict=True)]
    return df.select("qid", *extra, *columns)


def neighbors(hits: DataFrame, chunks: DataFrame, before: int, after: int) -> DataFrame:
    """(qid, neighbor_of, chunk columns): chunks of the same document and version up to so many places away.

    Places are spelt out, so the join is on equal keys rather than a range. They are written, so few go to the chunks' tasks
    and the texts stay there.
    """
    at = hits.select("qid", F.col("chunk_id").alias("neighbor_of"), "document_id", "document_version", "score", F.explode(F.sequence(F.col("chunk_index") - before, F.col("chunk_index") + after)).alias("place"), F.col("chunk_index").alias("own"))
    at = at.where("place <> own").select("qid", "neighbor_of", "score", "document_id", "document_version", F.col("place").alias("chunk_index"))
    return small(written(at, "places")).join(chunks.drop("score"), ["document_id", "document_version", "chunk_index"])


def assemble_contexts(candidates: DataFrame, budget: Budget = Budget(), chunks: DataFrame | None = None, before: int = 0, after: int = 0) -> DataFrame:
    """(qid, context, token_count, truncated, chunks, citations, duplicates, blocks), one row per query.

    ``candidates``: (qid, rank, chunk_id, document_id, document_version, chunk_index, text, score) and, where known,
    token_count, title, section_path, page_number, uri. ``chunks`` is the table neighbors come from. Candidates
    without text are passed over. They are written, as their neighbors are looked up too.
    """
    candidates = written(_shape(candidates, ["rank"]), "candidates")
    rows = candidates.where("text IS NOT NULL").withColumn("neighbor_of", F.lit(None).cast("string"))
    if chunks is not None and (before or after):
        rows = rows.unionByName(_shape(neighbors(candidates, chunks, before, after).where("text IS NOT NULL").withColumn("rank", F.lit(0)), ["rank", "neighbor_of"]), allowMissingColumns=True)
    kind = candidates.schema["qid"].dataType.simpleString()

    def one(table: pa.Table) -> pa.Table:
        data = table.to_pylist()
        qid = data[0]["qid"]
        near: dict[str, list[dict]] = {}
        for r in sorted((r for r in data if r["neighbor_of"] is not None), key=lambda r: r["chunk_index"]):
            near.setdefault(r["neighbor_of"], []).append(r)
        own = sorted((r for r in data if r["neighbor_of"] is None), key=lambda r: r["rank"])
        got = assemble(own, budget, near)
        return pa.Table.from_pylist([{"qid": qid, **got}], schema=arrow)

    arrow = to_arrow_schema(StructType.fromDDL(f"qid {kind}, {SCHEMA}"))
    return rows.groupBy("qid").applyInArrow(one, f"qid {kind}, {SCHEMA}")


def adjacent_runs(chunks: DataFrame) -> DataFrame:
    """Adjacent runs as gaps and islands: ``run`` numbers stretches of consecutive chunk_index within (document, version)."""
    order = W.partitionBy("document_id", "document_version").orderBy("chunk_index")
    return chunks.withColumn("run", F.col("chunk_index") - F.row_number().over(order))

