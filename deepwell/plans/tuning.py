"""Evaluation of a knowledge base on a dataset of questions, comparison of settings, tuning, and reports."""

from __future__ import annotations

import dataclasses
import html
import itertools
import json
import time
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import EvaluationError
from ..operators import evaluation
from ..sources.scratch import written
from .config import Config
from .knowledge_base import KnowledgeBase

DATASET = "qid long, question string, relevant_ids array<string>"


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """(qid, question, relevant_ids) from JSON lines with ``question`` and ``relevant_ids``; numbered in order of the question's text where ``qid`` is absent."""
    rows = spark.read.schema(DATASET + ", _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    rows = written(rows, "dataset")
    if rows.where("_bad IS NOT NULL OR question IS NULL OR trim(question) = '' OR relevant_ids IS NULL").head(1):
        raise EvaluationError("each line needs a question and relevant_ids")
    return rows.select(F.coalesce("qid", F.xxhash64("question")).alias("qid"), "question", "relevant_ids")


@dataclass(frozen=True)
class Report:
    name: str
    metrics: dict[str, float]
    config: Config

    def to_json(self) -> str:
        return json.dumps({"name": self.name, "metrics": self.metrics, "config": dataclasses.asdict(self.config)}, sort_keys=True)


def evaluate(kb: KnowledgeBase, dataset: DataFrame, k: int = 8, name: str = "current", mode: str | None = None) -> Report:
    """Means of the retrieval metrics over the questions, full recall, and milliseconds per question of the batch."""
    asked = dataset.select("qid", F.col("question").alias("text"))
    n = asked.count()
    if not n:
        raise EvaluationError("the dataset has no questions")
    began = time.perf_counter()
    hits = written(kb.search(asked, k, mode).join(kb.chunks().select("chunk_id", "document_id"), "chunk_id"), "hits")
    took = 1000 * (time.perf_counter() - began) / n
    row = evaluation.summary(evaluation.per_query(hits, dataset, k)).first()
    if row["queries"] == 0:
        raise EvaluationError("no question has relevant ids")
    full = evaluation.full_recall(hits, dataset.select("qid", "relevant_ids")).first()["full_recall"]
    return Report(name, {m: float(row[m]) for m in evaluation.METRICS} | {"queries": row["queries"], "full_recall": float(full), "ms_per_query": took}, kb.config)


def _with(kb: KnowledgeBase, config: Config) -> KnowledgeBase:
    return KnowledgeBase(kb.spark, kb.path, config, kb.embedder, kb.tenant_id)


def compare(kb: KnowledgeBase, dataset: DataFrame, settings: Mapping[str, Mapping[str, object]], k: int = 8) -> list[Report]:
    """One report for each named set of changes to the base's settings."""
    return [evaluate(_with(kb, dataclasses.replace(kb.config, **changes)), dataset, k, name) for name, changes in settings.items()]  # type: ignore[arg-type]


def tune(kb: KnowledgeBase, dataset: DataFrame, grid: Mapping[str, Sequence[object]], k: int = 8, objective: str = "ndcg", max_ms: float | None = None) -> tuple[Report, list[Report]]:
    """The best of all combinations of a grid: by the objective, then the time; and all of them."""
    if objective not in (*evaluation.METRICS, "full_recall"):
        raise EvaluationError(f"objective {objective!r} isn't a metric")
    names = list(grid)
    settings = {", ".join(f"{n}={v!r}" for n, v in zip(names, values, strict=True)): dict(zip(names, values, strict=True)) for values in itertools.product(*grid.values())}
    reports = compare(kb, dataset, settings, k)
    ok = [r for r in reports if max_ms is None or r.metrics["ms_per_query"] <= max_ms]
    if not ok:
        raise EvaluationError(f"no combination stays within {max_ms} ms a question")
    return min(ok, key=lambda r: (-r.metrics[objective], r.metrics["ms_per_query"], r.name)), reports


def apply(kb: KnowledgeBase, best: Report) -> KnowledgeBase:
    """A base that goes on with the report's settings, which the store keeps as its own."""
    kb.store.note(config=json.loads(best.config.to_json()))
    return _with(kb, best.config)


def applied(kb: KnowledgeBase) -> Config | None:
    """The settings that were applied to the store last."""
    have = (kb.store.state() or {}).get("config")
    return Config(**(have | {"neighbors": tuple(have["neighbors"])})) if have else None


def to_markdown(reports: Sequence[Report]) -> str:
    names = list(dict.fromkeys(m for r in reports for m in r.metrics))
    lines = ["| | " + " | ".join(names) + " |", "|-|" + "-|" * len(names)]
    return "\n".join(lines + [f"| {r.name} | " + " | ".join(f"{r.metrics.get(m, float('nan')):.4g}" for m in names) + " |" for r in reports])


def to_html(reports: Sequence[Report]) -> str:
    names = list(dict.fromkeys(m for r in reports for m in r.metrics))
    row = lambda cells, tag: "<tr>" + "".join(f"<{tag}>{html.escape(c)}</{tag}>" for c in cells) + "</tr>"
    return "<table>" + row(["", *names], "th") + "".join(row([r.name, *(f"{r.metrics.get(m, float('nan')):.4g}" for m in names)], "td") for r in reports) + "</table>"
