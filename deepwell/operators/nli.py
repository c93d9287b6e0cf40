"""Natural-language inference as a judge, with an injected model, and its threshold's calibration."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidInputError
from .evaluation import balanced_accuracy
from .verification import CONTRADICTED, SUPPORTED, UNSUPPORTED, Judge

LABELS = ("entailment", "neutral", "contradiction")
#: pairs (premise, hypothesis) -> logits, a row for each pair
Model = Callable[[list[tuple[str, str]]], np.ndarray]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def nli_judge(model: Model, labels: Sequence[str] = LABELS, threshold: float | None = None) -> Judge:
    """The best premise decides: entailment beats contradiction. Without a threshold by the largest class, else from the threshold up."""
    at = {name: i for i, name in enumerate(s.lower() for s in labels)}
    if "entailment" not in at or "contradiction" not in at:
        raise InvalidInputError("the model's labels must name entailment and contradiction")

    def judge(question: str, claim: str, evidence: Sequence[str]) -> dict:
        if not evidence:
            return {"verdict": UNSUPPORTED, "rationale": "no premise"}
        p = softmax(np.asarray(model([(e, claim) for e in evidence]), float))
        yes, no = p[:, at["entailment"]], p[:, at["contradiction"]]
        sure = (lambda v: v >= threshold) if threshold is not None else (lambda v: v >= p.max(1))
        if sure(yes).any():
            return {"verdict": SUPPORTED, "rationale": f"entailment {yes.max():.2f}"}
        if sure(no).any():
            return {"verdict": CONTRADICTED, "rationale": f"contradiction {no.max():.2f}"}
        return {"verdict": UNSUPPORTED, "rationale": "neutral"}

    return judge


def calibrate(scored: DataFrame, steps: int = 19) -> DataFrame:
    """(threshold, accuracy) over an even grid between 0 and 1, best first; of ``scored`` (score, label 0/1)."""
    grid = scored.sparkSession.range(1, steps + 1).select((F.col("id") / F.lit(steps + 1.0)).alias("threshold"))
    return balanced_accuracy(scored, grid).orderBy(F.desc("accuracy"), "threshold")
