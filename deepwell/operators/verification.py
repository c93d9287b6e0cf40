"""Checking answers against their evidence: claims, verdicts, grounds, repaired texts."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import VerificationError
from .context import terms

SUPPORTED, CONTRADICTED, UNSUPPORTED, UNCITED, QUESTION_FACT, INFERENCE = "supported", "contradicted", "unsupported", "uncited", "question_fact", "inference"
GROUNDS = {SUPPORTED: ("sources",), QUESTION_FACT: ("question",), INFERENCE: ("sources", "question"), CONTRADICTED: ("sources", "question"), UNSUPPORTED: (), UNCITED: ()}
MODES = ("report", "annotate", "repair", "strict")
KEPT_CHARS = 4 << 20
NOTHING_LEFT = "The available sources do not support an answer."

_SHORT = frozenset("mr mrs ms dr prof sr sra st vs etc e.g i.e fig no vol art inc ltd cf al approx".split())
_END = re.compile(r"(?P<stop>[.!?…]+[\"'”’)\]]*)(?P<marks>(?:\s*\[\d+\])*)(?P<gap>\s+)|(?P<tight>[。．！？｡।॥։።។၊။؟۔])(?P<marks2>(?:\s*\[\d+\])*)(?P<gap2>\s*)|(?P<blank>\n\s*\n)")
_MARK = re.compile(r"\[(\d+)\]")

#: (question, claim, evidence texts) -> {"verdict", "rationale"?, "quote"?, "replacement"?}
Judge = Callable[[str, str, Sequence[str]], dict]


def split_claims(text: str) -> tuple[list[str], list[str]]:
    """Claims and what stands between them: claim, gap, claim, ... is the stripped text. Markers after a full stop belong to the claim before."""
    text = text.strip()
    claims, gaps, at = [], [], 0
    for m in _END.finditer(text):
        if m["stop"] is not None:
            word = re.search(r"[\w.]*$", text[at : m.start()])[0].lower().strip(".")
            if m["stop"] == "." and (word in _SHORT or len(word) == 1 and word.isalpha() and text[m.start() - 1].isupper()):
                continue
            end = m.end("marks")
        else:
            end = m.end("marks2") if m["tight"] is not None else m.start()
        if end >= len(text):
            break
        if text[at:end].strip():
            claims.append(text[at:end])
            gaps.append(text[end : m.end()])
            at = m.end()
    if text[at:].strip():
        claims.append(text[at:])
    elif gaps:
        gaps.pop()
    return claims, gaps


def located(spans: Sequence[str], text: str) -> tuple[list[str], list[str], int]:
    """Spans found verbatim, in order and without overlap; gaps between them; how many characters none covers."""
    out, gaps, at, missing = [], [], 0, 0
    for span in spans:
        place = text.find(span, at)
        if place < 0:
            continue
        gap = text[at:place]
        if out:
            gaps.append(gap)
        missing += len(gap.strip())
        out.append(span)
        at = place + len(span)
    return out, gaps, missing + len(text[at:].strip())


def normal(span: str | None) -> str:
    return " ".join((span or "").split()).casefold()


def find_quote(quote: str, texts: Sequence[str]) -> int:
    """The fewest occurrences in any text that has the quote; 0 if none has."""
    needle = normal(quote)
    return min((n for n in (normal(t).count(needle) for t in texts) if n), default=0) if needle else 0


def check_ground(claim: str, said: dict, evidence: Sequence[str], question: str, require_evidence: bool = True, require_quotes: bool = False, most: int = 8, coverage: float = 0.0) -> tuple[str, str | None]:
    """The verdict that stands, and the structural issue if the judge's own doesn't."""
    verdict, quote = said["verdict"], said.get("quote")
    grounds = GROUNDS.get(verdict, ())
    if not grounds:
        return verdict, None
    if quote is not None:
        n = find_quote(quote, evidence) if "sources" in grounds else 0
        if not n and "question" in grounds:
            n = find_quote(quote, [question])
        if not n:
            return UNSUPPORTED, "quote not in the " + " or ".join(grounds)
        if most and n > most:
            return UNSUPPORTED, f"quote occurs {n} times"
        if coverage and len(normal(quote)) < coverage * max(1, len(normal(_MARK.sub("", claim)))):
            return UNSUPPORTED, "quote covers too little of the claim"
        return verdict, None
    if require_quotes:
        return UNSUPPORTED, "no quote"
    if not require_evidence or "sources" in grounds and evidence:
        return verdict, None
    return (UNCITED, "supported without a citation") if verdict == SUPPORTED else (UNSUPPORTED, "no ground named")


def overlap_judge(least: float = 0.6) -> Judge:
    """A lexical judge: supported if so large a share of the claim's terms stands in one evidence text.

    Evidence is much the same from claim to claim and from turn to turn, so the terms of ``KEPT_CHARS`` of it are kept.
    """
    known: dict[str, set[str]] = {}
    held = 0

    def words(text: str) -> set[str]:
        nonlocal held
        if text not in known:
            if held > KEPT_CHARS:
                known.clear()
                held = 0
            known[text] = set(terms(text))
            held += len(text)
        return known[text]

    def judge(question: str, claim: str, evidence: Sequence[str]) -> dict:
        own = set(terms(_MARK.sub("", claim)))
        best = max((len(own & words(e)) / len(own) for e in evidence), default=0.0) if own else 0.0
        return {"verdict": SUPPORTED if best >= least else UNSUPPORTED, "rationale": f"overlap {best:.2f}"}

    return judge


def _claims(answer: str, segment: Callable[[str], Sequence[str]] | None) -> tuple[list[str], list[str], int]:
    if segment is None:
        return *split_claims(answer), 0
    spans = [str(s).strip() for s in segment(answer)]
    if any(s not in answer for s in spans if s):
        raise VerificationError("the segmenter's claims aren't verbatim")
    return located([s for s in spans if s], answer)


def judged(answer: str, evidence: Sequence[str], judge: Judge, question: str = "", segment: Callable[[str], Sequence[str]] | None = None, **ground: object) -> list[dict]:
    """One row per claim. A claim that cites is held to the cited texts, one that doesn't to all; a judge that fails leaves the claim unsupported."""
    claims, gaps, _ = _claims(answer, segment)
    out = []
    for i, claim in enumerate(claims):
        numbers = list(dict.fromkeys(int(n) for n in _MARK.findall(claim)))
        cited = [evidence[n - 1] for n in numbers if 1 <= n <= len(evidence)]
        texts = cited if numbers else list(evidence)
        try:
            said = judge(question, claim, texts)
            if said.get("verdict") not in GROUNDS:
                raise VerificationError(f"unknown verdict {said.get('verdict')!r}")
            verdict, issue = check_ground(claim, said, texts, question, **ground)  # type: ignore[arg-type]
        except Exception as e:  # fail closed
            said, verdict, issue = {}, UNSUPPORTED, f"judge failed: {type(e).__name__}: {e}"
        replacement = said.get("replacement")
        if replacement is not None:
            try:
                again = judge(question, replacement, texts)
                if check_ground(replacement, again, texts, question, **ground)[0] != SUPPORTED:  # type: ignore[arg-type]
                    replacement = None
            except Exception:
                replacement = None
        out.append({"claim_no": i, "claim": claim, "gap": gaps[i] if i < len(gaps) else "", "citations": [n for n in numbers if 1 <= n <= len(evidence)], "verdict": verdict, "rationale": said.get("rationale"), "quote": said.get("quote"), "issue": issue, "replacement": replacement})
    return out


SCHEMA = "claim_no int, claim string, gap string, citations array<int>, verdict string, rationale string, quote string, issue string, replacement string"


def verify(answers: DataFrame, judge: Judge, segment: Callable[[str], Sequence[str]] | None = None, **ground: object) -> DataFrame:
    """(answer_id, claim columns) of ``answers`` (answer_id, answer, evidence ARRAY<STRING>, question?). Null answers have no claims."""
    kind = answers.schema["answer_id"].dataType.simpleString()
    rows = answers.select("answer_id", "answer", "evidence", F.col("question") if "question" in answers.columns else F.lit("").alias("question"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [p.split(" ")[0] for p in SCHEMA.split(", ")]
        kinds = [pa.int32(), pa.string(), pa.string(), pa.list_(pa.int32()), *[pa.string()] * 5]
        for batch in (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)):
            at, out = [], []
            for i, (_, answer, evidence, question) in enumerate(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                for claim in judged(answer or "", [e for e in evidence or [] if e is not None], judge, question or "", segment, **ground):
                    at.append(i)
                    out.append(claim)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array([r[n] for r in out], k) for n, k in zip(names, kinds, strict=True))], ["answer_id", *names])

    return rows.mapInArrow(run, f"answer_id {kind}, {SCHEMA}")


def apply_mode(claims: DataFrame, mode: str = "report") -> DataFrame:
    """(answer_id, text, verdicts, ok, valid): the answer by its claims in order, with their own gaps.

    report leaves it, annotate marks claims that don't stand, repair replaces or drops them, strict also drops what
    rests on no source. Nothing left becomes a fixed sentence.
    """
    if mode not in MODES:
        raise VerificationError(f"mode {mode!r}; expected one of {', '.join(MODES)}")
    good = F.col("verdict").isin(SUPPORTED, QUESTION_FACT, INFERENCE)
    if mode == "strict":
        good = F.col("verdict") == SUPPORTED
    shown = {"report": F.col("claim"), "annotate": F.when(good, F.col("claim")).otherwise(F.concat("claim", F.lit(" ("), "verdict", F.lit(")")))}.get(mode, F.when(good, F.col("claim")).otherwise(F.col("replacement")))
    part = F.struct("claim_no", shown.alias("shown"), F.col("gap"))
    rows = claims.groupBy("answer_id").agg(F.array_sort(F.collect_list(part)).alias("parts"), F.bool_and(good).alias("ok"), F.bool_and(F.col("issue").isNull()).alias("valid"), F.array_sort(F.collect_list("verdict")).alias("all"))
    kept = F.filter("parts", lambda p: p["shown"].isNotNull())
    text = F.aggregate(kept, F.struct(F.lit("").alias("t"), F.lit("").alias("g")), lambda a, p: F.struct(F.concat(a["t"], a["g"], p["shown"]).alias("t"), p["gap"].alias("g")), lambda a: a["t"])
    return rows.select("answer_id", F.when(F.size(kept) > 0, text).otherwise(F.lit(NOTHING_LEFT)).alias("text"), F.col("all").alias("verdicts"), "ok", "valid")


def verdict_counts(claims: DataFrame) -> DataFrame:
    return claims.groupBy("verdict").agg(F.count("*").alias("claims"))


def facets(expected: DataFrame, reported: DataFrame) -> DataFrame:
    """(answer_id, uncovered, complete): expected facets (answer_id, facet) that no report (answer_id, facet, covered) covers."""
    got = reported.where("covered").select("answer_id", "facet").distinct().withColumn("_ok", F.lit(True))
    rows = expected.join(got, ["answer_id", "facet"], "left")
    return rows.groupBy("answer_id").agg(F.array_sort(F.collect_list(F.when(F.col("_ok").isNull(), F.col("facet")))).alias("uncovered")).withColumn("complete", F.size("uncovered") == 0)


def ground_quotes(quotes: DataFrame, documents: DataFrame, quote_id: str, document_id: str, most: int = 8) -> DataFrame:
    """(quote_id, documents, occurrences, grounded) of (quote_id, quote): where each stands, white space and case aside.

    A document meets only the quotes that share its rarest word in them: one equal join on a word, then the substring test.
    """
    from ..functions.text import collapse, occurrences

    q = quotes.select(quote_id, F.lower(collapse(F.col("quote"))).alias("quote")).where("quote <> ''")
    d = documents.select(document_id, F.lower(collapse(F.col("text"))).alias("text"))
    # whole words inside the quote: its first and last may be parts of longer ones
    inner = F.explode(F.array_distinct(F.slice(F.split("quote", " "), 2, F.greatest(F.size(F.split("quote", " ")) - 2, F.lit(0)))))
    words = q.select(quote_id, inner.alias("word"))
    common = d.select(F.explode(F.array_distinct(F.split("text", " "))).alias("word")).join(F.broadcast(words.select("word").distinct()), "word").groupBy("word").agg(F.count("*").alias("n"))
    rare = words.join(common, "word", "left").groupBy(quote_id).agg(F.min_by("word", F.struct(F.coalesce("n", F.lit(0)), "word")).alias("word"))
    keyed = q.join(rare, quote_id, "left")
    pairs = d.withColumn("word", F.explode(F.array_distinct(F.split("text", " ")))).join(F.broadcast(keyed.where("word IS NOT NULL")), "word").drop("word")
    short = d.join(F.broadcast(keyed.where("word IS NULL").drop("word")), F.col("text").contains(F.col("quote")))
    columns = [quote_id, document_id, "text", "quote"]
    hits = pairs.select(*columns).where(F.col("text").contains(F.col("quote"))).unionByName(short.select(*columns))
    hits = hits.select(quote_id, document_id, occurrences(F.col("text"), F.col("quote")).alias("n"))
    out = quotes.select(quote_id).join(hits, quote_id, "left").groupBy(quote_id).agg(F.count(document_id).alias("documents"), F.coalesce(F.min("n"), F.lit(0)).alias("occurrences"))
    return out.withColumn("grounded", (F.col("documents") > 0) & (F.col("occurrences") <= most))
