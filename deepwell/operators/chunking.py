"""Chunks of documents with provenance. Packing is sequential within a text, so it runs in Python over Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..errors import ConfigurationError
from ..functions.text import CASELESS_ENDS

_UNSPACED = re.compile("[぀-ヿ㐀-䶿一-鿿豈-﫿가-힯฀-໿က-႟ក-៿]")
_GAP = re.compile(r"\n\s*\n")
_SENTENCE = re.compile(rf"(?<=[.!?…])\s+|(?<=[{CASELESS_ENDS}])\s*|(?<=[؟۔])\s+")
_HEADING = re.compile(r"(#{1,6})\s+(.*)")
STRATEGIES = ("auto", "markdown", "recursive", "paragraph", "sentence", "fixed")
ROWS = 64
SCHEMA = "chunk_index int, text string, char_start int, char_end int, token_count int, section_path array<string>"


def estimate(text: str) -> int:
    """The Python twin of ``functions.text.estimate_tokens``."""
    if not text:
        return 0
    rest = _UNSPACED.sub("", text)
    apart = len(text) - len(rest)
    blend = 0.6 * len(rest.split()) + 0.4 * (len(rest) / 4)
    return max(1, int(apart * 0.7 + blend if apart else blend))


@dataclass(frozen=True)
class Chunking:
    strategy: str = "auto"
    target_tokens: int = 400
    max_tokens: int = 700
    overlap_tokens: int = 40
    tokenizer: Callable[[str], int] | None = None

    def __post_init__(self) -> None:
        if self.strategy not in STRATEGIES:
            raise ConfigurationError(f"strategy {self.strategy!r}; expected one of {', '.join(STRATEGIES)}")

    def count(self, text: str) -> int:
        return (self.tokenizer or estimate)(text)


@dataclass
class Piece:
    text: str
    start: int
    end: int
    tokens: int
    section: list[str]


def blocks(text: str) -> Iterator[tuple[int, str]]:
    """Paragraphs and where they begin; blank lines part them."""
    at = 0
    for gap in [*_GAP.finditer(text), None]:
        block = text[at : gap.start() if gap else len(text)]
        if block.strip():
            yield at, block
        if gap:
            at = gap.end()


def _oversized(start: int, block: str, section: list[str], cfg: Chunking) -> Iterator[Piece]:
    """A paragraph beyond the maximum: by sentences, one of which overlaps; sentences beyond it by characters.

    The head of a cut sentence precedes the sentences that wait before it, and every piece counts from the
    paragraph's start: both are part of the format.
    """
    waiting: list[str] = []
    size = 0

    def piece(text: str, tokens: int) -> Piece:
        return Piece(text, start, start + len(text), tokens, section)

    for sentence in [s for s in _SENTENCE.split(block) if s.strip()] or [block]:
        n = cfg.count(sentence)
        if waiting and size + n > cfg.target_tokens:
            yield piece(" ".join(waiting), size)
            waiting = waiting[-1:] if cfg.overlap_tokens > 0 and waiting[-1] else []
            size = cfg.count(waiting[0]) if waiting else 0
        while n > cfg.max_tokens:
            cut = max(1, len(sentence) * cfg.max_tokens // n)
            yield piece(sentence[:cut], cfg.count(sentence[:cut]))
            sentence = sentence[cut:]
            n = cfg.count(sentence)
        if sentence.strip():
            waiting.append(sentence)
            size += n
    if waiting:
        yield piece(" ".join(waiting), size)


def _packed(units: list[tuple[int, str, list[str]]], cfg: Chunking) -> Iterator[Piece]:
    held: list[tuple[int, str]] = []
    size, section = 0, []

    def out() -> Iterator[Piece]:
        nonlocal held, size
        text = "\n\n".join(t for _, t in held).strip()
        if text:
            yield Piece(text, held[0][0], held[-1][0] + len(held[-1][1]), cfg.count(text), section)
        held, size = [], 0

    for start, block, path in units:
        if path != section:
            yield from out()
        section = path
        n = cfg.count(block)
        if n > cfg.max_tokens:
            yield from out()
            yield from _oversized(start, block, path, cfg)
            continue
        if held and size + n > cfg.target_tokens:
            yield from out()
        held.append((start, block))
        size += n
    yield from out()


def chunk_text(text: str | None, cfg: Chunking = Chunking(), fmt: str | None = "text") -> list[Piece]:
    """A null or blank text has no chunks."""
    if not text or not text.strip():
        return []
    by_format = "markdown" if fmt in {"md", "markdown"} else "recursive"
    strategy = by_format if cfg.strategy == "auto" else cfg.strategy
    if strategy == "fixed":
        cfg = Chunking("fixed", cfg.target_tokens, cfg.target_tokens, cfg.overlap_tokens, cfg.tokenizer)
    units = []
    path: list[tuple[int, str]] = []
    for start, block in blocks(text):
        if strategy == "markdown" and (m := _HEADING.fullmatch(block.strip().splitlines()[0])):
            path = [p for p in path if p[0] < len(m[1])] + [(len(m[1]), m[2].strip())]
        units.append((start, block, [title for _, title in path]))
    return list(_packed(units, cfg))


def chunk_documents(docs: DataFrame, cfg: Chunking = Chunking(), key: str = "document_id", text: str = "text", fmt: str | None = None) -> DataFrame:
    """(key, chunk_id STRING ``key#index``, chunk_index, text, char_start, char_end, token_count, section_path, previous and next chunk id)."""
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(key, F.col(text).cast("string").alias("_text"), (F.col(fmt) if fmt else F.lit("text")).alias("_format"))

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):  # pieces are several times their text
            at, pieces = [], []
            for i, (t, f) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                for n, p in enumerate(chunk_text(t, cfg, f)):
                    at.append(i)
                    pieces.append((n, p))
            columns = [[n for n, _ in pieces], [p.text for _, p in pieces], [p.start for _, p in pieces], [p.end for _, p in pieces], [p.tokens for _, p in pieces], [p.section for _, p in pieces]]
            kinds = [pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [key, "chunk_index", "text", "char_start", "char_end", "token_count", "section_path"])

    out = rows.mapInArrow(chunks, f"`{key}` {kind}, {SCHEMA}")
    return linked(out.withColumn("chunk_id", F.concat(F.col(key).cast("string"), F.lit("#"), F.col("chunk_index"))), key)


def linked(chunks: DataFrame, key: str = "document_id") -> DataFrame:
    """With the ids of the chunks before and after, within a document."""
    order = W.partitionBy(key).orderBy("chunk_index")
    return chunks.withColumn("previous_chunk_id", F.lag("chunk_id").over(order)).withColumn("next_chunk_id", F.lead("chunk_id").over(order))
