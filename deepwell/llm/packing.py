"""Vector best-fit packing of token sequences under several capacities at once.

``pack(docs)`` returns one row per bin:

    bin STRING ("group-number"), doc_ids ARRAY<BIGINT>, starts ARRAY<INT> (first token of the piece in
    its document), lengths ARRAY<INT>, tokens BINARY (the pieces' ids one after the other,
    little-endian), n_tokens BIGINT, n_docs BIGINT, attention BIGINT (sum of squared lengths)

Every bin obeys three capacities: ``max_tokens``, ``max_docs`` pieces, ``max_attention``. Pieces come in
descending length; of the open bins in which a piece fits under every constraint, ``dot`` takes the one
whose normalised residual has the largest weighted dot product with the piece's demands, and ``norm``
the one whose residual after the piece has the smallest weighted norm; ties go to the oldest bin. A
document longer than a bin may hold is cut into the fewest pieces first.

Documents are packed in independent groups of about ``GROUP`` by hash of doc_id and text, each in one task, so best fit is
over a group's bins, not all: a group's last bins are less full (README has the measured fill), and the job has no global
step. A group that reaches twice ``GROUP`` documents or ``GROUP_BYTES`` of tokens (identical rows, long texts) is closed and
goes on as another, so a task holds no more. ``starts`` counts from the start of the row's text; in the pipeline that is a
stretch of a document.

Defined cases: a text that is null or has no tokens is in no bin; a null doc_id is packed like another
(the id stays null); repeated rows are packed each; other columns are ignored; an empty table gives no bins.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T
from .tokens import pack_ids, vocabulary

MAX_TOKENS = 8192
MAX_DOCS = 24
MAX_ATTENTION = MAX_TOKENS * MAX_TOKENS // 2
WEIGHTS = (0.6, 0.1, 0.3)
GROUP = 4096
GROUP_BYTES = 64 << 20
VOCABULARY = "byte_bpe_50k.tiktoken"
SCHEMA = "bin string, doc_ids array<long>, starts array<int>, lengths array<int>, tokens binary, n_tokens long, n_docs long, attention long"


def piece_lengths(n: int, max_tokens: int, max_attention: int) -> list[int]:
    """A document's length as the fewest pieces that each fit in an empty bin; all but the last are full."""
    most = min(max_tokens, math.isqrt(max_attention))
    return [most] * (n // most) + ([n % most] if n % most else [])


def best_fit(lengths: np.ndarray, capacity: tuple[int, int, int], weights: tuple[float, float, float] = WEIGHTS, rule: str = "dot") -> list[list[int]]:
    """Bins, as lists of places in ``lengths`` (which descends; each fits in an empty bin)."""
    full = np.array(capacity, float)
    w = np.array(weights, float)
    bins: list[list[int]] = []
    least = int(lengths[-1]) if len(lengths) else 0
    left = np.zeros((64, 3), np.int64)  # of the open bins, oldest first
    name = np.zeros(64, np.int64)
    n = 0
    for i, size in enumerate(lengths.tolist()):
        need = np.array([size, 1, size * size])
        fits = np.flatnonzero((left[:n] >= need).all(1))
        if len(fits):
            rest = left[fits] / full
            if rule == "dot":
                at = int(fits[np.argmax(rest @ (w * (need / full)))])
            else:
                at = int(fits[np.argmin(((rest - need / full) ** 2) @ w)])
            bins[name[at]].append(i)
            left[at] -= need
            if left[at, 0] < least or left[at, 1] < 1 or left[at, 2] < least * least:  # nothing fits any more
                left[at : n - 1], name[at : n - 1] = left[at + 1 : n].copy(), name[at + 1 : n].copy()
                n -= 1
        else:
            if n == len(left):
                left, name = np.concatenate([left, left]), np.concatenate([name, name])
            left[n], name[n] = np.array(capacity) - need, len(bins)
            bins.append([i])
            n += 1
    return bins


def _tokenise(vocab: str, folder: str | None):
    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(vocab, folder)
        for batch in batches:
            for lo, hi, data, offsets in T.text_slices(batch.column(2)):
                ids, at = v.encode(data, offsets)
                raw = [pack_ids(ids[a:b], v.n) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                some = np.flatnonzero(np.diff(at) > 0)
                yield pa.RecordBatch.from_arrays([c.slice(lo, hi - lo).take(pa.array(some)) for c in (batch.column(0), batch.column(1))] + [pa.array(np.diff(at)[some].astype(np.int32)), pa.array([raw[i] for i in some], pa.binary())], ["grp", "doc_id", "n", "tokens"])

    return tokenise


def _fill(capacity: tuple[int, int, int], weights: tuple[float, float, float], rule: str, width: int):
    def close(group: str, rows: list[tuple]) -> pa.RecordBatch:
        pieces = []
        for r, (doc, n, _) in enumerate(rows):
            start = 0
            for size in piece_lengths(n, capacity[0], capacity[2]):
                pieces.append((-size, doc is None, doc or 0, start, r))
                start += size
        pieces.sort()
        bins = best_fit(np.array([-p[0] for p in pieces]), capacity, weights, rule)
        out: list[list] = [[] for _ in range(8)]
        for b, own in enumerate(bins):
            own = [pieces[i] for i in own]
            sizes = [-p[0] for p in own]
            row = (f"{group}-{b}", [rows[p[4]][0] for p in own], [p[3] for p in own], sizes, b"".join(rows[p[4]][2][p[3] * width : (p[3] - p[0]) * width] for p in own), sum(sizes), len(own), sum(s * s for s in sizes))
            for column, value in zip(out, row, strict=True):
                column.append(value)
        kinds = [pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["bin", "doc_ids", "starts", "lengths", "tokens", "n_tokens", "n_docs", "attention"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, part, rows, held = None, 0, [], 0
        for batch in batches:
            for g, doc, n, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows and (g != group or len(rows) >= 2 * GROUP or held >= GROUP_BYTES):
                    yield close(f"{group}.{part}" if part else f"{group}", rows)
                    rows, held, part = [], 0, part + 1
                if g != group:
                    group, part = g, 0
                rows.append((doc, n, raw))
                held += len(raw)
        if rows:
            yield close(f"{group}.{part}" if part else f"{group}", rows)

    return fill


def pack(docs: DataFrame, max_tokens: int = MAX_TOKENS, max_docs: int = MAX_DOCS, max_attention: int = MAX_ATTENTION, weights: tuple[float, float, float] = WEIGHTS, rule: str = "dot", vocab: str = VOCABULARY, folder: str | None = None) -> DataFrame:
    if rule not in ("dot", "norm"):
        raise ValueError("rule is dot or norm")
    if min(max_tokens, max_docs, max_attention) < 1:
        raise ValueError("capacities are 1 at least")
    groups = max(1, -(-docs.count() // GROUP))  # of a table that was read, from the Parquet footers
    width = 2 if vocabulary(vocab, folder).n <= 1 << 16 else 4
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    grouped = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).alias("grp"), "doc_id", "text")
    rows = grouped.mapInArrow(_tokenise(vocab, folder), "grp long, doc_id long, n int, tokens binary")
    return rows.repartition("grp").sortWithinPartitions("grp", "doc_id", "n", "tokens").mapInArrow(_fill((max_tokens, max_docs, max_attention), weights, rule, width), SCHEMA)
