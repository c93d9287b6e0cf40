"""Tokeniser fertility as a quality rule.

``judge(docs)`` returns one row per document:

    doc_id BIGINT, band STRING (language, or script where there's none), n_tokens ARRAY<BIGINT>,
    chars_per_token, fallback_share, entropy ARRAY<DOUBLE> (one entry per vocabulary), reasons ARRAY<STRING>, keep BOOLEAN

Each public vocabulary tokenises the whole text. ``fallback_share`` is the share of tokens that spell a character in
bytes for want of a piece; ``entropy`` is the Shannon entropy, in bits, of the text's token frequencies. The corpus sets
the rejection bands: of all documents with one language (or script) and one size class (powers of four of the token
count), [q1 - w, q3 + w] with w = ``WIDTH`` times the quartiles' distance, which has a floor per measure. A class of
fewer than ``LEAST`` documents uses its language's band over all sizes, a language of fewer the corpus's. A document is
kept if it lies in all its bands; ``reasons`` names those it leaves, as "measure vocabulary low|high".

Defined cases: a text that is null or has no tokens has null measures, the reason "no tokens", and isn't kept; nor does
it count for the bands. The script of a text without ``lang`` is that of most of its letters ("Latin" down to "other",
"none" if it has no letter; the earlier on a tie). Repeated rows count and are judged each; other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T
from .store import written
from .tokens import vocabulary

VOCABULARIES = ("byte_bpe_50k.tiktoken", "piece_bpe_32k.model")
WIDTH = 4.0
LEAST = 50
FLOORS = {"chars_per_token": 0.1, "fallback_share": 0.02, "entropy": 0.25}

#: By first byte of a character in UTF-8.
SCRIPTS = ("Latin", "Greek", "Cyrillic", "Hebrew", "Arabic", "Indic", "CJK", "Hangul", "other")
_SCRIPT = np.full(256, -1, np.int8)
_SCRIPT[[*range(65, 91), *range(97, 123), *range(0xC3, 0xCA)]] = 0
_SCRIPT[[0xCE, 0xCF]] = 1
_SCRIPT[0xD0:0xD4] = 2
_SCRIPT[0xD7] = 3
_SCRIPT[0xD8:0xDC] = 4
_SCRIPT[0xE0] = 5
_SCRIPT[0xE3:0xEA] = 6
_SCRIPT[0xEA:0xEE] = 7
_SCRIPT[[0xCA, 0xCB, 0xCC, 0xCD, 0xD4, 0xD5, 0xD6, *range(0xDC, 0xE0), 0xE1, 0xF0, 0xF1]] = 8


def scripts(data: np.ndarray, offsets: np.ndarray) -> list[str]:
    counts = np.stack([np.diff(np.concatenate([[0], np.cumsum(_SCRIPT[data] == s)])[offsets]) for s in range(len(SCRIPTS))], 1)
    best = counts.argmax(1)
    return [SCRIPTS[b] if c else "none" for b, c in zip(best, counts.max(1), strict=True)]


def entropies(tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Of each row's token frequencies, in bits; 0 for rows without tokens."""
    n = np.diff(bounds)
    row = np.repeat(np.arange(len(n), dtype=np.int64), n)
    key = np.sort(row << 20 | tokens)
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.concatenate([edge, [len(key)]])).astype(float)
    total = np.zeros(len(n))
    np.add.at(total, key[edge] >> 20, count * np.log2(count))
    return np.where(n > 0, np.log2(np.maximum(n, 1)) - total / np.maximum(n, 1), 0.0)


def _measure(vocabularies: Sequence[str], folder: str | None):
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = [vocabulary(v, folder) for v in vocabularies]
        for batch in batches:
            for lo, hi, data, offsets in T.text_slices(batch.column(2)):
                n = hi - lo
                chars = np.diff(np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets])
                columns: list[list[np.ndarray]] = [[], [], [], []]
                for v in loaded:
                    tokens, at = v.encode(data, offsets)
                    count = np.diff(at)
                    some = np.maximum(count, 1)
                    fallback = np.diff(np.concatenate([[0], np.cumsum(v.fallback[tokens])])[at])
                    for column, value in zip(columns, (count, chars / some, fallback / some, entropies(tokens, at)), strict=True):
                        column.append(value)
                langs = batch.column(1).slice(lo, n).to_pylist()
                if None in langs:
                    langs = [lang if lang is not None else script for lang, script in zip(langs, scripts(data, offsets), strict=True)]
                none = np.stack(columns[0], 1).min(1) == 0
                ends = pa.array(np.arange(n + 1, dtype=np.int32) * len(loaded), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.stack(c, 1).reshape(-1), pa.int64() if i == 0 else pa.float64()), mask=pa.array(none)) for i, c in enumerate(columns)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, n), pa.array(langs, pa.string()), *lists], ["doc_id", "band", "n_tokens", *FLOORS])

    return measure


def judge(docs: DataFrame, vocabularies: Sequence[str] = VOCABULARIES, folder: str | None = None) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    measured = written(rows.mapInArrow(_measure(vocabularies, folder), "doc_id long, band string, n_tokens array<long>, chars_per_token array<double>, fallback_share array<double>, entropy array<double>"), "fertility")
    measured = measured.withColumn("class", F.floor(F.log2(F.col("n_tokens")[0]) / 2).cast("int"))
    each = [(m, i) for m in FLOORS for i in range(len(vocabularies))]
    quartiles = [F.percentile_approx(F.col(m)[i], [0.25, 0.75], 10000).alias(f"{m}_{i}") for m, i in each]
    # (language, size), (language) and (): a few rows, from one aggregation over all documents
    bands = written(measured.where("n_tokens IS NOT NULL").rollup("band", "class").agg(F.count("*").alias("n"), F.grouping_id().alias("level"), *quartiles).where(f"level = 3 OR n >= {LEAST}"), "bands")
    kept = [F.col(f"{m}_{i}") for m, i in each]
    levels = []
    for level, keys in enumerate((["band", "class"], ["band"], [])):
        own = bands.where(F.col("level") == (0, 1, 3)[level]).select(*[F.col(k).alias(f"_{k}") for k in keys], F.struct(*kept).alias(f"b{level}"))
        levels.append((keys, own))
    out = measured
    for keys, own in levels:
        if keys:
            out = out.join(F.broadcast(own), F.expr(" AND ".join(f"{k} = _{k}" for k in keys)), "left").drop(*[f"_{k}" for k in keys])
        else:
            out = out.join(F.broadcast(own), F.lit(True), "left")
    out = out.withColumn("b", F.coalesce("b0", "b1", "b2"))
    reasons = []
    for m, i in each:
        q, v = F.col("b")[f"{m}_{i}"], F.col(m)[i]
        w = WIDTH * F.greatest(q[1] - q[0], F.lit(FLOORS[m]))
        name = f"{m} {vocabularies[i]} "
        reasons.append(F.when(v < q[0] - w, name + "low").when(v > q[1] + w, name + "high"))
    found = F.when(F.col("n_tokens").isNull(), F.array(F.lit("no tokens"))).otherwise(F.array_compact(F.array(*reasons)))
    return out.select("doc_id", "band", "n_tokens", *FLOORS, found.alias("reasons")).withColumn("keep", F.size("reasons") == 0)
