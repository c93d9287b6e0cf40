"""Language identification with bit-sliced Bloom filters of byte n-grams.

``identify(docs)`` returns one row per document:

    doc_id BIGINT, language STRING (null if undetermined), score DOUBLE, margin DOUBLE, grams BIGINT,
    scores MAP<STRING, DOUBLE>, keep BOOLEAN (a language was determined)

The filters of all languages share hash functions and are stored by position: ``table[h]`` is a 64-bit mask
of the languages whose filter has bit h set, so the AND of ``HASHES`` look-ups returns every language that
holds an n-gram. A document's hits per language are popcounts of these masks by bit. A language with
false-positive rate f among n n-grams expects n f wrong hits, so its score is (hits / n - f) / (1 - f).
The best language decides if its score reaches ``MIN_SCORE`` and leads by ``MIN_MARGIN``.

Text is folded first: ASCII letters to lower case, each run of other ASCII to one blank; n-grams of blanks
only don't occur. Filters are trained on at most ``SAMPLE`` labelled rows per language (column ``lang``; the
rows with the smallest hash of doc_id), from n-grams seen in ``SHARE`` of them and in 2 rows at least.

Defined cases: a text that is null, empty or shorter than an n-gram after folding is undetermined (score 0)
and rejected; rows without a ``lang`` aren't trained on; without any labels every document is undetermined;
ties between languages have margin 0 and are undetermined; at most 64 languages (ValueError beyond);
repeated rows give repeated results; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import textops as T

GRAM = 5
BITS = 20
HASHES = 3
SAMPLE = 300
SHARE = 0.01
MIN_SCORE = 0.2
MIN_MARGIN = 0.05

_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of each folded row, and the rows' bounds."""
    data = _FOLD[data]
    keep = np.ones(len(data), bool)
    if len(data):
        keep[1:] = (data[1:] != 32) | (data[:-1] != 32)
        first = offsets[:-1][np.diff(offsets) > 0]
        keep[first] = True
    at = np.concatenate([[0], np.cumsum(keep)])[offsets]
    data = data[keep]
    n = np.maximum(np.diff(at) - GRAM + 1, 0)
    if len(data) < GRAM:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    code = np.zeros(len(data) - GRAM + 1, np.uint64)
    for j in range(GRAM):
        code <<= np.uint64(8)
        code |= data[j : j + len(code)]
    if (n == np.maximum(np.diff(at), 0)).all():
        picked = code
    else:
        picked = code[T.ragged(at[:-1], n)]
    return T.mix(picked), np.concatenate([[0], np.cumsum(n)])


def positions(h: np.ndarray, i: int, bits: int = BITS) -> np.ndarray:
    """Position of the i-th hash function: double hashing of the two halves."""
    with np.errstate(over="ignore"):
        step = (h >> np.uint64(32)) | np.uint64(1)
        return ((h + np.uint64(i) * step) & np.uint64((1 << bits) - 1)).astype(np.int64)


class Filters:
    """``table``: bit l of entry h says whether language l's filter has h; ``rates``: false-positive rates."""

    def __init__(self, by_language: dict[str, np.ndarray], bits: int = BITS):
        if len(by_language) > 64:
            raise ValueError(f"{len(by_language)} languages; a mask holds 64")
        self.languages = sorted(by_language)
        self.bits = bits
        kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if np.iinfo(t).bits >= len(by_language))
        self.table = np.zeros(1 << bits, kind)
        fill = []
        for bit, name in enumerate(self.languages):
            own = np.zeros(1 << bits, bool)
            for i in range(HASHES):
                own[positions(by_language[name], i, bits)] = True
            self.table |= own.astype(kind) << kind(bit)
            fill.append(own.mean())
        self.rates = np.array(fill) ** HASHES

    def masks(self, h: np.ndarray) -> np.ndarray:
        out = self.table[positions(h, 0, self.bits)]
        for i in range(1, HASHES):
            out &= self.table[positions(h, i, self.bits)]
        return out

    def scores(self, h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """(rows, languages)."""
        n = np.diff(bounds)
        masks = self.masks(h)
        out = np.zeros((len(n), len(self.languages)))
        for bit in range(len(self.languages)):
            hits = np.concatenate([[0], np.cumsum(masks >> masks.dtype.type(bit) & masks.dtype.type(1), dtype=np.int64)])
            share = (hits[bounds[1:]] - hits[bounds[:-1]]) / np.maximum(n, 1)
            out[:, bit] = np.where(n > 0, np.maximum(0, (share - self.rates[bit]) / (1 - self.rates[bit])), 0)
        return out

    def decide(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language's number (-1: undetermined), its score and its lead."""
        if not scores.shape[1]:
            z = np.zeros(len(scores))
            return np.full(len(scores), -1), z, z
        best = scores.argmax(1)
        top = scores[np.arange(len(scores)), best]
        if scores.shape[1] > 1:
            second = np.partition(scores, -2, axis=1)[:, -2]
        else:
            second = np.zeros(len(scores))
        return np.where((top >= MIN_SCORE) & (top - second >= MIN_MARGIN), best, -1), top, top - second


def _collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) of the sample -> (lang, the row's distinct n-grams)."""
    for batch in batches:
        for lo, hi, data, offsets in T.text_slices(batch.column(1)):
            h, bounds = grams(data, offsets)
            own = [np.unique(h[bounds[i] : bounds[i + 1]]).view(np.int64) for i in range(hi - lo)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(own, pa.list_(pa.int64()))], ["lang", "grams"])


def train(docs: DataFrame, sample: int = SAMPLE) -> Filters:
    labelled = docs.select(F.col("lang").cast("string").alias("lang"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL")
    # the sample is chosen by ids alone; a second, filtered scan fetches its texts
    chosen = labelled.select("lang", "doc_id").withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))).where(F.col("r") <= sample)
    rows = labelled.join(F.broadcast(chosen.select("lang", "doc_id")), ["lang", "doc_id"]).select("lang", "text")
    seen = rows.mapInArrow(_collect, "lang string, grams array<long>")
    size = seen.groupBy("lang").agg(F.count("*").alias("rows"))
    often = seen.select("lang", F.explode("grams").alias("g")).groupBy("lang", "g").count().join(F.broadcast(size), "lang")
    often = often.where(F.col("count") >= F.greatest(F.lit(2), F.col("rows") * SHARE)).groupBy("lang").agg(F.collect_list("g").alias("g"))
    return Filters({r["lang"]: np.array(r["g"], np.int64).view(np.uint64) for r in often.toLocalIterator()})


def identify(docs: DataFrame, filters: Filters | None = None) -> DataFrame:
    filters = filters or train(docs)
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for lo, hi, data, offsets in T.text_slices(batch.column(1)):
                h, bounds = grams(data, offsets)
                scores = own.scores(h, bounds)
                best, top, lead = own.decide(scores)
                names = pa.array([own.languages[b] if b >= 0 else None for b in best], pa.string())
                n, k = scores.shape
                pairs = pa.MapArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k, pa.int32()), pa.array(own.languages * n, pa.string()), pa.array(scores.reshape(-1), pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), names, pa.array(top), pa.array(lead), pa.array(np.diff(bounds)), pairs, pa.array(best >= 0)], ["doc_id", "language", "score", "margin", "grams", "scores", "keep"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(label, "doc_id long, language string, score double, margin double, grams long, scores map<string,double>, keep boolean")


def in_a_language(docs: DataFrame, filters: Filters | None = None) -> DataFrame:
    """The documents whose language is determined, columns unchanged: no join, one pass."""
    filters = filters or train(docs)
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            flags = [own.decide(own.scores(*grams(data, offsets)))[0] >= 0 for _, _, data, offsets in T.text_slices(pc.cast(batch.column(at), pa.string()))]
            if flags:
                yield batch.filter(pa.array(np.concatenate(flags)))

    return docs.mapInArrow(keep, docs.schema)
