"""Toxic documents, by compression distance under two zstandard dictionaries.

``find_toxic(docs, labels)`` returns one row per document called toxic:

    doc_id BIGINT, score DOUBLE, threshold DOUBLE, windows INT, start INT, stop INT (bytes of the window with the
    largest gain), gain INT (its bytes saved), toxic BOOLEAN (true)

Training draws at most ``SAMPLE`` labelled documents of each class (smallest hash of doc_id) and of them, in that order, at
most ``SAMPLE_BYTES`` of text, drops near copies among them, and holds ``HELD_OUT`` of the ordinary ones out. One dictionary is
trained on windows of ordinary text. The other is trained on the stretches of toxic text that ordinary text lacks: words, and
phrases of two words, whose document frequency is ``LIFT`` times the ordinary one, with a log-likelihood ratio of ``SURE``
(``SURE_PHRASE``) at least. That is a departure from dictionaries of whole toxic texts: a toxic document is ordinary words but
for a few, whole texts give a dictionary of ordinary words, and on the same held-out documents that caught 0.75 at most where
this catches 0.98 (see the README). Both compressors start from the ordinary dictionary; the toxic one has the toxic
dictionary after it and the ordinary one as many filler bytes, so lengths differ only by what toxic text explains.

Whole texts are classified, in windows of ``WINDOW`` words, compressed behind ``LEAD`` bytes that both dictionaries
hold (zstandard stores blocks that don't shrink, which would hide small differences). A window's gain is its compressed length under the
ordinary dictionary less that under the toxic one. With p(g) the rate per window of held-out ordinary documents that
have a gain of g or more, c(g) windows out of n have a Chernoff score of c ln(c / np) - c + np; a document's score is the
largest over g, which treats short and long texts alike. The threshold is calibrated on the held-out ordinary
documents: their (1 - ``FALSE``) quantile, and ``FLOOR`` at least.

Defined cases: null and empty texts are not toxic; without stretches to train on nothing is toxic; labels that are null or of no document don't train; without
documents of both labels nothing is toxic; contradicting labels of one document train both classes; repeated rows
are judged each; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard as zs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import superminhash as S
from . import textops as T

SAMPLE = 3000
HELD_OUT = 0.3
WINDOW = 6
LIFT = 12.0
SURE = 14.0
SURE_PHRASE = 40.0
SAMPLE_BYTES = 48 << 20
ORDINARY_BYTES = 65536
TOXIC_BYTES = 8192
LEAD = 128
FALSE = 0.002
FLOOR = 5.0
GAINS = np.arange(2, 17)

_WORD = re.compile(rb"[\w\x80-\xff]+")


def compressor(dictionary: bytes) -> zs.ZstdCompressor:
    p = zs.ZstdCompressionParameters(window_log=18, hash_log=17, chain_log=17, search_log=6, min_match=5, target_length=0, strategy=zs.STRATEGY_DFAST, write_content_size=False, write_checksum=False, write_dict_id=False, format=zs.FORMAT_ZSTD1_MAGICLESS)
    return zs.ZstdCompressor(dict_data=zs.ZstdCompressionDict(dictionary, dict_type=zs.DICT_TYPE_RAWCONTENT), compression_params=p)


def dictionary(samples: list[bytes], size: int) -> bytes:
    """zstandard's trained dictionary; of samples too few to train on, the samples themselves."""
    whole = b"".join(samples)
    if len(whole) > 2 * size or len(samples) >= 64:
        try:
            return zs.train_dictionary(size, samples, level=3).as_bytes()
        except zs.ZstdError:
            pass
    return whole[-size:]


def windows(data: np.ndarray, offsets: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of each row's windows (with the white space around, if one), and the rows' bounds."""
    starts, ends, at = T.words(data, offsets)
    n = np.diff(at)
    count = -(-n // size)
    bounds = np.concatenate([[0], np.cumsum(count)])
    row = np.repeat(np.arange(len(n)), count)
    first = at[:-1][row] + (np.arange(bounds[-1]) - bounds[:-1][row]) * size
    last = np.minimum(first + size, at[1:][row]) - 1
    return np.maximum(starts[first] - 1, offsets[:-1][row]), np.minimum(ends[last] + 1, offsets[1:][row]), bounds


class Classifier:
    def __init__(self, ordinary: bytes, toxic: bytes, rates: np.ndarray, threshold: float):
        self.ordinary, self.toxic, self.rates, self.threshold = ordinary, toxic, rates, threshold
        self._pair: tuple | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_pair": None}

    def gains(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if self._pair is None:
            self._pair = compressor(self.ordinary + b"\0" * len(self.toxic)).compress, compressor(self.ordinary + self.toxic).compress
        a, b = self._pair
        raw, lead = data.tobytes(), self.ordinary[-LEAD:]
        return np.fromiter((len(a(w)) - len(b(w)) for w in (lead + raw[i:j] for i, j in zip(starts.tolist(), ends.tolist(), strict=True))), np.int64, len(starts))

    def scores(self, gains: np.ndarray, bounds: np.ndarray, window: np.ndarray) -> np.ndarray:
        """``window``: hashes of the windows' texts; one that a document repeats counts once in it."""
        gains = np.where(first_of_row(window, bounds), gains, 0)
        n = np.diff(bounds)
        best = np.zeros(len(n))
        for g, p in zip(GAINS, self.rates, strict=True):
            total = np.concatenate([[0], np.cumsum(gains >= g)])
            c, expected = (total[bounds[1:]] - total[bounds[:-1]]).astype(float), np.maximum(n * p, 1e-12)
            best = np.maximum(best, np.where(c > expected, c * np.log(np.maximum(c, 1) / expected) - c + expected, 0))
        return best


def first_of_row(key: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    row = np.repeat(np.arange(len(bounds) - 1, dtype=np.uint64), np.diff(bounds))
    out = np.zeros(len(key), bool)
    out[np.unique(T.mix(key ^ T.mix(row)), return_index=True)[1]] = True
    return out


def _lower(text: str) -> np.ndarray:
    return T.LOWER[np.frombuffer(text.encode(), np.uint8)]


def distinct(texts: list[str]) -> list[str]:
    """The texts less those that share a signature band with one before: near copies count once."""
    seen: set[int] = set()
    out = []
    for lo, hi, data, offsets in T.text_slices(pa.array(texts, pa.string())):
        element, bounds, _ = S.shingles(data, offsets)
        keys = S.bands(S.signatures(element, bounds, 64))
        for i in range(hi - lo):
            own = keys[i].tolist()
            if bounds[i] < bounds[i + 1] and seen.isdisjoint(own):
                seen.update(own)
                out.append(texts[lo + i])
    return out


def lacking(bad: list[np.ndarray], learn: list[np.ndarray]) -> set:
    """Words, and pairs of words that follow each other, of toxic documents that ordinary ones lack; pairs without such a word."""
    out: set = set()
    for n, sure in ((1, SURE), (2, SURE_PHRASE)):

        def terms(row: np.ndarray, n: int = n) -> set:
            words = _WORD.findall(row.tobytes())
            return set(words if n == 1 else zip(words, words[1:]))

        # by 64-bit hashes, since pairs are many; only those of enough toxic documents are counted in the others
        code, often = np.unique(np.concatenate([np.fromiter(map(hash, terms(row)), np.int64) for row in bad]), return_counts=True)
        least = max(3, 0.006 * len(bad))
        code, often = code[often >= least], often[often >= least]
        usual = np.zeros(len(code), np.int64)
        for row in learn:
            own = np.fromiter(map(hash, terms(row)), np.int64)
            usual[np.isin(code, own, assume_unique=True)] += 1
        share = len(bad) / (len(bad) + len(learn))
        apart = (often / len(bad) >= LIFT * (usual + 1) / len(learn)) & (2 * often * np.log(often / (share * (often + usual))) >= sure)
        hot = set(code[apart].tolist())
        new = {w for row in bad for w in terms(row) if hash(w) in hot} if hot else set()
        out |= new if n == 1 else {p for p in new if out.isdisjoint(p)}
    return out


def fit(toxic: list[str], ordinary: list[str]) -> Classifier | None:
    toxic, ordinary = distinct(toxic), distinct(ordinary)
    if not toxic or not ordinary:
        return None
    cut = max(1, round(len(ordinary) * (1 - HELD_OUT)))
    learn, held = [_lower(t) for t in ordinary[:cut]], [_lower(t) for t in ordinary[cut:] or ordinary]
    bad = [_lower(t) for t in toxic]
    hot = lacking(bad, learn)
    stretches = []
    for row in bad:
        raw = b" " + row.tobytes() + b" "
        spans = [m.span() for m in _WORD.finditer(raw)]
        names = [raw[i:j] for i, j in spans]
        stretches += [raw[i - 1 : j + 1] for (i, j), w in zip(spans, names, strict=True) if w in hot]
        stretches += [raw[i - 1 : j + 1] for (i, _), (_, j), *pair in zip(spans, spans[1:], names, names[1:]) if tuple(pair) in hot]
    if not stretches:
        return None
    samples = []
    for row in learn:
        a, b, _ = windows(row, np.array([0, len(row)]), 40)
        samples += [row[i:j].tobytes() for i, j in zip(a, b, strict=True)]
    kinds = sorted(set(stretches))
    model = Classifier(dictionary(samples, ORDINARY_BYTES - TOXIC_BYTES), dictionary(kinds * 4, TOXIC_BYTES), np.zeros(len(GAINS)), 0.0)
    data = np.concatenate(held)
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in held])])
    starts, ends, bounds = windows(data, offsets)
    gains = model.gains(data, starts, ends)
    most = np.array([gains[a:b].max(initial=0) for a, b in zip(bounds[:-1], bounds[1:], strict=True)])
    model.rates = (np.array([(most >= g).sum() for g in GAINS]) + 0.5) / (len(gains) + 1)  # a document counts once
    scores = model.scores(gains, bounds, T.span_hashes(T.prefix_hash(data), starts, ends))
    model.threshold = max(FLOOR, float(np.quantile(scores, 1 - FALSE)))
    return model


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Classifier | None:
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("class")).where("doc_id IS NOT NULL AND class IN (0, 1)").distinct()
    chosen = marks.withColumn("r", F.row_number().over(W.partitionBy("class").orderBy(F.xxhash64("doc_id"), "doc_id"))).where(F.col("r") <= sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    own = texts.join(F.broadcast(chosen), "doc_id").withColumn("size", F.octet_length("text"))
    before = F.sum("size").over(W.partitionBy("class").orderBy("r", F.xxhash64("text")).rowsBetween(W.unboundedPreceding, -1))
    rows = own.withColumn("before", F.coalesce(before, F.lit(0))).where((F.col("before") == 0) | (F.col("before") + F.col("size") <= SAMPLE_BYTES)).select("class", "r", "text").collect()  # bounded in rows and bytes
    rows.sort(key=lambda r: (r["r"], r["text"]))
    return fit([r["text"] for r in rows if r["class"] == 1], [r["text"] for r in rows if r["class"] == 0])


def find_toxic(docs: DataFrame, labels: DataFrame, model: Classifier | None = None) -> DataFrame:
    model = model or train(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for lo, hi, data, offsets in T.text_slices(batch.column(1)):
                if own is None:
                    continue
                data = T.LOWER[data]
                starts, ends, bounds = windows(data, offsets)
                gains = own.gains(data, starts, ends)
                scores = own.scores(gains, bounds, T.span_hashes(T.prefix_hash(data), starts, ends))
                rows = np.flatnonzero(scores > own.threshold)
                if not len(rows):
                    continue
                top = np.array([bounds[i] + gains[bounds[i] : bounds[i + 1]].argmax() for i in rows])
                columns = [pa.array(scores[rows]), pa.array(np.full(len(rows), own.threshold)), pa.array(np.diff(bounds)[rows].astype(np.int32)), pa.array((starts[top] - offsets[rows]).astype(np.int32)), pa.array((ends[top] - offsets[rows]).astype(np.int32)), pa.array(gains[top].astype(np.int32)), pa.array([True] * len(rows))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).take(pa.array(rows)), *columns], ["doc_id", "score", "threshold", "windows", "start", "stop", "gain", "toxic"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(judge, "doc_id long, score double, threshold double, windows int, start int, stop int, gain int, toxic boolean")
