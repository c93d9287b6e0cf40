"""Language-model scores by a weighted backoff automaton over words.

``score(docs)`` trains a model of the whole table and returns one row per document:

    doc_id BIGINT, tokens BIGINT (words, the end included), log_prob DOUBLE (natural, mean per token),
    total_log_prob DOUBLE, bits DOUBLE (per token), perplexity DOUBLE (per token)

A word is a run of bytes other than white space, ASCII letters in lower case; each text has two starts before its words and
an end after them. All n-grams of one to three words of all texts are counted, none is dropped, and smoothed towards the
next shorter one, a token's own occurrence left out of the counts by which it is scored (c counts, h' is h less its oldest
word, N are all tokens):

    p(w | h) = (c(hw) - 1 + K p(w | h')) / (c(h) - 1 + K),    p(w) = (c(w) - 1 + K / OPEN) / (N - 1 + K)

So a state is a context of two words, one or none. It has an arc, of weight log p(w | h), to the longest context that ends
hw for each n-gram that occurs again, c(hw) > 1, and a failure arc of weight log(K / (c(h) - 1 + K)) to h'. The state
after a word is the pair of words that ends there, so a text's transitions are resolved side by side: each takes its
state's arc or follows failure arcs to one, and their weights are added up from left to right.

The automaton is as large as the corpus, so no machine holds it. Texts are stored in parts of about ``part_bytes``; a part
sends its distinct n-grams with their counts, as sorted and compressed hashes, to buckets of hashes, where counts of all
parts are added up, and gets back the totals of its own n-grams: those states and arcs that its texts can reach. A bucket
holds an n-gram once for each part, however often it occurs, and about ``bucket_keys`` hashes. Hashes are cut to 20 bits
more than it takes to number the corpus's n-grams, so that one in a million meets another, at every size.

Defined cases: a null text has null scores and 0 tokens; one that is empty or white space scores its end alone; repeated
rows count and are scored each; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard as zs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T
from .store import written

ORDER = 3
STRENGTH = (1.0, 4.0, 1.0)  # K of contexts of no, one and two words
OPEN = 1 << 20
PART_BYTES = 2 << 20
BUCKET_KEYS = 1 << 20
SPARE_BITS = 20

_START, _END, _ALL = (np.uint64(T.mix_int(x)) for x in (0x57A27, 0xE4D, 0xA11))


# --- a part's n-grams -----------------------------------------------------------------------------


def _types(code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct codes, ascending, each place's, and how often they occur."""
    order = np.argsort(code)
    code = code[order]
    new = np.ones(len(code), bool)
    np.not_equal(code[1:], code[:-1], out=new[1:])
    at = np.empty(len(code), np.int32)
    at[order] = np.cumsum(new, dtype=np.int32) - 1
    first = np.flatnonzero(new)
    return code[first], at, np.diff(first, append=len(code))


class Part:
    """Of some texts, the tokens with their starts and the n-grams that end at each; ``keys`` are the distinct hashes, ascending."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, bits: int):
        low = T.LOWER[data]
        starts, ends, at = T.words(low, offsets)
        n = np.diff(at) + 2
        self.bounds = np.concatenate([[0], np.cumsum(n)])
        words = np.empty(self.bounds[-1], np.uint64)
        words[T.ragged(self.bounds[:-1] + 1, n - 2)] = T.span_hashes(T.prefix_hash(low), starts, ends)
        self.first, last = self.bounds[:-1], self.bounds[1:] - 1
        words[self.first], words[last] = _START, _END
        name, self.word, count1 = _types(words)
        del low, starts, ends, words
        before = np.concatenate([[0], self.word[:-1]]).astype(np.int64)
        before[self.first] = self.word[self.first]  # two starts
        pair, self.pair, count2 = _types(before << 32 | self.word)
        del before
        self.context = np.concatenate([[0], self.pair[:-1]]).astype(np.int32)
        inner = np.ones(len(self.word), bool)
        inner[self.first] = False
        self.scored = np.flatnonzero(inner)
        triple, self.triple, count3 = _types(self.context[self.scored].astype(np.int64) << 32 | self.word[self.scored])
        a, b = name[pair >> 32], name[pair & 0xFFFFFFFF]
        self.pair_head, self.pair_last = pair >> 32, pair & 0xFFFFFFFF
        of = triple >> 32
        with np.errstate(over="ignore"):
            two = T.mix(T.mix(a) * np.uint64(3) + b)
            three = T.mix(T.mix(two[of] + np.uint64(7)) * np.uint64(5) + name[triple & 0xFFFFFFFF])
            key = np.concatenate([T.mix(name + np.uint64(1)), T.mix(two + np.uint64(2)), T.mix(three + np.uint64(3)), [_ALL]]) >> np.uint64(64 - bits)
        self.sizes = np.cumsum([len(name), len(pair), len(triple)])
        count = np.concatenate([count1, count2, count3, [len(self.scored)]])
        self.keys, self.place, _ = _types(key)
        self.counts = np.bincount(self.place, count, len(self.keys)).astype(np.int64)

    def log_probs(self, totals: np.ndarray) -> np.ndarray:
        """Of each row, the sum over its tokens; ``totals``: of the keys, in the corpus."""
        c1, c2, c3, total = np.split(totals[self.place].astype(np.float64), self.sizes)
        k0, k1, k2 = STRENGTH
        one = (c1 - 1 + k0 / OPEN) / (total[0] - 1 + k0)
        two = (c2 - 1 + k1 * one[self.pair_last]) / (c1[self.pair_head] - 1 + k1)
        fail1, fail2 = np.log(k1 / (c1 - 1 + k1)), np.log(k2 / (c2 - 1 + k2))
        place, word, pair, state = self.scored, self.word[self.scored], self.pair[self.scored], self.context[self.scored]
        gain = fail2[state] + fail1[self.pair_last[state]] + np.log(one)[word]  # down to the root
        again = c2[pair] > 1
        gain[again] = fail2[state[again]] + np.log(two[pair[again]])
        again = c3[self.triple] > 1
        t, s = self.triple[again], state[again]
        gain[again] = np.log((c3[t] - 1 + k2 * two[pair[again]]) / (c2[s] - 1 + k2))
        sums = np.concatenate([[0.0], np.cumsum(gain)])
        at = np.searchsorted(place, self.bounds)
        return sums[at[1:]] - sums[at[:-1]]


# --- the exchange ---------------------------------------------------------------------------------


def _pack(values: np.ndarray) -> bytes:
    """Integers by planes of their bytes, compressed."""
    return zs.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())


def _unpack(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zs.ZstdDecompressor().decompress(raw), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).reshape(-1).view("<u8")


def _store(part_bytes: int):
    """(doc_id, text) -> parts: (part, doc_ids, sizes (-1: null), compressed texts)."""
    names = ["part", "doc_ids", "sizes", "texts"]

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 32
        ids, sizes, texts, held = [], [], [], 0

        def close() -> pa.RecordBatch:
            raw = zs.ZstdCompressor(level=5).compress(b"".join(texts))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([raw], pa.binary())], names)

        for batch in batches:
            for lo, hi, data, offsets in T.text_slices(batch.column(1), max(1, part_bytes // 4)):
                own = batch.column(1).slice(lo, hi - lo)
                size = np.where(np.asarray(own.is_null()), -1, np.diff(offsets))
                ids += batch.column(0).slice(lo, hi - lo).to_pylist()
                sizes += size.tolist()
                texts.append(data.tobytes())
                held += len(data)
                if held >= part_bytes or len(ids) >= 1 << 18:
                    yield close()
                    part, ids, sizes, texts, held = part + 1, [], [], [], 0
        if ids:
            yield close()

    return store


def _load(sizes: list[int], raw: bytes, bits: int) -> Part:
    data = np.frombuffer(zs.ZstdDecompressor().decompress(raw), np.uint8)
    return Part(data, np.concatenate([[0], np.cumsum(np.maximum(sizes, 0))]), bits)


def _bounds(buckets: int, bits: int) -> np.ndarray:
    """The first key of each bucket."""
    return np.array([(i << bits) // buckets for i in range(buckets)], np.uint64)


def _send(buckets: int, bits: int):
    """Parts -> (bucket, part, keys, counts)."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = _bounds(buckets, bits)
        for batch in batches:
            for r in range(batch.num_rows):
                own = _load(batch.column(1)[r].as_py(), batch.column(2)[r].as_py(), bits)
                at = [*np.searchsorted(own.keys, bounds).tolist(), len(own.keys)]
                rows = [(i, _pack(np.diff(own.keys[a:b], prepend=np.uint64(0))), _pack(own.counts[a:b])) for i, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)) if a < b]
                number, keys, counts = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), pa.array([batch.column(0)[r].as_py()] * len(rows), pa.int64()), pa.array(keys, pa.binary()), pa.array(counts, pa.binary())], ["bucket", "part", "keys", "counts"])

    return send


def _total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of bucket -> (part, bucket, totals of the part's keys in it)."""
    bucket, held = None, []

    def close() -> pa.RecordBatch:
        parts, keys, counts = zip(*held, strict=True)
        sizes = np.cumsum([len(k) for k in keys])[:-1]
        keys_, place, _ = _types(np.concatenate(keys))
        total = np.bincount(place, np.concatenate(counts), len(keys_)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), pa.array([bucket] * len(parts), pa.int32()), pa.array([_pack(t) for t in np.split(total[place], sizes)], pa.binary())], ["part", "bucket", "totals"])

    for batch in batches:
        for b, part, keys, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if b != bucket and held:
                yield close()
                held = []
            bucket = b
            held.append((part, np.cumsum(_unpack(keys), dtype=np.uint64), _unpack(counts)))
    if held:
        yield close()


def _judge(bits: int):
    """Rows in order of part, its texts before its totals by bucket -> scores."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        totals: list = []

        def close() -> Iterator[pa.RecordBatch]:
            ids, sizes, raw = held
            own = _load(sizes, raw, bits)
            log = own.log_probs(np.concatenate(totals))
            n = np.diff(own.bounds) - 1
            none = np.array(sizes) < 0
            bits_ = -log / n / math.log(2)
            columns = [pa.array(ids, pa.int64()), pa.array(np.where(none, 0, n)), *(pa.array(x, mask=none) for x in (log / n, log, bits_, 2.0**bits_))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "tokens", "log_prob", "total_log_prob", "bits", "perplexity"])

        for batch in batches:
            for r in range(batch.num_rows):
                if batch.column(1)[r].as_py() < 0:
                    if held:
                        yield from close()
                    held, totals = [batch.column(i)[r].as_py() for i in (2, 3, 4)], []
                else:
                    totals.append(_unpack(batch.column(4)[r].as_py()))
        if held:
            yield from close()

    return judge


def score(docs: DataFrame, part_bytes: int = PART_BYTES, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = written(rows.mapInArrow(_store(part_bytes), "part long, doc_ids array<long>, sizes array<long>, texts binary"), "parts")
    n = parts.select(F.aggregate("sizes", F.lit(0.0), lambda n, size: n + F.greatest(size, F.lit(0)) / 5 + 3).alias("n")).agg(F.sum("n")).first()[0] or 1.0
    grams = ORDER * n  # a bound on the n-grams for words of four bytes and a blank; more of them only make the buckets fuller
    bits = int(min(64, max(40, SPARE_BITS + math.ceil(math.log2(grams)))))
    buckets = max(1, math.ceil(grams / bucket_keys))
    sent = parts.select("part", "sizes", "texts").mapInArrow(_send(buckets, bits), "bucket int, part long, keys binary, counts binary")
    totals = sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_total, "part long, bucket int, totals binary")
    back = totals.select("part", "bucket", F.lit(None).cast("array<long>").alias("doc_ids"), F.lit(None).cast("array<long>").alias("sizes"), F.col("totals").alias("raw"))
    texts = parts.select("part", F.lit(-1).alias("bucket"), "doc_ids", "sizes", F.col("texts").alias("raw"))
    both = texts.union(back).repartition("part").sortWithinPartitions("part", "bucket")
    return both.mapInArrow(_judge(bits), "doc_id long, tokens long, log_prob double, total_log_prob double, bits double, perplexity double")
