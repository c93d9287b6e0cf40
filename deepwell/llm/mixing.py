"""Mixing sources to target weights, by blocks of tokens.

``mix(docs)`` packs each source's tokens into blocks of ``block`` tokens and draws output shards of
``shard`` slots; one row per slot:

    shard BIGINT, slot INT, source STRING, epoch BIGINT, block BIGINT (number in the source),
    n_tokens INT, doc_ids ARRAY<BIGINT>, lengths ARRAY<INT>, langs ARRAY<STRING>, tokens BINARY,
    tails ARRAY<BINARY> (of each stretch, the bytes that complete a character which its end cuts)

1. Documents go to buckets by a hash of id and text, of about ``BUCKET`` each, and in a bucket's order, by hash, each
   source's tokens are packed into blocks. What is left of a source in a bucket, less than a block, gets a place in the
   source's remainders by a prefix sum over buckets, and is cut again at multiples of ``block``: only the last block of
   a source may be short. A source's blocks are numbered through the buckets by a prefix sum, those of the remainders
   last. So blocks are a function of the table's rows, whatever files and tasks they come in.
2. Shard s draws its source counts from a multinomial with the target weights, by a generator keyed on
   (seed, s). There are as many slots as blocks, so weights above a source's share repeat it, and
   weights below thin it out.
3. A source's slots are numbered through the shards; slot j is block P(j mod n) of epoch j div n, where P
   is a Feistel permutation of 0..n-1 keyed on (seed, source, epoch): each epoch sees each block once.
   Slots meet the blocks' numbers first, without tokens, and then the blocks; tokens move for that only where the
   slots are more than ``broadcast_if_small`` takes.

``weights`` maps sources to weights (others get 0; those without blocks too); by default a source's
weight is its tokens to the power ``TEMPERATURE``. The driver gets a row per source.

Defined cases: a null source is a source of its own (null); null and empty texts have no tokens; null
ids and languages pass through, also where the column is missing; repeated rows are packed each; other columns are
ignored by ``mix`` and kept by ``mixed_documents``; an empty table gives no slots; weights that leave no source with
blocks are a ValueError.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window as W

from . import textops as T
from .store import broadcast_if_small, written
from .tokens import Vocabulary, pack_ids, unpack_ids, vocabulary

BLOCK = 2048
SHARD = 256
TEMPERATURE = 0.7
SEED = 20260101
VOCABULARY = "byte_bpe_50k.tiktoken"
BUCKET = 4096
RANGE = 4096  # of buckets or shards, in prefix sums
CARRIED = -1  # as bucket: the blocks of what the buckets left


def _tokenise(vocab: str, folder: str | None):
    """(bucket, hash, rest, source, meta, text) -> the same with tokens for the text, of rows that have some."""

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(vocab, folder)
        for batch in batches:
            for lo, hi, data, offsets in T.text_slices(batch.column(5)):
                ids, at = v.encode(data, offsets)
                some = np.flatnonzero(np.diff(at) > 0)
                raw = pa.array([pack_ids(ids[at[i] : at[i + 1]], v.n) for i in some], pa.binary())
                yield pa.RecordBatch.from_arrays([c.slice(lo, hi - lo).take(pa.array(some)) for c in batch.columns[:5]] + [raw], ["bucket", "hash", "rest", "source", "meta", "tokens"])

    return tokenise


def _tail(v: Vocabulary, after: np.ndarray) -> bytes:
    """The leading bytes of what comes after a cut that continue a character before it."""
    out = b""
    for i in after[:4].tolist():
        for b in v.pieces[i]:
            if b & 0xC0 != 0x80:
                return out
            out += bytes([b])
    return out


def _cut(block: int, vocab: str, folder: str | None):
    """Rows in order of bucket -> blocks: (source, bucket, number, n_tokens, metas, lengths, tails, tokens)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(vocab, folder)
        bucket = None
        held: dict = {}  # source: [blocks so far, tokens, metas, lengths, tails, parts] of the open block
        out: list[list] = [[] for _ in range(8)]
        meta = None

        def close(source) -> None:
            own = held[source]
            for column, value in zip(out, (source, bucket, own[0], own[1], own[2], own[3], own[4], b"".join(own[5])), strict=True):
                column.append(value)
            held[source] = [own[0] + 1, 0, [], [], [], []]

        def close_all() -> None:
            for source in sorted(held, key=lambda s: (s is None, s or "")):
                if held[source][1]:
                    close(source)
            held.clear()

        def ready() -> pa.RecordBatch:
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.list_(meta), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.binary()]
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["source", "bucket", "number", "n_tokens", "metas", "lengths", "tails", "tokens"])
            for c in out:
                c.clear()
            return batch

        for batch in batches:
            meta = batch.schema.field("meta").type
            for b, source, about, raw in zip(*(batch.column(i).to_pylist() for i in (0, 3, 4, 5)), strict=True):
                if b != bucket:
                    close_all()
                    bucket = b
                tokens = unpack_ids(raw, v.n)
                a, end = 0, len(tokens)
                while a < end:
                    own = held.setdefault(source, [0, 0, [], [], [], []])
                    n = min(end - a, block - own[1])
                    own[1] += n
                    own[2].append(about)
                    own[3].append(n)
                    own[4].append(_tail(v, tokens[a + n : a + n + 4]))
                    own[5].append(pack_ids(tokens[a : a + n], v.n))
                    a += n
                    if own[1] == block:
                        close(source)
                if len(out[0]) >= 256:
                    yield ready()
        close_all()
        if out[0]:
            yield ready()

    return cut


def _recut(block: int, vocab: str, folder: str | None):
    """Remainders with their place among the source's -> pieces: (source, number of block, place, as blocks have)."""

    def recut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(vocab, folder)
        for batch in batches:
            meta = batch.schema.field("metas").type
            out: list[list] = [[] for _ in range(8)]
            for source, place, metas, lengths, tails, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tokens = unpack_ids(raw, v.n)
                edge = min(len(tokens), block - place % block)
                for lo, hi in ((0, edge), (edge, len(tokens))):
                    if lo == hi:
                        continue
                    own: tuple[list, list, list] = ([], [], [])
                    at = 0
                    for about, n, tail in zip(metas, lengths, tails, strict=True):
                        a, b = max(lo, at), min(hi, at + n)
                        if a < b:
                            if b < at + n:
                                rest = tokens[b : min(b + 4, at + n)]
                                more = _tail(v, rest)
                                tail = more + (tail if len(more) == sum(len(v.pieces[i]) for i in rest) else b"")
                            for column, value in zip(own, (about, b - a, tail), strict=True):
                                column.append(value)
                        at += n
                    for column, value in zip(out, (source, (place + lo) // block, place + lo, hi - lo, *own, pack_ids(tokens[lo:hi], v.n)), strict=True):
                        column.append(value)
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), meta, pa.list_(pa.int32()), pa.list_(pa.binary()), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["source", "number", "place", "n_tokens", "metas", "lengths", "tails", "tokens"])

    return recut


def _before(sizes: DataFrame, group: str, order: str, n: str) -> DataFrame:
    """``sizes`` with ``before``: the sum of ``n`` in the group's rows of a smaller ``order``; by ranges first, so that no task holds a group."""
    sizes = sizes.withColumn("range", F.floor(F.col(order) / RANGE))
    ranges = sizes.groupBy(group, "range").agg(F.sum(n).alias("m"))
    ranges = ranges.withColumn("base", F.sum("m").over(W.partitionBy(group).orderBy("range")) - F.col("m"))
    ranges = ranges.select(F.col(group).alias("_group"), F.col("range").alias("_range"), "base")
    joined = sizes.join(ranges, F.col(group).eqNullSafe(F.col("_group")) & (F.col("range") == F.col("_range")))
    return joined.withColumn("before", F.col("base") + F.sum(n).over(W.partitionBy(group, "range").orderBy(order)) - F.col(n)).drop("_group", "_range", "range", "base")


def _blocks(docs: DataFrame, block: int, vocab: str, folder: str | None) -> DataFrame:
    """A written table of blocks: (source, bucket, number, n_tokens, metas, lengths, tails, tokens); metas: the other columns."""
    buckets = max(1, -(-docs.count() // BUCKET))
    have = lambda name, kind: (F.col(f"`{name}`") if name in docs.columns else F.lit(None)).cast(kind)
    meta = [have("doc_id", "long").alias("doc_id"), have("lang", "string").alias("lang"), *(F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "lang", "source", "text"))]
    rows = docs.select(have("source", "string").alias("source"), F.struct(*meta).alias("meta"), have("text", "string").alias("text")).where("text <> ''")
    hash_ = F.xxhash64("meta.doc_id", "text")
    rows = rows.select(F.pmod(hash_, F.lit(buckets)).alias("bucket"), hash_.alias("hash"), F.xxhash64(F.to_json("meta")).alias("rest"), "source", "meta", "text")
    kind = rows.schema["meta"].dataType.simpleString()
    tokens = rows.mapInArrow(_tokenise(vocab, folder), StructType([*rows.schema.fields[:5]]).add("tokens", "binary"))
    tokens = tokens.repartition("bucket").sortWithinPartitions("bucket", "source", "hash", "rest", "tokens")
    schema = f"source string, bucket long, number long, n_tokens int, metas array<{kind}>, lengths array<int>, tails array<binary>, tokens binary"
    cut = written(tokens.mapInArrow(_cut(block, vocab, folder), schema), "blocks")
    left = cut.where(F.col("n_tokens") < block)
    place = _before(left.select("source", "bucket", "n_tokens"), "source", "bucket", "n_tokens").select(F.col("source").alias("_source"), F.col("bucket").alias("_bucket"), "before")
    left = left.join(place, F.col("source").eqNullSafe(F.col("_source")) & (F.col("bucket") == F.col("_bucket"))).select("source", F.col("before").alias("place"), "metas", "lengths", "tails", "tokens")
    pieces = left.mapInArrow(_recut(block, vocab, folder), f"source string, number long, place long, n_tokens int, metas array<{kind}>, lengths array<int>, tails array<binary>, tokens binary")
    whole = pieces.groupBy("source", "number").agg(F.sum("n_tokens").cast("int").alias("n_tokens"), F.collect_list(F.struct("place", "metas", "lengths", "tails", "tokens")).alias("all"))
    whole = whole.withColumn("all", F.array_sort("all", lambda a, b: F.signum(a["place"] - b["place"]).cast("int")))
    each = lambda name: F.flatten(F.transform("all", lambda p: p[name])).alias(name)
    joined = F.aggregate("all", F.lit(b""), lambda got, p: F.concat(got, p["tokens"])).alias("tokens")
    whole = whole.select("source", F.lit(CARRIED).cast("long").alias("bucket"), "number", "n_tokens", each("metas"), each("lengths"), each("tails"), joined)
    return cut.where(F.col("n_tokens") == block).union(written(whole, "carried"))


def feistel(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """A permutation of 0..n-1 without a table: four Feistel rounds, walking cycles back into range."""
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    out = np.asarray(x).astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        a, b = out[todo] >> shift, out[todo] & mask
        for r in range(4):
            a, b = b, a ^ (T.mix(b ^ np.uint64(T.mix_int(key + r))) & mask)
        out[todo] = a << shift | b
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def source_key(seed: int, source: str | None, epoch: int) -> int:
    h = T.mix_int(seed)
    for b in (b"\xff" if source is None else source.encode()):
        h = T.mix_int(h ^ b)
    return T.mix_int(h ^ epoch)


def shard_counts(seed: int, shard: int, slots: int, p: list[float]) -> np.ndarray:
    return np.random.Generator(np.random.Philox(key=[seed, shard])).multinomial(slots, p)


def _draw(seed: int, shard: int, total: int, sources: list, p: list[float]):
    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in batch.column(0).to_pylist():
                n = shard_counts(seed, s, min(shard, total - s * shard), p)
                yield pa.RecordBatch.from_arrays([pa.array([s] * len(sources), pa.int64()), pa.array(range(len(sources)), pa.int32()), pa.array(n, pa.int64())], ["shard", "k", "n"])

    return draw


def _slots(seed: int, sources: list, blocks: list[int]):
    """(shard, k, n, before, first) -> one row per slot."""

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, k, n, before, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not n:
                    continue
                j = before + np.arange(n)
                epoch, at = j // blocks[k], j % blocks[k]
                number = np.empty(n, np.int64)
                for e in np.unique(epoch):
                    own = epoch == e
                    number[own] = feistel(at[own], blocks[k], source_key(seed, sources[k], int(e)))
                place = np.argsort(np.argsort(T.mix(np.uint64(T.mix_int(seed ^ shard)) + np.arange(first, first + n, dtype=np.uint64)), kind="stable"), kind="stable")
                yield pa.RecordBatch.from_arrays([pa.array([shard] * n, pa.int64()), pa.array(first + place, pa.int32()), pa.array([sources[k]] * n, pa.string()), pa.array(epoch), pa.array(number)], ["shard", "slot", "source", "epoch", "block"])

    return slots


def _drawn(docs: DataFrame, weights: Mapping[str, float] | None, block: int, shard: int, seed: int, vocab: str, folder: str | None) -> DataFrame:
    """(shard, slot, source, epoch, block, n_tokens, metas, lengths, tails, tokens) of every slot."""
    spark = docs.sparkSession
    blocks = _blocks(docs, block, vocab, folder)
    sizes = written(blocks.groupBy("source", "bucket").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t")), "sizes")
    each = sorted(sizes.groupBy("source").agg(F.sum("n").alias("n"), F.sum("t").alias("t")).collect(), key=lambda r: (r["source"] is None, r["source"] or ""))
    sources, n_blocks = [r["source"] for r in each], [r["n"] for r in each]
    total = sum(n_blocks)
    mass = [float(r["t"]) ** TEMPERATURE if weights is None else float(weights.get(r["source"], 0)) for r in each]
    if total and not sum(mass) > 0:
        raise ValueError("no source with blocks has a weight")
    p = [m / sum(mass) for m in mass]
    n_shards = -(-total // shard)
    drawn = spark.range(n_shards).mapInArrow(_draw(seed, shard, total, sources, p), "shard long, k int, n long")
    drawn = _before(drawn, "k", "shard", "n")
    drawn = drawn.withColumn("first", F.sum("n").over(W.partitionBy("shard").orderBy("k")) - F.col("n"))
    drawn = drawn.select("shard", "k", "n", "before", "first").repartition(max(1, n_shards // 64 + 1), "shard", "k")
    slots = drawn.mapInArrow(_slots(seed, sources, n_blocks), "shard long, slot int, source string, epoch long, block long")
    # the remainders' blocks come last
    last = F.when(F.col("bucket") == CARRIED, F.lit((1 << 62) // RANGE * RANGE)).otherwise(F.col("bucket"))
    starts = _before(sizes.withColumn("order", last), "source", "order", "n").select("source", "bucket", "before")
    index = _on(blocks.select("source", "bucket", "number"), starts, "source", "bucket").select("source", (F.col("before") + F.col("number")).alias("block"), "bucket", "number")
    slots = written(_on(slots, index, "source", "block"), "slots")
    return _on(blocks, broadcast_if_small(slots), "source", "bucket", "number")


def _on(left: DataFrame, right: DataFrame, *columns: str) -> DataFrame:
    """A join in which null equals null; the columns stay once."""
    right = right.withColumnsRenamed({c: f"_{c}" for c in columns})
    same: Column = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return left.join(right, same).drop(*(f"_{c}" for c in columns))


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, block: int = BLOCK, shard: int = SHARD, seed: int = SEED, vocab: str = VOCABULARY, folder: str | None = None) -> DataFrame:
    docs = docs.select(*(c for c in ("doc_id", "lang", "source", "text") if c in docs.columns))
    slots = _drawn(docs, weights, block, shard, seed, vocab, folder)
    about = lambda name: F.transform("metas", lambda m: m[name]).alias(f"{name}s")
    return slots.select("shard", "slot", "source", "epoch", "block", "n_tokens", about("doc_id"), "lengths", about("lang"), "tokens", "tails")


def _texts(vocab: str, folder: str | None, names: list[str]):
    """Slots -> a row of each document's stretch in each slot."""

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(vocab, folder)
        flat = np.frombuffer(b"".join(v.pieces), np.uint8)
        at = np.cumsum(v.sizes) - v.sizes
        for batch in batches:
            for rows in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                source, metas, lengths, tails, tokens = (rows.column(i) for i in range(5))
                sizes, out = [], []
                for r in range(rows.num_rows):
                    own = unpack_ids(tokens[r].as_py(), v.n)
                    raw = flat[T.ragged(at[own], v.sizes[own])].tobytes()
                    n = lengths[r].as_py()
                    a = 0
                    for b, tail in zip(np.cumsum(v.sizes[own])[np.cumsum(n) - 1].tolist(), tails[r].as_py(), strict=True):
                        while a < b and raw[a] & 0xC0 == 0x80:  # the stretch before has this character
                            a += 1
                        out.append((raw[a:b] + tail).decode("utf-8", "replace"))
                        a = b
                    sizes.append(len(n))
                about = metas.flatten()
                columns = {"text": pa.array(out, pa.string()), "source": source.take(pa.array(np.repeat(np.arange(len(sizes)), sizes))), "n_chars": pa.array([len(t) for t in out], pa.int64())}
                columns = {f.name: about.field(i) for i, f in enumerate(about.type)} | columns
                yield pa.RecordBatch.from_arrays([columns[n] for n in names], names)

    return texts


def mixed_documents(docs: DataFrame, weights: Mapping[str, float] | None = None, block: int = BLOCK, shard: int = SHARD, seed: int = SEED, vocab: str = VOCABULARY, folder: str | None = None) -> DataFrame:
    """The mix as documents: each slot's stretches of text, in the columns of ``docs``.

    A document that spans blocks gives a row for each, of which ``text`` and ``n_chars`` are the stretch's; one after the
    other they are the document, to the character: one that a block's edge cuts belongs to the stretch in which it begins.
    A stretch of the rest of such a character alone is a row with an empty text.
    """
    names = docs.columns
    schema = StructType([f for f in docs.schema])
    slots = _drawn(docs, weights, block, shard, seed, vocab, folder).select("source", "metas", "lengths", "tails", "tokens")
    made = ("doc_id long", "lang string", "source string", "text string", "n_chars long")
    kinds = {m.split()[0]: m.split()[1] for m in made}
    out = slots.mapInArrow(_texts(vocab, folder, names), ", ".join(f"`{f.name}` {kinds.get(f.name) or f.dataType.simpleString()}" for f in schema))
    return out.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema))
