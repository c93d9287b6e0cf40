"""Near-duplicate documents: SuperMinHash signatures, banding, verification, union-find grouping.

``near_duplicates(docs)`` returns one row per document that has a near copy:

    doc_id BIGINT, group_id BIGINT (the group's smallest doc_id), keep BOOLEAN (doc_id = group_id)

Two documents are near copies when the Jaccard similarity of their sets of ``SHINGLE``-word shingles
(ASCII lower case) is at least ``threshold``; groups are the connected components of that relation
over the candidates. A SuperMinHash signature (Ertl, 2017) gives each element a random permutation of
the components and rank-correlated values ``j + r``; an element's later ranks can only raise a
component's value, so a document stops at rank j as soon as every component is below j + 1. Bands of
``ROWS`` components propose candidates, which exact set intersection verifies. Texts that are equal
word for word are collapsed first, so thousands of copies cost one signature in the bands.

Defined cases: a text that is null, empty or only white space is nobody's copy; a text shorter than a
shingle is one shingle; rows that share a doc_id are one document; rows without a doc_id are left
out; other columns are ignored; an empty table gives an empty result.

Candidates: a bucket of at most ``ALL_PAIRS`` documents gives all its pairs. A larger one gives the
pairs with its smallest member first; then, if its members are not in one verified group yet, its members are split into
blocks of about ``BLOCK``, each two blocks meet in one task, and members of different groups are compared there. No pair is
emitted but a link that joins groups. Pairs within a group are skipped, so the groups are those of all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T
from .store import broadcast_if_small, written

SHINGLE = 3
COMPONENTS = 160
ROWS = 4
THRESHOLD = 0.5
ALL_PAIRS = 8
BLOCK = 256
BROADCAST_BYTES = 16 << 20
ONE_TASK_EDGES = 500_000

_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def signatures(elements: np.ndarray, bounds: np.ndarray, m: int = COMPONENTS) -> np.ndarray:
    """SuperMinHash of each row's elements, ``elements[bounds[i]:bounds[i + 1]]`` (64-bit hashes).

    Component values are ``j << 32 | r``: rank j of the element's permutation, then 32 random bits.
    Repeated elements change nothing. A row without elements keeps 2**64 - 1 everywhere.
    """
    n = len(bounds) - 1
    sig = np.full((n, m), _EMPTY)
    flat = sig.reshape(-1)
    counts = np.diff(bounds)
    row = np.repeat(np.arange(n), counts)
    width = np.uint64(m)
    seed = T.mix(elements)
    first = (seed % width).astype(np.int64)
    np.minimum.at(flat, row * m + first, T.mix(seed) >> np.uint64(32))
    open_rows = np.flatnonzero((counts > 0) & (sig.max(1, initial=0) >= np.uint64(1 << 32)))
    if not len(open_rows):
        return sig
    for lo in range(0, len(open_rows), 256):
        _later_ranks(sig, seed, first, bounds, open_rows[lo : lo + 256], m)
    return sig


def _later_ranks(sig: np.ndarray, seed: np.ndarray, first: np.ndarray, bounds: np.ndarray, rows: np.ndarray, m: int) -> None:
    """Ranks 1, 2, ... of the rows whose components aren't all below 1 after rank 0."""
    flat = sig.reshape(-1)
    at = T.ragged(bounds[rows], bounds[rows + 1] - bounds[rows])
    row = np.repeat(rows, bounds[rows + 1] - bounds[rows])
    order = np.lexsort((seed[at], row))  # each element of a row once
    at, row = at[order], row[order]
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (seed[at[1:]] != seed[at[:-1]])])
    at, row = at[new], row[new]
    state, k = seed[at], first[at]
    order = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (len(at), 1))
    line = np.arange(len(at))
    order[line, k] = 0
    order[:, 0] = k
    for j in range(1, m):
        state = T.mix(state + np.uint64(j))
        k = j + (state % np.uint64(m - j)).astype(np.int64)
        here = order[line, k].copy()
        order[line, k] = order[line, j]
        order[line, j] = here
        np.minimum.at(flat, row * m + here, T.mix(state) >> np.uint64(32) | np.uint64(j << 32))
        alive = sig[rows].max(1) >= np.uint64(j + 1 << 32)
        if not alive.any():
            return
        if not alive.all():
            rows = rows[alive]
            stay = np.flatnonzero(np.isin(row, rows))
            row, state, order, line = row[stay], state[stay], order[stay], np.arange(len(stay))


def bands(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key for each band of ``rows`` components; the band's number is part of the key."""
    n, m = sig.shape
    parts = sig[:, : m // rows * rows].reshape(n, m // rows, rows)
    key = np.broadcast_to(np.arange(m // rows, dtype=np.uint64) + np.uint64(1), (n, m // rows)).copy()
    for i in range(rows):
        key = T.mix(key ^ T.mix(parts[:, :, i] + np.uint64(i)))
    return key


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes of each row, their bounds, and the word hashes' bounds."""
    data = T.LOWER[data]
    starts, ends, at = T.words(data, offsets)
    word = T.span_hashes(T.prefix_hash(data), starts, ends)
    n = np.diff(at)
    count = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    bounds = np.concatenate([[0], np.cumsum(count)])
    all_of = T.shingle_hashes(np.concatenate([word, np.zeros(SHINGLE, np.uint64)]), SHINGLE)
    out = all_of[T.ragged(at[:-1], count)] if len(word) else np.zeros(0, np.uint64)
    for i in np.flatnonzero((n > 0) & (n < SHINGLE)):  # too short for a shingle: the words are one
        out[bounds[i]] = T.mix_int(int(sum(int(w) * (2 * k + 3) for k, w in enumerate(word[at[i] : at[i + 1]]))))
    return out, bounds, word


def _digests(word_at: np.ndarray, element: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of the sequence of shingles, so of the sequence of words."""
    with np.errstate(over="ignore"):
        place = np.arange(len(element), dtype=np.uint64) - np.repeat(bounds[:-1], np.diff(bounds)).astype(np.uint64)
        out = []
        for salt in (0x51ED270B, 0x2545F491):
            total = np.concatenate([[np.uint64(0)], np.cumsum(T.mix(element ^ T.mix(place + np.uint64(salt))))])
            out.append(total[bounds[1:]] - total[bounds[:-1]])
    return out[0], out[1]


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        for lo, hi, data, offsets in T.text_slices(batch.column(1)):
            element, bounds, word = shingles(data, offsets)
            some = np.flatnonzero(np.diff(bounds) > 0)
            if not len(some):
                continue
            key = bands(signatures(element, bounds))[some]
            a, b = _digests(word, element, bounds)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * key.shape[1], pa.int32()), pa.array(key.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo).take(pa.array(some)), pa.array(a[some].view(np.int64)), pa.array(b[some].view(np.int64)), lists], ["doc_id", "h1", "h2", "bands"])


def _needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hub, doc_id, set): a document's sorted shingle set, once for each hub that asks for it."""
    for batch in batches:
        ids, hubs = batch.column(0), batch.column(2)
        for lo, hi, data, offsets in T.text_slices(batch.column(1)):
            element, bounds, _ = shingles(data, offsets)
            out: tuple[list, list, list] = ([], [], [])
            for i in range(hi - lo):
                if bounds[i] == bounds[i + 1]:
                    continue
                own = np.unique(element[bounds[i] : bounds[i + 1]]).tobytes()
                for hub in hubs[lo + i].as_py():
                    for column, value in zip(out, (hub, ids[lo + i].as_py(), own), strict=True):
                        column.append(value)
                if len(out[0]) >= 2000:
                    yield _sets(out)
                    out = ([], [], [])
            if out[0]:
                yield _sets(out)


def _sets(out: tuple[list, list, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], ["hub", "doc_id", "elements"])


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted arrays of distinct values, not both empty."""
    both = np.concatenate([a, b])
    both.sort()
    same = int((both[1:] == both[:-1]).sum())
    return same / (len(both) - same)


def _compare(threshold: float):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = None, []
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            sets = batch.column(2)
            src, dst = [], []
            for i, (h, d) in enumerate(zip(a, b, strict=True)):
                if h != hub:
                    hub, own = h, []
                mine = np.frombuffer(sets[i].as_buffer(), np.uint64)
                if d == h:
                    own.append(mine.copy())
                elif any(min(len(x), len(mine)) >= threshold * max(len(x), len(mine)) and jaccard(x, mine) >= threshold for x in own):
                    src.append(h)
                    dst.append(d)
            if src:
                yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["a", "b"])

    return compare


def verified(pairs: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of similarity ``threshold`` or more. Each text is read once and only its set travels."""
    wanted = pairs.select(F.col("b").alias("doc_id"), F.col("a").alias("hub")).union(pairs.select(F.col("a").alias("doc_id"), F.col("a").alias("hub")))
    wanted = written(wanted.groupBy("doc_id").agg(F.collect_set("hub").alias("hubs")), "wanted")
    sets = docs.join(broadcast_if_small(wanted, BROADCAST_BYTES), "doc_id").select("doc_id", "text", "hubs").mapInArrow(_needed, "hub long, doc_id long, elements binary")
    sets = sets.repartition("hub").sortWithinPartitions("hub", "doc_id")  # a hub is its pairs' smallest
    return sets.mapInArrow(_compare(threshold), "a long, b long")


def _blocked_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, meetings) -> (bucket, low, high, doc_id, group, set) for each two blocks that the document meets in."""
    names = ["bucket", "low", "high", "doc_id", "root", "elements"]
    for batch in batches:
        meetings = batch.column(2)
        for lo, hi, data, offsets in T.text_slices(batch.column(1)):
            element, bounds, _ = shingles(data, offsets)
            for i in range(hi - lo):
                own = np.unique(element[bounds[i] : bounds[i + 1]]).tobytes()
                rows = meetings[lo + i].as_py()
                for a in range(0, len(rows), 512):
                    some = rows[a : a + 512]
                    columns = [pa.array([m[k] for m in some], t) for k, t in (("bucket", pa.int64()), ("low", pa.int32()), ("high", pa.int32()))]
                    yield pa.RecordBatch.from_arrays([*columns, batch.column(0).slice(lo + i, 1).take(pa.array([0] * len(some))), pa.array([m["root"] for m in some], pa.int64()), pa.array([own] * len(some), pa.binary())], names)


def _compare_blocks(threshold: float):
    """Rows in order of (bucket, low, high) -> the links that join groups of the documents that meet."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meeting, held = None, []
        for batch in batches:
            sets = batch.column(5)
            for i, (*now, doc, root) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True)):
                if now != meeting:
                    meeting, held, parent = now, [], {}
                mine = np.frombuffer(sets[i].as_buffer(), np.uint64).copy()
                src = []
                for other, x, group in held:
                    a, b = _root(parent, group), _root(parent, root)
                    if a != b and min(len(x), len(mine)) >= threshold * max(len(x), len(mine)) and jaccard(x, mine) >= threshold:
                        parent[max(a, b)] = min(a, b)
                        src.append(other)
                held.append((doc, mine, root))
                if src:
                    yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array([doc] * len(src), pa.int64())], ["a", "b"])

    return compare


def _root(parent: dict[int, int], x: int) -> int:
    while (p := parent.setdefault(x, x)) != x:
        parent[x] = x = parent.setdefault(p, p)
    return x


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, smallest node of its component) of the edges in the partition."""
    parent: dict[int, int] = {}
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = _root(parent, a), _root(parent, b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    if nodes:
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([_root(parent, x) for x in nodes], pa.int64())], ["node", "root"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each node's connected component. ``edges`` is a written table (a, b).

    Up to ``ONE_TASK_EDGES`` edges meet in one task's union-find (bounded memory). More are contracted
    by each partition's union-find, then by rounds of large-star and small-star (Kiveris et al., 2014).
    """
    if edges.count() <= ONE_TASK_EDGES:
        return edges.select("a", "b").coalesce(1).mapInArrow(_union_find, "node long, root long")
    return star_rounds(edges.select("a", "b").mapInArrow(_union_find, "node long, root long").where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))


def star_rounds(edges: DataFrame) -> DataFrame:
    e = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "stars")
    before = None
    while True:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        e = written(large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("s")).select("s.*").where("a <> b").distinct(), "stars")
        now = e.agg(F.count("*"), F.sum(F.col("b").cast("decimal(38,0)")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    signed = written(docs.mapInArrow(_sign, "doc_id long, h1 long, h2 long, bands array<long>"), "signatures")
    same = signed.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"), F.min_by("bands", "doc_id").alias("bands"))
    same = written(same, "distinct")
    copies = signed.select("doc_id", "h1", "h2").join(same.where("last <> rep").select("h1", "h2", "rep"), ["h1", "h2"]).where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    buckets = same.select("rep", F.explode("bands").alias("key")).groupBy("key").agg(F.sort_array(F.collect_set("rep")).alias("ids")).where(F.size("ids") > 1)
    buckets = written(buckets.select("ids").distinct(), "buckets")
    small = F.size("ids") <= ALL_PAIRS
    pairs = buckets.where(small).select(F.explode(F.flatten(F.transform("ids", lambda a: F.transform(F.filter("ids", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))).alias("p")).select("p.*")
    stars = buckets.where(~small).select(F.col("ids")[0].alias("a"), F.explode(F.slice("ids", 2, F.size("ids") - 1)).alias("b"))
    edges = written(verified(pairs.union(stars).distinct(), docs, threshold).union(copies), "edges")
    groups = components(edges)
    if (large := buckets.where(~small).withColumn("bucket", F.monotonically_increasing_id())).head(1):
        groups = written(groups, "groups")
        member = written(large.select("bucket", F.explode("ids").alias("node")).join(groups, "node", "left").withColumn("root", F.coalesce("root", "node")), "members")
        mixed = member.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("lo <> hi")
        meets = member.join(mixed, "bucket").withColumn("own", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
        meets = meets.select("node", "root", "bucket", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        meets = meets.groupBy(F.col("node").alias("doc_id")).agg(F.collect_list(F.struct("bucket", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "root")).alias("meetings"))
        meets = written(meets, "meetings")
        if meets.head(1):
            sets = docs.join(broadcast_if_small(meets, BROADCAST_BYTES), "doc_id").select("doc_id", "text", "meetings")
            sets = sets.mapInArrow(_blocked_sets, "bucket long, low int, high int, doc_id long, root long, elements binary")
            sets = sets.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high", "doc_id")
            groups = components(written(sets.mapInArrow(_compare_blocks(threshold), "a long, b long").union(edges), "edges"))
    return groups.select(F.col("node").alias("doc_id"), F.col("root").alias("group_id"), (F.col("node") == F.col("root")).alias("keep"))


def without_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, less all but the smallest doc_id of each group. Columns are unchanged."""
    gone = written(near_duplicates(docs, threshold).where("NOT keep").select(F.col("doc_id").alias("_gone")), "gone")
    gone = broadcast_if_small(gone, BROADCAST_BYTES)
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
