"""Repeated passages: a distributed suffix array, sorted deep-shallow, over word-aligned suffixes.

``repeated_passages(docs)`` returns the maximal spans of text that are covered by windows of
``WINDOW`` consecutive words found at two or more places of the corpus (in one document or in two):

    doc_id BIGINT, start BIGINT, stop BIGINT (offsets in the text's UTF-8 bytes), words BIGINT

A word is a run of bytes other than ASCII white space; windows are equal when their words are, byte
for byte, whatever white space separates them. The union of a document's repeated windows is cut
into maximal runs; every occurrence is reported, the first one too.

How it scales. Winnowing picks in each window the smallest hash of its ``ANCHOR``-word grams, so equal
windows pick the same gram. Grams are counted over the whole corpus, and a Bloom filter of those that occur twice, of
``FILTER_BITS`` at most, goes to every task: each occurrence of such a gram ships the words of the windows that chose it to
the partition of its gram, with their place in the text. (A gram that passes the filter by chance meets no other and is
dropped; a fuller filter ships more and loses nothing.) There, equal stretches of text are one string with a count; the
suffixes that start in strings of one gram are sorted by multikey quicksort to ``SHALLOW`` bytes, and groups that still tie are
ordered by a blind trie on their remaining bytes. Suffixes are repeated when a neighbour in suffix order shares
``WINDOW`` words. Nothing is sampled or capped: the anchors are complete for windows of ``WINDOW`` words.

A gram of more than ``CROWD`` occurrences (a license line in every document) is split: parts of about as many are sorted each
by itself, and each part sends every different window of its own once to a second sort, by ranges of the windows' hashes,
which finds those of two parts. A window thus comes there once for each part, however often it occurs.

Defined cases: null, empty or shorter texts have no window; rows without a doc_id are left out; a row
that stands twice in the table is found at two places; rows that share a doc_id but not a text are
told apart by an MD5 of both; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T
from .store import broadcast_if_small, written

WINDOW = 50
ANCHOR = 10
SHALLOW = 32
STEP = 4
FEW = 12
CROWD = 2048
FILTER_BITS = 1 << 27
FILTER_HASHES = 3


_SPACE = re.compile(b" ")


# --- deep-shallow sorting -------------------------------------------------------------------------


def deep_shallow(texts: list[bytes], shallow: int = SHALLOW) -> tuple[list[int], list[int]]:
    """Indices of ``texts`` in byte order (ties by index), and the common prefix with the one before.

    Multikey quicksort partitions on ``STEP`` bytes at a time, down to depth ``shallow``; each group that is
    equal so far goes to a blind trie. Groups of at most ``FEW`` are put in order at once, as quicksorts do.
    """
    order: list[int] = []
    stack: list[tuple[list[int], int]] = [(list(range(len(texts))), 0)]
    while stack:
        group, depth = stack.pop()
        if len(group) <= FEW:
            group.sort(key=texts.__getitem__)
            order += group
        elif depth >= shallow:
            trie = BlindTrie(texts)
            for i in group:
                trie.insert(i)
            order += [i for i, _ in trie.walk()]
        else:
            end = depth + STEP
            keys = [texts[i][depth:end] for i in group]
            pivot = sorted((keys[0], keys[len(keys) // 2], keys[-1]))[1]
            less = [i for i, k in zip(group, keys, strict=True) if k < pivot]
            same = [i for i, k in zip(group, keys, strict=True) if k == pivot]
            more = [i for i, k in zip(group, keys, strict=True) if k > pivot] if len(less) + len(same) < len(group) else []
            if len(pivot) < STEP:  # ended: equal strings, in index order
                if less:
                    stack += [(more, depth)] * bool(more)
                    stack += [(same[i : i + FEW], depth) for i in reversed(range(0, len(same), FEW))]
                    stack.append((less, depth))
                else:
                    order += same
                    stack += [(more, depth)] * bool(more)
            else:
                stack += [(g, d) for g, d in ((more, depth), (same, end), (less, depth)) if g]
    return order, [0, *(shared_prefix(texts[a], texts[b]) for a, b in zip(order, order[1:]))][: len(order)]


class BlindTrie:
    """A compacted trie that keeps branching depths and bytes only; a leaf's text settles the rest."""

    def __init__(self, texts: list[bytes]):
        self.texts = texts
        self.root: list | None = None  # a leaf: [ids]; a node: [depth, {byte or -1: child}]

    @staticmethod
    def _leaf(node: list) -> bool:
        return len(node) == 1

    def insert(self, i: int) -> None:
        text = self.texts[i]
        if self.root is None:
            self.root = [[i]]
            return
        node, path = self.root, []
        while not self._leaf(node):  # down by the branching bytes alone
            path.append(node)
            children = node[1]
            byte = text[node[0]] if node[0] < len(text) else -1
            node = children.get(byte) or next(iter(children.values()))
        other = self.texts[node[0][0]]
        depth = shared_prefix(text, other)
        if depth == len(text) == len(other):
            node[0].append(i)
            return
        above, here = None, self.root  # up again, to where the first difference belongs
        for n in path:
            if n[0] >= depth:
                here = n
                break
            above = n
            byte = text[n[0]] if n[0] < len(text) else -1
            here = n[1].get(byte)
            if here is None:
                break
        mine = text[depth] if depth < len(text) else -1
        if here is not None and not self._leaf(here) and here[0] == depth:
            here[1][mine] = [[i]]
            return
        if here is None:
            above[1][text[above[0]] if above[0] < len(text) else -1] = [[i]]
            return
        theirs = other[depth] if depth < len(other) else -1
        split = [depth, {mine: [[i]], theirs: here}]
        if above is None:
            self.root = split
        else:
            above[1][text[above[0]] if above[0] < len(text) else -1] = split

    def walk(self) -> Iterator[tuple[int, int]]:
        """(index, prefix shared with the one before, -1 for the first) in order."""
        shared, stack = -1, [(self.root, -1)]
        while stack:
            node, upon = stack.pop()
            if self._leaf(node):
                for n, i in enumerate(node[0]):
                    yield i, upon if n == 0 else len(self.texts[i])
                continue
            for n, byte in reversed(list(enumerate(sorted(node[1])))):
                stack.append((node[1][byte], upon if n == 0 else node[0]))
        return shared


def shared_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, step = 0, 16
    while a[lo : lo + step] == b[lo : lo + step]:
        lo += step
        step *= 2
    while step > 1:
        step //= 2
        if a[lo : lo + step] == b[lo : lo + step]:
            lo += step
    return lo


# --- anchors --------------------------------------------------------------------------------------


def sliding_argmin(h: np.ndarray, width: int) -> np.ndarray:
    """For each i, the leftmost place of the smallest of h[i : i + width]."""
    at = np.arange(len(h))
    span = 1
    while span * 2 <= width:
        a, b = at[: len(at) - span], at[span:]
        at = np.where(h[b] < h[a], b, a)
        span *= 2
    if width > span:
        n, gap = len(h) - width + 1, width - span
        a, b = at[:n], at[gap : gap + n]
        at = np.where(h[b] < h[a], b, a)
    return at


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each run of windows with one anchor: row, gram hash, first and last window (words of the slice), and the words' starts and ends."""
    starts, ends, at = T.words(data, offsets)
    word = T.span_hashes(T.prefix_hash(data), starts, ends)
    width = WINDOW - ANCHOR + 1
    if len(word) < WINDOW:
        z = np.zeros(0, np.int64)
        return z, z.astype(np.uint64), z, z, starts, ends, at
    gram = T.shingle_hashes(word, ANCHOR)
    place = sliding_argmin(gram, width)  # one for each window, also those across rows
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(at))
    inside = row[: len(place)] == row[WINDOW - 1 : WINDOW - 1 + len(place)]
    window = np.flatnonzero(inside)
    if not len(window):
        z = np.zeros(0, np.int64)
        return z, z.astype(np.uint64), z, z, starts, ends, at
    chosen = place[window]
    new = np.flatnonzero(np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (window[1:] != window[:-1] + 1) | (row[window[1:]] != row[window[:-1]])]))
    first = window[new]
    last = window[np.concatenate([new[1:] - 1, [len(window) - 1]])]
    return row[first], gram[chosen[new]], first, last, starts, ends, at


def _anchor_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, times) of the anchors of some texts."""
    for batch in batches:
        for _, _, data, offsets in T.text_slices(batch.column(0)):
            gram, n = np.unique(anchors(data, offsets)[1], return_counts=True)
            if len(gram):
                yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(n)], ["gram", "n"])


def _positions(gram: np.ndarray, bits: int) -> np.ndarray:
    """The filter's bits of each gram."""
    salts = np.arange(1, FILTER_HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (T.mix(gram[:, None] ^ salts) & np.uint64(bits - 1)).astype(np.int64)


def _filter_words(bits: int):
    """Grams -> (number of a filter's 64-bit word, the word)."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _positions(batch.column(0).to_numpy().view(np.uint64), bits).reshape(-1)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array((np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64))], ["at", "word"])

    return words


def _filter(grams: DataFrame) -> np.ndarray:
    """A Bloom filter of a written table's grams: at most FILTER_BITS, so many bytes / 8 at the driver and in each worker."""
    bits = 1 << 10
    n = grams.count()
    while bits < min(FILTER_BITS, 16 * n):
        bits *= 2
    rows = grams.select("gram").mapInArrow(_filter_words(bits), "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
    out = np.zeros(bits >> 6, np.uint64)
    out[rows["at"].to_numpy()] = rows["word"].to_numpy().view(np.uint64)
    return out


def passes(table: np.ndarray, gram: np.ndarray) -> np.ndarray:
    at = _positions(gram, len(table) << 6)
    return ((table[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).all(1)


def _chunks(shared):
    """(key, doc_id, text) -> the windows of each anchor whose gram passes the filter.

    ``chunk`` is the words from the first window's start to the last window's end, one space between
    them; ``word`` is the first window's number in the document, ``windows`` how many there are, ``start`` the byte at which
    the first begins, and ``starts`` those of all words where they aren't one space apart.
    """

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            keys, ids = batch.column(0), batch.column(1)
            for lo, _, data, offsets in T.text_slices(batch.column(2)):
                row, gram, first, last, starts, ends, at = anchors(data, offsets)
                keep = np.flatnonzero(passes(table, gram)) if len(row) else row
                if not len(keep):
                    continue
                row, gram, first, last = row[keep], gram[keep], first[keep], last[keep]
                begin, until = starts[first] - offsets[row], last + WINDOW
                wide = np.concatenate([[0], np.cumsum(np.concatenate([starts[1:] - ends[:-1] != 1, [False]]))])
                even = wide[until - 1] == wide[first]
                odd = np.concatenate([[0], np.cumsum(T.WHITE[data] & (data != 32))])
                raw = data.tobytes()
                text, places = [], []
                for a, b, o, plain in zip(first.tolist(), until.tolist(), offsets[row].tolist(), even.tolist(), strict=True):
                    s, e = int(starts[a]), int(ends[b - 1])
                    text.append(raw[s:e] if plain and odd[s] == odd[e] else b" ".join(raw[s:e].split()))
                    places.append(b"" if plain else (starts[a:b] - o).astype("<i8").tobytes())
                take = pa.array(lo + row)
                yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), keys.take(take), ids.take(take), pa.array(first - at[row]), pa.array((last - first + 1).astype(np.int32)), pa.array(begin), pa.array(places, pa.binary()), pa.array(text, pa.binary())], ["gram", "key", "doc_id", "word", "windows", "start", "starts", "chunk"])

    return chunks


# --- the sorted groups ----------------------------------------------------------------------------


def repeated_windows(chunks: list[bytes], windows: list[int]) -> list[list[bool]]:
    """For each chunk, which of its windows is found again, at another place in these chunks.

    Suffix j of a chunk starts at its j-th word; a neighbour in suffix order with ``WINDOW`` whole
    words in common makes both repeated. Equal chunks have all their windows repeated.
    """
    distinct: dict[bytes, list[int]] = {}
    for i, c in enumerate(chunks):
        distinct.setdefault(c, []).append(i)
    out = [[False] * w for w in windows]
    single = [(c, own) for c, own in distinct.items()]
    if len(single) > 1:
        suffixes, where, need = [], [], []
        for n, (c, own) in enumerate(single):
            spaces = [-1, *(m.start() for m in _SPACE.finditer(c)), len(c)]
            for j in range(windows[own[0]]):
                suffixes.append(c[spaces[j] + 1 :])
                where.append((n, j))
                need.append(spaces[j + WINDOW] - spaces[j] - 1)
        found = [False] * len(suffixes)
        order, common = deep_shallow(suffixes)
        for k in range(1, len(order)):
            a, b, shared = order[k - 1], order[k], common[k]
            # WINDOW words are shared when the window's bytes are and the word ends there in both
            if shared >= need[a] and _ends(suffixes[b], need[a]) or shared >= need[b] and _ends(suffixes[a], need[b]):
                found[a] = found[b] = True
        for s, (n, j) in enumerate(where):
            if found[s]:
                for i in single[n][1]:
                    out[i][j] = True
    for _, own in single:
        if len(own) > 1:
            for i in own:
                out[i] = [True] * windows[i]
    return out


def _ends(text: bytes, at: int) -> bool:
    return len(text) == at or len(text) > at and text[at] == 32


FOUND = "key binary, doc_id long, word long, until long, start long, stop long, gram long, sub int, window binary"


class _Found:
    """Runs of windows, and windows of split grams, as they go on."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []

    def ready(self) -> pa.RecordBatch:
        kinds = (pa.binary(), *[pa.int64()] * 6, pa.int32(), pa.binary())
        columns = zip(*self.rows, strict=True)
        names = [part.split()[0] for part in FOUND.split(", ")]
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
        self.rows = []
        return batch


def _place(row: tuple, spaces: list[int], j: int, k: int) -> tuple[int, int]:
    """Bytes of the text from the start of the chunk's word j to the end of its word k."""
    _, _, _, _, start, starts, chunk = row
    size = spaces[k + 1] - spaces[k] - 1
    if not starts:
        return start + spaces[j] + 1, start + spaces[k + 1]
    at = np.frombuffer(starts, "<i8")
    return int(at[j]), int(at[k]) + size


def _group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks in order of (gram, part) -> runs of repeated windows; of a split gram's part, its different windows too."""
    out = _Found()
    held: list[tuple] = []
    gram, part, parts = None, None, 1

    def close() -> None:
        if len(held) < 2 and parts == 1:
            return
        flags = repeated_windows([h[6] for h in held], [h[3] for h in held])
        seen: set[bytes] = set()
        for row, flag in zip(held, flags, strict=True):
            key, doc, word, _, _, _, chunk = row
            if not any(flag) and parts == 1:
                continue
            spaces = [-1, *(m.start() for m in _SPACE.finditer(chunk)), len(chunk)]
            j = 0
            while j < len(flag):
                if flag[j]:
                    k = j
                    while k + 1 < len(flag) and flag[k + 1]:
                        k += 1
                    out.rows.append((key, doc, word + j, word + k + WINDOW, *_place(row, spaces, j, k + WINDOW - 1), None, None, None))
                    j = k
                j += 1
            if parts > 1:
                for j, repeated in enumerate(flag):
                    window = chunk[spaces[j] + 1 : spaces[j + WINDOW]]
                    if repeated and window in seen:
                        continue
                    seen.add(window)
                    place = (None,) * 6 if repeated else (key, doc, word + j, word + j + WINDOW, *_place(row, spaces, j, j + WINDOW - 1))
                    out.rows.append((*place, gram, zlib.crc32(window) % parts, window))

    for batch in batches:
        for g, p, n, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (g, p) != (gram, part):
                if held:
                    close()
                held, gram, part, parts = [], g, p, n
            held.append(tuple(row))
            if len(out.rows) > 10000:
                yield out.ready()
    if held:
        close()
    if out.rows:
        yield out.ready()


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of split grams in order of (gram, range) -> those that two parts have, as runs."""
    out = _Found()
    held: list[tuple] = []
    group = None

    def close() -> None:
        texts = [row[-1] for row in held]
        order, common = deep_shallow(texts)
        twice = [False] * len(texts)
        for k in range(1, len(order)):
            a, b = order[k - 1], order[k]
            if common[k] == len(texts[a]) == len(texts[b]):
                twice[a] = twice[b] = True
        out.rows.extend((*row[:6], None, None, None) for row, found in zip(held, twice, strict=True) if found and row[0] is not None)

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[6:8] != group:
                if held:
                    close()
                held, group = [], row[6:8]
            held.append(row)
            if len(out.rows) > 10000:
                yield out.ready()
    if held:
        close()
    if out.rows:
        yield out.ready()


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, runs) -> byte spans of the union of each row's runs of words."""
    for batch in batches:
        out: list[tuple] = []
        for doc, runs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            merged: list[list[int]] = []
            for word, until, start, stop in sorted((r["word"], r["until"], r["start"], r["stop"]) for r in runs):
                if merged and word <= merged[-1][1]:
                    if until > merged[-1][1]:
                        merged[-1][1], merged[-1][3] = until, stop
                else:
                    merged.append([word, until, start, stop])
            out += [(doc, start, stop, until - word) for word, until, start, stop in merged]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["doc_id", "start", "stop", "words"])


def repeated_passages(docs: DataFrame) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    counts = docs.select("text").mapInArrow(_anchor_counts, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).where("n > 1")
    counts = written(counts, "grams")
    table = docs.sparkSession.sparkContext.broadcast(_filter(counts))
    key = F.unhex(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(" "), "text").cast("binary"))).alias("key")
    chunks = docs.select(key, "doc_id", "text").mapInArrow(_chunks(table), "gram long, key binary, doc_id long, word long, windows int, start long, starts binary, chunk binary")
    crowds = counts.where(F.col("n") > CROWD).select(F.col("gram").alias("_gram"), F.ceil(F.col("n") / CROWD).cast("int").alias("parts"))
    chunks = chunks.join(broadcast_if_small(written(crowds, "crowds")), F.col("gram") == F.col("_gram"), "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    chunks = chunks.withColumn("part", F.pmod(F.xxhash64("key", "word"), F.col("parts")).cast("int"))
    chunks = chunks.repartition("gram", "part").sortWithinPartitions("gram", "part", "key", "word")
    found = written(chunks.select("gram", "part", "parts", "key", "doc_id", "word", "windows", "start", "starts", "chunk").mapInArrow(_group, FOUND), "found")
    across = found.where("window IS NOT NULL").repartition("gram", "sub").sortWithinPartitions("gram", "sub").mapInArrow(_across, FOUND)
    runs = found.where("window IS NULL").union(across).groupBy("key", "doc_id").agg(F.collect_set(F.struct("word", "until", "start", "stop")).alias("runs"))
    return runs.select("doc_id", "runs").mapInArrow(_spans, "doc_id long, start long, stop long, words long").distinct()
