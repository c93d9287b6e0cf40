"""SuperMinHash near-dedup against all pairs."""

import itertools
import random
import time

import numpy as np

from deepwell.llm import superminhash as S

from .conftest import rows_of


def shingle_set(text):
    w = [x.decode() for x in text.encode().lower().split()]
    if not w:
        return None
    return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))}


def brute(rows, threshold=S.THRESHOLD):
    sets = {}
    for i, t, *_ in rows:
        if t is not None and i is not None and (s := shingle_set(t)):
            sets[i] = s
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    groups = {}
    for i in sets:
        groups.setdefault(find(i), []).append(i)
    return sorted((i, g, i == g) for g, own in groups.items() if len(own) > 1 for i in own)


def test_groups_are_those_of_all_pairs(docs, corpus):
    assert sorted(map(tuple, S.near_duplicates(docs).collect())) == brute(corpus)


def test_every_branch_gives_the_same_groups(spark, corpus, docs, monkeypatch):
    """Hubs and blocks from two documents a bucket on, star rounds, and joins that shuffle."""
    r = random.Random(8)
    words = [f"v{i}" for i in range(40)]
    chain = [" ".join(words)]
    for i in range(14):  # neighbours are near, the ends aren't
        own = chain[-1].split()
        for _ in range(3):
            own[r.randrange(40)] = f"y{i}_{r.randrange(99)}"
        chain.append(" ".join(own))
    rows = [(1000 + i, t, "aa", "s0", len(t)) for i, t in enumerate(chain)]
    both = docs.union(spark.createDataFrame(rows, docs.schema))
    want = brute([*corpus, *((i, t) for i, t, *_ in rows)])
    usual = sorted(map(tuple, S.near_duplicates(both).collect()))
    for name, value in (("ALL_PAIRS", 1), ("BLOCK", 2), ("ONE_TASK_EDGES", 0), ("BROADCAST_BYTES", -1)):
        monkeypatch.setattr(S, name, value)
    got = sorted(map(tuple, S.near_duplicates(both).collect()))
    assert got == usual and {x for x in usual if x[0] < 1000} == {x for x in want if x[0] < 1000}


def test_unlike_documents_of_one_bucket_meet_in_blocks(spark, monkeypatch):
    """All documents in one bucket: the pairs compared are those of all, whatever the hub is like."""
    monkeypatch.setattr(S, "BLOCK", 3)
    monkeypatch.setattr(S, "bands", lambda sig, rows=4: np.ones((len(sig), 1), np.uint64))
    monkeypatch.setattr(S, "_sign", _one_bucket)
    r = random.Random(3)
    rows = [(i, " ".join(r.choice("abcdefghijklmnopqrst") for _ in range(30))) for i in range(40)]
    rows += [(100 + i, t + " z") for i, t in rows[5:12]]
    got = sorted(map(tuple, S.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == brute(rows) and len(got) == 14


def _one_bucket(batches):
    for batch in batches:
        for lo, hi, data, offsets in S.T.text_slices(batch.column(1)):
            element, bounds, word = S.shingles(data, offsets)
            a, b = S._digests(word, element, bounds)
            yield S.pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), S.pa.array(a.view(np.int64)), S.pa.array(b.view(np.int64)), S.pa.array([[1]] * (hi - lo), S.pa.list_(S.pa.int64()))], ["doc_id", "h1", "h2", "bands"])


def test_a_repetitive_text_costs_its_distinct_shingles():
    """Two megabytes of a line, over and over: under 2 s (20 s when each repetition was an element)."""
    data = np.frombuffer(b"the same old line again\n" * 87_000, np.uint8)
    began = time.perf_counter()
    element, bounds, _ = S.shingles(data, np.array([0, len(data)]))
    sig = S.signatures(element, bounds)
    assert time.perf_counter() - began < 2
    few = np.unique(element)
    assert (sig == S.signatures(few, np.array([0, len(few)]))).all()


def test_one_of_each_group_stays_and_columns_are_unchanged(crowded, corpus):
    kept = S.without_near_duplicates(crowded)
    assert kept.columns == crowded.columns
    gone = {i for i, _, keep in brute(corpus) if not keep}
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in corpus} - gone


def test_nulls_repeated_rows_and_empty_tables(spark, none):
    assert S.near_duplicates(none).collect() == []
    rows = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (2, None), (3, "one two"), (4, "one two"), (5, "")], "doc_id long, text string")
    assert rows_of(S.near_duplicates(rows), "doc_id", "group_id", "keep") == [(3, 3, True), (4, 3, False)]


def test_a_crowd_beyond_all_pairs_is_one_group(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base[:59] + [f"x{i}"])) for i in range(40)]
    got = S.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.group_id) for r in got} == {(i, 0) for i in range(40)}


def test_signatures_estimate_similarity_and_ignore_repetition():
    r = np.random.default_rng(0)
    a = r.integers(0, 1 << 63, 400).astype(np.uint64)
    b = np.concatenate([a[:200], r.integers(0, 1 << 63, 200).astype(np.uint64)])
    sig = S.signatures(np.concatenate([a, b, a, a]), np.array([0, 400, 800, 1600]))
    assert (sig[0] == sig[2]).all()
    assert abs((sig[0] == sig[1]).mean() - 1 / 3) < 0.12


def test_star_rounds_equal_union_find(spark):
    r = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in r.integers(0, 60, (45, 2)) if a != b]
    df = spark.createDataFrame(edges, "a long, b long")
    want = {(x.node, x.root) for x in S.components(df).collect()}
    assert {(x.node, x.root) for x in S.star_rounds(df).collect()} == want
