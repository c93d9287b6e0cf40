"""Repeated passages against a dictionary of all windows."""

import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from deepwell.llm import suffixes as P


def brute(rows):
    seen = Counter()
    cut = []
    for i, t in rows:
        if i is None or t is None:
            continue
        raw = t.encode()
        spans, at = [], 0
        for w in raw.split():
            at = raw.index(w, at)
            spans.append((at, at + len(w)))
            at += len(w)
        words = [raw[a:b] for a, b in spans]
        windows = [tuple(words[j : j + P.WINDOW]) for j in range(len(words) - P.WINDOW + 1)]
        seen.update(windows)
        cut.append((i, spans, windows))
    out = set()
    for i, spans, windows in cut:
        covered = set()
        for j, w in enumerate(windows):
            if seen[w] > 1:
                covered.update(range(j, j + P.WINDOW))
        start = None
        for j in range(len(spans) + 1):
            if j in covered and start is None:
                start = j
            elif j not in covered and start is not None:
                out.add((i, spans[start][0], spans[j - 1][1], j - start))
                start = None
    return sorted(out)


def test_spans_are_those_of_all_windows(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdé") for _ in range(r.randint(2, 6)))
    shared = [" ".join(word() for _ in range(n)) for n in (49, 50, 51, 120)]
    rows = []
    for i in range(30):
        parts = [" ".join(word() for _ in range(r.randint(5, 80))), shared[i % 4] if i < 16 else "", " ".join(word() for _ in range(r.randint(5, 80)))]
        rows.append((i, r.choice([" ", "\n", "  "]).join(parts)))
    rows += [(50, ("again and " * 200).strip()), (51, rows[0][1]), (51, rows[0][1]), (52, None), (53, ""), (54, "short"), (None, rows[0][1])]
    got = P.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect())) == brute(rows)


@pytest.mark.parametrize("bits", [P.FILTER_BITS, 64])
def test_a_line_in_every_document(spark, monkeypatch, bits):
    """Split grams, some copies of which are in one part and some in two, under a filter with room and a full one."""
    monkeypatch.setattr(P, "CROWD", 4)
    monkeypatch.setattr(P, "FILTER_BITS", bits)
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(r.randint(2, 6)))
    line = " ".join(word() for _ in range(70))
    rows = [(i, " ".join(word() for _ in range(r.randint(0, 60))) + r.choice([" ", "\t", "\x0b", "\n\n "]) + line.replace(" ", r.choice([" ", "\x0c", "  "]), 3) + " " + " ".join(word() for _ in range(r.randint(0, 60)))) for i in range(60)]
    rows += [(100 + i, rows[i][1] if i % 2 else rows[i][1] + " end") for i in range(9)]
    want = brute(rows)
    assert sorted(map(tuple, P.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect())) == want
    assert {i for i, *_ in want} >= set(range(60))


def test_the_filter_misses_no_gram(spark):
    grams = np.random.default_rng(0).integers(-(1 << 62), 1 << 62, 5000)
    table = P._filter(spark.createDataFrame([(int(g),) for g in grams], "gram long"))
    assert P.passes(table, grams.view(np.uint64)).all()
    others = np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 20_000)
    assert P.passes(table, others.view(np.uint64)).mean() < 0.02


def test_corpus_and_empty_table(docs, corpus, none, crowded):
    want = brute([(i, t) for i, t, *_ in corpus])
    assert want and sorted(map(tuple, P.repeated_passages(crowded).collect())) == want
    assert P.repeated_passages(none).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.sampled_from([1, 12]), st.lists(st.text("ab\x00", max_size=12).map(str.encode) | st.text("ab", min_size=30, max_size=50).map(lambda s: (b"a" * 40) + s.encode()), min_size=1, max_size=14))
def test_deep_shallow_sorts_and_measures_prefixes(few, texts):
    P.FEW = few
    order, common = P.deep_shallow(texts, shallow=4)
    P.FEW = 12
    assert order == sorted(range(len(texts)), key=lambda i: (texts[i], i))
    for k in range(1, len(order)):
        a, b = texts[order[k - 1]], texts[order[k]]
        n = next((j for j, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert common[k] == n
