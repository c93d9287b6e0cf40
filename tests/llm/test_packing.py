import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from deepwell.llm import packing as P
from deepwell.llm.tokens import unpack_ids, vocabulary

CAPACITY = (32, 4, 512)


def brute(lengths, rule):
    """Best fit by the definition, over all bins ever opened."""
    full, w = np.array(CAPACITY, float), np.array(P.WEIGHTS)
    bins, left = [], []
    for i, n in enumerate(lengths):
        need = np.array([n, 1, n * n])
        best, at = None, None
        for b, rest in enumerate(left):
            if (rest >= need).all():
                v = float((rest / full) @ (w * (need / full))) if rule == "dot" else -float(((rest / full - need / full) ** 2) @ w)
                if best is None or v > best:
                    best, at = v, b
        if at is None:
            bins.append([i])
            left.append(np.array(CAPACITY) - need)
        else:
            bins[at].append(i)
            left[at] = left[at] - need
    return bins


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 22), max_size=60), st.sampled_from(["dot", "norm"]))
def test_bins_are_those_of_the_definition(lengths, rule):
    lengths = sorted(lengths, reverse=True)
    assert P.best_fit(np.array(lengths, np.int64), CAPACITY, rule=rule) == brute(lengths, rule)


@pytest.mark.parametrize("rule", ["dot", "norm"])
def test_every_token_is_in_one_bin_within_capacity(crowded, corpus, rule):
    v = vocabulary(P.VOCABULARY)
    limits = {"max_tokens": 512, "max_docs": 5, "max_attention": 512 * 400}
    parts = {}
    for r in P.pack(crowded, rule=rule, **limits).collect():
        assert r.n_tokens == sum(r.lengths) <= 512 and r.n_docs == len(r.doc_ids) <= 5 and r.attention == sum(n * n for n in r.lengths) <= 512 * 400
        ids = unpack_ids(r.tokens, v.n)
        ends = list(itertools.accumulate(r.lengths))
        for doc, start, n, b in zip(r.doc_ids, r.starts, r.lengths, ends):
            parts.setdefault(doc, {})[start] = ids[b - n : b].tolist()
    whole = {d: [i for s in sorted(p) for i in p[s]] for d, p in parts.items()}
    assert whole == {i: v._encode(t) for i, t, *_ in corpus if t}


def test_defined_cases(spark, none):
    assert P.pack(none).collect() == []
    rows = spark.createDataFrame([(None, "one two"), (None, "one two"), (1, None), (2, "")], "doc_id long, text string")
    got = P.pack(rows).collect()
    assert [r.doc_ids for r in got] == [[None, None]]
    with pytest.raises(ValueError):
        P.pack(rows, rule="first")


def test_groups_of_identical_rows_and_long_texts_are_bounded(spark, monkeypatch):
    """A third of all rows are one row, or tokens are many: groups close and go on, no token is lost, bins have names of their own."""
    monkeypatch.setattr(P, "GROUP", 8)
    monkeypatch.setattr(P, "GROUP_BYTES", 4000)
    rows = [(None, "one two three")] * 100 + [(i, f"text {i} " * (1 + i % 300)) for i in range(200)]
    got = P.pack(spark.createDataFrame(rows, "doc_id long, text string"), max_tokens=256, rule="norm").collect()
    v = vocabulary(P.VOCABULARY)
    assert len({r.bin for r in got}) == len(got)
    assert sum(d is None for r in got for d in r.doc_ids) == 100
    assert sum(r.n_tokens for r in got) == sum(len(v._encode(t)) for _, t in rows)


def test_documents_longer_than_a_bin_with_ties_under_norm(spark):
    v = vocabulary(P.VOCABULARY)
    rows = [(i, "word " * 150) for i in range(6)]
    got = P.pack(spark.createDataFrame(rows, "doc_id long, text string"), max_tokens=64, max_docs=3, rule="norm").collect()
    n = len(v._encode(rows[0][1]))
    pieces = sorted((-m, i, start) for i in range(6) for start, m in zip(range(0, n, 64), P.piece_lengths(n, 64, P.MAX_ATTENTION)))
    bins = P.best_fit(np.array([-p[0] for p in pieces]), (64, 3, P.MAX_ATTENTION), rule="norm")
    want = sorted([(pieces[i][1], pieces[i][2], -pieces[i][0]) for i in b] for b in bins)
    assert sorted(list(zip(r.doc_ids, r.starts, r.lengths)) for r in got) == want
