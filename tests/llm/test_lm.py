"""Against the automaton of the whole corpus, built from dictionaries and walked a word at a time."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from deepwell.llm import lm as L


class Whole:
    def __init__(self, texts):
        self.c = Counter()
        self.n = 0
        for t in texts:
            words = self.words(t)
            self.c.update((w,) for w in ["<s>", *words])
            self.c["<s>", "<s>"] += 1
            self.n += len(words)
            for i, w in enumerate(words):
                h = ("<s>", "<s>", *words)[i : i + 2]
                self.c[h[1], w] += 1
                self.c[(*h, w)] += 1

    @staticmethod
    def words(t):
        out = [re.sub(rb"[A-Z]", lambda m: m.group().lower(), w) for w in t.encode().split()]
        return [w.decode() for w in out] + ["</s>"]

    def p(self, h, w):
        k = L.STRENGTH[len(h)]
        if not h:
            return (self.c[w,] - 1 + k / L.OPEN) / (self.n - 1 + k)
        return (self.c[(*h, w)] - 1 + k * self.p(h[1:], w)) / (self.c[h] - 1 + k)

    def walk(self, t):
        """State by state: the sum of the weights of arcs and failure arcs."""
        state, total = ("<s>", "<s>"), 0.0
        for w in self.words(t):
            at = state
            while at and self.c[(*at, w)] < 2:
                total += math.log(L.STRENGTH[len(at)] / (self.c[at] - 1 + L.STRENGTH[len(at)]))
                at = at[1:]
            total += math.log(self.p(at, w))
            state = (state[1], w)
        return total


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


TEXTS = ["a rose is a rose is a rose", "A rose is red", "the end", "the end", "", "  ", "x", "ñandú ß a rose\tis\na", "z " * 500, "a rose is a rose is a rose"]


@pytest.mark.parametrize("sizes", [(L.PART_BYTES, L.BUCKET_KEYS), (20, 7)])
def test_scores_are_those_of_the_whole_automaton(spark, sizes):
    whole = Whole(TEXTS)
    got = {r.doc_id: r for r in L.score(frame(spark, TEXTS).repartition(3), *sizes).collect()}
    assert got.keys() == set(range(len(TEXTS)))
    for i, t in enumerate(TEXTS):
        assert got[i].tokens == len(whole.words(t))
        assert math.isclose(got[i].total_log_prob, whole.walk(t), rel_tol=1e-9)
        assert math.isclose(got[i].total_log_prob, sum(math.log(whole.p(("<s>", "<s>", *whole.words(t))[j : j + 2], w)) for j, w in enumerate(whole.words(t))), rel_tol=1e-9)
        assert math.isclose(got[i].log_prob * got[i].tokens, got[i].total_log_prob) and math.isclose(got[i].perplexity, math.exp(-got[i].log_prob))


def test_a_token_left_out_leaves_a_distribution():
    """Of the words that may stand where a token was taken away, probabilities sum to 1, what no text holds included."""
    whole = Whole(TEXTS)
    for t in TEXTS[:4]:
        words = ["<s>", "<s>", *whole.words(t)]
        for i in range(2, len(words)):
            less = Whole(TEXTS)
            h = tuple(words[i - 2 : i])
            for k in range(3):
                less.c[(*h[2 - k :], words[i])] -= 1
            less.n -= 1

            def p(h, w, down):
                k = L.STRENGTH[len(h)]
                if not h:
                    return (less.c[w,] + k / L.OPEN) / (less.n + k)
                return (less.c[(*h, w)] + k * p(h[1:], w, down)) / (less.c[h] - 1 + k)

            names = {w for g in less.c if len(g) == 1 for w in g} - {"<s>"}
            known = sum(p(h, w, None) for w in names)
            unknown = (L.OPEN - len(names)) * p(h, "never", None)
            assert math.isclose(known + unknown, 1, rel_tol=1e-9)
            assert math.isclose(p(h, words[i], None), whole.p(h, words[i]), rel_tol=1e-9)


def test_texts_that_occur_twice_score_apart(spark):
    r = np.random.default_rng(0)
    words = ["w%d" % i for i in range(400)]
    p = 1 / np.arange(1, 401)
    texts = [" ".join(r.choice(words, size=80, p=p / p.sum())) for _ in range(300)]
    rows = texts + texts[:30]
    got = {x.doc_id: x.log_prob for x in L.score(frame(spark, rows), 4000, 5000).collect()}
    twice = sorted([got[i] for i in range(30)])
    once = sorted([got[i] for i in range(30, 300)])
    assert twice[0] > once[-1]


def test_a_larger_corpus_keeps_every_count(spark):
    """The counts behind a text's score are those of the corpus, however large that is."""
    base = ["one two three four", "one two three five"]
    for times in (1, 50):
        rows = base + ["one two three four"] * times + ["other words here"] * times
        whole = Whole(rows)
        got = {r.doc_id: r.total_log_prob for r in L.score(frame(spark, rows).repartition(5), 64, 16).collect()}
        assert all(math.isclose(got[i], whole.walk(t), rel_tol=1e-9) for i, t in enumerate(rows))


def test_defined_cases(spark, none):
    assert L.score(none).collect() == []
    df = spark.createDataFrame([(1, None), (None, "a b"), (2, ""), (2, "")], "doc_id long, text string").withColumns({c: L.F.lit("x") for c in ("part", "tokens", "bucket", "sizes", "log_prob")})
    rows = L.score(df).collect()
    assert sorted((r.doc_id or 0, r.tokens, r.log_prob is None) for r in rows) == [(0, 3, False), (1, 0, True), (2, 1, False), (2, 1, False)]
    long = "word " * 300_000
    assert L.score(frame(spark, [long, "a"])).count() == 2
