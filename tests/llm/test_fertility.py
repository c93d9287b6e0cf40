import math
from collections import Counter

import numpy as np

from deepwell.llm import fertility as F
from deepwell.llm.tokens import vocabulary


def test_measures_are_those_of_the_tokens(docs, corpus):
    got = {r.doc_id: r for r in F.judge(docs).collect()}
    for i, t, lang, _ in corpus:
        r = got[i]
        if not t:
            assert r.reasons == ["no tokens"] and not r.keep and r.n_tokens is None
            continue
        for k, name in enumerate(F.VOCABULARIES):
            v = vocabulary(name)
            ids = list(v._encode(t) if v._encode else v._pieces.encode(t))
            n = Counter(ids)
            assert r.n_tokens[k] == len(ids), (i, name)
            assert math.isclose(r.chars_per_token[k], len(t) / len(ids))
            assert math.isclose(r.fallback_share[k], sum(c for x, c in n.items() if v.fallback[x]) / len(ids))
            assert math.isclose(r.entropy[k], -sum(c / len(ids) * math.log2(c / len(ids)) for c in n.values()), abs_tol=1e-9)


def test_odd_texts_leave_their_band(spark, corpus):
    rows = [(i, t, lang) for i, t, lang, _ in corpus if i < 120] + [(900, "9f8a7b6c5d" * 90, "aa"), (901, "z" * 900, "aa")]
    got = {r.doc_id: r for r in F.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert not got[900].keep and not got[901].keep and got[901].reasons
    assert sum(got[i].keep for i in range(120)) == 120


def test_scripts_and_entropy():
    texts = ["abc", "привет", "漢字", "123", "aб"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    at = np.cumsum([0] + [len(t.encode()) for t in texts])
    assert F.scripts(data, at) == ["Latin", "Cyrillic", "CJK", "none", "Latin"]
    assert F.entropies(np.array([1, 1, 2, 2, 5]), np.array([0, 4, 4, 5])).tolist() == [1.0, 0.0, 0.0]


def test_defined_cases(spark, none, crowded):
    assert F.judge(none).collect() == []
    assert F.judge(crowded).count() == crowded.count()
    rows = spark.createDataFrame([(1, None, None), (1, None, None), (2, "good text here", None)], "doc_id long, text string, lang string")
    assert sorted((r.doc_id, r.band, r.keep) for r in F.judge(rows).collect()) == [(1, "none", False), (1, "none", False), (2, "Latin", True)]
