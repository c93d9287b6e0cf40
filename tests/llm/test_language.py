import numpy as np
import pytest

from deepwell.llm import language as L

from .conftest import rows_of


def test_held_out_texts_get_their_language(docs):
    got = {r.doc_id: r for r in L.identify(docs.where("doc_id >= 40 OR doc_id IS NULL"), L.train(docs.where("doc_id < 40"))).collect()}
    own = [r for i, r in got.items() if 40 <= i < 120]
    assert len(own) == 80 and all(r.language == ("aa" if r.doc_id % 2 else "bb") and r.keep for r in own)
    for i in (300, 301, 302, 303):  # null, empty, blank, too short
        assert got[i].language is None and not got[i].keep and got[i].score == 0


def test_masks_equal_one_filter_per_language():
    r = np.random.default_rng(0)
    by = {n: r.integers(0, 1 << 63, 500).astype(np.uint64) for n in "abc"}
    f = L.Filters(by, bits=12)
    asked = np.concatenate([*by.values(), r.integers(0, 1 << 63, 3000).astype(np.uint64)])
    for bit, name in enumerate(f.languages):
        slots = {p for i in range(L.HASHES) for p in L.positions(by[name], i, 12).tolist()}
        want = [all(int(L.positions(np.array([h]), i, 12)[0]) in slots for i in range(L.HASHES)) for h in asked]
        assert ((f.masks(asked) >> bit & 1) == want).all()
    wrong = (f.masks(asked[1500:])[:, None] >> np.arange(3) & 1).mean(0)
    assert np.abs(wrong - f.rates).max() < 0.05  # the correction's rate is the one that is met


def test_ties_are_undetermined_and_too_many_languages_fail(spark):
    rows = spark.createDataFrame([(1, "abcdefgh ijkl", "x"), (2, "abcdefgh ijkl", "y"), (3, "abcdefgh ijkl", "x"), (4, "abcdefgh ijkl", "y")], "doc_id long, text string, lang string")
    assert all(r.language is None and r.margin == 0 for r in L.identify(rows).collect())
    with pytest.raises(ValueError):
        L.Filters({str(i): np.zeros(1, np.uint64) for i in range(65)})


def test_empty_table_no_labels_and_clashing_columns(spark, none, crowded):
    assert L.identify(none).collect() == []
    bare = spark.createDataFrame([(1, "some text here", None)], "doc_id long, text string, lang string")
    assert [r.language for r in L.identify(bare).collect()] == [None]
    kept = L.in_a_language(crowded)
    assert kept.columns == crowded.columns
    assert rows_of(kept, "doc_id") == rows_of(L.identify(crowded).where("keep"), "doc_id")
