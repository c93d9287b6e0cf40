import math
import random

import numpy as np
import pytest

from deepwell.llm import toxicity as X


@pytest.fixture(scope="module")
def labelled():
    r = random.Random(11)
    plain = ["".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(3, 9))) for _ in range(600)]
    foul = ["".join(r.choice("gkxzvub") for _ in range(r.randint(5, 9))) for _ in range(12)]
    docs, labels = [], []
    for i in range(700):
        words = [r.choice(plain) for _ in range(r.randint(40, 200))]
        toxic = i % 7 == 0
        if toxic:
            for _ in range(6):
                words[r.randrange(len(words))] = r.choice(foul)
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return docs, labels


def test_held_out_documents(spark, labelled):
    docs, labels = labelled
    d, m = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    found = {r.doc_id for r in X.find_toxic(d.where("doc_id >= 450"), m, X.train(d.where("doc_id < 450"), m)).collect()}
    truth = {i for i, t in labels if t and i >= 450}
    assert len(found & truth) >= 0.9 * len(truth)
    assert len(found - truth) <= 3


def test_scores_do_not_depend_on_the_batch(spark, labelled):
    docs, labels = labelled
    d, m = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = X.train(d, m)
    one = {(r.doc_id, r.score) for r in X.find_toxic(d.repartition(1), m, model).collect()}
    assert one == {(r.doc_id, r.score) for r in X.find_toxic(d.repartition(7), m, model).collect()}


def test_defined_cases(spark, labelled):
    docs, labels = labelled
    d, m = spark.createDataFrame([*docs, (9000, None), (9001, ""), (9002, "word " * 50000)], "doc_id long, text string"), spark.createDataFrame([*labels, (1, None), (None, 1), (123456, 1)], "doc_id long, toxic int")
    found = {r.doc_id for r in X.find_toxic(d.withColumn("score", X.F.lit("x")), m).collect()}
    assert not found & {9000, 9001, 9002}
    assert X.find_toxic(d, m.where("toxic = 0")).collect() == []
    assert X.find_toxic(d.limit(0), m).collect() == [] and X.find_toxic(d, m.limit(0)).collect() == []


def test_phrases_of_ordinary_words(spark):
    """Toxic documents that hold no word of their own, but four phrases of words that ordinary ones have."""
    r = random.Random(4)
    plain = ["".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(4, 9))) for _ in range(300)]
    foul = [(r.choice(plain), r.choice(plain)) for _ in range(4)]
    docs, labels = [], []
    for i in range(800):
        words = [r.choice(plain) for _ in range(r.randint(60, 150))]
        if i % 4 == 0:
            for _ in range(8):
                at = r.randrange(len(words) - 1)
                words[at : at + 2] = r.choice(foul)
        docs.append((i, " ".join(words)))
        labels.append((i, int(i % 4 == 0)))
    d, m = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    found = {x.doc_id for x in X.find_toxic(d.where("doc_id >= 500"), m, X.train(d.where("doc_id < 500"), m)).collect()}
    truth = {i for i, t in labels if t and i >= 500}
    assert len(found & truth) >= 0.8 * len(truth) and len(found - truth) <= 5


def test_lengths_and_scores_by_definition(spark, labelled):
    """Windows cut by str.split, two compressors, and the score of each document from its gains, one at a time."""
    docs, labels = labelled
    docs = [*docs[:120], (5000, docs[0][1]), (5001, docs[0][1] + " " + docs[0][1]), docs[7], docs[7]]
    d, m = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = X.train(d, m)
    ordinary, toxic = X.compressor(model.ordinary + b"\0" * len(model.toxic)), X.compressor(model.ordinary + model.toxic)
    want = []
    for i, text in docs:
        words, best, seen, gains = text.lower().split(" "), 0.0, set(), []
        for a in range(0, len(words), X.WINDOW):
            own = " ".join(words[a : a + X.WINDOW])
            window = (" " if a else "") + own + (" " if a + X.WINDOW < len(words) else "")
            raw = model.ordinary[-X.LEAD :] + window.encode()
            gains.append((len(ordinary.compress(raw)) - len(toxic.compress(raw))) * (window not in seen))
            seen.add(window)
        for g, p in zip(X.GAINS, model.rates, strict=True):
            c, e = sum(x >= g for x in gains), len(gains) * p
            if c > e:
                best = max(best, c * math.log(c / e) - c + e)
        if best > model.threshold:
            want.append((i, round(best, 9)))
    got = sorted((r.doc_id, round(r.score, 9)) for r in X.find_toxic(d, m, model).collect())
    assert got == sorted(want) and sum(i == 7 for i, _ in got) in (0, 3) and got


def test_contradicting_labels_and_ties(spark, labelled):
    docs, labels = labelled
    d = spark.createDataFrame(docs, "doc_id long, text string")
    both = spark.createDataFrame([(i, t) for i, _ in labels for t in (0, 1)], "doc_id long, toxic int")
    assert X.find_toxic(d, both).collect() == []  # every document trains both classes: no stretch tells them apart
    same = spark.createDataFrame(labels * 2, "doc_id long, toxic int")
    once = spark.createDataFrame(labels, "doc_id long, toxic int")
    assert X.train(d, same).__getstate__().keys() == X.train(d, once).__getstate__().keys()
    assert np.array_equal(X.train(d, same).rates, X.train(d, once).rates) and X.train(d, same).toxic == X.train(d, once).toxic


def test_the_training_sample_is_bounded_in_bytes(spark, labelled, monkeypatch):
    docs, labels = labelled
    d, m = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    took = {}
    monkeypatch.setattr(X, "fit", lambda toxic, ordinary: took.update(toxic=toxic, ordinary=ordinary))
    monkeypatch.setattr(X, "SAMPLE_BYTES", 20_000)
    X.train(d, m)
    assert all(10_000 < sum(map(len, took[k])) <= 20_000 for k in ("toxic", "ordinary"))
