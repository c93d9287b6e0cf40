import numpy as np
import pytest

from deepwell.llm import multiindex as X


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def crowd(n=600, near=200, dim=16, seed=2, noise=0.03):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, dim))
    y = x[r.integers(0, n, near)] + noise * r.normal(size=(near, dim))
    return [(i, v.tolist()) for i, v in enumerate(np.concatenate([x, y]))]


def brute(rows, threshold=X.THRESHOLD):
    """Of each id with a partner: links and the smallest id it's connected to."""
    ids = [i for i, _ in rows]
    x = np.array([v for _, v in rows], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= threshold
    np.fill_diagonal(near, False)
    label = np.arange(len(ids))
    while True:
        new = np.array([min([label[i], *label[near[i]]]) for i in range(len(ids))])
        if (new == label).all():
            break
        label = new
    return {ids[i]: (int(near[i].sum()), ids[label[i]]) for i in range(len(ids)) if near[i].any()}


def found(spark, rows):
    return {r.vec_id: (r.links, r.group_id) for r in X.near_vectors(table(spark, rows)).collect()}


@pytest.mark.parametrize("near", [200, 10, 0])
def test_recall_and_precision(spark, near):
    rows = crowd(near=near)
    got, want = found(spark, rows), brute(rows)
    assert set(got) <= set(want)
    assert sum(n for n, _ in got.values()) >= 0.95 * sum(n for n, _ in want.values())
    same = [i for i in got if got[i][0] == want[i][0]]
    assert len(same) >= 0.9 * len(want)


def test_one_huge_cluster_and_lone_pairs_in_split_rows(spark, monkeypatch):
    monkeypatch.setattr(X, "ROW_BLOCK", 16)
    r = np.random.default_rng(5)
    hub, lone = r.normal(size=16), r.normal(size=(150, 16))
    x = np.concatenate([hub + 0.04 * r.normal(size=(250, 16)), lone, lone + 0.07 * r.normal(size=lone.shape)])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got, want = found(spark, rows), brute(rows)
    assert set(got) <= set(want)
    apart = [i for i in want if i >= 250]
    assert len(apart) > 200 and sum(i in got for i in apart) >= 0.93 * len(apart)
    assert sum(n for n, _ in got.values()) >= 0.95 * sum(n for n, _ in want.values())
    assert {got[i][1] for i in range(250) if i in got} == {0}


@pytest.mark.parametrize("near", [0, 200])
def test_the_traversal_visits_more_than_a_cell_and_few(spark, near):
    """Mean of the cells visited, over all vectors, in 64 dimensions."""
    r = np.random.default_rng(1)
    x = r.normal(size=(4000, 64))
    x[:near] = x[near : 2 * near] + 0.02 * r.normal(size=(near, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    own = spark.createDataFrame([(i, bytearray(v.astype(np.float32).tobytes())) for i, v in enumerate(x)], "place long, v binary")
    index = X.train(own, 64, len(x), X.THRESHOLD, X.RECALL)
    a, b = index.distances(x[:300])
    seen = [sum(map(len, index.visits(a[i], b[i], 0).values())) for i in range(300)]
    assert 1 < np.mean(seen) < 0.05 * len(index.first) * len(index.second)


def test_the_traversal_ascends_over_all_cells():
    r = np.random.default_rng(0)
    a, b = np.sort(r.random(7)).tolist(), np.sort(r.random(9)).tolist()
    out = list(X.multi_sequence(a, b))
    assert len({(i, j) for _, i, j in out}) == len(out) == 63
    assert [d for d, *_ in out] == sorted(d for d, *_ in out)


def test_a_forest_connects_what_its_pairs_do():
    r = np.random.default_rng(4)
    x, y = r.integers(0, 60, 50), r.integers(100, 160, 50)
    low, high = X.forest(x, y)

    def groups(pairs):
        root = {}
        for p, q in pairs:
            p, q = root.setdefault(p, {p}), root.setdefault(q, {q})
            if p is not q:
                p |= q
                for i in q:
                    root[i] = p
        return {frozenset(s) for s in root.values()}

    assert groups(zip(x, y, strict=True)) == groups(zip(low, high, strict=True))
    assert len(low) == len(np.unique(np.concatenate([x, y]))) - len(groups(zip(x, y, strict=True)))


def test_copies_nulls_and_odd_rows(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v), (2, v), (3, v), (3, v), (4, None), (5, []), (6, [0.0, 0.0, 0.0]), (7, [1.0, None, 2.0]), (8, [float("nan"), 1.0, 1.0]), (9, [1.0, 2.0]), (None, v), (10, [-1.0, 2.0, 0.0]), (11, [1.0, 2.0, 3.01]), (11, [-1.0, 2.0, 0.01])]
    clashing = table(spark, rows).withColumns({c: X.F.lit("x") for c in ("cell", "class_id", "v", "place", "line", "links", "n")})
    got = sorted(map(tuple, X.near_vectors(clashing).select("vec_id", "class_id", "copies", "links", "group_id", "keep").collect()))
    assert got == [(1, 1, 2, 1, 1, True), (2, 1, 2, 1, 1, False), (3, 1, 2, 1, 1, False), (10, 10, 0, 1, 10, True), (11, 11, 0, 1, 1, False), (11, 11, 0, 1, 10, False)]
    assert X.near_vectors(table(spark, [])).collect() == []


def test_lengths_tie_to_the_smaller(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.001]), (3, [1.0, 0.0, 0.0]), (4, [1.0, 0.0, 0.001])]
    assert {r.vec_id for r in X.near_vectors(table(spark, rows)).collect()} == {1, 2}
