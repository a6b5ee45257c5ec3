"""Embedding near-duplicates and nearest neighbours against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlane.llm import ann, embed_dedup

DIMS = 8


@pytest.fixture(scope="module")
def vectors(spark):
    """Clusters, scaled copies, a vector that a third of the rows share, unusable
    vectors, null and repeated ids, and columns whose names clash."""
    rng = np.random.default_rng(1)
    base = rng.normal(size=(30, DIMS))
    rows = []
    for i in range(300):
        b = base[i % 30] * rng.uniform(0.1, 9) + rng.normal(size=DIMS) * 0.12 * (i % 5)
        rows.append((i if i % 97 else None, [float(x) for x in b.astype(np.float32)]))
    rows += [(1000 + i, rows[3][1]) for i in range(150)]
    rows += [(2000, None), (2020, []), (2040, [0.0] * DIMS), (2060, [float("nan")] + [1.0] * (DIMS - 1)),
             (2080, [None] + [1.0] * (DIMS - 1)), (2100, [1.0, 2.0]), (2120, [float("inf")] * DIMS), (3, rows[3][1])]
    return (spark.createDataFrame(rows, "vec_id long, embedding array<float>")
            .withColumns({c: F.lit("x") for c in ("v", "node", "cell", "score", "rank", "tile")}))


def usable(r):
    e = r.embedding
    return e is not None and len(e) == DIMS and all(x is not None and np.isfinite(x) for x in e) and any(e)


def brute_links(rows, threshold):
    at = [i for i, r in enumerate(rows) if usable(r)]
    m = np.array([rows[i].embedding for i in at], float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    near = m @ m.T >= threshold
    np.fill_diagonal(near, False)
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in zip(*np.nonzero(near), strict=True):
        x, y = sorted((top(at[a]), top(at[b])))
        root[y] = x
    links = dict(zip(at, near.sum(1).tolist(), strict=True))
    members = {}
    for i in range(len(rows)):
        members.setdefault(top(i), []).append(rows[i].vec_id)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in members.items()}
    return sorted(((r.vec_id, links.get(i, 0), least[top(i)], r.vec_id is not None and r.vec_id == least[top(i)])
                   for i, r in enumerate(rows)), key=str)


@pytest.mark.parametrize("tile", [4096, 60])
def test_embedding_links(vectors, tile):
    got = sorted(map(tuple, embed_dedup.near_duplicates(vectors, tile=tile).collect()), key=str)
    assert got == brute_links(vectors.collect(), 0.95)


def test_nothing_to_compare(vectors):
    assert embed_dedup.near_duplicates(vectors.limit(0)).count() == 0
    alone = embed_dedup.near_duplicates(vectors.where("vec_id in (2000, 2040)")).collect()
    assert sorted(map(tuple, alone)) == [(2000, 0, 2000, True), (2040, 0, 2040, True)]
    assert ann.search(vectors.limit(0)).count() == 0
    assert ann.search(vectors.where("vec_id = 2040")).count() == 0


def test_bound_never_loses_a_link():
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=(200, 24)), rng.normal(size=(150, 24))
    b[:60] = a[:60] + rng.normal(size=(60, 24)) * 0.05
    axes = embed_dedup.principal_axes(a.T @ a)
    x, y = embed_dedup.Side(a, axes), embed_dedup.Side(b, axes)
    assert np.array_equal(embed_dedup.linked(x, y, 0, 200, 0.95), x.u @ y.u.T >= 0.95)


def test_nearest_neighbours(vectors):
    k = 7
    got = {}
    for r in ann.search(vectors, k=k, per_list=40, sample=120, chunk=30).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    rows = [r for r in vectors.collect() if usable(r) and r.vec_id is not None]
    ids = np.array([r.vec_id for r in rows])
    m = np.array([r.embedding for r in rows], float)
    hits = total = 0
    assert set(got) == {i for i in ids.tolist() if i % 20 == 0}
    for q in got:
        best = {}
        for i, s in zip(ids.tolist(), m @ m[ids.tolist().index(q)], strict=True):
            if i != q:
                best[i] = max(s, best.get(i, -np.inf))
        want = sorted(best, key=lambda i: (-best[i], i))[:k]
        found = sorted(got[q])
        assert [r for r, _, _ in found] == list(range(1, k + 1))
        assert all(abs(best[i] - s) < 1e-9 for _, i, s in found)
        assert [i for _, i, _ in found] == sorted((i for _, i, _ in found), key=lambda i: (-best[i], i))
        # equal scores are equal answers
        hits += sum(best[i] >= best[want[-1]] - 1e-9 for _, i, _ in found)
        total += k
    assert hits / total >= 0.9


def test_fewer_candidates_than_asked(spark):
    df = spark.createDataFrame([(20, [1.0, 0.0]), (21, [0.5, 0.5]), (22, [0.5, 0.5]), (40, [0.0, 2.0])],
                               "vec_id long, embedding array<double>")
    got = sorted(map(tuple, ann.search(df).collect()))
    assert got == [(20, 1, 21, 0.5), (20, 2, 22, 0.5), (20, 3, 40, 0.0), (40, 1, 21, 1.0), (40, 2, 22, 1.0), (40, 3, 20, 0.0)]


@pytest.mark.parametrize("apart", [True, False])
def test_an_id_on_a_third_of_the_rows_is_one_neighbour(spark, apart):
    """Its rows, different or all the same, take one place each among a query's neighbours."""
    rng = np.random.default_rng(12)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(600, 12)))]
    near = 3 * np.array(rows[0][1])
    rows += [(1001, (near + apart * 0.01 * rng.normal(size=12)).tolist()) for _ in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(df, k=20, every=200, per_list=150, sample=256, chunk=120).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert sorted(got) == [0, 200, 400]
    hits = 0
    for q, found in got.items():
        best = {}
        for i, v in rows:
            if i != q:
                best[i] = max(best.get(i, -np.inf), float(np.dot(v, rows[q][1])))
        want = sorted(best, key=lambda i: (-best[i], i))[:20]
        assert [r for r, _, _ in sorted(found)] == list(range(1, 21)) and len({i for _, i, _ in found}) == 20
        assert all(abs(best[i] - s) < 1e-9 for _, i, s in found)
        hits += len(set(want) & {i for _, i, _ in found})
    assert hits >= 0.85 * 60


def test_best_names_an_id_once():
    ids = np.array([7] * 200 + list(range(100, 130)))
    scores = np.concatenate([np.linspace(2, 3, 200), np.linspace(0, 1, 30)])
    top = ann.best(scores, ids, 20)
    assert ids[top].tolist() == [7] + list(range(129, 110, -1)) and scores[top[0]] == 3
    turn = ann.rotation(2)
    (_, rows, values), = ann.scan(np.array([[1.0]]), np.array([0]), np.array([-1e300]), scores[:, None], ids, 3.0, turn, 20)
    assert ids[rows].tolist() == ids[top].tolist() and np.allclose(values, scores[top])
