import numpy as np
import pytest

from llm import embedding, topk

SCHEMA = "vec_id long, embedding array<float>, key string, unit string"


def rows_of(seed=0, n=400, dim=64):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dim))
    for k in range(0, n - 60, 7):  # neighbours at about the threshold, above and below
        noise = rng.normal(size=dim)
        base[k + 1] = base[k] + noise * np.linalg.norm(base[k]) / np.linalg.norm(noise) * rng.uniform(0.05, 0.4)
    base[n - 50 :] = base[0] + rng.normal(size=(50, dim)) * 0.1  # a dense group
    base = (base / np.linalg.norm(base, axis=1)[:, None]).astype(np.float32)
    return [(i, base[i].tolist(), "clash", None) for i in range(n)] + [(1000 + i, base[3].tolist(), "clash", None) for i in range(30)]


ODD = [(2000, None, None, None), (2001, [0.0] * 64, None, None), (2002, [float("nan")] * 64, None, None), (2003, [1.0] + [None] * 63, None, None), (2004, [], None, None), (2005, [1.0, 2.0], None, None), (2006, [float("inf")] * 64, None, None)]


def test_near_duplicates(spark, monkeypatch):
    monkeypatch.setattr(embedding, "BLOCK", 16)
    rows = rows_of()
    found = {r.vec_id: r for r in embedding.near_duplicates(spark.createDataFrame(rows + ODD, SCHEMA)).collect()}
    x = np.array([r[1] for r in rows], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    links = sum(found[r[0]].n_links for r in rows)
    assert 0.9 * near.sum() <= links <= near.sum()
    assert all(found[r[0]].n_links <= near[k].sum() for k, r in enumerate(rows))
    assert {found[1000 + i].component_id for i in range(30)} == {found[3].component_id}
    assert len({found[i].component_id for i in [0, *range(350, 400)]}) == 1
    for i, *_ in ODD:
        assert (found[i].n_links, found[i].component_id, found[i].kept) == (0, i, True)
    assert len(found) == len(rows) + len(ODD)
    assert embedding.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("dim", [64, 100, 256, 768, 1024])
def test_recall_of_every_scheme(dim):
    """Recall at the threshold of what is chosen for a thousand vectors up to a thousand billions."""
    chosen = {embedding.scheme(dim, 10**e, 0.95) for e in range(3, 13, 3)}
    a, b = embedding.at_cosine(np.random.default_rng(2), 400, dim, 0.9501)
    assert np.allclose((a * b).sum(axis=1), 0.9501)
    for own in chosen:
        x, y = (embedding.buckets(v, own.tables, own.vertices, own.probes) for v in (a, b))
        assert (x[:, :, :, None] == y[:, :, None, :]).any(axis=(1, 2, 3)).mean() >= 0.93, own


@pytest.mark.parametrize("vertices", [1, 2, 3, 4, 5])
def test_links_of_every_number_of_hashes(spark, monkeypatch, vertices):
    """All links, counted once, whatever the number of hashes of a bucket; tables and probes as the scheme would have them."""
    tables = {1: 3, 2: 5, 3: 7, 4: 12, 5: 20}[vertices]
    monkeypatch.setattr(embedding, "scheme", lambda *_: embedding.Scheme(vertices, tables, 2))
    rows = rows_of(3, 300, 33)
    found = {r.vec_id: r.n_links for r in embedding.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    x = np.array([r[1] for r in rows], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = (x @ x.T >= 0.95).sum(axis=1) - 1
    assert all(found[r[0]] <= n for r, n in zip(rows, near)) and sum(found.values()) >= 0.9 * near.sum()


def test_widths_and_precisions(spark):
    rng = np.random.default_rng(5)
    short, long = rng.normal(size=(2, 30)), rng.normal(size=(2, 70))
    rows = [(k, v.tolist(), None, None) for k, v in enumerate([short[0], short[0] * 1e200, long[0], long[0] * 3, short[1], long[1], short[0] * 1e-200])]
    found = embedding.near_duplicates(spark.createDataFrame(rows, SCHEMA.replace("float", "double"))).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in found} == {0: (2, 0), 1: (2, 0), 6: (2, 0), 2: (1, 2), 3: (1, 2), 4: (0, 4), 5: (0, 5)}


def test_products_are_exact():
    big = 2.0**29
    assert topk._products(np.array([[big, 3.0]]), np.array([[big, 1.0], [big, 2.0]])).tolist() == [[2**58 + 3, 2**58 + 6]]
    assert topk._products(np.array([[1e300, 1.0]]), np.array([[1e300, 0.0], [-1e300, 0.0], [0.0, 5.0]])).tolist() == [[2**63 - 1, 1 - 2**63, 5]]
    ids = np.arange(200)
    for scores in (np.zeros((1, 200)), np.full((1, 200), 2**60, dtype=np.int64)):
        scores[0, 3] = topk._least(scores)
        assert topk._best(ids, scores, 5)[1].tolist() == [0, 1, 2, 4, 5]


def test_topk_beyond_float_precision(spark):
    rows = [(0, [2.0**23, 3 / 64], None, None), (7, [2.0**23, 2 / 64], None, None), (9, [2.0**23, 1 / 64], None, None), (5, [2.0**23, 1 / 64], None, None)]
    df = spark.createDataFrame(rows, SCHEMA.replace("float", "double"))
    found = topk.search(df, df.where("vec_id = 0")).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in found] == [(7, 2**58 + 6), (5, 2**58 + 3), (9, 2**58 + 3)]


def test_topk(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 8)
    monkeypatch.setattr(topk, "SHARD", 50)
    monkeypatch.setattr(topk, "FAN_IN", 2)
    rows = rows_of(1)
    df = spark.createDataFrame(rows + ODD, SCHEMA).repartition(7)
    for sent in (1 << 13, 64 << 20):
        monkeypatch.setattr(topk, "SENT", sent)
        got = sorted(map(tuple, topk.search(df, df.where("vec_id % 20 = 0")).collect()))
        q = np.floor(64 * np.array([r[1] for r in rows], dtype=np.float32).astype(np.float64)).astype(int)
        ids = np.array([r[0] for r in rows])
        want = []
        for k in np.flatnonzero(ids % 20 == 0):
            s = q @ q[k]
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[k]][:20]
            want += [(int(ids[k]), n + 1, int(ids[j]), int(s[j])) for n, j in enumerate(order)]
        got = [g for g in got if g[0] < 2000]
        assert got == sorted(want)
    small = spark.createDataFrame(rows[:3], SCHEMA)
    assert topk.search(small, small.where("vec_id = 0")).count() == 2
    assert topk.search(small.limit(0), small.limit(0)).collect() == []
