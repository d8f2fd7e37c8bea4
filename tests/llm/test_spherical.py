import numpy as np
import pytest

from objectlake.llm import queries, spherical


def brute(rows, cosine=0.9):
    """id: (links, component), by comparing all pairs."""
    ok = {}
    for i, v in rows:
        if v and all(p is not None and np.isfinite(p) for p in v) and any(v):
            v = np.array(v, np.float64) / max(map(abs, v))
            ok[i] = v / np.linalg.norm(v)
    ids = sorted(ok)
    links, up = dict.fromkeys([i for i, _ in rows], 0), {i: i for i, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, i in enumerate(ids):
        for j in ids[:k]:
            if len(ok[i]) == len(ok[j]) and ok[i] @ ok[j] >= cosine:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: (links[i], find(i)) for i in links}


def found(df):
    return {r.vec_id: (r.n_links, r.component_id) for r in df.collect() if r.kept == (r.vec_id == r.component_id)}


def make(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def test_query(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert found(queries.embeddings_query(spark, sf)) == brute(rows)


@pytest.mark.parametrize("block", [2048, 7])
def test_groups_and_odd_vectors(spark, block, monkeypatch):
    monkeypatch.setattr(spherical, "BLOCK", block)
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(12):
        center = rng.standard_normal(24)
        center /= np.linalg.norm(center)
        for _ in range(12):
            rows.append((center + 0.03 * rng.standard_normal(24)).tolist())
    rows += [rng.standard_normal(24).tolist() for _ in range(100)]
    rows += [rows[0], rows[0], [2 * p for p in rows[0]], None, [], [0.0] * 24, [-0.0] * 24, [float("nan")] * 24, [None] * 24, [1.0] * 23, [1.0] * 23, [1e200] * 24, [1e-200] * 24, [1.0], [3.0], [-1.0], [1.0, 2.0], [2.0, 4.1]]
    rows = list(enumerate(rows))
    assert found(spherical.near_duplicates(make(spark, rows))) == brute([(i, None if v is None else v) for i, v in rows])


def test_recall_at_the_threshold(spark):
    rng = np.random.default_rng(8)
    a = spherical.unit(rng, 600, 64)
    b = spherical.unit(rng, 600, 64)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    b = 0.9005 * a + np.sqrt(1 - 0.9005**2) * b
    rows = list(enumerate(np.concatenate([a, b]).tolist()))
    got = found(spherical.near_duplicates(make(spark, rows)))
    assert sum(got[i + 600][1] == i for i in range(600)) >= 0.95 * 600


def test_decoding_lists_all_filters():
    code = spherical.make_code(20, 3000, 0.9)
    x = spherical.unit(np.random.default_rng(1), 50, 20)
    base, want = 0, [[] for _ in x]
    for part in range(len(code.parts)):
        left, right = code.sums(part, x)
        for i in range(len(x)):
            every = (left[i][:, None] + right[i][None, :]).ravel()
            want[i] += (base + np.flatnonzero(every >= code.least)).tolist()
        base += left.shape[1] * right.shape[1]
    assert [f.tolist() for f in code.beyond(x, code.least)] == want
    assert all(f.tolist() == w or len(w) < spherical.FEWEST <= len(f) for f, w in zip(code.decode(x), want, strict=True))


def test_empty_and_nulls(spark):
    assert spherical.near_duplicates(make(spark, [])).count() == 0
    rows = spherical.near_duplicates(make(spark, [(None, [1.0, 2.0]), (1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None)])).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id) for r in rows) == [(0, 0, None), (1, 1, 1), (1, 1, 1), (2, 0, 2)]
