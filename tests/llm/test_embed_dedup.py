import numpy as np
import pytest

from docgrain.llm import embed_dedup, queries
from tests.oracle import assert_same, connect

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string, size int"


def brute(vectors, least=0.95):
    """(links, component) of each row by all pairs."""
    n = len(vectors)
    ok = [v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in vectors]
    root, links = list(range(n)), [0] * n

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            a, b = vectors[i][1], vectors[j][1]
            if ok[i] and ok[j] and len(a) == len(b):
                a, b = np.asarray(a, float), np.asarray(b, float)
                if a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= least:
                    links[i] += 1
                    links[j] += 1
                    root[find(i)] = find(j)
    best = {}
    for i in range(n):
        best.setdefault(find(i), []).extend([vectors[i][0]] if vectors[i][0] is not None else [])
    return [(vectors[i][0], links[i], min(best[find(i)], default=None)) for i in range(n)]


def clustered(rng, clusters, size, spread, dim=32):
    out = []
    for _ in range(clusters):
        centre = rng.normal(size=dim)
        out += [(centre + spread * rng.normal(size=dim) * np.linalg.norm(centre) / np.sqrt(dim)).astype(np.float32).tolist() for _ in range(size)]
    return out


@pytest.mark.parametrize("limit", [embed_dedup.LONG_BUCKET, 24])
def test_links_equal_brute_force(spark, monkeypatch, limit):
    """Recall is measured as whole links: counts and components must agree. With the low limit buckets are dealt out in parts."""
    monkeypatch.setattr(embed_dedup, "LONG_BUCKET", limit)
    rng = np.random.default_rng(4)
    vectors = clustered(rng, 12, 25, 0.15) + clustered(rng, 60, 2, 0.22) + clustered(rng, 200, 1, 0)
    vectors += vectors[:5] + [[2 * x for x in vectors[0]]]
    rows = [(int(i), v) for i, v in zip(rng.permutation(len(vectors)), vectors, strict=True)]
    frame = spark.createDataFrame([(i, v, 0, "x", 1) for i, v in rows], SCHEMA)
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in embed_dedup.near_vectors(frame).collect())
    want = sorted(brute(rows))
    assert sum(w[1] for w in want) > 1000
    assert sum(g[1] for g in got) >= 0.995 * sum(w[1] for w in want) and all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
    assert np.mean([g[2] == w[2] for g, w in zip(got, want, strict=True)]) >= 0.995


def test_recall_at_the_threshold():
    rng = np.random.default_rng(5)
    a = embed_dedup.unit_rows(rng.normal(size=(4000, 64)))
    other = rng.normal(size=a.shape)
    other -= (other * a).sum(1)[:, None] * a
    b = 0.951 * a + np.sqrt(1 - 0.951**2) * embed_dedup.unit_rows(other)
    x, y = embed_dedup.bucket_keys(a), embed_dedup.bucket_keys(b)
    met = np.zeros(len(a), bool)
    for t in range(embed_dedup.TABLES):
        met |= (x[:, t][:, :, None] == y[:, t][:, None, :]).any(axis=(1, 2))
    assert met.mean() >= 0.995


def test_rotation_keeps_lengths():
    x = np.random.default_rng(6).normal(size=(5, 16))
    assert np.allclose(np.linalg.norm(embed_dedup.hadamard(x), axis=1), 4 * np.linalg.norm(x, axis=1))


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (9, [1.0, 0.0]), (7, [2.0, 0.0]), (8, [1.0, 0.0, 0.0]), (10, [1.0, 0.0]), (10, [1.0, 0.0]), (None, [1.0, 0.0]), (None, [0.0, 5.0])]
    frame = spark.createDataFrame([(i, v, None, None, None) for i, v in rows], SCHEMA)
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embed_dedup.near_vectors(frame).collect()), key=str)
    want = [(i, 0, i, True) for i in (1, 2, 3, 4, 5, 6, 8)] + [(7, 4, 7, True), (9, 4, 7, False), (10, 4, 7, False), (10, 4, 7, False), (None, 4, 7, False), (None, 0, None, True)]
    assert got == sorted(want, key=str)
    assert embed_dedup.near_vectors(frame.limit(0)).count() == 0


def test_ids_play_no_part_in_what_links(spark):
    """Rows without an id are bridges, and an id on different vectors joins nothing."""
    at = lambda degrees: [float(np.cos(np.radians(degrees))), float(np.sin(np.radians(degrees)))]
    bridge = [(1, at(0)), (None, at(15)), (2, at(30))]
    repeated = [(1, at(0)), (1, at(90)), (3, at(91)), (4, at(1)), (None, at(200)), (None, at(201))]
    rng = np.random.default_rng(8)
    vectors = clustered(rng, 10, 12, 0.2) + clustered(rng, 40, 1, 0)
    mixed = [(None if rng.random() < 0.3 else int(rng.integers(0, 60)), v) for v in vectors]
    for rows in (bridge, repeated, mixed):
        frame = spark.createDataFrame([(i, v, 0, "x", 1) for i, v in rows], SCHEMA)
        got = sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in embed_dedup.near_vectors(frame).collect()), key=str)
        assert got == sorted(brute(rows), key=str)


def test_query_equals_sql(spark, sf):
    assert_same(queries.op1_embedding_dedup(spark, sf).toPandas(), connect(sf).execute(queries.oracle_sql()["op1_embedding_dedup"]).df())
