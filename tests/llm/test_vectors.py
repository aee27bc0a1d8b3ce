import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import vectors as vx


def clusters(n, d, seed):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(30, d))
    return vx.unit(c[rng.integers(0, 30, n)] + 0.6 * rng.normal(size=(n, d)))


def test_scan_adds_up_to_the_coded_product():
    x = clusters(300, 9, 0)
    books = vx.fit(x)
    codes = vx.encode(x, books)
    back = np.stack([books[j][codes[:, j]] for j in range(books.shape[0])], 1).reshape(len(x), -1)
    q = clusters(7, 9, 1)
    rough = vx.scan(vx.pack(codes), vx.tables(q, books))
    assert np.allclose(rough, back @ np.hstack([q, np.zeros((7, 1))]).T, atol=1e-5)


def test_score_aware_codes_lower_the_parallel_residual():
    x = clusters(2000, 32, 2)
    loss = {}
    for eta in (1.0, vx.ETA):
        books = vx.fit(x, eta)
        codes = vx.encode(x, books, eta)
        back = np.stack([books[j][codes[:, j]] for j in range(16)], 1).reshape(len(x), -1)
        loss[eta] = (((x - back) * x).sum(1) ** 2).mean()
    assert loss[vx.ETA] < loss[1.0]


def test_recall_against_brute_force():
    x = clusters(12_000, 64, 3)
    q = x[:60]
    books = vx.fit(x[:4096])
    got = vx.search_block(x, q, books, 11)
    exact = q @ x.T
    hit = sum(len(set(c[np.argsort(-e)][:11]) & set(np.argsort(-exact[i])[:11])) for i, (c, e) in enumerate(got))
    assert hit / (60 * 11) >= 0.95


@pytest.fixture(scope="module")
def table(spark):
    x = clusters(900, 8, 4)
    rows = [("g1" if i % 3 else "g2", f"k{i:04d}", [float(v) for v in x[i]], 1) for i in range(900)]
    rows += [("g1", "k0001", [float(v) for v in x[2]], 0), ("g1", "copy", [float(v) for v in 5 * x[1]], 1), ("g1", "copy", [float(v) for v in 5 * x[1]], 1)]
    return x, spark.createDataFrame(rows, "g string, key string, v array<float>, v_order int")


def test_nearest_whole(spark, table):
    x, t = table
    q = spark.createDataFrame([(1, "g1", "k0001"), (1, "g1", "k0001"), (2, "g2", "k0000"), (3, "g1", "nowhere"), (4, "g2", "k0001")], "query_id long, g string, key string")
    got = {}
    for r in vx.nearest(t, q, 10).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.key))
    assert set(got) == {1, 2}
    assert sorted(got[1])[0] == (1, "copy") and len(got[1]) == 10
    f = x.astype(np.float32).astype(float)
    idx = [i for i in range(900) if i % 3 == 0 and i != 0]
    order = sorted(idx, key=lambda i: (-(vx.unit(f)[i] @ vx.unit(f)[0]), f"k{i:04d}"))[:10]
    assert [k for _, k in sorted(got[2])] == [f"k{i:04d}" for i in order]
    assert vx.nearest(t.where("false"), q).count() == 0 and vx.nearest(t, q.where("false")).count() == 0


@pytest.mark.parametrize(("probed", "least"), [(1.0, 0.99), (0.25, 0.9)])
def test_every_vector_by_a_coarse_partition(spark, monkeypatch, probed, least):
    """All vectors are queries; small cells and blocks, one key twice, and a third of all rows the same vector (a hot cell)."""
    monkeypatch.setattr(vx, "CELL_ROWS", 64)
    monkeypatch.setattr(vx, "BLOCK_ROWS", 256)
    x = clusters(1200, 16, 5)
    x[800:] = x[0]
    keys = [f"k{i:04d}" for i in range(1200)]
    df = spark.createDataFrame([("g", k, [float(a) for a in v], 1) for k, v in zip(keys, x, strict=True)] + [("g", "k0001", [1.0] * 16, 0)], "g string, key string, v array<float>, v_order int")
    asked = df.select(F.xxhash64("key").alias("query_id"), "g", "key").distinct()
    got = {}
    for r in vx.nearest(df, asked, 10, probed).join(asked.select("query_id", F.col("key").alias("of")), "query_id").collect():
        got.setdefault(r.of, []).append(r.similarity)
    s = vx.unit(x.astype(np.float32)) @ vx.unit(x.astype(np.float32)).T
    np.fill_diagonal(s, -2)
    assert len(got) == 1200
    edge = np.sort(s, 1)[:, -10] - 1e-6
    hit = sum(len([1 for v in sims if v >= edge[keys.index(k)]]) for k, sims in got.items())
    assert all(len(sims) == 10 for sims in got.values()) and hit >= least * 12_000


def test_malformed(spark):
    rows = [("a", [1.0, 2.0], 2), ("b", None, 2), ("c", [1.0], 2), ("d", [0.0, 0.0], 2), ("e", [float("nan"), 1.0], 2), ("f", [float("inf"), 1.0], 2), ("h", [None, 1.0], 2), ("i", [1.0, 2.0], None)]
    df = spark.createDataFrame(rows, "k string, v array<float>, n int")
    assert [r.k for r in df.where(vx.well_formed(F.col("v"), F.col("n"))).collect()] == ["a"]
