"""Queries that must run over all rows of their tables."""

import duckdb
import pytest

from strandline.plans import registry
from tools_compare import norm

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    from pathlib import Path

    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def equal_to_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    got = sorted(tuple(norm(v) for v in r) for r in df.collect())
    want = sorted(tuple(norm(v) for v in r) for r in duck.execute(f"SELECT {', '.join(df.columns)} FROM ({registry.oracles()[name]})").fetchall())
    assert got == want
    return df


def test_fusion_has_all_documents(spark, duck):
    df = equal_to_sql(spark, duck, "r13_rank_fusion")
    late = f"uid > {duck.execute('SELECT max(vec_id) FROM embeddings').fetchone()[0]}"
    lexical = registry.queries()["r07_bm25"](spark, SF).withColumnRenamed("doc", "uid").where(late)
    assert df.where(late).count() == lexical.count() > 0


def test_vector_join_meets_every_vector(spark, duck, monkeypatch):
    from strandline.operators import vectors

    monkeypatch.setattr(vectors, "BLOCK_ROWS", 200)
    df = equal_to_sql(spark, duck, "j22_vector_join")
    label = {i: x for i, x in duck.execute("SELECT vec_id, label FROM embeddings").fetchall()}
    got = df.collect()
    assert any(label[r.vec_id] != label[r.neighbour] for r in got) and max(r.distance for r in got) <= 1.5
    e = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [9.0, 0.0]), (4, None), (None, [0.0, 0.0])], "i long, v array<float>")
    assert {tuple(r) for r in vectors.nearest_within(e, "i", "v", 5, 2.0).collect()} == {(1, 2, 1.0), (2, 1, 1.0)}


def test_span_probe_reads_every_window(spark):
    from pyspark.sql import functions as F

    from strandline.plans import linking

    codes = {"tail": "a\n" * 7 + "retry cache", "two": "queue\na\na\nb\nretry cache\na\nqueue token\nb", "one": "queueRetry", "none": "x\ny"}
    words = {"queue", "retry", "resolver", "cache", "token"}
    want = {}
    for u, code in codes.items():
        lines = code.replace("queueRetry", "queue retry").split("\n")
        best = max((len(words & set(" ".join(lines[i : i + 6]).split())), -i - 1) for i in range(max(1, len(lines) - 5)))
        if best[0]:
            want[u] = (best[0], -best[1])
    df = linking._best_window(spark.createDataFrame(list(codes.items()), "uid string, code string"), F.array(*map(F.lit, sorted(words))))
    assert {r.uid: (r.score, r.line) for r in df.collect()} == want and want["tail"] == (2, 3)


def test_shared_pairs_counts_large_groups(spark, monkeypatch):
    from itertools import combinations

    from strandline.operators import lookups

    monkeypatch.setattr(lookups, "GROUP_BLOCK", 16)
    groups = {"big": range(60), "mid": range(20, 70), "small": [1, 2, 65], "all": range(70)}
    rows = [(i, g) for g, members in groups.items() for i in members] + [(1, "small"), (None, "big"), (1, None)]
    df = spark.createDataFrame(rows, "i int, g string")
    for exclude in ((), ("all",)):
        kept = [set(m) for g, m in groups.items() if g not in exclude]
        want = {(a, b, n) for a, b in combinations(range(70), 2) if (n := sum(a in m and b in m for m in kept)) >= 2}
        assert {tuple(r) for r in lookups.shared_pairs(df, "i", "g", 2, exclude).collect()} == want
