import itertools
import random

import pytest
from pyspark.sql import functions as F

from strandline.functions import text as tx
from strandline.operators import extract, graph, lookups, ranking, selection


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def bfs(adj, start, hops):
    seen, front = {start: 0}, [start]
    for d in range(1, hops + 1):
        front = [v for v in {w for u in front for w in adj.get(u, ())} if v not in seen]
        seen.update(dict.fromkeys(front, d))
    return seen


@pytest.fixture(scope="module")
def net(spark):
    rng = random.Random(3)
    pairs = {(f"n{rng.randint(0, 19)}", f"n{rng.randint(0, 19)}") for _ in range(40)} | {("loop", "loop"), ("a", "b"), ("b", "a")}
    return pairs, spark.createDataFrame([(a, b, "CALLS_DIRECT", 1.0) for a, b in pairs] * 2, "src string, dst string, rel_type string, confidence double")


def test_walk(spark, net):
    pairs, e = net
    adj = {}
    for a, b in pairs:
        adj.setdefault(a, set()).add(b)
    seeds = ["n0", "n1", "a", "loop", "absent"]
    got = graph.walk(graph.directed(e, "forward"), spark.createDataFrame([(s, s) for s in seeds], "seed string, node string"), 3)
    want = {}
    for s in seeds:
        for n, d in bfs(adj, s, 3).items():
            if d:
                want.setdefault(n, []).append(d)
    assert rows(got) == sorted(((n, min(ds), len(ds)) for n, ds in want.items()), key=str)


@pytest.mark.parametrize("bad", [0, -1, 1.5, "2", True])
def test_walk_refuses_hops(net, spark, bad):
    with pytest.raises(ValueError):
        graph.reach(net[1], spark.createDataFrame([("a", "a")], "seed string, node string"), bad)


def test_closure_is_capped_in_order(spark):
    e = spark.createDataFrame([("b", "a"), ("c", "a"), ("d", "a"), ("e", "b"), ("f", "c"), ("g", "d")], "src string, dst string")
    got = graph.closure_bounded(e, spark.createDataFrame([("a",)], "node string"), 2, 2)
    assert {r.node for r in got.collect()} == {"b", "c", "e", "f"}


def test_shortest_path(spark, net):
    pairs, e = net
    adj = {}
    for a, b in pairs:
        adj.setdefault(a, set()).add(b)
        adj.setdefault(b, set()).add(a)
    d = bfs(adj, "n0", 6)
    for goal in ("n5", "n9", "b", "n0"):
        got = [r.node for r in graph.shortest_path(e, "n0", goal, 6).orderBy("position").collect()]
        if goal in d:
            assert len(got) == d[goal] + 1 and got[0] == "n0" and got[-1] == goal
            assert all(y in adj[x] for x, y in itertools.pairwise(got))
        else:
            assert got == []


def test_depth_propagation_and_degrees(spark):
    e = spark.createDataFrame([("b", "a", "D"), ("c", "b", "D"), ("z", "y", "D")], "src string, dst string, rel_type string")
    n = spark.createDataFrame([(x,) for x in "abcyz"], "node string")
    depth = dict(rows(graph.depth_from_roots(graph.directed(e, "reverse"), n, n.where("node = 'a'"))))
    assert depth == {"a": 0, "b": 1, "c": 2, "y": 3, "z": 3}
    assert {r.node for r in graph.propagate(e, n.where("node = 'a'")).collect()} == {"a", "b", "c"}
    assert {r.node: (r.degree_in, r.degree_out) for r in graph.degrees(e).collect()}["b"] == (1, 1)


def test_cap_by_file(spark):
    rng = random.Random(1)
    data = [("q", f"f{rng.randint(0, 5)}", i) for i in range(40)]
    got = {r.i for r in selection.cap_by_file(spark.createDataFrame(data, "q string, file_path string, i int"), [F.col("i")], ["q"], per_file=2, files=4, total=6).collect()}
    want, count = [], {}
    for _, f, i in data:
        if len(want) == 6 or (f not in count and len(count) == 4) or count.get(f, 0) == 2:
            continue
        count[f] = count.get(f, 0) + 1
        want.append(i)
    assert got == set(want)


def test_spans(spark):
    rng = random.Random(2)
    spans = [("f", f"u{i}", a, a + rng.randint(0, 150)) for i, a in enumerate(rng.randint(0, 500) for _ in range(40))]
    s = spark.createDataFrame(spans, "file_path string, uid string, start int, end int")
    got = {(r.left_uid, r.right_uid, r.start, r.end) for r in lookups.overlaps(s, s, "file_path").collect()}
    want = {(a[1], b[1], max(a[2], b[2]), min(a[3], b[3])) for a in spans for b in spans if max(a[2], b[2]) <= min(a[3], b[3])}
    assert got == want
    p = spark.createDataFrame([("f", x) for x in range(0, 700, 7)], "file_path string, line int")
    inner = {r.line: r.uid for r in lookups.innermost(p, s, "file_path", "line").collect()}
    for x in range(0, 700, 7):
        hold = sorted((e - a, a, u) for _, u, a, e in spans if a <= x <= e)
        assert inner.get(x) == (hold[0][2] if hold else None)
    lines = sorted({x for _, _, a, e in spans for x in range(a, e + 1)})
    merged = lookups.merge_spans(s, ["file_path"]).collect()
    assert sorted(x for r in merged for x in range(r.start, r.end + 1)) == lines
    assert all(b.start > a.end + 1 for a, b in itertools.pairwise(sorted(merged, key=lambda r: r.start)))


def test_lookups(spark):
    m = spark.createDataFrame([("a.b.c",), ("a.x",), ("q",)], "qualified_name string")
    o = spark.createDataFrame([("a",), ("a.b",), ("a.b",)], "qualified_name string")
    assert rows(lookups.longest_owner(m, o)) == [("a.b.c", "a.b"), ("a.x", "a"), ("q", None)]
    assert lookups.longest_owner(m.where("false"), o).count() == 0
    b = lookups.capped_bridge(spark.createDataFrame([(f"s{i}", "hub") for i in range(9)] + [("s1", "k"), ("s1", "k")], "src string, key string"), spark.createDataFrame([("d", "hub"), ("s1", "k"), ("d", "k")], "dst string, key string"), "key", 5)
    assert rows(b) == [("s1", "d", "k")]
    left = spark.createDataFrame([(1, 5), (1, 0), (2, 9), (3, None)], "k int, at int")
    right = spark.createDataFrame([(1, 3, "x"), (1, 5, "y"), (2, 10, "z")], "k int, at int, v string")
    assert rows(lookups.as_of(left, right, ["k"], "at", ["v"])) == [(1, 0, None), (1, 5, "y"), (2, 9, None), (3, None, None)]



def test_ranking(spark):
    s = spark.createDataFrame([(float(x), x > 3) for x in [1, 2, 3, 3, 4, 5, 5]], "s double, g boolean")
    data = [(float(x), x > 3) for x in [1, 2, 3, 3, 4, 5, 5]]
    gold, other = [x for x, g in data if g], [x for x, g in data if not g]
    want = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a in gold for b in other) / (len(gold) * len(other))
    assert ranking.rank_auc(s, "s", F.col("g")).first().auc == pytest.approx(want)
    f = ranking.reciprocal_rank_fusion({"a": (spark.createDataFrame([("x", 1.0), ("y", 0.5)], "uid string, score double"), 1.0), "none": (spark.createDataFrame([], "uid string, score double"), 9.0)})
    assert {r.uid: r.score for r in f.collect()}["x"] == pytest.approx(1.0)
    assert [r.x for r in ranking.minmax(spark.createDataFrame([(2.0,), (2.0,)], "v double"), "v", "x").collect()] == [1.0, 1.0]


def test_paths(spark):
    p = spark.createDataFrame([("tests/a.py",), ("src/test_x.py",), ("a/contest/b.py",), ("conftest.py",), (None,)], "p string")
    assert [r[0] for r in p.select(tx.is_test_path(F.col("p"))).collect()] == [True, True, False, True, None]
    h = spark.createDataFrame([("/A//b/<int:id>/?q=1",), ("a/b/{x}",), ("/",)], "p string")
    assert [r[0] for r in h.select(tx.http_path(F.col("p"))).collect()] == ["/a/b/{}", "/a/b/{}", "/"]


def test_extract():
    src = "import os\nfrom a.b import c\n@d.e(1)\nclass X(Y):\n    def f(self):\n        raise V('x')\n        g.h()\n"
    f = {(k, n) for k, n, _ in extract.facts_of(src)}
    assert {("import", "os"), ("import", "a.b.c"), ("decorator", "d.e"), ("class", "X"), ("inherits", "Y"), ("function", "f"), ("raise", "V"), ("call", "g.h")} <= f
    assert extract.facts_of("def (") == [] and extract.facts_of("") == []


@pytest.mark.parametrize("rows", [0, 1, 2, 37, 500])
def test_quantiles_narrow_to_the_exact_value(spark, monkeypatch, rows):
    import random

    from strandline.operators import ranking as rk

    monkeypatch.setattr(rk, "QUANTILE_ROWS", 5)
    monkeypatch.setattr(rk, "QUANTILE_PARTS", 4)
    rng = random.Random(rows)
    values = [rng.choice([1.0, 2.0, rng.lognormvariate(0, 3)]) for _ in range(rows)]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "v double")
    import numpy as np

    for q in (0.0, 0.05, 0.5, 0.95, 1.0):
        got = rk.quantile(df, F.col("v"), q)
        assert got is None if not rows else got == pytest.approx(np.quantile(values, q))


def test_places_and_sums_by_ranges(spark):
    from strandline.operators import ranking as rk

    df = spark.createDataFrame([(i * 7 % 100, i % 5) for i in range(100)], "k int, v int").repartition(7)
    assert sorted((r.k, r["rank"]) for r in rk.ranked(df, [F.desc("k")]).collect()) == [(99 - i, i + 1) for i in reversed(range(100))]
    got = {r.k: r.b for r in rk.running_sum(df, [F.col("k")], F.col("v"), "b").collect()}
    value = {r.k: r.v for r in df.collect()}
    assert all(got[k] == sum(v for j, v in value.items() if j < k) for k in got)
    assert rk.ranked(df.where("false"), [F.col("k")]).count() == 0
