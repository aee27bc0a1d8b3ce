import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import ranking as rk

SCHEMA = "g string, k string, a double, b double, closeness int"


def brute(rows):
    items = {}
    for g, k, *x, _ in rows:
        if g is None or k is None:
            continue
        x = [np.nan if v is None or not np.isfinite(v) else v for v in x]
        old = items.setdefault(g, {}).setdefault(k, x)
        items[g][k] = [np.nanmax([p, q]) if not (np.isnan(p) and np.isnan(q)) else np.nan for p, q in zip(old, x, strict=True)]
    out = {}
    for g, it in items.items():
        keys, m = list(it), np.array(list(it.values()), float)
        best, worst, n = np.zeros(len(keys)), np.zeros(len(keys)), np.zeros(len(keys))
        for j in range(m.shape[1]):
            x = m[:, j]
            ok = ~np.isnan(x)
            n += ok
            if not ok.any():
                continue
            low = lambda v: np.sort(v)[int(np.ceil(0.5 * len(v))) - 1]
            med = low(x[ok])
            dev = np.abs(x[ok] - med)
            reach = 3 * (1.4826 * low(dev) if low(dev) > 0 else 1.2533 * dev.mean())
            y = np.clip(x, med - reach, med + reach)
            norm2 = np.nansum((y - np.nanmean(y)) ** 2)
            if norm2 > 0:
                best += np.nan_to_num((y - np.nanmax(y)) ** 2 / norm2)
                worst += np.nan_to_num((y - np.nanmin(y)) ** 2 / norm2)
        for k, b, w, c in zip(keys, best, worst, n, strict=True):
            b, w = np.sqrt(b / c) if c else 0, np.sqrt(w / c) if c else 0
            out[g, k] = w / (b + w) if b + w > 0 else 0.5
    return out


@pytest.mark.parametrize("seed", range(3))
def test_matches_brute_force(spark, seed):
    rng = random.Random(seed)
    val = lambda: rng.choice([None, float("nan"), float("inf"), 0.0]) if rng.random() < 0.15 else rng.lognormvariate(0, 2)
    rows = [(rng.choice(["x", "y", None]), rng.choice([*"abcdefghijklm", None]), val(), val(), 1) for _ in range(60)] + [("one", "z", 3.0, None, 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    hot = rk.hot_groups(df, "g", 5)
    assert rk.hot_groups(df, "g") is None and {r["__g"] for r in hot.collect()} == {"x", "y"}
    want = brute(rows)
    limits = spark.createDataFrame([("x", 4), ("y", 3), ("one", 9)], "g string, n int")
    firsts = []
    for h in (None, hot, hot.where("__g = 'x'")):
        got = rk.closeness(df, "g", "k", {"a": F.col("a"), "b": F.col("b")}, hot=h)
        have = {(r.g, r.k): r.closeness for r in got.collect()}
        assert have.keys() == want.keys()
        for k in want:
            assert have[k] == pytest.approx(want[k], abs=1e-9)
        firsts.append(sorted((r.g, r.k, r["rank"]) for r in rk.top(got, limits, "g", "k", "n", h).collect()))
    assert firsts[0] == firsts[1] == firsts[2] and len(firsts[0]) == 8


def test_units_and_extremes_do_not_matter(spark):
    rows = [("g", f"k{i:02d}", float(i), float(i), 1) for i in range(20)]
    scaled = [(g, k, a * 1e6, b if k != "k03" else 1e12, 1) for g, k, a, b, _ in rows]
    limits = spark.createDataFrame([("g", 3), ("g", 3), ("h", None)], "g string, n int")
    for data in (rows, scaled):
        c = rk.closeness(spark.createDataFrame(data, SCHEMA), "g", "k", {"a": F.col("a"), "b": F.col("b")})
        assert {r.k for r in rk.top(c, limits, "g", "k", "n").collect()} == {"k17", "k18", "k19"}


def test_ties_and_empty(spark):
    rows = [("g", k, 1.0, 1.0, 1) for k in "dcba"]
    c = rk.closeness(spark.createDataFrame(rows, SCHEMA), "g", "k", {"a": F.col("a")})
    limits = spark.createDataFrame([("g", 2)], "g string, n int")
    assert [(r.k, r.rank) for r in rk.top(c, limits, "g", "k", "n").orderBy("rank").collect()] == [("a", 1), ("b", 2)]
    assert rk.top(c.where("false"), limits, "g", "k", "n").count() == 0
