import random

import pytest

from strandline.operators import selection as se


def bundle(name, utility=1.0, files=("f",), tokens=10, role="r", steps=(), passive=False, symbols=None, weight=1.0):
    return {
        "bundle": name, "role": role, "passive": passive, "utility": utility, "weight": weight, "bridge": 0.0, "files": [{"path": f, "weight": weight} for f in files], "steps": list(steps),
        "symbols": [{"uid": u, "tokens": t, "semantic": 0.0} for u, t in (symbols or [(name, tokens)])],
    }


def slow(bundles, budget):
    """The same purchase without a heap: all last prices in a list."""
    state = se.Coverage(int(budget * 0.25))
    price = {i: se.hope(b) for i, b in enumerate(bundles)}
    used, out = 0, []
    while price and (not out or used < budget):
        i = min(price, key=lambda i: (-price[i], i))
        b = bundles[i]
        cost, gain = state.cost(b), state.gain(b)
        value = max(se.LEAST_GAIN, gain) / max(1, cost)
        others = [v for j, v in price.items() if j != i]
        if others and value + 1e-12 < max(others):
            price[i] = value
            continue
        del price[i]
        if out and used + cost > budget:
            continue
        out.append((b["bundle"], cost, gain))
        used += cost
        state.take(b, cost)
    return out


@pytest.mark.parametrize("seed", range(20))
def test_heap_equals_a_list(seed):
    rng = random.Random(seed)
    bundles = [bundle(f"b{i:02d}", rng.random(), rng.sample("fghij", rng.randint(0, 2)), role=rng.choice("xyz"), steps=rng.sample("stuv", rng.randint(0, 2)), passive=rng.random() < 0.3, weight=rng.choice([1.0, 0.5, 0.15]), symbols=[(rng.choice("abcdefghijklmnop"), rng.randint(0, 40)) for _ in range(rng.randint(1, 3))]) for i in range(25)]
    got = se.choose(bundles, 150)
    assert got == slow(bundles, 150)
    assert sum(c for _, c, _ in got[1:]) + got[0][1] <= max(150, got[0][1]) and len({b for b, _, _ in got}) == len(got)


def test_parts_of_the_gain():
    s = se.Coverage(100)
    first = bundle("a", 0.5, ("f", "g"), steps=("call", "type"))
    assert s.gain(first) == pytest.approx(0.5 + 0.35 + 0.08 + 0.20 + 2 * 0.10 + 0.05)
    s.take(first, 40)
    assert s.gain(bundle("b", 0.5, ("f",))) == pytest.approx(0.5 + 0.05 - 0.15 - 0.4), "its file is shown, its role covered, its file nearly full"
    assert s.cost(bundle("c", symbols=[("a", 10), ("z", 3), ("z", 3)])) == 3, "what is printed costs nothing"
    assert s.gain(bundle("d", 1.0, ("x",), role="q", passive=True, weight=0.15)) == pytest.approx(0.15 + 0.35 * 0.15 + 0.20 - 0.03)


def test_budget_and_cutoff():
    many = [bundle(f"b{i}", 1.0 - i / 10, (f"f{i}",), 10) for i in range(6)]
    assert [b for b, _, _ in se.choose(many, 30)] == ["b0", "b1", "b2"]
    assert [b for b, _, _ in se.choose([bundle("huge", tokens=99)], 30)] == ["huge"], "the first always fits"
    assert len(se.choose(many, 600, least=0.1)) < 6 and se.choose([], 10) == []


def test_pack(spark):
    rows = [("q", *b.values()) for b in [bundle("a"), bundle("b", 0.2, ("g",)), bundle("a")]] + [("p", *bundle("z").values())]
    df = spark.createDataFrame(rows, f"query string, {se.BUNDLE}").withColumnRenamed("query", "q")
    got = sorted((r.q, r.place, r.bundle, r.tokens) for r in se.pack(df, "q", 100).collect())
    assert got == [("p", 1, "z", 10), ("q", 1, "a", 10), ("q", 2, "b", 10)] and se.pack(df.where("false"), "q", 9).count() == 0


def test_leaders(spark):
    df = spark.createDataFrame([("a", u) for u in (1.0, 0.9, 0.1, 0.1, 0.1)] + [("b", 0.5)], "q string, u double")
    got = {r.q: (round(r.noise, 6), r.leaders, r.step_limit) for r in se.leaders(df, "q", "u", 1000).collect()}
    assert got == {"a": (10.0, 2, 500), "b": (1.0, 1, 1000)}


def row(role, place, uid, exact=False, channels=("lexical",), score=0.5):
    return {"role": role, "place": place, "uid": uid, "exact": exact, "channels": list(channels), "score": score}


def seeds(rows, intents=(), anchors=(), **how):
    return [(s["uid"], s["reasons"][-1], round(s["score"], 3)) for s in se.pick_seeds(rows, list(intents), frozenset(anchors), **how)]


def test_cap_anchors_and_exact_hits():
    rows = [row("r", i, f"u{i}") for i in range(5)]
    assert [u for u, _, _ in seeds(rows, cap=2)] == ["u0", "u1"]
    late = [*rows[:4], row("r", 4, "u4", exact=True)]
    assert seeds(late, cap=2) == [("u4", "hard_reserve", 0.5), ("u0", "ranked_fill", 0.5)]
    early = [row("r", 0, "u0", exact=True), *rows[1:4], row("r", 4, "u4", exact=True)]
    assert [u for u, _, _ in seeds(early, cap=2)] == ["u0", "u1"], "an exact hit is among the first already"
    anchored = [*rows, *[row("anchor", i, f"u{i}") for i in (2, 3, 4)]]
    assert [u for u, _, _ in seeds(anchored, anchors=["anchor"], cap=2)] == ["u2", "u3", "u4", "u0", "u1"], "anchors overflow the cap of their role"


def test_roles_asked_for_come_first_and_agreement_raises():
    rows = [row("b", 0, "x"), row("a", 0, "x", channels=("vector",), score=0.6), row("a", 1, "y", exact=True), row("c", 0, "x")]
    got = se.pick_seeds(rows, ["b", "a"], frozenset(), role_boost=0.1, channel_boost=0.05, exact_boost=0.2)
    assert [(g["uid"], g["roles"], round(g["score"], 3)) for g in got] == [("x", ["b", "a", "c"], 0.85), ("y", ["a"], 0.7)]
    assert got[0]["reasons"] == ["multi_intent_role", "multi_channel", "ranked_fill"] and got[1]["reasons"] == ["exact_symbol", "ranked_fill"]
    assert se.pick_seeds([], ["a"], frozenset()) == []


def test_select_seeds(spark):
    df = spark.createDataFrame([("q", "r", 1, "u", False, None, None), ("q", None, 1, "v", False, None, 1.0), ("p", "r", 1, None, True, [], 1.0)], "query string, role string, place int, uid string, exact boolean, channels array<string>, score double")
    assert [tuple(r) for r in se.select_seeds(df, "query", ["r"]).collect()] == [("q", 1, "u", ["r"], ["ranked_fill"], 0.0)]
    assert se.select_seeds(df.where("false"), "query", []).count() == 0
