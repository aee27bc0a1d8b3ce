from strandline.operators import expansions as ex
from strandline.operators import graph as gr
from strandline.operators import lookups as lk
from pyspark.sql import functions as F


def edges(spark, *rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "src string, dst string, rel_type string, node string")


def seeds(spark, *names):
    return spark.createDataFrame([(n, i) for i, n in enumerate(names)], "node string, place int")


def test_trace_prefers_callers(spark):
    e = edges(spark, ("a", "s", "CALLS_DIRECT"), ("s", "a", "CALLS_GUESS"), ("s", "b", "CALLS_DIRECT"), ("b", "c", "CALLS_DIRECT"), ("s", "z", "USES_TYPE"))
    got = [tuple(r) for r in ex.trace(e, seeds(spark, "s")).collect()]
    assert got == [("a", "trace_callers", 1, 0.35), ("b", "trace_callees", 1, 0.35), ("c", "trace_callees", 2, 0.175)]
    assert [r.node for r in ex.trace(e, seeds(spark, "s"), limit=1).collect()] == ["a"] and ex.trace(e, seeds(spark)).count() == 0


def test_phases_follow_kinds(spark):
    e = edges(spark, ("s", "r", "HANDLES"), ("s", "d", "DEPENDS_ON"), ("r", "run", "CALLS_DIRECT"))
    k = lambda *kinds: spark.createDataFrame([("s", x) for x in kinds], "node string, kind string")
    got = lambda *kinds: sorted(tuple(r) for r in ex.phased(e, seeds(spark, "s"), k(*kinds)).collect())
    assert got("task_register") == [("r", "phase_discovery"), ("run", "phase_execution")]
    assert got("middleware_chain", "unheard") == [("d", "phase_discovery")], "no axis of discovery: the structural one"
    assert ex.axes_of(["registry_class", "nothing"]) == ["registry", "structural"]


def test_caps_by_file(spark):
    rows = [(f"n{i:02d}", f"f{i % 4}", i // 8) for i in range(24)] + [("own", "seed", 0), ("none", None, 0)]
    near, taken = spark.createDataFrame(rows, "node string, file_path string, depth int"), spark.createDataFrame([("seed",)], "file_path string")
    got = [r.node for r in ex.new_files(near, taken, ["depth", "node"], 2, 3, 5).collect()]
    assert got == ["n00", "n01", "n02", "n04", "n05"]


def test_classes_and_ancestors(spark):
    n = spark.createDataFrame([("f", "function", "a.py"), ("A", "class", "a.py"), ("B", "class", "b.py"), ("C", "class", "b.py"), ("D", "class", "a.py")], "uid string, kind string, file_path string")
    e = edges(spark, ("A", "B", "DEPENDS_ON"), ("B", "C", "DEPENDS_ON"), ("A", "D", "DEPENDS_ON"))
    assert sorted(tuple(r) for r in ex.file_classes(n, seeds(spark, "f")).collect()) == [("f", "A"), ("f", "D")]
    assert [tuple(r) for r in ex.inheritance_ancestors(e, n, seeds(spark, "f")).collect()] == [("B", "b.py", 1)]
    assert sorted(r.node for r in ex.class_walk(e, n, seeds(spark, "f"), "forward", ("DEPENDS_ON",), 3).collect()) == ["B", "C"]


def test_bridge_turns(spark):
    e = edges(spark, *[(u, "t1", "USES_TYPE") for u in "abcde"], *[(u, "t2", "USES_TYPE") for u in "cdef"], ("x", "t2", "USES_TYPE"))
    n = spark.createDataFrame([(u, "core") for u in "abcdef"] + [("x", "test")], "uid string, tier string")
    got = [(r.seed, r.node) for r in ex.bridge(e, n, seeds(spark, "t1", "t2"), per_seed=2).collect()]
    assert got == [("t1", "e"), ("t1", "d"), ("t2", "f"), ("t2", "c")], "what the first took is not taken again"
    assert ex.bridge(e, n, seeds(spark, "t1", "t2"), per_seed=2, total=3).count() == 3 and ex.bridge(e, n, seeds(spark)).count() == 0


def test_gate(spark):
    e = gr.directed(edges(spark, ("a", "p", "C"), ("a", "q", "C"), ("b", "p", "C")), "undirected", ["C"])
    s = spark.createDataFrame([("a", "f1", 1), ("b", "f1", 2), ("c", "f9", 3), ("d", "f9", 4), ("e", None, 5)], "node string, file_path string, place int")
    o = spark.createDataFrame([("p", "f3"), ("q", None)], "node string, file_path string")
    got = lambda least, others=o: sorted((r.node, r.linked, r.why) for r in ex.connectivity_gate(s, others, e, least).collect())
    assert got(2) == [("a", 2, "linked"), ("c", 0, "sole cover")] and len(got(0)) == len(got(2, o.where("false"))) == 5
    covered = o.unionByName(spark.createDataFrame([("z", "f1"), ("z", "f9")], "node string, file_path string"))
    assert got(9, covered) == [("a", 2, "best of none")]


def test_fanout(spark):
    rows = [("anchor", 50, True, False, 0, 1, 0), ("head", 3, False, False, 0, 1, 0), ("roles", 9, False, False, 0, 3, 0), ("span", 9, False, False, 0, 1, 1), ("tail", 9, False, False, 0, 1, 0)]
    df = spark.createDataFrame(rows, "n string, rank int, anchor boolean, exact boolean, fam int, roles int, spans int")
    got = {r.n: (r.l["limit"], r.l["why"]) for r in df.select("n", ex.fanout_limit(F.col("rank"), F.col("anchor"), F.col("exact"), F.col("fam"), F.col("roles"), F.col("spans"), 8, 2, 3).alias("l")).collect()}
    assert got == {"anchor": (8, "protected"), "head": (8, "ranked_head"), "roles": (8, "strong_consensus"), "span": (8, "supported_tail"), "tail": (4, "weak_tail")}


def test_patched_adjacency_equals_a_new_one(spark):
    old = edges(spark, ("a", "b", "X"), ("b", "c", "X"), ("c", "d", "Y"), ("e", "f", "X"))
    new = edges(spark, ("a", "c", "X"), ("b", "c", "X"), ("c", "d", "Y"), ("e", "f", "X"))
    rows = lambda a: sorted((r.node, r.out, r.inn) for r in a.collect())
    patched = ex.patch_adjacency(gr.adjacency(old), new, seeds(spark, "a"))
    assert rows(patched) == rows(gr.adjacency(new))


def test_external_nodes_are_passed_through(spark):
    e = edges(spark, ("a", "X", "CALLS_EXTERNAL"), ("b", "X", "CALLS_EXTERNAL"), *[(f"u{i}", "HUB", "CALLS_EXTERNAL") for i in range(5)])
    x = spark.createDataFrame([("X",), ("HUB",)], "node string")
    assert sorted((r.src, r.dst) for r in ex.through_external(e, ["CALLS_EXTERNAL"], x, 4).collect()) == [("a", "b"), ("b", "a")]
    assert ("X", "a", False, True) in {tuple(r) for r in ex.external_maps(e, ["CALLS_EXTERNAL"]).collect()}


def test_imports_bindings_bases(spark):
    files = spark.createDataFrame([("src/a/b.py",), ("b.py",), ("lib/x/c.ts",), (None,)], "file_path string")
    imp = spark.createDataFrame([("i", ["b.py"]), ("j", ["x/c.ts", "a/b.py"]), ("k", ["nowhere"])], "imported string, candidates array<string>")
    assert {tuple(r) for r in lk.resolve_imports(imp, files).collect()} == {("i", "b.py"), ("j", "src/a/b.py")}
    sy = spark.createDataFrame([("1", "m.long.Task"), ("2", "m.Task"), ("3", "Task.x")], "uid string, qualified_name string")
    b = spark.createDataFrame([("p", "Task"), ("q", "m.long.Task"), ("r", "none")], "proxy string, target string")
    assert {(r.proxy, r["uid"]) for r in lk.bind_targets(b, sy).collect()} == {("p", "2"), ("q", "1")}
    s = spark.createDataFrame([("1", "Base", "class", "a.py"), ("2", "Base", "class", "b.py"), ("3", "Base", "class", "c.py"), ("4", "Base", "function", "a.py")], "uid string, name string, kind string, file_path string")
    got = lk.link_bases(spark.createDataFrame([("9", "Base", "a.py")], "sub_uid string, base_name string, file_path string"), s, spark.createDataFrame([("a.py", "b.py")], "file_path string, imported string"))
    assert sorted(r.base_uid for r in got.collect()) == ["1", "2"]


def test_callers_and_contained_evidence(spark):
    spans = spark.createDataFrame([("f", "o", "outer", 1, 50), ("f", "i", "inner", 10, 20), ("f", "t", "target", 30, 40)], "file_path string, uid string, symbol string, start int, end int")
    sites = spark.createDataFrame([("f", 15, "target"), ("f", 12, "target"), ("f", 5, "target"), ("f", 35, "target"), ("g", 1, "target")], "file_path string, line int, name string")
    assert sorted((r.uid, r.line) for r in lk.overlay_callers(sites, spans).collect()) == [("i", 12), ("o", 5)]
    assert lk.overlay_callers(sites, spans, 1).count() == 1
    ev = spark.createDataFrame([("f", "o", 1, 50, ["graph"], 0.2), ("f", "i", 10, 20, ["lexical", "vector"], 0.9), ("f", "z", 45, 60, [], 1.0)], "file_path string, uid string, start int, end int, channels array<string>, score double")
    assert [(r.uid, r.channels, [tuple(x) for x in r.spans], r.score) for r in lk.promote_contained(ev).collect()] == [("o", ["graph", "lexical", "vector"], [(1, 50), (10, 20)], 0.9)]


def test_other_roles_nearby(spark):
    e = gr.directed(edges(spark, ("a", "b", "C"), ("b", "c", "C"), ("c", "d", "C")), "undirected", ["C"])
    p = seeds(spark, "a", "d")
    sec = spark.createDataFrame([("c", "x"), ("c", "y"), ("q", "x")], "node string, role string")
    rows = lambda df: sorted((r.node, r.roles, r.boost) for r in df.collect())
    assert rows(gr.cross_role(e, p, sec, 1)) == [("d", 2, 0.3)] and rows(gr.cross_role(e, p, sec, 1, keep_all=True)) == [("a", 0, 0.0), ("d", 2, 0.3)]
    assert rows(gr.cross_role(e, p, sec.where("node = 'q'"), 2)) == [("a", 0, 0.0), ("d", 0, 0.0)], "none near: all, without a boost"
