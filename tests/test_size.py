"""What results are made of stays small: rows that are shuffled, where the pairs are many."""

import random

import pytest

from strandline.operators import graph as gr
from strandline.operators import lookups as lk


def shuffled(spark, make):
    """Rows that all stages wrote for shuffles from here on, checkpoints included, until what ``make`` gives was collected."""
    sc = spark.sparkContext._jsc.sc()

    def stages():
        sc.listenerBus().waitUntilEmpty(30_000)
        found = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return {(x.stageId(), x.attemptId()): x.shuffleWriteRecords() for x in (found.apply(i) for i in range(found.size()))}

    before = stages()
    make().collect()
    return sum(n for k, n in stages().items() if k not in before)


def test_bases_of_groups(spark):
    """300 classes that name one base, which 300 classes of two files are: the pairs are no rows of a shuffle."""
    subs = [(f"s{i}", "Base", "a.py") for i in range(300)]
    bases = [(f"b{i}", "Base", "class", "a.py" if i % 2 else "b.py") for i in range(300)]
    frames = spark.createDataFrame(subs, "sub_uid string, base_name string, file_path string"), spark.createDataFrame(bases, "uid string, name string, kind string, file_path string")
    df = lk.link_bases(*frames, spark.createDataFrame([("a.py", "b.py")], "file_path string, imported string"))
    assert shuffled(spark, lambda: df) < 9_000
    assert len({tuple(r) for r in df.collect()}) == df.count() == 90_000


def test_bases_met_twice(spark):
    """Classes and bases in several rows: repeated, of two files, of two names, with nulls, and a class that is its own base."""
    subs = [("s", "A", "a.py"), ("s", "A", "b.py"), ("s", "B", "a.py"), ("s", "A", "a.py"), ("t", "A", "a.py"), ("u", None, "a.py"), (None, "A", "a.py"), ("x", "A", "a.py"), ("v", "A", None)]
    bases = [("x", "A", "class", "a.py"), ("x", "A", "class", "b.py"), ("x", "B", "class", "a.py"), ("x", "A", "class", "a.py"), ("y", "B", "class", "c.py"), ("z", "A", "class", None), (None, "A", "class", "a.py"), ("f", "A", "method", "a.py")]
    imports = [("a.py", "b.py"), ("a.py", "b.py"), ("a.py", "a.py"), ("b.py", None), (None, "c.py"), ("b.py", "c.py")]
    df = lk.link_bases(spark.createDataFrame(subs, "sub_uid string, base_name string, file_path string"), spark.createDataFrame(bases, "uid string, name string, kind string, file_path string"), spark.createDataFrame(imports, "file_path string, imported string"))
    assert sorted(tuple(r) for r in df.collect()) == [("s", "x"), ("t", "x")]


def test_members_in_parts(spark, monkeypatch):
    """Groups of more members than go into one row."""
    monkeypatch.setattr(lk, "MEMBERS", 7)
    subs = [(f"s{i}", "Base", "a.py") for i in range(23)]
    df = lk.link_bases(spark.createDataFrame(subs, "sub_uid string, base_name string, file_path string"), spark.createDataFrame([("b", "Base", "class", "a.py")], "uid string, name string, kind string, file_path string"), spark.createDataFrame([], "file_path string, imported string"))
    assert sorted(r.sub_uid for r in df.collect()) == sorted(s for s, _, _ in subs)


EDGES = "src string, dst string, rel_type string"


def test_counterparts_of_many_seeds(spark):
    """300 clients of one endpoint with 300 handlers, and 40 that are both: the pairs are no rows of a shuffle."""
    e = [(f"c{i}", "E", "CALLS_ENDPOINT") for i in range(340)] + [(f"c{i}" if i >= 300 else f"h{i}", "E", "IMPLEMENTS_ENDPOINT") for i in range(340)]
    edges, seeds = spark.createDataFrame(e, EDGES), spark.createDataFrame([(f"c{i}",) for i in range(340)], "node string")
    assert shuffled(spark, lambda: gr.counterparts(edges, seeds)) < 15_000
    got = {r.node: (r.depth, r.reach) for r in gr.counterparts(edges, seeds).collect()}
    assert got == {f"h{i}": (1, 340) for i in range(300)} | {f"c{i}": (1, 340 if i >= 300 else 40) for i in range(340)}


@pytest.mark.parametrize("block, rows, groups", [(64, 100_000, 250_000), (128, 5, 10), (1024, 40, 250_000)])
def test_counterparts_are_all(spark, monkeypatch, block, rows, groups):
    """Several blocks of seeds, words in turns, repeated edges and seeds, unknown relations, nulls: as all pairs give."""
    for k, v in (("BLOCK", block), ("WORD_ROWS", rows), ("GROUPS", groups), ("SHARES", 2)):
        monkeypatch.setattr(gr, k, v)
    dice = random.Random(block)
    e = [(f"n{dice.randrange(700)}", f"E{dice.randrange(9)}", dice.choice(["CALLS_ENDPOINT", "IMPLEMENTS_ENDPOINT", "IMPLEMENTS_ENDPOINT", "USES_TYPE"])) for _ in range(1500)]
    e += e[:50] + [("n1", None, "CALLS_ENDPOINT"), ("n2", None, "IMPLEMENTS_ENDPOINT"), ("n3", "E1", None), ("n4", "0E1", "CALLS_ENDPOINT"), ("n5", "E1", "IMPLEMENTS_ENDPOINT")]
    s = [f"n{i}" for i in range(0, 700, 2)] + ["n2", "away", None]
    met = {}
    for a, x, r in e:
        for b, y, q in e:
            if x == y and x is not None and None not in (r, q) and r != q and r in gr.ENDPOINTS and q in gr.ENDPOINTS and a in s:
                met.setdefault(b, set()).add(a)
    got = gr.counterparts(spark.createDataFrame(e, EDGES), spark.createDataFrame([(x,) for x in s], "node string")).collect()
    assert sorted((r.node, r.depth, r.reach) for r in got) == sorted((k, 1, len(v)) for k, v in met.items())


def test_counterparts_of_none(spark):
    edges = spark.createDataFrame([("a", "E", "CALLS_ENDPOINT"), ("b", "E", "IMPLEMENTS_ENDPOINT"), (None, "E", "IMPLEMENTS_ENDPOINT")], EDGES)
    of = lambda *s: sorted((r.node or "", r.reach) for r in gr.counterparts(edges, spark.createDataFrame([(x,) for x in s], "node string")).collect())
    assert of() == [] and of("away") == [] and of("b") == [("a", 1)] and of("a") == [("", 1), ("b", 1)]
