import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from strandline.sources import incremental as inc

FEED = "id long, target string, target_hash string, status string, updated_at long, landed_at timestamp_ntz, run_id long"
RUNS = "run_id long, started_at timestamp_ntz, cutoff_at timestamp_ntz, status string"
T0 = datetime(2026, 1, 1)


def brute(feed, runs):
    ok = sorted({(c, s, r) for r, s, c, st in runs if st and st.strip().lower() == "succeeded" and c})
    out, before = [], {}
    for c, _, r in ok:
        state = {}
        for i, t, h, st, u, at, _ in feed:
            if at is None or at > c or not st or st.strip().lower() != "completed" or u is None or not (h or "").strip():
                continue
            k = (u if abs(u) >= 10**11 else u * 1000, i, h)
            if t not in state or k > state[t]:
                state[t] = k
        now = {t: k[2] for t, k in state.items()}
        out += [(r, t) for t, h in now.items() if before.get(t, None) != h or t not in before]
        before = now
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(4))
def test_replay_matches_brute_force(spark, seed):
    rng = random.Random(seed)
    feed = []
    for _ in range(rng.randint(0, 120)):
        u = rng.choice([None, *range(1_000_000, 1_000_010)])
        row = (rng.randint(1, 30), rng.choice(["a", "b", "c", None]), rng.choice(["h1", "h2", "h3", "", " ", None]), rng.choice(["completed", " Completed", "failed", None, "COMPLETED "]), u if u is None or rng.random() < 0.5 else u * 1000, rng.choice([None, T0 + timedelta(hours=rng.randint(0, 40))]), 5)
        feed += [row] * rng.choice([1, 1, 2])
    runs = [(i, T0 + timedelta(hours=5 * i), T0 + timedelta(hours=5 * (i - rng.choice([0, 0, 1]))), rng.choice(["succeeded", "Succeeded ", "failed", "running", None])) for i in range(8)]
    runs += runs[:2]
    # equal (updated_at, id) with different hashes are ordered by the hash on both sides
    got = inc.replay(spark.createDataFrame(feed, FEED), spark.createDataFrame(runs, RUNS))
    assert got.columns == ["run_id", "target", "checksum"]
    assert sorted(((r.run_id, r.target) for r in got.collect()), key=str) == brute(feed, runs)


def test_replay_empty(spark):
    f, r = spark.createDataFrame([], FEED), spark.createDataFrame([], RUNS)
    assert inc.replay(f, r).count() == 0
    one = spark.createDataFrame([(1, "a", "h", "completed", 1, T0, 1)], FEED)
    assert inc.replay(one, r).count() == 0


def test_pending_is_null_safe(spark):
    a = spark.createDataFrame([("x", None), (None, "1"), ("y", "2")], "k string, c string")
    m = spark.createDataFrame([("x", None), (None, "1"), ("y", "3")], "k string, c string")
    assert [r.k for r in inc.pending(a, m, ["k"], ["c"]).collect()] == ["y"]


def test_files_once_each_over_failures(spark, tmp_path):
    src, state, out = tmp_path / "in", tmp_path / "state", tmp_path / "out"
    src.mkdir()
    (src / "a.txt").write_text("one")
    (src / "b.txt").write_text("two")
    make = lambda: inc.IncrementalInput(spark, str(src), str(state), str(out), "*.txt")

    def read(todo):
        return todo.select(F.element_at(F.split("path", "/"), -1).alias("name"), "checksum")

    def broken(todo):
        return read(todo).withColumn("x", F.raise_error(F.lit("lost")))

    with pytest.raises(Exception):
        make().run(broken)
    assert make().output() is None
    first = make().run(read)
    assert first and make().run(read) is None
    (src / "c.txt").write_text("three")
    (src / "a.txt").write_text("one, changed")
    second = make().run(read)
    assert second != first and make().committed() == [first, second]
    names = sorted(r.name for r in make().output().collect())
    assert names == ["a.txt", "a.txt", "b.txt", "c.txt"]
    # A crash after the output and before the manifest: the same batch again, nothing twice.
    (src / "d.txt").write_text("four")
    i = make()
    rename = i._fs
    class NoRename:
        def __getattr__(self, n):
            return (lambda *a: False) if n == "rename" else getattr(rename, n)
    i._fs = NoRename()
    with pytest.raises(OSError):
        i.run(read)
    assert len(make().output().collect()) == 4
    make().run(read)
    assert sorted(r.name for r in make().output().collect()) == ["a.txt", "a.txt", "b.txt", "c.txt", "d.txt"]


class Names:
    """Reads names; can do something while it processes, once."""

    def __init__(self, meanwhile=None):
        self.meanwhile, self.seen = meanwhile, []

    def __call__(self, todo):
        self.seen.append(sorted(r.path.split("/")[-1] for r in todo.collect()))
        if self.meanwhile:
            self.meanwhile()
            self.meanwhile = None
        return todo.select(F.element_at(F.split("path", "/"), -1).alias("name"), "checksum")


def folder(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    return src, lambda: inc.IncrementalInput(spark, str(src), str(tmp_path / "state"), str(tmp_path / "out"), "*.txt")


def put(path, text, seconds):
    import os

    path.write_text(text)
    os.utime(path, (1_700_000_000 + seconds, 1_700_000_000 + seconds))


def test_a_file_that_goes_back_is_a_change(spark, tmp_path):
    src, make = folder(spark, tmp_path)
    for i, text in enumerate(["A", "B", "A"]):
        put(src / "a.txt", text, i)
        assert make().run(Names()) is not None
    assert make().run(Names()) is None
    assert [r.name for r in make().output().collect()] == ["a.txt"] * 3 and make().manifest().count() == 1


def test_only_what_looks_changed_is_read(spark, tmp_path):
    src, make = folder(spark, tmp_path)
    put(src / "a.txt", "A", 0)
    put(src / "b.txt", "B", 0)
    make().run(Names())
    put(src / "a.txt", "A", 5)  # touched, not changed
    n = Names()
    assert make().run(n) is None and n.seen == [[]]
    n = Names()
    assert make().run(n) is None and n.seen == [], "its new time is known now"
    put(src / "b.txt", "C", 5)
    n = Names()
    make().run(n)
    assert n.seen == [["b.txt"]]


def test_overwritten_while_it_is_processed(spark, tmp_path):
    src, make = folder(spark, tmp_path)
    put(src / "a.txt", "A", 0)
    n = Names(lambda: put(src / "a.txt", "later", 9))
    make().run(n)
    assert n.seen == [["a.txt"], ["a.txt"]], "once for each version"
    out = make().output().collect()
    import hashlib

    assert [r.checksum for r in out] == [hashlib.sha256(b"later").hexdigest()] and make().run(Names()) is None


def test_crash_at_each_step(spark, tmp_path, monkeypatch):
    src, make = folder(spark, tmp_path)
    put(src / "a.txt", "A", 0)
    for step in ("stage", "_changed", "commit"):
        def fail(*a, **k):
            raise KeyError("crash")

        with monkeypatch.context() as m:
            m.setattr(inc.IncrementalInput, step, fail)
            with pytest.raises(KeyError):
                make().run(Names())
        assert make().committed() == [] and make().output() is None
    first = make().run(Names())
    assert make().committed() == [first] and make().output().count() == 1 and make().run(Names()) is None


def test_snapshots_of_manifests(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(inc, "SNAPSHOT_EVERY", 2)
    src, make = folder(spark, tmp_path)
    for i in range(5):
        put(src / f"f{i}.txt", str(i), i)
        put(src / "same.txt", str(i), i)
        make().run(Names())
    assert len(make()._named("snapshot=")) == 2 and make().manifest().count() == 6
    assert make().run(Names()) is None and make().output().count() == 10


def test_large_files_are_not_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(inc, "HASHED_BYTES", 3)
    src, make = folder(spark, tmp_path)
    put(src / "a.txt", "long text", 0)
    put(src / "b [x]{1}.txt", "B", 0)
    make().run(Names())
    assert sorted(r.checksum[:6] for r in make().output().collect())[1] == "unread"
    assert make().run(Names()) is None
    put(src / "a.txt", "long yarn", 1)
    n = Names()
    make().run(n)
    assert n.seen == [["a.txt"]]


def test_batches_of_runs_are_written_and_committed(spark, tmp_path):
    feed = spark.createDataFrame([(1, "a", "h1", "completed", 1, T0, 1), (2, "a", "h2", "completed", 2, T0 + timedelta(hours=3), 1), (3, None, "h", "completed", 2, T0 + timedelta(hours=3), 1)], FEED)
    runs = spark.createDataFrame([(1, T0, T0 + timedelta(hours=1), "succeeded"), (2, T0, T0 + timedelta(hours=9), "succeeded"), (3, T0, T0 + timedelta(hours=12), "succeeded")], RUNS)
    for _ in range(2):
        got = inc.replay_batches(feed, runs, str(tmp_path / "x"))
        assert sorted((tuple(r) for r in got.collect()), key=str) == [(1, "a", "h1"), (2, "a", "h2"), (2, None, "h")]
    import shutil

    assert sorted(p.name for p in (tmp_path / "x" / "state").iterdir() if p.name.startswith("batch=")) == ["batch=1", "batch=2"]
    shutil.rmtree(tmp_path / "x" / "state" / "batch=2")
    assert inc.Batches(spark, str(tmp_path / "x/state"), str(tmp_path / "x/out")).output().count() == 1
    assert inc.replay_batches(feed.where("false"), runs, str(tmp_path / "y")).count() == 0


def test_checkpoint_folder_must_be_shared_on_a_cluster():
    from types import SimpleNamespace as N

    from strandline.session import checkpoint_dir

    sc = N(getCheckpointDir=lambda: None, master="spark://x")
    with pytest.raises(RuntimeError):
        checkpoint_dir(N(sparkContext=sc, conf=N(get=lambda *a: None)))
