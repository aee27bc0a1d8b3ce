from strandline.streaming import queue as q


def items(spark, *rows):
    return spark.createDataFrame(list(rows), q.ITEM)


def arrivals(spark, *rows):
    return spark.createDataFrame(list(rows), "workspace string, kind string, target string, at long, id long, extra string")


def left(df):
    return sorted((r.target, r.enqueued_at, r.updated_at, r.generation) for r in df.collect())


def test_coalesce_and_full(spark):
    empty = items(spark)
    after, said = q.admit(empty, arrivals(spark, ("w", "file", "a", 5, 1, ""), ("w", "file", "b", 6, 2, ""), ("w", "file", "a", 7, 3, ""), ("w", "file", "b", 8, 4, "")), cap=1)
    assert left(after) == [("a", 5, 7, 2)]
    assert {r.id: r.outcome for r in said.collect()} == {1: "queued", 2: "queue_full", 3: "coalesced", 4: "queue_full"}
    more, said = q.admit(after, arrivals(spark, ("w", "file", "a", 9, 5, ""), (None, "file", "c", 9, 6, "")), cap=2)
    assert left(more) == [("a", 5, 9, 3), ("c", 9, 9, 1)] and {r.id: r.outcome for r in said.collect()} == {5: "coalesced", 6: "queued"}
    assert q.admit(empty, arrivals(spark))[0].count() == 0


def test_batches(spark):
    files = items(spark, *[("w", "file", f"f{i}", 0, 100 * i, 1) for i in range(5)])
    take = lambda now, **k: [r.target for r in q.next_batch(files, now, **k).collect()]
    assert take(499) == [] and take(700) == ["f0", "f1", "f2"] and take(9_999, size=2) == ["f0", "f1"] and len(take(0, force=True)) == 5
    mixed = files.unionByName(items(spark, ("w", "project", "p", 0, 250, 1), ("v", "project", "o", 0, 200, 1)))
    assert [r.target for r in q.next_batch(mixed, 9_999).collect()] == ["o"], "alone"
    batch = q.next_batch(files, 700)
    touched = files.where("target <> 'f1'").unionByName(items(spark, ("w", "file", "f1", 0, 800, 2)))
    assert sorted(r.target for r in q.taken(touched, batch).collect()) == ["f1", "f3", "f4"]
