from datetime import datetime, timedelta


from strandline.streaming import jobs, windows

T0 = datetime(2026, 1, 1)


def run(spark, df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def source(spark, tmp_path, data, schema):
    # A row far in the future moves the watermark past all others.
    df = spark.createDataFrame(data, schema)
    df.repartition(1).write.mode("overwrite").parquet(str(tmp_path / "s"))
    return spark.read.parquet(str(tmp_path / "s")), spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "s"))


def test_debounce_stream_equals_table(spark, tmp_path):
    data = [("a", T0 + timedelta(milliseconds=m)) for m in (0, 300, 700, 2000, 2100)] + [("b", T0 + timedelta(milliseconds=100)), ("end", T0 + timedelta(days=2))]
    table, stream = source(spark, tmp_path, data, "target string, ts timestamp")
    want = sorted((r.target, r.enqueued_at, r.generation) for r in windows.debounce(table, "ts", ["target"]).collect() if r.target != "end")
    got = sorted((r.target, r.enqueued_at, r.generation) for r in run(spark, windows.debounce(stream, "ts", ["target"]), "deb", "append").collect() if r.target != "end")
    assert got == want and [g for _, _, g in want] == [3, 2, 1]


def test_tumbling_stream_equals_table(spark, tmp_path):
    data = [("x", T0 + timedelta(minutes=m), float(m)) for m in range(0, 300, 7)] + [("x", T0 + timedelta(days=2), 0.0)]
    table, stream = source(spark, tmp_path, data, "k string, ts timestamp, value double")
    want = sorted(tuple(r) for r in windows.tumbling(table, "ts", "1 hour", ["k"]).collect())[:-1]
    got = sorted(tuple(r) for r in run(spark, windows.tumbling(stream, "ts", "1 hour", ["k"]), "tum", "append").collect())
    assert got == want


def test_job_states(spark, tmp_path):
    data = [(1, "a", "running"), (2, "a", "failed"), (3, "a", " FAILED"), (4, "a", "failed"), (5, "b", "failed"), (6, "b", "completed"), (7, "b", "running"), (8, None, "failed"), (9, "c", None), (9, "d", "dead_letter")]
    table, stream = source(spark, tmp_path, data, "id long, target string, status string")
    want = {r.target: (r.state, r.failures) for r in jobs.states(table).collect()}
    assert want == {"a": ("dead_letter", 3), "b": ("running", 0), "c": (None, 0), "d": ("failed", 1)}
    got = {r.target: (r.state, r.failures) for r in run(spark, jobs.state_stream(stream), "jobs", "update").collect()}
    assert got == want


def test_job_states_over_batches(spark, tmp_path):
    """Rows out of order, and delivered again in a later batch, give what the whole table gives."""
    import random

    rng = random.Random(4)
    rows = [(i, rng.choice("ab"), rng.choice(["running", "failed", "failed", "completed", "dead_letter"])) for i in range(40)]
    said = rows + rng.sample(rows, 15)
    rng.shuffle(said)
    for n in range(5):
        spark.createDataFrame(said[n::5], "id long, target string, status string").coalesce(1).write.mode("append").parquet(str(tmp_path / "s"))
    table = spark.read.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "s"))
    seen: dict = {}

    def keep(df, _):
        seen.update({r.target: (r.state, r.failures) for r in df.collect()})

    jobs.state_stream(stream).writeStream.foreachBatch(keep).outputMode("update").trigger(availableNow=True).start().awaitTermination()
    assert seen == {r.target: (r.state, r.failures) for r in jobs.states(table).collect()}


def test_evict(spark):
    e = spark.createDataFrame([("o", i, i) for i in range(10)], "owner string, u int, k int")
    assert sorted(r.k for r in jobs.evict(e, "owner", "u", "k", 3, 2).collect()) == [7, 8, 9]
    assert jobs.evict(e, "owner", "u", "k", 3, 99).count() == 0
