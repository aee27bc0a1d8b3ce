import pytest
from pyspark.sql import functions as F

from strandline.sources import files, stores


def put(root, **texts):
    for name, text in texts.items():
        p = root / name.replace("__", "/").replace("_dot_", ".")
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)


def test_file_tree(spark, tmp_path):
    put(tmp_path, a_dot_py="1", sub__b_dot_ts="2", sub__c_dot_txt="3", node_modules__d_dot_py="4", gen__e_dot_py="5", gen__keep_dot_py="6", sub__gen__f_dot_py="7")
    tree = lambda *ignore: sorted(r.path for r in files.file_tree(spark, str(tmp_path), ignore=ignore).collect())
    assert tree() == ["a.py", "gen/e.py", "gen/keep.py", "sub/b.ts", "sub/gen/f.py"]
    assert tree("# note", "", "/gen/", "*.ts") == ["a.py", "sub/gen/f.py"]
    assert tree("gen/", "!gen/keep.py") == ["a.py", "gen/keep.py", "sub/b.ts"]
    assert tree("s?b/**/f.py", "/a.py") == ["gen/e.py", "gen/keep.py", "sub/b.ts"]
    got = files.file_tree(spark, f"file://{tmp_path}", ["txt"], content=True).first()
    assert (got.path, bytes(got.content), got["size"]) == ("sub/c.txt", b"3", 1)


def test_generated_committed_documents(spark, tmp_path):
    df = spark.createDataFrame([("a.js", "x" * 6000), ("a.py", "x" * 6000), ("b.ts", "ok\n//# sourceMappingURL=b.map\n"), ("c.ts", "// sourceMappingURL\nok"), ("d.js", None)], "path string, text string")
    assert {r.path: r.g for r in df.select("path", files.is_generated(F.col("text"), F.col("path")).alias("g")).collect()} == {"a.js": True, "a.py": False, "b.ts": True, "c.ts": False, "d.js": False}
    assert sorted(r.path for r in files.committed(df, df.where("path <> 'a.js'"), df.where("path = 'c.ts'")).collect()) == ["a.py", "b.ts", "d.js"]
    put(tmp_path, x_dot_md="one\ntwo\n", y__z_dot_md="", n_dot_txt="no")
    assert sorted(tuple(r) for r in files.documents(spark, str(tmp_path)).collect() if r.text) == [("x.md", "one\ntwo\n")]


def test_packs_include_packs(spark, tmp_path):
    a, b = str(tmp_path / "a.json"), str(tmp_path / "b.parquet")
    spark.createDataFrame([(1, None), (None, b), (None, a)], "id int, include string").write.json(a)
    spark.createDataFrame([(2, "x")], "id int, note string").write.parquet(b)
    assert sorted(r.id for r in files.pack(spark, a).collect()) == [1, 2]


def test_polling(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))

    def tick():
        files.polled(spark, src, "id int", files_a_tick=1).writeStream.format("parquet").option("checkpointLocation", ck).trigger(availableNow=True).start(out).awaitTermination()
        return sorted(r.id for r in spark.read.schema("id int").parquet(out).collect())

    put(tmp_path, in__a_dot_json='{"id": 1}')
    assert tick() == [1]
    put(tmp_path, in__b_dot_json='{"id": 2}\n{"id": 3}')
    assert tick() == [1, 2, 3] == tick()


@pytest.fixture
def table(spark, tmp_path):
    return stores.KeyedTable(spark, str(tmp_path / "t"), ["k"], "k string, v int")


def rows(t):
    return sorted(((r.k, r.v) for r in t.read().collect()), key=str)


def test_keyed_table(spark, table):
    make = lambda *r: spark.createDataFrame(list(r), "k string, v int, extra string")
    assert rows(table) == [] and table.version() == 0
    assert table.upsert(make(("a", 1, ""), ("b", 2, ""), (None, 3, ""))) == "delta"
    table.upsert(make(("b", 5, ""), ("b", 4, ""), (None, 6, "")), [F.desc("v")])
    assert rows(table) == [("a", 1), ("b", 5), (None, 6)]
    table.delete_keys(make(("a", 0, ""), ("zz", 0, "")))
    table.delete_where(F.col("k") == "b")
    assert rows(table) == [(None, 6)] and len(table.names("v=")) == 2 and table.version() == 4


def test_bulk_only_if_nothing_is_lost(spark, table):
    many = spark.range(600).select(F.col("id").cast("string").alias("k"), F.lit(1).alias("v"))
    assert table.upsert(many) == "bulk" and table.upsert(many.where("k <> '7'").withColumn("v", F.lit(2))) == "delta"
    assert len(rows(table)) == 600 and dict(rows(table))["7"] == 1


def test_a_failed_write_changes_nothing(spark, table):
    table.upsert(spark.createDataFrame([("a", 1)], "k string, v int"))
    with pytest.raises(Exception):
        table.upsert(spark.createDataFrame([("b", 1)], "k string, v int").withColumn("v", F.raise_error(F.lit("lost")).cast("int")))
    assert rows(table) == [("a", 1)]


def test_history_goes_with_its_messages(spark, tmp_path):
    h = stores.History(spark, str(tmp_path), "id string, updated_at string", "id string, conversation_id string")
    h.conversations.upsert(spark.createDataFrame([("c", "2026-01-01"), ("d", "2026-02-01")], "id string, updated_at string"))
    h.messages.upsert(spark.createDataFrame([("m", "c"), ("n", "d"), ("o", None)], "id string, conversation_id string"))
    h.prune(F.lit("2026-01-15"))
    assert [r.id for r in h.conversations.read().collect()] == ["d"] and sorted(r.id for r in h.messages.read().collect()) == ["n", "o"]


def test_log_rotates(spark, tmp_path):
    log = stores.JsonLog(spark, str(tmp_path / "log"), "i int, s string", rows=4, parts=3)
    make = lambda a, b: spark.range(a, b).select(F.col("id").cast("int").alias("i"), F.concat(F.lit("s"), "id").alias("s"))
    assert log.read().count() == 0 and log.tail(3, "i").count() == 0
    log.append(make(0, 0), "i")
    log.append(make(0, 8), "i")
    log.append(make(8, 16), "i")
    assert len(log.names("part=")) == 3 and min(r.i for r in log.read().collect()) >= 1
    assert [r.i for r in log.tail(3, "i").collect()] == [15, 14, 13] and [r.i for r in log.tail(1, "i", F.col("i") < 14).collect()] == [13]


def test_manifest_and_jobs_and_metrics(spark, tmp_path):
    m = stores.Manifest(spark, str(tmp_path / "m"))
    assert m.read("a int") is None
    for a in (1, 2):
        m.write(spark.createDataFrame([(a,)], "a int"))
    assert [r.a for r in m.read("a int").collect()] == [2]
    j = spark.createDataFrame([(1, "t", "h", "failed", 1, 5), (2, "t", "h", " FAILED", 2, 9), (3, "t", "h", "failed", 3, 10), (4, "t", "g", "completed", 1, 11)], "id long, target string, target_hash string, status string, attempts int, updated_at long")
    assert stores.start_job(j, "t", "h", 0) == (2, 3) and stores.start_job(j, "t", "g", 0) == (5, 1) and stores.start_job(j.where("false"), "t", "h", 0) == (1, 1)
    c = spark.createDataFrame([("n", {"b": "2", "a": "1"}, 1.0), ("n", {"a": "1", "b": "2"}, 2.5), ("o", {}, 4.0)], "name string, labels map<string,string>, value double")
    g = spark.createDataFrame([("x", {}, 1.0, 1), ("x", {}, 7.0, 2)], "name string, labels map<string,string>, value double, at int")
    assert [r.line for r in stores.metrics_text(c, g).collect()] == ["# TYPE n counter", 'n{a="1",b="2"} 3.5', "# TYPE o counter", "o 4", "# TYPE x gauge", "x 7"]
